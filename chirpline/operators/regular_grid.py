"""Irregular recordings onto the regular slots of their deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def slots(deployment: DataFrame, chunk_slots: int = 4096) -> DataFrame:
    """All slots of every deployment: (deploy_id, sensor_name, k, slot_us, slot_end_us).

    Slot k starts at start_at + k * step_s; the last one is cut at end_at. A deployment without
    sensor, bounds or a positive step, or that ends before it starts, has no slots. Repeated
    deployment rows count once. A deployment is cut into chunks of slots first, which are spread
    over the tasks, so none holds the slots of a long one as an array.
    """
    d = deployments(deployment)
    n = F.ceil((F.col("end_us") - F.col("start_us")) / F.col("step_us")).cast("long")
    chunks = d.withColumn("n", n).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk_slots).cast("long")))).repartition("deploy_id", "first")
    each = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + chunk_slots, F.col("n")) - 1))
    return chunks.select("deploy_id", "sensor_name", "start_us", "end_us", "step_us", each.alias("k")).select(
        "deploy_id",
        "sensor_name",
        "k",
        (F.col("start_us") + F.col("k") * F.col("step_us")).alias("slot_us"),
        F.least(F.col("start_us") + (F.col("k") + 1) * F.col("step_us"), F.col("end_us")).alias("slot_end_us"),
    )


def deployments(deployment: DataFrame) -> DataFrame:
    return (
        deployment.select(
            "deploy_id",
            "sensor_name",
            _us(F.col("start_at")).alias("start_us"),
            _us(F.col("end_at")).alias("end_us"),
            (F.col("step_s").cast("long") * 1_000_000).alias("step_us"),
        )
        .where("deploy_id is not null and sensor_name is not null and step_us > 0 and end_us > start_us")
        .distinct()
    )


def covered_slots(recordings: DataFrame, deployment: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Bucket-aggregated readings: (deploy_id, k, n_readings, seconds, last_us) of each slot that a recording runs in.

    A recording runs from date for length seconds, the end excluded; rows without sensor, date or
    a finite length above 0 don't count. Rows with the same sensor, start and end are one recording
    that was listed again. What lies outside all deployments is cut off before anything is
    counted, so that an absurd length costs no more than the days of the deployments. Recordings meet the deployments of their sensor by an
    equi-join on (sensor, day), for which both are split at midnights: the sensor that holds a
    third of all rows is spread over its days, and no range join or broadcast is needed.
    """
    # two numbers for the whole archive
    ends = deployments(deployment).agg(F.min("start_us").alias("a"), F.max("end_us").alias("b")).first()
    lo, hi = F.lit(ends.a or 0).cast("long"), F.lit(ends.b or 0).cast("long")
    runs = F.ceil(F.least(F.round(F.col("length") * 1e6, 3), F.greatest(hi - F.col("from_us"), F.lit(0)).cast("double"))).cast("long")
    r = (
        recordings.select("sensor_name", _us(F.col("date")).alias("from_us"), F.col("length").cast("double").alias("length"))
        .where("sensor_name is not null and length > 0 and length < double('infinity')")
        .where(F.col("from_us") < hi)
        .withColumn("until_us", F.col("from_us") + runs)
        .where(F.col("until_us") > lo)
        .select("sensor_name", "from_us", "until_us")
        .distinct()
    )
    day = lambda us: F.floor(us / bucket_us).cast("long")
    r = r.withColumn("day", F.explode(F.sequence(day(F.greatest("from_us", lo)), day(F.col("until_us") - 1))))
    d = deployments(deployment).withColumn("day", F.explode(F.sequence(day(F.col("start_us")), day(F.col("end_us") - 1))))
    # the part of the recording inside this day and deployment
    begins = F.greatest("from_us", "start_us", F.col("day") * bucket_us)
    stops = F.least("until_us", "end_us", (F.col("day") + 1) * bucket_us)
    both = r.join(d, ["sensor_name", "day"]).withColumn("lo", begins).withColumn("hi", stops).where("hi > lo")
    k = lambda us: F.floor((us - F.col("start_us")) / F.col("step_us")).cast("long")
    hit = both.withColumn("k", F.explode(F.sequence(k(F.col("lo")), k(F.col("hi") - 1))))
    slot = F.col("start_us") + F.col("k") * F.col("step_us")
    seconds = (F.least("hi", slot + F.col("step_us")) - F.greatest("lo", slot)) / 1e6
    # a recording over midnight has two parts in one slot and counts with the first
    first = F.greatest(F.col("lo"), slot) == F.greatest(F.col("from_us"), slot)
    return hit.groupBy("deploy_id", "k").agg(
        F.sum(first.cast("long")).alias("n_readings"), F.sum(seconds).alias("seconds"), F.max("from_us").alias("last_us")
    )


def slot_readings(recordings: DataFrame, deployment: DataFrame) -> DataFrame:
    """Every slot with its bucket-aggregated readings, null where no recording runs: (deploy_id, sensor_name, k, slot_us, slot_end_us, n_readings, seconds, last_us)."""
    return slots(deployment).join(covered_slots(recordings, deployment), ["deploy_id", "k"], "left")


def regular_series(recordings: DataFrame, deployment: DataFrame, max_gap_slots: int = 3, chunk_slots: int = 4096) -> DataFrame:
    """A row for each slot: (deploy_id, sensor_name, k, slot_us, status, n_readings, seconds, carried_us).

    status is ``observed`` if a recording runs in the slot, ``carried`` if the last observed slot
    lies at most ``max_gap_slots`` back (carried_us is then its latest start), else ``missing``.
    The last observation is carried inside chunks of ``chunk_slots`` slots, and over a chunk's
    border from the aggregate of the chunk before it, so no task orders a whole deployment.
    """
    if max_gap_slots > chunk_slots:
        raise ValueError("max_gap_slots must not exceed chunk_slots")
    chunk = F.floor(F.col("k") / chunk_slots).cast("long")
    hits = covered_slots(recordings, deployment)
    grid = slots(deployment, chunk_slots).join(hits, ["deploy_id", "k"], "left").withColumn("chunk", chunk)
    before = (
        hits.groupBy("deploy_id", (chunk + 1).alias("chunk"))
        .agg(F.max_by(F.struct("k", "last_us"), "k").alias("prev"))
    )
    seen = F.when(F.col("n_readings").isNotNull(), F.struct("k", "last_us"))
    w = Window.partitionBy("deploy_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(seen, ignorenulls=True).over(w), F.col("prev"))
    status = (
        F.when(F.col("n_readings").isNotNull(), "observed")
        .when(F.col("k") - F.col("last.k") <= max_gap_slots, "carried")
        .otherwise("missing")
    )
    return (
        grid.join(before, ["deploy_id", "chunk"], "left")
        .withColumn("last", last)
        .select(
            "deploy_id",
            "sensor_name",
            "k",
            "slot_us",
            status.alias("status"),
            F.coalesce("n_readings", F.lit(0)).cast("long").alias("n_readings"),
            F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
            F.when(status != "missing", F.col("last.last_us")).alias("carried_us"),
        )
    )


def empty_slots(readings: DataFrame) -> DataFrame:
    """The slots in which no recording runs: (sensor_name, slot_at in whole seconds). Takes what ``slot_readings`` or ``regular_series`` gives."""
    return readings.where("coalesce(n_readings, 0) = 0").select("sensor_name", F.floor(F.col("slot_us") / 1_000_000).cast("long").alias("slot_at")).distinct()
