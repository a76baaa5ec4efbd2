"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: Column, end: Column, chunk_units: int = 1_000_000) -> DataFrame:
    """Maximal covered periods of each entity and the gaps between them: (kind, keys, start_at, end_at).

    start and end are whole numbers (any unit). Starts and ends are ranked independently: the
    rank of a time is the number of starts, or of ends, up to it. A gap lies between the r-th end
    and the next start exactly if the start of rank r + 1 lies after the end of rank r, that is,
    if at that end no more starts than ends have come; the boundaries found so are paired with the
    last one of the other kind. Touching intervals belong together. Rows that lack a bound or do
    not end after they start don't count; null keys form entities of their own, and repeated rows
    change nothing.

    An entity may hold a third of all rows, so it is ordered in chunks of time, each of at most
    ``chunk_units`` distinct times. The points are shuffled and sorted once, by chunk; one small
    row per chunk goes through a window over its entity and brings back the ranks before the chunk
    and the last boundaries before it.
    """
    flat = [f"_k{i}" for i in range(len(keys))]
    rows = intervals.select(*[F.col(k).alias(x) for k, x in zip(keys, flat)], start.cast("long").alias("s"), end.cast("long").alias("e")).where("s is not null and e is not null and e > s")
    # null keys must meet in equi-joins, so a bit mask tells which keys are null and their values never are
    blank = {x: F.lit("" if t == "string" else 0).cast(t) for x, t in rows.dtypes}
    mask = sum((F.when(F.col(x).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(flat)), F.lit(0))
    entity = [*flat, "_nulls"]
    chunk = [*entity, "chunk"]
    points = rows.select(
        *[F.coalesce(F.col(x), blank[x]).alias(x) for x in flat], mask.alias("_nulls"),
        F.inline(F.array(F.struct(F.col("s").alias("t"), F.lit(1).cast("long").alias("up"), F.lit(0).cast("long").alias("down")), F.struct(F.col("e").alias("t"), F.lit(0).cast("long").alias("up"), F.lit(1).cast("long").alias("down")))),
    )
    placed = points.withColumn("chunk", F.floor(F.col("t") / chunk_units).cast("long")).repartition(*chunk)
    times = placed.groupBy(*chunk, "t").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    inside = Window.partitionBy(*chunk).orderBy("t")
    whole = Window.partitionBy(*chunk)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = times.withColumn("starts", F.sum("up").over(upto)).withColumn("ends", F.sum("down").over(upto)).withColumn("open", F.col("starts") - F.col("ends"))

    # Where a chunk closes, its number of open intervals is at its least. So its last closing, if it has one, and the first start behind that are known before the ranks are.
    least = ranked.withColumn("least", F.min("open").over(whole)).withColumn("last", F.max(F.when(F.col("open") == F.col("least"), F.col("t"))).over(whole))
    is_start = F.col("up") > 0
    of_chunk = least.groupBy(*chunk).agg(
        F.sum("up").alias("ups"), F.sum("down").alias("downs"), F.first("least").alias("least"), F.first("last").alias("last"),
        F.min(F.when(is_start, F.col("t"))).alias("first_start"), F.min(F.when(is_start & (F.col("t") > F.col("last")), F.col("t"))).alias("next_start"),
    )
    before = Window.partitionBy(*entity).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = of_chunk.withColumn("starts0", F.coalesce(F.sum("ups").over(before), F.lit(0))).withColumn("ends0", F.coalesce(F.sum("downs").over(before), F.lit(0)))
    held = F.col("starts0") - F.col("ends0")
    closed = F.when(held + F.col("least") == 0, F.col("last"))
    opened = F.when(closed.isNotNull(), F.col("next_start")).when(held == 0, F.col("first_start"))
    carried = sums.select(*chunk, "starts0", "ends0", F.last(opened, ignorenulls=True).over(before).alias("opened0"), F.last(closed, ignorenulls=True).over(before).alias("closed0"))

    both = ranked.join(carried, chunk)
    start_rank, end_rank = F.col("starts0") + F.col("starts"), F.col("ends0") + F.col("ends")
    closes = start_rank == end_rank
    opens = is_start & (start_rank - F.col("up") == end_rank - F.col("down"))
    marked = both.withColumn("closes", closes).withColumn("opens", opens).where("closes or opens")
    last = lambda flag, carry: F.coalesce(F.last(F.when(F.col(flag), F.col("t")), ignorenulls=True).over(upto), F.col(carry))
    found = marked.select(*entity, "t", "closes", F.when(F.col("closes"), last("opens", "opened0")).otherwise(last("closes", "closed0")).alias("from")).where("from is not null")
    back = [F.when(F.col("_nulls").bitwiseAND(1 << i) == 0, F.col(x)).alias(k) for i, (k, x) in enumerate(zip(keys, flat))]
    return found.select(F.when(F.col("closes"), "period").otherwise("gap").alias("kind"), *back, F.col("from").alias("start_at"), F.col("t").alias("end_at"))


def roi_periods(roi: DataFrame) -> DataFrame:
    """Periods and gaps of detections per recording and band: (kind, rec_id, min_f, max_f, start_e5, end_e5).

    Band edges are rounded to whole Hz and times counted in units of 0.00001 s. Times and edges
    that are no finite numbers up to 9e12 either way have no such unit and count as missing.
    """
    e5 = lambda c: F.round(F.col(c) * 100000)
    finite = lambda c: F.when(F.col(c).between(-9e12, 9e12), F.col(c))
    banded = roi.select("rec_id", F.round(finite("min_f")).cast("long").alias("min_f"), F.round(finite("max_f")).cast("long").alias("max_f"), finite("min_t").alias("min_t"), finite("max_t").alias("max_t")).where("max_t > min_t")
    return periods_and_gaps(banded, ["rec_id", "min_f", "max_f"], e5("min_t"), e5("max_t")).withColumnsRenamed({"start_at": "start_e5", "end_at": "end_e5"})
