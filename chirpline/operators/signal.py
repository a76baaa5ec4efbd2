"""Waveforms: one row ``(rec_id, x array<double>)`` for each recording, or long rows ``(rec_id, i, x)``.

A recording is the unit of work. What needs neighbours or frames is prepared inside the array, so
most operators need no shuffle but that of one aggregated row per recording and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.functions import decibel as db
from chirpline.session import checkpoint


def samples(signals: DataFrame) -> DataFrame:
    """Long form with the sample before: (rec_id, i, x, before). Null and empty arrays give no rows."""
    with_before = F.transform("x", lambda v, i: F.struct(i.cast("long").alias("i"), v.alias("x"), F.when(i > 0, F.get("x", i - 1)).alias("before")))
    return signals.select("rec_id", F.inline(with_before))


def frames(signals: DataFrame, nt: int) -> DataFrame:
    """Whole frames of nt samples, the tail dropped: (rec_id, k, frame array)."""
    n = F.floor(F.size("x") / nt).cast("int")
    each = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda k: F.struct(k.cast("long").alias("k"), F.slice("x", k * nt + 1, nt).alias("frame")))
    return signals.select("rec_id", F.inline(each))


def envelope(signals: DataFrame, nt: int) -> DataFrame:
    """The largest absolute value of each frame: (rec_id, k, e)."""
    return frames(signals, nt).select("rec_id", "k", F.array_max(F.transform("frame", F.abs)).alias("e"))


def energy_windowed(signals: DataFrame, fs: float, nt: int) -> DataFrame:
    """Mean square of frames after reflecting the end by 1 to nt samples up to whole frames, with the frames' centres: (rec_id, k, t, energy)."""
    n = F.size("x")
    pad = F.lit(nt) - n % nt  # a length of whole frames gets one more, as published
    padded = F.concat("x", F.when((pad > 0) & (n > pad), F.reverse(F.slice("x", n - pad, pad))).otherwise(F.array().cast("array<double>")))
    f = frames(signals.select("rec_id", padded.alias("x")), nt)
    square = F.aggregate(F.transform("frame", lambda v: v * v), F.lit(0.0), lambda a, v: a + v) / nt
    return f.select("rec_id", "k", ((F.col("k") + 0.5) * nt / fs).alias("t"), square.alias("energy"))


def normalise(signals: DataFrame, max_amp: float = 0.7) -> DataFrame:
    """Scale so that the largest absolute value is max_amp; silence stays silence."""
    peak = F.array_max(F.transform("x", F.abs))
    factor = F.transform(F.array(F.lit(max_amp) / F.greatest(peak, F.lit(db.MIN))), lambda f: F.transform("x", lambda v: v * f))[0]
    return signals.withColumn("x", F.when(peak > 0, factor).otherwise(F.col("x")))


def trim(signals: DataFrame, fs: float, min_t: float, max_t: float, pad: bool = False, constant: float = 0.0) -> DataFrame:
    """Samples from int(min_t fs) up to, not including, int(max_t fs); with pad, missing ones on both sides are constant."""
    lo, hi = int(min_t * fs), int(max_t * fs)
    if not pad:
        return signals.withColumn("x", F.slice("x", max(lo, 0) + 1, max(hi - max(lo, 0), 0)))
    return signals.withColumn("x", F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.coalesce(F.when(i >= 0, F.get("x", i)), F.lit(constant))))


def moments(value: str = "x") -> list[Column]:
    """Aggregates mean, population variance, and skewness and kurtosis with n - 1 in the sum and the population deviation."""
    n = F.count(value)
    correction = n / F.nullif(n - 1, F.lit(0))
    return [
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
        (F.skewness(value) * correction).alias("skew"),
        ((F.kurtosis(value) + 3) * correction).alias("kurt"),
    ]


def zero_crossing_rate(signals: DataFrame, fs: float) -> DataFrame:
    s = samples(signals)
    changed = (F.col("before").isNotNull() & ((F.col("x") > 0) != (F.col("before") > 0))).cast("long")
    return s.groupBy("rec_id").agg((F.sum(changed) / (F.count(F.lit(1)) / F.lit(float(fs)))).alias("zcr"))


def entropy(value: str) -> Column:
    """Aggregate: Shannon entropy over ln n of a positive series; 0 for one value, 1 for zeros alone.

    With S the sum, -sum(p ln p) = ln S - sum(v ln v) / S, so one pass is enough.
    """
    n, s = F.count(value), F.sum(value)
    h = F.ln(F.greatest(s, F.lit(db.MIN))) - F.sum(F.col(value) * F.ln(F.greatest(F.col(value), F.lit(db.MIN)))) / F.nullif(s, F.lit(0.0))
    return F.when(n == 1, F.lit(0.0)).when(s == 0, F.lit(1.0)).otherwise(h / F.ln(n))


def rescaled_entropy(series: DataFrame, by: list[str], value: str, out: str = "h") -> DataFrame:
    """``entropy`` of series that may have negative values: those that do are scaled to 0..1 first, the others are left as they are: (by, out).

    The bounds and the sums of a group combine before the shuffle; the scaled sums need the bounds, so the rows meet them in a join.
    """
    ends = series.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_lo") < 0, (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).otherwise(F.col(value))
    return series.join(ends, by).withColumn("_v", scaled).groupBy(*by).agg(entropy("_v").alias(out))


def median(value: str) -> Column:
    return F.percentile(value, F.lit(0.5))


def leq_periods(signals: DataFrame, nt: int, gain_db: float = 42.0, vadc: float = 2.0, sensitivity: float = -35.0, db_ref: float = 94.0) -> DataFrame:
    """Equivalent level of each period of nt samples: (rec_id, k, leq)."""
    square = F.aggregate(F.transform("frame", lambda v: v * v), F.lit(0.0), lambda a, v: a + v) / nt
    return frames(signals, nt).select("rec_id", "k", db.leq_of_rms(F.sqrt(square), gain_db, vadc, sensitivity, db_ref).alias("leq"))


def islands(series: DataFrame, by: list[str], order: str, on: Column) -> DataFrame:
    """Run-length encoding of a boolean series: (by, run, value, start, length). Null counts as false."""
    w = Window.partitionBy(*by).orderBy(order)
    v = series.withColumn("value", F.coalesce(on, F.lit(False)))
    edge = F.coalesce((F.col("value") != F.lag("value").over(w)).cast("long"), F.lit(0))
    runs = v.withColumn("edge", edge).withColumn("run", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.first("value").alias("value"), F.min(order).alias("start"), F.count(F.lit(1)).alias("length"))


def events(series: DataFrame, by: list[str], order: str, level: Column, dt: float, threshold: float, reject_s: float | None) -> DataFrame:
    """Share, mean duration and rate of runs at or above the threshold: (by, fraction, mean_s, per_s, n_events).

    With a rejection time, runs shorter than round(reject / dt) + 1 frames don't count. The share
    is of all n frames, the rate per (n - 1) dt seconds.
    """
    least = 1 if reject_s is None else int(round(reject_s / dt)) + 1
    runs = islands(series, by, order, level >= threshold)
    is_event = F.col("value") & (F.col("length") >= least)
    kept = F.sum(F.when(is_event, F.col("length")).otherwise(0))
    n_events, n = F.sum(is_event.cast("long")), F.sum("length")
    return runs.groupBy(*by).agg(
        (kept / n).alias("fraction"),
        F.coalesce(kept * F.lit(dt) / F.nullif(n_events, F.lit(0)), F.lit(0.0)).alias("mean_s"),
        F.coalesce(n_events / F.nullif((n - 1) * F.lit(dt), F.lit(0.0)), F.lit(0.0)).alias("per_s"),
        n_events.alias("n_events"),
    )


def background_levels(env: DataFrame) -> DataFrame:
    """Frames with their level over the recording's background: (rec_id, k, e, level, bgn, above)."""
    level = env.withColumn("level", db.amplitude_to_db(F.col("e")))
    bgn = F.percentile("level", F.lit(0.5)).over(Window.partitionBy("rec_id"))
    return level.withColumn("bgn", bgn).withColumn("above", F.col("level") - F.col("bgn"))


def temporal_snr(env: DataFrame) -> DataFrame:
    """Energy, background and their difference in dB: (rec_id, enr, bgn, snr)."""
    level = db.amplitude_to_db(F.col("e"))
    g = env.groupBy("rec_id").agg(db.mean_db(level).alias("enr"), F.percentile(level, F.lit(0.5)).alias("bgn"))
    return g.withColumn("snr", F.col("enr") - F.col("bgn"))


def temporal_activity(env: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Share and number of frames at or above the threshold, mean level of those above it: (rec_id, fraction, n_active, mean_active)."""
    a = background_levels(env)
    active = (F.col("above") >= threshold).cast("long")
    strong = F.when(F.col("above") > threshold, db.db_to_power(F.col("above")))
    return a.groupBy("rec_id").agg(F.avg(active).alias("fraction"), F.sum(active).alias("n_active"), F.coalesce(10 * F.log10(F.avg(strong)), F.lit(0.0)).alias("mean_active"))


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """Rank of each distinct value, the mean rank for ties: (column, rank).

    Distinct values with their counts are range-partitioned; each partition ranks its own and the
    counts of the partitions before it are added, so no task orders all values.
    """
    counts = checkpoint(values.groupBy(column).agg(F.count(F.lit(1)).alias("ties")).repartitionByRange(F.col(column)).withColumn("part", F.spark_partition_id()))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy("part").agg(F.sum("ties").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("offset") + F.coalesce(F.sum("ties").over(inside), F.lit(0))
    return counts.join(before, "part").select(column, (upto + (F.col("ties") + 1) / 2).alias("rank"))


def acoustic_richness(features: DataFrame) -> DataFrame:
    """rank(ht) rank(m) / n^2 over the whole set, with average ranks on ties: (rec_id, ari)."""
    n = features.count()
    both = features
    for c in ("ht", "m"):
        both = both.join(average_ranks(features, c).withColumnRenamed("rank", f"rank_{c}"), c)
    return both.select("rec_id", (F.col("rank_ht") * F.col("rank_m") / F.lit(float(n) * n)).alias("ari"))


def quantile_positions(series: DataFrame, by: list[str], order: str, axis: str, value: str, qs: list[float]) -> DataFrame:
    """The first position on the axis at which the running share of the total reaches each q: (by, q1, q2, ...). A q outside 0 to 1 is refused."""
    if not all(0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = series.withColumn("share", F.sum(value).over(w) / total)
    return c.groupBy(*by).agg(*[F.min(F.when(F.round("share", 12) >= q, F.col(axis))).alias(f"q{i + 1}") for i, q in enumerate(qs)])


def running_mean(series: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """Centred mean of n values; beyond the ends the end values repeat. For even n there is one value more before than after: (.., smooth)."""
    w = Window.partitionBy(*by).orderBy(order)
    left, right = n // 2, n - 1 - n // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = w.rowsBetween(-left, right)
    rank = F.row_number().over(w)
    count = F.count(F.lit(1)).over(whole)
    short_left = F.greatest(F.lit(left) - (rank - 1), F.lit(0))
    short_right = F.greatest(F.lit(right) - (count - rank), F.lit(0))
    total = F.sum(value).over(inside) + short_left * F.first(value).over(whole) + short_right * F.last(value).over(whole)
    return series.withColumn("smooth", total / n)


def crossfade_chain(signals: DataFrame, fs: float, fade_s: float = 1.0) -> DataFrame:
    """Recordings of a group joined in order with square-root ramps of m = fade_s * fs samples: (grp, i, x).

    ``signals`` has grp, ord and x, each x longer than 2 m + 1. A joint of two signals keeps the
    first but for its last sample, of which the m before it fade out one place later, and the
    second from its sample m - 1 to the last but one; so a joint is as long as both less m. The
    places of all samples follow from sums of lengths, and overlapping ones add up by place.
    """
    m = int(fade_s * fs)
    w = Window.partitionBy("grp").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    placed = (
        signals.withColumn("s", F.coalesce(F.sum(F.size("x") - m).over(w), F.lit(0)))
        .withColumn("is_first", F.col("ord") == F.min("ord").over(whole))
        .withColumn("is_last", F.col("ord") == F.max("ord").over(whole))
        .select("grp", "s", "is_first", "is_last", F.size("x").alias("n"), F.posexplode("x").alias("j", "v"))
    )
    none = F.array().cast("array<struct<p:bigint,x:double>>")
    at = lambda p, x: F.array(F.struct(p.cast("long").alias("p"), x.alias("x")))
    j, s, n, v = (F.col(c) for c in "jsnv")
    entering = F.when(F.col("is_first"), at(j, v)).otherwise(
        F.concat(F.when(j < m, at(s + j, v * F.sqrt(j / m))).otherwise(none), F.when((j >= m - 1) & (j <= n - 2), at(s + j + 1, v)).otherwise(none))
    )
    inside = placed.select("grp", "s", "n", "is_last", F.inline(entering))
    p, x, turn = F.col("p"), F.col("x"), F.col("s") + F.col("n") - m - 1
    leaving = F.when(F.col("is_last"), at(p, x)).otherwise(
        F.concat(F.when(p <= turn, at(p, x)).otherwise(none), F.when((p >= turn) & (p <= turn + m - 1), at(p + 1, x * F.sqrt((m - 1 - (p - turn)) / m))).otherwise(none))
    )
    return inside.select("grp", F.inline(leaving)).groupBy("grp", F.col("p").alias("i")).agg(F.sum("x").alias("x"))


def all_temporal(signals: DataFrame, fs: float, nt: int, dt_leq: int, threshold: float = 3.0, reject_s: float | None = 0.01, gain_db: float = 42.0) -> DataFrame:
    """The 16 temporal indices of each recording in one row."""
    zcr = zero_crossing_rate(signals, fs)
    long = samples(signals)
    m = long.groupBy("rec_id").agg(*moments())
    leq = leq_periods(signals, dt_leq, gain_db).groupBy("rec_id").agg(db.mean_db(F.col("leq")).alias("LEQt"))
    env = envelope(signals, nt)
    snr = temporal_snr(env)
    shape = env.withColumn("e2", F.col("e") * F.col("e")).groupBy("rec_id").agg(median("e").alias("MED"), entropy("e2").alias("Ht"))
    act = temporal_activity(env, threshold)
    evn = events(background_levels(env), ["rec_id"], "k", F.col("above"), nt / fs, threshold, reject_s)
    joined = zcr.join(m, "rec_id").join(leq, "rec_id").join(snr, "rec_id").join(shape, "rec_id").join(act.withColumnRenamed("fraction", "act_fraction"), "rec_id").join(evn, "rec_id")
    c = F.col
    return joined.select(
        "rec_id", c("zcr").alias("ZCR"), c("mean").alias("MEANt"), c("var").alias("VARt"), c("skew").alias("SKEWt"), c("kurt").alias("KURTt"), "LEQt",
        c("bgn").alias("BGNt"), c("snr").alias("SNRt"), "MED", "Ht", c("act_fraction").alias("ACTtFraction"), c("n_active").alias("ACTtCount"),
        c("mean_active").alias("ACTtMean"), c("fraction").alias("EVNtFraction"), c("mean_s").alias("EVNtMean"), c("per_s").alias("EVNtCount"),
    )
