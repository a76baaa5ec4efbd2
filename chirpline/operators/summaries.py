"""Summaries by time of day and date, and long-term pictures of indices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.session import checkpoint

# Date keys by their strftime notation.
DATE_KEYS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%m-%d": "MM-dd", "%H:%M": "HH:mm", "%a": "E", "%y-%m-%d": "yy-MM-dd"}


def date_key(ts: Column, notation: str) -> Column:
    if notation == "%V":
        return F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    return F.date_format(ts, DATE_KEYS[notation])


def filter_by_key(df: DataFrame, ts: str, notation: str, keys: str | list[str] | tuple[str, str]) -> DataFrame:
    """Rows whose date key is a value, in a list, or between two; for times of day a range may pass midnight."""
    k = date_key(F.col(ts), notation)
    if isinstance(keys, str):
        return df.where(k == keys)
    if isinstance(keys, list):
        return df.where(k.isin(keys))
    lo, hi = keys
    if notation == "%H:%M" and lo > hi:
        return df.where((k >= lo) | (k <= hi))
    return df.where(k.between(lo, hi))


def bucket_minutes(ts: Column, minutes: int) -> Column:
    """Minutes since midnight at the start of the bucket."""
    return (F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) * minutes).cast("long")


def heatmap(df: DataFrame, ts: str, value: str, notation: str = "%V", minutes: int = 30) -> DataFrame:
    """Mean per date key and time bucket, as the mean of the means of each minute: (date_key, minute, mean)."""
    one = df.groupBy(date_key(F.col(ts), notation).alias("date_key"), F.date_format(ts, "HH:mm").alias("hm")).agg(F.avg(value).alias("m"))
    bucket = (F.floor((F.substring("hm", 1, 2).cast("int") * 60 + F.substring("hm", 4, 2).cast("int")) / minutes) * minutes).cast("long")
    return one.groupBy("date_key", bucket.alias("minute")).agg(F.avg("m").alias("mean"))


def hourly_normalised(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Means by hour of day, scaled to 0..1 per column over the at most 24 hours."""
    h = df.groupBy(F.hour(ts).cast("long").alias("hour")).agg(*[F.avg(c).alias(c) for c in columns])
    w = Window.partitionBy(F.lit(0))
    scaled = [((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))).alias(c) for c in columns]
    return h.select("hour", *scaled)


def resample(df: DataFrame, ts: str, value: str, rule: str = "30 minutes") -> DataFrame:
    """Mean, sample deviation and count per time bucket: (bucket, mean, std, n)."""
    return df.groupBy(F.window(ts, rule)["start"].alias("bucket")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def graphical_soundscape(densities: DataFrame, hours: DataFrame) -> DataFrame:
    """Mean number of peaks per frame by hour and bin: (hour, f_idx, density).

    ``densities`` has rec_id, f_idx and density with a row for every bin, ``hours`` rec_id and hour.
    """
    return densities.join(hours, "rec_id").groupBy("hour", "f_idx").agg(F.avg("density").alias("density"))


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float]:
    """Exact quantiles of all non-null values, between two neighbours by linear interpolation; NaN counts as the largest. Empty if there are no values.

    The values are ordered by ranges and written once; the sizes of the ranges, one number each,
    tell in which of them a rank lies, and only the values of the wanted ranks reach the driver.
    """
    part = F.spark_partition_id()
    ordered = checkpoint(df.select(F.col(column).cast("double").alias("v")).where("v is not null").repartitionByRange("v").sortWithinPartitions("v").withColumn("part", part))
    sizes = {r.part: r.n for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return []
    bases, base = {}, 0
    for k in sorted(sizes):
        bases[k], base = base, base + sizes[k]
    wanted = sorted({r for q in qs for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    inside = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
    starts = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])
    ranks = ordered.where(F.col("part").isin([k for k in bases if any(bases[k] <= r < bases[k] + sizes[k] for r in wanted)])).withColumn("rank", inside + starts[F.col("part")])
    at = {r.rank: r.v for r in ranks.where(F.col("rank").isin(wanted)).collect()}
    out = []
    for q in qs:
        x = q * (total - 1)
        lo, hi = at[math.floor(x)], at[math.ceil(x)]
        out.append(lo + (hi - lo) * (x - math.floor(x)))
    return out


def false_colour(per_bin: DataFrame, red: str, green: str, blue: str, low: float = 0.01, high: float = 0.99, reverse: bool = False) -> DataFrame:
    """Three per-bin indices cut to their percentiles and scaled to 0..255, from 255 to 0 with ``reverse``: (rec_id, f_idx, r, g, b).

    The percentiles are exact and interpolated; the values left by the cut span the scale.
    """
    limits = {c: exact_quantiles(per_bin, c, [low, high]) or [0.0, 0.0] for c in (red, green, blue)}

    def scaled(c: str, out: str) -> Column:
        lo, hi = limits[c]
        cut = F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
        share = (cut - lo) / (F.lit(hi - lo) if hi > lo else F.lit(1.0))
        return F.round((1 - share if reverse else share) * 255).cast("long").alias(out)

    return per_bin.select("rec_id", "f_idx", scaled(red, "r"), scaled(green, "g"), scaled(blue, "b"))


def covering_buckets(counts: DataFrame, by: list[str], bucket: str, n: str, share: float = 0.5) -> DataFrame:
    """The fullest buckets of each group that together first reach the share: (by, bucket, n, cumulative)."""
    w = Window.partitionBy(*by).orderBy(F.desc(n), bucket).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("total", F.sum(n).over(Window.partitionBy(*by))).withColumn("upto", F.sum(n).over(w))
    return c.where(F.col("upto") - F.col(n) < share * F.col("total")).select(*by, bucket, n, (F.col("upto") / F.col("total")).alias("cumulative"))


def threshold_buckets(counts: DataFrame, by: list[str], bucket: str, n: str, share: float = 0.5) -> DataFrame:
    """All buckets of each group that are as full as the one that reaches the share, ties included: (by, bucket, n, cumulative).

    Cumulative is the share of the buckets up to this one, the fullest and then the earliest first.
    """
    c = covering_buckets(counts, by, bucket, n, share).groupBy(*by).agg(F.min(n).alias("least"))
    w = Window.partitionBy(*by).orderBy(F.desc(n), bucket).rowsBetween(Window.unboundedPreceding, 0)
    every = counts.withColumn("cumulative", F.sum(n).over(w) / F.sum(n).over(Window.partitionBy(*by)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    return every.alias("a").join(c.alias("b"), same).where(F.col(f"a.{n}") >= F.col("least")).select(*[f"a.{k}" for k in by], bucket, n, "cumulative")
