"""Exact quantiles of large groups without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bucket(v: Column) -> Column:
    """A sixteenth of an octave of the value, rising with it; zeros are one by themselves and NaN is above all."""
    octave = lambda x: F.floor(F.log2(x) * 16).cast("int")
    return F.when(F.isnan(v), 99_999).when(v == 0, 0).when(v > 0, F.least(20_000 + octave(v), F.lit(90_000))).otherwise(F.greatest(-20_000 - octave(-v), F.lit(-90_000)))


def grouped_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Quantiles of each group with linear interpolation between neighbours: (by, n, q array). Nulls don't count; groups without values have no row.

    Values are counted by group and bucket before the shuffle; the running counts of a group, at
    most some ten thousand rows, tell which buckets hold the wanted ranks. Only the values of those
    are counted one by one, keyed by group and bucket, so neither a group that holds a third of
    all rows nor one with equal values is ever in one task.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v")).where("v is not null").withColumn("bucket", _bucket(F.col("v")))
    counts = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    placed = counts.withColumn("base", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), (F.floor if s == 0 else F.ceil)(F.lit(float(q)) * (F.col("n") - 1)).cast("long").alias("rank")) for i, q in enumerate(qs) for s in (0, 1)])
    wanted = placed.select("*", F.inline(ranks)).where((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("c")))
    # null keys are groups too, so they meet null-safely
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    buckets = wanted.select(*keys, "bucket").distinct()
    values = rows.alias("r").join(buckets.alias("b"), same("r", "b", keys) + [F.col("r.bucket") == F.col("b.bucket")], "left_semi").groupBy(*keys, "bucket", "v").agg(F.count(F.lit(1)).alias("m"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("before", F.sum("m").over(inside) - F.col("m"))
    at = F.col("w.rank") - F.col("w.base")
    hit = (at >= F.col("x.before")) & (at < F.col("x.before") + F.col("x.m"))
    found = wanted.alias("w").join(values.alias("x"), same("w", "x", keys) + [F.col("w.bucket") == F.col("x.bucket")]).where(hit).select(*[F.col(f"w.{k}").alias(k) for k in keys], "w.n", "w.i", "w.side", "x.v")
    pick = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("v")))
    share = lambda q: F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))
    g = found.groupBy(*keys, "n").agg(F.array(*[F.struct(pick(i, 0).alias("lo"), pick(i, 1).alias("hi")) for i in range(len(qs))]).alias("e"))
    q = F.array(*[F.when(F.col("e")[i]["hi"] == F.col("e")[i]["lo"], F.col("e")[i]["lo"]).otherwise(F.col("e")[i]["lo"] + (F.col("e")[i]["hi"] - F.col("e")[i]["lo"]) * share(x)) for i, x in enumerate(qs)])
    return g.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", q.alias("q"))
