"""Joins, selections and pairings that audio tables need beyond plain SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, chunk: int) -> DataFrame:
    """Each left row with the latest right row of its key at or before it: left columns, matched_at, matched.

    ``at`` is a whole number on both sides. Both are cut into chunks of ``chunk`` units; inside a
    chunk a window carries the last right row on, and the chunk before it is known from the last
    rows of the chunks, so a key with a third of all rows is spread over its chunks. Ties: right
    rows at the same time count as earlier, the larger value wins. Rows without key or time match
    nothing and stay.
    """
    names = left.columns
    c = lambda df: F.floor(F.col(at) / chunk).cast("long")
    row = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_k"), F.col(at).alias("_t"), c(right).alias("_c"), row.alias("_r"))
    lasts = r.groupBy("_k", "_c").agg(F.max("_r").alias("_r"))
    l = left.select(F.col(by).alias("_k"), F.col(at).alias("_t"), c(left).alias("_c"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_l"))
    chunks = l.select("_k", "_c").distinct().join(lasts, ["_k", "_c"], "full")
    w = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("_k", "_c", F.last("_r", ignorenulls=True).over(w).alias("_before"))
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)))
    inside = Window.partitionBy("_k", "_c").orderBy("_t", F.col("_l").isNotNull(), F.col("_r.v")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside)).where("_l is not null").join(carried, ["_k", "_c"], "left")
    hit = F.coalesce("_hit", "_before")
    return found.select("_l.*", hit["t"].alias("matched_at"), hit["v"].alias("matched"))


def range_join(points: DataFrame, bands: list[tuple[str, float, float]], at: Column) -> DataFrame:
    """Rows with every band that holds them, bounds included; the bands are a parameter list and become an array filter instead of a join."""
    lit = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, lo, hi in bands])
    return points.select("*", F.inline(F.filter(lit, lambda b: (at >= b["lo"]) & (at <= b["hi"]))))


def triplets(spark: SparkSession, names: list[str]) -> DataFrame:
    """All ordered triples of different names; the list is a parameter."""
    return spark.createDataFrame(list(permutations(names, 3)), "red string, green string, blue string")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows per group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all column pairs in one pass: (a, b, r)."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.inline(rows))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of the key: a reproducible sample."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), key).limit(n)


def counts_by_value(rows: DataFrame, by: str, value: str, prefix: str, max_values: int = 1000) -> DataFrame:
    """Rows per ``by`` and value of a column, one output column for every value that occurs: (by, prefix + value ...).

    The list of values goes to the driver; more than ``max_values`` are an error, not a cut. Nulls
    are counted under prefix + "null" if there are any.
    """
    found = [r[0] for r in rows.select(value).distinct().limit(max_values + 1).collect()]
    if len(found) > max_values:
        raise ValueError(f"more than {max_values} values of {value}")
    found.sort(key=lambda v: (v is None, v if v is not None else 0))
    count = lambda v: F.count(F.when(F.col(value).eqNullSafe(F.lit(v)), 1))
    return rows.groupBy(by).agg(*[count(v).alias(f"{prefix}{'null' if v is None else v}") for v in found]) if found else rows.select(by).distinct()


def update_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``left`` with the non-null values of ``right`` in the columns that both have; other columns and rows of ``right`` are ignored.

    ``right`` has a key once; of repeated keys the largest row counts. Null keys meet nothing.
    """
    shared = [c for c in left.columns if c in right.columns and c not in on]
    once = right.groupBy(*on).agg(F.max(F.struct(*shared)).alias("_new"))
    both = left.join(once, on, "left")
    return both.select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns])
