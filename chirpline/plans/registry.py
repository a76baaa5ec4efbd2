"""Views of the test tables as acoustic data, rounding, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.session import table

FS, NT, DF, DT = 64.0, 8, 250.0, 0.25
M = "2.2250738585072014e-308"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, with one zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def R(expr: str, name: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE) AS {name}"


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as a waveform of 64 samples: (rec_id, x)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("x"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings of a label as the frames of a spectrogram: (rec_id, t_idx, f_idx, tn, fn, a, p)."""
    frames = table(spark, d, "embeddings").withColumn("t_idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    a = F.abs(F.col("v").cast("double")) * (1 + F.col("vec_id") % 7)
    long = frames.select("label", "vec_id", "t_idx", F.posexplode("embedding").alias("f_idx", "v")).withColumn("a", a)
    return long.select(F.col("label").cast("long").alias("rec_id"), F.col("t_idx").cast("long").alias("t_idx"), F.col("f_idx").cast("long").alias("f_idx"), (F.col("t_idx") * DT).alias("tn"), (F.col("f_idx") * DF).alias("fn"), "a", (F.col("a") * F.col("a")).alias("p"))


def event_series(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as a series: (rec_id, i, x)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("x"))


SIG = """sig AS (SELECT rec_id, i - 1 AS i, CAST(e[i] AS DOUBLE) AS x FROM (
  SELECT vec_id AS rec_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
SPEC = """spec AS (SELECT *, a * a AS p FROM (
  SELECT CAST(label AS BIGINT) AS rec_id, t_idx, i - 1 AS f_idx, t_idx * CAST(0.25 AS DOUBLE) AS tn, (i - 1) * CAST(250 AS DOUBLE) AS fn,
    abs(CAST(embedding[i] AS DOUBLE)) * (1 + vec_id % 7) AS a
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx FROM embeddings))))"""
EV = "ev AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
ENV = "env AS (SELECT rec_id, i // 8 AS k, max(abs(x)) AS e FROM sig GROUP BY 1, 2)"
LEV = f"""lev AS (SELECT *, level - bgn AS above FROM (
  SELECT *, quantile_cont(level, 0.5) OVER (PARTITION BY rec_id) AS bgn FROM (SELECT *, 20 * log10(greatest(e, {M})) AS level FROM env)))"""
