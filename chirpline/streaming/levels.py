"""Levels, sessions and normalisation of measurement streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chirpline.session import staging_path


def windowed_leq(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Equivalent level per source and window: (rec_id, start, leq, n). ``stream`` has rec_id, ts and x; later rows than ``late`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = stream.withWatermark("ts", late).groupBy("rec_id", w.alias("w")).agg(F.avg(F.col("x") * F.col("x")).alias("ms"), F.count(F.lit(1)).alias("n"))
    return g.select("rec_id", F.col("w.start").alias("start"), (10 * F.log10(F.greatest("ms", F.lit(2.2250738585072014e-308)))).alias("leq"), "n")


def session_events(stream: DataFrame, threshold: float, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of readings at or above a threshold, closed by a gap: (rec_id, start, end, n, peak)."""
    loud = stream.withWatermark("ts", late).where(F.col("x") >= threshold)
    g = loud.groupBy("rec_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("peak"))
    return g.select("rec_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def pcen(stream: DataFrame, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, b: float = 0.025, eps: float = 1e-6, late: str = "10 minutes", quiet: str = "30 days") -> DataFrame:
    """Per-channel energy normalisation of each source; the smoother is its state: (rec_id, ts, event_id, out).

    Within a micro-batch readings count in the order of ts and event_id, taken reading by reading
    from Arrow batches; over batches a reading that is older than the last one counts where it
    arrives, and one that is ``late`` is dropped. A source that has been silent for ``quiet`` of
    event time loses its state and begins anew.
    """
    silence = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def scan(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        m, latest = state.get if state.exists else (0.0, 0)
        out = []
        for x in pdf["x"]:
            m = b * x + (1 - b) * m
            out.append((x * (m + eps) ** -gain + bias) ** power - math.pow(bias, power))
        latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
        state.update((m, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + silence)
        yield pd.DataFrame({"rec_id": key[0], "ts": pdf["ts"], "event_id": pdf["event_id"], "out": out})

    return stream.withWatermark("ts", late).groupBy("rec_id").applyInPandasWithState(scan, "rec_id long, ts timestamp, event_id long, out double", "m double, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is available and return its result as a batch table in the shared folder."""
    spark = stream.sparkSession
    out = staging_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", staging_path(spark, "progress")).trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
