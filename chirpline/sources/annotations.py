"""Annotation tables of label editors: reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RAVEN = ["Selection", "View", "Channel", "Begin Time (s)", "End Time (s)", "Low Freq (Hz)", "High Freq (Hz)"]


def numbered(rows: DataFrame, by: str, order: list[str], weight: Column, out: str, chunk_s: float = 600.0) -> DataFrame:
    """Add the sum of the weights of all rows before each row of its recording, in an order that begins with a time.

    A recording may hold a third of all rows, so it is ordered in chunks of ``chunk_s`` seconds; the
    sums of the chunks before come from one small row per chunk. Null times come first.
    """
    at = F.coalesce(F.floor(F.col(order[0]) / chunk_s).cast("long"), F.lit(-(2**62)))
    placed = rows.withColumn("_chunk", at).withColumn("_w", weight)
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "_chunk").agg(F.sum("_w").alias("_s")).select(F.col(by).alias("_by"), F.col("_chunk").alias("_at"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    both = counted.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_chunk") == F.col("_at")))
    return both.withColumn(out, F.col("_base") + F.col("_inside")).drop("_chunk", "_at", "_by", "_w", "_base", "_inside")


def to_audacity(rois: DataFrame, by: str = "rec_id") -> DataFrame:
    """Lines of label files: (by, line_no from 1, line). A ROI gives a time line and, with a band, a frequency line after it.

    The order within a file is that of min_t, max_t, then the label. Null labels are empty.
    """
    text = lambda c: F.format_string("%.6f", F.col(c))
    first = F.concat_ws("\t", text("min_t"), text("max_t"), F.coalesce("label", F.lit("")))
    second = F.concat_ws("\t", F.lit("\\"), text("min_f"), text("max_f"))
    banded = F.col("min_f").isNotNull() & F.col("max_f").isNotNull()
    placed = numbered(rois, by, ["min_t", "max_t", "label", "roi_id"], F.when(banded, 2).otherwise(1), "_before")
    lines = F.when(banded, F.array(first, second)).otherwise(F.array(first))
    return placed.select(by, "_before", F.posexplode(lines).alias("j", "line")).select(by, (F.col("_before") + F.col("j") + 1).cast("long").alias("line_no"), "line")


def from_audacity(lines: DataFrame, by: str = "rec_id") -> DataFrame:
    """ROIs of well-formed label lines: (by, line_no, label, min_t, min_f, max_t, max_f); a time line takes the frequency line right after it."""
    f = F.split("line", "\t")
    rows = lines.select(by, "line_no", f.alias("f"))
    t = rows.where(f"f[0] <> '\\\\'").select(by, "line_no", F.col("f")[0].cast("double").alias("min_t"), F.col("f")[1].cast("double").alias("max_t"), F.col("f")[2].alias("label"))
    b = rows.where(f"f[0] = '\\\\'").select(by, (F.col("line_no") - 1).alias("line_no"), F.col("f")[1].cast("double").alias("min_f"), F.col("f")[2].cast("double").alias("max_f"))
    return t.join(b, [by, "line_no"], "left").select(by, "line_no", "label", "min_t", "min_f", "max_t", "max_f")


def read_audacity(spark, folder: str) -> DataFrame:
    """ROIs of all label files below a folder: (path, line_no, label, min_t, min_f, max_t, max_f), through the parser that separates faulty lines."""
    from chirpline.operators import row_parser

    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    keyed = texts.withColumn("rec_id", F.xxhash64("path"))
    found = row_parser.label_records(row_parser.raw_lines(keyed))
    return found.join(keyed.select("rec_id", "path"), "rec_id").select("path", "line_no", "label", "min_t", "min_f", "max_t", "max_f")


def to_raven(rois: DataFrame, by: str = "rec_id", extra: list[str] | None = None) -> DataFrame:
    """Selection tables: the standard columns, numbered from 1 in each recording, then the others."""
    rois = numbered(rois, by, ["min_t", "max_t", "roi_id"], F.lit(1), "_before")
    c: list[Column] = [
        (F.col("_before") + 1).cast("long").alias("Selection"), F.lit("Spectrogram 1").alias("View"), F.lit(1).cast("long").alias("Channel"),
        F.col("min_t").alias("Begin Time (s)"), F.col("max_t").alias("End Time (s)"), F.col("min_f").alias("Low Freq (Hz)"), F.col("max_f").alias("High Freq (Hz)"),
    ]
    return rois.select(by, *c, *(extra or []))


def read_raven(spark, path: str) -> DataFrame:
    """Tab-separated selection tables; the bounds are doubles, everything else text."""
    df = spark.read.csv(path, sep="\t", header=True)
    names = {"Begin Time (s)": "min_t", "End Time (s)": "max_t", "Low Freq (Hz)": "min_f", "High Freq (Hz)": "max_f"}
    return df.select(*[F.col(f"`{c}`").cast("double").alias(names[c]) if c in names else F.col(f"`{c}`") for c in df.columns])


def write_audacity(rois: DataFrame, folder: str, by: str = "rec_id") -> None:
    """One folder of label text per recording; lines keep their order. Recordings are spread over tasks by a hash."""
    lines = to_audacity(rois, by).repartition(F.col(by)).sortWithinPartitions(by, "line_no")
    lines.select(by, "line").write.partitionBy(by).text(folder)


def write_raven(rois: DataFrame, folder: str, by: str = "rec_id", extra: list[str] | None = None) -> None:
    """Tab-separated selection tables, one folder per recording."""
    rows = to_raven(rois, by, extra).repartition(F.col(by)).sortWithinPartitions(by, "Selection")
    rows.write.partitionBy(by).csv(folder, sep="\t", header=True)
