"""Consolidation of very many small files.

``compact`` works on physical files: it reads them in packed splits, coalesces without a shuffle,
writes a staged copy, verifies it against what was read and only then publishes it.
``distinct_files``, ``pack_plan``, ``consolidation`` and ``small_file_folders`` work on a listing of files.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.session import checkpoint, estimated_bytes, staging_path

SMALL_FILE = 1 << 20
# Row groups of the consolidated files, so that later scans can still split them.
ROW_GROUP = 16 << 20
GROUP_ROWS = 200_000
# Targets that one shelf of the packing takes; its last pack is the only one left unfilled.
SHELF_PACKS = 64


def canonical_path(path: Column) -> Column:
    """The place that ``path`` names, from the root, with single forward slashes.

    Backslashes count as slashes; a scheme (``file://``, with or without ``localhost``), empty
    parts and ``.`` parts go, ``..`` parts go with the part before them, and percent escapes of
    URLs are decoded. Null stays null; letter case and blanks are kept. A path that shows none of
    these is passed on after a few byte searches, without a regular expression.
    """
    simple = path.startswith("/") & ~path.contains("\\") & ~path.contains("//") & ~path.contains("/.") & ~path.endswith("/")
    return F.when(simple, path).otherwise(_parsed_path(path))


def _parsed_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    is_url = slashed.rlike("^[A-Za-z][A-Za-z0-9+.-]+:/")
    bare = F.regexp_replace(slashed, "^[A-Za-z][A-Za-z0-9+.-]+:(?://(?:localhost)?(?=/))?", "")
    decoded = F.when(
        is_url & bare.contains("%"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    ).otherwise(F.when(is_url, bare).otherwise(slashed))
    parts = F.filter(F.split(decoded, "/"), lambda x: (x != "") & (x != "."))
    # bound by a lambda, so that the parts are made once
    climbed = lambda p: F.aggregate(
        p,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    kept = F.transform(F.array(parts), lambda p: F.when(F.array_contains(p, ".."), climbed(p)).otherwise(p))[0]
    return F.when(path.isNotNull(), F.concat(F.lit("/"), F.array_join(kept, "/")))


def folder_of(canonical: Column) -> Column:
    """The folder of a canonical path, without a slash at the end (the root is ``/``)."""
    folder = F.regexp_replace(canonical, "/[^/]*$", "")
    return F.when(folder == "", F.lit("/")).otherwise(folder)


def distinct_files(listing: DataFrame, path: str = "path_audio", size: str = "fsize") -> DataFrame:
    """One row ``(path, n_bytes)`` for each place that is listed; n_bytes is null where no listing has a size.

    Rows without a path don't count. If one place is listed with several sizes, the largest
    counts: a file that was still being written is listed short. The aggregation combines
    before the shuffle, so a file listed very often costs one row per task. Extra columns are
    pruned; an empty listing gives no rows.
    """
    return (
        listing.select(canonical_path(F.col(path)).alias("path"), F.col(size).cast("long").alias("n_bytes"))
        .where("path is not null")
        .groupBy("path")
        .agg(F.max("n_bytes").alias("n_bytes"))
    )


def small_file_folders(files: DataFrame, limit: int = SMALL_FILE, at_least: int = 2) -> DataFrame:
    """Folders with at least ``at_least`` distinct files below ``limit``: (folder, n_files, n_bytes).

    Files of unknown size don't count. A folder that holds a third of all files is summed before the shuffle, so it is no hot key.
    """
    return (
        files.where(F.col("n_bytes") < limit)
        .groupBy(folder_of(F.col("path")).alias("folder"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
        .where(F.col("n_files") >= at_least)
    )


def pack_plan(files: DataFrame, target_bytes: int = 128 << 20, open_cost: int = 4 << 20) -> DataFrame:
    """Assign each distinct file to a pack of about ``target_bytes``: (path, n_bytes, pack_id, seq, offset).

    The rule is that of the engine's split packing: next fit in path order with ``open_cost``
    added for each file. So that it runs in many tasks and still gives the same packs however the
    rows are cut, the files stand on shelves of ``SHELF_PACKS`` targets each by their running total
    over all files; the running total comes from sums of range partitions, which are written once,
    and each shelf, at most ``SHELF_PACKS * target_bytes / open_cost`` files, is packed by itself.
    A file larger than the target gets a pack of its own. Files of unknown size come last, in
    packs of their own that count ``open_cost`` a file; their n_bytes and offset are null.
    """
    weight = F.coalesce("n_bytes", F.lit(0)).cast("long")
    ordered = files.select("path", weight.alias("n"), F.col("n_bytes").isNull().alias("unknown")).repartitionByRange("unknown", "path").sortWithinPartitions("unknown", "path")
    ordered = checkpoint(ordered.withColumn("part", F.spark_partition_id()).withColumn("w", F.col("n") + open_cost))
    # one row for each partition of the range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("w").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("unknown", "path").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("base") + F.coalesce(F.sum("w").over(inside), F.lit(0))
    shelved = ordered.join(F.broadcast(parts), "part").withColumn("shelf", F.floor(total / (SHELF_PACKS * target_bytes)).cast("long"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unknown", "path"], kind="stable", key=lambda c: c.str.encode("utf-8") if c.name == "path" else c)
        base, pack_no, filled, seq, offset, last = int(key[0]) << 32, -1, math.inf, 0, 0, None
        packs, seqs, offsets = [], [], []
        for n, unknown in zip(pdf["n"], pdf["unknown"]):
            if filled + n > target_bytes or unknown != last:
                pack_no, filled, seq, offset, last = pack_no + 1, 0, 0, 0, unknown
            packs.append(base + pack_no)
            seqs.append(seq)
            offsets.append(offset)
            filled, seq, offset = filled + n + open_cost, seq + 1, offset + n
        return pdf[["path", "n", "unknown"]].assign(pack_id=packs, seq=seqs, offset=offsets)

    size = lambda c: F.when(~F.col("unknown"), F.col(c)).alias(c if c == "offset" else "n_bytes")
    packed = shelved.select("shelf", "path", "n", "unknown").groupBy("shelf").applyInPandas(pack, "path string, n long, unknown boolean, pack_id long, seq long, offset long")
    return packed.select("path", size("n"), "pack_id", "seq", size("offset"))


def consolidation(listing: DataFrame, path: str = "path_audio", size: str = "fsize", target_bytes: int = 128 << 20, open_cost: int = 4 << 20) -> DataFrame:
    """The verified plan that consolidates the files of a listing, as a written table: (path, n_bytes, pack_id, seq, offset).

    The distinct places are written once, counted on the way, and each gets its pack by
    ``pack_plan``. The plan is coalesced without a shuffle and staged like consolidated data
    itself; unless the staged table has each place once and all bytes, it is deleted and the call fails.
    """
    spark = listing.sparkSession
    files, seen = distinct_files(listing, path, size), Observation()
    checks = lambda df: [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.pmod(F.xxhash64("path"), F.lit(2147483647))), F.lit(0)).alias("paths")]
    listed = staging_path(spark, "places")
    files.observe(seen, *checks(files)).write.parquet(listed)
    plan, staged = pack_plan(spark.read.schema(files.schema).parquet(listed), target_bytes, open_cost), staging_path(spark, "packs")
    # a row of the plan takes less than 200 bytes, so each file of it stays below the target
    plan.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(seen.get["n"] * 200 / target_bytes))).write.parquet(staged)
    copy = spark.read.schema(plan.schema).parquet(staged)
    found = copy.agg(*checks(copy), F.count_distinct("path").alias("places")).first().asDict()
    if found != seen.get | {"places": found["n"]}:
        _delete(spark, staged)
        raise RuntimeError(f"the staged plan differs from the listing: {found} != {seen.get}")
    return copy


def combined_scan(spark: SparkSession, source: str | list[str], columns: list[str] | None = None, target_bytes: int = 128 << 20, open_cost: int = 4 << 20, file_format: str = "parquet") -> DataFrame:
    """A scan whose splits combine small files up to ``target_bytes``, each counted with ``open_cost``.

    Both are set in a session of its own on the same context, so no other query sees them.
    """
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(open_cost))
    scan = own.read.format(file_format).load(source)
    return scan if columns is None else scan.select(*columns)


def _digest(df: DataFrame) -> list[Column]:
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0).cast("long")
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.pmod(h, F.lit(2147483647))), F.lit(0)).alias("total"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("parity"),
    ]


def compact(spark: SparkSession, source: str | list[str], columns: list[str] | None = None, target_bytes: int = 128 << 20, open_cost: int = 4 << 20, publish_to: str | None = None, overwrite: bool = False, file_format: str = "parquet") -> DataFrame:
    """Write the rows of many files into few well-sized ones and return the verified copy.

    The files are read in combined splits (``combined_scan``); ``coalesce`` then joins what is
    left without a shuffle, at any size of the input. Count and two order-independent checksums are
    observed while writing and compared with the staged copy; if they differ, the copy is deleted
    and the call fails, so records are neither lost nor doubled. With ``publish_to`` the copy is
    staged beside that folder and renamed to it. A folder that exists is refused; with
    ``overwrite`` it steps aside, comes back if the copy as published differs, and is deleted only
    after that. Without ``publish_to`` the copy lives as long as the application. An empty input
    gives an empty copy with the same schema. Map columns can't be hashed and are refused by Spark.
    """
    scan = combined_scan(spark, source, columns, target_bytes, open_cost, file_format)
    target = publish_to.rstrip("/") if publish_to else None
    if target and _exists(spark, target) and not overwrite:
        raise FileExistsError(f"{target} exists")
    staged = f"{target}.staged-{uuid.uuid4().hex}" if target else staging_path(spark, "compact")
    seen, total = Observation(), estimated_bytes(scan)
    groups = {"parquet.block.size": str(ROW_GROUP), "parquet.block.row.count.limit": str(GROUP_ROWS)}
    scan.coalesce(max(1, math.ceil(total / target_bytes))).observe(seen, *_digest(scan)).write.options(**groups).parquet(staged)
    copy = _verified(spark, staged, scan, seen.get)
    if copy is None:
        _delete(spark, staged)
        raise RuntimeError("the staged copy differs from its source")
    if target is None:
        return copy
    aside = f"{target}.before-{uuid.uuid4().hex}" if _exists(spark, target) else None
    if aside:
        _rename(spark, target, aside)
    try:
        _rename(spark, staged, target)
        copy = _verified(spark, target, scan, seen.get)
        if copy is None:
            _delete(spark, target)
            raise RuntimeError(f"the copy published to {target} differs from its source")
    except Exception:
        if aside and not _exists(spark, target):
            _rename(spark, aside, target)
        raise
    if aside:
        _delete(spark, aside)
    return copy


def _verified(spark: SparkSession, folder: str, scan: DataFrame, want: dict) -> DataFrame | None:
    copy = spark.read.schema(scan.schema).parquet(folder)
    return copy if copy.agg(*_digest(copy)).first().asDict() == want else None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename where nothing is; a rename into an existing folder would nest the two."""
    fs, p = _fs(spark, source)
    if _exists(spark, target) or not fs.rename(p, _fs(spark, target)[1]):
        raise RuntimeError(f"could not rename {source} to {target}")


def scattered(df: DataFrame, folder: str, rows_per_file: int) -> None:
    """Write a table as very many small files of at most ``rows_per_file`` rows: the state that ``compact`` ends."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
