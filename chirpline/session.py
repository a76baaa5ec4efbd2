"""Session defaults, table access and the shared folder for checkpoints and staged output."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the queries are tested with."""
    b = (
        SparkSession.builder.master(master)
        .appName("chirpline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in tests on
    one machine, a temporary folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chirpline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
        _until_exit(spark, sc.getCheckpointDir())
    return named


def _until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in one folder of the application that is deleted when it ends."""
    folder = os.path.join(shared_dir(spark), f"chirpline-{spark.sparkContext.applicationId}")
    _until_exit(spark, folder)
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; for a plain scan the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
