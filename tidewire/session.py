"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Rows of whole texts: fewer at a time bound the memory of Python workers and of the buffers to them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Top-k filters are also applied before the shuffle for large k.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000000",
}


def get_session(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators expect.

    On a cluster leave ``master`` unset and let the submit command decide;
    shuffle partitions start high there and adaptive execution coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_settings(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on, whoever built the session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; pick one only where none is set."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One machine runs everything, as in tests.
        shared = os.path.join(tempfile.gettempdir(), "tidewire-checkpoints")
    spark.sparkContext.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Later steps then start from files that outlive executors. A table rather
    than an RDD checkpoint, because its scan knows its size and prunes columns,
    so joins with a small step result can be planned as such.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, for files a job writes and reads back."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid4().hex[:12]}"
