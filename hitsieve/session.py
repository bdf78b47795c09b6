"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; on a cluster the caller brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # the Python workers of a local session take it from here
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hitsieve")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a session without the setting (a local one) gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written between stages."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
