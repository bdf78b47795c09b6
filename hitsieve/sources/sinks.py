"""Sinks: Parquet with zstd, CSV, split bundles, swapped updates, model contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "append") -> None:
    """zstd Parquet. An empty result leaves a folder with the schema only, so that it can be read back."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_split(features: DataFrame, split: DataFrame, path: str, id_col: str = "id") -> None:
    """Features, labels and ids per seed and role. The split table is (seed, id, role)."""
    write_parquet(features.join(split, id_col), path, ("seed", "role"), "overwrite")


def write_contract(spark: SparkSession, path: str, contract: dict) -> None:
    """Feature contract of a saved model as a one-row table."""
    row = spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "contract string")
    row.coalesce(1).write.mode("overwrite").parquet(path)


def read_contract(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).first()["contract"])


def replace_with_backup(updated: DataFrame, path: str, backup: str) -> str:
    """Copy-on-write update of a table: the old files go to `backup` once, the new table to `path`.

    The update may read `path`, so it is written beside it first. At every moment the table is whole under `path` or
    `<path>.old`: the old files step aside, the new ones move in, and only then the old ones go. Returns the backup path.
    """
    spark = updated.sparkSession
    fresh = f"{path.rstrip('/')}.new"
    write_parquet(updated, fresh, mode="overwrite")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old, new, bak = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, backup))
    fs = old.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old") if fs.exists(bak) else bak
    if fs.exists(aside) and not fs.exists(old):
        fs.rename(aside, old)  # an earlier swap was cut off in between
    for source, target in ((old, aside), (new, old)):
        if not fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")
    if aside.toString() != bak.toString():
        fs.delete(aside, True)
    return backup
