"""Reading tables, libraries and partitioned runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hitsieve.schemas import FP_BITS


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or Parquet, chosen by the suffix; text columns of CSV stay text unless a schema says otherwise."""
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spreads an input that the file scan cannot split over the cores; large inputs pass unchanged.

    Worth one shuffle of the raw rows when the work per row is heavy (text features) and the scan has fewer
    splits than the cluster has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_library(spark: SparkSession, path: str, columns: Sequence[str], spread_rows: bool = True) -> DataFrame:
    """Column-pruned library scan; a missing column raises before anything runs."""
    df = select_required(read_table(spark, path), columns)
    return spread(df) if spread_rows else df


def read_library_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def select_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def detect_features(columns: Sequence[str], prefix: str = "morgan_", n_bits: int = FP_BITS) -> list[str]:
    """Precomputed fingerprint columns by name, in numeric order; the first n_bits, or none when there are fewer."""
    pattern = re.compile(rf"^{re.escape(prefix)}(\d+)$")
    found = sorted((int(m.group(1)), c) for c in columns if (m := pattern.match(c)))
    return [c for _, c in found[:n_bits]] if len(found) >= n_bits else []


def gather_bits(df: DataFrame, columns: Sequence[str], out: str = "bits") -> DataFrame:
    """Wide 0/1 columns to the sorted positions of the set bits."""
    marks = F.array(*[F.col(c).cast("double") for c in columns])
    at = F.transform(marks, lambda x, i: F.when(F.coalesce(x, F.lit(0.0)) >= 0.5, i))
    return df.withColumn(out, F.filter(at, lambda i: i.isNotNull())).drop(*columns)


def read_runs(spark: SparkSession, folder: str, key: str = "seed") -> DataFrame:
    """All seed partitions of a run folder as one table; the key comes from the path."""
    return spark.read.option("basePath", folder).option("mergeSchema", True).parquet(folder).withColumn(
        key, F.col(key).cast("int"))


def key_from_path(df: DataFrame, key: str = "seed") -> DataFrame:
    """Fills a missing partition key from the file path (`.../<key>=N/...` or `.../<key>_N/...`)."""
    found = F.regexp_extract(F.col("_metadata.file_path"), rf"{key}[=_](\d+)", 1).try_cast("int")
    value = F.coalesce(F.col(key).cast("int"), found) if key in df.columns else found
    return df.withColumn(key, value)


def union_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of per-seed tables that may differ in columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
