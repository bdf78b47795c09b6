"""Incremental filtering and scoring of newly arrived files; counters per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from hitsieve.operators.screen import counters


def score_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Appends the transformed rows as Parquet until all present files are read; restarts where it stopped."""
    (transform(source).writeStream.format("parquet").option("compression", "zstd").option("path", out)
     .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
     .awaitTermination())


def count_stream(source: DataFrame, out: str, checkpoint: str) -> None:
    """One counter row per micro-batch of rows with `skip_reason`.

    A batch that is replayed after a failure overwrites its own partition, so totals never count twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counters(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())


def running_totals(df: DataFrame) -> DataFrame:
    """Totals over the counter rows of all batches."""
    names = ["processed", "predicted", "skipped", "skipped_nan", "skipped_text"]
    return df.agg(*[F.sum(n).alias(n) for n in names])
