"""Helpers the operators share: tables written between stages, blocks of a sorted partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitsieve.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage's table to the shared folder and reads it back.

    This cuts the lineage (a lost executor costs no recomputation of what came before) and gives the planner real
    sizes, so that it broadcasts a table only when the bytes written are below the session's broadcast threshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def in_blocks(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Applies `fn` to the rows of each key, one call for many small keys together.

    Rows are dealt by `key` and sorted; a task gathers whole keys until it holds about `GATHER` rows or `GATHER_BYTES`
    and hands them on as one Arrow table. A key must fit in memory: callers split hot keys before they come here.
    """
    dealt = df.repartition(F.col(key)).sortWithinPartitions(key)
    return dealt.mapInArrow(_Gather(key, fn), schema)


GATHER, GATHER_BYTES = 20_000, 24 << 20


class _Gather:
    def __init__(self, key: str, fn: Callable[[pa.Table], pa.Table | None]):
        self.key, self.fn = key, fn

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, int(batch.num_rows * GATHER_BYTES / 4 / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows >= GATHER or size >= GATHER_BYTES:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    keys = whole.column(self.key).to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1], side="left"))
                    if cut:
                        yield from self._call(whole.slice(0, cut))
                        held = whole.slice(cut).to_batches()
                        rows = whole.num_rows - cut
                        size = size * rows // whole.num_rows
        if held:
            yield from self._call(pa.Table.from_batches(held).combine_chunks())

    def _call(self, whole: pa.Table) -> Iterator[pa.RecordBatch]:
        out = self.fn(whole)
        if out is not None and out.num_rows:
            yield from out.to_batches()


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Positions where a new key begins in a sorted array, and its length at the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def rows_of(column: pa.Array | pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    """A matrix over a binary column whose values all have the same number of bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(kind).reshape(len(array), width)


class Forest:
    """Union-find over positions; a set's root is its smallest position."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, pairs: Sequence[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
