"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitsieve.llm.common import table, text_of
from hitsieve.llm.wordhash import IS_BLANK, bounds, pieces, span_hashes

BITS = 16  # buckets of words and of n-grams, each
DIM = 16
GRAMS = (3, 4)
TRAIN_DOCS = 6000  # bound of the training sample; smallest hashes of the ids first
_rng = np.random.default_rng(7)
_BYTE32 = _rng.integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_STEP32 = _rng.integers(1, 1 << 32, 8, dtype=np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class Model:
    """Vectors of the buckets (words first, then n-grams of each length) and the softmax layer."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """The average is linear, so a bucket's share in the difference of the two logits is one number."""
        side = self.weights[:, 1] - self.weights[:, 0]
        return (self.vectors @ side).astype(np.float64), float(self.bias[1] - self.bias[0])


def buckets(data: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of a text, piece by piece: its words, then the byte n-grams inside words and at their edges."""
    shift = np.uint32(32 - BITS)
    for piece in pieces(np.frombuffer(data, np.uint8)):
        yield (span_hashes(piece, *bounds(piece)) >> np.uint64(64 - BITS)).astype(np.int32)
        blank = np.ones(len(piece) + 2, bool)
        blank[1:-1] = IS_BLANK[piece]
        coded = np.full(len(piece) + 2, _BYTE32[32], np.uint32)
        coded[1:-1] = np.where(blank[1:-1], _BYTE32[32], _BYTE32[piece])
        for k, n in enumerate(GRAMS, 1):
            count = len(coded) - n + 1
            if count <= 0:
                continue
            total, inner = np.zeros(count, np.uint32), np.zeros(count, bool)
            for i in range(n):
                total += coded[i:i + count] * _STEP32[i]
                if 0 < i < n - 1:
                    inner |= blank[i:i + count]
            total ^= total >> np.uint32(15)
            total *= np.uint32(0x2C1B3C6D)
            yield (total[~inner] >> shift).astype(np.int32) + np.int32(k << BITS)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for text in batch.column("_text"):
            total = np.zeros((1 + len(GRAMS)) << BITS, np.int32)
            for part in buckets(text.as_py().encode()):
                total += np.bincount(part, minlength=len(total)).astype(np.int32)
            at = np.flatnonzero(total)
            ids.append(at.astype(np.int32))
            counts.append(total[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_order"), batch.column("_label"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            ["_order", "_label", "ids", "counts"])


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """Bucket counts of the training sample: labelled rows outside the held-out fold, at most `limit`.

    Labels that contradict each other are decided by their mean (0.5 counts as 1); null labels and ids are left out.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").where(~held_out())
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
              .select(F.col("doc_id").alias("_doc"), "_label", F.xxhash64("doc_id").alias("_order"))
              .orderBy("_order", "_doc").limit(limit))
    rows = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("_text"))
    return (rows.join(F.broadcast(chosen), "_doc")  # at most `limit` rows of three numbers
            .mapInArrow(_profile, "_order long, _label int, ids array<int>, counts array<int>"))


def fit(sample: DataFrame, epochs: int = 12, rate: float = 1.0, seed: int = 1) -> Model | None:
    """Stochastic gradient descent over the bounded sample; None where a class is missing.

    The rate of a step is normalised by the mean squared share of the document's buckets, so that long and short
    documents move their average by the same amount.
    """
    got = sample.toArrow().combine_chunks().sort_by("_order")
    y = got.column("_label").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    ids, counts, ends = [], [], [0]
    for chunk_ids, chunk_counts in zip(got.column("ids").chunks, got.column("counts").chunks):
        ids.append(chunk_ids.flatten().to_numpy())
        counts.append(chunk_counts.flatten().to_numpy())
        ends += (ends[-1] + np.cumsum(chunk_ids.value_lengths().to_numpy())).tolist()
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    del got
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, ((1 + len(GRAMS)) << BITS, DIM)).astype(np.float32)
    weights = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(y)):
            at, share = ids[ends[k]:ends[k + 1]], counts[ends[k]:ends[k + 1]].astype(np.float32)
            share /= max(1, share.sum())
            hidden = share @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = weights @ p
            weights -= 0.1 * pace * np.outer(hidden, p)
            bias -= 0.1 * pace * p
            if len(at):
                vectors[at] -= np.outer(share * (pace / float(share @ share)) / 10, back)
    return Model(vectors, weights, bias)


def score(spark: SparkSession, model: Model | None, prior: float = 0.5):
    """Column function: probability of label 1 for a text column (null counts as empty)."""
    if model is None:
        return lambda column: F.lit(float(prior))
    side, offset = model.folded()
    shared = spark.sparkContext.broadcast(side.astype(np.float32))  # (1 + len(GRAMS)) * 2**BITS floats

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        v = shared.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            total, n = 0.0, 0
            for part in buckets((text.as_py() or "").encode()):
                total += float(v[part].sum(dtype=np.float64))
                n += len(part)
            out[i] = offset + (total / n if n else 0.0)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return lambda column: probability(F.coalesce(column, F.lit("")))


def held_out():
    """The fold never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(labelled(docs, labels))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of `docs` with `held_out`, `score` and `predicted` (columns of these names are replaced).

    Whole texts are scored from their words and n-grams alone. Empty and null texts get the score of the bias; without
    both classes among the labels every score is 0.5. Repeated rows and ties get equal scores; an empty table gives an
    empty one; other columns pass through unseen, nulls included.
    """
    model = train(docs, labels)
    rated = score(docs.sparkSession, model)(F.col("text"))
    return (docs.withColumn("held_out", held_out()).withColumn("score", rated)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted as label 0 go, the others stay as they are."""
    rated = score(spark, train(docs, table(spark, sf_dir, "labels")))(F.col("text"))
    return docs.where(rated >= 0.5)
