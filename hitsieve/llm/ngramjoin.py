"""N-gram Jaccard join: MinHash buckets, Bayesian candidate pruning, exact verification in blocks of a cluster."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hitsieve.llm.common import Forest, in_blocks, rows_of, starts_of, store, table, text_of
from hitsieve.llm.graph import components
from hitsieve.llm.wordhash import mix, windows, word_hashes

WORDS, NUM, DEN = 5, 4, 5  # shingles of five words, similarity of 4/5 or more
BANDS, ROWS = 40, 4  # a pair at the threshold shares no bucket with probability (1 - 0.8**4)**40 = 8e-10
HASHES, STEP = BANDS * ROWS, 32
TOLERANCE = 1e-9  # posterior probability below which a pair is dropped
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
PAIRS = 1 << 15  # pairs compared at once
_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; a text of fewer words has one run, one without words none."""
    return np.unique(windows(word_hashes(text.encode()), n))


def signature(found: np.ndarray) -> np.ndarray:
    """The low 16 bits of each of the HASHES minima (two different minima agree in them once in 65,536 times)."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        low = np.minimum(low, ((short[at:at + 1024, None] ^ _XOR) * _ODD).min(axis=0))
    return low.astype(np.uint16)


@lru_cache
def least_matches(seen: int) -> int:
    """Matches among `seen` MinHash values that a pair needs to stay.

    With a uniform prior the similarity is Beta(m + 1, seen - m + 1) after m matches; the chance that it reaches the
    threshold is that of at most m successes in seen + 1 trials at the threshold.
    """
    t, total = NUM / DEN, 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * t ** m * (1 - t) ** (seen + 1 - m)
        if total >= TOLERANCE:
            return m
    return seen


def prune(signs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compares MinHash values STEP at a time and drops pairs as soon as the posterior falls below the tolerance."""
    matches = np.zeros(len(left), np.int32)
    for at in range(0, HASHES, STEP):
        matches += (signs[left, at:at + STEP] == signs[right, at:at + STEP]).sum(axis=1, dtype=np.int32)
        stay = matches >= least_matches(at + STEP)
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def block_pairs(cuts: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of positions within each block, small blocks together; two rows of one side (0 or 1) are no pair."""
    sizes = np.diff(cuts)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
        first, second = np.triu_indices(size, 1)
        begins = cuts[:-1][sizes == size]
        per = max(1, PAIRS // len(first))
        for at in range(0, len(begins), per):
            left = (begins[at:at + per, None] + first).ravel()
            right = (begins[at:at + per, None] + second).ravel()
            yield (*_across(left, right, side), False)
    for begin, end in zip(cuts[:-1][sizes > 32], cuts[1:][sizes > 32]):
        parts = []
        per = max(1, PAIRS // (end - begin))
        for at in range(begin, end, per):
            rows = np.arange(at, min(at + per, end))
            left = np.repeat(rows, end - rows - 1)
            right = np.concatenate([np.arange(r + 1, end) for r in rows])
            parts.append(_across(left, right, side))
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), True


def _across(left: np.ndarray, right: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stay = (side[left] != side[right]) | (side[left] == 2)
    return left[stay], right[stay]


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    return (int(mix(found).sum(dtype=np.uint64).view(np.int64)),
            int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))


class _Sketch:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, signs = [], [], []
            for text in batch.column("_text"):
                found = shingles(text.as_py())
                keys.append(set_key(found))
                n.append(len(found))
                signs.append(signature(found).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)],
                 pa.array(n, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "th", "k1", "k2", "n", "signs"])


class _Shingle:
    """The sets of the texts, each set once a task."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            step = max(1, int(batch.num_rows * (4 << 20) / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                keys, sets = [], []
                for text in batch.column("_text").slice(at, step):
                    found = shingles(text.as_py())
                    key = set_key(found)
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(sets, pa.binary())],
                                                 ["k1", "k2", "found"])


def _connect(whole: pa.Table) -> pa.Table | None:
    """Edges between the rows of a bucket that survive the pruning; a pair counts in its first common band only."""
    reps, side, band = (whole.column(c).to_numpy() for c in ("rep", "side", "band"))
    signs = rows_of(whole.column("signs"), HASHES, "<u2")
    bands = rows_of(whole.column("signs"), BANDS, "<u8")
    a, b = [], []
    for left, right, large in block_pairs(starts_of(whole.column("blk").to_numpy()), side):
        kept = []
        for at in range(0, len(left), PAIRS):
            i, j = left[at:at + PAIRS], right[at:at + PAIRS]
            first = (bands[i] == bands[j]).argmax(axis=1) == band[i]
            kept.append(prune(signs, i[first], j[first]))
        i, j = np.concatenate([k[0] for k in kept] or [left]), np.concatenate([k[1] for k in kept] or [right])
        if large and len(i):
            i, j = _spanning(i, j)
        a.append(reps[i])
        b.append(reps[j])
    if not a:
        return None
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position of the pairs with the root of its set: fewer edges, same components."""
    seen, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    forest = Forest(len(seen))
    forest.join(zip(at[:len(i)].tolist(), at[len(i):].tolist()))
    roots = np.array([forest.root(x) for x in range(len(seen))])
    return seen, seen[roots]


def _verify(whole: pa.Table) -> pa.Table | None:
    """Exact links of each row within its block: copies linked to it, and the root of its set."""
    whole = _once(whole)
    reps, side, copies = (whole.column(c).to_numpy() for c in ("rep", "side", "copies"))
    signs = rows_of(whole.column("signs"), HASHES, "<u2")
    found = [np.frombuffer(x.as_py(), np.uint64) for x in whole.column("found")]
    sizes = np.array([len(x) for x in found])
    links, a, b = np.zeros(len(reps), np.int64), [], []
    for left, right, large in block_pairs(starts_of(whole.column("blk").to_numpy()), side):
        kept = []
        for at in range(0, len(left), PAIRS):
            i, j = left[at:at + PAIRS], right[at:at + PAIRS]
            near = (DEN * np.minimum(sizes[i], sizes[j]) >= NUM * np.maximum(sizes[i], sizes[j])) & (reps[i] != reps[j])
            kept.append(prune(signs, i[near], j[near]))
        i, j = np.concatenate([k[0] for k in kept] or [left]), np.concatenate([k[1] for k in kept] or [right])
        both = _overlaps(found, i, j)
        linked = DEN * both >= NUM * (sizes[i] + sizes[j] - both)
        i, j = i[linked], j[linked]
        if not len(i):
            continue
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        i, j = _spanning(i, j)
        a.append(i)
        b.append(j)
    if not a:
        return None
    i, j = np.concatenate(a), np.concatenate(b)
    return pa.table({"rep": reps[i], "links": links[i], "root": reps[j]})


def _once(whole: pa.Table) -> pa.Table:
    """One row for each block and class: a set that several tasks have read comes as often."""
    keys = np.stack([whole.column("blk").to_numpy(), whole.column("rep").to_numpy()], axis=1)
    _, first = np.unique(keys, axis=0, return_index=True)
    return whole if len(first) == len(keys) else whole.take(first)


def _overlaps(found: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs, row by row: each left set is marked once and read by all its partners."""
    both = np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    cuts = starts_of(i[order]) if len(i) else [0]
    for begin, end in zip(cuts[:-1], cuts[1:]):
        at = order[begin:end]
        own = found[i[at[0]]]
        for part in range(0, len(at), 64):
            some = at[part:part + 64]
            others = [found[k] for k in j[some]]
            joined = np.concatenate(others)
            spot = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            hits = np.concatenate(([0], np.cumsum(own[spot] == joined)))
            ends = np.cumsum([len(x) for x in others])
            both[some] = hits[ends] - hits[ends - [len(x) for x in others]]
    return both


def _blocked(rows: DataFrame, parts, key: str) -> DataFrame:
    """Deals the rows of a key over `parts` parts and copies each to the pairs of parts it belongs to.

    A pair of rows meets in exactly one block; `side` tells the parts of a block apart, 2 means a part with itself.
    """
    cut = rows.withColumn("_k", F.greatest(F.lit(1), F.ceil(parts)).cast("int")).withColumn("_p", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    many = cut.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return (many.withColumn("blk", F.xxhash64(key, F.least("_p", "_q"), F.greatest("_p", "_q")))
            .withColumn("side", F.when(F.col("_p") == F.col("_q"), 2).when(F.col("_p") < F.col("_q"), 0).otherwise(1))
            .drop("_k", "_p", "_q"))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, k1, k2, n) of the documents; classes (k1, k2, least, first, copies, n_links) of those with words.

    `least` is the smallest (doc_id, th, rep) of a class, `first` the smallest of all classes reachable by links. A class
    is numbered when its table is written, so ids may be null or repeat; `th` hashes a text.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), text_of().alias("_text")).withColumn("th", F.xxhash64("_text"))
    rows = store(base.mapInArrow(_Sketch(), "doc_id long, th long, k1 long, k2 long, n long, signs binary"), "sketches")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "th")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signs").alias("signs"))
    classes = store(classes.withColumn("rep", F.monotonically_increasing_id()).withColumn("least", F.struct("one.doc_id", "one.th", "rep")).drop("one"), "classes")
    banded = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                                                lambda b: F.xxhash64(b, F.substring("signs", b * 8 + 1, F.lit(8))))).alias("band", "bucket"))
    met = banded.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("m > 1")
    placed = _blocked(met, F.col("m") / BLOCK, "bucket").select("rep", "band", "blk", "side")
    signed = placed.join(classes.select("rep", "signs"), "rep")
    edges = in_blocks(signed, "blk", _connect, "a long, b long")
    clusters = components(edges)

    members = store(clusters.withColumnRenamed("id", "rep").join(classes, "rep"), "members")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mass"))
    wanted = store(members.select("least.doc_id").distinct(), "wanted")  # other texts of these ids have other keys and go below
    sets = store(base.join(wanted, "doc_id", "left_semi").select("_text").mapInArrow(_Shingle(), "k1 long, k2 long, found binary"), "sets")
    full = sets.join(members.select("k1", "k2", "rep", "label", "copies", "signs"), ["k1", "k2"]).join(sizes, "label").drop("k1", "k2")
    blocks = _blocked(full, F.greatest(F.col("m") / BLOCK, F.col("mass") / BLOCK_SHINGLES), "label")
    exact = store(in_blocks(blocks, "blk", _verify, "rep long, links long, root long"), "exact")
    linked = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(exact.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    firsts = groups.join(classes.select("rep", "least"), "rep").groupBy("label").agg(F.min("least").alias("first"))
    named = (classes.join(linked, "rep", "left").join(groups.join(firsts, "label").select("rep", "first"), "rep", "left")
             .select("k1", "k2", "least", F.coalesce("first", "least").alias("first"), "copies",
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return rows.drop("signs"), named


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, kept) for each row of `docs(doc_id, text)`.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. `n_links`
    counts the other rows linked to the document, rows with an equal set (`n_copies` of them, itself included) among
    them; `class_id` is the smallest doc_id reachable by links and `kept` marks it.

    Words are split at blanks and compared as they are. Texts of 1 to 4 words have one shingle; empty and null texts
    have none and link with nothing. A null doc_id stands for id -1. Ids only name the result: rows that repeat an id are
    compared each by its own text. An empty table gives an empty one.

    1. Rows with equal sets are one class before anything is compared, so exact copies never form pairs.
    2. MinHash buckets propose pairs; a bucket of more than BLOCK classes is split into pairs of parts. Within a block
       MinHash values are compared step by step and a pair goes when its posterior falls below TOLERANCE. What survives
       leaves the task as a spanning forest, not as pairs, and gives the candidate clusters.
    3. Texts of clusters alone are read again, one for each class. Clusters are split into blocks of bounded rows and
       bounded shingles; each block prunes its pairs the same way and verifies the rest exactly, giving a count per class
       and a forest.
    """
    rows, named = _joined(docs)
    whole = rows.join(named, ["k1", "k2"], "left")
    return whole.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                        F.coalesce("copies", F.lit(1)).alias("n_copies")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked rows one stays, with the smallest id; rows without words stay.

    A null id counts as -1. Rows of one id with different texts are groups of their own.
    """
    rows, named = _joined(docs)
    first = F.struct("first.doc_id", "first.th")
    gone = store(rows.join(named.select("k1", "k2", "first"), ["k1", "k2"]).where(F.struct("doc_id", "th") != first).select("doc_id", "th").distinct(), "gone")
    often = store(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id"), "often")
    again = store(rows.where("n > 0").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id", "th"), "again")
    keys = ["_near_id", "_near_th"]
    left = docs.withColumns({keys[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), keys[1]: F.xxhash64(text_of())})
    # an id of one row needs no text hash, which keeps the table of what goes small
    alone = store(gone.join(often, "doc_id", "left_anti").select(F.col("doc_id").alias(keys[0])), "alone")
    mixed = store(gone.join(often, "doc_id", "left_semi").select(F.col("doc_id").alias(keys[0]), F.col("th").alias(keys[1])), "mixed")
    left = left.join(alone, keys[0], "left_anti").join(mixed, keys, "left_anti")
    again = again.toDF(*keys)
    once = left.join(again, keys, "left_anti").unionByName(left.join(again, keys, "left_semi").dropDuplicates(keys))
    return once.select(*docs.columns)


OP5_SQL = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: w[i:i + {WORDS - 1}])) AS g
         FROM split WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b, s.n = x.n AND s.n = y.n AS same FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE {DEN} * s.n >= {NUM} * (x.n + y.n - s.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n, count(*) FILTER (same) AS same FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low.b, doc_id)) AS class_id, coalesce(c.n, 0) AS n_links, coalesce(c.same, 0) + 1 AS n_copies,
       doc_id = least(doc_id, coalesce(low.b, doc_id)) AS kept
FROM documents LEFT JOIN low ON low.a = doc_id LEFT JOIN counted c ON c.a = doc_id
"""
