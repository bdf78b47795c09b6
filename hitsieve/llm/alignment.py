"""Alignment of two tokenizers: groups between common token ends, and links scored through bitmaps of each pair of ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hitsieve.llm.bpe import LEAF, VOCABULARY, Codec, codec, encode_tree
from hitsieve.llm.common import in_blocks, store, table
from hitsieve.llm.piecetable import MODEL, SPACE, pieces

SPAN = 16  # bits of a document's number that are its place in a bitmap; the bits above are the bitmap's span
DENSE = 1 << SPAN - 4  # documents from which a bitmap is written bit by bit; with fewer it is a list of places
WORDS = 1 << 16  # stretches that a worker remembers here, where it holds two vocabularies
SLICE = 1 << 18  # code points of the texts that are aligned in one step
LINKS = 1 << 19  # links a task holds before it writes their bitmaps


class PlainCodec(Codec):
    """The vocabulary without added tokens: their strings in a text are plain text."""

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")


class Sizes:
    """Byte lengths of both vocabularies' tokens: what links need, without any coder."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.size_a, self.size_b = (np.array([len(p) for p in pieces], np.int64) for pieces in (a, b))


class Pair(Sizes):
    """Both vocabularies: ids of a text, byte lengths, and the decimal ids with the sign that follows them."""

    def __init__(self, vocabulary: str, model: str):
        self.a, self.b = PlainCodec(vocabulary), pieces(model, WORDS)
        super().__init__(self.a.pieces, self.b.raw)
        if len(self.size_a) > 1 << 16:
            raise ValueError("a pair of ids must fit in 32 bits")
        words = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        self.inner, self.bar, self.last = (np.array([w + sign for w in words], object) for sign in (",", "|", ";"))

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the space and each text by A, and of the text by B (which adds the space); none where bytes differ."""
        # B takes its own space sign for a space; it spells all else in letters or bytes
        texts = [t if t and SPACE not in t else "" for t in texts]
        none, out = np.zeros(0, "<u4"), []
        for text, b in zip(texts, self.b.encode_many(texts)):
            whole = f" {text}"
            a = encode_tree(self.a, whole) if len(whole) > LEAF else self.a.encode(whole)
            same = text and self.size_a[a].sum() == self.size_b[b].sum() == len(whole.encode())
            out.append((a, b) if same else (none, none))
        return out


@lru_cache(maxsize=2)
def pair(vocabulary: str = VOCABULARY, model: str = MODEL) -> Pair:
    return Pair(vocabulary, model)


def linked(code: Sizes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each token's end is one of the other tokenizer's, in the joined bytes of some texts, and for each link its tokens' positions.

    Two tokens overlap in one stretch of bytes, which ends where one of them ends; so every end of either is one link.
    """
    ends_a, ends_b = np.cumsum(code.size_a[a]), np.cumsum(code.size_b[b])
    size = 1 + max(int(e[-1]) if len(e) else 0 for e in (ends_a, ends_b))
    at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
    at_a[ends_a], at_b[ends_b] = True, True
    ends = np.flatnonzero(at_a | at_b)
    # the ends before a link's own end are as many as the tokens before its token
    link_a, link_b = (np.cumsum(at[ends]) - at[ends] for at in (at_a, at_b))
    return at_b[ends_a], at_a[ends_b], link_a, link_b


def _aligned_slice(code: Pair, texts: list[str | None]) -> dict[str, pa.Array]:
    found = code.ids(texts)
    size_a, size_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    shared_a, shared_b, link_a, _ = linked(code, a, b)
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    groups = int(shared_a.sum())
    before_a, before_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=groups)))) for g in (group_a, group_b))
    words = np.empty(len(a) + len(b), object)
    words[np.arange(len(a)) + before_b[group_a]] = np.where(shared_a, code.bar[a], code.inner[a])
    words[np.arange(len(b)) + before_a[group_b + 1]] = np.where(shared_b, code.last[b], code.inner[b])
    at_a, at_b = (np.concatenate(([0], np.cumsum(s))) for s in (size_a, size_b))
    texts_of = ["".join(words[x:y].tolist())[:-1] for x, y in zip(at_a[:-1] + at_b[:-1], at_a[1:] + at_b[1:])]
    before = np.concatenate(([0], np.cumsum(shared_a)))
    return {"ids_a": _short(a, at_a), "ids_b": _short(b, at_b), "groups": pa.array(texts_of, pa.string()),
            "n_a": pa.array(size_a), "n_b": pa.array(size_b), "n_groups": pa.array(before[at_a[1:]] - before[at_a[:-1]]),
            "n_links": pa.array(np.diff(np.searchsorted(link_a, at_a)))}


def _short(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 16-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u2").tobytes())])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the runs and the ids that `_short` wrote."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return at // 2, np.frombuffer(column.buffers()[2] or b"", "<u2", int(at[-1]) // 2)


ALIGNED = T.StructType([T.StructField(n, t) for n, t in (
    ("ids_a", T.BinaryType()), ("ids_b", T.BinaryType()), ("groups", T.StringType()), ("n_a", T.LongType()),
    ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()))])


class _Align:
    def __init__(self, text: str, names: list[str], vocabulary: str, model: str):
        self.text, self.names, self.paths = text, names, (vocabulary, model)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pair(*self.paths)
        for batch in batches:
            texts, at = batch.column(self.text), 0
            while at < batch.num_rows:
                held, size, end = [], 0, at
                while end < batch.num_rows and (end == at or size < SLICE):
                    held.append(texts[end].as_py())
                    size += len(held[-1] or "")
                    end += 1
                part, out = batch.slice(at, end - at), _aligned_slice(code, held)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in self.names), *out.values()], [*self.names, *out])
                at = end
            del part, out
            pa.default_memory_pool().release_unused()  # else a batch's buffers stay with the worker


def aligned(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Ids of both tokenizers and the groups between common ends, for every whole text, where it is read.

    Adds `ids_a`, `ids_b` (little-endian unsigned 16-bit integers), `groups` (`a1,a2|b1;a3|b2,b3`), `n_a`, `n_b`, `n_groups` and `n_links` (overlapping
    occurrences) to the other columns of `docs`; columns of these names are replaced and the text itself is left out.
    Null and empty texts, and texts that either tokenizer changes, have no tokens. Repeated rows are aligned each; an
    empty table gives an empty one.
    """
    rows = docs.drop(*ALIGNED.names)
    kept = [f for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(_Align(text, [f.name for f in kept], vocabulary, model), T.StructType([*kept, *ALIGNED]))


class _Bitmaps:
    """The documents of each pair of ids as compressed bitmaps, a part of a span at a time."""

    def __init__(self, vocabulary: str, model: str):
        self.sizes = Sizes(codec(vocabulary).pieces, pieces(model).raw)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, links, span = [], 0, -1
        pair.cache_clear()  # a worker that has aligned texts before gives up both vocabularies
        pieces.cache_clear()
        for batch in batches:
            number = batch.column("_n").to_numpy()
            at, flat = zip(*(_ids(batch.column(n)) for n in ("ids_a", "ids_b")))
            steps = np.flatnonzero(np.diff(number >> SPAN) | np.diff(at[0][1:] // SLICE)) + 1
            for start, end in zip([0, *steps], [*steps, len(number)]):
                if number[start] >> SPAN != span or links >= LINKS:
                    yield from _written(held, span)
                    held, links, span = [], 0, int(number[start] >> SPAN)
                ids_a, ids_b = (flat[k][at[k][start]:at[k][end]] for k in (0, 1))
                _, _, link_a, link_b = linked(self.sizes, ids_a, ids_b)
                row = np.repeat(np.arange(start, end), np.diff(at[0][start:end + 1]))[link_a]
                place = (number[row] & (1 << SPAN) - 1).astype(np.uint64)
                held.append(ids_a[link_a].astype(np.uint64) << np.uint64(32) | ids_b[link_b].astype(np.uint64) << np.uint64(16) | place)
                links += len(place)
            pa.default_memory_pool().release_unused()
        yield from _written(held, span)


def _written(held: list[np.ndarray], span: int) -> Iterator[pa.RecordBatch]:
    keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
    if not len(keys):
        return
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    more = np.diff(np.concatenate((first, [len(keys)]))) - 1
    keys = keys[first]
    yield from _plane(keys, span, 0)
    keys, more = keys[more > 0], more[more > 0]
    for level in range(1, int(more.max(initial=0)).bit_length() + 1):
        yield from _plane(keys[more >> level - 1 & 1 > 0], span, level)


def _plane(keys: np.ndarray, span: int, level: int) -> Iterator[pa.RecordBatch]:
    """A row for each pair with its documents of one level, from sorted keys of pair and place."""
    if not len(keys):
        return
    of_pair, place = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype("<u2")
    at = np.concatenate(([0], np.flatnonzero(of_pair[1:] != of_pair[:-1]) + 1, [len(keys)]))
    for x in range(0, len(at) - 1, 1 << 15):
        cut = at[x:x + (1 << 15) + 1]
        n = len(cut) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(of_pair[cut[:-1]]), pa.array(np.full(n, span)), pa.array(np.full(n, level, np.int32)),
             _packed(place[cut[0]:cut[-1]], cut - cut[0])], ["pair", "span", "level", "bits"])


def _packed(place: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bitmaps of runs of sorted places: the places themselves, or one bit for each place of the span where they are many."""
    if np.diff(at).max() < DENSE:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(place.tobytes())])
    return pa.array([_bitmap(place[x:y]) for x, y in zip(at, at[1:])], pa.binary())


def _bitmap(place: np.ndarray) -> bytes:
    if len(place) < DENSE:
        return place.astype("<u2").tobytes()
    bits = np.zeros(1 << SPAN, np.uint8)
    bits[place] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _places(bits: bytes) -> np.ndarray:
    if len(bits) < 2 * DENSE:
        return np.frombuffer(bits, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype("<u2")


@F.arrow_udf(T.BinaryType())
def any_of(parts: pa.Array) -> pa.Array:
    """The bitmaps of a list OR-ed into one."""
    at, each = parts.offsets.to_numpy(), parts.values
    if len(parts) == at[-1] - at[0] and np.diff(at).max(initial=1) == 1:
        return each.slice(at[0], len(parts))
    whole = [[each[k].as_py() for k in range(x, y)] for x, y in zip(at, at[1:])]
    return pa.array([p[0] if len(p) == 1 else _bitmap(np.unique(np.concatenate([_places(b) for b in p]))) for p in whole], pa.binary())


def members(bits: str | Column) -> Column:
    """Number of documents in a bitmap."""
    size = F.octet_length(bits)
    return F.when(size < 2 * DENSE, size / 2).otherwise(F.bitmap_count(bits)).cast("long")


def weight() -> Column:
    """Links that a document of a level's bitmap stands for: one for being there, then the bits of the further ones."""
    return F.when(F.col("level") == 0, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.col("level") - 1)).cast("long")


def pair_bitmaps(numbered: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """`pair` (id of A times 2^16 plus id of B), `span`, `level`, `bits` from rows numbered by `_n`.

    Level 0 holds the documents with a link of the pair, level k those whose number of further links has bit k - 1 set.
    A task writes what it has seen of a span; the parts of a bitmap hold different documents and are OR-ed here.
    """
    parts = numbered.select("_n", "ids_a", "ids_b").mapInArrow(_Bitmaps(vocabulary, model), "pair long, span long, level int, bits binary")
    return parts.groupBy("pair", "span", "level").agg(F.collect_list("bits").alias("parts")).select("pair", "span", "level", any_of("parts").alias("bits"))


def pair_scores(bitmaps: DataFrame) -> DataFrame:
    """`pair`, `id_a`, `id_b`, its `documents` and `links` over the whole corpus, and whether no pair of its B id has more links."""
    n = members("bits")
    counts = bitmaps.groupBy("pair").agg(F.sum(F.when(F.col("level") == 0, n)).alias("documents"), F.sum(n * weight()).alias("links"))
    counts = counts.withColumns({"id_a": F.shiftright("pair", 16).cast("int"), "id_b": F.col("pair").bitwiseAND(0xFFFF).cast("int")})
    most = counts.groupBy("id_b").agg(F.max("links").alias("_most"))
    return counts.join(most, "id_b").select("pair", "id_a", "id_b", "documents", "links", (F.col("links") == F.col("_most")).alias("best"))


def _summed(rows: pa.Table) -> pa.Table:
    """Per document of some spans: links of best pairs and the sum of their counts."""
    bits = rows.column("bits").combine_chunks()
    at, raw = (np.frombuffer(bits.buffers()[k], kind) for k, kind in ((1, np.int32), (2, np.uint8)))
    at = at[bits.offset:bits.offset + len(bits) + 1].astype(np.int64)
    size, many = np.diff(at) // 2, np.diff(at) >= 2 * DENSE
    span, times, links, best = (rows.column(n).to_numpy() for n in ("span", "times", "links", "best"))
    few = raw[at[0]:at[-1]].view("<u2")[np.repeat(~many, size)]
    place, row = [few], [np.repeat(np.flatnonzero(~many), size[~many])]
    for k in np.flatnonzero(many):
        place.append(_places(raw[at[k]:at[k + 1]].tobytes()))
        row.append(np.full(len(place[-1]), k))
    place, row = np.concatenate(place).astype(np.int64), np.concatenate(row)
    number = span[row] << SPAN | place
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return pa.table({"_n": number[first], "n_best": np.add.reduceat(times[row] * best[row], first),
                     "count_sum": np.add.reduceat(times[row] * links[row], first)})


def scored(rows: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Aligned rows with `n_best` and `count_sum`, the scores of their links, in place of `ids_a` and `ids_b`.

    `n_best` counts the links whose pair has the most links of all pairs of its B id in the corpus (ties included),
    `count_sum` adds up the pairs' links. Rows are numbered and written once; their bitmaps go to the pairs, and the
    pairs' scores come back to each document through the same bitmaps. A pair that every document holds is a row for each
    span of 65,536 numbers and level, not one for each document. Rows without links have zeros; an empty table gives an
    empty one.
    """
    clash = [c for c in ("_n", "n_best", "count_sum") if c in rows.columns]
    numbered = store(rows.drop(*clash).withColumn("_n", F.monotonically_increasing_id()), "aligned")
    bitmaps = store(pair_bitmaps(numbered, vocabulary, model), "bitmaps")
    scores = pair_scores(bitmaps).select("pair", "links", F.col("best").cast("long").alias("best"))
    back = bitmaps.join(scores, "pair").select("span", weight().alias("times"), "links", "best", "bits")
    sums = in_blocks(back, "span", _summed, "_n long, n_best long, count_sum long").groupBy("_n").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return numbered.drop("ids_a", "ids_b").join(sums, "_n", "left").drop("_n").withColumns(
        {c: F.coalesce(c, none) for c in ("n_best", "count_sum")})


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return scored(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "ids_a", "ids_b"))
