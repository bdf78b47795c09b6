"""Suffix-array dedup: byte strings of a given length that occur elsewhere are removed, over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitsieve.llm.common import in_blocks, store, table, text_of
from hitsieve.llm.wordhash import BASE, BYTE, mix, powers

LENGTH = 400  # bytes of a string that must not occur twice
GRAM = 64  # bytes of an anchor
PART = 1 << 20  # starts handled at once
GROUP = 1024  # distinct segments of an anchor that one suffix array takes
SHARE = 8192  # segments of a large group for which a share of its strings is set up
SORTED = 1 << 17  # bytes of small groups that share one suffix array
_OTHER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE2 = 0xC2B2AE3D27D4EB4F
_UP = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _UP or len(_UP[base][0]) < n:
        size = max(n, 1 << 14)
        _UP[base] = powers(base, size), powers(pow(base, -1, 1 << 64), size)
    return _UP[base]


class Spans:
    """Hashes of byte spans of one array by prefix sums."""

    def __init__(self, data: np.ndarray, base: int = BASE, letters: np.ndarray = BYTE):
        up, self.down = _powers(base, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * up[:len(data)], out=self.total[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.down[:n])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts (first, last, anchor hash, two hashes of the run's bytes) whose strings have the same anchor.

    The anchor of a string is the smallest hash among its `gram`-byte pieces, the first of equals: it follows from the
    string alone, so equal strings have equal anchors at equal places, wherever they stand.
    """
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, PART):
        part = data[at:at + PART + length - 1]
        first, second = Spans(part), Spans(part, _BASE2, _OTHER)
        grams = first.every(gram)
        keys = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        low = sliding_min(keys, width) & np.uint64(0xFFFFFF)
        begin = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        last = np.concatenate((begin[1:] - 1, [len(low) - 1]))
        yield begin + at, last + at, grams[low[begin].astype(np.int64)], first(begin, last + length), second(begin, last + length)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from running minima of blocks of this width in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first `depth` bytes at least (ties in any order), by two-stage sorting.

    Suffixes smaller than their successor are sorted directly. The others follow by scanning the buckets of first bytes
    from the smallest: whenever a suffix has its place, the one that starts a byte earlier, if it is not smaller than
    its successor, gets the next place of its own bucket. Within a bucket such suffixes come before the sorted ones.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    wide = data.astype(np.int16)
    step = np.concatenate((np.sign(np.diff(wide)), [-1]))  # the end is smaller than every byte
    # a run of equal bytes takes the direction of what follows it
    back = np.where(step[::-1] != 0, np.arange(n), 0)
    smaller = step[::-1][np.maximum.accumulate(back)][::-1] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    view = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    direct = direct[np.argsort(np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel(), kind="stable")]
    counts = np.bincount(data, minlength=256)
    starts = np.concatenate(([0], np.cumsum(counts)))
    order = np.empty(n, np.int64)
    firsts = data[direct]
    sorted_in = np.concatenate(([0], np.cumsum(np.bincount(firsts, minlength=256))))
    free = starts[:-1].copy()

    def place(at: np.ndarray) -> None:
        """Puts the predecessors of the suffixes `at`, in this order, at the free places of their buckets."""
        before = at[at > 0] - 1
        before = before[~smaller[before]]
        letters = data[before]
        by = np.argsort(letters, kind="stable")
        before, letters = before[by], letters[by]
        cuts = np.concatenate(([0], np.flatnonzero(letters[1:] != letters[:-1]) + 1)) if len(before) else np.zeros(0, int)
        for a, b in zip(cuts, [*cuts[1:], len(before)]):
            c = letters[a]
            order[free[c]:free[c] + b - a] = before[a:b]
            free[c] += b - a

    place(np.array([n]))
    for c in np.flatnonzero(counts):
        done = starts[c]
        while done < free[c]:  # places filled from within the bucket are scanned in their turn
            upto = free[c]
            place(order[done:upto])
            done = upto
        own = direct[sorted_in[c]:sorted_in[c + 1]]
        order[starts[c + 1] - len(own):starts[c + 1]] = own
        place(own)
    return order


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most `most`; all pairs advance by words of 8 bytes."""
    padded = np.concatenate((data, np.zeros(most + 16, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + most + 8, 8), (1, 1)).copy().view("<u8").ravel()
    size, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, most, 8):
        odd = words[a[live] + at] ^ words[b[live] + at]
        same = odd == 0
        size[live[same]] += 8
        rest = odd[~same]
        for k in range(1, 8):  # equal bytes below the first that differs
            size[live[~same]] += rest & np.uint64((1 << 8 * k) - 1) == 0
        live = live[same]
    return np.minimum(np.minimum(size, most), len(data) - np.maximum(a, b))


class _Segments:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(7)]
            size = 0
            for did, row, text in zip(batch.column("did"), batch.column("row"), batch.column("_text")):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                for begin, last, anchor, h1, h2 in segments(data):
                    n = len(begin)
                    for place, x in zip(held, (np.full(n, did.as_py()), np.full(n, row.as_py()), begin, last, *[h.view(np.int64) for h in (anchor, h1, h2)])):
                        place.append(x)
                    size += n
                if size > 100_000:
                    yield self._batch(held)
                    held, size = [[] for _ in range(7)], 0
            if size:
                yield self._batch(held)

    @staticmethod
    def _batch(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in held], ["did", "row", "a", "b", "anchor", "h1", "h2"])


class _Cut:
    """The bytes of the wanted segments of each text."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, row, text, wanted in zip(*(batch.column(c) for c in ("did", "row", "_text", "wanted"))):
                data, wanted = text.as_py().encode(), wanted.as_py()
                for at in range(0, len(wanted), 4096):
                    part = wanted[at:at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([did.as_py()] * len(part)), pa.array([row.as_py()] * len(part)),
                         *[pa.array([w[c] for w in part]) for c in ("anchor", "a", "alone", "k")],
                         pa.array([data[w["a"]:w["b"] + LENGTH] for w in part], pa.binary())],
                        ["did", "row", "anchor", "a", "alone", "k", "seg"])


def _repeats(whole: pa.Table) -> pa.Table | None:
    """Runs of starts of the lone segments whose string occurs in another segment, by suffix arrays over whole groups."""
    anchors, a, alone = (whole.column(c).to_numpy() for c in ("anchor", "a", "alone"))
    segs = [np.frombuffer(x.as_py(), np.uint8) for x in whole.column("seg")]
    sizes = np.array([len(x) for x in segs])
    out: list[list[np.ndarray]] = [[], [], []]
    begin = 0
    ends = np.concatenate((np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]))
    total = np.cumsum(sizes)
    for n, end in enumerate(ends):
        nxt = ends[n + 1] if n + 1 < len(ends) else None
        if nxt is not None and total[nxt - 1] - (total[begin - 1] if begin else 0) <= SORTED:
            continue
        data = np.concatenate(segs[begin:end])
        at = np.cumsum(sizes[begin:end]) - sizes[begin:end]
        valid = np.zeros(len(data), bool)
        owner = np.repeat(np.arange(begin, end), sizes[begin:end])
        valid[np.arange(len(data)) - at[owner - begin] <= sizes[owner] - LENGTH] = True
        order = suffix_order(data, LENGTH)
        order = order[valid[order]]
        equal = common_prefix(data, order[:-1], order[1:], LENGTH) >= LENGTH
        twice = np.zeros(len(data), bool)
        twice[order[:-1][equal]] = True
        twice[order[1:][equal]] = True
        twice &= alone[owner]
        edge = np.diff(np.concatenate(([0], (twice * (owner + 1)), [0])))
        on = np.flatnonzero(twice & (edge[:-1] != 0))
        off = np.flatnonzero(twice & (edge[1:] != 0))
        who = owner[on]
        out[0].append(who)
        out[1].append(a[who] + on - at[who - begin])
        out[2].append(a[who] + off - at[who - begin])
        begin = end
    who = np.concatenate(out[0])
    if not len(who):
        return None
    return pa.table({"did": whole.column("did").take(pa.array(who)), "row": whole.column("row").take(pa.array(who)),
                     "a": np.concatenate(out[1]).astype(np.int64), "b": np.concatenate(out[2]).astype(np.int64)})


class _Strings:
    """The strings of a segment of a large group, dealt by their hash over the shares of the group.

    A row holds the strings of one segment in one share: their starts and two 64-bit hashes. A group of k segments has
    about k / SHARE shares, so a share holds a bounded number of strings whatever the group's size.
    """

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for did, row, anchor, a, alone, k, seg in zip(*(batch.column(c) for c in ("did", "row", "anchor", "a", "alone", "k", "seg"))):
                data = np.frombuffer(seg.as_py(), np.uint8)
                h1, h2 = Spans(data).every(LENGTH), Spans(data, _BASE2, _OTHER).every(LENGTH)
                share = h1 % np.uint64(-(-k.as_py() // self.size))
                name = mix(np.array([anchor.as_py()], np.int64).view(np.uint64))[0]
                for p in np.unique(share):
                    at = np.flatnonzero(share == p)
                    made = (did.as_py(), row.as_py(), int((name + p).view(np.int64)), alone.as_py(), (at + a.as_py()).astype("<i8").tobytes(),
                            np.stack([h1[at], h2[at]]).astype("<u8").tobytes())
                    for column, x in zip(out, made):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["did", "row", "share", "alone", "starts", "hashes"])


def _counted(whole: pa.Table) -> pa.Table | None:
    """Starts of the lone segments' strings that stand in another segment of their share, as bytes for each segment."""
    shares, alone = whole.column("share").to_numpy(), whole.column("alone").to_numpy()
    starts = [np.frombuffer(x.as_py(), "<i8") for x in whole.column("starts")]
    hashes = [np.frombuffer(x.as_py(), "<u8").reshape(2, -1) for x in whole.column("hashes")]
    size = np.array([len(x) for x in starts])
    owner = np.repeat(np.arange(len(size)), size)
    h, share = np.concatenate(hashes, axis=1), shares[owner]
    order = np.lexsort((h[1], h[0], share))
    same = np.concatenate(([False], (h[:, order[1:]] == h[:, order[:-1]]).all(axis=0) & (share[order[1:]] == share[order[:-1]]), [False]))
    twice = np.zeros(len(owner), bool)
    twice[order] = same[1:] | same[:-1]
    twice &= alone[owner]
    cuts = np.concatenate(([0], np.cumsum(size)))
    hit = np.flatnonzero(np.add.reduceat(twice, cuts[:-1]) > 0) if len(size) else np.zeros(0, int)
    if not len(hit):
        return None
    found = [starts[i][twice[cuts[i]:cuts[i + 1]]].astype("<i8").tobytes() for i in hit]
    return pa.table({"did": whole.column("did").take(pa.array(hit)), "row": whole.column("row").take(pa.array(hit)), "starts": pa.array(found, pa.binary())})


class _Remove:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[int, int, int, bytes]] = []
            for text, runs, more in zip(*(batch.column(c) for c in ("_text", "runs", "more"))):
                data, end, parts, spans, removed = (text.as_py() or "").encode(), 0, [], 0, 0
                found = [(r["a"], r["b"] + LENGTH) for r in runs.as_py() or []]
                found += [(x, x + LENGTH) for part in more.as_py() or [] for x in np.frombuffer(part, "<i8").tolist()]
                for run in sorted(found):
                    if run[1] <= end:
                        continue
                    if run[0] > end or not spans:
                        parts.append(data[end:run[0]])
                        spans += 1
                        removed -= run[0]
                    else:
                        removed -= end
                    end = run[1]
                    removed += end
                parts.append(data[end:])
                made.append((len(data), removed, spans, b"".join(parts)))
            columns = list(zip(*made)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(list(c), pa.int64()) for c in columns[:3]], pa.array(list(columns[3]), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of `docs(doc_id, text)`; kept is what remains, in bytes.

    Every byte covered by a LENGTH-byte string that also starts anywhere else, in the same document or another, is
    removed. Null and empty texts have no bytes and stay; texts shorter than LENGTH lose nothing; repeated rows repeat
    each other's strings; a null doc_id is a row like others; an empty table gives an empty one.

    1. Equal strings share an anchor, so texts are cut into segments of starts with one anchor (about 170 starts each).
       Segments with equal bytes are counted by their hashes before any shuffle: where there are two or more, all
       their strings repeat. A lone segment whose anchor stands nowhere else has no repeated string.
    2. What is left are anchors with several different segments, mostly at the borders of repeated passages. Their
       bytes are read again and each group gets a suffix array by two-stage sorting; neighbours with a common prefix of
       LENGTH bytes repeat each other.
    3. An anchor with over GROUP different segments would be too large for one suffix array. Its strings are dealt by
       hash over shares of bounded size and compared by two 64-bit hashes there, which gives the same answer.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text")).withColumns(
        {"did": F.coalesce("doc_id", F.lit(-1)), "row": F.xxhash64("_text")})
    cut = store(base.mapInArrow(_Segments(), "did long, row long, a long, b long, anchor long, h1 long, h2 long"), "segments")
    classes = cut.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "row", "a", "b")).alias("rep"))
    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == 1).alias("lone"), F.sum("n").alias("n"))
    groups = store(groups.where("n > 1"), "anchors")
    classes = store(classes.join(groups.select("anchor", "k", "lone"), "anchor").select("anchor", "h1", "h2", "n", "rep", "k", "lone"), "classes")

    whole = cut.join(classes.where("n > 1").select("anchor", "h1", "h2"), ["anchor", "h1", "h2"]).select("did", "row", "a", "b")
    open_ = classes.where("k > 1 and lone > 0").select("anchor", "rep.*", (F.col("n") == 1).alias("alone"), "k")
    wanted = open_.groupBy("did", "row").agg(F.collect_list(F.struct("anchor", "a", "b", "alone", "k")).alias("wanted"))
    texts = base.select("did", "row", "_text").join(wanted, ["did", "row"])
    bytes_ = store(texts.mapInArrow(_Cut(), "did long, row long, anchor long, a long, alone boolean, k long, seg binary"), "bytes")
    sorted_ = in_blocks(bytes_.where(F.col("k") <= GROUP).drop("k"), "anchor", _repeats, "did long, row long, a long, b long")
    strings = bytes_.where(F.col("k") > GROUP).mapInArrow(_Strings(SHARE), "did long, row long, share long, alone boolean, starts binary, hashes binary")
    counted = in_blocks(strings, "share", _counted, "did long, row long, starts binary")
    found = whole.unionByName(sorted_).withColumn("starts", F.lit(None).cast("binary")).unionByName(counted, allowMissingColumns=True)
    runs = found.groupBy("did", "row").agg(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("runs"),
                                           F.collect_list("starts").alias("more"))
    joined = base.join(runs, ["did", "row"], "left").select("doc_id", "_text", "runs", "more")
    return joined.mapInArrow(_Remove(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
