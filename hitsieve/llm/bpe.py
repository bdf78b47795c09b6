"""BPE by tree concatenation: halves of long texts are encoded in parallel and joined by re-encoding around the cut."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitsieve.llm.common import store, table, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LEAF = 1 << 15  # code points of a text that one call encodes whole
WINDOW = 8  # tokens on either side of a cut that are encoded again at first
LETTER, DIGIT, BLANK, SIGN, OTHER = 1, 2, 3, 4, 0


class Codec:
    """Vocabulary of a byte-level BPE file with its added tokens; the coder is built when something is encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {i: bytes(byte_of[c] for c in word) for word, i in spec["model"]["vocab"].items() if word not in self.special}
        words |= {i: word.encode() for word, i in self.special.items()}
        self.pieces = [words.get(i, b"") for i in range(1 + max(words))]

    @cached_property
    def coder(self) -> tiktoken.Encoding:
        added = set(self.special.values())
        ranks = {piece: i for i, piece in enumerate(self.pieces) if piece and i not in added}
        return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next free one above 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(path)


def _class(c: str) -> int:
    """Class of a character where every Unicode version agrees; OTHER is unknown."""
    if c in " \t\n\r":
        return BLANK
    if c.isascii():
        return LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN if c.isprintable() else OTHER
    return LETTER if "À" <= c <= "ʯ" and c not in "×÷" else OTHER


def sure_cut(left: str, right: str) -> bool:
    """Whether the pattern always splits between two neighbours, whatever stands around them.

    No match has a blank after another character, a non-letter after a letter, a non-digit after a digit, or a digit
    after a sign. Inside an added token only letters meet signs; there nothing is sure.
    """
    a, b = _class(left), _class(right)
    if a == OTHER or a == BLANK:
        return False
    if b == BLANK:
        return True
    if (left, right) == ("t", "|"):
        return False
    return a == LETTER and b in (DIGIT, SIGN) or a == DIGIT and b in (LETTER, SIGN) or a == SIGN and b == DIGIT


def concatenate(code: Codec, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of the joined text from the ids of its halves.

    A growing window of tokens around the cut is encoded again until both sides agree: either the window's text has, on
    each side, a place where the pattern always splits (the ids outside are then those of the halves), or it lies
    within one run of letters and its first and last tokens are those of the halves (a sequence of tokens is the
    encoding of a run when every two neighbours are one). At last the window is the whole text.
    """
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    width = WINDOW
    while True:
        i, j = max(0, len(left) - width), min(len(right), width)
        while i > 0 and code.pieces[left[i]][0] & 0xC0 == 0x80:
            i -= 1
        while j < len(right) and code.pieces[right[j]][0] & 0xC0 == 0x80:
            j += 1
        before, after = code.decode_bytes(left[i:]).decode(), code.decode_bytes(right[:j]).decode()
        whole_left, whole_right = i == 0, j == len(right)
        found = _sure(code, left, i, before, whole_left, last=True), _sure(code, right[:j], 0, after, whole_right, last=False)
        if found[0] is not None and found[1] is not None:
            (a, text_a), (b, text_b) = found
            return np.concatenate([left[:a], code.encode(before[text_a:] + after[:text_b]), right[b:]])
        if not whole_left and not whole_right and len(before) + len(after) > 24 and (before + after).isascii() and (before + after).isalpha():
            again = code.encode(before + after)
            if len(again) > 1 and again[0] == left[i] and again[-1] == right[j - 1]:
                return np.concatenate([left[:i], again, right[j:]])
        width *= 4


def _sure(code: Codec, ids: np.ndarray, start: int, text: str, whole: bool, last: bool) -> tuple[int, int] | None:
    """Token and character position of the sure cut nearest to the join; an end of the half is one."""
    order = range(len(text) - 1, 0, -1) if last else range(1, len(text))
    at = next((k for k in order if sure_cut(text[k - 1], text[k])), None)
    if at is None:
        return None if not whole else (0, 0) if last else (len(ids), len(text))
    sizes = np.cumsum([0, *[len(code.pieces[t]) for t in ids[start:]]])
    return start + int(np.searchsorted(sizes, len(text[:at].encode()))), at


def encode_tree(code: Codec, text: str, leaf: int = LEAF) -> np.ndarray:
    """Ids of a text by halving it down to leaves and joining them again."""
    if len(text) <= leaf:
        return code.encode(text)
    half = len(text) // 2
    return concatenate(code, encode_tree(code, text[:half], leaf), encode_tree(code, text[half:], leaf))


def join_leaves(code: Codec, parts: list[np.ndarray]) -> np.ndarray:
    """Joins neighbours pairwise, level by level."""
    while len(parts) > 1:
        parts = [concatenate(code, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else np.zeros(0, "<u4")


class _Halve:
    """Cuts texts into a power of two of equal parts, the ends of repeated halving."""

    def __init__(self, leaf: int):
        self.leaf = leaf

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row"), batch.column("text")):
                text, n = text.as_py(), 1
                while len(text) > n * self.leaf:
                    n *= 2
                at = [len(text) * k // n for k in range(n + 1)]
                parts = [text[a:b] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * n), pa.array(range(n), pa.int32()), pa.array(parts)], ["_row", "_at", "_part"])


def encoded(docs: DataFrame, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """The columns of `docs` with `ids`, the token ids as little-endian unsigned 32-bit integers.

    Texts of up to `leaf` code points are encoded where they are read. Longer ones are cut in halves down to leaves,
    which Spark deals over all tasks; the leaves of a text meet again in one row and are joined as a tree. Null texts
    count as empty and have no ids. Repeated rows are encoded each; an empty table gives an empty one; a column `ids`
    is replaced and other columns pass through.
    """
    spark = docs.sparkSession
    encode = _text_encoder(path)
    base = docs.drop("ids")
    short = base.where(F.coalesce(F.length("text"), F.lit(0)) <= leaf).withColumn("ids", encode(text_of()))
    long = store(base.where(F.length("text") > leaf).withColumn("_row", F.expr("uuid()")), "long")
    leaves = long.select("_row", "text").mapInArrow(_Halve(leaf), "_row string, _at int, _part string")
    done = leaves.repartition("_row", "_at").select("_row", "_at", encode(F.col("_part")).alias("ids"))
    joined = done.groupBy("_row").applyInPandas(_join(path), "_row string, ids binary")
    whole = long.join(joined, "_row").select(*base.columns, "ids")
    return short.select(*base.columns, "ids").unionByName(whole)


def _join(path: str):
    def call(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u4") for x in rows.sort_values("_at")["ids"]]
        return pd.DataFrame({"_row": rows["_row"].iloc[:1], "ids": [join_leaves(codec(path), parts).tobytes()]})
    return call


def _text_encoder(path: str):
    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        code = codec(path)
        return pa.array([code.encode(t.as_py()).tobytes() for t in texts], pa.binary())

    return encode


def decoder(path: str = VOCABULARY):
    """Column function: the text of token ids (binary); bytes that are no UTF-8 become replacement characters."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        code = codec(path)
        return pa.array([code.decode(np.frombuffer(t.as_py(), "<u4")) for t in ids], pa.string())

    return decode


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(decoder()(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their token ids, as an array of longs, and the number of tokens."""
    @F.arrow_udf("array<int>")
    def numbers(ids: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(t.as_py(), "<i4") for t in ids], pa.list_(pa.int32()))

    coded = encoded(docs)
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("tokens", numbers(F.col("ids"))).drop("ids")
