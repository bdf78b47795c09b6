"""Token counts under a unigram model: distinct pre-tokens share the forward scores of their common prefixes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from hitsieve.llm.common import table, text_of
from hitsieve.llm.wordhash import BASE, mix, powers

PIECES = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"  # stands before every pre-token
IN_TRIE = 64  # code points of a pre-token that goes into the trie; longer ones are scored alone, with equal results
KEPT = 400_000  # pre-tokens whose counts a worker remembers
CHUNK = 8 << 20


class Unigram:
    """Log probabilities of the pieces of a vocabulary file: by Zipf's law over their ranks.

    A character that is no piece costs as much as the rarest piece and ten more, and counts as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        real = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        rank = {model.id_to_piece(i): max(0.0, -model.get_score(i)) for i in real}
        level = np.log(np.log(len(rank)) + 0.5772)
        self.score = {piece: float(-np.log(1.0 + r) - level) for piece, r in rank.items()}
        self.unknown = min(self.score.values()) - 10.0
        self.longest = max(map(len, self.score))
        hashes = np.array([int(_spans(_codes([p])[0], 0, len(p))[0]) for p in self.score], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(self.score.values()))[order]
        self.present = np.zeros(1 << 20, bool)
        self.present[self.hashes >> np.uint64(44)] = True


_UP, _DOWN = powers(BASE, IN_TRIE + 20), powers(pow(BASE, -1, 1 << 64), IN_TRIE + 20)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as rows, 0 after their ends, and their lengths."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.zeros((len(words), max(1, size.max())), np.uint32)
    rows[np.arange(rows.shape[1]) < size[:, None]] = flat
    return rows, size


def _sums(codes: np.ndarray) -> np.ndarray:
    total = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(77)) * _UP[:codes.shape[1]], axis=1, out=total[:, 1:])
    return total


def _spans(codes: np.ndarray, start: int, end: int) -> np.ndarray:
    total = _sums(codes[None, :] if codes.ndim == 1 else codes)
    return mix((total[:, end] - total[:, start]) * _DOWN[start] + np.uint64(end - start))


def trie_counts(model: Unigram, words: list[str]) -> np.ndarray:
    """Tokens of the best segmentation of each of the sorted distinct words (each with START in front).

    Sorted words are a trie in preorder: the node of a prefix is the first word that has it. Going down by depth, each
    node looks at the pieces that end there and at the scores of its ancestors, once for all words below; the count at
    a word's last node is its answer. Equal scores take fewer tokens.
    """
    codes, size = _codes(words)
    n, deep = codes.shape
    total = _sums(codes)
    differ = codes[1:] != codes[:-1]
    shared = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), deep)))
    best, count = np.zeros((n, deep + 1)), np.zeros((n, deep + 1), np.int32)
    at = np.arange(n)
    node = [np.zeros(n, np.int64)]  # the word that holds the scores of each word's prefix of this length
    for d in range(1, deep + 1):
        own = (shared < d) & (size >= d)
        node.append(np.maximum.accumulate(np.where(own, at, 0)))
        rows = np.flatnonzero(own)
        top, tokens = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int32)
        for length in range(1, min(d, model.longest) + 1):
            h = mix((total[rows, d] - total[rows, d - length]) * _DOWN[d - length] + np.uint64(length))
            maybe = np.flatnonzero(model.present[h >> np.uint64(44)])
            spot = np.minimum(np.searchsorted(model.hashes, h[maybe]), len(model.hashes) - 1)
            hit = model.hashes[spot] == h[maybe]
            maybe, spot = maybe[hit], spot[hit]
            back = node[d - length][rows[maybe]]
            _better(top, tokens, maybe, best[back, d - length] + model.scores[spot], count[back, d - length] + 1)
            if length == 1:
                alone = np.ones(len(rows), bool)
                alone[maybe] = False
                odd = np.flatnonzero(alone)
                back = node[d - 1][rows[odd]]
                point = codes[rows[odd], d - 1]
                width = 1 + (point > 0x7F).astype(np.int32) + (point > 0x7FF) + (point > 0xFFFF)
                _better(top, tokens, odd, best[back, d - 1] + model.unknown, count[back, d - 1] + width)
        best[rows, d], count[rows, d] = top, tokens
    return count[at, size]


def _better(top: np.ndarray, tokens: np.ndarray, at: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
    wins = (score > top[at]) | ((score == top[at]) & (number < tokens[at]))
    top[at[wins]], tokens[at[wins]] = score[wins], number[wins]


def plain_count(model: Unigram, word: str) -> int:
    """The same for one word of any length, keeping only the scores that pieces can reach back to."""
    held: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=model.longest)
    for d in range(1, len(word) + 1):
        found: list[tuple[float, int]] = []
        for length in range(1, min(d, model.longest) + 1):
            value = model.score.get(word[d - length:d])
            if value is not None:
                found.append((held[-length][0] + value, -(held[-length][1] + 1)))
            elif length == 1:
                found.append((held[-1][0] + model.unknown, -(held[-1][1] + len(word[d - 1].encode()))))
        score, number = max(found)
        held.append((score, -number))
    return held[-1][1]


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


_KEPT: dict[str, dict[bytes, int]] = {}


def token_counts(path: str, texts: list[bytes]) -> list[tuple[int, int]]:
    """(pre-tokens, tokens) of each text; new distinct pre-tokens of all the texts share one trie."""
    model, kept = unigram(path), _KEPT.setdefault(path, {})
    words = [t.split() for t in texts]  # at ASCII blanks
    if len(kept) > KEPT:
        kept.clear()
    new = set().union(*words).difference(kept) if words else set()
    shorter = sorted(START + w.decode() for w in new if len(w) < IN_TRIE)
    for at in range(0, len(shorter), 1 << 15):
        part = shorter[at:at + (1 << 15)]
        kept.update(zip((w[1:].encode() for w in part), trie_counts(model, part).tolist()))
    longer = {w: plain_count(model, START + w.decode()) for w in new if len(w) >= IN_TRIE}
    count = (kept | longer if longer else kept).__getitem__
    return [(len(w), sum(map(count, w))) for w in words]


class _Count:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * CHUNK / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = token_counts(self.path, [t.as_py().encode() for t in part.column("_text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]],
                                                 ["doc_id", "n_words", "n_tokens"])


def count_tokens(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of `docs(doc_id, text)`, without a shuffle.

    Pre-tokens are split at ASCII blanks; null and empty texts have none. Rows with a null doc_id and repeated rows are
    counted each; an empty table gives an empty one.
    """
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long"
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(_Count(path), kind)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
