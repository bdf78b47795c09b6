"""SentencePiece BPE by a prefix table: each prefix of a text has one last token, and the ids are read off backwards."""

from __future__ import annotations

import re
from array import array
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitsieve.llm.common import table, text_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"  # fixed value: how the model writes a space
UNKNOWN = " ⁇ "  # fixed value: the text of the unknown id
SHORT = 32  # code points of a stretch whose ids are remembered
SLICE = 1 << 19  # code points of the texts whose new stretches are worked out together
TOGETHER = 1 << 14  # such stretches, at most
TABLE = 18  # bits of the place of a tested pair
BETWEEN = "\ue000"  # stands between stretches; a model whose pieces hold it is refused
IDS = 1 << 20  # ids that are decoded in one step, or those of one longer text
WORDS, PAIRS = 1 << 17, 1 << 18  # remembered stretches and tested pairs of a Python worker; beyond them it starts anew


class Sparse:
    """Numbers below 2^20 at some places of a wide matrix: each at one of two spots of a hash table, so that many are asked at once."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        keys, many = row << 16 | column, len(row)
        self.bits = max(8, (4 * many).bit_length() - 1)  # a quarter to half of the table is used
        held, second, homeless = np.full(1 << self.bits, -1, np.int64), np.ones(many, bool), np.arange(many)
        for _ in range(500):
            if not len(homeless):
                break
            # who has no spot takes its other one; who stood there goes on to its own other one
            second[homeless] ^= True
            spot = np.where(second[homeless], *self._spots(keys[homeless])[::-1])
            before = held[spot]
            held[spot] = homeless
            homeless = np.unique(np.concatenate((homeless[held[spot] != homeless], before[before >= 0])))
        if len(homeless):
            raise ValueError("numbers found no place in the table")
        self.words = np.where(held < 0, -1, keys[held] << 20 | value[held]) if many else held

    def _spots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide, shift = keys.astype(np.uint64), np.uint64(64 - self.bits)
        return tuple(((wide * np.uint64(m)) >> shift).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    def at(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The numbers at these places, -1 where there is none."""
        keys = row.astype(np.int64) << 16 | column
        one, two = (self.words[s] for s in self._spots(keys))
        word = np.where(one >> 20 == keys, one, two)
        return np.where(word >> 20 == keys, word & 0xFFFFF, -1).astype(np.int32)


class Pieces:
    """Vocabulary of a merge-type model, its automaton, and the tests of neighbouring tokens.

    Only models that take texts as they are (no normalization but the space sign in front) and spell unknown letters in
    bytes are accepted.
    """

    def __init__(self, path: str, words: int = WORDS):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        if model.normalize("ﬁ  é ") != f"{SPACE}ﬁ{SPACE * 2}é{SPACE}":
            raise ValueError("the model changes texts before it splits them")
        self.end = model.eos_id()
        self.names = [model.id_to_piece(i) for i in every]
        self.byte_ids = [i for i in every if model.is_byte(i)]
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no bytes for unknown letters")
        if len(self.names) > 1 << 16:
            raise ValueError("the model has more than 65,536 pieces")
        self.silent = np.array([i for i in every if model.is_control(i)], np.int64)
        normal = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.names[i]: model.get_score(i) for i in normal}
        self.number = {self.names[i]: i for i in normal}
        self.raw = [b"" if model.is_control(i) else self.names[i].replace(SPACE, " ").encode() for i in every]
        self.raw[model.unk_id()] = UNKNOWN.encode()
        for byte, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([byte])
        if any(BETWEEN in piece for piece in self.number):
            raise ValueError("pieces hold the sign between stretches")
        self.opens = np.array([name.startswith(SPACE) for name in self.names])
        self.shown = pa.array([*self.raw, *(r[1:] if o else r for r, o in zip(self.raw, self.opens))], pa.binary())
        self.shown_sizes = np.array([len(r) for r in self.shown.to_pylist()], np.int64)
        self.doubtful = np.zeros(len(self.names), bool)
        self.doubtful[[*self.silent, *self.byte_ids[128:]]] = True
        self.size = [len(name) for name in self.names]
        self.sizes = np.array(self.size, np.int64)
        self.tested = np.full(1 << TABLE, 1 << 62, np.int64)  # a pair's key, and whether it fits as the lowest bit
        self.matches = ahocorasick.Automaton()
        for piece, i in self.number.items():
            self.matches.add_word(piece, i)
        self.matches.make_automaton()
        inside = {c for piece in self.number if len(piece) > 1 for c in piece}
        # no token reaches over a space sign that follows a letter, or over a sign that stands in no longer piece
        alone = "".join(c for c in map(chr, range(128)) if c not in inside)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.number):
            raise ValueError("pieces hold spaces after letters")
        self.stretches = re.compile(f"[{re.escape(alone)}]|{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        self.grown: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.known = _Known(self, words)
        self._spines()
        self._trie()

    def _spines(self) -> None:
        """For every token its last merge's place in the order of merges and the two parts; the ranks of all merges of two parts.

        A token that its letters never become has no rank here. One whose merges do not come in the order of their scores
        is odd: its pairs are tested step by step.
        """
        number, names = dict(self.number), self.names
        for letter in sorted(set(chain.from_iterable(self.number)) - set(self.number)):  # letters that are no pieces merge as well
            number[letter] = len(names) + len(number) - len(self.number)
        if (most := max(number.values(), default=0) + 1) > 1 << 16:
            raise ValueError("pieces and letters must fit in 16 bits")
        order = {mark: k for k, mark in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank, self.odd, self.lost = np.full(most, -1, np.int32), np.zeros(most, bool), np.zeros(most, bool)
        self.front, self.back = np.arange(most, dtype=np.int32), np.arange(most, dtype=np.int32)
        left, right, rank = [], [], []
        for piece, i in self.number.items():
            if len(piece) == 1:
                continue
            mine = order[self.score[piece]]
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(mine)
            grown = self.steps(i)
            if grown is None:
                self.lost[i] = True
            else:
                marks, firsts, lasts = grown
                self.rank[i], self.front[i], self.back[i] = mine, number[firsts[-2]], number[lasts[-2]]
                self.odd[i] = any(a < b for a, b in zip(marks, marks[1:]))
        self.grown.clear()
        self.borders = Sparse(*(np.array(x, np.int64) for x in (left, right, rank)))

    def _trie(self) -> None:
        """The pieces that letters become, as a trie over the letters that stand in pieces; node 0 is the root."""
        seen = Counter(chain.from_iterable(self.number))
        column = {letter: k for k, (letter, _) in enumerate(seen.most_common(), 1)}
        self.letter = np.zeros(0x110000, np.uint16)
        for letter, k in column.items():
            self.letter[ord(letter)] = k
        nodes, edges, ends = {"": 0}, [], [-1]
        for piece, i in self.number.items():
            if self.lost[i]:
                continue
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    edges.append((nodes[piece[:k - 1]], column[piece[k - 1]], nodes[piece[:k]]))
                    ends.append(-1)
            ends[nodes[piece]] = i
        self.ends = np.array(ends, np.int32)
        self.edges = Sparse(*np.array(edges, np.int64).reshape(-1, 3).T)

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and token of every piece in a text: from all places at once, a letter further at each step."""
        letters = self.letter[np.frombuffer((text + BETWEEN).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
        at = np.flatnonzero(letters).astype(np.int32)
        begin, node, out = at, np.zeros(len(at), np.int32), []
        while len(at):
            node = self.edges.at(node, letters[at])
            live = np.flatnonzero(node >= 0)
            at, begin, node = at[live] + 1, begin[live], node[live]
            piece = self.ends[node]
            whole = np.flatnonzero(piece >= 0)
            out.append((begin[whole], at[whole], piece[whole]))
        return tuple(np.concatenate([o[k] for o in out] or [np.zeros(0, np.int32)]) for k in range(3))

    def steps(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a token grows from its letters: score of each merge, and the first and last part before each and at the end.

        The best-scored neighbours merge first, the leftmost of equal ones. None for a token that its letters never become.
        """
        if token not in self.grown:
            parts, score = list(self.names[token]), self.score
            marks, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
                marks.append(best[0])
                firsts.append(parts[0])
                lasts.append(parts[-1])
            self.grown[token] = (marks, firsts, lasts) if len(parts) == 1 else None
        return self.grown[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' joined letters is these two tokens; -1 stands for no token on the left.

        Both grow by their own merges, the better-scored next one first, unless the parts that meet at the border make a
        merge that comes before both.
        """
        after = self.steps(right)
        if left < 0 or after is None:
            return after is not None
        before, score = self.steps(left), self.score
        if before is None:
            return False
        (marks_a, _, lasts), (marks_b, firsts, _) = before, after
        i = j = 0
        while True:
            a = marks_a[i] if i < len(marks_a) else None
            b = marks_b[j] if j < len(marks_b) else None
            border = score.get(lasts[i] + firsts[j])
            if border is not None and (a is None or border > a) and (b is None or border >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a >= b:
                i += 1
            else:
                j += 1

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch: last token of every prefix from the left, then the ids from the right.

        A piece that ends at a place is the prefix's last token if it fits to the last token of what stands before it; a
        sequence is an encoding when all its neighbours fit, so exactly one piece does. Letters without a piece have
        none that ends there; they are spelled in bytes and never merge.
        """
        last, pairs, size = [-1] * (len(text) + 1), self.pairs, self.size
        if len(pairs) > PAIRS:
            pairs.clear()
        for at, piece in self.matches.iter(text):
            at += 1
            if last[at] < 0:
                left = last[at - size[piece]]
                key = left << 16 | piece
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.fits(left, piece)
                if fits:
                    last[at] = piece
        out, at = [], len(text)
        while at:
            piece = last[at]
            if piece < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                out.append(piece)
                at -= size[piece]
        out.reverse()
        return array("I", out).tobytes()

    def stretches_of(self, texts: list[str]) -> list[bytes]:
        """The same for many short stretches at once: their tables are filled side by side, one place of all at a time.

        The stretches are read as one text with a sign between them that stands in no piece.
        """
        lengths = np.array([len(t) for t in texts])
        begin = np.concatenate(([0], np.cumsum(lengths[:-1] + 1))).astype(np.int64)
        before, end, piece = self.found(BETWEEN.join(texts))
        place = (end - np.repeat(begin, lengths + 1)[before]).astype(np.int16)
        order = np.argsort(place, kind="stable")
        end, piece, before = end[order], piece[order], before[order]
        steps = np.searchsorted(place[order], np.arange(1, int(lengths.max()) + 2))
        last = np.full(int(lengths.sum()) + len(texts) + 1, -1, np.int32)
        for low, high in zip(steps, steps[1:]):
            fits = self._known_pairs(last[before[low:high]], piece[low:high])
            last[end[low:high][fits]] = piece[low:high][fits]
        # backwards from the ends, all stretches at once
        ids, count, at = np.zeros((len(texts), int(lengths.max())), "<u4"), np.zeros(len(texts), np.int64), begin + lengths
        spelled, live = np.zeros(len(texts), bool), np.flatnonzero(lengths > 0)
        while len(live):
            here = last[at[live]]
            unknown = here < 0
            if unknown.any():
                spelled[live[unknown]] = True
                live, here = live[~unknown], here[~unknown]
            count[live] += 1
            ids[live, -count[live]] = here
            at[live] -= self.sizes[here]
            live = live[at[live] > begin[live]]
        raw, width = ids.tobytes(), 4 * ids.shape[1]
        ends, sizes = (np.arange(1, len(texts) + 1) * width).tolist(), (4 * count).tolist()
        return [self.stretch(t) if alone else raw[e - n:e] for t, e, n, alone in zip(texts, ends, sizes, spelled.tolist())]

    def _known_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens fit, each pair; a table by hash answers for pairs tested before."""
        keys = left.astype(np.int64) << 16 | right
        spot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)).astype(np.int64)
        held = self.tested[spot]
        out, missed = (held & 1).astype(bool), np.flatnonzero(held >> 1 != keys)
        if len(missed):
            out[missed] = answer = self.fit_all(left[missed], right[missed])
            self.tested[spot[missed]] = keys[missed] << 1 | answer
        return out

    def fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fits` for many pairs: back from the two tokens, the merge that came last is undone first.

        The two parts at the border must never have had a merge that comes before the one that ended their meeting. A merge
        inside a token that leaves the part at the border as it is comes before the one that changes it and decides nothing.
        """
        out = (left < 0) | ~self.odd[left] & ~self.odd[right]
        for k in np.flatnonzero(~out):
            out[k] = self.fits(int(left[k]), int(right[k]))
        live = np.flatnonzero((left >= 0) & ~self.odd[left] & ~self.odd[right])
        a, b = left[live], right[live]
        limit = np.full(len(live), 1 << 30, np.int32)
        while len(live):
            border = self.borders.at(a, b)
            clash = (border >= 0) & (border < limit)
            out[live[clash]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            going = np.flatnonzero(~clash & (np.maximum(rank_a, rank_b) >= 0))
            live, a, b, rank_a, rank_b = live[going], a[going], b[going], rank_a[going], rank_b[going]
            later = rank_a > rank_b
            limit = np.where(later, rank_a, rank_b + 1)
            a, b = np.where(later, self.back[a], a), np.where(later, b, self.front[b])
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without an end id. Stretches that are not known yet are worked out together."""
        parts = [self.stretches.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        at = np.cumsum([0, *map(len, parts)]).tolist()
        ids = self.known.ids(list(chain.from_iterable(parts)))
        return [np.frombuffer(b"".join(ids[x:y]), "<u4") for x, y in zip(at, at[1:])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the space sign in front goes, control ids are silent, each byte that is no UTF-8 becomes a replacement sign."""
        shown = ids[~np.isin(ids, self.silent)]
        front = len(shown) and self.names[shown[0]].startswith(SPACE)
        inside = len(shown) and not np.array_equal(shown, ids[:len(shown)])
        raw = b"".join(map(self.raw.__getitem__, shown.tolist()))
        try:
            text = raw.decode() if not inside else self._run_by_run(ids)
        except UnicodeDecodeError:
            text = self._run_by_run(ids)
        return text[1:] if front else text

    def decode_many(self, flat: np.ndarray, at: np.ndarray) -> pa.Array:
        """`decode` for the runs of ids between places. Runs with spelled bytes beyond ASCII, or control ids before the end, go one by one."""
        out = []
        cuts = [0, *(np.flatnonzero(np.diff(at[1:] // IDS)) + 1).tolist(), len(at) - 1]
        for low, high in zip(cuts, cuts[1:]):
            own = at[low:high + 1] - at[low]
            ids = flat[at[low]:at[high]].astype(np.int64)
            some = np.flatnonzero(np.diff(own))
            first, last = own[some], own[some + 1] - 1
            doubt = np.concatenate(([0], np.cumsum(self.doubtful[ids])))
            alone = some[doubt[own[some + 1]] - doubt[own[some]] > np.isin(ids[last], self.silent)]
            bare = first[self.opens[ids[first]]]
            runs = {k: ids[own[k]:own[k + 1]].copy() for k in alone.tolist()}
            ids[bare] += len(self.raw)  # the same piece without its space sign
            raw = self.shown.take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")
            ends = np.concatenate(([0], np.cumsum(self.shown_sizes[ids])))[own].astype(np.int32)
            whole = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer(ends), raw])
            if runs:
                mask = np.zeros(len(whole), bool)
                mask[alone] = True
                whole = pc.replace_with_mask(whole, pa.array(mask), pa.array([self.decode(r).encode() for r in runs.values()], pa.binary()))
            out.append(whole.cast(pa.string()))
        return pa.concat_arrays(out)

    def _run_by_run(self, ids: np.ndarray) -> str:
        """Spelled bytes are read together as far as no other id stands between them."""
        out, held, spelled = [], bytearray(), set(self.byte_ids)
        for i in [*ids.tolist(), None]:
            if i in spelled:
                held += self.raw[i]
                continue
            out.append(_letters(held))
            held.clear()
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)


def _letters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("\ufffd")
        at += n
    return "".join(out)


class _Known:
    """Ids of the stretches met lately. When they are too many, those not met since the last time go."""

    def __init__(self, pieces: Pieces, words: int):
        self.pieces, self.words, self.held, self.older = pieces, words, {}, {}

    def ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of all these stretches; those of long ones are not kept, so that the memory stays bounded."""
        if len(self.held) > self.words:
            self.held, self.older = {}, self.held
        held, older = self.held, self.older
        out = list(map(held.get, stretches))
        missed = [k for k, ids in enumerate(out) if ids is None]
        long, new = {}, []
        for text in {stretches[k] for k in missed}:
            if text in older:
                held[text] = older[text]
            elif len(text) <= SHORT:
                new.append(text)
            else:
                long[text] = self.pieces.stretch(text)
        for low in range(0, len(new), TOGETHER):
            some = new[low:low + TOGETHER]
            held.update(zip(some, self.pieces.stretches_of(some)))
        known = ChainMap(long, held) if long else held
        for k in missed:
            out[k] = known[stretches[k]]
        return out


@lru_cache(maxsize=2)
def pieces(path: str = MODEL, words: int = WORDS) -> Pieces:
    return Pieces(path, words)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """An Arrow array of integer lists over the parts."""
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))


def slices(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """Runs of texts of about `size` code points; a longer text is one of its own."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text or "")
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _ids(code: Pieces, texts: pa.Array, end: bool) -> pa.ListArray:
    tail = np.array([code.end] if end else [], "<u4")
    found = chain.from_iterable(map(code.encode_many, slices(texts.to_pylist(), SLICE)))
    return lists([np.concatenate([ids, tail]) for ids in found])


def _texts(code: Pieces, ids: pa.ListArray) -> pa.Array:
    return code.decode_many(ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy())


def encoder(path: str = MODEL, end: bool = True):
    """Column function: ids of whole texts as an array of integers, with the end id last where it is asked for."""
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _ids(pieces(path), texts, end)

    return encode


def round_trip(path: str = MODEL, end: bool = True):
    """Column function: `ids` of whole texts and the text `decoded` from them.

    Both are made in one call: a decoder called on the encoder's column makes Spark encode every text once for the ids and
    once more for the decoder.
    """
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encode_decode(texts: pa.Array) -> pa.Array:
        ids = _ids(pieces(path), texts, end)
        return pa.StructArray.from_arrays([ids, _texts(pieces(path), ids)], ["ids", "decoded"])

    return encode_decode


def decoder(path: str = MODEL):
    """Column function: the text of an array of ids."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return _texts(pieces(path), ids)

    return decode


def encoded(docs: DataFrame, path: str = MODEL, end: bool = True) -> DataFrame:
    """The columns of `docs` with `ids`, the token ids of the whole text.

    Every text is encoded where it is read, without a shuffle: a text of any length takes time and memory in proportion
    to it, because every prefix is settled once. Null texts count as empty and have the end id alone. Repeated rows are
    encoded each; an empty table gives an empty one; a column `ids` is replaced and other columns pass through.
    """
    return docs.drop("ids").withColumn("ids", encoder(path, end)(text_of()))


def round_tripped(docs: DataFrame, path: str = MODEL, end: bool = True) -> DataFrame:
    """`encoded` with a further column `decoded`, the text that the ids stand for; a column of this name is replaced."""
    both = docs.drop("ids", "decoded").withColumn("ids", round_trip(path, end)(text_of()))
    return both.withColumns({"ids": F.col("ids.ids"), "decoded": F.col("ids.decoded")})


def op13_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_tripped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
