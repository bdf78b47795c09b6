"""64-bit hashes of the words of a text, for all words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 21  # bytes hashed at once, so that memory stays bounded for very long texts
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
UNIT = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out[:n]


class Powers:
    """Powers of an odd base and of its inverse, kept for texts up to the largest seen piece."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = powers(1, 1)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, min(2 * len(self.up), PIECE))
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)


_POWERS = Powers(BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """The text in parts of about PIECE bytes that end at a blank; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            blanks = np.flatnonzero(IS_BLANK[data[at:end]])
            while not len(blanks) and end < len(data):
                blanks = np.flatnonzero(IS_BLANK[data[end:end + PIECE]]) + (end - at)
                end += PIECE
            end = at + int(blanks[-1]) + 1 if len(blanks) else len(data)
        yield data[at:end]
        at = end


def bounds(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a piece, in bytes."""
    word = np.zeros(len(piece) + 2, np.int8)
    word[1:-1] = ~IS_BLANK[piece]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of piece[start:end] for each span; equal bytes give equal hashes wherever they stand."""
    _POWERS.reach(len(piece) + 1)
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(BYTE[piece] * _POWERS.up[:len(piece)], out=total[1:])
    return mix((total[ends] - total[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    found = [span_hashes(p, *bounds(p)) for p in pieces(np.frombuffer(data, np.uint8))]
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint64)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; a shorter text has one run of all its words, an empty one none."""
    if not len(words):
        return words
    k = min(n, len(words))
    count = len(words) - k + 1
    total = np.zeros(count, np.uint64)
    for i in range(k):
        total = (total + words[i:i + count]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(total)
