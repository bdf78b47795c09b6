import collections
import random

import numpy as np
import pytest

from hitsieve.llm import suffixes


def test_two_stage_order_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 50, 1500):
        for letters in (1, 2, 4, 200):
            data = rng.integers(0, letters, n).astype(np.uint8)
            raw, order = bytes(data), suffixes.suffix_order(data, 20)
            assert sorted(order.tolist()) == list(range(n))
            assert [raw[i:i + 20] for i in order] == sorted(raw[i:i + 20] for i in range(n))
            for a, b, size in zip(order, order[1:], suffixes.common_prefix(data, order[:-1], order[1:], 20) if n > 1 else []):
                same = next((k for k in range(20) if raw[a + k:a + k + 1] != raw[b + k:b + k + 1] or a + k >= n or b + k >= n), 20)
                assert size == same


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 500).astype(np.uint64)
    for width in (1, 7, 337, 500):
        assert suffixes.sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(500 - width + 1)]


def plain(rows, length=400):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("group,share", [(1024, 8192), (3, 8192), (1, 2)])
def test_against_plain_version(spark, group, share, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "SHARE", share)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, border = prose(160), prose(90)
    rows = [(i, prose(rng.randint(0, 200))) for i in range(25)]
    rows += [(100 + i, prose(rng.randint(0, 90)) + passage + prose(rng.randint(0, 90))) for i in range(12)]
    rows += [(200 + i, border[:rng.randint(380, 500)] + prose(60)) for i in range(6)]
    rows += [(300, "ab " * 700), (301, "x" * 399), (302, "x" * 400), (303, "x" * 401), (304, passage * 3), (305, None), (306, ""), rows[2], (None, rows[3][1])]
    long = prose(120)
    rows += [(400 + i, long[:300] + word() + long[300:]) for i in range(5)] + [(500, long), (501, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = suffixes.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == plain(rows)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_segments_cover_every_start_once(monkeypatch):
    data = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    whole = list(suffixes.segments(data))
    monkeypatch.setattr(suffixes, "PART", 333)
    for found in (whole, list(suffixes.segments(data))):
        starts = np.concatenate([np.arange(a, b + 1) for begin, last, *_ in found for a, b in zip(begin, last)])
        assert starts.tolist() == list(range(len(data) - 399))
