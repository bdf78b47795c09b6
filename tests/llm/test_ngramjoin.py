import random

import numpy as np
import pytest

from hitsieve.llm import ngramjoin
from hitsieve.llm.wordhash import windows, word_hashes


def plain(rows):
    """doc_id -> (class, links, copies) by comparing all pairs of sets of word runs."""
    sets = []
    for i, text in rows:
        w = (text or "").split()
        sets.append((-1 if i is None else i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    links, copies, parent = [0] * len(sets), [1] * len(sets), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x is not None and y is not None and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                if x == y:
                    copies[a] += 1
                    copies[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(i, low.get(root(k), i))
    return sorted((sets[k][0], low[root(k)], links[k], copies[k]) for k in range(len(sets)))


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10 ** 6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randint(5, 200))) for _ in range(60)]
    for base in texts[:12]:
        texts += [near(rng, base.split(), rng.randint(0, 4)) for _ in range(rng.randint(1, 6))]
    hot = [f"h{k}" for k in range(150)]
    texts += [near(rng, hot, rng.randint(0, 6)) for _ in range(90)]
    shared = " ".join(f"p{k}" for k in range(60))
    texts += [shared + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(200)) for _ in range(40)]
    texts += [None, "", "  \n ", "one two", "one two", "one  two", "a b c d", "a b c d e", "a b c d e", "z " * 3000, "z " * 50, texts[0], texts[0]]
    return list(enumerate(texts)) + [(None, texts[1])]


@pytest.mark.parametrize("block", [256, 8])
def test_against_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rep int, signs string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngramjoin.jaccard_join(docs).collect())
    assert got == plain(rows)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngramjoin.jaccard_join(docs).collect())
    assert got == [(5, 5, 1, True), (5, 5, 1, True), (6, 6, 0, True)]
    assert ngramjoin.jaccard_join(docs.limit(0)).count() == 0


def test_one_id_with_two_texts_does_not_crash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r.class_id for r in ngramjoin.jaccard_join(docs).collect()} == {1}


def test_minhash_follows_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    errors = []
    for k in range(60):
        a, b = x[:500], np.concatenate([x[5 * k:500], x[500:500 + 5 * k]])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((ngramjoin.signature(np.unique(a)) == ngramjoin.signature(np.unique(b))).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_pruning_bound_is_the_posterior():
    rng = np.random.default_rng(3)
    for seen in (32, 96, 160):
        m = ngramjoin.least_matches(seen)
        assert 0 < m < 0.8 * seen
        draws = rng.beta(m + 1, seen - m + 1, 200_000)
        assert (draws >= 0.8).mean() < 1e-4  # far below what sampling can see; the bound itself is 1e-9


def test_word_hashes_do_not_depend_on_place():
    text = "alpha beta alpha beta alpha beta".encode()
    h = word_hashes(text)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    w = windows(h, 2)
    assert w[0] == w[2] == w[4] and w[1] == w[3] != w[0]


def odd_ids():
    """Different texts under one id and under null ids, an empty one among them, each with near copies elsewhere."""
    rng = random.Random(5)
    base = [" ".join(f"u{k}_{i}" for i in range(80)) for k in range(6)]
    rows = [(None, base[0]), (None, base[1]), (None, ""), (None, base[1]), (7, base[2]), (7, base[3]), (7, None), (7, base[4])]
    return rows + [(10 + k, near(rng, t.split(), 1)) for k, t in enumerate(base)] + [(3, base[5]), (3, base[4])]


def test_rows_of_one_id_keep_their_links(spark):
    rows = odd_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngramjoin.jaccard_join(docs).collect())
    assert got == plain(rows)


def test_stage_keeps_one_row_of_each_group(spark):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(odd_ids())], "doc_id long, text string, place long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:3]) for r in ngramjoin.drop_near_copies(spark, docs, "").collect())
    assert got == [(-1, ""), (-1, "u0_"), (-1, "u1_"), (3, "u4_"), (3, "u5_"), (7, ""), (7, "u2_"), (7, "u3_")]
