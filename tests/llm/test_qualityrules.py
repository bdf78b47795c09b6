import random
import re

import numpy as np
import pytest

from hitsieve.llm import qualityrules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    runs = {}
    for k in range(len(words) - 4):
        runs.setdefault(tuple(words[k:k + 5]), []).append(k)
    covered = {k + i for at in runs.values() if len(at) > 1 for k in at for i in range(5)}
    lines = text.split("\n")
    again = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def texts():
    rng = random.Random(8)
    some = ["", " ", "\n\n", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\nx\n x\n\n\nx", "é 漢 # $% 😀\x85   b", "a b c d e f a b c d g a b c d e f"]
    some += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))).replace("c a", "c\na") for _ in range(60)]
    return some + ["word " * 9 + "| <x>\n" * 4, "z" * 5000]


def test_base_counts():
    for text in texts():
        assert Q.describe(text)[:5] == plain(text)


def test_long_texts_in_pieces(monkeypatch):
    from hitsieve.llm import wordhash
    monkeypatch.setattr(wordhash, "PIECE", 16)
    test_base_counts()


def test_divergence():
    p, q = np.array([1.0, 0, 3]), np.array([2.0, 2, 0])
    assert Q.divergence(p, p) == pytest.approx(0) and Q.divergence(np.array([1.0, 0]), np.array([0.0, 5])) == pytest.approx(1)
    assert Q.divergence(p, q) == pytest.approx(Q.divergence(q, p)) and Q.divergence(p * 0, q) == 0


def test_divergence_of_many_rows():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (50, 6)).astype(float), rng.integers(0, 4, (50, 6)).astype(float)
    a[3], b[4] = 0, 0

    def one(p, q):
        if not p.sum() or not q.sum():
            return 0.0
        p, q = p / p.sum(), q / q.sum()
        return sum(x * np.log2(x / ((x + y) / 2)) for v, w in ((p, q), (q, p)) for x, y in zip(v, w) if x) / 2

    assert Q.divergence(a, b) == pytest.approx(np.array([one(p, q) for p, q in zip(a, b)]))


def test_word_bound_falls_with_length(spark):
    """Words in wrong shares pass as a short text and fail as a long one."""
    rng = random.Random(4)
    prose = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    common = Q.COMMON["en"].split()
    filler = ["house", "river", "walking", "light", "stone", "green", "letter"]
    rows = [(i, prose(400, common + filler), "en") for i in range(60)] + [(100, prose(2000, common[:30] + filler * 6), "en")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert Q.MAX_WORD_JS + Q.WORD_NOISE / 2000 < got[100].word_js < Q.MAX_WORD_JS + Q.WORD_NOISE / 50
    assert not got[100].kept and got[100].char_js < Q.MAX_CHAR_JS


def test_verdicts(spark):
    rng = random.Random(3)
    words = Q.COMMON["en"].split() + ["house", "river", "walking", "light", "stone", "green", "letter"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 300)), "en") for i in range(60)]
    rows += [(100, " ".join(w + "###" for w in prose(120).split()), "en"), (101, prose(120).upper(), "en"), (102, "short but fine words stand here to be read now ok", None),
             (103, None, "en"), (104, "", None), (105, "again and again we go " * 30, "en"), (106, prose(200), None), rows[0]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert all(got[i].kept for i in range(60) if not got[i].base_failed) and sum(got[i].kept for i in range(60)) > 50
    assert not got[100].kept and not got[101].kept and got[102].kept and got[103].base_failed and got[104].base_failed
    assert got[105].base_failed and not got[105].kept and got[106].kept == (not got[106].base_failed)
    assert Q.judge(docs).count() == len(rows) and Q.judge(docs.limit(0)).count() == 0
