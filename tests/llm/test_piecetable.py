import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SMALL
from hitsieve.llm import piecetable as P

LETTERS = [" ", "  ", "a", "b", "e", "t", "in", "er", "▁", "\n", "é", "\t", "你", "好", "\U0001F600", "\x00", "0", "12", "</s>", "<0x0A>",
           "ть", "the ", "=", "==", "-", "--", "/", "aaa", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_random_texts_agree_with_the_library(library):
    rng, code = random.Random(3), P.pieces()
    for _ in range(8000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text)
        assert code.encode(text).tolist() == ids, text
        assert code.decode(np.array(ids, "<u4")) == library.decode(ids), text


def test_runs_of_blanks_signs_and_letters(library):
    code = P.pieces()
    for sign in (" ", "a", "=", "\n", "▁", "é", "\u0000"):
        for n in (1, 2, 3, 5, 15, 16, 17, 33, 64, 200):
            assert code.encode(sign * n).tolist() == library.encode(sign * n)


def test_any_ids_decode_as_the_library_does(library):
    rng, code = random.Random(4), P.pieces()
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 28705, code.byte_ids[rng.randrange(256)], rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert code.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_many_runs_of_ids_decode_at_once(monkeypatch):
    """Empty runs, control ids in front, between and at the end, spelled letters whole and broken; several steps."""
    rng, code = random.Random(6), P.pieces()
    special = [0, 1, 2, code.number["▁the"], code.byte_ids[10], *(code.byte_ids[b] for b in "é€".encode())]
    runs = [[rng.choice([*special, rng.randrange(32000)]) for _ in range(rng.choice([0, 1, 2, 3, 9]))] for _ in range(3000)]
    at, flat = np.cumsum([5, *map(len, runs)]), np.array([7] * 5 + sum(runs, []), np.int32)
    want = [code.decode(np.array(r, "<u4")) for r in runs]
    for step in (P.IDS, 100):
        monkeypatch.setattr(P, "IDS", step)
        assert code.decode_many(flat, at).to_pylist() == want
    assert code.decode_many(flat, at[:1]).to_pylist() == [] and code.decode_many(flat[:0], np.zeros(3, int)).to_pylist() == ["", ""]


def test_pairs_and_places_of_many_at_once_are_those_of_each():
    rng, code = random.Random(7), P.pieces()
    texts, pairs = list(code.number), [(-1, i) for i in range(300, 400)]
    for _ in range(20000):  # tokens that meet by chance, and two parts of longer letters
        joined = rng.choice(texts) + rng.choice(["", *rng.choices(texts, k=3)])
        k = rng.randrange(len(joined))
        pairs += [(code.number[a], code.number[b]) for a, b in [(joined[:k], joined[k:])] if a in code.number and b in code.number]
        pairs.append((code.number[rng.choice(texts)], code.number[rng.choice(texts)]))
    left, right = np.array(pairs, np.int32).T
    want = [code.fits(a, b) for a, b in zip(left.tolist(), right.tolist())]
    assert 0.05 < np.mean(want) < 0.99 and code.fit_all(left, right).tolist() == want
    code.odd[left[::3]] = True  # the step-by-step way gives the same
    assert code.fit_all(left, right).tolist() == want
    code.odd[:] = False
    for _ in range(2):  # tested anew, then remembered
        assert code._known_pairs(left, right).tolist() == want
    text = "".join(rng.choice(LETTERS).replace(" ", P.SPACE) for _ in range(3000))
    want = sorted((end + 1 - code.size[i], end + 1, i) for end, i in code.matches.iter(text) if not code.lost[i])
    assert sorted(zip(*(x.tolist() for x in code.found(text)))) == want


def test_sparse_numbers():
    rng = np.random.default_rng(8)
    for many in (0, 1, 3, 300, 50_000):
        keys = rng.choice(1 << 32, many, replace=False)
        row, column, value = keys >> 16, keys & 0xFFFF, rng.integers(0, 1 << 20, many)
        table, held = P.Sparse(row, column, value), dict(zip(keys.tolist(), value.tolist()))
        assert table.at(row, column).tolist() == value.tolist()
        other = rng.integers(0, 1 << 32, 1000)
        assert table.at(other >> 16, other & 0xFFFF).tolist() == [held.get(k, -1) for k in other.tolist()]


def test_a_long_text_without_blanks_takes_linear_time(library):
    text = "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(400_000))
    assert P.pieces().encode(text).tolist() == library.encode(text)


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", list(r["ids"])) for r in P.encoded(docs).collect())
    assert got == [(0, "c", [277, 2]), (1, "", [2]), (2, "", [2]), (3, "a b", [264, 287, 2]), (3, "a b", [264, 287, 2])]
    assert P.encoded(docs.where("false")).count() == 0
    assert [list(r[0]) for r in P.encoded(docs.where("doc_id = 2"), end=False).select("ids").collect()] == [[]]


def test_query_equals_the_library(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode(r["text"], add_eos=True)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.op13_sentencepiece_round_trip(spark, SMALL).collect()}
    assert got == want


def test_texts_are_encoded_once(spark):
    """Ids, their number and the decoded text come from one call of Python for each text."""
    texts = spark.createDataFrame([(None,), ("",), ("a b",), ("é\U0001F600\n",)], "text string")
    assert [(list(r["ids"]), r["decoded"]) for r in P.round_tripped(texts.withColumn("decoded", F.lit(1))).select("ids", "decoded").collect()] == [
        (ids.tolist() + [2], t or "") for t in (None, "", "a b", "é\U0001F600\n") for ids in [P.pieces().encode(t or "")]]
    plan = P.op13_sentencepiece_round_trip(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    calls = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(calls) == 1 and calls[0].count("coalesce(text") == 1
