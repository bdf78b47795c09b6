import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hitsieve.llm import variants as V


def plain_words(rows):
    """Runs and slips letter by letter."""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def plain(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        top = min(near, key=lambda x: (-words[x], x), default=None)
        form = top if top is not None and words[top] >= 5 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def taken(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    stems = ["colour", "çafé" + "té", "wordly", "summers", "aaaaaa", "ÀÉÎõü÷", "straßen", "abcabc"]
    every = []
    for s in stems:
        every.append(s)
        for _ in range(12):
            k = rng.randrange(len(s))
            c = rng.choice("aeéxzç")
            every.append(rng.choice([s[:k] + s[k + 1:], s[:k] + c + s[k:], s[:k] + c + s[k + 1:], s.upper()]))
    out = [(i, " ".join(rng.choice(every[:1 + rng.randrange(len(every))]) for _ in range(60))) for i in range(120)]
    return out + [(3, "colour, COLOUR-colour"), (None, "colour " * 9), (7, None), (8, ""), (9, "colour\n" * 400), (9, "colour\n" * 400)]


def test_words_forms_and_roots_equal_loops(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id int, text string, word string, n string")
    words = plain_words(rows)
    assert {r["word"]: r["n"] for r in V.word_counts(docs).collect()} == words
    got = taken(V.variants(docs))
    assert got == plain(words)
    assert V.variants(docs.where("false")).count() == 0


def test_pairs_of_any_block_size_and_parts(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(300)})
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for parts, block in ((None, 512), (None, 7), (["a", "b", "c"], 40), (["", "", "abc"], 1000)):
        got = [(r["a"], r["b"]) for r in V.near_pairs(df, parts, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_signatures_of_one_edit_share_one(spark):
    rng, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyzéß"
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        k, c = rng.randrange(len(a)), rng.choice(letters)
        pairs.append((a, rng.choice([a[:k] + a[k + 1:], a[:k] + c + a[k:], a[:k] + c + a[k + 1:]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    parts = V.alphabet_parts(df.select(F.col("a").alias("word")))
    assert sorted("".join(parts)) == sorted({c for a, _ in pairs for c in a})
    assert df.where(F.arrays_overlap(V.signatures(F.col("a"), parts), V.signatures(F.col("b"), parts))).count() == 400


def test_chains_of_forms_end_at_the_root(spark):
    names = ["abcdef" + c for c in "ghijklmnop"]
    forms = spark.createDataFrame([(a, b) for a, b in zip(names, [*names[1:], None])] + [("lonely", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in V.with_roots(forms).collect()} == {**{n: names[-1] for n in names}, "lonely": "lonely"}
