import random

from hypothesis import given, settings, strategies as st

from hitsieve.llm import trietokens
from hitsieve.llm.trietokens import PIECES, START, plain_count, token_counts, trie_counts, unigram


def brute(model, word):
    """Best (score, fewest tokens) over all segmentations, from the definition."""
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        options = []
        for s in range(d):
            piece = word[s:d]
            if piece in model.score:
                options.append((best[s][0] + model.score[piece], best[s][1] - 1))
            elif d - s == 1:
                options.append((best[s][0] + model.unknown, best[s][1] - len(piece.encode())))
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abtheinrs▁漢é😀.,1 "), max_size=20), min_size=1, max_size=30))
def test_trie_is_brute_force(words):
    words = sorted({START + w.replace(" ", "") for w in words})
    model = unigram(PIECES)
    want = [brute(model, w) for w in words]
    assert trie_counts(model, words).tolist() == want == [plain_count(model, w) for w in words]


def test_texts(monkeypatch):
    model, rng = unigram(PIECES), random.Random(1)
    texts = ["", " \n", "the the theory", "x" * 5000, " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 90))) for _ in range(300))]
    want = [(len(t.split()), sum(brute(model, START + w) for w in t.split())) for t in texts]
    for kept in (400_000, 0):
        monkeypatch.setattr(trietokens, "KEPT", kept)
        assert token_counts(PIECES, [t.encode() for t in texts]) == want


def test_query(spark):
    docs = spark.createDataFrame([(1, "the cat", 9), (2, None, 9), (None, "", 9), (1, "the cat", 9)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in trietokens.count_tokens(docs).collect()), key=str)
    n = token_counts(PIECES, [b"the cat"])[0][1]
    assert got == sorted([(1, 2, n), (1, 2, n), (2, 0, 0), (None, 0, 0)], key=str)
    assert trietokens.count_tokens(docs.limit(0)).count() == 0
