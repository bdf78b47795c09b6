import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from hitsieve.llm import alignment as A
from hitsieve.llm.bpe import VOCABULARY, byte_letters
from hitsieve.llm.piecetable import MODEL


class Plain:
    """The same by the libraries and loops over all token pairs."""

    def __init__(self):
        self.a = Tokenizer.from_file(VOCABULARY)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        self.byte_of = {c: b for b, c in byte_letters().items()}

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(i, bytes(self.byte_of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        return (a, b) if b"".join(x[1] for x in a) == b"".join(x[1] for x in b) == raw else ([], [])

    def document(self, text):
        a, b = self.tokens(text)
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, raw in tokens:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        parts = [[[] for _ in shared] for _ in spans]
        for side, out in zip(spans, parts):
            k = 0
            for _, e, i in side:
                while e > shared[k]:
                    k += 1
                out[k].append(str(i))
        groups = ["|".join(map(",".join, p)) for p in zip(*parts)]
        links, first = [], 0
        for s, e, i in spans[0]:
            while first < len(spans[1]) and spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        return len(a), len(b), groups, links

    def corpus(self, texts):
        done = [self.document(t) for t in texts]
        count = Counter(x for d in done for x in d[3])
        most = {}
        for (_, b), n in count.items():
            most[b] = max(most.get(b, 0), n)
        return [(na, nb, len(g), len(li), sum(count[x] == most[x[1]] for x in li), sum(count[x] for x in li),
                 hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, li in done], count


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_query_equals_loops_over_the_libraries(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain.corpus([r["text"] for r in docs])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.op12_tokenizer_alignment(spark, SMALL).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(docs, want)}


def test_odd_texts_repeats_and_clashing_columns(spark, plain, monkeypatch):
    long = "wintentions" * 4000 + " " + "é\n" * 500
    texts = [None, "", " ", "a", "a ▁ b", "<|endoftext|> x </s>", "\U0001F600\U0001F600 \x00", "same words here", "same words here",
             "tab\tand\r\nline", "中文和 english", "x" * 50 + "      y", long, long]
    rows = [(i if i != 8 else 7, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, groups string, _n int").withColumn("k", F.monotonically_increasing_id())
    want, count = plain.corpus(texts)
    for step in (1 << 20, 50):  # several slices and parts of a bitmap
        monkeypatch.setattr(A, "SLICE", step)
        monkeypatch.setattr(A, "LINKS", step)
        got = A.scored(A.aligned(docs).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")))
        assert [tuple(r[c] for c in COLUMNS) for r in got.orderBy("k").collect()] == want
    empty = A.scored(A.aligned(docs.where("false")))
    assert empty.count() == 0 and {"doc_id", "groups", "n_best", "count_sum"} < set(empty.columns)
    numbered = A.aligned(docs).withColumn("_n", F.col("k"))
    scores = {(r["id_a"], r["id_b"]): (r["links"], r["documents"]) for r in A.pair_scores(A.pair_bitmaps(numbered)).collect()}
    held = Counter(x for t in texts for x in set(plain.document(t)[3]))
    assert scores == {x: (n, held[x]) for x, n in count.items()}


def test_bitmaps_of_many_documents(spark):
    """Lists and bits give the same places; parts are OR-ed."""
    rng = np.random.default_rng(1)
    for n in (0, 1, A.DENSE - 1, A.DENSE, 60000):
        place = np.sort(rng.choice(1 << A.SPAN, n, replace=False)).astype("<u2")
        assert np.array_equal(A._places(A._bitmap(place)), place)
    parts = [np.sort(rng.choice(1 << A.SPAN, n, replace=False)).astype("<u2") for n in (3000, 3000, 9000)]
    df = spark.createDataFrame([([bytearray(A._bitmap(p)) for p in parts],), ([bytearray(A._bitmap(parts[0]))],)], "parts array<binary>")
    got = df.select(A.any_of("parts").alias("bits")).select(A.members("bits").alias("n"), "bits").collect()
    whole = np.unique(np.concatenate(parts))
    assert [r["n"] for r in got] == [len(whole), 3000] and np.array_equal(A._places(bytes(got[0]["bits"])), whole)


def test_a_pair_in_more_documents_than_a_list_holds(spark):
    docs = spark.range(0, 6000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), F.repeat(F.lit("the "), (F.col("id") % 7).cast("int"))).alias("text"))
    rows = A.aligned(docs)
    got = A.scored(rows).groupBy("n_links").agg(F.min("count_sum").alias("a"), F.max("count_sum").alias("b"), F.min(F.col("n_best") == F.col("n_links")).alias("best")).collect()
    scores = A.pair_scores(A.pair_bitmaps(rows.withColumn("_n", F.col("doc_id")))).collect()
    assert len(got) == 7 and all(r["a"] == r["b"] and r["best"] for r in got)
    assert max(r["documents"] for r in scores) == 6000
    assert max(r["links"] for r in scores) == sum(1 + i % 7 for i in range(6000))


def test_links_and_common_ends_without_sorting(plain):
    code = A.pair()
    for text in ("intentions of x", "é\U0001F600 \n\n  tokenizers, 12345", "the " * 300):
        (a, b), = code.ids([text])
        na, nb, groups, links = plain.document(text)
        shared_a, shared_b, link_a, link_b = A.linked(code, a, b)
        assert (len(a), len(b)) == (na, nb) and shared_a.sum() == shared_b.sum() == len(groups)
        assert list(zip(a[link_a].tolist(), b[link_b].tolist())) == links
    assert [len(x) for x in A.linked(code, a[:0], b[:0])] == [0, 0, 0, 0]


def test_ids_between_stages_are_short(spark):
    """Half the bytes of 32-bit ids; sliced and empty columns are read as written."""
    column = A._short(np.array([1, 65535, 7], "<u4"), np.array([0, 2, 2, 3]))
    assert [A._ids(column)[0].tolist(), A._ids(column)[1].tolist()] == [[0, 2, 2, 3], [1, 65535, 7]]
    at, flat = A._ids(column.slice(1))
    assert at.tolist() == [2, 2, 3] and flat[at[0]:at[-1]].tolist() == [7]
    assert A._ids(column.slice(0, 0))[0].tolist() == [0]
    row = A.aligned(spark.createDataFrame([("a b",)], "text string")).first()
    assert len(row["ids_a"]) == 2 * row["n_a"] and len(row["ids_b"]) == 2 * row["n_b"]
