import corpus_pipeline
from hitsieve.llm.catalog import QUERIES
from hitsieve.llm.common import store

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, SMALL), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first.columns and out.dtypes == first.dtypes
        seen.append((docs, out))
        docs = out
    (_, good), (_, lines), (_, near), (_, mixed), (_, coded) = seen
    assert 0 < near.count() < lines.count() == good.count() < first.count()
    assert mixed.count() > mixed.select("doc_id").distinct().count()  # epochs
    assert coded.count() == mixed.count() and coded.where("n_tokens <> size(tokens)").isEmpty()
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect())) == sorted(
        map(str, coded.select("doc_id", "n_tokens").collect()))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SMALL), "stage")
    assert docs.count() == 0


def test_nulls_and_extra_columns(spark):
    rows = [(1, None, None, None, None, "k"), (None, "a b c d e f", "en", "s", 11, "k"), (2, "", "en", None, 0, None), (2, "", "en", None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = store(stage(spark, docs, SMALL), "stage")
        assert set(rows[0][5:]) <= {r.score for r in docs.select("score").collect()} | {"k"}


def test_all_ten_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
