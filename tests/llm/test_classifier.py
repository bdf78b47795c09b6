import random
import zlib

from pyspark.sql import functions as F

from hitsieve.llm import classifier as C


def test_held_out_fold(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", C.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def corpus(rng, n):
    good, bad = ["river", "stone", "walks", "slowly", "under", "trees"], ["BUY", "now!!", "$$$", "click", "fr33", "|||"]
    for i in range(n):
        y = int(rng.random() < 0.6)
        yield i, " ".join(rng.choice(good if y or rng.random() < 0.3 else bad) for _ in range(rng.randint(20, 60))), y


def test_learns_and_handles_odd_rows(spark):
    rows = list(corpus(random.Random(1), 500))
    docs = [(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "river", "x"), rows[0][:2] + ("x",), (9002, "river stone " * 90000, "x")]
    labels = [(i, y) for i, _, y in rows] + [(0, None), (None, 1), (7, rows[7][2])]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    made = C.score_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = made.collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    scores = {r.doc_id: r.score for r in got}
    assert scores[9000] == scores[9001]
    again = {r.doc_id: r.score for r in made.collect()}
    assert again == scores


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)]):
        got = C.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert [r.score for r in got] == [0.5, 0.5]
    assert C.score_documents(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = list(corpus(random.Random(2), 200))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in C.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert a == b
