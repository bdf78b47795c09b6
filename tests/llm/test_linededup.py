import collections
import random

from hitsieve.llm import linededup

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans(linededup.UPPER, linededup.LOWER)


def plain(rows, min_chars, min_docs):
    held = collections.defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOW)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i is not None and i != max(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_against_plain_version(spark):
    rng = random.Random(5)
    lines = ["", " ", "short", "a line that is long enough", "A Line that is LONG enough \t", "ÄÖ line that is long enough", "äö line that is long enough",
             "  another line of some length", "x" * 300]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a line that is long enough"), rows[3], rows[3], (7, "a line that is long enough\nonly here in this other text")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, _gone string")
    for batches in (1, 4, 7):
        got = linededup.drop_lines(docs.drop("_gone"), 10, 5, batches).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == plain(rows, 10, 5)
    assert linededup.drop_lines(docs.limit(0).drop("_gone")).count() == 0


def test_many_texts_of_one_id_are_one_document(spark):
    line = "one line that is long enough for anything, said the sign"
    docs = spark.createDataFrame([(1, f"{line}\n{k}") for k in range(40)] + [(2, line)], "doc_id long, text string")
    for batches in (1, 2, 3, 4, 9):
        assert linededup.drop_lines(docs, batches=batches).agg({"n_dropped": "sum"}).first()[0] == 0
    more = docs.union(spark.createDataFrame([(k, line) for k in (3, 4, 5)], "doc_id long, text string"))
    for batches in (1, 4, 9):
        got = linededup.drop_lines(more, batches=batches).where("n_dropped > 0").groupBy("doc_id").count().collect()
        assert sorted(map(tuple, got)) == [(1, 40), (2, 1), (3, 1), (4, 1)]


def test_runs_hold_each_hash_once(spark):
    rows = spark.range(300).selectExpr("id as doc_id", "id % 50 as h1", "id % 50 as h2", "id div 60 as batch")
    runs = linededup.LineRuns(spark)
    fresh = [runs.add(rows.where(f"batch = {b}").drop("batch")).count() for b in range(5)]
    assert fresh == [50, 0, 0, 0, 0]
    assert all(len(level) < linededup.FANOUT for level in runs.levels)
    assert {(r.n, r.top) for r in runs.totals().collect()} == {(6, 250 + k) for k in range(50)}
    runs.drop()


def test_texts_meet_their_lost_lines_by_one_plan_at_every_size(spark):
    docs = spark.createDataFrame([(i, "a line that is long enough to be taken out of most of its texts\nown %d" % i) for i in range(9)], "doc_id long, text string")
    cut = linededup.drop_lines(docs)
    assert "SortMergeJoin" in cut._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n_dropped for r in cut.collect()) == 8
