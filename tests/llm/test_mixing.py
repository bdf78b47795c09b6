import collections

import pytest

from hitsieve.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        over = {s: most * sizes[s] for s in left if rest * w[s] / sum(w[x] for x in left) >= most * sizes[s]}
        if not over:
            return capped | {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 10, "c": 5, None: 40}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 7}, {"z": 5}, {"a": 0},
                                   {f"s{i}": (i * 37) % 101 for i in range(23)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark):
    rows = [(i, "word " * (i % 17 + 1) + ("###" if i % 5 == 0 else ""), "big" if i % 3 else f"s{i % 7}") for i in range(1500)]
    rows += [(2000, None, "big"), (2001, "", None), (2002, "one two", None), rows[4], (None, "a b c", "s1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, key string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, target, most = collections.Counter(), {}, 0
    for r in got:
        assert 0 <= r.times <= 3
        taken[r.source] += r.size * r.times
        target[r.source] = r.target
        most = max(most, r.size)
    for source in target:
        assert abs(taken[source] - target[source]) <= most
    full = collections.defaultdict(set)
    for r in got:
        if r["size"]:
            full[r.source].add(r.times)
    assert all(max(t) - min(t) <= 1 for t in full.values())  # complete epochs first
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "good words here now" if i % 2 else "bad# w#rds $here n$w", "a" if i < 4000 else "b") for i in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a'").collect()
    share = [sum(r.times for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert share[1] > 1.5 * share[0] > 0


def test_copies_of_a_row_are_parted_at_the_border(spark):
    rows = [(1, "ten words " * 5, "a")] * 600 + [(i, "ten words " * 5, "a") for i in range(2, 402)] + [(9000 + i, "w " * 10, "b") for i in range(5000)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, _copy long")
    for seed in range(2):
        got = mixing.mix(docs, (1, 8), seed=seed).collect()
        assert len(got) == len(rows)
        for source in "ab":
            here = [r for r in got if r.source == source]
            assert abs(sum(r.size * r.times for r in here) - here[0].target) <= 5
            assert max(r.times for r in here) - min(r.times for r in here) <= 1
    docs = docs.withColumn("text", docs.text)
    times = collections.Counter()
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += r.times
    kept = mixing.mix_sources(spark, docs.repartition(5), None)
    assert kept.columns == docs.columns
    found = collections.Counter(r.doc_id for r in kept.collect())
    assert found == +times and max(collections.Counter(r._copy for r in kept.collect()).values()) <= 3


def test_the_stage_does_not_shuffle_texts(spark):
    """A document learns from its source's cut how often it is taken, also where nothing is small enough to be sent unasked."""
    rows = [(i, "word " * (i % 17 + 1), "big" if i % 3 else f"s{i % 7}", "own") for i in range(700)] + [(800, None, None, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, border string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = mixing.mix_sources(spark, docs, None)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        want = {r.doc_id: r.times for r in mixing.mix(docs).collect() if r.times}
        assert collections.Counter(r.doc_id for r in kept.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
