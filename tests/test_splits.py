import numpy as np
import pytest
from pyspark.sql import functions as F

from hitsieve.operators import splits as SP


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one group; the rest are small groups and a few rows without a group."""
    rng = np.random.default_rng(2)
    keys = ["hot"] * 300 + [f"g{int(i)}" for i in rng.integers(0, 150, 580)] + [None] * 20
    return spark.createDataFrame([(i, k, int(rng.random() < 0.3)) for i, k in enumerate(keys)],
                                 "id long, grp string, y int").cache()


def test_group_holdout(rows):
    out = SP.group_holdout(rows, "grp", "y", 0.2, 42, trials=20).collect()
    assert len(out) == 900
    roles = {}
    for r in out:
        roles.setdefault(r["grp"], set()).add(r["role"])
    assert all(len(v) == 1 for v in roles.values())
    ext = [r for r in out if r["role"] == "external"]
    assert 0 < len(ext) <= 180 * 1.05
    assert {r["y"] for r in ext} == {0, 1}


def test_holdout_in_cells_equals_one_pass(rows):
    one = {r["id"]: r["role"] for r in SP.group_holdout(rows, "grp", "y", 0.2, 7, trials=10).collect()}
    cut = {r["id"]: r["role"] for r in SP.group_holdout(rows, "grp", "y", 0.2, 7, trials=10, groups_per_cell=9).collect()}
    assert one == cut


def test_best_trial_wins(rows):
    def gap(trials):
        out = SP.group_holdout(rows, "grp", "y", 0.2, 3, trials=trials).where("role = 'external'").agg(
            F.count("*").alias("n"), F.sum("y").alias("p")).first()
        pos = rows.agg(F.sum("y")).first()[0]
        tp, tn = round(pos * 0.2), round((900 - pos) * 0.2)
        return abs(out["n"] - 180) / 180 + 0.75 * abs(out["p"] - tp) / tp + 0.25 * abs(out["n"] - out["p"] - tn) / tn
    assert gap(20) <= gap(1)


def test_group_larger_than_the_holdout(spark):
    df = spark.createDataFrame([(i, "only", i % 2) for i in range(10)], "id long, grp string, y int")
    assert {r["role"] for r in SP.group_holdout(df, "grp", "y", 0.2, 1, trials=3).collect()} == {"dev"}


def test_grouped_folds(rows):
    out = SP.grouped_folds(rows, "grp", "y", 4, 42).collect()
    assert len(out) == 900
    seen = {}
    for r in out:
        seen.setdefault(r["grp"], set()).add(r["fold"])
    assert all(len(v) == 1 for v in seen.values())
    for f in range(4):
        mine = [r["y"] for r in out if r["fold"] == f]
        assert set(mine) == {0, 1}
    small = sorted(sum(r["fold"] == f for r in out) for f in range(4))
    assert small[0] >= 150


def test_folds_fall_back_when_a_class_is_missing(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}", int(i < 4)) for i in range(40)], "id long, grp string, y int")
    sizes = SP.grouped_folds(df, "grp", "y", 4, 1).groupBy("fold").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) <= 12


def test_tuning_guards(spark, rows):
    assert SP.tuning_folds(rows.where("y = 1"), "grp", "y", 3, 1) is None
    assert SP.tuning_folds(rows.where("grp = 'hot'"), "grp", "y", 3, 1) is None


def test_stratified_sizes(rows):
    out = SP.stratified_holdout(rows, "id", "y", 0.25, 5).collect()
    for c in (0, 1):
        mine = [r for r in out if r["y"] == c]
        assert sum(r["role"] == "external" for r in mine) == int(len(mine) * 0.25 + 0.5)


def test_balanced_sample_tops_up(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(200)], "id long, y int")
    got = SP.balanced_sample(df, "id", "y", 40, 1).collect()
    assert len(got) == 40 and sum(r["y"] for r in got) == 5
    assert SP.balanced_sample(df, "id", "y", 500, 1).count() == 200
    assert SP.balanced_sample(df.where("y = 0"), "id", "y", 10, 1).count() == 10


def test_permutation_keeps_class_counts(rows):
    out = SP.permuted_labels(rows, "id", "y", 3, 1)
    a = out.groupBy("permutation").agg(F.sum("y").alias("a"), F.sum("permuted").alias("b"), F.count("*").alias("n"),
                                       F.sum((F.col("y") != F.col("permuted")).cast("int")).alias("moved")).collect()
    assert len(a) == 3
    assert all(r["a"] == r["b"] and r["n"] == 900 and r["moved"] > 0 for r in a)


def test_augmentation_keeps_tokens_and_labels(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", 1), (2, "", 0)], "id long, text string, y int")
    out = SP.augment(df, "id", "text", 3, 42, 0).collect()
    assert len(out) == 5
    mixed = [r["text"] for r in out if r["variant"] > 0]
    assert all(sorted(t.split()) == list("abcdefgh") for t in mixed) and len(set(mixed)) > 1
    again = SP.augment(df, "id", "text", 3, 42, 0).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert SP.augment(df, "id", "text", 0, 42, 0).count() == 2
