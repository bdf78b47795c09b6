import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hitsieve.operators import attribution as A, metrics as M, models as ML, rollup as R, screen as SC, splits as SP
from hitsieve.plans import q_models as QM
from hitsieve.plans.views import documents
from hitsieve.schemas import TrainConfig
from hitsieve.session import scratch_path
from conftest import SMALL


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=240) * 0.4 > 0).astype(int)
    rows = [(i, r.tolist(), int(t), f"g{i % 30}") for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, grp string")
    vec = array_to_vector("v")
    return df.withColumns({"features_scaled": vec, "features_raw": vec}).cache()


@pytest.mark.parametrize("family", list(QM.SMALL))
def test_families_learn(toy, family):
    model = ML.fit_family(toy.where("id < 160"), family, "y", QM.SMALL[family] | ({"max_iter": 100} if family == "MLP" else {}))
    rows = ML.with_probability(model.transform(toy.where("id >= 160"))).select(F.col("y").alias("y_true"), "y_prob")
    assert M.roc_auc(rows, []).first()[0] > 0.8


def test_attributions_add_up(toy):
    model = ML.fit_family(toy, "RFC", "y", QM.SMALL["RFC"])
    score = lambda d: ML.with_probability(model.transform(d.withColumn("features_raw", array_to_vector("v"))))
    ex, bg = toy.where("id < 5").select("id", "v"), toy.where("id >= 200 and id < 206").select("id", "v")
    vals = A.sampled_attribution(ex, bg, "v", ["a", "b", "c"], "id", score, 3).groupBy("id").agg(F.sum("value").alias("s"))
    base = score(bg).agg(F.avg("y_prob")).first()[0]
    full = {r["id"]: r["y_prob"] for r in score(ex).collect()}
    for r in vals.collect():
        assert r["s"] == pytest.approx(full[r["id"]] - base, abs=1e-9)


def test_isotonic_is_monotone_and_calibration_helps(toy):
    folds = SP.grouped_folds(toy, "grp", "y", 3, 1).cache()
    fit = lambda t: ML.fit_family(t, "LR", "y", {"max_iter": 50})
    for method in ("sigmoid", "isotonic"):
        out = ML.calibrate(folds, "y", "fold", method, fit)
        got = [r["y_cal"] for r in out.collect()]
        assert len(got) == 240 and min(got) >= 0 and max(got) <= 1
    with pytest.raises(ValueError):
        ML.calibrate(folds, "y", "fold", "other", fit)


def test_search_space_is_a_seeded_subset():
    full = ML.search_space("LR", "grid", 5, 1)
    assert len(full) == 6
    some = ML.search_space("RFC", "random", 7, 3)
    assert len(some) == 7 and some == ML.search_space("RFC", "random", 7, 3)


def test_permutation_summary(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, None)], "permutation_idx int, metric double")
    r = R.permutation_summary(df, F.lit(0.6)).first()
    assert r["p_value"] == pytest.approx(2 / 4) and r["perm_std"] == pytest.approx(0.1) and r["z_score"] == pytest.approx(0.0, abs=1e-12)


def test_rollup_conventions(spark):
    long = spark.createDataFrame([(0, 0, "A", "f1", 0.2), (0, 1, "A", "f1", 0.4), (0, 0, "A", "mcc", None), (0, 1, "A", "mcc", 1.0)],
                                 "seed int, fold int, model string, metric string, value double")
    got = {r["metric"]: r for r in R.fold_summary(long).collect()}
    assert got["f1"]["mean"] == pytest.approx(0.3) and got["f1"]["std"] == pytest.approx(0.1)
    assert got["f1"]["mean_std"] == "0.3000 ± 0.1000" and got["mcc"]["mean"] is None and got["mcc"]["mean_std"] is None
    seeds = spark.createDataFrame([(s, "A", "f1", v) for s, v in ((1, 0.2), (2, 0.4), (3, 0.9))],
                                  "seed int, model string, metric string, value double")
    t = {r["row"]: r["A_f1"] for r in R.seed_table(seeds, ["A_f1"]).collect()}
    assert t["MEAN"] == pytest.approx(0.5) and t["STD"] == pytest.approx(np.std([0.2, 0.4, 0.9], ddof=1))
    assert R.seed_distance(seeds).first()["seed"] == 2
    assert R.seed_distance(seeds, "B_f1").first()["distance"] == float("inf")
    assert R.chosen(seeds, ["nobody"], None).count() == 3


def test_threshold_resolution(spark):
    t = spark.createDataFrame([(0.3, None, 0.6)], "selected_threshold double, max_f1_threshold double, youden_j_threshold double")
    get = lambda **k: SC.resolve_threshold(t, **k).first()["threshold"]
    assert get(metric="f1") == 0.3 and get(metric="youden") == 0.6 and get(metric="mcc") == 0.6 and get(mode="0.25") == 0.25
    assert SC.resolve_threshold(t.select("max_f1_threshold"), "auto").first()["threshold"] == 0.5
    with pytest.raises(ValueError):
        get(mode=1.5)
    with pytest.raises(ValueError):
        get(metric="other")


def test_scoring_needs_no_shuffle_and_reads_planned_columns(spark):
    from hitsieve.functions.text import with_descriptors
    from hitsieve.plans.q_screen import score_all
    from hitsieve.sources.tables import read_library
    docs = read_library(spark, f"{SMALL}/documents.parquet", ["doc_id", "text"], spread_rows=False)
    plan = score_all(with_descriptors(docs, ["unique_ratio", "symbol_ratio", "digit_ratio", "mean_token"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_stored_features_push_rules_to_the_scan(spark):
    from hitsieve.functions.text import rule_filter
    from hitsieve.plans.views import TEXT_BASIC_RULES, library
    path = scratch_path(spark, "stored")
    library(spark, SMALL).write.parquet(path)
    plan = spark.read.parquet(path).where(rule_filter(TEXT_BASIC_RULES)).select("doc_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars)" in text


def test_missing_column_raises_before_running(spark):
    from hitsieve.sources.tables import select_required
    with pytest.raises(ValueError):
        select_required(documents(spark, SMALL), ["doc_id", "nope"])


def test_csv_round_trip_runs_and_backup(spark):
    from hitsieve.sources import sinks, tables
    path = scratch_path(spark, "t") + ".csv"
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    sinks.write_csv(df, path)
    assert sorted(map(tuple, tables.read_table(spark, path, "id int, s string").collect()), key=str) == [(1, "a,b"), (2, None)]
    runs = scratch_path(spark, "runs")
    df.write.parquet(f"{runs}/seed=4")
    df.withColumn("extra", F.lit(1)).write.parquet(f"{runs}/seed=5")
    assert sorted((r["seed"], r["extra"]) for r in tables.read_runs(spark, runs).collect()) == sorted(
        [(4, None), (4, None), (5, 1), (5, 1)], key=str)
    single = tables.key_from_path(spark.read.parquet(f"{runs}/seed=4"))
    assert {r["seed"] for r in single.collect()} == {4}
    table = scratch_path(spark, "live")
    df.write.parquet(table)
    sinks.replace_with_backup(spark.read.parquet(table).withColumn("n", F.lit(1)), table, table + ".bak")
    assert spark.read.parquet(table).columns == ["id", "s", "n"] and spark.read.parquet(table + ".bak").columns == ["id", "s"]
    empty = scratch_path(spark, "empty")
    sinks.write_parquet(df.where("id > 9"), empty)
    assert spark.read.parquet(empty).count() == 0


def test_wide_feature_detection(spark):
    from hitsieve.sources.tables import detect_features, gather_bits
    cols = ["id", "morgan_10", "morgan_2", "morgan_0", "morgan_x"]
    assert detect_features(cols, n_bits=3) == ["morgan_0", "morgan_2", "morgan_10"] and detect_features(cols, n_bits=4) == []
    df = spark.createDataFrame([(1, 1, 0, 1)], "id int, morgan_0 int, morgan_1 int, morgan_2 int")
    assert gather_bits(df, ["morgan_0", "morgan_1", "morgan_2"]).first()["bits"] == [0, 2]


@pytest.mark.parametrize("space", [{"max_depth": ["deep"]}, {"n_estimators": ["many"]}])
def test_a_failed_search_is_no_result(toy, space):
    """Candidates that a family refuses end the search, in a task or before it."""
    folds = toy.withColumn("fold", (F.col("id") % 3).cast("int"))
    with pytest.raises((PySparkException, ValueError)):
        ML.search(folds, "XGBC", "y", "fold", space=space)
    with pytest.raises(ValueError, match="two folds"):
        ML.search(folds.where("fold = 0"), "LR", "y", "fold", "grid")
    found = ML.search(folds, "LR", "y", "fold", "grid", space={"C": [1.0], "max_iter": [20]})
    assert found["best_score"] > 0.8 and found["cv_folds"] == 3 and found["n_iter"] == 1


def test_queries_run_the_whole_job(spark, monkeypatch):
    """The registered queries give the operators their defaults: families, folds, seeds, searches, permutations."""
    seen = {}

    class Stop(Exception):
        pass

    def caught(name, place):
        def run(*a, **k):
            seen[name] = (a, k)
            raise Stop
        monkeypatch.setattr(place, name, run)

    for name in ("out_of_fold", "final_models", "run_seeds", "permutation_scores"):
        caught(name, ML)
    for run in (QM.oof, QM.external, QM.seeds, QM.permutation_test):
        with pytest.raises(Stop):
            run(spark, SMALL)
    for name in ("out_of_fold", "final_models", "run_seeds"):
        given = [x for x in (*seen[name][0], *seen[name][1].values()) if isinstance(x, TrainConfig)]
        assert given == [TrainConfig()]
        assert {} == {f: p for x in seen[name][0] if isinstance(x, dict) for f, p in x.items() if isinstance(p, dict) and p}
    assert seen["run_seeds"][1]["params"] == {f: {} for f in TrainConfig().models}
    assert seen["out_of_fold"][0][0].agg(F.max("fold")).first()[0] == 4
    assert 200 in seen["permutation_scores"][0]
    searches = []
    monkeypatch.setattr(ML, "tune", lambda folds, family, label, fold, kind, n, scoring, seed, **k: (
        searches.append((family, kind, n, k)), (None, {"model": family, "best_score": 1.0, "best_params": {}, "cv_folds": 3}))[1])
    QM.tuning(spark, SMALL)
    assert searches == [(f, kind, 60, {}) for f in TrainConfig().models for kind in ("grid", "random")]
