import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitsieve.operators import metrics as M


def cases():
    rng = np.random.default_rng(3)
    out = {}
    for i in range(12):
        n = int(rng.integers(5, 120))
        p = np.round(rng.random(n), int(rng.integers(1, 7)))
        out[f"c{i}"] = (rng.integers(0, 2, n), p)
    out["all_ties"] = (np.array([0, 1, 1, 0, 1]), np.full(5, 0.5))
    out["perfect"] = (np.array([0, 0, 1, 1]), np.array([0.1, 0.2, 0.8, 0.9]))
    out["one_class"] = (np.ones(6, dtype=int), np.linspace(0, 1, 6))
    out["no_positive"] = (np.zeros(6, dtype=int), np.linspace(0, 1, 6))
    g = (np.arange(501) * 0.002).astype(np.float32)
    edge = np.concatenate([g, np.nextafter(g, np.float32(0)), np.nextafter(g, np.float32(1))]).clip(0, 1)
    out["grid_edges"] = (rng.integers(0, 2, len(edge)), edge.astype(np.float64))
    return out


@pytest.fixture(scope="module")
def data():
    return cases()


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(k, i, int(y), float(p)) for k, (ys, ps) in data.items() for i, (y, p) in enumerate(zip(ys, ps))]
    return spark.createDataFrame(rows, "g string, id long, y_true int, y_prob double").cache()


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def brute_ap(y, p):
    if y.sum() in (0, len(y)):
        return None
    total = 0.0
    for s in np.unique(p):
        at = p == s
        total += (at & (y == 1)).sum() / y.sum() * ((p >= s) & (y == 1)).sum() / (p >= s).sum()
    return total


def brute_hits(y, p, f):
    k = max(1, math.ceil(f * len(y)))
    order = np.lexsort((np.arange(len(y)), -p))[:k]
    return k, int(y[order].sum())


def close(a, b):
    assert (a is None) == (b is None), (a, b)
    if a is not None:
        assert a == pytest.approx(b, abs=1e-12)


def test_auc_and_ap(frame, data):
    auc = {r["g"]: r["roc_auc"] for r in M.roc_auc(frame, ["g"]).collect()}
    ap = {r["g"]: r["pr_auc"] for r in M.average_precision(frame, ["g"]).collect()}
    for k, (y, p) in data.items():
        close(auc[k], brute_auc(y, p))
        close(ap[k], brute_ap(y, p))


def test_auc_ignores_monotone_transforms(frame):
    a = {r["g"]: r["roc_auc"] for r in M.roc_auc(frame, ["g"]).collect()}
    squeezed = frame.withColumn("y_prob", F.col("y_prob") * 0.25)
    b = {r["g"]: r["roc_auc"] for r in M.roc_auc(squeezed, ["g"]).collect()}
    for k in a:
        close(a[k], b[k])


def test_top_hits_break_ties_by_id(frame, data):
    rows = M.enrichment(frame, ["g"], (0.01, 0.1, 0.35)).collect()
    assert len(rows) == 3 * len(data)
    for r in rows:
        y, p = data[r["g"]]
        assert (r["k"], r["hits"]) == brute_hits(y, p, r["fraction"])
        if y.sum() == 0:
            assert r["ef"] is None and r["nef"] is None
        else:
            assert r["ef"] == pytest.approx(r["hits"] / r["k"] / (y.sum() / len(y)))


def test_sweep_equals_the_full_matrix_in_float32(frame, data):
    grid = np.array([i * 0.002 for i in range(501)]).astype(np.float32)
    grid[-1] = 1.0
    got = {}
    for r in M.sweep(frame, ["g"]).collect():
        got.setdefault(r["g"], {})[round(r["threshold"] * 500)] = r
    for k, (y, p) in data.items():
        p32 = p.astype(np.float32)
        for i, t in enumerate(grid):
            r = got[k][i]
            assert np.float32(r["threshold"]) == t
            assert r["tp"] == ((p32 >= t) & (y == 1)).sum() and r["fp"] == ((p32 >= t) & (y == 0)).sum()
            assert r["tp"] + r["fn"] == y.sum() and r["fp"] + r["tn"] == (y == 0).sum()


def test_recall_does_not_rise_with_the_threshold(frame):
    rows = M.sweep(frame, ["g"], 101).orderBy("g", "threshold").collect()
    for a, b in zip(rows, rows[1:]):
        if a["g"] == b["g"]:
            assert b["recall"] <= a["recall"]


def test_best_thresholds(frame, data):
    rows = {r["g"]: r for r in M.best_thresholds(frame, ["g"], "max_mcc").collect()}
    assert "one_class" not in rows and "no_positive" not in rows
    assert rows["perfect"]["selected_f1"] == 1.0 and rows["perfect"]["selection_rule"] == "max_mcc"
    assert rows["perfect"]["max_recall_threshold"] == 0.0
    # lowest grid point above 0.2 separates the classes
    assert rows["perfect"]["selected_threshold"] == pytest.approx(0.202, abs=1e-6)
    assert M.best_thresholds(frame, ["g"], "nonsense").first()["selection_rule"] == "max_f1"


def test_exact_thresholds(frame):
    rows = {r["g"]: r for r in M.exact_thresholds(frame, ["g"]).collect()}
    assert rows["perfect"]["youden_threshold"] == 0.8 and rows["perfect"]["f1_threshold"] == 0.8


def test_candidates_first_wins(frame):
    r = {x["g"]: x for x in M.best_candidate(frame, ["g"], [0.5, 0.3, 0.7], "f1").collect()}
    assert r["perfect"]["threshold"] == 0.5 and r["perfect"]["score"] == 1.0


def test_nulls_and_empty_input(spark, frame):
    df = spark.createDataFrame([(0, 1, None), (1, 1, 0.9), (2, 0, 0.1)], "id long, y_true int, y_prob double")
    assert M.roc_auc(df, []).first()["roc_auc"] == 1.0
    assert M.best_thresholds(df, []).first()["n_oof"] == 2
    assert M.evaluate(frame.where("g = 'x'"), ["g"]).collect() == []


def test_reliability_matches_numpy(frame, data):
    rows = M.reliability(frame, ["g"], 5).collect()
    for k, (y, p) in data.items():
        edges = np.quantile(p, np.linspace(0, 1, 6))[1:-1]
        raw = np.searchsorted(edges, p)
        mine = sorted([r for r in rows if r["g"] == k], key=lambda r: r["bin"])
        used = np.unique(raw)
        assert len(mine) == len(used)
        for r, b in zip(mine, used):
            assert r["mean_pred"] == pytest.approx(p[raw == b].mean()) and r["frac_pos"] == pytest.approx(y[raw == b].mean())


def test_resampled_curves_match_numpy(frame, data):
    grid = np.linspace(0, 1, 400)
    rows = M.resampled_curves(frame, ["g"]).collect()
    for k, (y, p) in data.items():
        mine = sorted([(r["i"], r["y"]) for r in rows if r["g"] == k and r["kind"] == "roc"])
        if brute_auc(y, p) is None:
            assert not mine
            continue
        s = np.unique(p)[::-1]
        fpr = np.array([0.0] + [((p >= t) & (y == 0)).sum() / (y == 0).sum() for t in s])
        tpr = np.array([0.0] + [((p >= t) & (y == 1)).sum() / y.sum() for t in s])
        np.testing.assert_allclose([v for _, v in mine], np.interp(grid, fpr, tpr), atol=1e-9)


def test_r_squared(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.0, 0.5), ("b", 1.0, 0.2), ("b", 1.0, 0.4)],
                               "g string, y_true double, y_prob double")
    got = {r["g"]: r["r2"] for r in M.r_squared(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] is None
