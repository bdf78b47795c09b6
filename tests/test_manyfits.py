import threading
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hitsieve.operators import manyfits as MF, models as ML, shapley as SH, solvers as S, trees as T
from hitsieve.plans import q_models as QM
from hitsieve.session import scratch_path
from conftest import SMALL


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.concatenate(((rng.random((200, 6)) > 0.5).astype(float), rng.normal(size=(200, 4))), 1)
    y = (x[:, 6] + x[:, 0] - 0.5 + 0.5 * rng.normal(size=200) > 0).astype(float)
    return x, y, np.arange(200) * 7 + 3


def sharded(make, rows, parts=3):
    """Runs a generator in each of some threads over its rows; they meet as the tasks of a stage do."""
    meet, said, out = threading.Barrier(parts), [None] * parts, [None] * parts

    def exchange(k):
        def call(op, part):
            said[k] = part
            meet.wait(60)
            got = np.concatenate(said) if op == "cat" else np.minimum.reduce(said) if op == "min" else np.sum(said, 0)
            meet.wait(60)
            return got
        return call

    def work(k):
        out[k] = MF.run_alone(make(rows % parts == k), exchange(k))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(parts)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def plain_boost(x, y, s):
    """One model, node by node, from sorted values."""
    margin, trees = np.zeros(len(x)), []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, value = p - y, p * (1 - p), np.zeros(len(x))

        def grow(at, depth):
            G, H = g[at].sum(), h[at].sum()
            best = (T.MIN_GAIN, None)
            if depth < s.depth:
                for f in range(x.shape[1]):
                    seen = np.unique(x[:, f])  # borders follow from all training rows
                    for cut in (seen[1:] + seen[:-1]) / 2:
                        left = at[x[at, f] <= cut]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl < s.min_hessian or H - hl < s.min_hessian:
                            continue
                        gain = gl ** 2 / (hl + s.l2) + (G - gl) ** 2 / (H - hl + s.l2) - G ** 2 / (H + s.l2)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
            if best[1] is None:
                value[at] = -s.rate * G / (H + s.l2)
                return
            f, cut = best[1]
            grow(at[x[at, f] <= cut], depth + 1)
            grow(at[x[at, f] > cut], depth + 1)

        grow(np.arange(len(x)), 0)
        margin += value
        trees.append(value)
    return margin


def test_boosting_equals_a_plain_grower(data):
    x, y, rows = data
    x = np.round(x, 1)  # at most 64 values a feature
    s = T.Boost(rounds=8, depth=4, rate=0.3, min_hessian=1.0)
    _, margin = MF.run_alone(T.boost(x, y[None], rows, np.ones((1, 200), bool), [s]))
    assert margin[0] == pytest.approx(plain_boost(x, y, s), abs=1e-9)


def test_boosting_settings_change_the_model_and_models_do_not_mix(data):
    x, y, rows = data
    sets = [T.Boost(rounds=6), T.Boost(rounds=9, depth=3, subsample=0.7, columns=0.5), T.Boost(rounds=6, min_hessian=5.0), T.Boost(rounds=6, l2=10.0)]
    use = np.ones((4, 200), bool)
    use[1, :50] = False
    target = np.stack([y, 1 - y, y, y])
    trees, many = MF.run_alone(T.boost(x, target, rows, use, sets))
    assert [len(t) for t in trees] == [6, 9, 6, 6]
    for k, s in enumerate(sets):
        one, alone = MF.run_alone(T.boost(x, target[k:k + 1], rows, use[k:k + 1], [s]))
        assert many[k] == pytest.approx(alone[0], abs=1e-12)
        assert alone[0] == pytest.approx(sum(t.predict(x) for t in one[0]), abs=1e-12)
    assert len({m.tobytes() for m in many}) == 4


def test_random_cuts_follow_seed_and_settings(data):
    x, y, rows = data
    use = np.ones((1, 200), bool)

    def run(**k):
        return MF.run_alone(T.forest(x, y[None], rows, use, [T.Forest(**{"trees": 12, "random_cuts": True, **k})]))

    trees, _ = run()
    for t in trees[0]:  # every cut lies between the ends of its own node's rows, leaves are pure unless equal rows differ
        stack = [(0, np.arange(200))]
        while stack:
            node, at = stack.pop()
            f = t.feature[node]
            if f < 0:
                assert t.value[node] == pytest.approx(y[at].mean()) and (len(at) == 1 or len(set(y[at])) == 1)
                continue
            assert x[at, f].min() <= t.cut[node] < x[at, f].max()
            stack += [(t.left[node], at[x[at, f] <= t.cut[node]]), (t.right[node], at[x[at, f] > t.cut[node]])]
    cuts = lambda found: [t.cut.tolist() for t in found[0]]
    assert cuts(run()[0]) == cuts(trees) != cuts(run(seed=5)[0])
    smaller = run(min_split=20)[0][0]
    assert np.mean([len(t.feature) for t in smaller]) < np.mean([len(t.feature) for t in trees[0]])
    assert max(_depth(t) for t in run(depth=3)[0][0]) == 3
    assert T.Forest(features="sqrt").tried(100) == 10 and T.Forest(features="log2").tried(64) == 6 and T.Forest(features=0.5).tried(9) == 4


def _depth(t, node=0):
    return 0 if t.feature[node] < 0 else 1 + max(_depth(t, t.left[node]), _depth(t, t.right[node]))


def test_forest_takes_the_best_cut_of_its_features(data):
    x, y, rows = data
    trees, _ = MF.run_alone(T.forest(np.round(x, 1), y[None], rows, np.ones((1, 200), bool), [T.Forest(trees=3, depth=1, features=1.0)]))
    for k, t in enumerate(trees[0]):
        w = T.drawn(rows, 42, k)
        best = max(_gini_gain(np.round(x[:, f], 1), c, y, w) for f in range(10) for c in np.unique(np.round(x[:, f], 1))[:-1])
        assert _gini_gain(np.round(x[:, t.feature[0]], 1), t.cut[0], y, w) == pytest.approx(best)
    assert T.drawn(np.arange(100_000), 1, 1).mean() == pytest.approx(1.0, abs=0.02)


def _gini_gain(v, cut, y, w):
    score = 0.0
    for side in (v <= cut, v > cut):
        n = w[side].sum()
        if (w[side] > 0).sum() < 1:
            return -np.inf
        score += ((w * y)[side].sum() ** 2 + (w * (1 - y))[side].sum() ** 2) / n
    return score


def test_any_sharding_gives_the_same_models(data):
    x, y, rows = data
    use, target = np.ones((2, 200), bool), np.stack([y, 1 - y])
    use[1, 150:] = False
    makes = {
        "boost": lambda m: T.boost(x[m], target[:, m], rows[m], use[:, m], [T.Boost(rounds=4, subsample=0.8)] * 2),
        "forest": lambda m: T.forest(x[m], target[:, m], rows[m], use[:, m], [T.Forest(trees=5), T.Forest(trees=5, random_cuts=True)]),
        "linear": lambda m: S.linear(x[m], target[:, m], use[:, m], np.array([0.01, 0.0]), np.array([0.0, 0.01])),
        "network": lambda m: S.network(x[m], y[m], rows[m], use[0, m], (8, 4), epochs=15),
        "machine": lambda m: S.machine(x[m], y[m], use[0, m], tol=1e-8),
    }
    for name, make in makes.items():
        whole, parts = MF.run_alone(make(np.ones(200, bool))), sharded(make, rows)
        if name in ("boost", "forest"):
            for part in parts:
                for a, b in zip(whole[0], part[0]):
                    assert [t.feature.tolist() for t in a] == [t.feature.tolist() for t in b]
                    assert all(np.allclose(t.value, u.value, atol=1e-9) for t, u in zip(a, b))
        elif name == "machine":
            margin = lambda m: S.kernel(x, m[0], m[3]) @ m[1] + m[2]
            assert all(np.allclose(margin(whole), margin(p), atol=1e-5) for p in parts)
        else:
            assert all(np.allclose(a, b, atol=1e-6) for p in parts for a, b in zip(whole, p))


def test_kernel_machine_is_optimal(data):
    """Margins of a plain projected ascent on the dual, far beyond the solver's tolerance."""
    x, y, _ = data
    k, s, c = S.kernel(x, x, 0.1), np.where(y > 0, 1.0, -1.0), 1.0
    a, b = S.dual(k, s, c, tol=1e-9)
    q = k * np.outer(s, s)
    assert abs(a @ s) < 1e-9 and (a >= 0).all() and (a <= c).all()
    plain = np.zeros(200)
    for _ in range(1500):
        step = plain + (1.0 - q @ plain) / np.linalg.norm(q, 2)
        low, high = -1e3, 1e3
        for _ in range(80):  # back to the box and the plane
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(step - mid * s, 0, c) @ s > 0 else (low, mid)
        plain = np.clip(step - (low + high) / 2 * s, 0, c)
    value = lambda v: v.sum() - 0.5 * v @ q @ v
    assert value(a) >= value(plain) - 1e-7
    assert k @ (a * s) == pytest.approx(k @ (plain * s), abs=1e-2)


def test_linear_columns_equal_single_fits_of_spark(spark, data):
    x, y, _ = data
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "v array<double>, label double").withColumn("f", array_to_vector("v"))
    sets = [{"C": c, "penalty": p} for c in (0.1, 10.0) for p in ("l1", "l2")]
    one = np.ones((4, 200), bool)
    strength = np.array([1 / (s["C"] * 200) for s in sets])
    sparse = np.array([s["penalty"] == "l1" for s in sets])
    w = MF.run_alone(S.linear(x, np.repeat(y[None], 4, 0), one, strength * sparse, strength * ~sparse))
    for k, s in enumerate(sets):
        model = ML.logistic_regression(s, "f", 200).setTol(1e-12).fit(df)
        assert w[:-1, k] == pytest.approx(model.coefficients.toArray(), abs=1e-5) and w[-1, k] == pytest.approx(model.intercept, abs=1e-5)
        alone = MF.run_alone(S.linear(x, y[None], one[:1], (strength * sparse)[k:k + 1], (strength * ~sparse)[k:k + 1]))
        assert w[:, k] == pytest.approx(alone[:, 0], abs=1e-6)


def test_network_gradient_and_settings(data):
    x, y, rows = data
    rng = np.random.default_rng(0)
    layers = [rng.normal(size=s) * 0.5 for s in ((10, 5), (5,), (5, 1), (1,))]
    _, grads = S._backward(layers, x, y)
    for k, p in enumerate(layers):
        at = tuple(0 for _ in p.shape)
        up, down = ([q.copy() for q in layers] for _ in range(2))
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert grads[k][at] == pytest.approx((S._backward(up, x, y)[0] - S._backward(down, x, y)[0]) / 2e-6, rel=1e-4, abs=1e-6)
    run = lambda **k: MF.run_alone(S.network(x, y, rows, np.ones(200, bool), (8,), epochs=10, **k))
    base = run()
    assert all(np.array_equal(a, b) for a, b in zip(base, run()))
    for other in ({"alpha": 0.5}, {"rate": 0.01}, {"seed": 1}):
        assert not np.allclose(base[0], run(**other)[0])


@pytest.mark.parametrize("family", ["LR", "RFC", "ETC", "XGBC", "MLP", "SVC"])
def test_held_rows_and_models_agree(spark, data, family):
    """Probabilities of the fitting job are those of the model it keeps, also after it was saved."""
    x, y, _ = data
    rows = [(i, r.tolist(), [float(t), float(1 - t)], i % 3 if i < 180 else -1) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_row long, v array<double>, y array<double>, fold int").withColumn("f", array_to_vector("v")).cache()
    params = {"n_estimators": 10, "hidden_layer_sizes": (8,), "max_iter": 30}
    jobs = [MF.Job(family, params, 1, 0), MF.Job(family, params, 1, 2), MF.Job(family, params, 1, 2, label=1)]
    got = MF.fit_many(df, "f", "y", jobs, "fold", keep=True).collect()
    assert sorted((r["job"], r["_row"]) for r in got if r["model"] is None) == sorted(
        (k, i) for k, j in enumerate(jobs) for i in range(200) if i >= 180 or i % 3 == j.skip)
    blob = next(bytes(r["model"]) for r in got if r["job"] == 1 and r["model"] is not None)
    import base64
    model = MF.ArrayModel(blob=base64.b64encode(blob).decode(), features="f")
    path = scratch_path(spark, "model")
    model.save(path)
    scored = {r["_row"]: r["y_prob"] for r in ML.with_probability(MF.ArrayModel.load(path).transform(df)).collect()}
    for r in got:
        if r["job"] == 1 and r["model"] is None:
            assert scored[r["_row"]] == pytest.approx(r["p"], abs=1e-9)
    assert MF.fit_many(df.where("false"), "f", "y", jobs, "fold").count() == 0


def test_shards_meet_in_a_barrier_stage(spark, data):
    x, y, _ = data
    df = spark.createDataFrame([(i, r.tolist(), [float(t)]) for i, (r, t) in enumerate(zip(x, y))], "_row long, v array<double>, y array<double>").withColumn("f", array_to_vector("v"))
    jobs = [MF.Job("RFC", {"n_estimators": 3, "max_depth": 2}), MF.Job("XGBC", {"n_estimators": 2, "max_depth": 2})]
    parts = MF.fit_many(df, "f", "y", jobs, scope="all", shard_cells=1000)
    whole = MF.fit_many(df, "f", "y", jobs, scope="all")
    a, b = ({(r["job"], r["_row"]): r["p"] for r in t.collect()} for t in (parts, whole))
    assert a.keys() == b.keys() and len(a) == 400
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9
    with pytest.raises(ValueError):
        MF.fit_many(df, "f", "y", jobs, shard_cells=10)


@pytest.mark.parametrize("family", ["RFC", "ETC"])
def test_a_forest_in_parts_is_the_same_forest(spark, data, family):
    """One forest is shared by the slots, as prediction and as model, and equals the forest of one task to the last bit."""
    x, y, _ = data
    df = spark.createDataFrame([(i, r.tolist(), [float(t)], i % 3 - 1) for i, (r, t) in enumerate(zip(x, y))], "_row long, v array<double>, y array<double>, fold int").withColumn("f", array_to_vector("v")).cache()
    job = MF.Job(family, {"n_estimators": 21})
    parts, split = MF._fitted(df, "f", "y", [job], "fold", "held", False, "_row", MF.SHARD_CELLS, True)
    assert split == {0} and parts.rdd.getNumPartitions() == 3  # of 8 trees each
    got = {r["_row"]: r["p"] for r in MF.fit_many(df, "f", "y", [job], "fold").collect()}
    alone = {r["_row"]: r["p"] for r in MF.fit_many(df, "f", "y", [job], "fold", keep=True).collect() if r["model"] is None}
    assert got == alone and len(got) == 67
    model = MF.fit_models(df, "f", "y", [job], fold="fold")[0].fitted
    assert len(model.trees) == 21
    some = sorted(got)
    assert model.margin(x[some]) == pytest.approx([got[i] for i in some], abs=1e-9)


def test_kernel_machine_never_holds_the_whole_matrix(data, monkeypatch):
    """Working sets far smaller than the rows, and small blocks, reach the optimum of the whole matrix."""
    x, y, _ = data
    shapes, plain = [], S.kernel
    monkeypatch.setattr(S, "kernel", lambda a, b, g: shapes.append((len(a), len(b))) or plain(a, b, g))
    monkeypatch.setattr(S, "KERNEL_CELLS", 400)
    v, times, b, gamma, _ = MF.run_alone(S.machine(x, y, np.ones(200, bool), 1.0, 0.1, 1e-7, added=20))
    assert max(m * n for m, n in shapes) <= 400
    s = np.where(y > 0, 1.0, -1.0)
    k = plain(x, x, 0.1)
    a, offset = S.dual(k, s, 1.0, tol=1e-9)
    assert S.kernel_sum(x, v, times, gamma) + b == pytest.approx(k @ (a * s) + offset, abs=1e-5)


def test_kernel_machine_in_shards_beside_other_families(spark, data, monkeypatch):
    """A barrier stage and plain lanes in one result, as the queries of several families unite them."""
    x, y, _ = data
    df = spark.createDataFrame([(i, r.tolist(), [float(t)], i % 3 - 1) for i, (r, t) in enumerate(zip(x, y))], "_row long, v array<double>, y array<double>, fold int").withColumn("f", array_to_vector("v")).cache()
    jobs = [MF.Job("LR"), MF.Job("SVC"), MF.Job("RFC", {"n_estimators": 9})]
    whole = {(r["job"], r["_row"]): r["p"] for r in MF.fit_many(df, "f", "y", jobs, "fold").collect()}
    monkeypatch.setattr(MF, "KERNEL_CELLS", 800)
    both = MF.fit_many(df, "f", "y", jobs, "fold")
    parts = {(r["job"], r["_row"]): r["p"] for r in both.unionByName(both.where("false")).collect()}
    assert parts.keys() == whole.keys() and len(parts) == 3 * 67
    assert max(abs(parts[k] - whole[k]) for k in whole) < 5e-3


# ---- attributions ----------------------------------------------------------------------------------------------

def enumerated(f, x, z):
    """Shapley values by their definition over all subsets."""
    d = x.shape[1]
    out = np.zeros(x.shape)
    worth = {}
    for s in range(d + 1):
        for some in combinations(range(d), s):
            mixed = np.repeat(z[None], len(x), 0)
            mixed[:, :, list(some)] = x[:, None, list(some)]
            worth[some] = f(mixed.reshape(-1, d)).reshape(len(x), len(z)).mean(1)
    for i in range(d):
        for some in worth:
            if i not in some:
                times = factorial(len(some)) * factorial(d - len(some) - 1) / factorial(d)
                out[:, i] += times * (worth[tuple(sorted((*some, i)))] - worth[some])
    return out, worth[()][0]


@pytest.mark.parametrize("family", ["RFC", "ETC", "XGBC"])
def test_tree_values_equal_all_subsets(spark, data, family):
    x, y, rows = data
    x = x[:, 2:]
    df = spark.createDataFrame([(i, r.tolist(), [float(t)]) for i, (r, t) in enumerate(zip(x, y))], "_row long, v array<double>, y array<double>").withColumn("f", array_to_vector("v")).cache()
    model = MF.fit_models(df, "f", "y", [MF.Job(family, {"n_estimators": 7, "max_depth": 5})])[0].fitted
    want, base = enumerated(model.margin, x[:6], x[100:112])
    import base64
    blob = base64.b64decode(MF.fit_models(df, "f", "y", [MF.Job(family, {"n_estimators": 7, "max_depth": 5})])[0].getOrDefault("blob"))
    got = SH.tree_attribution(df.where("_row < 6"), df.where("_row >= 100 and _row < 112"), "v", [f"x{i}" for i in range(8)], "_row", blob).collect()
    assert len(got) == 48
    for r in got:
        assert r["value"] == pytest.approx(want[r["_row"], int(r["feature"][1:])], abs=1e-12) and r["base"] == pytest.approx(base, abs=1e-12)


def test_kernel_values_equal_all_subsets(spark, data):
    x, y, rows = data
    x = x[:, 3:]
    model = MF.run_alone(S.machine(x, y, np.ones(200, bool)))
    predict = lambda t: 1 / (1 + np.exp(-(S.kernel(t, model[0], model[3]) @ model[1] + model[2])))
    want, base = enumerated(predict, x[:4], x[50:60])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "_row long, v array<double>")
    names = [f"x{i}" for i in range(7)]
    got = SH.kernel_attribution(df.where("_row < 4"), df.where("_row between 50 and 59"), "v", names, "_row", predict).collect()
    for r in got:
        assert r["value"] == pytest.approx(want[r["_row"], int(r["feature"][1:])], abs=1e-9) and r["base"] == pytest.approx(base)
    some = SH.kernel_attribution(df.where("_row < 4"), df.where("_row between 50 and 59"), "v", names, "_row", predict, samples=60).collect()
    whole = predict(x[:4])
    for i in range(4):
        assert sum(r["value"] for r in some if r["_row"] == i) == pytest.approx(whole[i] - base, abs=1e-9)
    masks, weights = SH.coalitions(12, 300, 1)
    assert len({m.tobytes() for m in masks}) == len(masks) <= 300 and weights.sum() == pytest.approx(1.0)


def test_tree_rows_are_dealt_over_the_slots(spark):
    """Rows of one partition go to all slots; a chain of 60 features has more flags than a number holds."""
    rng, d = np.random.default_rng(6), 60
    inner = np.arange(2 * d + 1) % 2 == 0
    inner[-1] = False
    chain = T.Tree(np.where(inner, np.arange(2 * d + 1) // 2, -1), np.zeros(2 * d + 1), np.where(inner, np.arange(2 * d + 1) + 1, -1),
                   np.where(inner, np.arange(2 * d + 1) + 2, -1), np.where(inner, 0.0, rng.random(2 * d + 1)))
    x, z = rng.random((12, d)) - 0.05, rng.random((9, d)) - 0.1
    blob = MF._packed("XGBC", MF._of_trees([chain]))
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>").coalesce(1)
    out = SH.tree_attribution(frame(x), frame(z), "v", [f"x{i}" for i in range(d)], "id", blob)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    whole, base = chain.predict(x), chain.predict(z).mean()
    sums = {r["id"]: r for r in out.groupBy("id").agg({"value": "sum", "base": "max"}).collect()}
    for i in range(12):
        assert sums[i]["sum(value)"] + sums[i]["max(base)"] == pytest.approx(whole[i], abs=1e-12) and sums[i]["max(base)"] == pytest.approx(base)


def test_flags_are_summed_as_histograms_are():
    rng = np.random.default_rng(12)
    x = np.concatenate(((rng.random((400, 9)) < 0.3).astype(float), rng.normal(size=(400, 3)), np.full((400, 1), 7.0)), 1)
    for flags in (x[:, :9], 2 * x[:, :9] - 3):  # bits as they are, and two other values
        x = np.concatenate((flags, x[:, 9:]), 1)
        bins = T.Bins(MF.run_alone(T.borders(x)), x)
        row = rng.choice(400, 500)
        slot, stats = rng.integers(0, 5, 500), [rng.integers(-99, 99, 500) / 64.0 for _ in range(2)]
        assert T.Flags.many(bins) and (T.Flags(bins, x).histogram(bins, slot, row, stats, 5) == T._histogram(bins, slot, row, stats, 5)).all()
        assert (T.Flags(bins, x[:0]).histogram(bins, slot[:0], row[:0], [s[:0] for s in stats], 5) == 0).all()
    assert not T.Flags.many(T.Bins(MF.run_alone(T.borders(x[:, 9:])), x[:, 9:]))


def test_a_library_of_labelled_fingerprints_is_one_shard():
    """20,598 labelled rows of 0.1 GB with 2,048 bits and 12 descriptors: two shards met up to seven times a round, a second each."""
    assert 20_598 * (2048 + 12) <= MF.SHARD_CELLS


@pytest.mark.parametrize("random_cuts", [True, False])
def test_rows_stay_in_the_order_of_their_open_nodes(data, monkeypatch, random_cuts):
    """A feature's values of a node are neighbours at every level, so no level sorts the values of all tried features."""
    x, y, _ = data
    name, seen = "_random_cuts" if random_cuts else "_best_cuts", []
    plain = getattr(T, name)

    def watched(x_, slot, *more):
        seen.append(bool((np.diff(slot) >= 0).all()))
        return plain(x_, slot, *more)

    monkeypatch.setattr(T, name, watched)
    MF.run_alone(T.forest(x, y[None].astype(float), np.arange(len(x)), np.ones((1, len(x)), bool), [T.Forest(4, random_cuts=random_cuts)]))
    assert len(seen) > 2 and all(seen)


def test_kernel_machine_is_taken_apart_for_coalitions():
    """Means by products of kernels are those of mixed rows, for masks with and without their complement."""
    rng, d = np.random.default_rng(9), 20
    predict = MF.Predictor(MF._packed("SVC", {"vectors": rng.normal(size=(300, d)), "times": rng.normal(size=300), "offset": np.array(0.1),
                                              "gamma": np.array(1 / d), "sigmoid": np.array([1.3, 0.2])}))
    x, z = rng.normal(size=(7, d)), rng.normal(size=(9, d))
    masks, _ = SH.coalitions(d, 300, 1)
    for some in (masks, masks[:101]):
        assert SH.coalition_means(predict, x, z, some) == pytest.approx(SH.coalition_means(lambda m: predict(m), x, z, some), abs=1e-12)


def test_kernel_attribution_explains_every_external_row(spark):
    """No sample of rows or background stands between the query and the operator."""
    got = QM.kernel_attribution(spark, SMALL).groupBy("id").count()
    want = {r["vec_id"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 5 = 0").collect()}
    assert {r["id"] for r in got.collect()} == want and got.select("count").distinct().count() == 1


def test_trees_are_dealt_over_tasks_and_rows_meet_them_together(spark, monkeypatch):
    """A forest's trees are parts that add up to the values by all of them in turn, and no task repeats a tree for some of its rows."""
    rng = np.random.default_rng(13)
    x = np.concatenate(((rng.random((300, 4)) > 0.5).astype(float), rng.normal(size=(300, 5))), 1)
    y = (x[:, 5] + x[:, 0] > 0.5).astype(float)
    trees, _ = MF.run_alone(T.forest(x, y[None], np.arange(300), np.ones((1, 300), bool), [T.Forest(40)]))
    blob = MF._packed("RFC", MF._of_trees(trees[0]))
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>").repartition(5)
    out = SH.tree_attribution(frame(x[:60]), frame(x[100:140]), "v", [f"x{i}" for i in range(9)], "id", blob)
    want, base = SH.tree_values(trees[0], x[:60], x[100:140])
    found = out.collect()
    got = {(r["id"], r["feature"]): (r["value"], r["base"]) for r in found}
    assert len(found) == len(got) == 540
    for (i, name), (value, at) in got.items():
        assert value == pytest.approx(want[i, int(name[1:])] / 40, abs=1e-12) and at == pytest.approx(base / 40, abs=1e-12)
    parts = SH._TreeRows(blob, x[100:140], [[0, 1], [2]])
    import pyarrow as pa
    sent = pa.RecordBatch.from_pydict({"id": [0, 1], "_part": [1, 1], "_x": [x[0].tolist(), x[1].tolist()]})
    assert next(iter(parts(iter([sent])))).column("_v")[0].as_py()[:9] == pytest.approx(SH.tree_values(trees[0][2:3], x[:2], x[100:140])[0][0] / 40)
