import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hitsieve.functions import scalar as S, text as X
from hitsieve.operators import clean as C, domain as D, features as FE, joins as J, screen as SC
from hitsieve.schemas import MissingPolicy, Rule


@pytest.fixture(scope="module")
def bits(spark):
    rng = np.random.default_rng(4)
    m = rng.random((300, 12)) < rng.random(12)
    m[:, 5] = m[:, 2]
    m[:, 7] = ~m[:, 3]
    m[:, 9] = False
    rows = [(i, [int(j) for j in np.nonzero(r)[0]]) for i, r in enumerate(m)]
    return m.astype(float), spark.createDataFrame(rows, "id long, bits array<int>")


def test_variances_and_pairs(bits):
    m, df = bits
    got = {r["bit"]: r for r in FE.bit_variances(df, "bits", 12, 0.05).collect()}
    for j in range(12):
        assert got[j]["variance"] == pytest.approx(m[:, j].var(), abs=1e-12)
        assert got[j]["kept"] == (m[:, j].var() >= 0.05)
    kept = FE.fit_mask(df, "bits", 12, 0.05, 0.9)
    assert (2 in kept) and (5 not in kept) and (3 in kept) and (7 not in kept) and (9 not in kept)
    assert FE.fit_mask(df, "bits", 12, 0.05, 0.9, max_bits=3) == sorted(j for j in range(12) if m[:, j].var() >= 0.05)


def test_nothing_passes_keeps_the_top_bit(spark):
    df = spark.createDataFrame([(i, [1] if i == 0 else []) for i in range(100)], "id long, bits array<int>")
    assert FE.fit_mask(df, "bits", 4, 0.05) == [1]


def test_pruning_prefers_variance_then_index():
    assert FE.prune_correlated({1: 0.1, 2: 0.2, 3: 0.1}, [(1, 2, 0.95), (1, 3, 0.95)]) == [2, 3]
    assert FE.prune_correlated({1: 0.2, 2: 0.2}, [(1, 2, 0.95)]) == [1]


def test_assembled_vectors(bits):
    m, df = bits
    t = df.withColumn("d", (F.col("id") * 2).cast("double"))
    out, contract = FE.assemble(t, t.where("id < 100"), "bits", [3, 0], ["d"])
    assert contract == [(0, "bit_3", "bit"), (1, "bit_0", "bit"), (2, "d", "descriptor")]
    ref = np.arange(100) * 2.0
    for r in out.select("id", vector_to_array("features_raw").alias("a"), vector_to_array("features_scaled").alias("b")).collect():
        i = r["id"]
        assert r["a"] == [m[i, 3], m[i, 0], 2.0 * i]
        assert r["b"][2] == pytest.approx((2.0 * i - ref.mean()) / ref.std())


def test_missing_policies(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "d double")
    out, names = FE.fill_missing(df, ["d"], MissingPolicy("nan_indicator", 9.0))
    assert names == ["d", "d__isna"] and sorted((r["d"], r["d__isna"]) for r in out.collect()) == [(1, 0), (9, 1), (9, 1), (9, 1)]
    out, names = FE.fill_missing(df, ["d"], MissingPolicy("zero", 9.0))
    assert names == ["d"] and sorted(r["d"] for r in out.collect()) == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        FE.fill_missing(df, ["d"], MissingPolicy("other"))


def test_array_scaling_with_a_constant_column(spark):
    m = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    df = spark.createDataFrame([(r.tolist(),) for r in m], "x array<double>")
    got = np.array([r["z"] for r in FE.scale_arrays(df, df, "x", "z").collect()])
    np.testing.assert_allclose(sorted(got[:, 0]), (m[:, 0] - m[:, 0].mean()) / m[:, 0].std())
    assert (got[:, 1] == 0).all()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    b = rng.normal(size=(15, 4)) * 2
    mu, sd = a.mean(0), a.std(0)
    a, b = (a - mu) / sd, (b - mu) / sd
    make = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, z array<double>")
    return a, b, make(a), make(b)


def test_leverage(cloud):
    a, b, da, db = cloud
    out, limit, p = D.leverage(da, db, "z", 0.95)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    want_p = int(np.searchsorted(np.cumsum(s ** 2) / (s ** 2).sum(), 0.95) + 1)
    assert p == want_p and limit == pytest.approx(3 * p / 80)
    t, q = a @ vt[:p].T, b @ vt[:p].T
    want = np.einsum("ij,jk,ik->i", q, np.linalg.pinv(t.T @ t), q)
    got = {r["id"]: r["leverage"] for r in out.collect()}
    np.testing.assert_allclose([got[i] for i in range(15)], want, rtol=1e-8)


def test_shrunk_covariance_and_distance(cloud):
    a, b, da, db = cloud
    mean, cov = D.shrunk_covariance(da, "z")
    n, d = a.shape
    x = a - a.mean(0)
    s = x.T @ x / n
    m = np.trace(s) / d
    d2 = ((s - m * np.eye(d)) ** 2).sum() / d
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n ** 2 / d
    w = min(b2, d2) / d2
    np.testing.assert_allclose(cov, (1 - w) * s + w * m * np.eye(d), atol=1e-9)
    got = {r["id"]: r["mahalanobis"] for r in D.mahalanobis(db, "z", mean, cov).collect()}
    c = b - a.mean(0)
    np.testing.assert_allclose([got[i] for i in range(15)], np.sqrt(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)), rtol=1e-8)


def test_map_occupancy(cloud):
    _, _, da, db = cloud
    weights = D.fit_map(da, "z", "id", 3, 3, 5)
    assert weights.shape == (9, 4)
    assert all(r["som_in"] for r in D.occupied_flag(da, da, "z", weights).collect())
    assert len(D.occupied_flag(db, da, "z", weights).collect()) == 15


def test_principal_components_by_share(cloud):
    a, _, da, _ = cloud
    loadings, share = FE.fit_pca(da.select(array_to_vector("z").alias("v")), "v", 0.95)
    s = np.linalg.svd(a, compute_uv=False) ** 2
    np.testing.assert_allclose(share, (s / s.sum())[:len(share)], rtol=1e-8)


def test_label_parsing(spark):
    words = spark.createDataFrame([("Active",), (" false ",), ("1",)], "l string")
    assert sorted(r["label"] for r in S.parse_labels(words, "l").collect()) == [0, 1, 1]
    numbers = spark.createDataFrame([("1.0",), ("2",), ("0",)], "l string")
    assert sorted(r["label"] for r in S.parse_labels(numbers, "l").collect()) == [0, 1, 2]
    mixed = spark.createDataFrame([("active",), ("2",)], "l string")
    with pytest.raises(Exception, match="unknown label"):
        S.parse_labels(mixed, "l").collect()


def test_potency_edges(spark):
    df = spark.createDataFrame([(0.0,), (-5.0,), (100.0,), (1e9,)], "value double")
    assert sorted(r["p"] for r in C.potency(df).collect()) == [7.0, float("inf")]


def test_residuals_and_zscore(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5)], "y int, p double")
    r = df.select(S.log_loss(F.col("y"), F.col("p")).alias("l"), S.deviance_residual(F.col("y"), F.col("p")).alias("d")).collect()
    assert r[0]["l"] == pytest.approx(1e-9, rel=1e-3) and r[0]["d"] > 0 and r[1]["d"] > 0
    one = spark.createDataFrame([(3.0,)], "x double")
    assert S.zscore(one, "x", "z").first()["z"] == 0.0


def test_text_features(spark):
    df = spark.createDataFrame([(1, "Ab  12 ab\nab."), (2, None), (3, "  ")], "id long, text string")
    out = {r["id"]: r for r in X.with_fingerprint(X.with_descriptors(df, list(X.DESCRIPTORS))).collect()}
    assert out[1]["n_tokens"] == 4 and out[1]["n_unique"] == 4 and out[1]["n_lines"] == 2
    assert out[1]["digit_ratio"] == pytest.approx(2 / 12)
    assert out[2]["bits"] == [] and out[3]["mean_token"] is None
    # "ab" counts once: three words, three pairs, two triples
    assert 0 < len(out[1]["bits"]) <= 8
    with pytest.raises(ValueError):
        X.with_descriptors(df, ["nothing"])


def test_fragments_and_keys(spark):
    df = spark.createDataFrame([("Na. C C O.xx",), ("aa.bb",), (" . ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.largest_fragment(F.col("t"))).collect()] == ["c c o", "aa", None, None]
    texts = [("Item 12 of 340 x",), (None,), ("item 9 of 7 x",), ("Item 12 of",), ("other start Item 12 of 340 x",), ("x",)]
    key = [r.k for r in X.with_template_key(spark.createDataFrame(texts, "t string"), "t", "k", 4).collect()]
    runs = [hashlib.md5(t.encode()).hexdigest() for t in ("item # of #", "# of # x", "other start item #", "start item # of")]
    assert key[0] == key[2] == min(runs[:2]) and key[1] == "" and key[3] == hashlib.md5(b"item # of").hexdigest()
    assert key[4] == min(runs) and len(set(key)) >= 4


def test_keys_and_stored_fingerprints_are_hashed_in_batches(spark):
    """A lambda of Spark is interpreted for each run of tokens, so no digest may stand in one."""
    texts = [(1, "A1 b\tC22  d\n\u03a3e \u0130 \u00e9 77x"), (2, "one\r two"), (3, " \n "), (4, None), (5, "a b c"), (6, "a b c d a b c 1 ΑΣ ΣΑ b")]
    df = spark.createDataFrame(texts, "id int, t string")
    keyed = X.with_template_key(df, "t", "k")
    tok = spark.createDataFrame(texts, "id int, t string").select("id", F.transform(X.tokens(F.col("t")), lambda w: F.regexp_replace(F.lower(w), "[0-9]+", "#")).alias("w"))
    for (_, got), (_, words) in zip(sorted((r.id, r.k) for r in keyed.collect()), sorted((r.id, r.w) for r in tok.collect())):
        runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
        assert got == (min(hashlib.md5(w.encode()).hexdigest() for w in runs) if words else "")
    store = SC.feature_store(df, "id", "t", ["n_chars", "n_tokens"], 2048)
    plain = X.with_fingerprint(df.withColumn("w", X.tokens(F.col("t"))), "t", tok="w")
    want = {r.id: r.bits for r in plain.collect()}
    assert {r.id: r.bits for r in store.collect()} == {i: want[i] for i in (1, 2, 5, 6)}
    for out in (keyed, store):
        assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rules_and_catalogue(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "a double")
    assert df.where(X.rule_filter([Rule("a", 2.0, 5.0)])).count() == 1
    assert [r[0] for r in df.select(X.rule_flag([Rule("a", None, 2.0)])).collect()] == [True, False, False]


def test_skewed_join_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("zz", 4)], "k string, v int")
    got = J.skew_safe_join(left, right, "k")
    assert got.count() == 2000 * 2 + 1 and got.select("i", "v").distinct().count() == 4001


def test_alignment(spark):
    pop = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    same = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.2)], "id long, text string, p double")
    other = spark.createDataFrame([(1, "a", 0.1), (2, "B", 0.2)], "id long, text string, p double")
    for preds in (same, other):
        assert {r["id"]: r["p"] for r in J.align_predictions(pop, preds).collect()} == {1: 0.1, 2: 0.2}
    with pytest.raises(ValueError):
        J.align_predictions(pop, same.where("id = 1"))


def test_lookup_without_a_row_fails(spark):
    t = spark.createDataFrame([("RF-C", 0, 0.4)], "model string, seed int, selected_threshold double")
    q = spark.createDataFrame([("rf_c", 0)], "model string, seed int")
    assert J.lookup_thresholds(q, t).first()["selected_threshold"] == 0.4
    with pytest.raises(Exception, match="no threshold row"):
        J.lookup_thresholds(q.withColumn("model", F.lit("other")), t).collect()


def test_runs_are_hashed_in_batches(spark):
    texts = [None, "", " \n\t ", "One", "a b a b a b a", "ΑΣ İstanbul\r\nΣΑΣ  straße\x0bx é", "\x00   z z z", "w" * 5000, " ".join(map(str, range(3000)))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for radius, n_bits in ((2, 2048), (0, 1000), (1, 7)):
        out = X.with_fingerprint(df, radius=radius, n_bits=n_bits)
        words = F.transform(X.tokens(F.col("text")), F.lower)
        ref = df.select("id", X.set_bits(words, radius, n_bits).alias("ref"))
        for r in out.join(ref, "id").collect():
            assert r["bits"] == r["ref"], r["id"]
    plan = out.where(F.size("bits") > 0)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and plan.count("ArrowEvalPython") == 1
