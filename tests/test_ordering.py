import numpy as np

from hitsieve.operators.ordering import exact_quantiles, ranked


def shapes(rng):
    """Value sets that are hard for cells: ties, constants, one far outlier, a dense spot."""
    return {
        "uniform": rng.random(500), "ties": rng.integers(0, 3, 400).astype(float), "constant": np.full(50, 0.25),
        "outlier": np.append(rng.random(300) * 1e-9, 1.0), "dense": 0.5 + rng.random(300) * 1e-12, "one": np.array([0.7]),
        "two": np.array([0.1, 0.9]),
    }


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = shapes(rng)
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    for r in exact_quantiles(df, ["g"], "v", probs).collect():
        assert r["n"] == len(data[r["g"]])
        want = np.quantile(data[r["g"]], probs)
        np.testing.assert_allclose([r[f"q{i}"] for i in range(5)], want, rtol=1e-12, atol=1e-15)


def test_quantiles_skip_nulls_and_accept_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    got = {r["g"]: r["q0"] for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {"a": 1.0}
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []


def test_ranks_in_both_directions(spark):
    rng = np.random.default_rng(1)
    vals = rng.permutation(1000)
    df = spark.createDataFrame([(int(i % 2), int(v)) for i, v in enumerate(vals)], "g int, v int")
    for down in (False, True):
        rows = ranked(df, ["g"], "v", descending=down).collect()
        for g in (0, 1):
            mine = sorted([r for r in rows if r["g"] == g], key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(500))
            assert [r["v"] for r in mine] == sorted([r["v"] for r in mine], reverse=down)
            assert all(r["rank_of"] == 500 for r in mine)


def test_ties_follow_the_tie_columns(spark):
    df = spark.createDataFrame([(1.0, i) for i in range(50)], "v double, id int")
    rows = ranked(df, [], "v", ties=["id"]).collect()
    assert all(r["rank"] == r["id"] for r in rows)


def test_string_ids_and_crowded_values(spark):
    words = [f"CH{i}" for i in range(300)]
    rows = ranked(spark.createDataFrame([(w,) for w in words], "id string"), [], "id").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(words)
    tiny = [i * 1e-13 for i in range(5000)]
    rows = ranked(spark.createDataFrame([(x,) for x in reversed(tiny)], "v double"), [], "v").collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["rank"])] == tiny


def test_no_partition_holds_a_crowd(spark):
    from hitsieve.operators import ordering
    cells = []
    keep = ordering._same
    try:
        ordering._same = lambda left, right, keys: cells.extend(left.groupBy("_part").count().collect()) or keep(left, right, keys)
        ranked(spark.range(20_000).selectExpr("id * 1e-15 as v"), [], "v").count()
    finally:
        ordering._same = keep
    sizes = [r["count"] for r in cells]
    assert max(sizes) < 3 * sum(sizes) / len(sizes) and len(sizes) > 1
