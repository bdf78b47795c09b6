import numpy as np
import pytest

from hitsieve.operators import nearest as NN


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(5)
    ref = np.vstack([rng.normal(size=(150, 6)), np.tile([[1.0, 2, 3, 4, 5, 6]], (70, 1)), np.zeros((2, 6))])
    qry = np.vstack([rng.normal(size=(60, 6)), [[1.0, 2, 3, 4, 5, 6]] * 25, np.zeros((1, 6))])
    make = lambda m: spark.createDataFrame(
        [(i, [float(x) for x in r], [int(j) for j in np.nonzero(r > 0)[0]]) for i, r in enumerate(m)],
        "id long, x array<double>, bits array<int>")
    return ref, qry, make(ref), make(qry)


WAYS = [{}, {"broadcast_bytes": 0, "block_rows": 16}, {"broadcast_bytes": 0, "block_rows": 1000}]


@pytest.mark.parametrize("way", WAYS)
def test_knn(sets, way):
    ref, qry, dr, dq = sets
    d = np.sqrt(((qry[:, None] - ref[None]) ** 2).sum(2))
    got = {r["id"]: r["knn_mean"] for r in NN.knn_mean_distance(dq, dr.select("x"), "x", "id", 4, 6, **way).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(qry))], np.sort(d, 1)[:, :4].mean(1), atol=1e-9)


@pytest.mark.parametrize("way", WAYS)
def test_knn_within_leaves_self_out(sets, way):
    ref, _, dr, _ = sets
    d = np.sqrt(((ref[:, None] - ref[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: r["knn_mean"] for r in
           NN.knn_mean_distance(dr, dr.select("x"), "x", "id", 4, 6, within=True, **way).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(ref))], np.sort(d, 1)[:, :4].mean(1), atol=1e-9)


@pytest.mark.parametrize("way", WAYS)
def test_cosine(sets, way):
    ref, qry, dr, dq = sets
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) < 1e-12, 1, np.linalg.norm(m, axis=1, keepdims=True))
    want = (unit(qry) @ unit(ref).T).max(1)
    got = {r["id"]: r["cosine_max"] for r in NN.max_cosine(dq, dr, "x", "id", 6, **way).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(qry))], want, atol=1e-9)


@pytest.mark.parametrize("way", WAYS)
def test_tanimoto(sets, way):
    ref, qry, dr, dq = sets
    a, b = (qry > 0).astype(int), (ref > 0).astype(int)
    both = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None] - both
    want = (both / np.where(union == 0, 1, union)).max(1)
    got = {r["id"]: r["tanimoto_max"] for r in NN.max_tanimoto(dq, dr, "bits", "id", 6, **way).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(qry))], want, atol=1e-12)


def test_more_neighbours_than_rows_and_empty_reference(sets):
    ref, qry, dr, dq = sets
    few = dr.where("id < 3").select("x")
    d = np.sqrt(((qry[:, None] - ref[None, :3]) ** 2).sum(2))
    for way in WAYS[:2]:
        got = {r["id"]: r["knn_mean"] for r in NN.knn_mean_distance(dq, few, "x", "id", 9, 6, **way).collect()}
        np.testing.assert_allclose([got[i] for i in range(len(qry))], d.mean(1), atol=1e-9)
    got = NN.max_tanimoto(dq, dr.where("id < 0"), "bits", "id", 6).collect()
    assert {r["tanimoto_max"] for r in got} == {0.0}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("offset", [1e7, 1e8])
def test_knn_far_from_the_origin(spark, way, offset):
    rng = np.random.default_rng(9)
    ref, qry = rng.normal(size=(400, 5)) + offset, rng.normal(size=(40, 5)) + offset
    make = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, x array<double>")
    d = np.sort(np.sqrt(((qry[:, None] - ref[None]) ** 2).sum(2)), 1)[:, :3].mean(1)
    got = {r["id"]: r["knn_mean"] for r in NN.knn_mean_distance(make(qry), make(ref).select("x"), "x", "id", 3, 5, **way).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(qry))], d, rtol=1e-12)


def test_blocks_grow_instead_of_their_number(spark, monkeypatch):
    """A row goes once to every block of the other side: with the least block size alone, copies grow with the square of the rows."""
    monkeypatch.setattr(NN, "BLOCKS", 4)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, x array<double>")
    found = NN.nearest_distances(df, df.select("x"), "x", "id", 2, NN.Metric("euclidean", 6), broadcast_bytes=0, block_rows=2)
    want = np.sort(np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), 1)[:, :2]
    for r in found.collect():
        assert r["nearest"] == pytest.approx(want[r["id"]], abs=1e-9)
    # few cells of few blocks: the pivots, and with them the cells, follow the block size
    seen = []
    plain = NN.Metric.smallest
    q = rng.normal(size=(3, 6))
    monkeypatch.setattr(NN, "CELLS", 800)
    monkeypatch.setattr(NN.Metric, "distances", lambda self, a, b: seen.append(len(a) * len(b)) or np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)))
    plain(NN.Metric("euclidean", 6), q, m, np.ones(400, np.int64), 2)
    assert max(seen) <= 800  # what a task holds at once does not grow with the references


def test_scores_are_in_single_precision_where_it_suffices(monkeypatch):
    """Neighbours are ordered in single precision and measured in double; a row of large norm among near ones needs double for both."""
    rng = np.random.default_rng(8)
    plain, seen = NN.Metric.distances, []
    monkeypatch.setattr(NN.Metric, "distances", lambda self, a, b: seen.append((a.dtype, b.dtype)) or plain(self, a, b))
    q, m = rng.normal(size=(30, 8)), rng.normal(size=(3001, 8))
    copies = rng.integers(1, 4, len(m))
    for far, kinds in ((m, {np.float32}), (np.concatenate((m[:-1], m[:1] * 1e9)), {np.float32, np.float64})):
        seen.clear()
        for k in (1, 6):
            got = NN.Metric("euclidean", 8).smallest(q + 5.0, far + 5.0, copies, k)
            d = np.sqrt((((q + 5.0)[:, None] - (far + 5.0)[None]) ** 2).sum(2))
            want = [np.repeat(row[at], copies[at])[:k] for row, at in zip(d, d.argsort(1))]
            np.testing.assert_allclose(got, want, rtol=1e-6 if len(kinds) > 1 else 1e-12)
        assert {np.dtype(x) for x in kinds} == {x for pair in seen for x in pair}
    bits = (m > 0.3).astype(np.float32)
    got = NN.Metric("jaccard", 8).smallest(bits[:20], bits, copies, 5)
    both = bits[:20] @ bits.T
    union = bits[:20].sum(1)[:, None] + bits.sum(1) - both
    far = 1.0 - both / np.where(union == 0, 1.0, union)
    want = [np.repeat(row[at], copies[at])[:5] for row, at in zip(far, far.argsort(1, kind="stable"))]
    np.testing.assert_allclose(got, want, atol=1e-6)
