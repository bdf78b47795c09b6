import numpy as np
import pytest

from hitsieve.llm import vectorjoin


def plain(rows, cosine=0.98):
    unit = []
    for i, e, label in rows:
        ok = label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)
        v = np.array(e, np.float32).astype(float) if ok else None
        unit.append(None if v is None else v / np.sqrt((v * v).sum()))
    ids = [-1 if i is None else i for i, _, _ in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = unit[a], unit[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= cosine:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for k, i in enumerate(ids):
        low[root(k)] = min(i, low.get(root(k), i))
    return sorted((ids[k], links[k], low[root(k)], ids[k] == low[root(k)]) for k in range(len(rows)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for c in range(25):
            base = rng.normal(size=16)
            spread = rng.uniform(0.02, 0.12)
            for _ in range(rng.integers(1, 9)):
                rows.append((base + rng.normal(size=16) * spread).astype(np.float32).tolist() + [label])
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * 0.04).astype(np.float32).tolist() + [1] for _ in range(120)]
    rows += [np.float32(hot).tolist() + [1]] * 15
    rows = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    n = len(rows)
    good = rows[0][1]
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, good[:15] + [None], 0), (n + 4, good[:15] + [float("nan")], 0),
             (n + 5, good[:15] + [float("inf")], 0), (n + 6, good, None), (n + 7, good[:8], 0), (n + 8, good[:8], 0), (n + 9, [2 * x for x in good], 0)]
    return rows


@pytest.mark.parametrize("block,per_cell", [(1024, 2048), (16, 12)])
def test_against_all_pairs(spark, rows, block, per_cell, monkeypatch):
    monkeypatch.setattr(vectorjoin, "BLOCK", block)
    monkeypatch.setattr(vectorjoin, "PER_CELL", per_cell)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep int, cell string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectorjoin.range_join(table).collect())
    assert got == plain(rows)


def test_empty_and_repeated(spark):
    table = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [5.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectorjoin.range_join(table).collect())
    assert got == [(-1, 2, -1), (3, 2, -1), (3, 2, -1)]
    assert vectorjoin.range_join(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1024, 12])
def test_more_lengths_than_any_bound(spark, most, monkeypatch):
    monkeypatch.setattr(vectorjoin, "BLOCK", 8)
    monkeypatch.setattr(vectorjoin, "PER_CELL", 12)
    monkeypatch.setattr(vectorjoin, "MOST_PIVOTS", most)
    rng = np.random.default_rng(7)
    vectors = [rng.normal(size=n).astype(np.float32).tolist() for n in range(1, 70)]
    for size, n in ((90, 60), (91, 50), (92, 3)):
        base = rng.normal(size=size)
        vectors += [(base + rng.normal(size=size) * 0.1).astype(np.float32).tolist() for _ in range(n)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain(rows)
    assert sum(r[1] for r in want) > 1000
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectorjoin.range_join(table).collect()) == want


def test_different_vectors_of_one_id_are_different_nodes(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(None, a, 1), (None, c, 1), (5, a, 1), (6, b, 1), (6, c, 1), (7, b, 1)]
    got = vectorjoin.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [
        (-1, 3, -1), (-1, 3, -1), (5, 3, -1), (6, 1, 6), (6, 3, -1), (7, 1, 6)]


def test_doubles_are_not_rounded(spark):
    rows = [(1, [1e39, 0.0], 1), (2, [1e39, 1.0], 1), (3, [1e300, 0.0], 1), (4, [1e-300, 1e-303], 1), (5, [1.0, 0.2032], 1), (6, [0.0, 1e-320], 1)]
    got = vectorjoin.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 1), (6, 0)]
