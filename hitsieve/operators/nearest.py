"""Exact nearest-reference joins: k nearest by Euclidean distance, best cosine, best Tanimoto.

Two exact ways. A reference set whose checked size fits the bound is broadcast and the queries stream past it
without a shuffle. Beyond the bound both sides are cut into blocks:

* identical vectors are counted once, so a group of copies costs one row;
* a few reference rows become pivots and every reference row belongs to its nearest pivot's cell;
* the triangle inequality gives a query an upper bound on its k-th distance and a lower bound per cell, and only
  cells within the bound are visited (both distances, Euclidean and 1 - Tanimoto, are metrics);
* large cells and the queries that visit them are split by hash into blocks of bounded size; a block pair gives
  only the k best distances per query, never the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from hitsieve.session import cut_lineage

BROADCAST_BYTES = 64 << 20
MAX_PIVOTS = 128
CELLS = 1 << 22  # distances, or coordinates of candidates, that a task holds at once
BLOCK_BYTES = 8 << 20  # reference rows of a block
BLOCKS = 32  # blocks that more rows than these hold make larger, up to `BLOCK_BYTES`, not more
GROUPS = 32  # scores of which the least one is looked at first
OVER = 64  # groups that a query may look into, beyond those it has to, before its scores are in double precision
ROUNDING = 8 * np.finfo(np.float64).eps


@dataclass(frozen=True)
class Metric:
    """Distance between blocks of rows; `width` is the vector length, or the number of bits for sets."""

    name: str
    width: int
    center: tuple[float, ...] | None = None

    def matrix(self, rows) -> np.ndarray:
        if self.name == "euclidean":
            x = np.array([np.asarray(r, dtype=np.float64) for r in rows]).reshape(len(rows), self.width)
            return x if self.center is None else x - np.array(self.center)
        out = np.zeros((len(rows), self.width), dtype=np.float32)
        for i, r in enumerate(rows):
            out[i, np.asarray(r, dtype=np.int64)] = 1.0
        return out

    def distances(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.name == "euclidean":
            # norms go with the product, the rest is in place: a matrix of a task's whole allowance is held once
            own, norms = (q * q).sum(1)[:, None], (r * r).sum(1)[:, None]
            d2 = np.concatenate((-2.0 * q, own, np.ones_like(own)), 1) @ np.concatenate((r, np.ones_like(norms), norms), 1).T
            return np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)
        both = (q @ r.T).astype(np.float64)
        union = q.sum(1)[:, None] + r.sum(1)[None, :] - both
        return 1.0 - both / np.where(union == 0, 1.0, union)

    def error(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Bound on the rounding error of the squared Euclidean distances of each query to any row; 0 for sets."""
        if self.name != "euclidean" or not len(r):
            return np.zeros(len(q))
        return ROUNDING * (self.width + 8) * ((q * q).sum(1) + (r * r).sum(1).max())

    def smallest(self, q: np.ndarray, r: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
        """The k smallest distances per query (rows sorted, padded with inf), counting copies of a reference row.

        Scores in single precision order the reference rows of a query within a bound on their error. The k-th of the least
        scores of `GROUPS` rows each is no less than the k-th score, so only groups that reach it are looked into. Both sides
        are centred on the mean of the rows, every row within the error bound of the k-th is a candidate, however many there
        are, and candidates are measured again in double precision, from the differences. Where single precision leaves
        too many candidates, as with few rows of large norms, scores are in double precision.
        """
        out = np.full((len(q), k), np.inf)
        if not len(r):
            return out
        euclid, few = self.name == "euclidean", min(len(r), k)
        if euclid:
            middle = r.mean(axis=0)
            q, r = q - middle, r - middle
        step = max(1, CELLS // max(len(r), 1))
        for s in range(0, len(q), step):
            part = q[s:s + step]
            row, at = self._candidates(part, r, few, np.float32)
            if row is None:
                row, at = self._candidates(part, r, few, np.float64)
            best = np.empty(len(row))
            chunk = max(1, CELLS // 4 // self.width)
            for i in range(0, len(row), chunk):
                x, y = part[row[i:i + chunk]], r[at[i:i + chunk]]
                if euclid:
                    best[i:i + chunk] = np.sqrt(((x - y) ** 2).sum(1))
                else:
                    both = (x * y).sum(1, dtype=np.float64)
                    union = x.sum(1, dtype=np.float64) + y.sum(1, dtype=np.float64) - both
                    best[i:i + chunk] = 1.0 - both / np.where(union == 0, 1.0, union)
            order = np.lexsort((best, row))
            times = np.minimum(copies[at[order]], k)
            row, best = np.repeat(row[order], times), np.repeat(best[order], times)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, best, place = (v[place < k] for v in (row, best, place))
            out[s + row, place] = best
        return out

    def _candidates(self, q: np.ndarray, r: np.ndarray, few: int, kind: type) -> tuple[np.ndarray | None, np.ndarray | None]:
        """(query, reference row) of every pair that may be among the `few` nearest by scores of this kind; None where they are too many."""
        single, n, eps = kind is np.float32, len(r), np.finfo(kind).eps
        if self.name == "euclidean":
            error = self.error(q, r) * (eps / np.finfo(np.float64).eps)
            if single and not error.max() < 1e25:
                return None, None
            score = self.distances(q.astype(kind), r.astype(kind))
        else:
            both = q.astype(kind) @ r.astype(kind).T
            score = (q.sum(1)[:, None] + r.sum(1)).astype(kind)
            score -= both
            np.maximum(score, 1.0, out=score)
            np.divide(both, score, out=score)
            np.negative(score, out=score)
        wide = n // GROUPS if n >= GROUPS * max(few, GROUPS) else n
        deep, rest = n // wide, n % wide
        grouped = score[:, :n - rest].reshape(len(q), deep, wide)
        least = grouped.min(axis=1)
        kth = least.min(axis=1) if few == 1 else np.partition(least, few - 1, axis=1)[:, few - 1]
        kth = kth.astype(np.float64)
        top = np.sqrt(kth ** 2 + 2 * error) * (1 + 8 * eps) if self.name == "euclidean" else kth + 16 * eps
        i, g = np.nonzero(least <= top[:, None])
        if single and len(i) > len(q) * (few + OVER):
            return None, None
        where, layer = np.nonzero(grouped[i, :, g] <= top[i][:, None])
        row, at = i[where], layer * wide + g[where]
        if rest:
            i, j = np.nonzero(score[:, n - rest:] <= top[:, None])
            row, at = np.concatenate((row, i)), np.concatenate((at, n - rest + j))
        return row, at


def _series(found: np.ndarray) -> pd.Series:
    return pd.Series([row[np.isfinite(row)].tolist() for row in found])


def nearest_distances(queries: DataFrame, refs: DataFrame, col: str, id_col: str, k: int, metric: Metric,
                      out: str = "nearest", broadcast_bytes: int = BROADCAST_BYTES,
                      block_rows: int | None = None) -> DataFrame:
    """Adds the sorted distances of the k nearest reference rows (fewer when there are fewer)."""
    size = refs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(col)), F.lit(0)).alias("cells")).first()
    held = size["n"] * metric.width * (8 if metric.name == "euclidean" else 4)
    if max(held, size["cells"] * 8) <= broadcast_bytes:
        return _broadcast_join(queries, refs, col, k, metric, out)
    return _block_join(queries, refs, col, id_col, k, metric, out, block_rows)


def _broadcast_join(queries, refs, col, k, metric, out):
    """Size of `refs` was checked by the caller."""
    rows = refs.select(col).toPandas()[col].tolist()
    held = queries.sparkSession.sparkContext.broadcast(metric.matrix(rows))

    @pandas_udf("array<double>")
    def search(v: pd.Series) -> pd.Series:
        r = held.value
        return _series(metric.smallest(metric.matrix(v.tolist()), r, np.ones(len(r), dtype=np.int64), k))

    return queries.withColumn(out, search(F.col(col)))


def _block_join(queries, refs, col, id_col, k, metric, out, block_rows):
    spark = queries.sparkSession
    vec = F.col(col)
    distinct = refs.groupBy(vec.alias("v")).agg(F.count("*").alias("copies"))
    total = distinct.count()
    # rows go once to every block of the other side, so their copies grow with the number of blocks
    most = max(256, BLOCK_BYTES // (8 * max(metric.width, 1)))
    block = max(block_rows, min(most, -(-total // BLOCKS))) if block_rows else most
    n_pivots = min(MAX_PIVOTS, max(2, math.isqrt(max(1, total // block)) * 2))
    pivots = metric.matrix([r["v"] for r in distinct.orderBy(F.xxhash64("v"), F.col("v")).limit(n_pivots).collect()])
    if metric.name == "euclidean" and len(pivots):
        metric = replace(metric, center=tuple(pivots.mean(axis=0)))
        pivots = pivots - np.array(metric.center)
    held = spark.sparkContext.broadcast(pivots)

    @pandas_udf("cell int, gap double")
    def home(v: pd.Series) -> pd.DataFrame:
        d = metric.distances(metric.matrix(v.tolist()), held.value)
        at = d.argmin(axis=1)
        return pd.DataFrame({"cell": at.astype("int32"), "gap": d[np.arange(len(d)), at]})

    homed = cut_lineage(distinct.withColumn("h", home("v")).select("v", "copies", "h.cell", "h.gap"))
    close = W.partitionBy("cell").orderBy("gap")
    near = (homed.select("cell", "gap", "copies").withColumn("_r", F.row_number().over(close)).where(F.col("_r") <= k)
            .groupBy("cell").agg(F.collect_list(F.struct("gap", F.least("copies", F.lit(k)).alias("c"))).alias("near")))
    stats = (homed.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
             .join(near, "cell").orderBy("cell").collect())
    cells = np.array([s["cell"] for s in stats])
    blocks = np.array([max(1, math.ceil(s["n"] / block)) for s in stats])
    lo, hi = np.array([s["lo"] for s in stats]), np.array([s["hi"] for s in stats])
    # error bound of the reference rows' own distances: their norms are at most a pivot's norm and the largest radius
    norms = np.sqrt((pivots * pivots).sum(1)).max(initial=0.0) + (hi.max() if len(hi) else 0.0)
    far = ROUNDING * (metric.width + 8) * 2 * norms ** 2 if metric.name == "euclidean" else 0.0
    inner = [np.repeat([g["gap"] for g in s["near"]], [g["c"] for g in s["near"]])[:k] for s in stats]
    owner = np.repeat(np.arange(len(stats)), [len(x) for x in inner])
    inner = np.concatenate(inner) if inner else np.zeros(0)

    @pandas_udf("array<int>")
    def visits(v: pd.Series) -> pd.Series:
        x = metric.matrix(v.tolist())
        d = metric.distances(x, held.value)[:, cells]
        # three distances, each wrong by at most the root of its error; radii of cells are those of reference rows
        wrong = 4 * np.sqrt(metric.error(x, held.value) + far) + ROUNDING
        reach = d[:, owner] + inner[None, :]
        top = np.sort(reach, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(d), np.inf)
        floor = np.maximum(np.maximum(d - hi[None, :], lo[None, :] - d), 0.0)
        ok = floor <= (top + wrong + ROUNDING * np.where(np.isfinite(top), top, 0.0))[:, None]
        return pd.Series([cells[row].astype("int32").tolist() for row in ok])

    n_blocks = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(cells, blocks) for x in pair]), F.col("cell"))
    asked = queries.groupBy(vec.alias("v")).agg(F.min(id_col).alias("rep"))
    asked = cut_lineage(asked.select("v", "rep", visits("v").alias("cells")))
    q_blocks = max(1, math.ceil(asked.count() / (2 * block)))
    left = (asked.select("v", "rep", F.explode("cells").alias("cell"))
            .withColumn("rb", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
            .withColumn("qb", F.pmod(F.xxhash64("v"), F.lit(q_blocks)).cast("int")))
    right = (homed.select("v", "copies", "cell")
             .withColumn("rb", F.pmod(F.xxhash64("v"), n_blocks.cast("bigint")).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    rep_type = asked.schema["rep"].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"rep": a["rep"].iloc[:0], "d": pd.Series([], dtype="float64")})
        found = metric.smallest(metric.matrix(a["v"].tolist()), metric.matrix(b["v"].tolist()),
                                b["copies"].to_numpy(), k)
        i, j = np.nonzero(np.isfinite(found))
        return pd.DataFrame({"rep": a["rep"].to_numpy()[i], "d": found[i, j]})

    keys = ["cell", "rb", "qb"]
    pieces = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
              .applyInPandas(meet, f"rep {rep_type}, d double"))
    best = W.partitionBy("rep").orderBy("d")
    merged = (pieces.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
              .groupBy("rep").agg(F.sort_array(F.collect_list("d")).alias(out)))
    answers = asked.select("v", "rep").join(merged, "rep", "left").select(
        F.col("v").alias("_v"), F.coalesce(F.col(out), F.array().cast("array<double>")).alias(out))
    return queries.join(answers, F.col(col) == F.col("_v")).drop("_v")


def _mean(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c))


def knn_mean_distance(queries: DataFrame, refs: DataFrame, col: str, id_col: str, k: int, width: int,
                      out: str = "knn_mean", within: bool = False, **options) -> DataFrame:
    """Mean distance to the k nearest reference rows; `within` is for the reference rows themselves.

    A reference row finds itself at distance 0, so one nearest hit is left out (unless it is the only row).
    """
    k = max(1, int(k))
    found = nearest_distances(queries, refs, col, id_col, k + 1 if within else k, Metric("euclidean", width),
                              "_near", **options)
    near = F.col("_near")
    used = F.when(F.size(near) > 1, F.slice(near, 2, k)).otherwise(near) if within else near
    return found.withColumn("_used", used).withColumn(out, F.coalesce(_mean(F.col("_used")), F.lit(0.0))).drop(
        "_near", "_used")


def max_cosine(queries: DataFrame, refs: DataFrame, col: str, id_col: str, width: int, out: str = "cosine_max",
               **options) -> DataFrame:
    """Largest cosine to a reference row: the nearest neighbour of the unit vectors; a zero vector has cosine 0."""

    def unit(df: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda s, x: s + x * x))
        return df.withColumn("_norm", norm).withColumn(
            "_unit", F.when(F.col("_norm") >= 1e-12, F.transform(col, lambda x: x / F.col("_norm")))
            .otherwise(F.transform(col, lambda x: F.lit(0.0))))

    base = unit(refs)
    zero = base.agg(F.coalesce(F.max((F.col("_norm") < 1e-12).cast("int")), F.lit(0))).scalar()
    found = nearest_distances(unit(queries), base.where(F.col("_norm") >= 1e-12).select("_unit"), "_unit", id_col, 1,
                              Metric("euclidean", width), "_near", **options)
    d = F.get("_near", F.lit(0))
    cos = F.when(F.col("_norm") < 1e-12, 0.0).otherwise(1.0 - d * d / 2.0)
    return (found.withColumn("_zero", zero)
            .withColumn(out, F.coalesce(F.when(F.col("_zero") == 1, F.greatest(cos, F.lit(0.0))).otherwise(cos),
                                        F.lit(0.0)))
            .drop("_norm", "_unit", "_near", "_zero"))


def max_tanimoto(queries: DataFrame, refs: DataFrame, bits: str, id_col: str, n_bits: int, out: str = "tanimoto_max",
                 **options) -> DataFrame:
    """Largest Tanimoto similarity to a reference row; 0 without reference rows and for two empty sets."""
    found = nearest_distances(queries, refs.select(bits), bits, id_col, 1, Metric("jaccard", n_bits), "_near",
                              **options)
    return found.withColumn(out, 1.0 - F.coalesce(F.get("_near", F.lit(0)), F.lit(1.0))).drop("_near")
