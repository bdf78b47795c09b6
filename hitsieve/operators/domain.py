"""Applicability domain: leverage, Mahalanobis, neighbour density, map occupancy, similarity, flag algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from hitsieve.functions.scalar import deviance_residual, log_loss, zscore
from hitsieve.operators import nearest as NN
from hitsieve.operators.features import fit_pca, project
from hitsieve.operators.ordering import exact_quantiles
from hitsieve.schemas import DomainConfig
from hitsieve.session import cut_lineage


def train_quantile(df: DataFrame, value: str, q: float) -> Column:
    """Quantile with linear interpolation as a scalar subquery; q is clamped to [0, 1]."""
    return exact_quantiles(df.select(value), [], value, [q]).select("q0").scalar()


def leverage(train: DataFrame, query: DataFrame, col: str, variance: float = 0.95) -> tuple[DataFrame, float, int]:
    """Leverage of the query rows in the space of the train components, the limit 3p/n and p.

    Train columns are centred, so the scores of different components are orthogonal and the inverse of their
    product matrix is one over the sums of squares; components without variance drop out.
    """
    vec = train.select(array_to_vector(col).alias("v"))
    loadings, _ = fit_pca(vec, "v", float(variance))
    scored = project(train.select(col), col, loadings)
    p = loadings.shape[1]
    sums = scored.agg(F.count("*").alias("n"), *[F.sum(F.pow(F.get("pc", F.lit(j)), 2)).alias(f"s{j}")
                                                 for j in range(p)]).first()
    inverse = [1.0 / sums[f"s{j}"] if sums[f"s{j}"] > 1e-12 else 0.0 for j in range(p)]
    h = F.aggregate(F.zip_with("pc", F.lit(inverse), lambda a, w: a * a * w), F.lit(0.0), lambda s, v: s + v)
    limit = 3.0 * p / sums["n"] if sums["n"] else float("inf")
    return project(query, col, loadings).withColumn("leverage", h).drop("pc"), limit, p


def shrunk_covariance(train: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) with Ledoit-Wolf shrinkage from two aggregates over the rows.

    With x centred, S the population covariance, m = trace(S)/d: the weight of the m*I target is
    min(b2, d2)/d2 where d2 = |S - mI|^2 / d and b2 = (mean |x|^4 - |S|^2) / (n d).
    """
    vec = train.select(array_to_vector(col).alias("v"))
    row = vec.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    mean, n = row["mean"].toArray(), int(row["count"])
    d = len(mean)
    sd = np.sqrt(row["variance"].toArray() * (n - 1) / n)
    corr = np.nan_to_num(Correlation.corr(vec, "v", "pearson").first()[0].toArray())
    s = corr * sd[:, None] * sd[None, :]
    center = F.lit([float(m) for m in mean])
    sq = F.aggregate(F.zip_with(col, center, lambda a, m: (a - m) * (a - m)), F.lit(0.0), lambda acc, v: acc + v)
    fourth = train.agg(F.avg(F.pow(sq, 2))).first()[0]
    m = np.trace(s) / d
    d2 = ((s - m * np.eye(d)) ** 2).sum() / d
    b2 = min(max((fourth - (s ** 2).sum()) / (n * d), 0.0), d2)
    w = b2 / d2 if d2 > 0 else 0.0
    return mean, (1 - w) * s + w * m * np.eye(d)


def mahalanobis(df: DataFrame, col: str, mean: np.ndarray, cov: np.ndarray, out: str = "mahalanobis") -> DataFrame:
    """Distance of every row; the d x d whitening matrix is a constant of the task.

    Directions without variance are left out, as the pseudo-inverse does, so a singular covariance has distances too.
    """
    value, side = np.linalg.eigh(cov)
    live = value > value.max(initial=0.0) * len(value) * np.finfo(float).eps
    whiten = side[:, live] / np.sqrt(value[live])

    @pandas_udf("double")
    def dist(v: pd.Series) -> pd.Series:
        x = np.array([np.asarray(r, dtype=np.float64) for r in v]).reshape(len(v), len(mean)) - mean
        return pd.Series(np.sqrt(np.maximum(((x @ whiten) ** 2).sum(1), 0.0)))

    return df.withColumn(out, dist(F.col(col)))


def _units(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return ((x ** 2).sum(1)[:, None] - 2.0 * x @ weights.T + (weights ** 2).sum(1)[None, :]).argmin(axis=1)


def best_unit(df: DataFrame, col: str, weights: np.ndarray, out: str = "unit") -> DataFrame:
    """Index of the map unit nearest to the row; the map has a fixed number of units."""

    @pandas_udf("int")
    def unit(v: pd.Series) -> pd.Series:
        x = np.array([np.asarray(r, dtype=np.float64) for r in v]).reshape(len(v), weights.shape[1])
        return pd.Series(_units(x, weights).astype("int32"))

    return df.withColumn(out, unit(F.col(col)))


def fit_map(train: DataFrame, col: str, id_col: str, rows: int, cols: int, epochs: int, seed: int = 42) -> np.ndarray:
    """Batch self-organising map: per epoch, rows go to their best unit and units move to smoothed means."""
    from hitsieve.operators.splits import uniform_sample

    units = rows * cols
    start = uniform_sample(train.select(id_col, col), id_col, units, seed).collect()
    weights = np.array([start[i % len(start)][col] for i in range(units)], dtype=np.float64)
    at = np.array([(i // cols, i % cols) for i in range(units)], dtype=np.float64)
    gap = ((at[:, None, :] - at[None, :, :]) ** 2).sum(2)
    train = cut_lineage(train.select(F.col(col), array_to_vector(col).alias("_vec")))  # every epoch reads prepared rows
    for e in range(epochs):
        sigma = max(0.5, max(rows, cols) / 2.0 * (1.0 - e / epochs))
        sums = (best_unit(train, col, weights).groupBy("unit")
                .agg(F.count("*").alias("n"), Summarizer.metrics("sum").summary(F.col("_vec")).alias("s")).collect())
        n, s = np.zeros(units), np.zeros(weights.shape)
        for r in sums:
            n[r["unit"]] = r["n"]
            s[r["unit"]] = r["s"]["sum"].toArray()
        near = np.exp(-gap / (2.0 * sigma ** 2))
        weight = near @ n
        weights = np.where(weight[:, None] > 1e-12, (near @ s) / np.maximum(weight, 1e-12)[:, None], weights)
    return weights


def occupied_flag(query: DataFrame, train: DataFrame, col: str, weights: np.ndarray, out: str = "som_in") -> DataFrame:
    """True when some train row has the same best unit."""
    used = best_unit(train, col, weights).select("unit").distinct().withColumn(out, F.lit(True))
    return (best_unit(query, col, weights).join(F.broadcast(used), "unit", "left")
            .withColumn(out, F.coalesce(out, F.lit(False))).drop("unit"))


def combine(base: Column, som: Column, tanimoto: Column, cosine: Column, strict: bool = True) -> Column:
    inner = base & som
    similar = tanimoto & cosine
    return inner & similar if strict else inner | similar


def residual_columns(df: DataFrame, y: str = "y_true", p: str = "y_prob", z: float = 3.0) -> DataFrame:
    out = df.withColumns({"log_loss": log_loss(F.col(y), F.col(p)), "deviance": deviance_residual(F.col(y), F.col(p))})
    out = zscore(out, "deviance", "std_residual")
    error = F.col(p) - F.col(y)
    return out.withColumns({"prob_error": error, "abs_prob_error": F.abs(error),
                            "outlier": F.abs(F.col("std_residual")) > z})


def domain_table(train: DataFrame, query: DataFrame, config: DomainConfig, id_col: str, base: str, bits: str,
                 width: int, n_bits: int, descriptors: str | None = None, **options) -> DataFrame:
    """Per-row domain flags of the query rows; `base` is the scaled array column of the base method."""
    desc = descriptors or base
    null = F.lit(None).cast("double")
    out = query
    if config.base_method == "leverage":
        out, limit, _ = leverage(train, out, base, config.pca_variance)
        out = out.withColumns({"threshold": F.lit(limit), "base_in": F.col("leverage") <= limit,
                               "mahalanobis": null, "knn_mean": null})
    elif config.base_method == "mahalanobis":
        mean, cov = shrunk_covariance(train, base)
        cut = train_quantile(mahalanobis(train, base, mean, cov), "mahalanobis", config.quantile)
        out = (mahalanobis(out, base, mean, cov).withColumn("threshold", cut)
               .withColumns({"base_in": F.col("mahalanobis") <= F.col("threshold"), "leverage": null, "knn_mean": null}))
    elif config.base_method == "knn_density":
        inside = NN.knn_mean_distance(train.select(id_col, base), train.select(base), base, id_col, config.knn_k, width,
                                      within=True, **options)
        cut = train_quantile(inside, "knn_mean", config.quantile)
        out = (NN.knn_mean_distance(out, train.select(base), base, id_col, config.knn_k, width, **options)
               .withColumn("threshold", cut)
               .withColumns({"base_in": F.col("knn_mean") <= F.col("threshold"), "leverage": null, "mahalanobis": null}))
    else:
        raise ValueError(f"unknown base method: {config.base_method}")
    if config.skip_som:
        out = out.withColumn("som_in", F.lit(True))
    else:
        weights = fit_map(train, base, id_col, config.som_rows, config.som_cols, config.som_epochs)
        out = occupied_flag(out, train, base, weights)
    out = NN.max_tanimoto(out, train, bits, id_col, n_bits, **options)
    out = NN.max_cosine(out, train.select(desc), desc, id_col, width, **options)
    out = out.withColumns({"base_method": F.lit(config.base_method),
                           "tanimoto_in": F.col("tanimoto_max") >= config.tanimoto_threshold,
                           "cosine_in": F.col("cosine_max") >= config.cosine_threshold})
    flag = combine(F.col("base_in"), F.col("som_in"), F.col("tanimoto_in"), F.col("cosine_in"),
                   config.strict_similarity)
    return out.withColumn("in_domain", flag)


def domain_rates(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of rows inside per flag; 0 for no rows."""
    return table.groupBy(*by).agg(*[
        F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)).alias(c)
        for c in ("base_in", "som_in", "tanimoto_in", "cosine_in", "in_domain")], F.count("*").alias("n"))
