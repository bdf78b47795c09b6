"""Feature tables: missing values, scaling, bit masks, assembly, principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitsieve.functions.scalar import finite
from hitsieve.functions.text import bind
from hitsieve.schemas import MissingPolicy


def fill_missing(df: DataFrame, names: Sequence[str], policy: MissingPolicy = MissingPolicy()) -> tuple[DataFrame, list[str]]:
    """Imputed columns, then one indicator per column under `nan_indicator`; returns the feature names in order."""
    if policy.strategy not in ("zero", "nan_indicator"):
        raise ValueError(f"unknown missing strategy: {policy.strategy}")
    value = 0.0 if policy.strategy == "zero" else policy.impute_value
    clean = {n: finite(F.col(n)) for n in names}
    cols: dict[str, Column] = {}
    if policy.strategy == "nan_indicator":
        cols = {f"{n}{policy.suffix}": c.isNull().cast("double") for n, c in clean.items()}
    flagged = df.withColumns(cols) if cols else df
    out = flagged.withColumns({n: F.coalesce(c, F.lit(value)) for n, c in clean.items()})
    return out, [*names, *cols]


def column_moments(df: DataFrame, names: Sequence[str]) -> Column:
    """Mean and population sigma of every column as one struct (scalar subquery); sigma 0 counts as 1."""
    parts = []
    for n in names:
        sd = F.stddev_pop(n)
        parts += [F.avg(n).alias(f"{n}_mu"), F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd).alias(f"{n}_sd")]
    return df.agg(F.struct(*parts).alias("s")).scalar()


def scale_columns(df: DataFrame, fit_on: DataFrame, names: Sequence[str], suffix: str = "") -> DataFrame:
    s = "_moments"
    with_s = df.withColumn(s, column_moments(fit_on, names))
    return with_s.withColumns({
        f"{n}{suffix}": (F.col(n) - F.col(f"{s}.{n}_mu")) / F.col(f"{s}.{n}_sd") for n in names}).drop(s)


def scale_arrays(df: DataFrame, fit_on: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """The same for an array column; moments come from one pass that merges on the map side."""
    stat = Summarizer.metrics("mean", "variance", "count").summary(F.col("_v"))
    raw = (fit_on.select(array_to_vector(F.col(col)).alias("_v")).select(stat.alias("s"))
           .select(vector_to_array("s.mean").alias("mu"), vector_to_array("s.variance").alias("var"), "s.count"))
    sd = F.transform("var", lambda v: F.sqrt(v * (F.col("count") - 1) / F.col("count")))
    one = raw.select(F.struct("mu", F.transform(sd, lambda v: F.when(v > 0, v).otherwise(1.0)).alias("sd")).alias("m"))
    held = bind(df.withColumn("_m", one.scalar()), _mu=F.col("_m.mu"), _sd=F.col("_m.sd"))
    scaled = F.transform(col, lambda v, i: (v - F.get("_mu", i)) / F.get("_sd", i))
    return held.withColumn(out or col, scaled).drop("_m", "_mu", "_sd")


def bit_variances(df: DataFrame, bits: str, n_bits: int, threshold: float = 0.05) -> DataFrame:
    """(bit, variance, kept): population variance of every bit; with none above the threshold the top one is kept."""
    # one pass: the first position of a row also counts the row
    spread = df.select(F.posexplode_outer(bits).alias("pos", "bit"))
    counts = spread.groupBy("bit").agg(F.count("*").alias("c"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("first"))
    frame = df.sparkSession.range(-1, n_bits).select(F.col("id").cast("int").alias("bit"))
    table = (frame.join(counts.withColumn("bit", F.coalesce("bit", F.lit(-1))), "bit", "left")
             .withColumn("_n", F.sum("first").over(W.partitionBy(F.lit(0)))).where(F.col("bit") >= 0)
             .withColumn("p", F.try_divide(F.coalesce(F.col("c"), F.lit(0)).cast("double"), F.col("_n")))
             .withColumn("variance", F.coalesce(F.col("p") * (1 - F.col("p")), F.lit(0.0))))
    # n_bits rows in all
    best = W.partitionBy(F.lit(0))
    passing = F.max((F.col("variance") >= threshold).cast("int")).over(best)
    top = F.row_number().over(best.orderBy(F.desc("variance"), "bit")) == 1
    kept = F.when(passing == 1, (F.col("variance") >= threshold) & (F.col("variance") > 0)).otherwise(top)
    return table.select("bit", "variance", kept.alias("kept"))


def as_vector(df: DataFrame, bits: str, kept: Sequence[int], out: str) -> DataFrame:
    """Kept bits as a sparse vector in the order of `kept`; bits are looked up by hash on the JVM."""
    model = CountVectorizerModel.from_vocabulary([str(b) for b in kept], inputCol="_words", outputCol=out)
    model.setBinary(True).setMinTF(1.0)
    words = F.transform(bits, lambda b: b.cast("string"))
    return model.transform(df.withColumn("_words", words)).drop("_words")


def correlated_pairs(df: DataFrame, bits: str, candidates: Sequence[int], threshold: float = 0.9) -> list[tuple]:
    """(i, j, |r|) with i < j above the threshold, from one distributed pass over the rows.

    The driver holds one number per pair of candidates: 32 MB for the 2,048 bits of a fingerprint.
    """
    kept = list(candidates)
    if len(kept) < 2:
        return []
    dense = as_vector(df, bits, kept, "_v").select("_v")
    m = np.abs(np.nan_to_num(Correlation.corr(dense, "_v", "pearson").first()[0].toArray()))
    i, j = np.nonzero(np.triu(m > threshold, 1))
    return [(kept[a], kept[b], float(m[a, b])) for a, b in zip(i, j)]


def prune_correlated(variances: dict[int, float], pairs: Sequence[tuple]) -> list[int]:
    """Bits left when, in index order, the weaker of every surviving correlated pair is dropped.

    The pair loses its lower variance, or its higher index on equal variance.
    """
    alive = dict.fromkeys(sorted(variances), True)
    later: dict[int, list[int]] = {}
    for i, j, _ in pairs:
        later.setdefault(min(i, j), []).append(max(i, j))
    for i in alive:
        for j in sorted(later.get(i, [])):
            if not alive[i]:
                break
            if alive[j]:
                alive[i if variances[j] > variances[i] else j] = False
    return [b for b, ok in alive.items() if ok]


def fit_mask(df: DataFrame, bits: str, n_bits: int, variance: float = 0.05, correlation: float = 0.9,
             max_bits: int | None = None) -> list[int]:
    """Kept bit positions: variance filter, then correlation pruning at any number of bits.

    `max_bits` restores a rule that skips the pruning when more bits than that are left.
    """
    table = bit_variances(df, bits, n_bits, variance).where("kept").collect()
    var = {r["bit"]: r["variance"] for r in table}
    if max_bits is not None and len(var) > max_bits:
        return sorted(var)
    return prune_correlated(var, correlated_pairs(df, bits, sorted(var), correlation))


@dataclass(frozen=True)
class Processor:
    """Everything fitted that turns rows into features: kept bits, missing policy, moments. Saved with a model.

    `names` are the descriptors and, under `nan_indicator`, one indicator for each that had missing values in training.
    """

    bits: str
    n_bits: int
    kept: list[int]
    descriptors: list[str]
    names: list[str]
    means: list[float]
    sigmas: list[float]
    strategy: str
    impute_value: float
    suffix: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `features_raw` and `features_scaled`; needs no training rows."""
        policy = MissingPolicy(self.strategy, self.impute_value, self.suffix)
        filled, _ = fill_missing(df, self.descriptors, policy)
        out = as_vector(filled, self.bits, self.kept, "_bits")
        out = out.withColumns({f"{n}__z": (F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(self.names, self.means, self.sigmas)})
        for target, names in (("features_raw", self.names), ("features_scaled", [f"{n}__z" for n in self.names])):
            out = VectorAssembler(inputCols=["_bits", *names], outputCol=target, handleInvalid="error").transform(out)
        extra = [f"{n}{self.suffix}" for n in self.descriptors if policy.strategy == "nan_indicator" and f"{n}{self.suffix}" not in df.columns]
        return out.drop("_bits", *extra, *[f"{n}__z" for n in self.names])

    def contract(self) -> list[tuple[int, str, str]]:
        """(position, name, type) of the features."""
        out = [(i, f"bit_{b}", "bit") for i, b in enumerate(self.kept)]
        return out + [(len(self.kept) + i, n, "descriptor") for i, n in enumerate(self.names)]

    def saved(self) -> dict:
        return asdict(self)

    @staticmethod
    def loaded(state: dict) -> "Processor":
        return Processor(**state)


def fit_processor(train: DataFrame, bits: str, n_bits: int, descriptors: Sequence[str], kept: Sequence[int],
                  missing: MissingPolicy = MissingPolicy()) -> Processor:
    """Moments and missing-value indicators of the training rows, in one pass; a constant column has sigma 1."""
    filled, names = fill_missing(train, descriptors, missing)
    # one aggregate over the row's descriptors as a vector: a plan of two columns, however many there are
    whole = array_to_vector(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]))
    seen = filled.select(Summarizer.metrics("mean", "variance", "count").summary(whole).alias("s")).first()["s"] if names else None
    count = seen["count"] if seen else 0
    mean = dict(zip(names, seen["mean"].toArray())) if count else {}
    deviation = dict(zip(names, np.sqrt(seen["variance"].toArray() * max(count - 1, 0) / count))) if count else {}
    flags = [n for n in names if n not in descriptors]
    names = [*descriptors, *[n for n in flags if mean.get(n, 0.0) > 0]]
    return Processor(bits, n_bits, list(kept), list(descriptors), names, [float(mean.get(n, 0.0)) for n in names],
                     [float(deviation.get(n, 0.0)) or 1.0 for n in names], missing.strategy, float(missing.impute_value), missing.suffix)


def assemble(df: DataFrame, fit_on: DataFrame, bits: str, kept: Sequence[int], descriptors: Sequence[str],
             ) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """`features_scaled` and `features_raw` (kept bits, then descriptors) and the (position, name, type) contract."""
    fitted = fit_processor(fit_on, bits, 0, descriptors, kept)
    return fitted.transform(df), fitted.contract()


def fit_pca(df: DataFrame, col: str, components: int | float) -> tuple[np.ndarray, np.ndarray]:
    """(loadings d x k, share of variance per component) on a centred vector column.

    A float keeps the fewest components whose shares reach it.
    """
    d = len(df.select(vector_to_array(col).alias("a")).first()["a"])
    k = d if isinstance(components, float) else min(int(components), d)
    model = PCA(k=k, inputCol=col, outputCol="_pc").fit(df)
    share = model.explainedVariance.toArray()
    if isinstance(components, float):
        k = int(min(d, np.searchsorted(np.cumsum(share), components - 1e-12) + 1))
    return model.pc.toArray()[:, :k], share[:k]


def project(df: DataFrame, col: str, loadings: np.ndarray, out: str = "pc") -> DataFrame:
    """Array column times fixed loadings, one matrix product per Arrow batch."""
    held = df.sparkSession.sparkContext.broadcast(np.asarray(loadings, dtype=np.float64))  # d x k numbers

    @F.pandas_udf("array<double>")
    def times(v):
        m = held.value
        x = np.array([np.asarray(r, dtype=np.float64) for r in v]).reshape(len(v), len(m))
        return type(v)(list(x @ m), index=v.index, dtype=object)

    return df.withColumn(out, times(F.col(col)))
