"""Cleaning of measurement tables and their basic summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitsieve.functions.scalar import activity_label, neg_log_molar, to_number
from hitsieve.operators.ordering import exact_quantiles


def category_filter(df: DataFrame, kind: str, unit: str, relation: str, columns=("type", "unit", "relation")):
    t, u, rel = (F.col(c) for c in columns)
    return df.where((F.upper(t) == kind.upper()) & (F.lower(u) == unit.lower()) & (rel == relation))


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, to_number(F.col(col))).where(F.col(col).isNotNull())


def potency(df: DataFrame, value: str = "value", out: str = "p", floor: float = 3.0) -> DataFrame:
    return df.withColumn(out, neg_log_molar(F.col(value))).where(F.col(out) >= floor)


def collapse_replicates(df: DataFrame, key: str, id_col: str, order: Sequence[str], value: str = "value",
                        transform: Callable[[Column], Column] = neg_log_molar) -> DataFrame:
    """One row per entity: first id in `order`, median value and median of the transformed value.

    The transform is monotone, so both medians come from the same two order statistics.
    """
    med = exact_quantiles(df, [key], value, [0.5], bounds=True).select(
        key, F.col("q0").alias("value_median"),
        ((transform(F.col("low0")) + transform(F.col("high0"))) / 2.0).alias("p_median"))
    first = df.groupBy(key).agg(F.min_by(id_col, F.struct(*order)).alias("first_id"))
    return first.join(med, key)


def clean_measurements(df: DataFrame, entities: DataFrame, key: str, id_col: str, order: Sequence[str],
                       kind: str, unit: str, relation: str, cut: float = 6.0) -> DataFrame:
    """Filter, coerce, transform, collapse and label, with the entity attributes joined at the end.

    Collapsing first leaves one row per entity for the join, so a frequent entity costs nothing there.
    """
    rows = potency(coerce_numeric(category_filter(df, kind, unit, relation), "value"))
    return (collapse_replicates(rows, key, id_col, order)
            .withColumn("label", activity_label(F.col("p_median"), cut)).join(entities, key))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the common range; the last bin is closed on the right."""
    s = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    rows = df.where(F.col(col).isNotNull()).withColumns({"_lo": s["lo"], "_hi": s["hi"]})
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.coalesce(F.floor(F.try_divide(F.col(col) - F.col("_lo"), width)), F.lit(0))
    counts = (rows.withColumn("bin", F.least(b, F.lit(bins - 1)).cast("int")).withColumn("width", width)
              .groupBy(*by, "bin").agg(F.count("*").alias("n"), F.max("width").alias("width"),
                                       F.max("_lo").alias("lo")))
    total = F.sum("n").over(W.partitionBy(*(by or [F.lit(0)])))
    return (counts.withColumn("left", F.col("lo") + F.col("bin") * F.col("width"))
            .withColumn("density", F.try_divide(F.col("n"), total * F.col("width"))).drop("lo", "width"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation aggregate: 0 for a (nearly) constant side, NULL without rows."""

    def flat(c: str) -> Column:
        lo, hi = F.min(c), F.max(c)
        return hi - lo <= F.lit(1e-8) + F.lit(1e-5) * F.abs(lo)

    return F.when(F.count(F.lit(1)) == 0, None).when(flat(x) | flat(y), 0.0).otherwise(
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line; NULL for a constant x."""
    slope = F.try_divide(F.regr_sxy(y, x), F.regr_sxx(y, x))
    return df.groupBy(*by).agg(slope.alias("slope"),
                               (F.regr_avgy(y, x) - slope * F.regr_avgx(y, x)).alias("intercept"))


def cluster_rates(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return (df.groupBy(cluster).agg(F.avg(label).alias("rate"), F.count("*").alias("n"))
            .orderBy(F.desc("rate"), cluster))


def subgroup_rates(df: DataFrame, cluster: str, key: str, label: str) -> DataFrame:
    """Count and active rate per cluster and group; rows without a group are left out."""
    return (df.where(F.col(key).isNotNull()).groupBy(cluster, key)
            .agg(F.count("*").alias("n"), F.avg(label).alias("active_ratio")))


def top_subgroups(rates: DataFrame, cluster: str, key: str, k: int = 3) -> DataFrame:
    """The k largest groups per cluster. Keys are hashed into slices first, so a cluster is never one big sort."""
    order = [F.desc("n"), F.asc(key)]
    sliced = rates.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(256)))
    local = W.partitionBy(cluster, "_s").orderBy(*order)
    kept = sliced.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
    final = W.partitionBy(cluster).orderBy(*order)
    return kept.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).drop("_s", "_r")


def centroids(df: DataFrame, cluster: str, coords: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in coords], F.avg(label).alias("rate"),
                                   F.count("*").alias("n"))


def representatives(df: DataFrame, cluster: str, label: str, coords: Sequence[str], id_col: str) -> DataFrame:
    """Row nearest to the centroid of its cluster, among the positives when the cluster has any."""
    has = df.groupBy(cluster).agg(F.max(label).alias("_top"))
    pool = df.join(has, cluster).where((F.col("_top") < 1) | (F.col(label) == 1)).drop("_top")
    center = pool.groupBy(cluster).agg(*[F.avg(c).alias(f"_m_{c}") for c in coords])
    gap = sum((F.pow(F.col(c) - F.col(f"_m_{c}"), 2) for c in coords), F.lit(0.0))
    return (pool.join(center, cluster).withColumn("_d", gap)
            .groupBy(cluster).agg(F.min_by(F.struct(id_col, label, F.sqrt("_d").alias("distance")),
                                           F.struct(F.round("_d", 12), F.col(id_col))).alias("s"))
            .select(cluster, "s.*"))
