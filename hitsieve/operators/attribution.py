"""Shapley attributions: closed form for linear models, permutation sampling for any fitted model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hitsieve.functions.text import bind


def linear_attribution(df: DataFrame, background: DataFrame, coef: dict[str, float], intercept: float,
                       id_col: str) -> DataFrame:
    """(id, feature, value, base) in margin space: coef * (x - background mean); base is the margin at the mean."""
    names = list(coef)
    means = background.agg(F.struct(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names]).alias("m")).scalar()
    base = F.lit(float(intercept))
    for n in names:
        base = base + F.lit(float(coef[n])) * F.col(f"_m.{n}")
    cells = F.array(*[F.struct(F.lit(n).alias("feature"),
                               (F.lit(float(coef[n])) * (F.coalesce(F.col(n), F.lit(0.0)) - F.col(f"_m.{n}"))).alias("value"))
                      for n in names])
    return (df.withColumn("_m", means).select(id_col, base.alias("base"), F.explode(cells).alias("c"))
            .select(id_col, "c.feature", "c.value", "base"))


def sampled_attribution(rows: DataFrame, background: DataFrame, features: str, names: Sequence[str], id_col: str,
                        score: Callable[[DataFrame], DataFrame], permutations: int = 4, seed: int = 42) -> DataFrame:
    """(id, feature, value) for any model; `score` adds `y_prob` to rows with the array column `features`.

    Every (row, background row, order of features) walks from the background row to the row one feature at a time
    and credits each step to its feature. Values of a row add up to its score minus the mean background score.
    `rows` and `background` are samples of fixed size (see `uniform_sample`).
    """
    d = len(names)
    x = rows.select(id_col, F.col(features).alias("_x"))
    z = background.select(F.col(id_col).alias("_bg"), F.col(features).alias("_z"))
    # a fixed-size background travels with every explained row as one array, so no pairs are joined
    pool = z.agg(F.sort_array(F.collect_list(F.struct("_bg", "_z")))).scalar()
    runs = (x.withColumn("_pool", pool).withColumn("_walks", F.size("_pool") * permutations).withColumn("_b", F.explode("_pool"))
            .withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
            .select(id_col, "_x", "_walks", F.col("_b._bg").alias("_bg"), F.col("_b._z").alias("_z"), "_p"))
    key = F.concat_ws(":", F.col(id_col), F.col("_bg"), F.col("_p"))
    # a step to an equal value changes nothing, so walks visit the differing positions, which stand first in the order
    equal = lambda i: F.get("_x", i).eqNullSafe(F.get("_z", i))
    order = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(
        equal(i).alias("equal"), F.xxhash64(F.lit(seed), F.col("_key"), i).alias("h"), i.alias("i"))))
    runs = bind(runs.withColumn("_key", key), _full=order)
    place = F.transform(F.sort_array(F.transform("_full", lambda s, k: F.struct(s["i"].alias("i"), k.alias("k")))), lambda s: s["k"])
    runs = bind(runs, _order=F.transform("_full", lambda s: s["i"]), _place=place, _m=F.size(F.filter("_full", lambda s: ~s["equal"]))).drop("_full")
    steps = runs.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_m"))))
    mixed = F.transform("_x", lambda v, i: F.when(F.get("_place", i) < F.col("_s"), v).otherwise(F.get("_z", i)))
    scored = score(steps.select(id_col, "_bg", "_p", "_s", "_walks", F.get("_order", F.col("_s") - 1).alias("_j"),
                                mixed.alias(features)))
    # one walk has at most d + 1 steps
    walk = W.partitionBy(id_col, "_bg", "_p").orderBy("_s")
    gain = F.col("y_prob") - F.lag("y_prob").over(walk)
    labels = F.array(*[F.lit(n) for n in names])
    won = (scored.withColumn("gain", gain).where(F.col("_s") > 0)
           .groupBy(F.col(id_col).alias("_id"), F.get(labels, F.col("_j")).alias("_feature"))
           .agg((F.sum("gain") / F.max("_walks")).alias("value")))
    every = x.withColumn("_pool", pool).where(F.size("_pool") > 0).select(id_col, F.explode(labels).alias("feature"))
    return (every.join(won, (F.col(id_col) == F.col("_id")) & (F.col("feature") == F.col("_feature")), "left")
            .select(id_col, "feature", F.coalesce("value", F.lit(0.0)).alias("value")))



def importance(values: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (values.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature"))


def top_features(values: DataFrame, k: int) -> DataFrame:
    return importance(values).limit(k)


def heat_map(values: DataFrame, id_col: str, rows: int = 64, k: int = 15) -> DataFrame:
    """(id, feature, value, place) of the first rows and the top features."""
    first = values.select(id_col).distinct().orderBy(id_col).limit(rows)
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), "feature"))
    top = top_features(values, k).withColumn("place", place).select("feature", "place")
    return values.join(F.broadcast(top), "feature").join(F.broadcast(first), id_col, "left_semi")


def explain_bundle(df: DataFrame, background_ids: DataFrame, id_col: str) -> DataFrame:
    """Rows tagged `background` or `explain`; the background ids are a fixed-size sample."""
    marked = background_ids.select(id_col, F.lit("background").alias("part"))
    return (df.join(F.broadcast(marked), id_col, "left")
            .withColumn("part", F.coalesce("part", F.lit("explain"))))
