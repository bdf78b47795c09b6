"""Queries over metric tables: fold and seed roll-ups, permutation summary, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitsieve.functions.scalar import mean_std_text
from hitsieve.operators import features as FE, metrics as M, rollup as R, splits as SP
from hitsieve.plans import q_metrics as QM
from hitsieve.plans.q_features import PERM_SQL
from hitsieve.plans.registry import n, query, r, rounded, sql_r, sql_rs
from hitsieve.plans.views import MODELS, SEEDS, predictions, sql_with, table, vectors
from hitsieve.schemas import METRICS

FOLD = ["model", "seed", "fold"]
PARTS = ["conf", "confm", "sc", "cum", "rk", "ord", "frac", "top", "ef", "efw", "report"]
FOLD_SQL = {p: QM.SQL[p].replace("model, seed", "model, seed, fold") for p in PARTS}
UNPIVOT = " UNION ALL ".join(f"SELECT {{keys}}, '{m}' AS metric, {m}::DOUBLE AS value FROM report" for m in METRICS)
FOLD_SQL["long"] = UNPIVOT.format(keys="model, seed, fold")
SEED_SQL = {p: QM.SQL[p] for p in PARTS} | {"long": UNPIVOT.format(keys="model, seed")}


def by_fold(body: str, extra: dict[str, str] | None = None) -> str:
    return sql_with(["predictions"], FOLD_SQL | (extra or {}), body)


def by_seed(body: str, extra: dict[str, str] | None = None) -> str:
    return sql_with(["predictions"], SEED_SQL | (extra or {}), body)


def fold_metrics(spark, d):
    return M.long_metrics(M.evaluate(predictions(spark, d), FOLD), FOLD)


def seed_metrics(spark, d):
    return M.long_metrics(M.evaluate(predictions(spark, d), QM.BY), QM.BY)


STRICT = "CASE WHEN count(*) = count(value) THEN {} END"


@query("agg16_fold_summary", by_fold(f"""SELECT model, metric, {sql_r(STRICT.format('avg(value)'))} AS mean,
{sql_r(STRICT.format('stddev_pop(value)'))} AS std FROM long GROUP BY ALL"""))
def fold_summary(spark, d):
    return rounded(R.fold_summary(fold_metrics(spark, d)), ["model", "metric"], ["mean", "std"])


@query("prj14_mean_std_text", by_seed("""SELECT model, metric, printf('%.4f ± %.4f', round(avg(value), 4),
round(stddev_pop(value), 4)) AS mean_std FROM long GROUP BY ALL"""))
def mean_std(spark, d):
    t = R.seed_summary(seed_metrics(spark, d))
    return t.select("model", "metric", mean_std_text(F.round("mean", 4), F.round("std", 4)).alias("mean_std"))


@query("agg17_fold_results", by_fold(f"SELECT seed, fold, model, 'val' AS split, {sql_rs(METRICS)} FROM report"))
def fold_results(spark, d):
    long = fold_metrics(spark, d).withColumn("split", F.lit("val"))
    return rounded(R.fold_results(long), ["seed", "fold", "model", "split"], METRICS)


@query("agg18_seed_rollup", by_seed(f"""SELECT model, metric, {sql_r('avg(value)')} AS mean, {sql_r('stddev_pop(value)')} AS std,
count(value) AS n FROM long GROUP BY ALL"""))
def seed_rollup(spark, d):
    return rounded(R.seed_summary(seed_metrics(spark, d)), ["model", "metric"], ["mean", "std"], ["n"])


COLUMNS = [f"{m}_{k}" for m in MODELS for k in ("mcc", "f1", "roc_auc")]
PICK = "SELECT *, model || '_' || metric AS cell FROM long WHERE metric IN ('mcc', 'f1', 'roc_auc')"
WIDE = ", ".join(f"max(value) FILTER (cell = '{c}') AS {c}" for c in COLUMNS)


@query("agg19_seed_table", by_seed(
    f"""SELECT 'seed_' || seed AS "row", {sql_rs(COLUMNS)} FROM w
    UNION ALL SELECT 'MEAN', {', '.join(sql_r(f'avg({c})') for c in COLUMNS)} FROM w
    UNION ALL SELECT 'STD', {', '.join(sql_r(f'stddev_samp({c})') for c in COLUMNS)} FROM w""",
    {"cells": PICK, "w": f"SELECT seed, {WIDE} FROM cells GROUP BY seed"}))
def seed_table(spark, d):
    long = R.chosen(seed_metrics(spark, d), None, ["mcc", "f1", "roc_auc", "unknown"])
    return rounded(R.seed_table(long, COLUMNS), ["row"], COLUMNS)


@query("agg20_seed_distance", by_seed(
    f"""SELECT seed, {sql_r('sqrt(sum((value - m) * (value - m)))')} AS distance FROM cells JOIN
    (SELECT cell, avg(value) AS m FROM cells GROUP BY cell) USING (cell) GROUP BY seed""", {"cells": PICK}))
def seed_distance(spark, d):
    long = R.chosen(seed_metrics(spark, d), None, ["mcc", "f1", "roc_auc"])
    return rounded(R.seed_distance(long), ["seed"], ["distance"])


@query("agg24_box_statistics", by_fold(f"""SELECT model, metric, {sql_rs(['q1', 'median', 'q3'])},
{sql_r('min(value) FILTER (value >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
{sql_r('max(value) FILTER (value <= q3 + 1.5 * (q3 - q1))')} AS whisker_high, count(*) AS n FROM
(SELECT *, quantile_cont(value, 0.25) OVER g AS q1, quantile_cont(value, 0.5) OVER g AS median,
quantile_cont(value, 0.75) OVER g AS q3 FROM long WHERE value IS NOT NULL WINDOW g AS (PARTITION BY model, metric))
GROUP BY model, metric, q1, median, q3"""))
def box(spark, d):
    return rounded(R.box_stats(fold_metrics(spark, d)), ["model", "metric"],
                   ["q1", "median", "q3", "whisker_low", "whisker_high"], ["n"])


@query("agg34_external_summary", by_seed(f"""SELECT model, seed, metric, {sql_r('value')} AS mean, 0.0::DOUBLE AS std FROM long"""))
def external(spark, d):
    t = R.external_summary(M.evaluate(predictions(spark, d), QM.BY))
    return rounded(t, ["model", "seed", "metric"], ["mean", "std"])


def permuted_scores(spark, d):
    p = predictions(spark, d).where("model = 'LIN_A' AND seed = 0").select(F.col("id").alias("doc_id"), "y_prob", "y_true")
    perms = SP.permuted_labels(table(spark, d, "labels"), "doc_id", "quality", 200, 9)
    runs = perms.join(p.select("doc_id", "y_prob"), "doc_id").select(
        "permutation", "y_prob", F.col("permuted").alias("y_true"))
    return M.roc_auc(runs, ["permutation"]).withColumnRenamed("roc_auc", "metric"), M.roc_auc(p, []).select("roc_auc").scalar()


PERM_PARTS = {
    "pm": PERM_SQL,
    "px": "SELECT permutation, y_prob, permuted AS y FROM pm JOIN predictions ON id = doc_id WHERE model = 'LIN_A' AND seed = 0 "
          "UNION ALL SELECT 0, y_prob, y_true FROM predictions WHERE model = 'LIN_A' AND seed = 0",
    "psc": "SELECT permutation, y_prob, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM px GROUP BY ALL",
    "pcm": """SELECT *, coalesce(sum(pos) OVER (PARTITION BY permutation ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS pb FROM psc""",
    "pa": "SELECT permutation, sum(neg * (pb + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM pcm GROUP BY permutation",
    "act": "SELECT auc AS actual FROM pa WHERE permutation = 0",
}


@query("agg25_permutation_summary", sql_with(["predictions"], PERM_PARTS, f"""SELECT {sql_r('actual')} AS actual,
{sql_r('avg(auc)')} AS perm_mean, {sql_r('stddev_pop(auc)')} AS perm_std, {sql_r('(actual - avg(auc)) / stddev_pop(auc)', 4)} AS z_score,
{sql_r('(1 + count(*) FILTER (auc >= actual))::DOUBLE / (count(*) + 1)')} AS p_value, count(*) AS n_permutations
FROM pa, act WHERE permutation > 0 GROUP BY actual"""))
def permutation_summary(spark, d):
    scores, actual = permuted_scores(spark, d)
    t = R.permutation_summary(scores, actual)
    return t.select(r("actual").alias("actual"), r("perm_mean").alias("perm_mean"), r("perm_std").alias("perm_std"),
                    r("z_score", 4).alias("z_score"), r("p_value").alias("p_value"), n("n_permutations").alias("n_permutations"))


@query("agg31_retention", sql_with(["vectors"], {
    "f": "SELECT *, vec_id % 3 AS fold FROM vectors", "nn": "SELECT fold, count(*)::DOUBLE AS n FROM f GROUP BY fold",
    "c": "SELECT fold, bit, count(*) AS c FROM (SELECT fold, unnest(bits) AS bit FROM f) GROUP BY ALL",
    "k": "SELECT 'cv' AS stage, fold, (c / n * (1 - c / n) >= 0.249) AS kept FROM c JOIN nn USING (fold)",
    "p": "SELECT stage, fold, count(*) FILTER (kept) AS kept_dim, count(*) FILTER (kept) / 64.0::DOUBLE AS rate FROM k GROUP BY ALL"},
    f"""SELECT stage, {sql_r('avg(kept_dim)')} AS kept_mean, {sql_r('avg(rate)')} AS rate_mean,
{sql_r('stddev_pop(rate)')} AS rate_std, count(*) AS folds FROM p GROUP BY stage"""))
def retention(spark, d):
    v = vectors(spark, d)
    masks = None
    for f in range(3):
        t = FE.bit_variances(v.where(F.col("vec_id") % 3 == f), "bits", 64, 0.249).select(
            F.lit("cv").alias("stage"), F.lit(f).alias("fold"), "bit", "kept")
        masks = t if masks is None else masks.unionByName(t)
    return rounded(R.retention(masks), ["stage"], ["kept_mean", "rate_mean", "rate_std"], ["folds"])
