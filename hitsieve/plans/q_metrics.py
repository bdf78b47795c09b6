"""Queries over predictions: confusion, ranking metrics, thresholds, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitsieve.operators import metrics as M
from hitsieve.plans.registry import n, query, r, rounded, sql_r, sql_rs
from hitsieve.plans.views import predictions, sql_with
from hitsieve.schemas import METRICS

BY = ["model", "seed"]
STEP = "(1.0::DOUBLE / 500)"


def sql_metrics(tp: str, fp: str, tn: str, fn: str) -> str:
    """precision, recall, tpr, fpr, f1, mcc from counts; 0 on an empty denominator."""
    d = {k: f"({v})::DOUBLE" for k, v in {"tp": tp, "fp": fp, "tn": tn, "fn": fn}.items()}
    tp, fp, tn, fn = d["tp"], d["fp"], d["tn"], d["fn"]
    pr, rc = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    den = f"(sqrt({tp} + {fp}) * sqrt({tp} + {fn}) * sqrt({tn} + {fp}) * sqrt({tn} + {fn}))"
    return (f"{pr} AS precision, {rc} AS recall, {rc} AS tpr, coalesce({fp} / nullif({fp} + {tn}, 0), 0) AS fpr, "
            f"coalesce(2 * {pr} * {rc} / nullif({pr} + {rc}, 0), 0) AS f1, "
            f"coalesce(({tp} * {tn} - {fp} * {fn}) / nullif({den}, 0), 0) AS mcc")


def sql_counts(pred: str) -> str:
    return (f"count(*) FILTER (y_true = 1 AND ({pred})) AS tp, count(*) FILTER (y_true = 0 AND ({pred})) AS fp, "
            f"count(*) FILTER (y_true = 0 AND NOT ({pred})) AS tn, count(*) FILTER (y_true = 1 AND NOT ({pred})) AS fn")


SQL = {
    "conf": f"SELECT model, seed, {sql_counts('y_prob >= 0.5')} FROM predictions GROUP BY ALL",
    "confm": f"SELECT *, {sql_metrics('tp', 'fp', 'tn', 'fn')}, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy "
             "FROM conf",
    "sc": "SELECT model, seed, y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg "
          "FROM predictions GROUP BY ALL",
    "cum": """SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb,
  sum(pos) OVER (PARTITION BY model, seed) AS pt, sum(neg) OVER (PARTITION BY model, seed) AS nt FROM sc
  WINDOW w AS (PARTITION BY model, seed ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "rk": """SELECT model, seed, sum(neg * (pb + pos / 2.0::DOUBLE)) / nullif(max(pt * nt), 0) AS roc_auc,
  sum(CASE WHEN nt > 0 THEN pos::DOUBLE / nullif(pt, 0) * (pb + pos) / (pb + pos + nb + neg) END) AS pr_auc
  FROM cum GROUP BY ALL""",
    "ord": """SELECT model, seed, y_true, row_number() OVER (PARTITION BY model, seed ORDER BY y_prob DESC, id) AS rn,
  count(*) OVER (PARTITION BY model, seed) AS n, sum(y_true) OVER (PARTITION BY model, seed) AS positives
  FROM predictions""",
    "frac": "SELECT unnest([0.01, 0.05, 0.10])::DOUBLE AS fraction",
    "top": """SELECT model, seed, fraction, max(n) AS n, max(positives) AS positives,
  max(greatest(1, ceil(fraction * n)))::BIGINT AS k,
  sum(y_true) FILTER (rn <= greatest(1, ceil(fraction * n))) AS hits FROM ord, frac GROUP BY ALL""",
    "ef": """SELECT *, (hits::DOUBLE / k) / nullif(positives::DOUBLE / n, 0) AS ef,
  ((hits::DOUBLE / k) / nullif(positives::DOUBLE / n, 0))
  / nullif((least(positives, k)::DOUBLE / k) / nullif(positives::DOUBLE / n, 0), 0) AS nef FROM top""",
    "efw": """SELECT model, seed, max(ef) FILTER (fraction = 0.01::DOUBLE AND positives < n) AS ef1,
  max(ef) FILTER (fraction = 0.05::DOUBLE AND positives < n) AS ef5,
  max(ef) FILTER (fraction = 0.10::DOUBLE AND positives < n) AS ef10,
  max(nef) FILTER (fraction = 0.10::DOUBLE AND positives < n) AS nef10 FROM ef GROUP BY ALL""",
    "report": f"SELECT model, seed, {', '.join(METRICS)} FROM confm JOIN rk USING (model, seed) "
              "JOIN efw USING (model, seed)",
    "grid": f"SELECT i AS b, (CASE WHEN i = 500 THEN 1 ELSE i * {STEP} END)::FLOAT AS threshold FROM range(501) t(i)",
    "swc": f"SELECT model, seed, threshold, {sql_counts('y_prob::FLOAT >= threshold')} FROM predictions, grid "
           "GROUP BY ALL",
    "sweep": f"SELECT *, recall - fpr AS youden_j FROM (SELECT *, {sql_metrics('tp', 'fp', 'tn', 'fn')} FROM swc)",
}
SQL["best"] = """SELECT model, seed, (tp + fn > 0 AND fp + tn > 0) AS ok, threshold, tp + fp + tn + fn AS n_oof, """ + \
    ", ".join(f"row_number() OVER (PARTITION BY model, seed ORDER BY round({m}, 12) DESC, threshold) AS r_{m}"
              for m in ("f1", "mcc", "precision", "recall", "youden_j")) + " FROM sweep"
SQL["picks"] = """SELECT model, seed, max(n_oof) AS n_oof,
  max(threshold) FILTER (r_f1 = 1)::DOUBLE AS max_f1_threshold, max(threshold) FILTER (r_mcc = 1)::DOUBLE AS max_mcc_threshold,
  max(threshold) FILTER (r_precision = 1)::DOUBLE AS max_precision_threshold,
  max(threshold) FILTER (r_recall = 1)::DOUBLE AS max_recall_threshold,
  max(threshold) FILTER (r_youden_j = 1)::DOUBLE AS youden_j_threshold FROM best WHERE ok GROUP BY ALL"""
SQL["sel"] = f"""SELECT k.*, 'max_f1' AS selection_rule, max_f1_threshold AS selected_threshold,
  s.f1 AS selected_f1, s.mcc AS selected_mcc, s.precision AS selected_precision, s.recall AS selected_recall
  FROM picks k JOIN (SELECT *, {sql_metrics('tp', 'fp', 'tn', 'fn')} FROM (SELECT p.model, p.seed,
  {sql_counts('y_prob >= max_f1_threshold')} FROM predictions p JOIN picks k ON k.model = p.model AND k.seed = p.seed
  GROUP BY ALL)) s ON s.model = k.model AND s.seed = k.seed"""
SQL_ORDER = list(SQL)
THRESHOLDS = ["max_f1_threshold", "max_mcc_threshold", "max_precision_threshold", "max_recall_threshold",
              "youden_j_threshold"]


SQL_INPUTS = {"confm": ["conf"], "cum": ["sc"], "rk": ["cum"], "top": ["ord", "frac"], "ef": ["top"], "efw": ["ef"],
              "report": ["confm", "rk", "efw"], "swc": ["grid"], "sweep": ["swc"], "best": ["sweep"],
              "picks": ["best"], "sel": ["picks"]}


def on_predictions(body: str, *parts: str, extra: dict[str, str] | None = None) -> str:
    need: list[str] = []

    def add(p: str) -> None:
        for q in SQL_INPUTS.get(p, []):
            add(q)
        if p not in need:
            need.append(p)

    for p in parts:
        add(p)
    return sql_with(["predictions"], {p: SQL[p] for p in need} | (extra or {}), body)


CONF = ["precision", "recall", "tpr", "fpr", "f1", "mcc"]
COUNTS = ["tp", "fp", "tn", "fn"]


@query("agg06_confusion", on_predictions(
    f"SELECT model, seed, {', '.join(COUNTS)}, {sql_rs(CONF)} FROM confm", "confm"))
def confusion(spark, d):
    return rounded(M.confusion_at(predictions(spark, d), BY, 0.5), BY, CONF, COUNTS)


@query("agg07_classifier_report", on_predictions(f"SELECT model, seed, {sql_rs(METRICS)} FROM report", "report"))
def report(spark, d):
    return rounded(M.evaluate(predictions(spark, d), BY), BY, METRICS)


@query("agg08_roc_auc", on_predictions(f"SELECT model, seed, {sql_rs(['roc_auc'], 8)} FROM rk", "rk"))
def roc_auc(spark, d):
    return rounded(M.roc_auc(predictions(spark, d), BY), BY, ["roc_auc"], digits=8)


@query("agg09_average_precision", on_predictions(f"SELECT model, seed, {sql_rs(['pr_auc'], 8)} FROM rk", "rk"))
def average_precision(spark, d):
    return rounded(M.average_precision(predictions(spark, d), BY), BY, ["pr_auc"], digits=8)


@query("agg10_enrichment", on_predictions(
    f"SELECT model, seed, fraction, k::BIGINT AS k, hits::BIGINT AS hits, {sql_rs(['ef', 'nef'])} FROM ef", "ef"))
def enrichment(spark, d):
    return rounded(M.enrichment(predictions(spark, d), BY), [*BY, "fraction"], ["ef", "nef"], ["k", "hits"])


SWEEP = ["precision", "recall", "f1", "mcc", "tpr", "fpr", "youden_j"]


@query("agg11_threshold_sweep", on_predictions(
    f"SELECT model, seed, {sql_rs(['threshold', *SWEEP])}, {', '.join(COUNTS)} FROM sweep", "sweep"))
def sweep(spark, d):
    return rounded(M.sweep(predictions(spark, d), BY), BY, ["threshold", *SWEEP], COUNTS)


SELECTED = ["selected_threshold", "selected_f1", "selected_mcc", "selected_precision", "selected_recall"]


@query("agg12_optimal_thresholds", on_predictions(
    f"SELECT model, seed, selection_rule, n_oof::BIGINT AS n_oof, {sql_rs([*THRESHOLDS, *SELECTED])} FROM sel", "sel"))
def thresholds(spark, d):
    return rounded(M.best_thresholds(predictions(spark, d), BY), [*BY, "selection_rule"], [*THRESHOLDS, *SELECTED],
                   ["n_oof"])


@query("agg13_exact_thresholds", on_predictions(
    """SELECT model, seed, arg_max(y_prob, struct_pack(a := j, b := y_prob)) AS youden_threshold,
    max(j) AS youden_j, arg_max(y_prob, struct_pack(a := f, b := -y_prob)) AS f1_threshold, max(f) AS f1
    FROM (SELECT model, seed, y_prob, round(recall - fpr, 9) + 0.0 AS j, round(f1, 9) + 0.0 AS f FROM exact)
    GROUP BY ALL""", "cum",
    extra={"exact": f"SELECT model, seed, y_prob, {sql_metrics('pb + pos', 'nb + neg', 'nt - nb - neg', 'pt - pb - pos')} "
                    "FROM cum WHERE pt > 0 AND nt > 0"}))
def exact_thresholds(spark, d):
    return rounded(M.exact_thresholds(predictions(spark, d), BY), BY,
                   ["youden_threshold", "youden_j", "f1_threshold", "f1"], digits=9)


CURVE = ["Threshold", "Precision", "Recall", "TPR", "FPR", "F1", "MCC", "selected_threshold"]


@query("agg14_threshold_curve", on_predictions(
    f"""SELECT seed AS split_seed, model, dataset, {sql_r('threshold')} AS Threshold, {sql_r('precision')} AS Precision,
    {sql_r('recall')} AS Recall, {sql_r('tpr')} AS TPR, {sql_r('fpr')} AS FPR, {sql_r('f1')} AS F1,
    {sql_r('mcc')} AS MCC, {sql_r('selected_threshold')} AS selected_threshold FROM
    (SELECT c.*, s.selected_threshold FROM curve c JOIN sel s USING (model, seed))""", "sel",
    extra={"g2": "SELECT i AS b, CASE WHEN i = 500 THEN 1 ELSE i * (1.0::DOUBLE / 500) END AS threshold FROM range(501) t(i)",
           "tagged": "SELECT *, CASE WHEN fold = 0 THEN 'external' ELSE 'oof' END AS dataset FROM predictions",
           "cc": f"SELECT model, seed, dataset, threshold, {sql_counts('y_prob >= threshold')} FROM tagged, g2 GROUP BY ALL",
           "curve": f"SELECT *, {sql_metrics('tp', 'fp', 'tn', 'fn')} FROM cc"}))
def curve(spark, d):
    p = predictions(spark, d)
    tagged = p.withColumn("dataset", F.when(F.col("fold") == 0, "external").otherwise("oof"))
    rows = M.threshold_curve(tagged, [*BY, "dataset"], 501, M.best_thresholds(p, BY))
    return rounded(rows.withColumnRenamed("seed", "split_seed"), ["split_seed", "model", "dataset"], CURVE)


CANDIDATES = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]


@query("agg15_best_candidate", on_predictions(
    f"""SELECT model, seed, {sql_r('t')} AS threshold, {sql_r('mcc')} AS score FROM (SELECT *, row_number() OVER
    (PARTITION BY model, seed ORDER BY round(mcc, 12) DESC, t) AS rn FROM cm) WHERE rn = 1""",
    extra={"cd": f"SELECT unnest({CANDIDATES})::DOUBLE AS t",
           "cc": f"SELECT model, seed, t, {sql_counts('y_prob >= t')} FROM predictions, cd GROUP BY ALL",
           "cm": f"SELECT *, {sql_metrics('tp', 'fp', 'tn', 'fn')} FROM cc"}))
def candidate(spark, d):
    return rounded(M.best_candidate(predictions(spark, d), BY, CANDIDATES, "mcc"), BY, ["threshold", "score"])


@query("agg21_brier", on_predictions(
    f"""SELECT model, seed, {sql_r('avg(b)', 9)} AS brier, count(*) AS folds FROM (SELECT model, seed, fold,
    avg((y_prob - y_true) * (y_prob - y_true)) AS b FROM predictions GROUP BY ALL) GROUP BY ALL"""))
def brier(spark, d):
    return rounded(M.brier(predictions(spark, d), BY), BY, ["brier"], ["folds"], digits=9)


EDGES = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]::DOUBLE[]"
SQL_REL = {
    "edges": f"SELECT model, seed, quantile_cont(y_prob, {EDGES}) AS e FROM predictions GROUP BY ALL",
    "binned": "SELECT p.model, p.seed, y_prob, y_true, len(list_filter(e, lambda v: v < y_prob)) AS raw "
              "FROM predictions p JOIN edges USING (model, seed)",
    "rel": "SELECT model, seed, row_number() OVER (PARTITION BY model, seed ORDER BY raw) - 1 AS bin, "
           "avg(y_prob) AS mean_pred, avg(y_true) AS frac_pos, count(*) AS n FROM binned GROUP BY model, seed, raw",
}


@query("agg22_reliability_curve", on_predictions(
    f"SELECT model, seed, bin::BIGINT AS bin, {sql_rs(['mean_pred', 'frac_pos'], 12)}, n::BIGINT AS n FROM rel",
    extra=SQL_REL))
def reliability(spark, d):
    return rounded(M.reliability(predictions(spark, d), BY), BY, ["mean_pred", "frac_pos"], ["bin", "n"], digits=12)


@query("jn11_reliability_side_by_side", on_predictions(
    f"""SELECT seed, bin::BIGINT AS bin, {sql_rs(['mean_a', 'frac_a', 'mean_b', 'frac_b'], 12)} FROM
    (SELECT seed, bin, mean_pred AS mean_a, frac_pos AS frac_a FROM rel WHERE model = 'LIN_A') FULL JOIN
    (SELECT seed, bin, mean_pred AS mean_b, frac_pos AS frac_b FROM rel WHERE model = 'LIN_B' AND bin < 8)
    USING (seed, bin)""", extra=SQL_REL))
def side_by_side(spark, d):
    rel = M.reliability(predictions(spark, d), BY)
    a = rel.where("model = 'LIN_A'").select("seed", "bin", F.col("mean_pred").alias("mean_a"),
                                            F.col("frac_pos").alias("frac_a"))
    b = rel.where("model = 'LIN_B' AND bin < 8").select("seed", "bin", F.col("mean_pred").alias("mean_b"),
                                                        F.col("frac_pos").alias("frac_b"))
    return rounded(a.join(b, ["seed", "bin"], "full_outer"), ["seed"], ["mean_a", "frac_a", "mean_b", "frac_b"],
                   ["bin"], digits=12)


# curves on the grid: interpolation in plain SQL over all curve points
SQL_CURVES = {
    "pts": """SELECT model, seed, 'roc' AS kind, (pb + pos + nb + neg)::DOUBLE AS o, (nb + neg)::DOUBLE / nt AS x,
  (pb + pos)::DOUBLE / pt AS y FROM cum WHERE pt > 0 AND nt > 0
  UNION ALL SELECT model, seed, 'pr', (pb + pos + nb + neg)::DOUBLE, (pb + pos)::DOUBLE / pt,
  (pb + pos)::DOUBLE / (pb + pos + nb + neg) FROM cum WHERE pt > 0 AND nt > 0
  UNION ALL SELECT DISTINCT model, seed, 'roc', 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM cum WHERE pt > 0 AND nt > 0
  UNION ALL SELECT DISTINCT model, seed, 'pr', 0::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM cum WHERE pt > 0 AND nt > 0""",
    "seg": """SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts
  WINDOW w AS (PARTITION BY model, seed, kind ORDER BY o)""",
    "g4": "SELECT i, CASE WHEN i = 399 THEN 1 ELSE i * (1.0::DOUBLE / 399) END AS gx FROM range(400) t(i)",
    "lastp": """SELECT model, seed, kind, i, gx, arg_max(struct_pack(x := x, y := y, x2 := x2, y2 := y2), o) AS p
  FROM seg JOIN g4 ON x <= gx GROUP BY ALL""",
    "curves": """SELECT model, seed, kind, i, gx AS x, CASE WHEN p.x2 IS NULL THEN p.y ELSE
  (p.y2 - p.y) / (p.x2 - p.x) * (gx - p.x) + p.y END AS y FROM lastp""",
    "band": "SELECT model, kind, i, x, avg(y) AS mean, stddev_pop(y) AS std FROM curves GROUP BY ALL",
    "area": """SELECT model, seed, kind, sum((x - px) * (y + py) / 2) AS area FROM (SELECT *, lag(x) OVER w AS px,
  lag(y) OVER w AS py FROM curves WINDOW w AS (PARTITION BY model, seed, kind ORDER BY i)) GROUP BY ALL""",
}


@query("agg23_curve_band", on_predictions(
    f"SELECT model, kind, i::BIGINT AS i, {sql_rs(['x', 'mean', 'std'])} FROM band", "cum", extra=SQL_CURVES))
def band(spark, d):
    curves = M.resampled_curves(predictions(spark, d), BY)
    return rounded(M.curve_band(curves, ["model"]), ["model", "kind"], ["x", "mean", "std"], ["i"])


@query("win06_model_ranking", on_predictions(
    f"""SELECT model, kind, {sql_rs(['mean', 'std'])}, row_number() OVER (PARTITION BY kind ORDER BY mean DESC,
    std DESC, model) AS position FROM (SELECT model, kind, avg(area) AS mean, stddev_pop(area) AS std FROM area
    GROUP BY ALL)""", "cum", extra=SQL_CURVES))
def ranking(spark, d):
    areas = M.curve_areas(M.resampled_curves(predictions(spark, d), BY), BY)
    return rounded(M.rank_models(areas, ["model"]), ["model", "kind"], ["mean", "std"], ["position"])


@query("agg33_r_squared", on_predictions(
    f"""SELECT model, seed, {sql_r('1 - sum((y_true - y_prob) * (y_true - y_prob)) / nullif(var_pop(y_true) * count(*), 0)')}
    AS r2 FROM predictions GROUP BY ALL"""))
def r2(spark, d):
    return rounded(M.r_squared(predictions(spark, d), BY), BY, ["r2"])


@query("win02_top_fraction_hits", on_predictions(
    "SELECT model, seed, fraction, k::BIGINT AS k, n::BIGINT AS n, hits::BIGINT AS hits FROM top", "top"))
def top_fraction(spark, d):
    return rounded(M.top_hits(predictions(spark, d), BY, [0.01, 0.05, 0.10]), [*BY, "fraction"], [], ["k", "n", "hits"])


@query("jn08_rows_by_threshold", on_predictions(
    f"""SELECT model, seed, {sql_r('threshold')} AS threshold, count(*) FILTER (y_prob::FLOAT >= threshold) AS predicted
    FROM predictions, grid GROUP BY model, seed, threshold"""
    , "grid"))
def by_threshold(spark, d):
    t = M.sweep(predictions(spark, d), BY)
    return t.select(*BY, r("threshold").alias("threshold"), n(F.col("tp") + F.col("fp")).alias("predicted"))


@query("jn10_nearest_curve_row", on_predictions(
    f"""SELECT model, seed, {sql_rs(['threshold', 'precision', 'recall', 'f1', 'mcc'])} FROM (SELECT *, row_number() OVER
    (PARTITION BY model, seed ORDER BY round(abs(threshold::DOUBLE - 0.437), 9), threshold) AS rn FROM sweep)
    WHERE rn = 1""", "sweep"))
def nearest_row(spark, d):
    t = M.sweep(predictions(spark, d), BY)
    gap = F.round(F.abs(F.col("threshold").cast("double") - 0.437), 9)
    best = t.groupBy(*BY).agg(F.min_by(F.struct("threshold", "precision", "recall", "f1", "mcc"),
                                       F.struct(gap, F.col("threshold"))).alias("s"))
    return rounded(best.select(*BY, "s.*"), BY, ["threshold", "precision", "recall", "f1", "mcc"])


@query("win07_ordered_curve", on_predictions(
    f"""SELECT model, seed, {sql_r('fpr')} AS fpr, {sql_r('max(tpr)')} AS tpr, dense_rank() OVER (PARTITION BY model, seed
    ORDER BY {sql_r('fpr')}) AS position FROM sweep WHERE fpr IS NOT NULL AND tpr IS NOT NULL
    GROUP BY model, seed, fpr""", "sweep"))
def ordered_curve(spark, d):
    from pyspark.sql import Window as W
    t = M.sweep(predictions(spark, d), BY).dropna(subset=["fpr", "tpr"])
    pts = t.groupBy(*BY, r("fpr").alias("fpr")).agg(r(F.max("tpr")).alias("tpr"))
    place = F.dense_rank().over(W.partitionBy(*BY).orderBy("fpr"))
    return pts.withColumn("position", n(place)).orderBy(*BY, "position")
