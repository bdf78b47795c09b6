"""Model families, tuning, out-of-fold prediction, final fits, calibration, permutation test, clusters."""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitsieve.operators import features as FE, metrics as M
from hitsieve.operators.clean import safe_corr
from hitsieve.operators.manyfits import ArrayModel, Job, fit_many, fit_models  # noqa: F401
from hitsieve.operators.similar import silhouettes
from hitsieve.operators.splits import augment, grouped_folds, group_holdout, permuted_labels, stratified_holdout, tuning_folds
from hitsieve.schemas import SCALED_MODELS, TrainConfig
from hitsieve.session import cut_lineage, scratch_path
from hitsieve.sources.sinks import read_contract, write_contract

# Search spaces per family.
GRID_SPACES: dict[str, dict[str, list]] = {
    "LR": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
    "RFC": {"n_estimators": [200, 500], "max_depth": [None, 10], "min_samples_leaf": [1, 4]},
    "ETC": {"n_estimators": [200, 500], "max_depth": [None, 10], "min_samples_leaf": [1, 4]},
    "SVC": {"C": [1.0, 10.0, 100.0], "gamma": ["scale", 0.01, 0.001]},
    "XGBC": {"n_estimators": [200, 500], "max_depth": [3, 6], "learning_rate": [0.03, 0.1], "subsample": [0.8, 1.0]},
    "MLP": {"hidden_layer_sizes": [(256, 128), (512, 256)], "learning_rate_init": [1e-3, 5e-4]},
}
RANDOM_SPACES: dict[str, dict[str, list]] = {
    "LR": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"]},
    "RFC": {"n_estimators": [200, 400, 700], "max_depth": [None, 6, 10, 16], "min_samples_split": [2, 4, 8, 12],
            "min_samples_leaf": [1, 2, 4, 8], "max_features": ["sqrt", "log2", 0.5]},
    "ETC": {"n_estimators": [200, 400, 700], "max_depth": [None, 6, 10, 16], "min_samples_split": [2, 4, 8, 12],
            "min_samples_leaf": [1, 2, 4, 8], "max_features": ["sqrt", "log2", 0.5]},
    "SVC": {"C": [0.1, 1.0, 10.0, 50.0, 100.0], "gamma": ["scale", 0.1, 0.01, 0.001]},
    "XGBC": {"n_estimators": [200, 300, 500], "max_depth": [3, 4, 6, 8], "learning_rate": [0.01, 0.03, 0.1, 0.2],
             "subsample": [0.7, 0.85, 1.0], "colsample_bytree": [0.6, 0.8, 1.0], "min_child_weight": [1, 3, 5]},
    "MLP": {"hidden_layer_sizes": [(128,), (256, 128), (512, 256), (256, 128, 64)], "alpha": [1e-5, 1e-4, 1e-3, 1e-2],
            "learning_rate_init": [1e-4, 5e-4, 1e-3, 5e-3], "max_iter": [400, 600, 800]},
}
SCORINGS = ("roc_auc", "average_precision", "f1", "balanced_accuracy", "mcc")


def family_columns(df: DataFrame, fit_on: DataFrame, names: Sequence[str], family: str) -> DataFrame:
    """Descriptors scaled for the linear, kernel and network families; raw for trees."""
    return FE.scale_columns(df, fit_on, names) if family in SCALED_MODELS else df


def family_features(family: str) -> str:
    return "features_scaled" if family in SCALED_MODELS else "features_raw"


# ---- estimators ------------------------------------------------------------------------------------------------

def logistic_regression(p: dict, features: str, rows: int) -> LogisticRegression:
    """Spark's estimator; `rows` turns C into a mean-loss penalty."""
    return LogisticRegression(featuresCol=features, maxIter=int(p.get("max_iter", 1000)), standardization=False,
                              regParam=1.0 / (float(p.get("C", 1.0)) * max(rows, 1)),
                              elasticNetParam=1.0 if p.get("penalty", "l2") == "l1" else 0.0)


def numbered(df: DataFrame, features: str, label: str, *more: str) -> DataFrame:
    """Feature vector, labels as an array and a row number, written once so that every task sees the same numbers."""
    return cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), features, F.array(F.col(label).cast("double")).alias("_y"), *more))


def fit_sigmoid(df: DataFrame, vector: str, label: str) -> Model:
    """Platt's sigmoid on a score vector, with his smoothed targets as weighted pairs of rows."""
    n = df.agg(F.sum(F.col(label)).alias("p"), F.count("*").alias("n")).first()
    pos, neg = float(n["p"]), float(n["n"] - n["p"])
    target = F.when(F.col(label) == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    pairs = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")),
                              F.struct(F.lit(0.0).alias("label"), (1.0 - target).alias("w")))).alias("t")
    rows = df.select(vector, pairs).select(vector, "t.label", "t.w")
    return LogisticRegression(featuresCol=vector, labelCol="label", weightCol="w", standardization=False, maxIter=100,
                              rawPredictionCol="_platt_raw", predictionCol="_platt_label").fit(rows)


def with_probability(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`y_prob` and `y_pred` from a model output; without a probability only the label."""
    if "probability" in df.columns:
        p = F.get(vector_to_array("probability"), F.lit(1))
        return df.withColumn("y_prob", p).withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))
    return df.withColumn("y_prob", F.lit(None).cast("double")).withColumn("y_pred", F.col("prediction").cast("int"))


def fit_family(train: DataFrame, family: str, label: str, params: dict | None = None, seed: int = 42,
               features: str | None = None) -> Model:
    """One model: Spark's logistic regression, or a family of `manyfits`."""
    features = features or family_features(family)
    if family == "LR":
        rows = train.select(features, F.col(label).cast("double").alias("label"))
        return logistic_regression(params or {}, features, rows.count()).fit(rows)
    return fit_models(numbered(train, features, label), features, "_y", [Job(family, params or {}, seed)])[0]


def scores_by(df: DataFrame, by: Sequence[str], scoring: str) -> DataFrame:
    """(by, score) on exact counts of rows with `y_true` and `y_prob`; an undefined score counts as the worst."""
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring: {scoring}")
    if scoring == "roc_auc":
        out = M.roc_auc(df, by).withColumn("score", F.col("roc_auc"))
    elif scoring == "average_precision":
        out = M.average_precision(df, by).withColumn("score", F.col("pr_auc"))
    else:
        value = (F.col("tpr") + 1 - F.col("fpr")) / 2 if scoring == "balanced_accuracy" else F.col(scoring)
        out = M.confusion_at(df, by, 0.5).withColumn("score", value)
    return out.select(*by, F.coalesce("score", F.lit(0.0)).alias("score"))


def search_space(family: str, kind: str, n_iter: int, seed: int, space: dict | None = None) -> list[dict]:
    """All combinations, or a seeded subset of `n_iter` of them."""
    space = space or (GRID_SPACES if kind == "grid" else RANDOM_SPACES)[family]
    every = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    if kind == "grid" or len(every) <= n_iter:
        return every
    at = np.random.default_rng(seed).permutation(len(every))[:n_iter]
    return [every[i] for i in sorted(at)]


def search(rows: DataFrame, family: str, label: str, fold: str, kind: str = "random", n_iter: int = 60, scoring: str = "roc_auc",
           seed: int = 42, space: dict | None = None) -> dict:
    """The best candidate over prepared folds: all candidates of all folds are fitted in one job and scored in one more.

    A search that fails raises: settings that were never compared are no result.
    """
    features = family_features(family)
    candidates = search_space(family, kind, n_iter, seed, space)
    table = numbered(rows, features, label, F.col(fold).cast("int").alias("_fold"))
    folds = sorted(r[0] for r in table.select("_fold").distinct().collect())
    if len(folds) < 2 or not candidates:
        raise ValueError(f"a search needs two folds and a candidate; {family} has {len(folds)} and {len(candidates)}")
    info = {"model": family, "cv_folds": len(folds), "n_iter": len(candidates), "search_type": kind}
    jobs = [Job(family, c, seed, f) for c in candidates for f in folds]
    held = fit_many(table, features, "_y", jobs, "_fold")
    seen = table.select("_row", F.get("_y", F.lit(0)).cast("int").alias("y_true"))
    scored = cut_lineage(held.select("job", "_row", F.col("p").alias("y_prob"))).join(seen, "_row")
    got = {r["job"]: r["score"] for r in scores_by(scored, ["job"], scoring).collect()}
    if missing := sorted({k // len(folds) for k in range(len(jobs)) if k not in got}):
        raise RuntimeError(f"{family}: no score for candidates {[candidates[i] for i in missing]}")
    means = [float(np.mean([got[i * len(folds) + k] for k in range(len(folds))])) for i in range(len(candidates))]
    best = int(np.argmax(means))
    return info | {"best_score": means[best], "best_params": candidates[best]}


def tune(train: DataFrame, family: str, label: str, fold: str, kind: str = "random", n_iter: int = 60,
         scoring: str = "roc_auc", seed: int = 42, space: dict | None = None) -> tuple[Model, dict]:
    """The best candidate of a search, refitted on all rows, and what the search found."""
    info = search(train, family, label, fold, kind, n_iter, scoring, seed, space)
    return fit_family(train, family, label, info["best_params"] or None, seed), info


# ---- cross-validation and final fits ---------------------------------------------------------------------------

def fitted(train: DataFrame, bits: str, n_bits: int, descriptors: Sequence[str], config: TrainConfig, seed: int, phase: int,
           text: str | None = None, id_col: str = "id", recompute: Callable[[DataFrame], DataFrame] | None = None,
           ) -> tuple[DataFrame, FE.Processor]:
    """Training rows as the config wants them (augmented, features assembled) and the processor fitted on them."""
    if config.n_augments:
        if text is None:
            raise ValueError("augmentation needs the text column")
        if config.descriptor_mode == "recompute" and recompute is None:
            raise ValueError("recomputed descriptors need a function")
        train = augment(train, id_col, text, config.n_augments, seed, phase,
                        recompute if config.descriptor_mode == "recompute" else None)
    kept = FE.fit_mask(train, bits, n_bits, config.variance_threshold, config.correlation_threshold,
                       config.max_correlation_bits)
    processor = FE.fit_processor(train, bits, n_bits, descriptors, kept, config.missing)
    return processor.transform(train), processor


def prepared(train: DataFrame, other: DataFrame, bits: str, n_bits: int, descriptors: Sequence[str], config: TrainConfig,
             seed: int, phase: int, **options):
    """Train and other rows with features; augmentation, mask and scaling come from the train rows only."""
    rows, processor = fitted(train, bits, n_bits, descriptors, config, seed, phase, **options)
    return rows, processor.transform(other), processor.contract()


def chosen_params(train: DataFrame, family: str, label: str, config: TrainConfig, seed: int, params: dict | None, group: str | None,
                  stage: str, fold: int | None, log: list[dict] | None) -> dict:
    """The given settings of a family, or those a search finds where the config asks for one.

    Each search adds a row to `log`. Too few rows of a class or too few groups for two folds skip the search.
    """
    if config.search == "none" or params is not None:
        return params or {}
    folds = tuning_folds(train.drop("fold"), group, label, config.search_folds, seed) if group else None
    if folds is None:
        return {}
    info = search(cut_lineage(folds), family, label, "fold", config.search, config.search_iterations, config.search_scoring, seed)
    if log is not None:
        log.append({"split_seed": seed, "stage": stage, "fold": fold, "model": family, "best_score": info["best_score"],
                    "cv_type": info["search_type"], "cv_folds": int(info["cv_folds"]), "n_iter": int(info["n_iter"]),
                    "classification_threshold": config.classification_threshold, "best_params_json": json.dumps(info["best_params"])})
    return info["best_params"]


TUNING_TABLE = ("split_seed int, stage string, fold int, model string, best_score double, cv_type string, cv_folds int, n_iter int, "
                "classification_threshold double, best_params_json string")


def out_of_fold(df: DataFrame, label: str, fold: str, bits: str, n_bits: int, descriptors: Sequence[str],
                config: TrainConfig, seed: int, params: dict[str, dict] | None = None, id_col: str = "id",
                group: str | None = None, with_train: bool = False, log: list[dict] | None = None, **options) -> DataFrame:
    """Predictions for every row from models that never saw its fold.

    `with_train` adds the predictions of each model for its own training rows and a column `split` (`val`, `train`).
    """
    params = params or {}
    threshold = config.classification_threshold if config.thresholding else 0.5
    def one(f: int) -> DataFrame:
        train, processor = fitted(df.where(F.col(fold) != f), bits, n_bits, descriptors, config, seed, f, id_col=id_col, **options)
        keep = [id_col, label, "features_raw", "features_scaled"]
        train = cut_lineage(train.select(*keep, *([group] if group else [])))
        settings = {m: chosen_params(train, m, label, config, seed, params.get(m), group, "cv", int(f), log) for m in config.models}
        val = processor.transform(df.where(F.col(fold) == f)).select(*keep)
        both = cut_lineage(train.select(*keep).withColumn("_fold", F.lit(0)).unionByName(val.withColumn("_fold", F.lit(-1)))
                           .withColumns({"_row": F.monotonically_increasing_id(), "_y": F.array(F.col(label).cast("double"))}))
        shown = both.select("_row", F.col(id_col).alias("id"), F.col(label).cast("int").alias("y_true"),
                            F.when(F.col("_fold") < 0, "val").otherwise("train").alias("split"))
        out = cut_lineage(together(both, settings, seed, "all" if with_train else "held")).join(shown, "_row").select(
            "id", "y_true", (F.col("y_prob") >= threshold).cast("int").alias("y_pred"), "y_prob", "model", F.lit(seed).alias("seed"),
            F.lit(int(f)).alias("fold"), "split")
        return out if with_train else out.drop("split")

    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    with ThreadPoolExecutor(max(1, len(folds))) as pool:  # folds share nothing but their input
        parts = list(pool.map(one, folds))
    return functools.reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def together(rows: DataFrame, settings: Mapping[str, dict], seed: int, scope: str) -> DataFrame:
    """(_row, model, y_prob) of all families in one job for each feature column; rows with `_fold` below 0 are not trained on."""
    parts = None
    for features in ("features_raw", "features_scaled"):
        some = [m for m in settings if family_features(m) == features]
        if not some:
            continue
        got = fit_many(rows, features, "_y", [Job(m, settings[m], seed) for m in some], "_fold", scope)
        got = got.select("_row", F.get(F.array(*map(F.lit, some)), F.col("job")).alias("model"), F.col("p").alias("y_prob"))
        parts = got if parts is None else parts.unionByName(got)
    return parts


def predicted(train: DataFrame, external: DataFrame, label: str, settings: Mapping[str, dict], seed: int, id_col: str = "id") -> DataFrame:
    """(id, y_true, model, y_prob) of the external rows by models fitted on the training rows.

    The external rows go with the training rows and are scored where a model, or a part of its trees, was grown; no model
    is collected or sent.
    """
    keep = [id_col, label, "features_raw", "features_scaled"]
    rows = cut_lineage(train.select(*keep, F.lit(0).alias("_fold")).unionByName(external.select(*keep, F.lit(-1).alias("_fold")))
                       .withColumns({"_row": F.monotonically_increasing_id(), "_y": F.array(F.col(label).cast("double"))}))
    shown = rows.where("_fold < 0").select("_row", F.col(id_col).alias("id"), F.col(label).cast("int").alias("y_true"))
    return cut_lineage(together(rows, settings, seed, "held")).join(shown, "_row").select("id", "y_true", "model", "y_prob")


def final_models(dev: DataFrame, external: DataFrame, label: str, bits: str, n_bits: int, descriptors: Sequence[str],
                 config: TrainConfig, seed: int, thresholds: dict[str, float], params: dict[str, dict] | None = None,
                 id_col: str = "id", group: str | None = None, log: list[dict] | None = None, keep_models: bool = True, **options,
                 ) -> tuple[dict[str, Model], DataFrame, FE.Processor]:
    """Fits on all development rows; external predictions at the locked thresholds (`threshold`); the processor.

    Without `keep_models` no model is collected: full-grown forests grow with their rows.
    """
    params = params or {}
    train, processor = fitted(dev, bits, n_bits, descriptors, config, seed, 99, id_col=id_col, **options)
    train = cut_lineage(train.select(id_col, label, *([group] if group else []), "features_raw", "features_scaled"))
    ext = processor.transform(external)
    settings = {m: chosen_params(train, m, label, config, seed, params.get(m), group, "final", None, log) for m in config.models}
    at = F.element_at(F.create_map(*[F.lit(v) for m in config.models for v in (m, float(thresholds.get(m, 0.5)))]), F.col("model"))
    if not keep_models:
        out = predicted(train, ext, label, settings, seed, id_col).withColumn("threshold", at)
        return {}, out.select("id", "y_true", (F.col("y_prob") >= F.col("threshold")).cast("int").alias("y_pred"), "y_prob", "model",
                              F.lit(seed).alias("seed"), "threshold"), processor
    models, parts = {}, None
    for features in ("features_raw", "features_scaled"):
        some = [m for m in config.models if family_features(m) == features]
        fits = fit_models(numbered(train, features, label), features, "_y", [Job(m, settings[m], seed) for m in some]) if some else []
        models |= dict(zip(some, fits))
    for family in config.models:
        at = float(thresholds.get(family, 0.5))
        out = with_probability(models[family].transform(ext), at).select(
            F.col(id_col).alias("id"), F.col(label).cast("int").alias("y_true"), "y_pred", "y_prob",
            F.lit(family).alias("model"), F.lit(seed).alias("seed"), F.lit(at).alias("threshold"))
        parts = out if parts is None else parts.unionByName(out)
    return models, parts, processor


def run_seed(df: DataFrame, label: str, group: str, bits: str, n_bits: int, descriptors: Sequence[str], config: TrainConfig,
             seed: int, params: dict[str, dict] | None = None, id_col: str = "id", **options) -> dict[str, DataFrame]:
    """One seed: hold-out, out-of-fold predictions, locked thresholds, final fits, external report, tuning table."""
    df = df.drop("role", "fold")
    if config.split_method == "group":
        split = group_holdout(df, group, label, config.test_size, seed)
    else:
        roles = stratified_holdout(df, id_col, label if config.split_method == "stratified" else None, config.test_size, seed)
        split = df.join(roles.select(id_col, "role"), id_col)
    split = cut_lineage(split)
    dev, external = split.where("role = 'dev'"), split.where("role = 'external'")
    folds = cut_lineage(grouped_folds(dev, group, label, config.cv_folds, seed))
    log: list[dict] = []
    every = cut_lineage(out_of_fold(folds, label, "fold", bits, n_bits, descriptors, config, seed, params, id_col, group, True, log, **options))
    oof = every.where("split = 'val'").drop("split")
    locked = cut_lineage(M.best_thresholds(oof, ["model", "seed"], config.selection_rule, config.sweep_points))
    chosen = {r["model"]: r["selected_threshold"] for r in locked.collect()}
    _, ext, _ = final_models(dev, external, label, bits, n_bits, descriptors, config, seed, chosen, params, id_col, group, log, False, **options)
    ext = cut_lineage(ext)
    at = config.classification_threshold if config.thresholding else 0.5
    log.sort(key=lambda row: (row["stage"], -1 if row["fold"] is None else row["fold"], row["model"]))
    tuned = dev.sparkSession.createDataFrame([tuple(row.values()) for row in log], TUNING_TABLE)
    return {"oof": oof, "thresholds": locked, "external": ext, "tuning": tuned,
            "fold_metrics": M.evaluate(every, ["model", "seed", "fold", "split"], at),
            "external_report": M.evaluate(ext, ["model", "seed"], "threshold"),
            "curves": M.threshold_curve(oof.withColumn("dataset", F.lit("oof")), ["model", "seed", "dataset"],
                                        config.curve_points, locked)}


def run_seeds(df: DataFrame, config: TrainConfig, **kw) -> dict[str, DataFrame]:
    """All seeds; each table is the union over seeds."""
    with ThreadPoolExecutor(max(1, len(config.seeds))) as pool:
        runs = list(pool.map(lambda seed: run_seed(df, config=config, seed=seed, **kw), config.seeds))
    return {name: functools.reduce(lambda a, b: a.unionByName(b), [r[name] for r in runs]) for name in (runs[0] if runs else {})}


# ---- calibration -----------------------------------------------------------------------------------------------

def calibrate(df: DataFrame, label: str, fold: str, method: str, fit: Callable[[DataFrame], Model], id_col: str = "id",
              out: str = "y_cal") -> DataFrame:
    """Calibrated probability of every row: the mean over folds of refitted model plus calibrator.

    Per fold the model is fitted on the other folds and the calibrator on its scores of the fold. A sigmoid calibrator
    sees the model's margin where it has one, an isotonic one the probability.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = None
    for f in folds:
        model = fit(df.where(F.col(fold) != f))
        seen = with_probability(model.transform(df))
        # Platt's sigmoid is meant for margins; isotonic steps are the same on either scale
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1)) if "rawPrediction" in seen.columns else F.col("y_prob")
        shown = margin if method == "sigmoid" else F.col("y_prob")
        scores = seen.select(id_col, label, F.col(fold).alias("_fold"), "y_prob", array_to_vector(F.array(shown)).alias("_s"))
        held = scores.where(F.col("_fold") == f)
        if method == "isotonic":
            iso = IsotonicRegression(featuresCol="_s", labelCol=label, predictionCol="_c").fit(
                held.withColumn(label, F.col(label).cast("double")))
            got = iso.transform(scores.drop(label)).select(id_col, F.col("_c").alias("p"))
        elif method == "sigmoid":
            got = with_probability(fit_sigmoid(held.drop("y_prob"), "_s", label).transform(scores.select(id_col, "_s"))
                                   ).select(id_col, F.col("y_prob").alias("p"))
        else:
            raise ValueError(f"unknown method: {method}")
        parts = got if parts is None else parts.unionByName(got)
    return parts.groupBy(id_col).agg(F.avg("p").alias(out))


def calibration_report(df: DataFrame, by: Sequence[str], raw: str = "y_prob", calibrated: str = "y_cal") -> DataFrame:
    """Brier scores before and after and their difference."""
    b = lambda c: F.avg(F.pow(F.col(c) - F.col("y_true"), 2))
    return (df.groupBy(*by).agg(F.count("*").alias("n_samples"), b(raw).alias("brier_raw"), b(calibrated).alias("brier_calibrated"))
            .withColumn("brier_improvement", F.col("brier_raw") - F.col("brier_calibrated")))


# ---- permutation test, clusters --------------------------------------------------------------------------------

def permutation_scores(dev: DataFrame, external: DataFrame, label: str, settings: Mapping[str, dict], permutations: int, seed: int,
                       id_col: str = "id") -> tuple[DataFrame, dict[str, float]]:
    """(model, permutation_idx, y_corr, metric) of models refitted on permuted labels, and each model's actual score.

    The labels of all runs are columns of one array beside a row's features, and all refits of all families run in one
    job for each feature column. The metric is the area under the ROC curve of the external rows, which no run trains on.
    """
    permuted = permuted_labels(dev, id_col, label, permutations, seed)
    corr = permuted.groupBy("permutation").agg(safe_corr(label, "permuted").alias("y_corr"))
    runs = permuted.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("permutation", "permuted"))).alias("_p"))
    keep = [id_col, label, "features_raw", "features_scaled"]
    own = F.array(F.col(label).cast("double"))
    train = dev.select(*keep).join(runs, id_col).select(*keep, F.concat(own, F.transform("_p", lambda r: r["permuted"].cast("double"))).alias("_y"),
                                                        F.lit(0).alias("_fold"))
    blank = external.select(*keep, F.array_repeat(F.lit(0.0), permutations + 1).alias("_y"), F.lit(-1).alias("_fold"))
    rows = cut_lineage(train.unionByName(blank).withColumn("_row", F.monotonically_increasing_id()))
    actual = rows.where("_fold < 0").select("_row", F.col(label).cast("int").alias("y_true"))
    parts = None
    for features in ("features_raw", "features_scaled"):
        jobs = [(m, k) for m in settings if family_features(m) == features for k in range(permutations + 1)]
        if not jobs:
            continue
        got = fit_many(rows, features, "_y", [Job(m, settings[m], seed, label=k) for m, k in jobs], "_fold")
        named = F.get(F.array(*[F.lit(m) for m, _ in jobs]), F.col("job"))
        got = got.select("_row", named.alias("model"), F.pmod("job", F.lit(permutations + 1)).alias("permutation_idx"), F.col("p").alias("y_prob"))
        parts = got if parts is None else parts.unionByName(got)
    scored = cut_lineage(M.roc_auc(cut_lineage(parts).join(actual, "_row"), ["model", "permutation_idx"]).withColumnRenamed("roc_auc", "metric"))
    out = scored.where("permutation_idx > 0").join(corr.withColumnRenamed("permutation", "permutation_idx"), "permutation_idx")
    return (out.select("model", "permutation_idx", "y_corr", "metric"),
            {r["model"]: r["metric"] for r in scored.where("permutation_idx = 0").collect()})


def cluster_scan(df: DataFrame, features: str, ks: Sequence[int], seed: int = 42, workers: int = 4) -> DataFrame:
    """(k, inertia, silhouette) per number of clusters; the silhouette is the exact Euclidean one."""
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), features))

    def one(k: int) -> tuple:
        model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol=f"_k{k}").fit(rows)
        return k, float(model.summary.trainingCost), model

    with ThreadPoolExecutor(workers) as pool:
        found = list(pool.map(one, ks))
    labelled = rows
    for _, _, model in found:
        labelled = model.transform(labelled)
    labelled = cut_lineage(labelled.withColumn("_v", vector_to_array(features)))
    shapes = silhouettes(labelled, "_row", "_v", [f"_k{k}" for k in ks])
    costs = df.sparkSession.createDataFrame([(k, cost, f"_k{k}") for k, cost, _ in found], "k int, inertia double, labelling string")
    return costs.join(shapes, "labelling", "left").select("k", "inertia", "silhouette")


def assign_clusters(df: DataFrame, features: str, k: int = 8, seed: int = 42) -> DataFrame:
    """Cluster ids from 1."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="_c").fit(df)
    return model.transform(df).withColumn("cluster_id", F.col("_c") + 1).drop("_c")


def save_model(spark: SparkSession, model: Model, path: str, contract: dict, processor: FE.Processor | None = None) -> None:
    """Model with its feature contract beside it; a processor makes the saved model able to build its own features."""
    if processor is not None:
        contract = {**contract, "processor": processor.saved()}
    whole = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    whole.write().overwrite().save(f"{path}/model")
    write_contract(spark, f"{path}/contract", contract)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), read_contract(spark, f"{path}/contract")


def score_library(spark: SparkSession, library: DataFrame, path: str, id_col: str) -> DataFrame:
    """(id, y_prob, y_pred) of a batch or streaming library by a saved model, its processor and its threshold."""
    model, contract = load_model(spark, path)
    rows = FE.Processor.loaded(contract["processor"]).transform(library)
    return with_probability(model.transform(rows), float(contract.get("threshold", 0.5))).select(id_col, "y_prob", "y_pred")
