"""Queries that fit models: families, tuning, cross-validation, calibration, permutation test, clusters."""

from __future__ import annotations

import functools

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hitsieve.functions import text as X
from hitsieve.functions.scalar import hash32
from hitsieve.operators import attribution as A, features as FE, metrics as M, models as ML, rollup as R, shapley as SH, splits as SP
from hitsieve.plans.q_features import VECTOR
from hitsieve.plans.q_metrics import on_predictions
from hitsieve.plans.registry import n, query, r, rounded, sql_r
from hitsieve.plans.views import DESCRIPTOR_NAMES, library, predictions, sql_hash, table, vectors
from hitsieve.schemas import FP_BITS, ExplainConfig, TrainConfig
from hitsieve.session import cut_lineage, scratch_path
from hitsieve.sources.sinks import write_parquet

NAMES = [f"x{i}" for i in range(VECTOR)]
FULL, EXPLAIN = TrainConfig(), ExplainConfig()
SMALL = {family: {} for family in FULL.models}  # no setting is cut: every family has the operators' defaults
KEYS = ["id", "y_true", "y_pred", "model"]


def rows(spark, d):
    """Vectors as training rows: sign bits, components as descriptors, label, group."""
    v = vectors(spark, d)
    return v.select(F.col("vec_id").alias("id"), "bits", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(NAMES)],
                    F.col("y"), "role", F.concat(F.lit("g"), (hash32(F.col("vec_id")) % 40).cast("string")).alias("grp"))


def split(spark, d):
    t = rows(spark, d)
    train, ext = t.where("role = 'train'"), t.where("role = 'query'")
    a, b, contract = ML.prepared(train, ext, "bits", VECTOR, NAMES, FULL, 0, 0)
    return cut_lineage(a.drop("bits")), b, contract


def family(name):
    def run(spark, d):
        train, ext, _ = split(spark, d)
        if name == "LR":
            out = ML.with_probability(ML.fit_family(train, name, "y", SMALL[name], 42).transform(ext)).withColumn("y_true", F.col("y"))
        else:
            out = ML.predicted(train, ext, "y", {name: SMALL[name]}, 42).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
        return out.select(
            "id", "y_true", "y_pred", r("y_prob").alias("y_prob"), F.lit(name).alias("model"))
    return run


for key, fam in (("ml01_logistic_regression", "LR"), ("ml02_random_forest", "RFC"), ("ml03_extra_trees", "ETC"),
                 ("ml04_boosted_trees", "XGBC"), ("ml05_kernel_machine", "SVC"), ("ml06_network", "MLP")):
    query(key)(family(fam))


@query("prj07_probability_and_label", """SELECT vec_id AS id, path, true AS agrees FROM embeddings,
(SELECT unnest(['probability', 'label']) AS path) WHERE vec_id % 5 = 0""")
def probability(spark, d):
    train, ext, _ = split(spark, d)
    scored = ML.fit_family(train, "LR", "y", SMALL["LR"]).transform(ext)
    p = F.get(vector_to_array("probability"), F.lit(1))
    same = (F.col("y_prob") == p) & p.between(0, 1) & (F.col("y_pred") == (p >= 0.4).cast("int"))
    with_p = ML.with_probability(scored, 0.4).select("id", F.lit("probability").alias("path"), same.alias("agrees"))
    alone = F.col("y_prob").isNull() & (F.col("y_pred") == F.col("prediction"))
    label = ML.with_probability(scored.drop("probability")).select("id", F.lit("label").alias("path"), alone.alias("agrees"))
    return with_p.unionByName(label)


@query("ml07_tuning")
def tuning(spark, d):
    train, _, _ = split(spark, d)
    folds = cut_lineage(SP.tuning_folds(train, "grp", "y", FULL.search_folds, 7))
    out = []
    for family in FULL.models:
        for kind, scoring in (("grid", "roc_auc"), ("random", "mcc")):
            _, info = ML.tune(folds, family, "y", "fold", kind, FULL.search_iterations, scoring, 7)
            out.append((info["model"], kind, scoring, info["best_score"], str(info["best_params"]), info["cv_folds"]))
    return spark.createDataFrame(out, "model string, search string, scoring string, best_score double, best_params string, folds int")


@query("ml08_out_of_fold")
def oof(spark, d):
    folds = cut_lineage(SP.grouped_folds(rows(spark, d), "grp", "y", FULL.cv_folds, 42))
    out = ML.out_of_fold(folds, "y", "fold", "bits", VECTOR, NAMES, FULL, 42, SMALL)
    return out.withColumn("y_prob", r("y_prob"))


@query("ml09_external_evaluation")
def external(spark, d):
    t = rows(spark, d)
    _, ext, _ = ML.final_models(t.where("role = 'train'"), t.where("role = 'query'"), "y", "bits", VECTOR, NAMES, FULL, 42,
                                {"LR": 0.45, "RFC": 0.5}, SMALL, keep_models=False)
    return rounded(M.evaluate(ext, ["model", "seed"]), ["model", "seed"], ["accuracy", "mcc", "roc_auc", "pr_auc"])


@query("ml10_seeds")
def seeds(spark, d):
    out = ML.run_seeds(rows(spark, d), FULL, label="y", group="grp", bits="bits", n_bits=VECTOR, descriptors=NAMES, params=SMALL)
    long = M.long_metrics(out["external_report"], ["model", "seed"])
    return rounded(R.seed_summary(long), ["model", "metric"], ["mean", "std"], ["n"])


def calibrated(spark, d, method):
    train, _, _ = split(spark, d)
    folds = cut_lineage(SP.grouped_folds(train, "grp", "y", FULL.cv_folds, 42))
    fit = lambda t: ML.fit_family(t, "LR", "y", SMALL["LR"])
    cal = ML.calibrate(folds, "y", "fold", method, fit)
    raw = ML.with_probability(fit(folds).transform(folds)).select("id", F.col("y").alias("y_true"), "y_prob")
    return raw.join(cal, "id")


@query("cal01_sigmoid")
def sigmoid_calibration(spark, d):
    return rounded(calibrated(spark, d, "sigmoid"), ["id", "y_true"], ["y_prob", "y_cal"])


@query("cal02_isotonic")
def isotonic_calibration(spark, d):
    return rounded(calibrated(spark, d, "isotonic"), ["id", "y_true"], ["y_prob", "y_cal"])


@query("cal03_calibration_report", on_predictions(f"""SELECT model, seed, count(*) AS n_samples, {sql_r('avg((y_prob - y_true) ** 2)', 9)} AS brier_raw,
{sql_r('avg((y_cal - y_true) ** 2)', 9)} AS brier_calibrated, {sql_r('avg((y_prob - y_true) ** 2) - avg((y_cal - y_true) ** 2)', 9)} AS brier_improvement
FROM (SELECT *, 0.6 * y_prob + 0.3 AS y_cal FROM predictions) GROUP BY ALL"""))
def calibration_report(spark, d):
    p = predictions(spark, d).withColumn("y_cal", F.col("y_prob") * 0.6 + 0.3)
    return rounded(ML.calibration_report(p, ["model", "seed"]), ["model", "seed"],
                   ["brier_raw", "brier_calibrated", "brier_improvement"], ["n_samples"], digits=9)


@query("rob01_permutation_test")
def permutation_test(spark, d):
    train, ext, _ = split(spark, d)
    scores, actual = ML.permutation_scores(train, cut_lineage(ext), "y", SMALL, 200, 42)
    scores = cut_lineage(scores)
    parts = [R.permutation_summary(scores.where(F.col("model") == m), F.lit(a)).select(F.lit(m).alias("model"), "*") for m, a in sorted(actual.items())]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query("clu01_cluster_scan")
def clusters(spark, d):
    v = FE.scale_arrays(vectors(spark, d), vectors(spark, d), "x", "z").select("vec_id", array_to_vector("z").alias("f"))
    return rounded(ML.cluster_scan(v, "f", range(2, 11)), ["k"], ["inertia", "silhouette"])


@query("clu01_cluster_assignment")
def assignment(spark, d):
    v = FE.scale_arrays(vectors(spark, d), vectors(spark, d), "x", "z").select("vec_id", array_to_vector("z").alias("f"))
    return ML.assign_clusters(v, "f", 8).select("vec_id", "cluster_id")


@query("snk04_saved_model", """SELECT vec_id AS id, true AS same, true AS streamed FROM embeddings WHERE vec_id % 5 = 0""")
def saved_model(spark, d):
    """Stored, loaded, and applied to raw rows in batch and as a stream; an LR model is recomputed from its coefficients."""
    t = rows(spark, d)
    train, processor = ML.fitted(t.where("role = 'train'"), "bits", VECTOR, NAMES, FULL, 0, 0)
    model = ML.fit_family(train, "LR", "y", SMALL["LR"])
    path = scratch_path(spark, "model")
    ML.save_model(spark, model, path, {"features": [list(c) for c in processor.contract()], "family": "LR", "threshold": 0.45}, processor)
    library = scratch_path(spark, "library")
    t.where("role = 'query'").drop("y").write.parquet(library)
    raw = spark.read.parquet(library)
    batch = ML.score_library(spark, raw, path, "id")
    margin = F.lit(float(model.intercept))
    for i, b in enumerate(processor.kept):
        margin = margin + F.array_contains("bits", b).cast("double") * float(model.coefficients[i])
    for i, (name, mu, sd) in enumerate(zip(processor.names, processor.means, processor.sigmas), len(processor.kept)):
        margin = margin + (F.col(name) - mu) / sd * float(model.coefficients[i])
    own = raw.select("id", (1.0 / (1.0 + F.exp(-margin))).alias("own"))
    found = scratch_path(spark, "scores")
    stream = spark.readStream.schema(raw.schema).parquet(library)
    (ML.score_library(spark, stream, path, "id").writeStream.format("parquet").option("path", found)
     .option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination())
    live = spark.read.parquet(found).select("id", F.col("y_prob").alias("live"), F.col("y_pred").alias("live_label"))
    both = batch.join(own, "id").join(live, "id")
    return both.select("id", ((F.abs(F.col("y_prob") - F.col("own")) < 1e-9) & (F.col("y_pred") == (F.col("own") >= 0.45).cast("int"))).alias("same"),
                       ((F.col("live") == F.col("y_prob")) & (F.col("live_label") == F.col("y_pred"))).alias("streamed"))


@query("vs06_trained_library", """SELECT doc_id AS id, true AS same, true AS streamed, true AS labelled FROM documents""")
def trained_library(spark, d):
    """A boosted model trained on the labelled documents' features, saved, and applied to the whole library in batch and as a stream."""
    features = X.with_fingerprint(library(spark, d, keep_tokens=True), tok="_tok", portable=False).select("doc_id", "bits", *DESCRIPTOR_NAMES)
    path, stored = scratch_path(spark, "model"), scratch_path(spark, "features")
    features.write.parquet(stored)
    rows = spark.read.parquet(stored)
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    train, processor = ML.fitted(rows.join(labels, "doc_id"), "bits", FP_BITS, DESCRIPTOR_NAMES, FULL, 0, 0)
    model = ML.fit_family(train, "XGBC", "y", SMALL["XGBC"])
    ML.save_model(spark, model, path, {"features": [list(c) for c in processor.contract()], "family": "XGBC", "threshold": 0.45}, processor)
    own = ML.with_probability(model.transform(processor.transform(rows)), 0.45).select("doc_id", F.col("y_prob").alias("own"))
    batch = ML.score_library(spark, rows, path, "doc_id")
    found = scratch_path(spark, "scores")
    stream = spark.readStream.schema(rows.schema).parquet(stored)
    (ML.score_library(spark, stream, path, "doc_id").writeStream.format("parquet").option("path", found)
     .option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination())
    live = spark.read.parquet(found).select("doc_id", F.col("y_prob").alias("live"), F.col("y_pred").alias("live_label"))
    both = batch.join(own, "doc_id").join(live, "doc_id")
    return both.select(F.col("doc_id").alias("id"), (F.col("own") == F.col("y_prob")).alias("same"),
                       ((F.col("live") == F.col("y_prob")) & (F.col("live_label") == F.col("y_pred"))).alias("streamed"),
                       (F.col("y_pred") == (F.col("y_prob") >= 0.45).cast("int")).alias("labelled"))


# ---- attribution of fitted models ------------------------------------------------------------------------------

def explained(spark, d, name):
    """A fitted model, the background of the published size, the rows to explain as arrays, and the features' names."""
    train, ext, contract = split(spark, d)
    feats = ML.family_features(name)
    model = ML.fit_models(ML.numbered(train, feats, "y"), feats, "_y", [ML.Job(name, SMALL[name], 42)])[0]
    arr = lambda t: t.select("id", vector_to_array(feats).alias("v"))
    background = cut_lineage(arr(train.join(SP.balanced_sample(train, "id", "y", EXPLAIN.background, EXPLAIN.seed).select("id"), "id")))
    return model, background, cut_lineage(arr(ext)), [c[1] for c in contract]


@query("sh02_tree_attribution")
def tree_attribution(spark, d):
    """All external rows by all three tree families."""
    parts = []
    for name in ("RFC", "ETC", "XGBC"):
        model, background, rows, names = explained(spark, d, name)
        parts.append(SH.tree_attribution(rows, background, "v", names, "id", model.blob_bytes).withColumn("model", F.lit(name)))
    every = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return rounded(every, ["model", "id", "feature"], ["value", "base"], digits=9)


@query("sh03_kernel_attribution")
def kernel_attribution(spark, d):
    """All external rows, against the whole background."""
    model, background, rows, names = explained(spark, d, "SVC")
    values = SH.kernel_attribution(rows, background, "v", names, "id", model.predictor(), seed=EXPLAIN.seed)
    return rounded(values, ["id", "feature"], ["value", "base"], digits=9)


@query("sh05_explain_bundle", f"""SELECT part, y, count(*) AS n FROM (SELECT e.vec_id, (label % 2)::INT AS y,
CASE WHEN b.vec_id IS NULL THEN 'explain' ELSE 'background' END AS part FROM embeddings e LEFT JOIN (SELECT vec_id FROM
(SELECT *, row_number() OVER (ORDER BY (rn > greatest(1, floor(256 / k)))::INT, h, vec_id) AS place FROM (SELECT *, row_number() OVER
(PARTITION BY y ORDER BY h, vec_id) AS rn, count(DISTINCT y) OVER () AS k FROM (SELECT vec_id, label % 2 AS y,
{sql_hash("'42:' || vec_id::VARCHAR")} AS h FROM embeddings WHERE vec_id % 5 <> 0)) WHERE rn <= 256) WHERE place <= 256) b USING (vec_id)) GROUP BY ALL""")
def bundle(spark, d):
    t = rows(spark, d)
    path = scratch_path(spark, "bundle")
    bg = SP.balanced_sample(t.where("role = 'train'"), "id", "y", EXPLAIN.background, EXPLAIN.seed)
    write_parquet(A.explain_bundle(t, bg, "id"), path, ("part",))
    return spark.read.parquet(path).groupBy("part", "y").agg(F.count("*").alias("n"))
