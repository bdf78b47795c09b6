"""Queries of the screening path: filters, funnels, feature store, scoring, attribution, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitsieve.functions import text as X
from hitsieve.functions.scalar import clip01, predict_label
from hitsieve.operators import attribution as A, metrics as M, screen as SC
from hitsieve.plans.q_metrics import BY, on_predictions
from hitsieve.plans.registry import n, query, r, rounded, sql_r, sql_rs
from hitsieve.plans.views import (CATALOGUE, DESCRIPTOR_NAMES, DESIRED, MODELS, TEXT_BASIC_RULES, TEXT_STRICT_RULES,
                                  _lin, documents, library, linear, predictions, sigmoid, sql_with, table)
from hitsieve.session import scratch_path
from hitsieve.sources import sinks
from hitsieve.sources.tables import read_library_stream
from hitsieve.streaming import score as ST

MAX_LENGTH = 6000
LEAST = 0.4
SYMBOLS = [c for c in "abcdefghijklmnopqrstuvwxyz.,;:!?'\"()-"]


def sql_rules(rules) -> str:
    parts = []
    for x in rules:
        parts += [f"{x.column} >= {x.lo}"] if x.lo is not None else []
        parts += [f"{x.column} <= {x.hi}"] if x.hi is not None else []
    return "coalesce(" + " AND ".join(parts) + ", false)"


SQL_CATALOGUE = "regexp_matches(text, '" + "|".join(f"(?:{p})" for p in CATALOGUE) + "')"
SQL_SYMBOLS = ("len(list_filter(list_distinct(string_split(lower(array_to_string(tok, '')), '')), lambda c: NOT list_contains(["
               + ", ".join("'" + s.replace("'", "''") + "'" for s in SYMBOLS) + "], c))) = 0")
_TOTAL = sum(x[0] for x in DESIRED)
SQL_SCORE = "exp((" + " + ".join(
    f"{w} * ln(1 / (1 + exp({'-' if up else ''}(({c} - {mid}) / {width}::DOUBLE))))" for w, c, mid, width, up in DESIRED
) + f") / {_TOTAL}::DOUBLE)"


def letters():
    """Distinct letters of a row, as its symbols."""
    return F.array_distinct(F.split(F.lower(F.array_join("_tok", "")), ""))


def basic():
    return SC.basic_stages("text", TEXT_BASIC_RULES, CATALOGUE, MAX_LENGTH)


def strict():
    return SC.strict_stages(letters(), SYMBOLS, TEXT_STRICT_RULES, DESIRED, LEAST)


@query("flt03_length_filter", f"SELECT doc_id, source FROM documents WHERE length(text) < {MAX_LENGTH}")
def length_filter(spark, d):
    return documents(spark, d).where(F.length("text") < MAX_LENGTH).select("doc_id", "source")


@query("flt04_upper_bounds", sql_with(["library"], {}, f"SELECT doc_id, source FROM library WHERE {sql_rules(TEXT_BASIC_RULES)}"))
def upper_bounds(spark, d):
    return library(spark, d).where(X.rule_filter(TEXT_BASIC_RULES)).select("doc_id", "source")


@query("flt05_strict_ranges", sql_with(["library"], {}, f"SELECT doc_id, source FROM library WHERE {sql_rules(TEXT_STRICT_RULES)}"))
def strict_ranges(spark, d):
    return library(spark, d).where(X.rule_filter(TEXT_STRICT_RULES)).select("doc_id", "source")


@query("flt06_allowed_symbols", sql_with(["library"], {}, f"SELECT doc_id, source FROM library WHERE {SQL_SYMBOLS}"))
def allowed(spark, d):
    docs = X.with_tokens(documents(spark, d))
    return docs.where(X.symbols_allowed(letters(), SYMBOLS)).select("doc_id", "source")


@query("flt07_pattern_catalogue", f"SELECT doc_id, source FROM documents WHERE NOT {SQL_CATALOGUE}")
def catalogue(spark, d):
    return documents(spark, d).where(~X.catalogue_match(F.col("text"), CATALOGUE)).select("doc_id", "source")


@query("flt08_desirability", sql_with(["library"], {}, f"""SELECT doc_id, {sql_r(SQL_SCORE)} AS score FROM library
WHERE {SQL_SCORE} >= {LEAST}"""))
def desirable(spark, d):
    lib = library(spark, d).withColumn("score", SC.desirability_score(DESIRED))
    return rounded(lib.where(F.col("score") >= LEAST), ["doc_id"], ["score"])


SQL_BASIC = {"length": f"length(text) < {MAX_LENGTH}", "rules": sql_rules(TEXT_BASIC_RULES), "catalogue": f"NOT {SQL_CATALOGUE}"}
SQL_STRICT = {"symbols": SQL_SYMBOLS, "ranges": sql_rules(TEXT_STRICT_RULES), "desirability": f"coalesce({SQL_SCORE} >= {LEAST}, false)"}


def sql_funnel(stages: dict[str, str]) -> str:
    rows, seen = ["SELECT 0 AS stage, 'input' AS name, count(*) AS rows FROM library"], []
    for i, (name, cond) in enumerate(stages.items()):
        seen.append(cond)
        rows.append(f"SELECT {i + 1}, '{name}', count(*) FILTER ({' AND '.join(seen)}) FROM library")
    return " UNION ALL ".join(rows)


@query("flt09_filter_funnel", sql_with(["library"], {}, sql_funnel(SQL_BASIC | SQL_STRICT)))
def funnel(spark, d):
    stages = basic() + strict()
    t = SC.funnel(library(spark, d, keep_tokens=True), stages)
    return t.select("stage", "name", n("rows").alias("rows"))


@query("vs01_basic_funnel", sql_with(["library"], {}, f"SELECT doc_id, text, source FROM library WHERE {' AND '.join(SQL_BASIC.values())}"))
def basic_funnel(spark, d):
    return SC.survivors(library(spark, d), basic()).select("doc_id", "text", "source")


@query("vs02_strict_funnel", sql_with(["library"], {}, f"SELECT doc_id, source FROM library WHERE {' AND '.join(SQL_STRICT.values())}"))
def strict_funnel(spark, d):
    return SC.survivors(library(spark, d, keep_tokens=True), strict()).select("doc_id", "source")


STORE = ["n_chars", "unique_ratio", "digit_ratio"]


@query("vs03_feature_store", sql_with(["library"], {}, f"""SELECT doc_id, {', '.join(f'{sql_r(f"{c}::FLOAT", 5)} AS {c}' for c in STORE)},
{', '.join(f'({c} IS NULL) AS {c}__isna' for c in STORE)} FROM library WHERE len(tok) > 0"""))
def store(spark, d):
    path = scratch_path(spark, "store")
    sinks.write_parquet(SC.feature_store(documents(spark, d, "doc_id", "text"), "doc_id", "text", STORE, 2048), path)
    back = spark.read.parquet(path)
    return rounded(back, ["doc_id", *[f"{c}__isna" for c in STORE]], STORE, digits=5)


MESSY = """SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE 'v' || vec_id END AS txt,
CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding[1]::DOUBLE END AS a, vec_id % 5 <> 0 AS ok FROM embeddings"""


def messy(spark, d):
    i = F.col("vec_id")
    e = table(spark, d, "embeddings").select(
        "vec_id", F.when(i % 13 == 0, None).otherwise(F.concat(F.lit("v"), i.cast("string"))).alias("txt"),
        F.when(i % 7 == 0, None).otherwise(F.get("embedding", F.lit(0)).cast("double")).alias("a"), (i % 5 != 0).alias("ok"))
    return SC.skip_reasons(e, "vec_id", "txt", ["a"], F.col("ok"))


REASON = "CASE WHEN txt IS NULL OR txt = '' THEN 'base' WHEN a IS NULL THEN 'nan' WHEN NOT ok THEN 'text' END"


@query("flt10_skip_reasons", sql_with([], {"m": MESSY}, f"SELECT vec_id, {REASON} AS skip_reason FROM m"))
def reasons(spark, d):
    return messy(spark, d).select("vec_id", "skip_reason")


@query("agg32_skip_counters", sql_with([], {"m": MESSY, "s": f"SELECT {REASON} AS w FROM m"}, """SELECT count(*) AS processed,
count(*) FILTER (w IS NULL) AS predicted, count(w) AS skipped, count(*) FILTER (w = 'nan') AS skipped_nan,
count(*) FILTER (w = 'text') AS skipped_text FROM s"""))
def skip_counters(spark, d):
    return SC.counters(messy(spark, d))


@query("prj06_clip_and_label", f"""SELECT vec_id, {sql_r('p', 5)} AS prob, (p >= 0.3)::TINYINT AS pred_label FROM
(SELECT vec_id, greatest(least((embedding[1]::DOUBLE * 5 + 0.5)::FLOAT, 1), 0)::FLOAT AS p FROM embeddings)""")
def clipped(spark, d):
    p = clip01(F.get("embedding", F.lit(0)).cast("double") * 5 + 0.5)
    e = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return e.select("vec_id", r("p", 5).alias("prob"), predict_label(F.col("p"), 0.3).alias("pred_label"))


A_SQL = f"1 / (1 + exp(-({_lin(MODELS['LIN_A'])})))"
SCORED_SQL = f"""SELECT doc_id AS id, text, {sql_r(f'({A_SQL})::FLOAT', 5)} AS prob,
({A_SQL} >= 0.75)::TINYINT AS pred_label, 'LIN_A' AS model_name, 7::BIGINT AS seed, {sql_r('0.75')} AS threshold_used FROM library"""


def score_all(df):
    return SC.score_rows(df, sigmoid(linear(MODELS["LIN_A"])), 0.75, "LIN_A", 7, "doc_id", "text")


def shown(df):
    return df.select("id", "text", r("prob", 5).alias("prob"), "pred_label", "model_name", "seed",
                     r("threshold_used").alias("threshold_used"))


@query("vs06_scored_library", sql_with(["library"], {}, SCORED_SQL))
def scored(spark, d):
    return shown(score_all(library(spark, d)))


@query("vs06_hits_by_source", sql_with(["library"], {"s": f"SELECT source, {A_SQL} AS p FROM library WHERE length(text) < {MAX_LENGTH} "
       f"AND {sql_rules(TEXT_BASIC_RULES)}"}, f"SELECT source, count(*) AS passed, count(*) FILTER (p >= 0.75) AS hits, "
       f"{sql_r('avg(p)')} AS mean_prob FROM s GROUP BY source"))
def hits_by_source(spark, d):
    """Which sources yield hits after the funnel."""
    names = ["n_chars", "mean_token", "digit_ratio", "punct_ratio", "symbol_ratio", "unique_ratio"]
    docs = documents(spark, d).where(F.length("text") < MAX_LENGTH)
    rows = X.with_descriptors(docs, names).where(X.rule_filter(TEXT_BASIC_RULES)).withColumn(
        "p", sigmoid(linear(MODELS["LIN_A"])))
    return rows.groupBy("source").agg(F.count("*").alias("passed"), F.count_if(F.col("p") >= 0.75).alias("hits"),
                                      r(F.avg("p")).alias("mean_prob"))


@query("vs05_sanity_check", sql_with(["library"], {}, f"""SELECT count(*) AS rows, 0::BIGINT AS nan_rows, 2048::BIGINT AS n_bits,
{len(STORE)}::BIGINT AS n_descriptors FROM library WHERE len(tok) > 0"""))
def sanity(spark, d):
    lib = SC.feature_store(documents(spark, d, "doc_id", "text"), "doc_id", "text", STORE, 2048)
    got = SC.sanity_check(lib, STORE, "bits", 2048)
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} bigint" for k in got))


@query("vs07_resolved_threshold", on_predictions(f"""SELECT model, seed, {sql_r('max_f1_threshold')} AS f1, {sql_r('max_mcc_threshold')} AS mcc,
{sql_r('youden_j_threshold')} AS youden, 0.7::DOUBLE AS fixed FROM sel""", "sel"))
def resolved(spark, d):
    t = M.best_thresholds(predictions(spark, d), BY)
    for metric in ("f1", "mcc", "youden"):
        t = SC.resolve_threshold(t, "auto", metric, out=f"_{metric}")
    t = SC.resolve_threshold(t, 0.7, out="_fixed")
    return t.select(*BY, *[r(f"_{m}").alias(m) for m in ("f1", "mcc", "youden", "fixed")])


@query("vs09_scaled_for_family", sql_with(["library"], {"fit": "SELECT avg(n_chars) AS mu, stddev_pop(n_chars) AS sd FROM library "
                                                                 "WHERE doc_id IN (SELECT doc_id FROM labels)"},
                                          f"""SELECT doc_id, {sql_r('(n_chars - mu) / sd')} AS for_lr,
{sql_r('n_chars')} AS for_rfc FROM library, fit"""))
def family_scaling(spark, d):
    from hitsieve.operators.models import family_columns
    lib = library(spark, d, ["n_chars"])
    train = lib.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")  # the moments are those of training
    lr = family_columns(lib, train, ["n_chars"], "LR").select("doc_id", r("n_chars").alias("for_lr"))
    rf = family_columns(lib, train, ["n_chars"], "RFC").select("doc_id", r("n_chars").alias("for_rfc"))
    return lr.join(rf, "doc_id")


# ---- attribution -----------------------------------------------------------------------------------------------

COEF = {k: v for k, v in MODELS["LIN_A"].items() if k != "bias"}
SHAP_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS feature, {v} * (coalesce({k}, 0) - avg({k}) OVER ()) AS value FROM library"
                              for k, v in COEF.items())


def linear_values(spark, d):
    lib = library(spark, d, list(COEF))
    return A.linear_attribution(lib, lib, COEF, MODELS["LIN_A"]["bias"], "doc_id")


@query("sh01_linear_attribution", sql_with(["library"], {"v": SHAP_SQL}, f"SELECT doc_id, feature, {sql_rs(['value'])} FROM v"))
def linear_attribution(spark, d):
    return rounded(linear_values(spark, d), ["doc_id", "feature"], ["value"])


@query("agg30_feature_importance", sql_with(["library"], {"v": SHAP_SQL}, f"SELECT feature, {sql_r('avg(abs(value))')} AS mean_abs FROM v GROUP BY feature"))
def importance(spark, d):
    return rounded(A.importance(linear_values(spark, d)), ["feature"], ["mean_abs"])


@query("sh04_attribution_tables", sql_with(["library"], {"v": SHAP_SQL}, f"""SELECT feature, {sql_r('avg(abs(value))')} AS mean_abs,
{sql_r('max(value)')} AS largest, {sql_r('min(value)')} AS smallest, 'linear' AS method, 'margin' AS model_output, count(*) AS n
FROM v GROUP BY feature"""))
def attribution_tables(spark, d):
    path = scratch_path(spark, "attribution")
    sinks.write_parquet(linear_values(spark, d), path)
    v = spark.read.parquet(path)
    t = v.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.max("value").alias("largest"),
                                 F.min("value").alias("smallest"), F.count("*").alias("n"))
    t = t.withColumns({"method": F.lit("linear"), "model_output": F.lit("margin")})
    return rounded(t, ["feature", "method", "model_output"], ["mean_abs", "largest", "smallest"], ["n"])


@query("win05_top_features", sql_with(["library"], {"v": SHAP_SQL}, f"""SELECT feature, {sql_r('avg(abs(value))')} AS mean_abs FROM v
GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 3"""))
def top_features(spark, d):
    return rounded(A.top_features(linear_values(spark, d), 3), ["feature"], ["mean_abs"])


@query("sh06_heat_map", sql_with(["library"], {"v": SHAP_SQL,
    "t": "SELECT feature, row_number() OVER (ORDER BY avg(abs(value)) DESC, feature) AS place FROM v GROUP BY feature"},
    f"""SELECT doc_id, feature, {sql_r('value')} AS value, place FROM v JOIN t USING (feature) WHERE place <= 3
AND doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 64)"""))
def heat_map(spark, d):
    t = A.heat_map(linear_values(spark, d), "doc_id", 64, 3)
    return rounded(t, ["doc_id", "feature"], ["value"], ["place"])


# ---- streams ---------------------------------------------------------------------------------------------------

def staged_files(spark, d, df=None, parts=3, key="doc_id"):
    """Library files as a stream source sees them arrive: at least `parts`, and no fewer than the tasks that scan the rows."""
    path = scratch_path(spark, "arrivals")
    rows = documents(spark, d) if df is None else df
    rows.repartition(max(parts, rows.rdd.getNumPartitions()), F.col(key)).write.parquet(path)
    return path


@query("str01_stream_scores", sql_with(["library"], {}, SCORED_SQL))
def stream_scores(spark, d):
    path, out, ck = staged_files(spark, d), scratch_path(spark, "scores"), scratch_path(spark, "ck")
    source = read_library_stream(spark, path, spark.read.parquet(path).schema)
    names = [k for k in COEF]
    ST.score_stream(source, lambda s: score_all(X.with_descriptors(s, names)), out, ck)
    return shown(spark.read.parquet(out))


@query("str02_stream_counters", sql_with([], {"m": MESSY, "s": f"SELECT {REASON} AS w FROM m"}, """SELECT count(*) AS processed,
count(*) FILTER (w IS NULL) AS predicted, count(w) AS skipped, count(*) FILTER (w = 'nan') AS skipped_nan,
count(*) FILTER (w = 'text') AS skipped_text FROM s"""))
def stream_counters(spark, d):
    path, out, ck = staged_files(spark, d, messy(spark, d), key="vec_id"), scratch_path(spark, "counts"), scratch_path(spark, "ck")
    ST.count_stream(read_library_stream(spark, path, spark.read.parquet(path).schema), out, ck)
    t = ST.running_totals(spark.read.parquet(out))
    return t.select(*[n(c).alias(c) for c in t.columns])


@query("str03_stream_funnel", sql_with(["library"], {}, f"SELECT doc_id, source FROM library WHERE {' AND '.join(SQL_BASIC.values())}"))
def stream_funnel(spark, d):
    path, out, ck = staged_files(spark, d), scratch_path(spark, "kept"), scratch_path(spark, "ck")
    source = read_library_stream(spark, path, spark.read.parquet(path).schema)
    ST.score_stream(source, lambda s: SC.survivors(X.with_descriptors(s, DESCRIPTOR_NAMES), basic()).select("doc_id", "source"), out, ck)
    return spark.read.parquet(out)
