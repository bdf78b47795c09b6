"""Queries over measurements and events: sources, parsing, filters, joins, basic summaries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from hitsieve.functions import scalar as S
from hitsieve.operators import clean as C, joins as J, metrics as M
from hitsieve.operators.ordering import ranked
from hitsieve.plans.q_metrics import BY, on_predictions
from hitsieve.plans.registry import n, query, r, rounded, sql_r, sql_rs
from hitsieve.plans.views import (documents, entities, library, measurements, predictions, sql_hash, sql_with, table,
                                  vectors)
from hitsieve.session import scratch_path
from hitsieve.sources import sinks, tables as SRC

LINEITEM = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType())])


# ---- sources and sinks -----------------------------------------------------------------------------------------

@query("src01_read_table", f"""SELECT l_returnflag, count(*) AS n, {sql_r('sum(l_quantity)')} AS quantity
FROM lineitem GROUP BY l_returnflag""")
def read_table(spark, d):
    li = SRC.read_table(spark, f"{d}/lineitem.parquet", LINEITEM)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("l_quantity")).alias("quantity"))


@query("src02_library_scan", """SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents
GROUP BY source""")
def library_scan(spark, d):
    docs = SRC.read_library(spark, f"{d}/documents.parquet", ["source", "text"], spread_rows=False)
    return docs.groupBy("source").agg(F.count("*").alias("n"), n(F.sum(F.length("text"))).alias("chars"))


@query("src03_pruned_scan", "SELECT label, count(*) AS n, max(vec_id) AS last_id FROM embeddings GROUP BY label")
def pruned_scan(spark, d):
    rows = SRC.read_library(spark, f"{d}/embeddings.parquet", ["vec_id", "label"], spread_rows=False)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("last_id"))


@query("src04_detected_features", sql_with(["vectors"], {}, """SELECT bit::BIGINT AS bit, count(*) AS n,
sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, unnest(bits) AS bit FROM vectors) GROUP BY bit"""))
def detected(spark, d):
    v = vectors(spark, d)
    wide = v.select("vec_id", *[(F.get("x", F.lit(i)) > 0).cast("int").alias(f"morgan_{i}") for i in range(64)])
    found = SRC.detect_features(wide.columns, n_bits=64)
    bits = SRC.gather_bits(wide, found)
    return (bits.select("vec_id", F.explode("bits").alias("bit")).groupBy(n("bit").alias("bit"))
            .agg(F.count("*").alias("n"), n(F.sum("vec_id")).alias("ids")))


RUN_SQL = f"SELECT seed, model, count(*) AS n, {sql_r('sum(y_prob)')} AS total FROM predictions GROUP BY ALL"


@query("src06_seed_partitions", on_predictions(RUN_SQL))
def seed_partitions(spark, d):
    path = scratch_path(spark, "runs")
    sinks.write_parquet(predictions(spark, d), path, ("seed",))
    return (SRC.read_runs(spark, path).groupBy("seed", "model")
            .agg(F.count("*").alias("n"), r(F.sum("y_prob")).alias("total")))


@query("snk01_parquet_zstd", "SELECT doc_id, source, text FROM documents WHERE length(text) < 1500")
def parquet_sink(spark, d):
    path = scratch_path(spark, "filtered")
    docs = SRC.read_library(spark, f"{d}/documents.parquet", ["doc_id", "source", "text"], spread_rows=False)
    sinks.write_parquet(docs.where(F.length("text") < 1500), path)
    return spark.read.parquet(path)


@query("snk02_csv_result", on_predictions(
    "SELECT model, seed, count(*) AS n, sum(y_true)::BIGINT AS positives FROM predictions GROUP BY ALL"))
def csv_sink(spark, d):
    path = scratch_path(spark, "result") + ".csv"
    table_ = predictions(spark, d).groupBy(*BY).agg(F.count("*").alias("n"), n(F.sum("y_true")).alias("positives"))
    sinks.write_csv(table_, path)
    return SRC.read_table(spark, path, "model string, seed int, n bigint, positives bigint")


ROLE_SQL = f"CASE WHEN {sql_hash('doc_id')} % 5 = 0 THEN 'external' ELSE 'dev' END"


def roles(df, id_col="doc_id", seed=0):
    return df.select(F.lit(seed).alias("seed"), id_col,
                     F.when(S.hash32(F.col(id_col)) % 5 == 0, "external").otherwise("dev").alias("role"))


@query("snk03_split_bundle", sql_with(["library"], {}, f"""SELECT 0 AS seed, role, count(*) AS n,
{sql_r('sum(n_tokens)')} AS tokens FROM (SELECT *, {ROLE_SQL} AS role FROM library) GROUP BY role"""))
def split_bundle(spark, d):
    path = scratch_path(spark, "split")
    lib = library(spark, d, ["n_tokens", "n_chars"]).drop("text")
    sinks.write_split(lib, roles(lib), path, "doc_id")
    back = SRC.read_runs(spark, path)
    return back.groupBy("seed", "role").agg(F.count("*").alias("n"), r(F.sum("n_tokens")).alias("tokens"))


@query("snk05_replaced_rows", on_predictions(
    f"""SELECT id, model, seed, {sql_r('y_prob')} AS y_prob, {sql_r("CASE WHEN model = 'LIN_A' THEN abs(y_prob - y_true) END")}
    AS error FROM predictions"""))
def replaced_rows(spark, d):
    p = predictions(spark, d)
    computed = p.where("model = 'LIN_A'").select("id", "model", "seed",
                                                 F.abs(F.col("y_prob") - F.col("y_true")).alias("error"))
    out = J.with_new_columns(p, computed, ["id", "model", "seed"])
    return rounded(out, ["id", "model", "seed"], ["y_prob", "error"])


@query("snk06_feature_export", sql_with(["library"], {}, f"""SELECT doc_id, source, text, {sql_rs(['n_chars', 'n_tokens',
'unique_ratio', 'digit_ratio'])} FROM library"""))
def feature_export(spark, d):
    path = scratch_path(spark, "features")
    sinks.write_parquet(library(spark, d, ["n_chars", "n_tokens", "unique_ratio", "digit_ratio"]), path)
    return rounded(spark.read.parquet(path), ["doc_id", "source", "text"],
                   ["n_chars", "n_tokens", "unique_ratio", "digit_ratio"])


# ---- projections and filters -----------------------------------------------------------------------------------

@query("prj01_column_names", f"""SELECT l_returnflag AS standard_type, l_linestatus AS standard_units,
{sql_r('avg(l_extendedprice)', 4)} AS standard_value, count(*) AS molecule_id FROM lineitem GROUP BY ALL""")
def column_names(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("Standard Type"), F.col("l_linestatus").alias("Standard Units"),
        F.col("l_extendedprice").alias("Standard Value"), F.col("l_partkey").alias("Compound ID"))
    named = S.snake_names(li, {"compound_id": "molecule_id"})
    return named.groupBy("standard_type", "standard_units").agg(
        r(F.avg("standard_value"), 4).alias("standard_value"), F.count("molecule_id").alias("molecule_id"))


@query("flt01_category_filter", f"""SELECT entity_id, count(*) AS n, {sql_r('sum(value)', 3)} AS total FROM
(SELECT l_partkey AS entity_id, l_extendedprice AS value FROM lineitem
WHERE upper(l_returnflag) = 'R' AND lower(l_linestatus) = 'f' AND l_linenumber = 1) GROUP BY entity_id""")
def category_filter(spark, d):
    m = measurements(spark, d).withColumn("relation", F.when(F.col("line") == 1, "'='").otherwise("'>'"))
    kept = C.category_filter(m, "r", "F", "'='")
    return kept.groupBy("entity_id").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


RAW_K = "regexp_extract(props, '([0-9]+)', 1)"
RAW_CASE = f"CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL ELSE {RAW_K} END"


def raw_events(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, d, "events").withColumn(
        "raw", F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, None).otherwise(k))


@query("flt02_numeric_coercion", f"""SELECT event_type, count(*) AS n, {sql_r('sum(TRY_CAST(raw AS DOUBLE))')} AS total
FROM (SELECT *, {RAW_CASE} AS raw FROM events) WHERE TRY_CAST(raw AS DOUBLE) IS NOT NULL GROUP BY event_type""")
def numeric_coercion(spark, d):
    kept = C.coerce_numeric(raw_events(spark, d), "raw")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("raw")).alias("total"))


NM = "l_extendedprice * l_discount"
P_SQL = (f"(SELECT *, CASE WHEN v = 0 THEN 'Infinity'::DOUBLE WHEN v > 0 THEN -log10(v * 1e-9::DOUBLE) END AS p "
         f"FROM (SELECT *, {NM} AS v FROM lineitem))")


def nanomolar(spark, d):
    return table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice") * F.col("l_discount"))


@query("prj02_negative_log", f"""SELECT l_returnflag, count(*) AS n, count(*) FILTER (p = 'Infinity'::DOUBLE) AS unbounded,
{sql_r("sum(p) FILTER (p < 'Infinity'::DOUBLE)", 4)} AS total FROM {P_SQL} WHERE p >= 6 GROUP BY l_returnflag""")
def negative_log(spark, d):
    p = C.potency(nanomolar(spark, d), "v", floor=6.0)
    inf = F.col("p") == float("inf")
    return p.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(inf).alias("unbounded"),
                                         r(F.sum(F.when(~inf, F.col("p"))), 4).alias("total"))


@query("prj03_activity_label", f"""SELECT l_returnflag, (CASE WHEN p >= 6 THEN 1 ELSE 0 END)::INT AS label, count(*) AS n
FROM {P_SQL} GROUP BY ALL""")
def activity(spark, d):
    p = nanomolar(spark, d).withColumn("label", S.activity_label(S.neg_log_molar(F.col("v"))))
    return p.groupBy("l_returnflag", "label").agg(F.count("*").alias("n"))


WORDS = {"view": "Active", "click": " true ", "signup": "0", "error": "inactive", "purchase": "1"}


@query("prj04_label_words", """SELECT event_type, (CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1
WHEN 'purchase' THEN 1 ELSE 0 END)::INT AS label, count(*) AS n FROM events GROUP BY ALL""")
def label_words(spark, d):
    raw = F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.col("event_type"))
    ev = S.parse_labels(table(spark, d, "events").select("event_type", raw.alias("raw")), "raw")
    return ev.groupBy("event_type", "label").agg(F.count("*").alias("n"))


@query("prj04_label_numbers", f"""SELECT (TRY_CAST({RAW_K} AS INT) % 3)::INT AS label, count(*) AS n FROM events
GROUP BY ALL""")
def label_numbers(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 3
    ev = S.parse_labels(table(spark, d, "events").select(k.cast("string").alias("raw")), "raw")
    return ev.groupBy("label").agg(F.count("*").alias("n"))


@query("prj17_lenient_label", f"""SELECT event_type, sum(coalesce(TRY_CAST({RAW_CASE} AS INT), 0))::BIGINT AS total,
count(*) AS n FROM events GROUP BY ALL""")
def lenient(spark, d):
    ev = raw_events(spark, d).withColumn("label", S.lenient_label(F.col("raw")))
    return ev.groupBy("event_type").agg(n(F.sum("label")).alias("total"), F.count("*").alias("n"))


@query("prj05_default_id", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id,
length(coalesce(text, ''))::BIGINT AS chars FROM documents""")
def default_id(spark, d):
    docs = documents(spark, d, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return ranked(docs, [], "doc_id", "id").select("doc_id", n("id").alias("id"), n(F.length("text")).alias("chars"))


LL = "-(y_true * ln(q) + (1 - y_true) * ln(1 - q))"
RES = f"""SELECT *, {LL} AS ll, (CASE WHEN y_true - y_prob >= 0 THEN 1 ELSE -1 END) * sqrt(2 * ({LL})) AS dev
FROM (SELECT *, least(greatest(y_prob, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS q FROM predictions)"""
ZS = """SELECT *, (dev - avg(dev) OVER (PARTITION BY model, seed)) / coalesce(nullif(stddev_samp(dev)
OVER (PARTITION BY model, seed), 0), 1) AS z FROM res"""
KEYS = ["id", "model", "seed"]


def residuals(spark, d):
    y, p = F.col("y_true"), F.col("y_prob")
    return predictions(spark, d).withColumns({"ll": S.log_loss(y, p), "dev": S.deviance_residual(y, p)})


@query("prj08_log_loss", on_predictions(f"SELECT id, model, seed, {sql_rs(['ll'])} FROM res", extra={"res": RES}))
def log_loss(spark, d):
    return rounded(residuals(spark, d), KEYS, ["ll"])


@query("prj09_deviance_residual", on_predictions(f"SELECT id, model, seed, {sql_rs(['dev'])} FROM res",
                                                 extra={"res": RES}))
def deviance(spark, d):
    return rounded(residuals(spark, d), KEYS, ["dev"])


@query("prj10_zscore", on_predictions(f"SELECT id, model, seed, {sql_rs(['z'])} FROM zs", extra={"res": RES, "zs": ZS}))
def zscore(spark, d):
    return rounded(S.zscore(residuals(spark, d), "dev", "z", BY), KEYS, ["z"])


@query("prj11_error_and_outlier", on_predictions(
    f"""SELECT id, model, seed, {sql_r('y_prob - y_true')} AS prob_error, {sql_r('abs(y_prob - y_true)')} AS abs_error,
    abs(z) > 3 AS outlier FROM zs""", extra={"res": RES, "zs": ZS}))
def errors(spark, d):
    rows = S.zscore(residuals(spark, d), "dev", "z", BY)
    e = F.col("y_prob") - F.col("y_true")
    return rows.select(*KEYS, r(e).alias("prob_error"), r(F.abs(e)).alias("abs_error"),
                       (F.abs("z") > 3).alias("outlier"))


@query("prj12_display_names", """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown FROM part""")
def display_names(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.display_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("shown"))


@query("prj15_match_token", "SELECT p_partkey, lower(replace(regexp_replace(p_brand || '-' || p_type, '[^A-Za-z0-9_-]', '',"
       " 'g'), '-', '_')) AS token FROM part")
def token(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.match_token(F.concat_ws("-", "p_brand", "p_type")).alias("token"))


# ---- joins -----------------------------------------------------------------------------------------------------

@query("jn01_measurements_entities", f"""SELECT grp, type, count(*) AS n, {sql_r('sum(m.value)', 2)} AS total FROM
(SELECT l_partkey, l_returnflag AS type, l_extendedprice AS value FROM lineitem) m
JOIN (SELECT p_partkey, p_brand AS grp FROM part) e ON l_partkey = p_partkey GROUP BY ALL""")
def merged(spark, d):
    m = J.merge_measurements(measurements(spark, d), entities(spark, d), "entity_id")
    return m.groupBy("grp", "type").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query("jn02_aligned_predictions", on_predictions(
    f"""SELECT id, source, y_true, {sql_r('y_prob')} AS y_prob FROM predictions WHERE model = 'LIN_A' AND seed = 0"""))
def aligned(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    population = docs.join(labels, "id", "left_semi")
    preds = predictions(spark, d).where("model = 'LIN_A' AND seed = 0").select("id", "source", "y_true", "y_prob")
    return rounded(J.align_predictions(population, preds, "id", "source"), ["id", "source", "y_true"], ["y_prob"])


@query("jn03_computed_columns", sql_with(["library"], {}, f"SELECT doc_id, {sql_rs(['n_lines', 'line_length', 'mean_token'])}"
                                         " FROM library"))
def computed_columns(spark, d):
    lib = library(spark, d, ["n_lines", "line_length", "mean_token"])
    return rounded(lib, ["doc_id"], ["n_lines", "line_length", "mean_token"])


@query("jn07_threshold_lookup", on_predictions(
    f"""SELECT CASE WHEN seed = 1 THEN lower(replace(model, '_', '-')) ELSE model END AS model, seed,
    model AS matched_model, {sql_rs(['selected_threshold', 'max_mcc_threshold'])} FROM sel""", "sel"))
def threshold_lookup(spark, d):
    p = predictions(spark, d)
    wanted = p.select(F.when(F.col("seed") == 1, F.lower(F.replace("model", F.lit("_"), F.lit("-"))))
                      .otherwise(F.col("model")).alias("model"), "seed").distinct()
    found = J.lookup_thresholds(wanted, M.best_thresholds(p, BY))
    return rounded(found, ["model", "seed", "matched_model"], ["selected_threshold", "max_mcc_threshold"])


@query("jn09_role_semi_join", f"""SELECT source, count(*) AS n FROM documents d WHERE EXISTS
(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND {ROLE_SQL.replace('doc_id', 'l.doc_id')} = 'external') GROUP BY source""")
def role_semi(spark, d):
    split = roles(table(spark, d, "labels"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    return J.select_role(docs, split, "external", "doc_id").groupBy("source").agg(F.count("*").alias("n"))


# ---- aggregates ------------------------------------------------------------------------------------------------

CLEANED = f"""SELECT l_partkey AS entity_id, arg_min(l_orderkey, struct_pack(a := l_orderkey, b := l_linenumber)) AS first_id,
quantile_cont(v, 0.5) AS value_median, quantile_cont(p, 0.5) AS p_median FROM {P_SQL}
WHERE v > 0 AND p >= 3 GROUP BY l_partkey"""


def positive_values(spark, d):
    return nanomolar(spark, d).where("v > 0").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"), F.col("v").alias("value"))


@query("agg01_replicate_collapse", f"SELECT entity_id, first_id, {sql_rs(['value_median', 'p_median'])} FROM ({CLEANED})")
def collapse(spark, d):
    rows = C.potency(positive_values(spark, d))
    out = C.collapse_replicates(rows, "entity_id", "order_id", ["order_id", "line"])
    return rounded(out, ["entity_id", "first_id"], ["value_median", "p_median"])


@query("agg01_cleaned_dataset", f"""SELECT entity_id, first_id, p_brand AS grp, p_name AS name,
{sql_rs(['value_median', 'p_median'])}, (CASE WHEN p_median >= 6 THEN 1 ELSE 0 END)::INT AS label FROM
({CLEANED.replace('WHERE v > 0', "WHERE v > 0 AND l_returnflag = 'R' AND l_linestatus = 'F'")})
JOIN part ON p_partkey = entity_id""")
def cleaned(spark, d):
    m = nanomolar(spark, d).where("v > 0").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("unit"), F.lit("'='").alias("relation"), F.col("v").alias("value"))
    out = C.clean_measurements(m, entities(spark, d).drop("value"), "entity_id", "order_id", ["order_id", "line"],
                               "r", "f", "'='")
    return rounded(out, ["entity_id", "first_id", "grp", "name", "label"], ["value_median", "p_median"])


@query("agg02_class_balance", f"""SELECT quality, count(*) AS n, {sql_r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percent
FROM labels GROUP BY quality""")
def balance(spark, d):
    return rounded(C.class_balance(table(spark, d, "labels"), "quality"), ["quality"], ["percent"], ["n"])


def hist_sql(table_: str, col: str, bins: int) -> str:
    return f"""SELECT bin, n, {sql_r('lo + bin * w', 4)} AS "left", {sql_r('n / (sum(n) OVER () * w)', 9)} AS density FROM
    (SELECT least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1})::INT AS bin, count(*) AS n, any_value(lo) AS lo,
    any_value((hi - lo) / {bins}) AS w FROM {table_}, (SELECT min({col}) AS lo, max({col}) AS hi FROM {table_}) GROUP BY 1)"""


@query("agg03_histogram_density", hist_sql("lineitem", "l_extendedprice", 25))
def density(spark, d):
    h = C.histogram(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice", 25)
    return h.select("bin", n("n").alias("n"), r("left", 4).alias("left"), r("density", 9).alias("density"))


@query("agg03_histogram_count", f"SELECT bin, n FROM ({hist_sql('events', 'value', 24)})")
def hist_count(spark, d):
    return C.histogram(table(spark, d, "events").select("value"), "value", 24).select("bin", n("n").alias("n"))


@query("agg04_cluster_rate", f"SELECT label, {sql_r('avg(y)')} AS rate, count(*) AS n FROM "
       "(SELECT label, (vec_id % 2)::INT AS y FROM embeddings) GROUP BY label")
def cluster_rate(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("y"))
    return rounded(C.cluster_rates(e, "label", "y"), ["label"], ["rate"], ["n"])


KEYED = """SELECT source AS cluster, nullif(CASE WHEN len(tok) = 0 THEN '' ELSE list_min(list_transform(tok,
lambda t: md5(regexp_replace(lower(t), '[0-9]+', '#', 'g')))) END, '') AS grp, (doc_id % 2)::INT AS y FROM tok"""


def keyed_docs(spark, d):
    from hitsieve.functions.text import with_template_key
    docs = with_template_key(documents(spark, d), n=1)
    return docs.select(F.col("source").alias("cluster"), F.nullif(F.col("key"), F.lit("")).alias("grp"), (F.col("doc_id") % 2).alias("y"))


@query("agg05_subgroup_rates", sql_with(["tok"], {"k": KEYED}, f"""SELECT cluster, grp, count(*) AS n,
{sql_r('avg(y)')} AS active_ratio FROM k WHERE grp IS NOT NULL GROUP BY ALL"""))
def subgroups(spark, d):
    return rounded(C.subgroup_rates(keyed_docs(spark, d), "cluster", "grp", "y"), ["cluster", "grp"],
                   ["active_ratio"], ["n"])


@query("win01_top_subgroups", sql_with(["tok"], {"k": KEYED}, """SELECT cluster, grp, n, place FROM (SELECT cluster, grp,
count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, grp) AS place FROM k WHERE grp IS NOT NULL
GROUP BY cluster, grp) WHERE place <= 3"""))
def top3(spark, d):
    top = C.top_subgroups(C.subgroup_rates(keyed_docs(spark, d), "cluster", "grp", "y"), "cluster", "grp")
    return top.select("cluster", "grp", n("n").alias("n"), n("place").alias("place"))


@query("agg26_safe_correlation", f"""SELECT event_type, {sql_r(f'corr(value, ({RAW_K})::DOUBLE)')} AS r_value,
0.0::DOUBLE AS r_constant FROM events GROUP BY event_type""")
def correlation(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    ev = table(spark, d, "events").select("event_type", "value", k.alias("k"), F.lit(3.0).alias("c"))
    return ev.groupBy("event_type").agg(r(C.safe_corr("value", "k")).alias("r_value"),
                                        r(C.safe_corr("value", "c")).alias("r_constant"))


@query("agg27_trend_line", f"""SELECT event_type, {sql_r(f'regr_slope(value, ({RAW_K})::DOUBLE)')} AS slope,
{sql_r(f'regr_intercept(value, ({RAW_K})::DOUBLE)')} AS intercept FROM events GROUP BY event_type""")
def trend(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    ev = table(spark, d, "events").select("event_type", "value", k.alias("k"))
    return rounded(C.trend_line(ev, "k", "value", ["event_type"]), ["event_type"], ["slope", "intercept"])


XY = """SELECT label AS cluster, vec_id, (vec_id % 2)::INT AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b
FROM embeddings"""


def plane(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("label").alias("cluster"), "vec_id", (F.col("vec_id") % 2).cast("int").alias("y"),
        F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))


@query("agg35_cluster_centroids", sql_with([], {"xy": XY}, f"""SELECT cluster, {sql_r('avg(a)')} AS a, {sql_r('avg(b)')} AS b,
{sql_r('avg(y)')} AS rate, count(*) AS n FROM xy GROUP BY cluster"""))
def centroid_table(spark, d):
    return rounded(C.centroids(plane(spark, d), "cluster", ["a", "b"], "y"), ["cluster"], ["a", "b", "rate"], ["n"])


@query("win04_cluster_representatives", sql_with([], {"xy": XY}, f"""SELECT cluster, vec_id, y, {sql_r('sqrt(dd)')} AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(dd, 12), vec_id) AS rn FROM
(SELECT *, (a - avg(a) OVER c) ** 2 + (b - avg(b) OVER c) ** 2 AS dd FROM
(SELECT *, max(y) OVER (PARTITION BY cluster) AS top FROM xy) WHERE top < 1 OR y = 1
WINDOW c AS (PARTITION BY cluster))) WHERE rn = 1"""))
def reps(spark, d):
    return rounded(C.representatives(plane(spark, d), "cluster", "y", ["a", "b"], "vec_id"),
                   ["cluster", "vec_id", "y"], ["distance"])


# ---- sets ------------------------------------------------------------------------------------------------------

@query("set01_union_of_runs", on_predictions(
    f"""SELECT id, model, seed, {sql_r('y_prob')} AS y_prob, CASE WHEN seed = 0 THEN fold END AS fold,
    CASE WHEN seed = 1 THEN source END AS source FROM predictions"""))
def union_runs(spark, d):
    p = predictions(spark, d)
    parts = [p.where("seed = 0").select("id", "model", "seed", "y_prob", "fold"),
             p.where("seed = 1").select("id", "model", "seed", "y_prob", "source")]
    return rounded(SRC.union_runs(parts), ["id", "model", "seed", "fold", "source"], ["y_prob"])


@query("set02_distinct_rows", on_predictions("SELECT DISTINCT model, seed, fold, source FROM predictions"))
def distinct_rows(spark, d):
    return predictions(spark, d).select("model", "seed", "fold", "source").dropDuplicates()
