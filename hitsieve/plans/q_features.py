"""Queries over features, splits, nearest-reference joins and the domain table."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hitsieve.functions import scalar as S, text as X
from hitsieve.operators import domain as D, features as FE, nearest as NN, splits as SP
from hitsieve.operators.ordering import exact_quantiles
from hitsieve.operators.similar import similar_enough
from hitsieve.plans.q_basic import RAW_CASE, raw_events
from hitsieve.plans.registry import n, query, r, rounded, sql_r, sql_rs
from hitsieve.plans.views import (DESCRIPTOR_NAMES, documents, library, sql_hash, sql_with, table, vectors)
from hitsieve.schemas import FP_BITS, DomainConfig, MissingPolicy
from hitsieve.session import cut_lineage

VECTOR = 64

# ---- features --------------------------------------------------------------------------------------------------

BITS_SQL = f"""SELECT doc_id, list_distinct(list_transform(list_concat(low,
  list_transform(range(0, greatest(len(low) - 1, 0)), lambda i: low[i + 1] || ' ' || low[i + 2]),
  list_transform(range(0, greatest(len(low) - 2, 0)), lambda i: low[i + 1] || ' ' || low[i + 2] || ' ' || low[i + 3])),
  lambda s: {sql_hash('s')} % 2048)) AS bits FROM (SELECT doc_id, list_transform(tok, lambda t: lower(t)) AS low FROM tok)"""


def fingerprints(spark, d):
    return X.with_fingerprint(documents(spark, d, "doc_id", "text")).select("doc_id", "bits")


@query("fe01_fingerprint", sql_with(["tok"], {"f": BITS_SQL}, """SELECT doc_id, len(bits)::BIGINT AS n_bits,
coalesce(list_sum(bits), 0)::BIGINT AS bit_sum, list_min(bits)::BIGINT AS low, list_max(bits)::BIGINT AS high FROM f"""))
def fingerprint(spark, d):
    f = fingerprints(spark, d)
    total = F.aggregate("bits", F.lit(0).cast("bigint"), lambda s, b: s + b)
    return f.select("doc_id", n(F.size("bits")).alias("n_bits"), total.alias("bit_sum"),
                    n(F.array_min("bits")).alias("low"), n(F.array_max("bits")).alias("high"))


@query("fe02_descriptors", sql_with(["library"], {}, f"SELECT doc_id, {sql_rs(DESCRIPTOR_NAMES)} FROM library"))
def descriptors(spark, d):
    return rounded(library(spark, d), ["doc_id"], DESCRIPTOR_NAMES)


@query("fe02_user_descriptor", sql_with(["tok"], {}, f"""SELECT doc_id, len(list_filter(tok, lambda t: length(t) >= 12))::DOUBLE AS long_tokens,
{sql_r("len(list_filter(tok, lambda t: length(t) >= 12))::DOUBLE / nullif(len(tok), 0)")} AS long_ratio FROM tok"""))
def user_descriptor(spark, d):
    """Descriptors that a user adds to the registry and asks for by name, over the token column all descriptors share."""
    long = F.size(F.filter("_tok", lambda t: F.length(t) >= 12))
    X.register_descriptor("long_tokens", lambda: long.cast("double"))
    X.register_descriptor("long_ratio", lambda: F.try_divide(long.cast("double"), F.size("_tok").cast("double")))
    found = X.with_descriptors(documents(spark, d, "doc_id", "text"), ["long_tokens", "long_ratio"])
    return found.select("doc_id", "long_tokens", r("long_ratio").alias("long_ratio"))


@query("fe03_missing_values", f"""SELECT event_id, {sql_r('coalesce(x, -1)')} AS x, {sql_r('value')} AS value,
{sql_r('(x IS NULL)::INT')} AS x__isna, 0.0::DOUBLE AS value__isna FROM
(SELECT *, TRY_CAST({RAW_CASE} AS DOUBLE) AS x FROM events)""")
def missing(spark, d):
    ev = raw_events(spark, d).select("event_id", F.col("raw").try_cast("double").alias("x"), "value")
    out, names = FE.fill_missing(ev, ["x", "value"], MissingPolicy("nan_indicator", -1.0))
    return rounded(out, ["event_id"], names)


def key_sql(n: int = 3) -> str:
    """SQL twin of the structural key over a token list `tok`."""
    return f"""CASE WHEN len(tok) = 0 THEN '' ELSE list_min(list_transform(range(1, greatest(len(tok) - {n} + 1, 1) + 1),
lambda i: md5(array_to_string(list_transform(tok[i:i + {n} - 1], lambda t: regexp_replace(lower(t), '[0-9]+', '#', 'g')), ' ')))) END"""


@query("fe04_group_key", sql_with(["tok"], {}, f"SELECT doc_id, {key_sql()} AS key FROM tok"))
def group_key(spark, d):
    return X.with_template_key(documents(spark, d, "doc_id", "text")).select("doc_id", "key")


@query("fe05_scaled_vectors", f"""SELECT vec_id, pos::BIGINT AS pos, {sql_r('(v - avg(v) OVER p) / coalesce(nullif(stddev_pop(v) OVER p, 0), 1)')}
AS z FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
WINDOW p AS (PARTITION BY pos)""")
def scaled(spark, d):
    v = vectors(spark, d)
    z = FE.scale_arrays(v, v, "x", "z")
    return z.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", n("pos").alias("pos"), r("z").alias("z"))


@query("fe05_scaled_descriptors", sql_with(["library"], {}, "SELECT doc_id, " + ", ".join(
    f"{sql_r(f'({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)')} AS {c}"
    for c in ("n_chars", "n_tokens", "n_lines")) + " FROM library"))
def scaled_columns(spark, d):
    lib = library(spark, d, ["n_chars", "n_tokens", "n_lines"])
    return rounded(FE.scale_columns(lib, lib, ["n_chars", "n_tokens", "n_lines"]), ["doc_id"],
                   ["n_chars", "n_tokens", "n_lines"])


VAR_SQL = """SELECT b.bit, coalesce(c, 0)::DOUBLE / n AS p, p * (1 - p) AS variance FROM (SELECT unnest(range(0, {bits})) AS bit) b
LEFT JOIN (SELECT bit, count(*) AS c FROM (SELECT unnest(bits) AS bit FROM {src}) GROUP BY bit) u ON u.bit = b.bit,
(SELECT count(*) AS n FROM {src})"""


@query("fe06_bit_variance", sql_with(["tok"], {"f": BITS_SQL, "v": VAR_SQL.format(bits=2048, src="f")},
       f"SELECT bit::BIGINT AS bit, {sql_r('variance', 9)} AS variance, variance >= 0.05 AS kept FROM v"))
def bit_variance(spark, d):
    t = FE.bit_variances(fingerprints(spark, d), "bits", 2048)
    return t.select(n("bit").alias("bit"), r("variance", 9).alias("variance"), "kept")


PAIR_LIMIT = 0.08


@query("fe07_correlated_bits", sql_with(["vectors"], {
    "b": "SELECT vec_id, unnest(bits) AS bit FROM vectors",
    "c": "SELECT bit, count(*)::DOUBLE AS c FROM b GROUP BY bit",
    "o": "SELECT x.bit AS i, y.bit AS j, count(*)::DOUBLE AS o FROM b x JOIN b y ON x.vec_id = y.vec_id AND x.bit < y.bit "
         "GROUP BY ALL",
    "s": "SELECT i, j, abs((n * o - ci.c * cj.c) / sqrt(ci.c * (n - ci.c) * cj.c * (n - cj.c))) AS r FROM o "
         "JOIN c ci ON ci.bit = i JOIN c cj ON cj.bit = j, (SELECT count(*)::DOUBLE AS n FROM vectors)"},
    f"SELECT i::BIGINT AS i, j::BIGINT AS j, {sql_r('r')} AS r FROM s WHERE r > {PAIR_LIMIT}"))
def correlated(spark, d):
    pairs = FE.correlated_pairs(vectors(spark, d), "bits", range(VECTOR), PAIR_LIMIT)
    return spark.createDataFrame([(int(i), int(j), round(x, 6)) for i, j, x in pairs], "i bigint, j bigint, r double")


@query("fe07_pruned_mask")
def pruned(spark, d):
    v = vectors(spark, d)
    kept = FE.fit_mask(v, "bits", VECTOR, 0.05, PAIR_LIMIT)
    return (FE.bit_variances(v, "bits", VECTOR).where(F.col("bit").isin([int(b) for b in kept]))
            .select("bit", r("variance", 9).alias("variance")))


@query("fe08_assembled_features", sql_with(["vectors"], {}, f"""SELECT vec_id, {sql_r('len(bits) + 3 * (embedding_1 - m) / s')} AS total
FROM (SELECT vec_id, bits, x[1] AS embedding_1, avg(x[1]) OVER () AS m, stddev_pop(x[1]) OVER () AS s FROM vectors)"""))
def assembled(spark, d):
    v = vectors(spark, d).withColumn("a", F.get("x", F.lit(0)))
    out, contract = FE.assemble(v, v, "bits", list(range(VECTOR)), ["a"])
    weights = F.transform(vector_to_array("features_scaled"), lambda x, i: F.when(i == VECTOR, x * 3).otherwise(x))
    return out.select("vec_id", r(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("fe10_largest_fragment", sql_with([], {"p": """SELECT doc_id, list_transform(string_split(text, '.'),
lambda x: lower(trim(regexp_replace(x, '[ \\t\\n\\r]+', ' ', 'g')))) AS parts FROM documents"""},
       """SELECT doc_id, list_filter(parts, lambda x: length(x) = list_max(list_transform(parts, lambda y: length(y))))[1]
AS fragment FROM p WHERE list_max(list_transform(parts, lambda y: length(y))) > 0"""))
def fragments(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return docs.select("doc_id", X.largest_fragment(F.col("text")).alias("fragment")).where(F.col("fragment").isNotNull())


def scaled_vectors(spark, d):
    v = vectors(spark, d)
    return FE.scale_arrays(v, v.where("role = 'train'"), "x", "z")


@query("fe11_principal_components")
def components(spark, d):
    v = scaled_vectors(spark, d)
    loadings, share = FE.fit_pca(v.where("role = 'train'").select(array_to_vector("z").alias("v")), "v", 50)
    out = FE.project(v, "z", loadings)
    return out.select("vec_id", *[r(F.get("pc", F.lit(j))).alias(f"pc_{j + 1}") for j in range(3)])


@query("win03_cumulative_variance")
def cumulative_variance(spark, d):
    from pyspark.sql import Window as W
    v = scaled_vectors(spark, d)
    _, share = FE.fit_pca(v.select(array_to_vector("z").alias("v")), "v", 50)
    t = spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(share)], "pc int, share double")
    run = W.partitionBy(F.lit(0)).orderBy("pc").rowsBetween(W.unboundedPreceding, W.currentRow)
    return t.select("pc", r("share").alias("share"), r(F.sum("share").over(run)).alias("cumulative"))


# ---- splits ----------------------------------------------------------------------------------------------------

@query("spl01_group_holdout", sql_with(["tok"], {}, f"""SELECT key, count(*) AS n, sum((doc_id % 3 = 0)::INT)::BIGINT AS positives,
1::BIGINT AS parts, true AS in_bounds FROM (SELECT doc_id, {key_sql()} AS key FROM tok) GROUP BY key"""))
def group_holdout(spark, d):
    keyed = X.with_template_key(documents(spark, d, "doc_id", "text"))
    docs = cut_lineage(keyed.select("doc_id", "key", (F.col("doc_id") % 3 == 0).cast("int").alias("y")))  # texts are read once
    out = cut_lineage(SP.group_holdout(docs, "key", "y", 0.2, 42).select("key", "y", "role"))
    share = out.agg(F.avg((F.col("role") == "external").cast("int")).alias("s")).scalar()
    return (out.groupBy("key").agg(n(F.count("*")).alias("n"), n(F.sum("y")).alias("positives"), n(F.countDistinct("role")).alias("parts"))
            .withColumn("in_bounds", share.between(0.18, 0.2 * SP.OVERFILL)))


def seed_hash(seed: int, expr: str) -> str:
    return sql_hash(f"'{seed}:' || {expr}::VARCHAR")


@query("spl02_stratified_holdout", f"""SELECT doc_id, quality, CASE WHEN rn <= round(c * 0.2::DOUBLE) THEN 'external' ELSE 'dev' END
AS role FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {seed_hash(7, 'doc_id')}, doc_id) AS rn,
count(*) OVER (PARTITION BY quality) AS c FROM labels)""")
def stratified(spark, d):
    return SP.stratified_holdout(table(spark, d, "labels"), "doc_id", "quality", 0.2, 7)


def keyed_labels(spark, d):
    docs = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    return X.with_template_key(docs).select("doc_id", "key", "source", F.col("quality").alias("y"))


KEYED_LABELS = f"SELECT t.doc_id, {key_sql()} AS key, quality AS y FROM tok t JOIN labels USING (doc_id)"


@query("spl03_grouped_folds", sql_with(["tok"], {"k": KEYED_LABELS}, """SELECT key, count(*) AS n, sum(y)::BIGINT AS positives, 1::BIGINT AS parts,
true AS in_bounds FROM k GROUP BY key"""))
def grouped_folds(spark, d):
    out = SP.grouped_folds(keyed_labels(spark, d), "key", "y", 5, 42)
    sizes = out.groupBy("fold").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))
    fair = sizes.agg(((F.count("*") == 5) & (F.max("n") <= 1.2 * F.avg("n")) & (F.max("low") == 0) & (F.min("high") == 1)).alias("f")).scalar()
    return (out.groupBy("key").agg(n(F.count("*")).alias("n"), n(F.sum("y")).alias("positives"), n(F.countDistinct("fold")).alias("parts"))
            .withColumn("in_bounds", fair))


@query("spl04_tuning_folds", sql_with(["tok"], {}, f"""SELECT source, count(*) AS n, sum(quality)::BIGINT AS positives, 1::BIGINT AS parts
FROM documents JOIN (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {seed_hash(42, 'doc_id')}, doc_id) AS rn,
count(*) OVER (PARTITION BY quality) AS c FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) USING (doc_id)
WHERE rn > round(c * 0.2::DOUBLE) GROUP BY source"""))
def tuning_folds(spark, d):
    rows = SP.stratified_holdout(keyed_labels(spark, d), "doc_id", "y", 0.2, 42).where("role = 'dev'")
    dev = keyed_labels(spark, d).join(rows.select("doc_id"), "doc_id", "left_semi")
    out = SP.tuning_folds(dev, "source", "y", 3, 42)
    return out.groupBy("source").agg(n(F.count("*")).alias("n"), n(F.sum("y")).alias("positives"), n(F.countDistinct("fold")).alias("parts"))


@query("agg36_fold_balance", f"""SELECT fold, sum(quality)::BIGINT AS positives, count(*) AS n FROM
(SELECT quality, {sql_hash('doc_id')} % 5 AS fold FROM labels) GROUP BY fold""")
def fold_balance(spark, d):
    rows = table(spark, d, "labels").withColumn("fold", S.hash32(F.col("doc_id")) % 5)
    return SP.fold_balance(rows, "quality").select("fold", n("positives").alias("positives"), "n")


@query("spl05_balanced_background", f"""SELECT doc_id, quality FROM (SELECT *, row_number() OVER
(ORDER BY (rn > greatest(1, floor(64 / k)))::INT, h, doc_id) AS place FROM (SELECT *, row_number() OVER
(PARTITION BY quality ORDER BY h, doc_id) AS rn, (SELECT count(DISTINCT quality) FROM labels) AS k FROM
(SELECT doc_id, quality, {seed_hash(3, 'doc_id')} AS h FROM labels)) WHERE rn <= 64) WHERE place <= 64""")
def background(spark, d):
    return SP.balanced_sample(table(spark, d, "labels"), "doc_id", "quality", 64, 3)


@query("spl06_uniform_sample", f"SELECT vec_id, label FROM embeddings ORDER BY {seed_hash(5, 'vec_id')}, vec_id LIMIT 50")
def uniform(spark, d):
    return SP.uniform_sample(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 50, 5)


PERM_SQL = f"""SELECT a.permutation, a.doc_id, a.quality, b.quality AS permuted FROM
(SELECT permutation, doc_id, quality, row_number() OVER (PARTITION BY permutation ORDER BY doc_id) AS rn FROM labels,
(SELECT unnest(range(1, 201)) AS permutation)) a JOIN
(SELECT permutation, quality, row_number() OVER (PARTITION BY permutation ORDER BY
{sql_hash("(permutation + 9000)::VARCHAR || ':' || doc_id::VARCHAR")}, doc_id) AS rn FROM labels,
(SELECT unnest(range(1, 201)) AS permutation)) b USING (permutation, rn)"""


@query("spl07_label_permutation", f"SELECT permutation::INT AS permutation, doc_id, quality, permuted FROM ({PERM_SQL})")
def permutation(spark, d):
    return SP.permuted_labels(table(spark, d, "labels"), "doc_id", "quality", 200, 9)


@query("spl08_augmented_rows", sql_with(["tok"], {}, """SELECT doc_id, v.variant::INT AS variant, quality, len(tok)::DOUBLE AS n_tokens,
len(list_distinct(tok))::DOUBLE AS n_unique FROM tok JOIN labels USING (doc_id), (SELECT unnest(range(0, 4)) AS variant) v
WHERE v.variant = 0 OR len(tok) > 0"""))
def augmented(spark, d):
    docs = documents(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    out = SP.augment(docs, "doc_id", "text", 3, 42, 1)
    return X.with_descriptors(out, ["n_tokens", "n_unique"]).select("doc_id", "variant", "quality", "n_tokens", "n_unique")


# ---- nearest-reference joins -----------------------------------------------------------------------------------

def roles(spark, d):
    v = vectors(spark, d)
    return v.where("role = 'train'"), v.where("role = 'query'")


TANIMOTO = """SELECT q.vec_id, max(CASE WHEN len(q.bits) + len(t.bits) = 0 THEN 0 ELSE
len(list_intersect(q.bits, t.bits))::DOUBLE / (len(q.bits) + len(t.bits) - len(list_intersect(q.bits, t.bits))) END) AS tanimoto_max
FROM vectors q, vectors t WHERE q.role = 'query' AND t.role = 'train' GROUP BY q.vec_id"""
COSINE = """SELECT q.vec_id, max(list_cosine_similarity(q.x, t.x)) AS cosine_max FROM vectors q, vectors t
WHERE q.role = 'query' AND t.role = 'train' GROUP BY q.vec_id"""
KNN = """SELECT vec_id, avg(dist) AS knn_mean FROM (SELECT q.vec_id, list_distance(q.x, t.x) AS dist,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x)) AS rn FROM vectors q, vectors t
WHERE q.role = '{role}' AND t.role = 'train' AND q.vec_id <> t.vec_id) WHERE rn <= 5 GROUP BY vec_id"""


@query("jn04_max_tanimoto", sql_with(["vectors"], {"t": TANIMOTO}, f"SELECT vec_id, {sql_rs(['tanimoto_max'])} FROM t"))
def tanimoto(spark, d):
    train, q = roles(spark, d)
    return rounded(NN.max_tanimoto(q, train, "bits", "vec_id", VECTOR), ["vec_id"], ["tanimoto_max"])


@query("jn05_max_cosine", sql_with(["vectors"], {"t": COSINE}, f"SELECT vec_id, {sql_rs(['cosine_max'])} FROM t"))
def cosine(spark, d):
    train, q = roles(spark, d)
    return rounded(NN.max_cosine(q, train, "x", "vec_id", VECTOR), ["vec_id"], ["cosine_max"])


@query("jn06_knn_mean_distance", sql_with(["vectors"], {"a": KNN.format(role="train"), "b": KNN.format(role="query")},
       f"SELECT vec_id, 'train' AS role, {sql_rs(['knn_mean'])} FROM a UNION ALL "
       f"SELECT vec_id, 'query', {sql_r('knn_mean')} FROM b"))
def knn(spark, d):
    train, q = roles(spark, d)
    a = NN.knn_mean_distance(train.select("vec_id", "x"), train.select("x"), "x", "vec_id", 5, VECTOR, within=True)
    b = NN.knn_mean_distance(q.select("vec_id", "x"), train.select("x"), "x", "vec_id", 5, VECTOR)
    both = a.withColumn("role", F.lit("train")).unionByName(b.withColumn("role", F.lit("query")))
    return rounded(both, ["vec_id", "role"], ["knn_mean"])


@query("jn06_knn_blocks", sql_with(["vectors"], {"b": KNN.format(role="query")},
       f"SELECT vec_id, {sql_rs(['knn_mean'])} FROM b"))
def knn_blocks(spark, d):
    """The way for reference sets beyond the broadcast bound."""
    train, q = roles(spark, d)
    out = NN.knn_mean_distance(q.select("vec_id", "x"), train.select("x"), "x", "vec_id", 5, VECTOR, broadcast_bytes=0,
                               block_rows=256)
    return rounded(out, ["vec_id"], ["knn_mean"])


@query("jn04_max_tanimoto_blocks", sql_with(["vectors"], {"t": TANIMOTO}, f"SELECT vec_id, {sql_rs(['tanimoto_max'])} FROM t"))
def tanimoto_blocks(spark, d):
    train, q = roles(spark, d)
    out = NN.max_tanimoto(q, train, "bits", "vec_id", VECTOR, broadcast_bytes=0, block_rows=256)
    return rounded(out, ["vec_id"], ["tanimoto_max"])


@query("agg28_train_quantile", sql_with([], {}, f"SELECT label, {sql_r('quantile_cont(embedding[1]::DOUBLE, 0.99)')} AS q "
                                        "FROM embeddings GROUP BY label"))
def quantile(spark, d):
    e = table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return exact_quantiles(e, ["label"], "x", [0.99]).select("label", r("q0").alias("q"))


# ---- domain ----------------------------------------------------------------------------------------------------

@query("ad01_leverage")
def leverage(spark, d):
    v = scaled_vectors(spark, d)
    out, limit, p = D.leverage(v.where("role = 'train'"), v.where("role = 'query'"), "z")
    return out.select("vec_id", r("leverage").alias("leverage"), F.lit(round(limit, 6)).alias("limit"),
                      (F.col("leverage") <= limit).alias("base_in"))


@query("ad02_mahalanobis")
def mahalanobis(spark, d):
    v = scaled_vectors(spark, d)
    train, q = v.where("role = 'train'"), v.where("role = 'query'")
    mean, cov = D.shrunk_covariance(train, "z")
    cut = D.train_quantile(D.mahalanobis(train, "z", mean, cov), "mahalanobis", 0.99)
    out = D.mahalanobis(q, "z", mean, cov).withColumn("threshold", cut)
    return rounded(out.withColumn("inside", (F.col("mahalanobis") <= F.col("threshold")).cast("int")), ["vec_id"],
                   ["mahalanobis", "threshold"], ["inside"])


AD_PARTS = {
    "tr": KNN.format(role="train"), "qr": KNN.format(role="query"), "tm": TANIMOTO, "cm": COSINE,
    "cut": "SELECT quantile_cont(knn_mean, 0.99) AS threshold FROM tr",
    "pr": """SELECT vec_id, y AS y_true, round(1 / (1 + exp(-(4 * x[1] + 3 * x[2]))), 6) AS y_prob FROM vectors
WHERE role = 'query'""",
    "rs": """SELECT *, -(y_true * ln(y_prob) + (1 - y_true) * ln(1 - y_prob)) AS log_loss,
CASE WHEN y_true - y_prob >= 0 THEN 1 ELSE -1 END * sqrt(2 * -(y_true * ln(y_prob) + (1 - y_true) * ln(1 - y_prob))) AS deviance
FROM pr""",
    "st": "SELECT *, (deviance - avg(deviance) OVER ()) / coalesce(nullif(stddev_samp(deviance) OVER (), 0), 1) AS std_residual "
          "FROM rs",
    "fl": """SELECT *, knn_mean <= threshold AS base_in, tanimoto_max >= 0.6 AS tanimoto_in, cosine_max >= 0.7 AS cosine_in
FROM st JOIN qr USING (vec_id) JOIN tm USING (vec_id) JOIN cm USING (vec_id), cut""",
    "ad": "SELECT *, TRUE AS som_in, base_in OR (tanimoto_in AND cosine_in) AS in_domain FROM fl",
}
CONFIG = DomainConfig(strict_similarity=False)
MEASURES = ["y_prob", "knn_mean", "threshold", "tanimoto_max", "cosine_max", "log_loss", "deviance", "std_residual"]
FLAGS = ["base_in", "som_in", "tanimoto_in", "cosine_in", "in_domain"]


def scored(q):
    z = 4 * F.get("x", F.lit(0)) + 3 * F.get("x", F.lit(1))
    return q.withColumns({"y_true": F.col("y"), "y_prob": F.round(1.0 / (1.0 + F.exp(-z)), 6)})


def domain(spark, d):
    train, q = roles(spark, d)
    return D.domain_table(train, D.residual_columns(scored(q)), CONFIG, "vec_id", "x", "bits", VECTOR, VECTOR)


@query("ad03_knn_density", sql_with(["vectors"], AD_PARTS, f"SELECT vec_id, {sql_rs(['knn_mean', 'threshold'])}, base_in FROM ad"))
def density(spark, d):
    train, q = roles(spark, d)
    inside = NN.knn_mean_distance(train.select("vec_id", "x"), train.select("x"), "x", "vec_id", 5, VECTOR, within=True)
    out = (NN.knn_mean_distance(q, train.select("x"), "x", "vec_id", 5, VECTOR)
           .withColumn("threshold", D.train_quantile(inside, "knn_mean", 0.99))
           .withColumn("base_in", F.col("knn_mean") <= F.col("threshold")))
    return rounded(out, ["vec_id", "base_in"], ["knn_mean", "threshold"])


@query("ad04_map_occupancy")
def occupancy(spark, d):
    v = scaled_vectors(spark, d)
    weights = D.fit_map(v.where("role = 'train'"), "z", "vec_id", 12, 12, 20)
    return D.occupied_flag(v.where("role = 'query'"), v.where("role = 'train'"), "z", weights).select("vec_id", "som_in")


@query("ad05_similarity_flags", sql_with(["vectors"], AD_PARTS, "SELECT vec_id, tanimoto_in, cosine_in FROM ad"))
def similarity_flags(spark, d):
    train, q = roles(spark, d)
    out = NN.max_cosine(similar_enough(q, train, "bits", VECTOR, 0.6, "tanimoto_in"), train.select("x"), "x", "vec_id", VECTOR)
    return out.select("vec_id", "tanimoto_in", (F.col("cosine_max") >= 0.7).alias("cosine_in"))


@query("ad05_wide_similarity", sql_with(["tok"], {"f": BITS_SQL}, """SELECT q.doc_id, coalesce(bool_or(
len(list_intersect(q.bits, t.bits))::DOUBLE / nullif(len(q.bits) + len(t.bits) - len(list_intersect(q.bits, t.bits)), 0) >= 0.6), false) AS similar
FROM (SELECT doc_id, list_distinct(bits) AS bits FROM f WHERE doc_id % 5 = 0) q, (SELECT list_distinct(bits) AS bits FROM f WHERE doc_id % 5 <> 0) t
GROUP BY q.doc_id"""))
def wide_similarity(spark, d):
    """Fingerprints of the full width: documents near any of the reference documents."""
    f = fingerprints(spark, d).select("doc_id", "bits")
    return similar_enough(f.where("doc_id % 5 = 0"), f.where("doc_id % 5 <> 0"), "bits", FP_BITS, 0.6).select("doc_id", "similar")


@query("ad06_flag_algebra", """SELECT vec_id, (a AND b) AND (c AND e) AS strict, (a AND b) OR (c AND e) AS loose FROM
(SELECT vec_id, embedding[1] > 0 AS a, embedding[2] > 0 AS b, embedding[3] > 0 AS c, embedding[4] > 0 AS e FROM embeddings)""")
def algebra(spark, d):
    v = table(spark, d, "embeddings")
    flags = [F.get("embedding", F.lit(i)) > 0 for i in range(4)]
    return v.select("vec_id", D.combine(*flags, strict=True).alias("strict"),
                    D.combine(*flags, strict=False).alias("loose"))


@query("ad07_domain_table", sql_with(["vectors"], AD_PARTS, f"""SELECT vec_id, y_true, 'knn_density' AS base_method,
{sql_rs(MEASURES)}, abs(std_residual) > 3 AS outlier, {', '.join(FLAGS)} FROM ad"""))
def domain_rows(spark, d):
    return rounded(domain(spark, d), ["vec_id", "y_true", "base_method", "outlier", *FLAGS], MEASURES)


@query("agg29_domain_rates", sql_with(["vectors"], AD_PARTS, "SELECT " + ", ".join(
    f"{sql_r(f'avg({f}::INT)')} AS {f}" for f in FLAGS) + ", count(*) AS n FROM ad"))
def rates(spark, d):
    return rounded(D.domain_rates(domain(spark, d)), [], FLAGS, ["n"])
