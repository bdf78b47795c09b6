"""The test tables seen as measurements, library, predictions and vectors; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitsieve.functions import text as X
from hitsieve.functions.scalar import hash32
from hitsieve.schemas import Rule
from hitsieve.session import scratch_path
from hitsieve.sources.sinks import write_parquet
from hitsieve.sources.tables import read_library, read_table

DESCRIPTOR_NAMES = ["n_chars", "n_tokens", "n_unique", "unique_ratio", "mean_token", "digit_ratio", "upper_ratio",
                    "vowel_ratio", "punct_ratio", "symbol_ratio", "n_lines", "line_length"]

# Two linear scores over text descriptors, the rule sets on text, the pattern catalogue.
MODELS = {
    "LIN_A": {"bias": 0.9, "unique_ratio": 2.5, "symbol_ratio": -30.0, "digit_ratio": -12.0, "mean_token": 0.05},
    "LIN_B": {"bias": -0.4, "unique_ratio": 0.8, "punct_ratio": 9.0, "upper_ratio": 6.0, "symbol_ratio": -8.0},
}
SEEDS = (0, 1)
SEED_SHIFT = 0.15
TEXT_BASIC_RULES = (Rule("n_chars", None, 4000.0), Rule("mean_token", None, 9.0), Rule("digit_ratio", None, 0.05),
                    Rule("punct_ratio", None, 0.06), Rule("symbol_ratio", None, 0.03))
TEXT_STRICT_RULES = (Rule("n_tokens", 10.0, None), Rule("n_chars", 250.0, 3000.0), Rule("mean_token", 2.0, 8.0),
                     Rule("vowel_ratio", 0.2, 0.6), Rule("digit_ratio", None, 0.03), Rule("symbol_ratio", None, 0.02),
                     Rule("upper_ratio", None, 0.1))
CATALOGUE = ("[Ll]icen[cs]e", "[Pp]assword", "https?://", "lorem ipsum", "[0-9]{3}-[0-9]{2}-[0-9]{4}")
DESIRED = ((0.6, "unique_ratio", 0.5, 0.1, True), (0.5, "symbol_ratio", 0.02, 0.005, False),
           (0.4, "digit_ratio", 0.05, 0.01, False), (0.3, "mean_token", 9.0, 1.0, False))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_library(spark, f"{d}/documents.parquet", columns or ("doc_id", "text", "source"))


def library(spark: SparkSession, d: str, names=tuple(DESCRIPTOR_NAMES), keep_tokens: bool = False) -> DataFrame:
    return X.with_descriptors(documents(spark, d), names, keep_tokens=keep_tokens)


def linear(coef: dict[str, float]):
    z = F.lit(coef["bias"])
    for name, w in coef.items():
        if name != "bias":
            z = z + F.lit(w) * F.coalesce(F.col(name), F.lit(0.0))
    return z


def sigmoid(z):
    return 1.0 / (1.0 + F.exp(-z))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows as a stored table: metric queries read it more than once, the text only once."""
    path = scratch_path(spark, "predictions")
    write_parquet(_predictions(spark, d), path)
    return spark.read.schema("id bigint, source string, y_true int, y_prob double, model string, seed int, fold int").parquet(path)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    names = sorted({n for c in MODELS.values() for n in c if n != "bias"})
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"))
    docs = read_library(spark, f"{d}/documents.parquet", ("doc_id", "text", "source"))
    rows = X.with_descriptors(docs.join(labels, "doc_id"), names)
    runs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"),
                 F.round(sigmoid(linear(c) + F.lit(SEED_SHIFT * s) * F.coalesce("mean_token", F.lit(0.0))), 6)
                 .alias("y_prob"))
        for m, c in MODELS.items() for s in SEEDS])).alias("r")
    return (rows.select(F.col("doc_id").alias("id"), "source", "y_true", runs)
            .select("id", "source", "y_true", "r.y_prob", "r.model", "r.seed",
                    F.pmod(hash32(F.col("id")), F.lit(5)).cast("int").alias("fold")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id", x.alias("x"), F.filter(F.transform(x, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
        .alias("bits"), (F.col("label") % 2).cast("int").alias("y"), "label",
        F.when(F.col("vec_id") % 5 == 0, "query").otherwise("train").alias("role"))


def measurements(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("order_id"),
                     F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("type"),
                     F.col("l_linestatus").alias("unit"), F.col("l_quantity").alias("relation_code"),
                     F.col("l_extendedprice").alias("value"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("grp"),
                                          F.col("p_name").alias("name"), F.col("p_size").alias("value"))


# ---- the same views as SQL -------------------------------------------------------------------------------------

def _chars(text: str, chars: str) -> str:
    quoted = chars.replace("'", "''")
    return f"(length({text}) - length(translate({text}, '{quoted}', '')))"


def _lin(coef: dict[str, float]) -> str:
    return " + ".join([f"({coef['bias']})::DOUBLE"] + [
        f"({w})::DOUBLE * coalesce({n}, 0)" for n, w in coef.items() if n != "bias"])


_RUNS = " UNION ALL ".join(
    f"SELECT doc_id, source, '{m}' AS model, {s}::INT AS seed, round(1 / (1 + exp(-({_lin(c)} + "
    f"({SEED_SHIFT * s})::DOUBLE * coalesce(mean_token, 0)))), 6) AS y_prob FROM library"
    for m, c in MODELS.items() for s in SEEDS)

HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def sql_hash(expr: str) -> str:
    return HASH.format(f"({expr})::VARCHAR")


SQL_VIEWS: dict[str, str] = {
    "tok": "SELECT doc_id, text, source, coalesce(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), "
           "lambda t: t <> ''), []) AS tok FROM documents",
    "norm": "SELECT *, array_to_string(tok, ' ') AS norm, coalesce(text, '') AS txt FROM tok",
    "library": f"""SELECT doc_id, text, source, tok, norm,
  length(norm)::DOUBLE AS n_chars, len(tok)::DOUBLE AS n_tokens, len(list_distinct(tok))::DOUBLE AS n_unique,
  len(list_distinct(tok))::DOUBLE / nullif(len(tok), 0) AS unique_ratio,
  (length(norm) - len(tok) + 1)::DOUBLE / nullif(len(tok), 0) AS mean_token,
  {_chars('norm', X.DIGITS)}::DOUBLE / nullif(length(norm), 0) AS digit_ratio,
  {_chars('norm', X.UPPER)}::DOUBLE / nullif(length(norm), 0) AS upper_ratio,
  {_chars('norm', X.VOWELS)}::DOUBLE / nullif(length(norm), 0) AS vowel_ratio,
  {_chars('norm', X.PUNCT)}::DOUBLE / nullif(length(norm), 0) AS punct_ratio,
  {_chars('norm', X.SYMBOLS)}::DOUBLE / nullif(length(norm), 0) AS symbol_ratio,
  (length(txt) - length(replace(txt, chr(10), '')) + 1)::DOUBLE AS n_lines,
  length(txt)::DOUBLE / (length(txt) - length(replace(txt, chr(10), '')) + 1) AS line_length
  FROM norm""",
    "runs": _RUNS,
    "predictions": f"""SELECT r.doc_id AS id, r.source, l.quality AS y_true, r.y_prob, r.model, r.seed,
  ({sql_hash('r.doc_id')} % 5)::INT AS fold FROM runs r JOIN labels l ON l.doc_id = r.doc_id""",
    "vectors": """SELECT vec_id, embedding::DOUBLE[] AS x, list_filter(list_transform(range(0, 64),
  lambda i: CASE WHEN embedding[i + 1] > 0 THEN i::INT END), lambda i: i IS NOT NULL) AS bits,
  (label % 2)::INT AS y, label, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'train' END AS role FROM embeddings""",
    "measurements": """SELECT l_partkey AS entity_id, l_orderkey AS order_id, l_linenumber AS line,
  l_returnflag AS type, l_linestatus AS unit, l_quantity AS relation_code, l_extendedprice AS value FROM lineitem""",
    "entities": "SELECT p_partkey AS entity_id, p_brand AS grp, p_name AS name, p_size AS value FROM part",
}
SQL_NEEDS = {"norm": ["tok"], "library": ["norm"], "runs": ["library"], "predictions": ["runs"]}


def sql_with(names: list[str], extra: dict[str, str], body: str) -> str:
    """`WITH` over the named views and their inputs, then extra parts in order, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in SQL_NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} {body}") if parts else body
