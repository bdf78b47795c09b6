"""Scalar column functions: parsing, labels, residuals, names, portable hashing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# Label words understood besides plain numbers.
LABEL_WORDS = {"1": 1, "0": 0, "true": 1, "false": 0, "active": 1, "inactive": 0}


def hash32(c: Column) -> Column:
    """First 32 bits of the md5 of the value as text; the same integer on every engine."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded_hash(seed: int | Column, c: Column) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return hash32(F.concat_ws(":", s.cast("string"), c.cast("string")))


def to_number(c: Column) -> Column:
    """Text to double; what does not parse, NaN and infinities become NULL."""
    return finite(c.try_cast("double"))


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def neg_log_molar(value: Column) -> Column:
    """-log10 of a nanomolar value; zero maps to +inf, negative values to NULL."""
    return (F.when(value == 0, F.lit(float("inf")))
            .when(value > 0, -F.log10(value * F.lit(1e-9))))


def activity_label(p: Column, cut: float = 6.0) -> Column:
    return F.when(p >= cut, 1).otherwise(0).cast("int")


def word_label(c: Column) -> Column:
    """The label words mapped to 0/1; anything else NULL."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LABEL_WORDS.items()))
    return F.try_element_at(table, F.lower(F.trim(c.cast("string"))))


def parse_labels(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Label words, or the numeric path for the whole column when one value is no label word.

    The choice is one aggregate over the column, read as a scalar subquery. A value that neither path
    understands raises at execution.
    """
    odd = df.agg(F.coalesce(F.max(word_label(F.col(col)).isNull().cast("int")), F.lit(0))).scalar()
    number = F.col(col).cast("string").try_cast("double").try_cast("int")
    value = F.when(odd == 0, word_label(F.col(col))).otherwise(number)
    bad = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL"))))
    return df.withColumn(out, F.when(value.isNull(), bad.cast("int")).otherwise(value).cast("int"))


def lenient_label(c: Column) -> Column:
    """Non-numeric becomes 0, fractions are cut."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def clip01(p: Column) -> Column:
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), p.cast("float")))


def predict_label(p: Column, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(p >= t, 1).otherwise(0).cast("tinyint")


def log_loss(y: Column, p: Column, eps: float = 1e-9) -> Column:
    q = F.least(F.greatest(p.cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def deviance_residual(y: Column, p: Column) -> Column:
    side = F.when(y - p >= 0, 1.0).otherwise(-1.0)
    return side * F.sqrt(2.0 * log_loss(y, p))


def zscore(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """(x - mean) / sample sigma; a sigma of zero or of a single row counts as 1."""
    stats = [F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd")]
    if by:
        joined = df.join(df.groupBy(*by).agg(*stats), by)
    else:
        one = df.agg(F.struct(*stats).alias("s")).scalar()
        joined = df.withColumn("_s", one).withColumns({"_mu": F.col("_s._mu"), "_sd": F.col("_s._sd")}).drop("_s")
    sd = F.when(F.col("_sd").isNull() | F.isnan("_sd") | (F.col("_sd") == 0), 1.0).otherwise(F.col("_sd"))
    return joined.withColumn(out, (F.col(col) - F.col("_mu")) / sd).drop("_mu", "_sd")


def display_name(c: Column, mode: str = "pretty") -> Column:
    """Underscores become spaces and every word gets a capital; `raw` leaves the name alone."""
    if mode == "raw":
        return c
    if mode != "pretty":
        raise ValueError(f"unknown name mode: {mode!r}")
    return F.initcap(F.trim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), " +", " ")))


def match_token(c: Column) -> Column:
    """Key for tolerant matching: letters, digits, '_' and '-' kept, '-' as '_', lower case."""
    return F.lower(F.replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""), F.lit("-"), F.lit("_")))


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.when(mean.isNotNull() & std.isNotNull(), F.format_string("%.4f ± %.4f", mean, std))


def snake_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Lower-case column names with underscores, then fixed renames."""
    renames = renames or {}
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[renames.get(n, n) for n in names])
