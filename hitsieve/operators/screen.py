"""Screening: filter funnels, feature store, validity, scoring, counters, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hitsieve.functions.scalar import clip01, finite, predict_label
from hitsieve.functions.text import (catalogue_match, desirability, rule_flag, symbols_allowed, weighted_geometric_mean,
                                     with_descriptors, with_fingerprint)
from hitsieve.operators.features import fill_missing
from hitsieve.schemas import MissingPolicy, Rule

Stage = tuple[str, Column]


def with_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """`stage`: number of leading stages a row passes. Later stages are not evaluated after a failure."""
    passed = F.lit(len(stages))
    for i, (_, cond) in reversed(list(enumerate(stages))):
        passed = F.when(~F.coalesce(cond, F.lit(False)), F.lit(i)).otherwise(passed)
    return df.withColumn("stage", passed)


def survivors(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Rows that pass every stage; stages keep their order, so the cheap ones run first."""
    for _, cond in stages:
        df = df.where(cond)
    return df


def funnel(df: DataFrame, stages: Sequence[Stage], by: Sequence[str] = ()) -> DataFrame:
    """(stage, name, rows) with the survivors after every stage, from one pass over the rows."""
    staged = with_stages(df, stages)
    counts = staged.groupBy(*by).agg(F.count("*").alias("_0"), *[
        F.count_if(F.col("stage") > i).alias(f"_{i + 1}") for i in range(len(stages))])
    names = ["input", *[n for n, _ in stages]]
    cells = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(f"_{i}").alias("rows"))
                      for i, n in enumerate(names)])
    return counts.select(*by, F.inline(cells))


def basic_stages(text: str, rules: Sequence[Rule], patterns: Sequence[str], max_length: int) -> list[Stage]:
    return [("length", F.length(text) < max_length), ("rules", rule_flag(rules)),
            ("catalogue", ~catalogue_match(F.col(text), patterns))]


def strict_stages(symbols: Column, allowed: Sequence[str], rules: Sequence[Rule], parts, least: float) -> list[Stage]:
    return [("symbols", symbols_allowed(symbols, allowed)), ("ranges", rule_flag(rules)),
            ("desirability", desirability_score(parts) >= least)]


def desirability_score(parts: Sequence[tuple]) -> Column:
    """Weighted geometric mean over (weight, column, centre, width, rising)."""
    return weighted_geometric_mean([(w, desirability(F.col(c), mid, width, up)) for w, c, mid, width, up in parts])


def feature_store(df: DataFrame, id_col: str, text: str, names: Sequence[str], n_bits: int,
                  policy: MissingPolicy = MissingPolicy()) -> DataFrame:
    """Ids, text, fingerprint, imputed descriptors and indicators; rows without id or text are dropped.

    One projection over the scan, no shuffle.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(text)) > 0))
    rows = with_descriptors(rows, names, text)
    rows = with_fingerprint(rows, text, n_bits=n_bits)
    filled, columns = fill_missing(rows.where(F.size("bits") > 0), names, policy)
    floats = {c: F.col(c).cast("float") for c in names}
    flags = {c: F.col(c).cast("boolean") for c in columns if c not in names}
    return filled.withColumns(floats | flags)


def skip_reasons(df: DataFrame, id_col: str, text: str, names: Sequence[str], text_ok: Column | None = None) -> DataFrame:
    """`skip_reason`: base (id or text unusable), then nan (a feature is missing), then text; NULL when valid."""
    base_ok = F.col(id_col).cast("string").try_cast("double").isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)
    has_nan = F.lit(False)
    for n in names:
        has_nan = has_nan | finite(F.col(n)).isNull()
    ok = F.lit(True) if text_ok is None else F.coalesce(text_ok, F.lit(False))
    return df.withColumn("skip_reason", F.when(~base_ok, "base").when(has_nan, "nan").when(~ok, "text"))


def score_rows(df: DataFrame, score: Callable[[DataFrame], DataFrame] | Column, threshold: float, model: str, seed: int,
               id_col: str, text: str) -> DataFrame:
    """Score output: clipped float probability, label, and the constants of the run."""
    scored = df.withColumn("y_prob", score) if isinstance(score, Column) else score(df)
    p = clip01(F.col("y_prob"))
    return scored.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), p.alias("prob"),
        predict_label(p.cast("double"), float(threshold)).alias("pred_label"), F.lit(model).alias("model_name"),
        F.lit(seed).cast("bigint").alias("seed"), F.lit(float(threshold)).cast("float").alias("threshold_used"))


def counters(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Processed, predicted and skipped rows from `skip_reason`."""
    why = F.col("skip_reason")
    return df.groupBy(*by).agg(
        F.count("*").alias("processed"), F.count_if(why.isNull()).alias("predicted"),
        F.count_if(why.isNotNull()).alias("skipped"), F.count_if(why == "nan").alias("skipped_nan"),
        F.count_if(why == "text").alias("skipped_text"))


# Threshold columns read per metric, in order, and the common fallback.
THRESHOLD_COLUMNS = {
    "f1": ["max_f1_threshold", "selected_threshold", "f1_threshold"],
    "mcc": ["max_mcc_threshold", "mcc_threshold", "youden_j_threshold", "youden_threshold"],
    "youden": ["youden_j_threshold", "youden_threshold", "j_threshold"],
    "precision": ["max_precision_threshold", "precision_threshold"],
    "recall": ["max_recall_threshold", "recall_threshold"],
}
THRESHOLD_FALLBACK = ["selected_threshold", "max_f1_threshold", "youden_j_threshold"]


def resolve_threshold(df: DataFrame, mode: str | float = "auto", metric: str = "f1", compat: bool = False,
                      out: str = "threshold") -> DataFrame:
    """A fixed number, or the first threshold column with a value for the metric, else 0.5; must lie in [0, 1].

    `compat` reads the selected threshold before the F1 optimum.
    """
    if mode != "auto":
        value = float(mode)
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"threshold out of range: {value}")
        return df.withColumn(out, F.lit(value))
    if metric not in THRESHOLD_COLUMNS:
        raise ValueError(f"unknown threshold metric: {metric}")
    order = list(THRESHOLD_COLUMNS[metric])
    if compat and metric == "f1":
        order = ["selected_threshold", "max_f1_threshold", "f1_threshold"]
    found = [finite(F.col(c)) for c in [*order, *THRESHOLD_FALLBACK] if c in df.columns]
    t = F.coalesce(*found, F.lit(0.5))
    bad = F.raise_error(F.lit("threshold out of range")).cast("double")
    return df.withColumn(out, F.when((t < 0) | (t > 1), bad).otherwise(t))


def sanity_check(df: DataFrame, names: Sequence[str], bits: str, n_bits: int) -> dict[str, int]:
    """One pass over all rows: columns present, bit positions in range, rows with missing features."""
    missing = [c for c in [*names, bits] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    nan = F.lit(False)
    for n in names:
        nan = nan | finite(F.col(n)).isNull()
    got = df.agg(F.count("*").alias("rows"), F.count_if(nan).alias("nan_rows"),
                             F.count_if(F.array_max(bits) >= n_bits).alias("bad_bits")).first()
    if got["bad_bits"]:
        raise ValueError(f"bit positions beyond {n_bits}")
    return {"rows": got["rows"], "nan_rows": got["nan_rows"], "n_bits": n_bits, "n_descriptors": len(names)}
