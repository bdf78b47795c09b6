"""Metrics over prediction rows (`y_true`, `y_prob`, group columns): confusion, ranking, thresholds, curves.

Ranking metrics count rows per distinct score first, so a score shared by a third of the rows is one row when
the running sums start; the running sums themselves go by range partitions (see `ordering`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitsieve.operators.ordering import exact_quantiles, prefix_sums, ranked
from hitsieve.schemas import METRICS


def grouped(fn):
    """Lets an operator that joins on its groups run without any: all rows form one constant group."""

    @wraps(fn)
    def run(df: DataFrame, by: Sequence[str], *args, **kw) -> DataFrame:
        if by:
            return fn(df, by, *args, **kw)
        return fn(df.withColumn("_all", F.lit(0)), ["_all"], *args, **kw).drop("_all")

    return run


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    precision, recall, fpr = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(fp, fp + tn)
    return {
        "precision": precision, "recall": recall, "tpr": recall, "fpr": fpr,
        "f1": ratio(2.0 * precision * recall, precision + recall),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
    }


def _hits(pred: Column) -> list[Column]:
    y = F.col("y_true")
    return [F.count_if((y == 1) & pred).alias("tp"), F.count_if((y == 0) & pred).alias("fp"),
            F.count_if((y == 0) & ~pred).alias("tn"), F.count_if((y == 1) & ~pred).alias("fn")]


def confusion_at(df: DataFrame, by: Sequence[str], threshold: float | str) -> DataFrame:
    """Counts and metrics at one threshold, a number or a column of the rows."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    counts = df.groupBy(*by).agg(*_hits(F.col("y_prob") >= t))
    return counts.withColumns(confusion_columns(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def score_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return (df.where(F.col("y_prob").isNotNull() & ~F.isnan("y_prob")).groupBy(*by, "y_prob")
            .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")))


def cumulative(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives at it, above it (`_before`) and in the group (`_total`)."""
    return prefix_sums(score_counts(df, by), by, "y_prob", ["pos", "neg"], descending=True)


def _auc() -> Column:
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0))
    return F.try_divide(area, F.max(F.col("pos_total").cast("double") * F.col("neg_total")))


def _average_precision() -> Column:
    tp = F.col("pos_before") + F.col("pos")
    both = F.col("neg_total") > 0
    return F.sum(F.when(both, F.try_divide(F.col("pos"), F.col("pos_total"))
                        * tp / (tp + F.col("neg_before") + F.col("neg"))))


def roc_auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with one class."""
    return cumulative(df, by).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return cumulative(df, by).groupBy(*by).agg(_average_precision().alias("pr_auc"))


def top_hits(df: DataFrame, by: Sequence[str], fractions: Sequence[float], id_col: str = "id",
             cum: DataFrame | None = None) -> DataFrame:
    """Positives among the top ceil(f * n) rows by score, one row per group and fraction.

    Whole scores inside the top are summed. Only a score that straddles the cut has its rows ordered by id.
    """
    by = list(by)
    cum = cumulative(df, by) if cum is None else cum
    fr = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    n = F.col("pos") + F.col("neg")
    start = F.col("pos_before") + F.col("neg_before")
    total = F.col("pos_total") + F.col("neg_total")
    scored = (cum.select("*", fr)
              .withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("fraction") * total)).cast("bigint"))
              .withColumns({"start": start, "n": n, "total": total}))
    whole = F.col("start") + F.col("n") <= F.col("k")
    cut = (F.col("start") < F.col("k")) & ~whole
    mixed = cut & (F.col("pos") > 0) & (F.col("neg") > 0)
    sure = F.when(whole, F.col("pos")).when(cut & (F.col("neg") == 0), F.col("k") - F.col("start")).otherwise(0)
    base = scored.groupBy(*by, "fraction").agg(
        F.max("k").alias("k"), F.max("total").alias("n"), F.max("pos_total").alias("positives"),
        F.sum(sure).alias("sure"))
    edge = scored.where(mixed).select(*by, "fraction", "y_prob", (F.col("k") - F.col("start")).alias("room"))
    tied = df.select(*by, "y_prob", "y_true", id_col).join(edge, [*by, "y_prob"])
    inside = (ranked(tied, [*by, "fraction"], id_col, "place").where(F.col("place") < F.col("room"))
              .groupBy(*by, "fraction").agg(F.count_if(F.col("y_true") == 1).alias("tie_hits")))
    return (base.join(inside, [*by, "fraction"], "left")
            .withColumn("hits", F.col("sure") + F.coalesce(F.col("tie_hits"), F.lit(0)))
            .drop("sure", "tie_hits"))


def enrichment(df: DataFrame, by: Sequence[str], fractions: Sequence[float] = (0.01, 0.05, 0.10),
               id_col: str = "id", cum: DataFrame | None = None) -> DataFrame:
    """Enrichment factor per fraction and its share of the best attainable; NULL without positives."""
    top = top_hits(df, by, fractions, id_col, cum)
    base = F.try_divide(F.col("positives").cast("double"), F.col("n"))
    ef = F.try_divide(F.col("hits").cast("double") / F.col("k"), base)
    best = F.try_divide(F.least("positives", "k").cast("double") / F.col("k"), base)
    return top.withColumns({"ef": ef, "nef": F.try_divide(ef, best)})


@grouped
def evaluate(df: DataFrame, by: Sequence[str], threshold: float | str = 0.5, id_col: str = "id") -> DataFrame:
    """The eleven report metrics per group; ranking metrics are NULL when a class is missing.

    `threshold` is a number or a column that is constant within a group, such as the locked threshold of its model.
    """
    by = list(by)
    named = isinstance(threshold, str)
    cum = cumulative(df, by)
    if named:
        locked = df.groupBy(*by).agg(F.max(threshold).alias("_locked"))
        cum = cum.join(locked, by)
    high = F.col("y_prob") >= (F.col("_locked") if named else F.lit(float(threshold)))

    def rows(c: str, side: Column) -> Column:
        return F.sum(F.when(side, F.col(c)).otherwise(0))

    rank = cum.groupBy(*by).agg(
        _auc().alias("roc_auc"), _average_precision().alias("pr_auc"), rows("pos", high).alias("tp"),
        rows("neg", high).alias("fp"), rows("neg", ~high).alias("tn"), rows("pos", ~high).alias("fn"))
    counts = [F.col(c) for c in ("tp", "fp", "tn", "fn")]
    rank = rank.withColumns(confusion_columns(*counts)).withColumn(
        "accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
    ef = enrichment(df, by, (0.01, 0.05, 0.10), id_col, cum)
    both = F.col("positives") < F.col("n")
    wide = ef.groupBy(*by).agg(
        *[F.max(F.when(both & (F.abs(F.col("fraction") - f) < 1e-9), F.col("ef"))).alias(name)
          for name, f in (("ef1", 0.01), ("ef5", 0.05), ("ef10", 0.10))],
        F.max(F.when(both & (F.abs(F.col("fraction") - 0.10) < 1e-9), F.col("nef"))).alias("nef10"))
    return rank.join(wide, by, "left").select(*by, *METRICS)


def grid(points: int, kind: str = "float") -> Column:
    """Value of grid position `b`: an even grid on [0, 1] in the given float width."""
    v = F.when(F.col("b") >= points - 1, F.lit(1.0)).otherwise(F.col("b") * F.lit(1.0 / (points - 1)))
    return v.cast(kind)


def _bucket(p: Column, points: int, kind: str) -> Column:
    """Highest grid position whose value does not exceed the score; -1 below the grid.

    Scaling finds it up to one step; comparing with the neighbouring grid values settles it.
    """
    guess = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(p.cast("double") * (points - 1)))).cast("int")
    here, after = (_grid(guess + i, points, kind) for i in (0, 1))
    return (F.when(here > p, guess - 1).when((guess < points - 1) & (after <= p), guess + 1).otherwise(guess))


def _grid(i: Column, points: int, kind: str) -> Column:
    """Value of a grid position: an even grid on [0, 1] in the given float width."""
    return F.when(i >= points - 1, F.lit(1.0)).otherwise(i * F.lit(1.0 / (points - 1))).cast(kind)


def _from_buckets(counts: DataFrame, by: list[str], b: str, points: int, kind: str) -> DataFrame:
    """Counts and metrics at every grid threshold from rows counted per bucket; `points` rows per group."""
    counts = counts.groupBy(*by, F.col(b).alias("b")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    frame = (counts.select(*by).distinct()
             .select(*by, F.explode(F.sequence(F.lit(-1), F.lit(points - 1))).alias("b")))
    full = frame.join(counts, [*by, "b"], "left")
    up = W.partitionBy(*by).orderBy(F.desc("b"))
    run = up.rowsBetween(W.unboundedPreceding, 0)
    every = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    tp, fp = (F.coalesce(F.sum(c).over(run), zero) for c in ("p", "q"))
    pos, neg = (F.coalesce(F.sum(c).over(every), zero) for c in ("p", "q"))
    cum = (full.withColumns({"tp": tp, "fp": fp, "fn": pos - tp, "tn": neg - fp}).where(F.col("b") >= 0)
           .withColumn("threshold", _grid(F.col("b"), points, kind)))
    cols = confusion_columns(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    return (cum.withColumns(cols).withColumn("youden_j", F.col("recall") - F.col("fpr"))
            .select(*by, "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "mcc", "tpr", "fpr",
                    "youden_j"))


def _bucket_counts(df: DataFrame, by: list[str], points: int, kind: str) -> DataFrame:
    """Rows per bucket, by the score in the width of the grid (`b`) and in double (`b64`)."""
    p = F.col("y_prob")
    rows = df.where(p.isNotNull() & ~F.isnan("y_prob")).withColumns(
        {"b": _bucket(p.cast(kind), points, kind), "b64": _bucket(p.cast("double"), points, kind)})
    return rows.groupBy(*by, "b", "b64").agg(
        F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") == 0).alias("q"))


@grouped
def sweep(df: DataFrame, by: Sequence[str], points: int = 501, kind: str = "float") -> DataFrame:
    """Counts and metrics at every grid threshold; one pass over the rows and at most `points` rows per group."""
    by = list(by)
    return _from_buckets(_bucket_counts(df, by, points, kind), by, "b", points, kind)


@grouped
def best_thresholds(df: DataFrame, by: Sequence[str], rule: str = "max_f1", points: int = 501) -> DataFrame:
    """Five optimal thresholds per group and the one locked by `rule`, with its metrics on the rows.

    The lowest threshold wins ties; groups with fewer than two classes give no row; rows without score are skipped.
    The optima compare scores in the float width of the grid, the locked metrics in double, as a user of the
    threshold would; both come from one pass over the rows.
    """
    by = list(by)
    counts = _bucket_counts(df, by, points, "float")
    table = _from_buckets(counts, by, "b", points, "float")

    def best(metric: str) -> Column:
        # comparing rounded metrics keeps ties ties when sums differ in the last bit
        return F.max_by("threshold", F.struct(F.round(F.col(metric), 12), -F.col("threshold")))

    picks = table.groupBy(*by).agg(
        best("f1").alias("max_f1_threshold"), best("mcc").alias("max_mcc_threshold"),
        best("precision").alias("max_precision_threshold"), best("recall").alias("max_recall_threshold"),
        best("youden_j").alias("youden_j_threshold"), F.max(F.col("tp") + F.col("fn")).alias("_p"),
        F.max(F.col("fp") + F.col("tn")).alias("_n"), F.max(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))
        .alias("n_oof"))
    column = "youden_j_threshold" if rule == "youden_j" else f"{rule}_threshold"
    if column not in picks.columns:
        column, rule = "max_f1_threshold", "max_f1"
    picks = (picks.where((F.col("_p") > 0) & (F.col("_n") > 0)).drop("_p", "_n")
             .withColumns({"selection_rule": F.lit(rule), "selected_threshold": F.col(column)}))
    exact = _from_buckets(counts, by, "b64", points, "float").select(
        *by, F.col("threshold").alias("selected_threshold"),
        *[F.col(c).alias(f"selected_{c}") for c in ("f1", "mcc", "precision", "recall")])
    out = picks.join(exact, [*by, "selected_threshold"])
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.endswith("_threshold")})


def exact_thresholds(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Youden and F1 optima over the distinct scores: highest score on Youden ties, lowest on F1 ties."""
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    cols = confusion_columns(tp, fp, F.col("neg_total") - fp, F.col("pos_total") - tp)
    table = (cumulative(df, by).where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
             .withColumns({"j": F.round(cols["recall"] - cols["fpr"], 12), "f": F.round(cols["f1"], 12)}))
    return table.groupBy(*by).agg(
        F.max_by("y_prob", F.struct("j", "y_prob")).alias("youden_threshold"), F.max("j").alias("youden_j"),
        F.max_by("y_prob", F.struct(F.col("f"), -F.col("y_prob"))).alias("f1_threshold"), F.max("f").alias("f1"))


def threshold_curve(df: DataFrame, by: Sequence[str], points: int = 501,
                    selected: DataFrame | None = None) -> DataFrame:
    """Curve table on an even double grid, with the selected threshold of the group when given."""
    rows = sweep(df, by, points, "double").select(
        *by, F.col("threshold").alias("Threshold"), F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"), F.col("tpr").alias("TPR"), F.col("fpr").alias("FPR"),
        F.col("f1").alias("F1"), F.col("mcc").alias("MCC"))
    if selected is None:
        return rows.withColumn("selected_threshold", F.lit(None).cast("double"))
    keys = [c for c in selected.columns if c in by]
    return rows.join(selected.select(*keys, "selected_threshold"), keys, "left")


@grouped
def best_candidate(df: DataFrame, by: Sequence[str], candidates: Sequence[float], metric: str = "mcc") -> DataFrame:
    """Best threshold of a short list; the first of the list wins ties. One pass, counts per candidate."""
    y, p = F.col("y_true"), F.col("y_prob")
    aggs = [F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"),
                     *_hits(p >= F.lit(float(t)))).alias(f"c{i}") for i, t in enumerate(candidates)]
    rows = (df.groupBy(*by).agg(*aggs)
            .select(*by, F.explode(F.array(*[f"c{i}" for i in range(len(candidates))])).alias("c"))
            .select(*by, "c.*"))
    scored = rows.withColumn("score", F.round(confusion_columns(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))[
        "f1" if metric == "f1" else "mcc"], 12))
    return scored.groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("score"), -F.col("i"))).alias("threshold"), F.max("score").alias("score"))


def brier(df: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Brier score per fold, averaged over the folds of a group."""
    one = (df.where(F.col("y_prob").isNotNull()).groupBy(*by, fold)
           .agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), 2)).alias("b")))
    return one.groupBy(*by).agg(F.avg("b").alias("brier"), F.count("*").alias("folds"))


@grouped
def reliability(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Reliability curve over quantile bins; empty bins are left out, bins are numbered as they appear."""
    by = list(by)
    # counted per score first, so a shared score is searched once
    scores = score_counts(df, by).withColumn("n", F.col("pos") + F.col("neg"))
    edges = exact_quantiles(scores, by, "y_prob", [i / bins for i in range(bins + 1)], weight="n")
    inner = edges.select(*by, F.array(*[f"q{i}" for i in range(1, bins)]).alias("edges"))
    per = scores.join(inner, by).withColumn("raw", F.size(F.filter("edges", lambda e: e < F.col("y_prob"))))
    table = per.groupBy(*by, "raw").agg(
        (F.sum(F.col("y_prob") * F.col("n")) / F.sum("n")).alias("mean_pred"),
        (F.sum("pos") / F.sum("n")).alias("frac_pos"), F.sum("n").alias("n"))
    number = F.row_number().over(W.partitionBy(*by).orderBy("raw")) - 1
    return table.withColumn("bin", number).select(*by, "bin", "mean_pred", "frac_pos", "n")


def r_squared(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """1 - residual / total sum of squares; NULL for constant targets or fewer than two rows."""
    res = F.sum(F.pow(F.col("y_true") - F.col("y_prob"), 2))
    tot = F.var_pop("y_true") * F.count("*")
    return df.groupBy(*by).agg((1.0 - F.try_divide(res, F.when(F.count("*") > 1, tot))).alias("r2"))


@grouped
def resampled_curves(df: DataFrame, by: Sequence[str], points: int = 400) -> DataFrame:
    """ROC and PR curves of every group on an even grid: `kind`, `i`, `x`, `y`.

    Curve points fall into grid intervals; the first and last point of an interval are enough to interpolate, so
    at most 2 * `points` rows per curve reach the ordered step.
    """
    by = list(by)
    cum = cumulative(df, by).where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    tp = (F.col("pos_before") + F.col("pos")).cast("double")
    fp = (F.col("neg_before") + F.col("neg")).cast("double")
    order = tp + fp
    recall = tp / F.col("pos_total")
    roc = F.struct(F.lit("roc").alias("kind"), (fp / F.col("neg_total")).alias("x"), recall.alias("y"))
    pr = F.struct(F.lit("pr").alias("kind"), recall.alias("x"), (tp / (tp + fp)).alias("y"))
    pts = (cum.select(*by, order.alias("o"), F.explode(F.array(roc, pr)).alias("c"))
           .select(*by, "o", "c.kind", "c.x", "c.y"))
    starts = (score_counts(df, by).groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
              .where((F.col("p") > 0) & (F.col("q") > 0))
              .select(*by, F.lit(0.0).alias("o"), F.explode(F.array(
                  F.struct(F.lit("roc").alias("kind"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
                  F.struct(F.lit("pr").alias("kind"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))).alias("c"))
              .select(*by, "o", "c.kind", "c.x", "c.y"))
    step = 1.0 / (points - 1)
    guess = F.floor(F.col("x") * (points - 1)).cast("int")

    def value(i: Column) -> Column:
        return F.when(i >= points - 1, F.lit(1.0)).otherwise(i * F.lit(step))

    # smallest grid position whose value is not below x
    slot = (F.when(value(guess - 1) >= F.col("x"), guess - 1).when(value(guess) >= F.col("x"), guess)
            .when(value(guess + 1) >= F.col("x"), guess + 1).otherwise(guess + 2))
    xy = F.struct("o", "x", "y")
    slots = (pts.unionByName(starts).withColumn("i", slot).groupBy(*by, "kind", "i")
             .agg(F.min(xy).alias("first"), F.max(xy).alias("last")))
    frame = (slots.groupBy(*by, "kind").agg(F.lit(1).alias("_x")).drop("_x")
             .select(*by, "kind", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")))
    w = W.partitionBy(*by, "kind").orderBy("i")
    left = F.last("last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first("first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    joined = (frame.join(slots, [*by, "kind", "i"], "left").withColumns({"l": left, "r": right})
              .withColumn("gx", value(F.col("i"))))
    slope = F.try_divide(F.col("r.y") - F.col("l.y"), F.col("r.x") - F.col("l.x"))
    y = F.when(F.col("r").isNull(), F.col("l.y")).otherwise(
        F.coalesce(slope, F.lit(0.0)) * (F.col("gx") - F.col("l.x")) + F.col("l.y"))
    return joined.select(*by, "kind", "i", F.col("gx").alias("x"), y.alias("y"))


def curve_band(curves: DataFrame, model: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the curves of a model at every grid point."""
    return curves.groupBy(*model, "kind", "i", "x").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def curve_areas(curves: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trapezoid area of every resampled curve."""
    w = W.partitionBy(*by, "kind").orderBy("i")
    part = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2.0
    return curves.withColumn("part", part).groupBy(*by, "kind").agg(F.sum("part").alias("area"))


def rank_models(areas: DataFrame, model: Sequence[str]) -> DataFrame:
    """Models by (mean area, deviation), best first, per curve kind."""
    table = areas.groupBy(*model, "kind").agg(F.avg("area").alias("mean"), F.stddev_pop("area").alias("std"))
    w = W.partitionBy("kind").orderBy(F.desc("mean"), F.desc("std"), *[F.asc(m) for m in model])
    return table.withColumn("position", F.row_number().over(w))


def long_metrics(report: DataFrame, by: Sequence[str], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    return report.unpivot(list(by), list(metrics), "metric", "value")
