"""Ordered work without one big task: prefix sums, ranks, top-k and exact quantiles.

A running sum over all rows of a group would put that group in one task. Here the rows are range-partitioned by the
order itself, whatever its type, so a hot range is cut like any other. Sums run over the partitions of a group (one row
for each partition that the group touches), and then over the rows of one partition. Rows are expected to be aggregated
per distinct value first, so that equal values are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitsieve.session import cut_lineage


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False,
                keep: Column | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Adds `<s>_before` (sum over the rows ahead) and `<s>_total` (sum over the group) for each column of `sums`.

    `df` holds at most one row per (by, order, ties). `keep` may prune partitions of a group: it sees `<s>_off` (sum
    ahead of the partition), `<s>_cell` (sum in it) and `<s>_total`; rows of dropped partitions are not returned.

    The partitioned rows are written once (a reliable checkpoint), because two evaluations of a range partitioning
    could cut at different places.
    """
    by = list(by)
    way = F.col(order).desc() if descending else F.col(order).asc()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *[F.col(c) for c in by], way, *[F.col(t) for t in ties])
    rows = cut_lineage(cut.withColumn("_part", F.spark_partition_id()))
    cells = rows.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"{s}_cell") for s in sums])
    every = W.partitionBy(*(by if by else [F.lit(0)]))
    ahead = every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    cols = {}
    for s in sums:
        cols[f"{s}_off"] = F.coalesce(F.sum(f"{s}_cell").over(ahead), F.lit(0))
        cols[f"{s}_total"] = F.sum(f"{s}_cell").over(every)
    cells = cells.withColumns(cols)
    if keep is not None:
        cells = cells.where(keep)
    inside = W.partitionBy(*by, "_part").orderBy(way, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (_same(rows, cells, [*by, "_part"])
            .withColumns({f"{s}_before": F.col(f"{s}_off") + F.coalesce(F.sum(s).over(inside), F.lit(0))
                          for s in sums})
            .drop("_part", *[f"{s}_off" for s in sums], *[f"{s}_cell" for s in sums]))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join where NULL keys meet NULL keys."""
    names = {k: f"_r{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, r in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return left.join(renamed, cond).drop(*names.values())


def ranked(df: DataFrame, by: Sequence[str], order: str, out: str = "rank", descending: bool = False,
           ties: Sequence[str] = ()) -> DataFrame:
    """0-based position of every row; `order` with `ties` is unique within a group."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (prefix_sums(one, by, order, ["_one"], descending, ties=ties)
            .withColumnsRenamed({"_one_before": out, "_one_total": f"{out}_of"}).drop("_one"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    bounds: bool = False, weight: str | None = None) -> DataFrame:
    """Quantiles with linear interpolation, one column `q<i>` per probability, plus `n`; NULLs are skipped.

    `bounds` also returns the two order statistics around each quantile as `low<i>` and `high<i>`; `weight`
    is a column with the number of times a row counts.

    Values are counted per distinct value first; only the partitions that hold a wanted rank reach the last step.
    """
    by = list(by)
    probs = [min(max(float(p), 0.0), 1.0) for p in probs]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        (F.sum(weight) if weight else F.count("*")).alias("c"))
    spots = [(i, p) for i, p in enumerate(probs)]

    def pos(p: float) -> Column:
        return F.lit(p) * (F.col("c_total") - 1)

    def holds(start: Column, size: Column, rank: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    wanted = F.lit(False)
    for _, p in spots:
        wanted = wanted | holds(F.col("c_off"), F.col("c_cell"), F.floor(pos(p))) \
            | holds(F.col("c_off"), F.col("c_cell"), F.ceil(pos(p)))
    rows = prefix_sums(counts, by, value, ["c"], keep=wanted)
    aggs = [F.max("c_total").alias("n")]
    for i, p in spots:
        low, high = F.floor(pos(p)), F.ceil(pos(p))
        aggs.append(F.max(F.when(holds(F.col("c_before"), F.col("c"), low), F.col(value))).alias(f"low{i}"))
        aggs.append(F.max(F.when(holds(F.col("c_before"), F.col("c"), high), F.col(value))).alias(f"high{i}"))
    out = rows.groupBy(*by).agg(*aggs)
    for i, p in spots:
        frac = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        out = out.withColumn(f"q{i}", F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * frac)
    return out if bounds else out.drop(*[f"low{i}" for i, _ in spots], *[f"high{i}" for i, _ in spots])
