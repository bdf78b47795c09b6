"""Connected components on Spark: contraction by smallest neighbours and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hitsieve.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in `edges(a, b)`; the label is the smallest id reachable.

    Every round gives each node its smallest neighbour, follows these links twice and contracts the edges, so paths
    shrink by a constant factor. Smallest neighbours are aggregated before the shuffle, edges are never collected.
    Rows with a null end and loops are ignored; no edges give no rows.
    """
    live = store(_normal(edges), "edges")
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = store(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("p")), "hooks")
        for _ in range(2):
            hook = hook.join(hook.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        hook = store(hook, "jumps")
        if labels is None:
            labels = hook.select(F.col("a").alias("id"), F.col("p").alias("label"))
        else:
            step = hook.select(F.col("a").alias("label"), "p")
            labels = store(labels.join(step, "label", "left").select("id", F.coalesce("p", "label").alias("label")), "labels")
        left, right = hook.select("a", F.col("p").alias("pa")), hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        live = store(_normal(moved), "edges")
    if labels is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels


def _normal(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
