"""Embedding near-dedup: exact range join of unit vectors over pivot cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hitsieve.llm.common import Forest, in_blocks, starts_of, store, table
from hitsieve.llm.graph import components

COSINE = 0.98
BLOCK = 1024  # vectors on a side of a block
PER_CELL, MOST_PIVOTS = 2048, 1024  # a pivot for so many vectors; the pivots of all lengths are broadcast, so their number is bounded
SLACK = 1e-9  # rounding of distances, in favour of copying a vector to a cell


def _unit(data: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of float bytes, all of one length, as unit vectors in double precision; sizes whose squares overflow are scaled first."""
    rows = np.stack([np.frombuffer(x.as_py(), kind) for x in data]).astype(np.float64)
    most = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where((most > 1e100) | (most < 1e-100), most, 1.0)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class _Cells:
    """Home cell of each vector and the cells within reach; vectors of a length without pivots are all at home in cell 0.

    A vector y linked to x has |x - y| <= reach. If y is nearer to pivot c than to x's own pivot h, then by the
    triangle inequality d(x, c) - d(x, h) <= 2 * reach, and more sharply the distance of x to the plane between the
    pivots, (d(x, c)**2 - d(x, h)**2) / (2 * d(h, c)), is at most `reach`. Both bounds hold for every link.
    """

    def __init__(self, pivots, reach: float, kind: str):
        self.pivots, self.reach, self.kind = pivots, reach, kind

    def __call__(self, batches):
        by_size = self.pivots.value
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            row, cell, home = [], [], []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                pivots = by_size.get(int(dim))
                if pivots is None:
                    row.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    home.append(np.ones(len(at), bool))
                    continue
                unit = _unit(batch.column("vec").take(pa.array(at)), self.kind)
                gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
                square = np.maximum(0, 2 - 2 * unit @ pivots.T)
                own = square.argmin(axis=1)
                nearest = square[np.arange(len(at)), own][:, None]
                reached = (np.sqrt(square) - np.sqrt(nearest) <= 2 * self.reach + SLACK) & (
                    square - nearest <= 2 * gap[own] * (self.reach + SLACK) + SLACK)
                reached[np.arange(len(at)), own] = True
                i, c = np.nonzero(reached)
                row.append(at[i])
                cell.append(c)
                home.append(c == own[i])
            if row:
                order = pa.array(np.concatenate(row))
                kept = [batch.column(n).take(order) for n in ("label", "dim", "rep", "copies", "vec")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(home))],
                                                 ["label", "dim", "rep", "copies", "vec", "cell", "home"])


def _pivots(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Unit pivots of the lengths that hold more than PER_CELL classes, the most frequent lengths first, at most MOST_PIVOTS in all.

    Any pivots give the same links, and so does a length without: its one cell is split into blocks like any large cell.
    """
    many = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_CELL).orderBy(F.desc("n"), "dim").limit(MOST_PIVOTS).collect()
    wanted, left = [], MOST_PIVOTS
    for r in many:
        k = min(-(-r["n"] // PER_CELL), left)
        if k > 1:
            wanted.append((r["dim"], r["n"], k))
            left -= k
    if not wanted:
        return {}
    spark = classes.sparkSession
    asked = F.broadcast(spark.createDataFrame(wanted, "dim int, n long, k int"))
    # an even sample of some more than k of each length, so that the ranking sees few rows whatever the length holds
    some = classes.join(asked, "dim").where(F.pmod("h1", "n") < 4 * F.col("k") + 64)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy("h1", "h2"))
    found: dict[int, list] = {}
    for r in some.withColumn("_at", rank).where("_at <= k").select("dim", "vec").collect():
        found.setdefault(r["dim"], []).append(bytes(r["vec"]))
    return {dim: _unit(pa.array(p, pa.binary()), kind) for dim, p in found.items()}


class _Match:
    """Links of the probing rows of each block with its other rows, and a spanning forest of what is linked."""

    def __init__(self, cosine: float, kind: str):
        self.cosine, self.kind = cosine, kind

    def __call__(self, whole: pa.Table) -> pa.Table | None:
        reps, probe, copies = (whole.column(c).to_numpy() for c in ("rep", "probe", "copies"))
        out: list[list[np.ndarray]] = [[], [], []]
        cuts = starts_of(whole.column("blk").to_numpy())
        for begin, end in zip(cuts[:-1], cuts[1:]):
            asks = np.flatnonzero(probe[begin:end]) + begin
            has = np.flatnonzero(~probe[begin:end]) + begin
            if not len(asks) or not len(has):
                continue
            near = _unit(whole.column("vec").take(pa.array(asks)), self.kind) @ _unit(whole.column("vec").take(pa.array(has)), self.kind).T >= self.cosine
            near &= reps[asks][:, None] != reps[has][None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            names, at = np.unique(np.concatenate([reps[asks[i]], reps[has[j]]]), return_inverse=True)
            forest = Forest(len(names))
            forest.join(zip(at[:len(i)].tolist(), at[len(i):].tolist()))
            links = np.zeros(len(names), np.int64)
            np.add.at(links, at[:len(i)], copies[has[j]])
            out[0].append(names)
            out[1].append(links)
            out[2].append(names[[forest.root(x) for x in range(len(names))]])
        if not out[0]:
            return None
        return pa.table({n: np.concatenate(x) for n, x in zip(("rep", "links", "root"), out)})


def usable(embedding) -> F.col:
    """A vector with components, all present and finite, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors(vec_id, embedding, label)`.

    Rows of the same label (not null) are linked when their cosine in double precision is at least `cosine`; vectors of
    different length never are. Null, empty and zero vectors, those with null or non-finite components, and rows without
    label link with nothing and are their own component. Equal vectors of a label are one class before anything is
    compared, so `n_links` counts copies without pairing them. Repeated rows count as copies; a null vec_id stands for
    id -1. Different vectors of one id, or without id, are different nodes with their own links and components. An
    empty table gives an empty one. An array of doubles is compared as such.

    Unit vectors are dealt to the cells of their nearest pivot (an even sample of the data, one for PER_CELL vectors of
    a length; lengths with fewer vectors, and those that MOST_PIVOTS leaves without, have one cell) and copied to every cell that may hold a partner. Each cell is joined on its own, each label apart; a large cell is
    split into blocks of BLOCK by BLOCK vectors, and a block returns counts and a spanning forest, never its pairs.
    Every link of a vector is found in its home cell.
    """
    spark = vectors.sparkSession
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    kind = "<f8" if wide else "<f4"
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(-1)).alias("vec_id"), "label",
                          F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    fine = F.col("label").isNotNull() & usable(F.col("embedding"))
    keyed = store(rows.withColumn("fine", fine).withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", "label")}), "vectors")
    classes = keyed.where("fine").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = classes.withColumn("rep", F.xxhash64("h1", "h2"))  # the class is the node, not an id that several may bear

    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([np.array(x.as_py(), kind).tobytes() for x in lists], pa.binary())

    classes = store(classes.select("h1", "h2", "rep", "least", "copies", "label", F.size("embedding").alias("dim"), packed("embedding").alias("vec")), "classes")
    pivots = _pivots(classes, kind)
    reach = float(np.sqrt(2 - 2 * cosine))
    cells = classes.select("label", "dim", "rep", "copies", "vec").mapInArrow(
        _Cells(spark.sparkContext.broadcast(pivots), reach, kind), "label int, dim int, rep long, copies long, vec binary, cell int, home boolean")
    cells = store(cells.withColumn("key", F.xxhash64("label", "dim", "cell")), "cells")
    sizes = cells.groupBy("key").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("kh"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ka"))
    placed = cells.join(sizes, "key")
    part = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    others = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    asks = placed.where("home").withColumns({"x": part("kh"), "y": others("ka")}).withColumn("probe", F.lit(True))
    has = placed.where("kh > 0").withColumns({"y": part("ka"), "x": others("kh")}).withColumn("probe", F.lit(False))
    blocks = asks.unionByName(has).select(F.xxhash64("key", "x", "y").alias("blk"), "rep", "copies", "vec", "probe")
    exact = store(in_blocks(blocks, "blk", _Match(cosine, kind), "rep long, links long, root long"), "exact")
    linked = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(exact.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), F.col("label").alias("group"))
    members = classes.select("h1", "h2", "rep", "least", "copies").join(linked, "rep", "left").join(groups, "rep", "left")
    smallest = members.where("group is not null").groupBy("group").agg(F.min("least").alias("first"))
    named = members.join(smallest, "group", "left").select(
        "h1", "h2", F.lit(True).alias("fine"), F.coalesce("first", "least").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = keyed.select("vec_id", "fine", "h1", "h2").join(named, ["h1", "h2", "fine"], "left")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
                        ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e, list_sum([x::DOUBLE * x::DOUBLE for x in embedding]) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE a.q > 0 AND b.q > 0 AND list_dot_product(a.e, b.e) / sqrt(a.q) / sqrt(b.q) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN named ON named.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""
