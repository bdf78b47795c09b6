"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hitsieve.llm.common import WORD, store, table

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 17
SLOTS = 4096  # cells of a level; two levels split a source's key range in SLOTS**2 cells
SIGNS = "#*$%&|<>!"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Positive weight that falls with the share of sign characters; an empty text has weight 1."""
    whole = F.coalesce(text, F.lit(""))
    signs = F.length(whole) - F.length(F.translate(whole, SIGNS, ""))
    return 1.0 / (1.0 + 20.0 * signs / F.greatest(F.length(whole), F.lit(1)))


def row_hash(seed: int) -> Column:
    """60 bits of the md5 of seed, id, source and text; rows that are alike in these get the same."""
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(row: Column) -> Column:
    """A number in (0, 1) from 60 random bits."""
    return (row.cast("double") + 0.5) / F.lit(float(1 << 60))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) of a table with one row per source (source, source_size).

    The weights repeat along the sources by code point, null last. A target stops at `most` times the source's size and
    the excess goes to the others by weight. Where the caps bind is found in one pass: sources ordered by cap per
    weight fill up in this order, and a source is capped when the level that its followers would reach is not below
    its own cap. Sources of size 0 have target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.get(cycle, F.pmod(place, F.lit(len(weights))).cast("int"))).withColumn(
        "_cap", most * F.col("source_size"))
    by_cap = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("_total", share * F.sum("source_size").over(whole)).withColumn("_level", level).withColumn(
        "_free", F.col("_cap") > F.col("_w") * F.col("_level"))
    free = filled.withColumn("_rate", F.max(F.when(F.col("_free"), F.col("_level"))).over(whole))
    return free.select("source", "source_size", F.when(F.col("_free"), F.col("_w") * F.col("_rate")).otherwise(F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, times) for each row of `docs`; times is how often the mix takes it.

    Every source is taken in complete epochs first; the rest of its target is filled by Efraimidis-Spirakis sampling:
    each document draws an exponential key divided by its quality weight, keys are sorted within the source, and sizes
    are prefix-summed up to the rest. The document on the border is taken when that brings the sum nearer to the
    target, so a source misses its target by at most half of one document.

    No source is sorted in one task: sizes are summed per cell of the key range, the cell where the prefix sum crosses
    the rest is found among at most SLOTS cells, twice, and only the rows of one cell in SLOTS**2 are ordered.

    Nulls: a null text has size 0, a null source is a source of its own (ordered last), a null doc_id is drawn by its
    text. Documents of size 0 are taken in complete epochs only. Repeated rows have equal keys; they are counted before
    anything is ordered, and as many of their copies as fit are taken where the border falls among them. An empty table
    gives an empty one.
    """
    drawn, cut = cuts(docs, weights, most, seed)
    joined = drawn.join(cut, F.col("source").eqNullSafe(F.col("_source")))
    split, times = border_row("row", F.col("size") > 0), times_of("row", "key", "spot", F.col("size") > 0)
    names = ["row", "doc_id", "source", "size", "source_size", "target"]
    plain = joined.where(~split).select(*names, times.alias("times"))
    # the row whose copies the border parts: so many with one more, the others without
    border = joined.where(split).groupBy(*names, "epochs", "copies", "taken").count()
    given = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")
    parted = border.select(*names, "epochs", "taken", given).select(
        *names, (F.col("epochs") + (F.col("_copy") <= F.col("taken")).cast("int")).cast("long").alias("times"))
    return plain.unionByName(parted)


def draws(docs: DataFrame, seed: int, row: str = "row", key: str = "key", spot: str = "spot") -> DataFrame:
    """`docs` with each row's hash, its exponential key over its quality and the key's cell."""
    drawn = docs.withColumn(row, row_hash(seed)).withColumn(key, -F.log(uniform(F.col(row))) / quality_weight(F.col("text")))
    return drawn.withColumn(spot, (F.lit(float(SLOTS * SLOTS)) * (1 - F.exp(-F.col(key) / 4))).cast("int"))


def border_row(row: str, sized: Column, of: str = "") -> Column:
    """Whether a row joined with its source's cut (`of` stands before the cut's columns) is the one whose copies the border parts."""
    return F.coalesce((F.col(row) == F.col(f"{of}_part_row")) & sized, F.lit(False))


def times_of(row: str, key: str, spot: str, sized: Column, of: str = "") -> Column:
    """How often a row joined with its source's cut is taken, unless the border parts its copies."""
    border, place = F.col(f"{of}border"), F.struct(F.col(key).alias("key"), F.col(row).alias("row"))
    below = (F.col(spot) < border) | ((F.col(spot) == border) & F.coalesce(place <= F.col(f"{of}last"), F.lit(False)))
    more = F.when(sized & (F.col(f"{of}rest") > 0) & F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return (F.col(f"{of}epochs") + more).cast("long")


def cuts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The drawn rows without their texts, and a row for each source: its epochs, and where in the order of keys its rest ends."""
    drawn = draws(docs.select("doc_id", "source", "text"), seed).withColumn("size", size_of(F.col("text")))
    drawn = store(drawn.select("row", "doc_id", "source", "size", "key", "spot"), "drawn")
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = store(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")

    def crossing(rows: DataFrame, rest: DataFrame, cell: Column, name: str) -> DataFrame:
        sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("size"))
        upto = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("before", upto).join(rest, sums["source"].eqNullSafe(rest["_source"])).where(
            (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
        return store(found.select("_source", F.col("cell").alias(name), (F.col("rest") - F.col("before")).alias("rest")), "cells")

    same = F.col("source").eqNullSafe(F.col("_source"))
    rest = plan.select(F.col("source").alias("_source"), "rest")
    coarse = crossing(drawn, rest, F.floor(F.col("spot") / SLOTS), "coarse")
    inside = drawn.join(coarse, same & (F.floor(F.col("spot") / SLOTS) == F.col("coarse"))).select("source", "spot", "size")
    fine = crossing(inside, coarse.select("_source", "rest"), F.col("spot"), "border")
    edge = drawn.join(fine, same & (F.col("spot") == F.col("border")) & (F.col("size") > 0))
    # equal rows are one row with a number of copies before anything is ordered
    edge = edge.groupBy("source", "key", "row", "doc_id", "size").agg(F.count("*").alias("copies"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("key", "row", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    room = (F.col("rest") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))) / F.col("size")
    edge = edge.withColumn("taken", F.least(F.greatest(F.floor(room + 0.5), F.lit(0)), F.col("copies")).cast("long"))
    edge = store(edge.where("taken > 0"), "edge")
    full = edge.where("taken = copies").groupBy("source").agg(F.max(F.struct("key", "row")).alias("last"))
    part = edge.where("taken < copies").select(F.col("source").alias("_part_source"), F.col("row").alias("_part_row"), "copies", "taken")
    cut = fine.join(full, full["source"].eqNullSafe(fine["_source"]), "left").select("_source", "border", "last")
    cut = cut.join(part, F.col("_source").eqNullSafe(F.col("_part_source")), "left").select("_source", "border", "last", "_part_row", "copies", "taken")
    cut = plan.join(cut, same, "left").select(F.col("source").alias("_source"), "source_size", "target", "epochs", "rest", "border", "last",
                                              "_part_row", "copies", "taken")
    return drawn, store(cut, "cuts")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; documents that it does not take go."""
    _, cut = cuts(docs)
    sized = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # the cuts are a row for each source, so a document learns where it is read how often it is taken
    drawn = draws(docs, SEED, "__mix_at", "__mix_key", "__mix_spot").withColumn("__mix_sized", sized)
    placed = drawn.join(F.broadcast(cut.select(F.struct("*").alias("__mix_cut"))), F.col("source").eqNullSafe(F.col("__mix_cut._source")))
    split = border_row("__mix_at", F.col("__mix_sized"), "__mix_cut.")
    times = times_of("__mix_at", "__mix_key", "__mix_spot", F.col("__mix_sized"), "__mix_cut.")
    even = placed.where(~split).withColumn("__mix_times", times).where("__mix_times > 0").select(*docs.columns, "__mix_times")
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))
    if cut.where("_part_row is not null").isEmpty():
        return even.withColumn("__mix_copy", copies).select(*docs.columns)
    # copies of one row that the border parts: numbered within each part of the table, then across its parts
    odd = placed.where(split).withColumns({"__mix_p": F.spark_partition_id(), "__mix_i": F.monotonically_increasing_id()})
    odd = store(odd.select(*docs.columns, "__mix_at", "__mix_p", "__mix_i", F.col("__mix_cut.epochs").cast("long").alias("__mix_least"),
                           F.col("__mix_cut.taken").alias("__mix_extra")), "parted")
    counts = odd.groupBy("__mix_at", "__mix_p").agg(F.count("*").alias("__mix_c"))
    upto = F.sum("__mix_c").over(Window.partitionBy("__mix_at").orderBy("__mix_p").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("__mix_at").alias("__mix_a"), F.col("__mix_p").alias("__mix_q"), F.coalesce(upto, F.lit(0)).alias("__mix_before"))
    place = F.row_number().over(Window.partitionBy("__mix_at", "__mix_p").orderBy("__mix_i"))
    ranked = odd.withColumn("__mix_r", place).join(before, (F.col("__mix_at") == F.col("__mix_a")) & (F.col("__mix_p") == F.col("__mix_q")))
    parted = ranked.withColumn("__mix_times", F.col("__mix_least") + (F.col("__mix_r") + F.col("__mix_before") <= F.col("__mix_extra")).cast("int")).where("__mix_times > 0")
    every = even.select(*docs.columns, "__mix_times").unionByName(parted.select(*docs.columns, "__mix_times"))
    return every.withColumn("__mix_copy", copies).select(*docs.columns)


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SIGNS}', '')))
      / greatest(length(coalesce(text, '')), 1)) AS quality,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS row
  FROM documents),
drawn AS (SELECT *, -ln((row::DOUBLE + 0.5) / {float(1 << 60)}::DOUBLE) / quality AS key FROM sized),
sizes AS (SELECT source, sum(size)::DOUBLE AS source_size,
            [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
          FROM drawn GROUP BY source),
levels AS (SELECT *, {MOST} * source_size AS cap,
             (sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER before, 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
           FROM sizes
           WINDOW before AS (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size::BIGINT AS source_size,
           CASE WHEN cap > w * level THEN w * max(level) FILTER (WHERE cap > w * level) OVER () ELSE cap END AS target FROM levels),
summed AS (SELECT d.*, p.source_size, p.target,
             CASE WHEN p.source_size > 0 THEN floor(target / p.source_size) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, source,
       (size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size > 0
                               AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
