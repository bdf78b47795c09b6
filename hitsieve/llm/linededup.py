"""Line dedup over levelled sorted runs of line hashes, DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitsieve.llm.common import BLANKS, store, table, text_of
from hitsieve.session import scratch_path

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, row, pos, h1, h2, batch) for each line whose key is long enough.

    `row` is the hash of the text, so rows that repeat an id with other texts keep their own lines. All rows of an id
    are in one batch, so that adding up the batches' documents counts none twice.
    """
    lines = docs.select("doc_id", F.xxhash64(text_of()).alias("row"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


class LineRuns:
    """Sorted runs of (h1, h2, n, top): documents that hold the line in the batch that brought it, largest id.

    A run is a table bucketed and sorted by hash, so a batch that is shuffled once is anti-joined with every run by
    merging. Runs never share a hash: a batch adds only hashes that no run has; what it repeats goes to a side table.
    When a level holds `fanout` runs they are merged into one run of the next level, so every entry is rewritten once
    per level.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes the lines (doc_id, h1, h2) of a batch in; returns the hashes that no run had, with their counts."""
        fresh = batch = store(lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("top")), "batch")
        known = [self.spark.table(name) for level in self.levels for name in level]
        for run in known:
            fresh = fresh.join(run, ["h1", "h2"], "left_anti")
        name = self._write(fresh)
        self._place(name, 0)
        added = self.spark.table(name)
        if known:
            self.repeats.append(batch.join(added, ["h1", "h2"], "left_anti"))
        return added

    def totals(self) -> DataFrame:
        """Documents and largest id of every line hash."""
        parts = [self.spark.table(name) for level in self.levels for name in level] + self.repeats
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.select("h1", "h2", "n", "top").repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
         .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        return name

    def _place(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._place(self._write(merged), level + 1)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The columns of `docs` with `n_lines`, `n_dropped` and `kept_text`.

    Lines whose key has at least `min_chars` code points and stands in at least `min_docs` documents go, except in the
    document with the largest id among those that hold it. A null or empty text is one empty line and stays as it is
    (`kept_text` is empty). Rows without doc_id are not counted as documents and keep their lines; repeated rows of an id
    count as one document and lose the same lines. Extra columns pass through; the three names above are replaced.
    An empty table gives an empty one.
    """
    lines = store(occurrences(docs, min_chars, batches).where("doc_id is not null"), "lines")
    runs = LineRuns(docs.sparkSession)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("doc_id", "h1", "h2"))
        often = store(runs.totals().where(F.col("n") >= min_docs).select("h1", "h2", "top"), "often")
    finally:
        runs.drop()
    gone = (lines.join(often, ["h1", "h2"]).where(F.col("doc_id") != F.col("top"))
            .select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "pos")
            .groupBy("_id", "_row").agg(F.collect_set("pos").alias("_gone")))
    gone = store(gone, "gone")
    rest = docs.drop("n_lines", "n_dropped", "kept_text")
    # one plan for every size: a table small enough to be sent whole here would be shuffled with the texts later on
    joined = rest.withColumn("_hash", F.xxhash64(text_of())).join(
        gone.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    parts = F.split(text_of(), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *rest.columns, F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), text_of()).otherwise(cut).alias("kept_text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their repeated lines taken out; n_chars follows the text, null texts stay null."""
    cut = drop_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


SQL_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '%s', '%s')" % (UPPER, LOWER)
OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {SQL_KEY} AS key FROM lines),
often AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {MIN_CHARS}
          GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.top AS gone
           FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
