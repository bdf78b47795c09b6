"""Spelling variants: words at one edit are found by PartEnum signatures of their letters and led to their commonest form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitsieve.llm.common import store, table, text_of

# What a word's letters are, and which of them are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199  # a run whose checksum this number divides has lost a letter
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
DISTANCE = 2  # Hamming distance of the letter multisets of two words at one edit, at most
PARTS = 6  # parts of the alphabet; a signature leaves out `DISTANCE` of them
BLOCK = 512  # words of a signature that meet in one cell; a signature with more is split into cells


def word_counts(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """`word`, `n`: the runs of letters of all whole texts with at least so many code points and occurrences.

    A to Z are lower-cased. Where `slip` divides the unsigned crc32 of `<doc_id>:<run>` (an id that is null counts as
    empty), the run loses its code point at checksum modulo length. Runs of a document are counted before the checksum
    is taken, and counts are added up before each shuffle, so a word that a third of all texts hold is a row a task.
    Null and empty texts have no words; each of several rows of an id counts; an empty table gives an empty one.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.split(text_of(), f"[^{LETTERS}]+")).alias("run")).where("run <> ''")
    lower = F.translate("run", UPPER, LOWER)
    here = runs.select("_id", lower.alias("run"))
    sum_ = F.crc32(F.concat("_id", F.lit(":"), F.col("run")).cast("binary"))
    size = F.char_length("run")
    at = (F.col("_h") % size).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = here.withColumn("_h", sum_).select(F.when(F.col("_h") % slip == 0, lost).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def alphabet_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters in parts of about equal use: one by one, the commonest first, each to the part used least so far.

    Collects a row for each letter (at most 116 for the fixed alphabet).
    """
    use = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    sums, out = [0] * parts, [""] * parts
    for c, n in sorted(((r["c"], r["count"]) for r in use), key=lambda x: (-x[1], x[0])):
        k = min(range(parts), key=lambda i: (sums[i], i))
        sums[k] += n
        out[k] += c
    return out


def signatures(word: Column, parts: list[str], distance: int = DISTANCE) -> Column:
    """PartEnum signatures of a word's multiset of letters, as 64-bit hashes.

    The dimensions (a letter and which one of its kind) are parted by letter. Multisets at Hamming distance of at most
    `distance` differ in at most so many parts, so they agree in what is left without some choice of `distance` parts:
    each choice is a signature, the sorted letters of the other parts. Two words with equal hashes are verified.
    """
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    left = [F.xxhash64(F.lit(k), F.translate(letters, "".join(parts[p] for p in out), ""))
            for k, out in enumerate(combinations(range(len(parts)), distance))]
    return F.array(*left)


def near_pairs(words: DataFrame, parts: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """`a`, `b` with a < b: all pairs of different words that differ by one inserted, deleted or replaced code point.

    Words of equal signature meet in an equi-join and are verified there. A signature of more than `block` words is dealt
    over cells of two blocks each, so no task gets a whole group and nothing is left out; only verified pairs are kept.
    """
    words = words.select("word")
    found = store(words.select("word", F.explode(signatures(F.col("word"), parts or alphabet_parts(words))).alias("sig")), "signatures")
    sizes = found.groupBy("sig").count().where("count > 1").select("sig", F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
    dealt = found.join(sizes, "sig").withColumn("_block", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    left = dealt.select("sig", F.col("_block").alias("lo"), F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("hi"), F.col("word").alias("x"))
    right = dealt.select("sig", F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("lo"), F.col("_block").alias("hi"), F.col("word").alias("y"))
    close = (F.col("x") != F.col("y")) & ((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y")))
    close &= F.abs(F.char_length("x") - F.char_length("y")) <= 1
    met = left.join(right, ["sig", "lo", "hi"]).where(close & (F.levenshtein("x", "y", 1) == 1))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def with_forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`: the near word of largest n (ties: the first in code-point order).

    The form stays null where its n is less than `times` the word's. Words without near ones keep a row.
    """
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    met = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    out = words.select("word", "n").join(best, "word", "left")
    enough = -F.col("_best.less") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("_best.near")).alias("form"),
                      F.when(enough, -F.col("_best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """The rows with `root`: from a word along its forms to the last one, the word itself where it has none.

    Every step at least multiplies n by `times`, so chains are short; the way doubles with each join until none grows.
    """
    links = store(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = store(links.join(next_, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_grew")), "roots")
        links = longer.drop("_grew")
        if longer.where("_grew").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, **options) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of all words of the texts; see `word_counts` for what words are."""
    words = store(word_counts(docs, **options), "words")
    forms = store(with_forms(words, near_pairs(words)), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


# DuckDB has no crc32; it is folded over the bytes with the table of its polynomial.
OP11_SQL = r"""
WITH RECURSIVE entry(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM entry WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM entry WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, m, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT) AS b
  FROM (SELECT run, m, hex(encode(id || ':' || run)) AS h FROM runs)),
words AS (
  SELECT word, sum(m)::BIGINT AS n FROM (
    SELECT m, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
    FROM (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS h
          FROM bytes, crc))
  WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
shorter AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT s.word, w.word AS other FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT s.word, t.word FROM shorter s JOIN shorter t ON s.rest = t.rest AND s.i = t.i AND s.word <> t.word),
best AS (
  SELECT a.word, a.n, coalesce(k, 0) AS n_near, CASE WHEN top.n >= 5 * a.n THEN top.other END AS form, CASE WHEN top.n >= 5 * a.n THEN top.n END AS form_n
  FROM words a LEFT JOIN (
    SELECT e.word, count(*) AS k, arg_min({'other': e.other, 'n': w.n}, {'less': -w.n, 'other': e.other}) AS top
    FROM near e JOIN words w ON e.other = w.word GROUP BY e.word) USING (word)),
way(word, last) AS (
  SELECT word, form FROM best WHERE form IS NOT NULL
  UNION ALL SELECT way.word, best.form FROM way JOIN best ON way.last = best.word WHERE best.form IS NOT NULL)
SELECT b.word, b.form, coalesce(w.last, b.word) AS root, b.n, b.n_near, b.form_n
FROM best b LEFT JOIN (SELECT way.word, way.last FROM way JOIN best ON way.last = best.word WHERE best.form IS NULL) w ON b.word = w.word
"""
