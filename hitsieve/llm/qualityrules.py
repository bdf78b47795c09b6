"""Quality rules: base counts, and the divergence of a document's histograms from those of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hitsieve.llm.common import store, table, text_of
from hitsieve.llm.wordhash import IS_BLANK, bounds, pieces, span_hashes, windows

# Frequent function words of four languages; other languages are judged by the same list.
COMMON = {
    "en": "the of and to a in is it that for was on are as with his they at be this from or had by not but what all were we",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas sur au ne se ce il sont avec son ou elle",
    "de": "der die und in den von zu das mit sich des auf im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
CLASSES = ("lower", "upper", "digit", "blank", "stop", "sign", "other")
MIN_WORDS, MIN_CHARS = 50, 200  # shorter documents are not judged by their histograms
MAX_CHAR_JS = 0.085  # in bits; clean documents of the given tables stay below 0.075
MAX_WORD_JS, WORD_NOISE = 0.05, 8.0  # bound of a long text in bits, and what is added to it over the number of words
RUN, MOST_REPEATED, LEAST_WORDS = 5, 20, 10

_CLASS = np.full(256, 6, np.int64)
_CLASS[128:192] = 7  # continuation bytes are no characters of their own
_CLASS[32:127] = 5
_CLASS[IS_BLANK] = 3
_CLASS[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    joined = " ".join(WORDS).encode()
    piece = np.frombuffer(joined, np.uint8)
    found = span_hashes(piece, *bounds(piece))
    order = np.argsort(found)
    return found[order], order


_HASHES, _PLACES = _common_hashes()


def describe(text: str) -> tuple:
    """Base counts and both histograms of a whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    chars, symbols, words, common = np.zeros(8, np.int64), 0, [], np.zeros(len(WORDS) + 1, np.int64)
    for piece in pieces(data):
        chars += np.bincount(_CLASS[piece], minlength=8)
        symbols += int(_SYMBOL[piece].sum())
        found = span_hashes(piece, *bounds(piece))
        spot = np.minimum(np.searchsorted(_HASHES, found), len(_HASHES) - 1)
        known = _HASHES[spot] == found
        common[:-1] += np.bincount(_PLACES[spot[known]], minlength=len(WORDS))
        common[-1] += len(found) - int(known.sum())
        words.append(found)
    hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return (len(hashes), int(chars[:7].sum() - chars[3]), symbols, again, repeated_words(hashes), chars[:7].tolist(), common.tolist())


def repeated_words(hashes: np.ndarray, run: int = RUN) -> int:
    """Words that stand in a run which the text holds twice or more, the first time included."""
    if len(hashes) <= run:
        return 0
    found = windows(hashes, run)
    order = np.argsort(found, kind="stable")
    same = np.concatenate(([False], found[order][1:] == found[order][:-1], [False]))
    twice = order[same[:-1] | same[1:]]
    step = np.zeros(len(hashes) + 1, np.int32)
    step[twice] += 1
    step[twice + run] -= 1
    # runs that begin at one place and end at another may meet, so the ends are summed and not set
    return int((np.cumsum(step)[:-1] > 0).sum())


class _Describe:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t.as_py()) for t in batch.column("_text")]
            columns = list(zip(*found)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"])


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of histograms of the same cells, row by row; 0 where one of the two is empty."""
    full = (counts.sum(-1, keepdims=True) > 0) & (reference.sum(-1, keepdims=True) > 0)
    p, q = (np.where(full, x, 1.0) / np.where(full, x, 1.0).sum(-1, keepdims=True) for x in (counts, reference))
    m = (p + q) / 2
    part = [np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0) / np.where(m > 0, m, 1.0)), 0.0).sum(-1) for x in (p, q)]
    return np.where(full[..., 0], (part[0] + part[1]) / 2, 0.0)


@F.arrow_udf(T.DoubleType())
def _divergence(counts: pa.Array, reference: pa.Array) -> pa.Array:
    there = pc.is_valid(reference)
    matrix = lambda lists: lists.filter(there).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(there.true_count, -1)
    out = np.zeros(len(counts))
    if there.true_count:
        out[there.to_numpy(zero_copy_only=False)] = divergence(matrix(counts), matrix(reference))
    return pa.array(out)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, divergences, `base_failed` and `kept` for each row of `docs(doc_id, text, lang)`.

    The reference of a language is the sum of the histograms of all its documents that pass the base rules. A
    document fails when it has MIN_WORDS words and MIN_CHARS characters or more and one of its divergences is above its
    bound. The share of a common word in n words strays by chance, and the divergence of a clean text with it by about
    1 / n a word, so the bound of words is MAX_WORD_JS + WORD_NOISE / n. Null and empty texts have no words and fail the base rules; a null lang is a language of its own; repeated
    rows are judged each; an empty table gives an empty one.
    """
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text_of().alias("_text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_words long, word_chars long, n_symbols long, " \
           "n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = store(read.mapInArrow(_Describe(), kind).withColumn("base_failed", failed), "described")
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))).cast("double") for i in range(n)])
    reference = store(found.where("not base_failed").groupBy("lang").agg(
        sums("chars", len(CLASSES)).alias("_chars"), sums("common", len(WORDS) + 1).alias("_common")), "reference")
    joined = found.join(reference, "lang", "left")
    rated = joined.withColumns({"char_js": _divergence("chars", "_chars"), "word_js": _divergence("common", "_common")})
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= MIN_CHARS)
    odd = judged & (F.coalesce(F.col("char_js") > MAX_CHAR_JS, F.lit(False)) | F.coalesce(F.col("word_js") > MAX_WORD_JS + WORD_NOISE / F.col("n_words"), F.lit(False)))
    return rated.withColumn("kept", ~F.col("base_failed") & ~odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_js", "word_js")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("char_js", "word_js")


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


BLANK_SQL = r"[\x20\x09-\x0D]"
OP8_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times
         FROM (SELECT rid, i, w[i:i + {RUN - 1}] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {RUN - 2})) AS i FROM docs))),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {RUN})) AS p FROM runs WHERE times > 1) GROUP BY rid),
dups AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, lang, w, len(w) AS n_words, length(t) AS size,
    length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lower, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper,
    length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit, length(t) - length(regexp_replace(t, '{BLANK_SQL}', '', 'g')) AS blank,
    length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')) AS stop,
    length(t) - length(regexp_replace(t, '[\x21-\x7E]', '', 'g')) AS plain,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN dups USING (rid) LEFT JOIN again USING (rid)),
base AS (SELECT *, size - blank AS word_chars, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted),
cells AS (
  SELECT rid, 'chars' AS kind, unnest(['lower', 'upper', 'digit', 'blank', 'stop', 'sign', 'other']) AS cell,
         unnest([lower, upper, digit, blank, stop, plain - lower - upper - digit - stop, size - plain - blank]) AS c FROM base
  UNION ALL
  SELECT rid, 'words', cell, count(*) FROM (SELECT rid, CASE WHEN x IN ({_sql_list(WORDS)}) THEN x ELSE '' END AS cell
    FROM (SELECT rid, unnest(w) AS x FROM base)) GROUP BY rid, cell),
shares AS (SELECT rid, kind, cell, c / sum(c) OVER (PARTITION BY rid, kind) AS p FROM cells WHERE c > 0),
ref AS (SELECT lang, kind, cell, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q
        FROM cells JOIN base USING (rid) WHERE NOT base_failed AND c > 0 GROUP BY lang, kind, cell),
wanted AS (SELECT rid, r.kind, r.cell, r.q FROM base JOIN ref r USING (lang)),
pairs AS (SELECT coalesce(s.rid, w.rid) AS rid, coalesce(s.kind, w.kind) AS kind, coalesce(p, 0) AS p, coalesce(q, 0) AS q
          FROM shares s FULL JOIN wanted w ON s.rid = w.rid AND s.kind = w.kind AND s.cell = w.cell),
js AS (SELECT rid, kind, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS d,
              sum(p) > 0 AND sum(q) > 0 AS filled FROM pairs GROUP BY rid, kind),
odd AS (SELECT rid FROM js JOIN base USING (rid) WHERE filled AND d > CASE kind WHEN 'chars' THEN {MAX_CHAR_JS}::DOUBLE
                                        ELSE {MAX_WORD_JS}::DOUBLE + {WORD_NOISE}::DOUBLE / n_words END GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND word_chars >= {MIN_CHARS} AND rid IN (SELECT rid FROM odd)) AS kept
FROM base
"""
