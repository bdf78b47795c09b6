"""Text features as native expressions: tokens, fragments, descriptors, fingerprints, group keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hitsieve.functions.scalar import hash32
from hitsieve.schemas import FP_BITS, Rule

BLANKS = "[ \t\n\r]+"
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOWELS = "aeiouAEIOU"
PUNCT = ".,;:!?'\"()-"
SYMBOLS = "#|*<>{}[]=/\\_@$%&+~^`"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def tokens(text: Column) -> Column:
    """Blank-separated tokens; NULL or blank text has none."""
    parts = F.filter(F.split(text, BLANKS), lambda t: t != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    The optimizer copies a projected expression into every filter and lambda that mentions it, which repeats
    costly array work. A generator over a one-element array gives the same row and is never copied.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def largest_fragment(text: Column, separator: str = r"\.") -> Column:
    """Longest piece between separators, blanks squeezed, lower case; the first of equals; NULL when empty."""
    sized = F.transform(F.split(text, separator), lambda x, i: _sized(F.lower(squeeze(x)), i))
    best = F.array_max(sized)
    return F.nullif(best["text"], F.lit(""))


def _sized(piece: Column, i: Column) -> Column:
    return F.struct(F.length(piece).alias("size"), (-i).alias("place"), piece.alias("text"))


# Named descriptors over a row that carries `text`, `_norm` (blanks squeezed) and `_tok` (tokens).
DESCRIPTORS: dict[str, Callable[[], Column]] = {
    "n_chars": lambda: F.length("_norm").cast("double"),
    "n_tokens": lambda: F.size("_tok").cast("double"),
    "n_unique": lambda: F.size(F.array_distinct("_tok")).cast("double"),
    "unique_ratio": lambda: _ratio(F.size(F.array_distinct("_tok")), F.size("_tok")),
    "mean_token": lambda: _ratio(F.length("_norm") - F.size("_tok") + 1, F.size("_tok")),
    "digit_ratio": lambda: _ratio(count_of(F.col("_norm"), DIGITS), F.length("_norm")),
    "upper_ratio": lambda: _ratio(count_of(F.col("_norm"), UPPER), F.length("_norm")),
    "vowel_ratio": lambda: _ratio(count_of(F.col("_norm"), VOWELS), F.length("_norm")),
    "punct_ratio": lambda: _ratio(count_of(F.col("_norm"), PUNCT), F.length("_norm")),
    "symbol_ratio": lambda: _ratio(count_of(F.col("_norm"), SYMBOLS), F.length("_norm")),
    "n_lines": lambda: (count_of(F.col("_text"), "\n") + 1).cast("double"),
    "line_length": lambda: _ratio(F.length("_text"), count_of(F.col("_text"), "\n") + 1),
}


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def register_descriptor(name: str, build: Callable[[], Column]) -> None:
    """Adds a descriptor; the expression may use `_text`, `_norm` and `_tok`."""
    DESCRIPTORS[name] = build


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    text_ = F.coalesce(F.col(text), F.lit(""))
    return bind(bind(df, _text=text_, _tok=tokens(text_)), _norm=F.array_join("_tok", " "))


def with_descriptors(df: DataFrame, names: Sequence[str], text: str = "text", keep_tokens: bool = False) -> DataFrame:
    """One double column per name; a descriptor that cannot be computed is NULL; unknown names raise."""
    unknown = [n for n in names if n not in DESCRIPTORS]
    if unknown:
        raise ValueError(f"unknown descriptors: {unknown}")
    out = with_tokens(df, text).withColumns({n: DESCRIPTORS[n]() for n in names})
    return out if keep_tokens else out.drop("_text", "_norm", "_tok")


def shingles(tok: Column, radius: int = 2) -> Column:
    """All runs of 1..radius+1 consecutive tokens, joined by a blank."""
    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(tok) - k, F.lit(0)))
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tok, i + j) for j in range(k)]))
        return F.when(F.size(tok) >= k, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(tok, *[runs(k) for k in range(2, radius + 2)])


def set_bits(tok: Column, radius: int = 2, n_bits: int = FP_BITS, portable: bool = True) -> Column:
    """Hashed presence fingerprint as the sorted positions of the set bits.

    The portable hash (md5) gives the same bits on every engine; the other one (xxhash64) is several times cheaper.
    Training and scoring must use the same.
    """
    pieces = F.array_distinct(shingles(tok, radius))
    hashed = hash32 if portable else F.xxhash64
    return F.sort_array(F.array_distinct(F.transform(pieces, lambda s: F.pmod(hashed(s), F.lit(n_bits)).cast("int"))))


def _run_bits(radius: int, n_bits: int):
    """`set_bits` of a lower-case text's tokens with the portable hash, in batches: a lambda of Spark is interpreted for each run."""
    blanks = bytes.maketrans(b"\t\n\r", b"   ")

    @F.arrow_udf("array<int>")
    def bits(texts: pa.Array) -> pa.Array:
        try:  # the plain module starts a digest in half the time
            from _md5 import md5
        except ImportError:
            from hashlib import md5
        out = []
        for text in texts:
            words = [w for w in (text.as_py() or "").encode().translate(blanks).split(b" ") if w]
            runs = set(words)
            for k in range(2, radius + 2):
                runs.update(map(b" ".join, zip(*[words[i:] for i in range(k)])))
            first = np.frombuffer(b"".join([md5(r).digest() for r in runs]), ">u4")[::4]
            out.append(np.unique(first % n_bits).astype(np.int32))
        ends = np.concatenate(([0], np.cumsum([len(b) for b in out]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))

    return bits


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "bits", radius: int = 2,
                     n_bits: int = FP_BITS, tok: str | None = None, portable: bool = True) -> DataFrame:
    """Fingerprint column; rows without text get no bits, so they can be kept (training) or dropped (library).

    `tok` names a column with the tokens of the text, where they are already there.
    """
    if portable and not tok:
        return bind(df.withColumn("_runs", _run_bits(radius, n_bits)(F.lower(F.col(text)))), **{out: F.col("_runs")}).drop("_runs")
    words = F.col(tok) if tok else tokens(F.col(text))
    low = bind(df, _tk=F.transform(words, F.lower))
    return bind(low, **{out: set_bits(F.col("_tk"), radius, n_bits, portable)}).drop("_tk")


def with_template_key(df: DataFrame, text: str = "text", out: str = "key", n: int = 3) -> DataFrame:
    """Structural key of the whole text: the smallest md5 over its runs of n tokens, lower case, digits masked.

    Copies share their key, and near copies share it as often as they share runs, wherever they differ; texts with a
    common start do not. Missing and blank texts have the key ''; a text of fewer tokens is one run.
    """
    return bind(df.withColumn("_least", _least_run(n)(F.regexp_replace(F.lower(F.col(text)), "[0-9]+", "#"))), **{out: F.col("_least")}).drop("_least")


def _least_run(n: int):
    """The smallest md5 over the runs of n tokens, in batches like `_run_bits`; '' without tokens."""
    blanks = bytes.maketrans(b"\t\n\r", b"   ")

    @F.arrow_udf("string")
    def least(texts: pa.Array) -> pa.Array:
        try:
            from _md5 import md5
        except ImportError:
            from hashlib import md5
        out = []
        for text in texts:
            words = [w for w in (text.as_py() or "").encode().translate(blanks).split(b" ") if w]
            runs = set(map(b" ".join, zip(*[words[i:] for i in range(n)]))) if len(words) > n else {b" ".join(words)}
            out.append(min(md5(r).digest() for r in runs).hex() if words else "")
        return pa.array(out, pa.string())

    return least


def rule_filter(rules: Sequence[Rule]) -> Column:
    """Conjunction of closed ranges as a filter: plain comparisons, so they reach a Parquet scan; NULL fails."""
    cond = F.lit(True)
    for r in rules:
        c = F.col(r.column)
        if r.lo is not None:
            cond = cond & (c >= F.lit(r.lo))
        if r.hi is not None:
            cond = cond & (c <= F.lit(r.hi))
    return cond


def rule_flag(rules: Sequence[Rule]) -> Column:
    return F.coalesce(rule_filter(rules), F.lit(False))


def symbols_allowed(symbols: Column, allowed: Sequence[str]) -> Column:
    return F.size(F.array_except(symbols, F.array(*[F.lit(a) for a in allowed]))) == 0


def catalogue_match(text: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern of the catalogue occurs; one alternation, one pass over the text."""
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def desirability(value: Column, center: float, width: float, rising: bool = True) -> Column:
    """Logistic desirability in (0, 1)."""
    z = (value - F.lit(center)) / F.lit(width)
    return 1.0 / (1.0 + F.exp(-z if rising else z))


def weighted_geometric_mean(parts: Sequence[tuple[float, Column]]) -> Column:
    total = sum(w for w, _ in parts)
    acc = F.lit(0.0)
    for w, d in parts:
        acc = acc + F.lit(w) * F.log(d)
    return F.exp(acc / F.lit(total))
