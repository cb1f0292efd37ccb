"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose measure exceeds its cutoff. The cutoffs of all rules form levels from lenient to strict,
and a level rejects what any of its rules rejects. Labelled good documents are the holdout: for a stratum (language) and a
level, the number of good documents that it would reject is binomial. A level is accepted if the exact binomial bound proves,
at the stratum's share of DELTA, that at most ALPHA of the stratum's good documents are rejected by all rules together.
Levels are tested from lenient to strict until the first one fails (a fixed sequence, which needs no correction between
them); between strata DELTA is divided (Bonferroni). The strictest accepted level holds in the stratum. Every stratum of the
holdout is tested; a stratum that has proven no level, or has no holdout, rejects by the base test only.

So with a confidence of 1 - DELTA no stratum loses more than ALPHA of its good documents, as far as the labelled ones are
independent draws: each doc_id counts once, but near copies among them make the holdout count for more than it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Most false rejections among a stratum's good documents, and the chance that any proof is wrong.
ALPHA, DELTA = 0.03, 0.05
#: For each rule its measure and its cutoff at each level, from lenient to strict.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.5, 0.45, 0.4, 0.35, 0.3, 0.3)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.3)),
    "upper": ("n_upper / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
}
LEVELS = 6
#: Strata whose levels are broadcast, at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000
SPACES = r"\\x20\\x09-\\x0D"
_POSITION = 24  # bits for a word's place in its document, below the bits of a window's hash
_MEASURES, _ROW = "__folioflow_measures", "__folioflow_row"


def with_measures(docs: DataFrame, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows with all their columns and a struct of measures: stratum, counts of the whole text (a null one has no words),
    base_failed, and `rejecting`, the first level that rejects the document (from 1, null if none does).

    Windows of three words are compared by hash with their place in one sorted array, and neighbours with equal hashes
    word by word; a text of over 2^24 words is compared by its windows themselves.
    """
    d = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(_ROW), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(
        _ROW,
        "stratum",
        F.expr(f"regexp_extract_all(text, '[^{SPACES}]+', 0)").alias("words"),
        F.expr(f"filter(split(text, '\\n'), x -> x rlike '[^{SPACES}]')").alias("lines"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("regexp_count(text, '\\\\p{Lu}')").cast("long").alias("n_upper"),
    )
    d = d.select("*", F.size("words").cast("long").alias("n_words"))
    hashed = f"transform(sequence(0, size(words) - 3), i -> shiftleft(shiftrightunsigned(xxhash64(words[i], words[i + 1], words[i + 2]), {_POSITION + 1}), {_POSITION}) | i)"
    d = d.select("*", F.expr(f"case when size(words) between 3 and {(1 << _POSITION) - 1} then sort_array({hashed}) else cast(array() as array<bigint>) end").alias("windows"))
    place, head = "cast(windows[{0}] & 16777215L as int)", f"shiftright(windows[{{0}}], {_POSITION})"
    same = lambda a, b: f"({head.format(a)} = {head.format(b)} and words[{place.format(a)}] = words[{place.format(b)}] and words[{place.format(a)} + 1] = words[{place.format(b)} + 1] and words[{place.format(a)} + 2] = words[{place.format(b)} + 2])"
    twice = f"filter(sequence(0, size(windows) - 1), k -> (k > 0 and {same('k', 'k - 1')}) or (k < size(windows) - 1 and {same('k', 'k + 1')}))"
    d = d.select("*", F.expr(f"case when size(windows) < 2 then cast(array() as array<int>) else transform({twice}, k -> {place.format('k')}) end").alias("found"))
    grams = "transform(sequence(0, size(words) - 3), i -> struct(words[i] as a, words[i + 1] as b, words[i + 2] as c, i as i))"
    longest = f"case when size(words) >= {1 << _POSITION} then sort_array({grams}) end"
    d = d.select("*", F.expr(longest).alias("grams"))
    equal = "(grams[{0}].a = grams[{1}].a and grams[{0}].b = grams[{1}].b and grams[{0}].c = grams[{1}].c)"
    slow = f"transform(filter(sequence(0, size(grams) - 1), k -> (k > 0 and {equal.format('k', 'k - 1')}) or (k < size(grams) - 1 and {equal.format('k', 'k + 1')})), k -> grams[k].i)"
    d = d.select(
        _ROW,
        "stratum",
        "n_words",
        F.expr("aggregate(words, 0L, (s, w) -> s + length(w))").alias("word_chars"),
        "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(f"cast(size(array_distinct(flatten(transform(case when grams is null then found else {slow} end, p -> array(p, p + 1, p + 2))))) as bigint)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
    )
    first = (f"nullif(array_position(transform(array({', '.join(f'{c}D' for c in cs)}), c -> {m} > c), true), 0)" for m, cs in RULES.values())
    measures = ("stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejecting")
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumn("rejecting", F.expr(f"least({', '.join(first)})"))
    return d.select(f"{_ROW}.*", F.struct(*measures).alias(_MEASURES))


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id and the measures of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    return with_measures(rows).select("doc_id", f"{_MEASURES}.*")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly, summed as logarithms; k at or above n * p gives 1."""
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(math.log(p / (1 - p)))
        top = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(F.when(k < n * p, steps), start, add, lambda s: F.exp(s["sum"])))


def proven_levels(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, levels: int = LEVELS) -> DataFrame:
    """stratum and level (the strictest one proven, 0: none) of each stratum of the holdout.

    measured has doc_id, stratum, base_failed and rejecting. The holdout are documents whose labels all have quality 1 and
    whose base test did not fail; an id counts once in a stratum.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1").select("doc_id")
    held = measured.where(~F.col("base_failed")).select("doc_id", "stratum", "rejecting").join(good, "doc_id", "left_semi")
    held = held.groupBy("doc_id", "stratum").agg(F.min("rejecting").alias("rejecting"))
    rejected = F.array(*(F.count_if(F.col("rejecting") <= i) for i in range(1, levels + 1)))
    counts = stored(held.groupBy("stratum").agg(F.count("*").alias("n"), rejected.alias("rejected")))  # a row for each stratum
    share = delta / max(1, counts.count())
    failed = F.array_position(F.transform("rejected", lambda k: binomial_tail(F.col("n"), k, alpha) > share), True)
    found = stored(counts.select("stratum", F.when(failed == 0, levels).otherwise(failed - 1).cast("int").alias("level")))
    drop_stored(counts)
    return found


def _judged(measured: DataFrame, levels: DataFrame) -> DataFrame:
    """The rows with `kept`, for columns stratum, base_failed and rejecting; levels is a stored table."""
    if levels.count() <= MOST_BROADCAST:
        levels = F.broadcast(levels)
    rejected = F.coalesce(F.col("rejecting") <= F.col("level"), F.lit(False))
    return measured.join(levels, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts and verdict of every document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. One row for each row,
    with equal or null ids too; labels that are null, contradict each other or are of unknown documents are not used.
    Without labels no rule rejects, only the base test does. An empty or null text has no words, so its base test fails.
    """
    measured = stored(base_measures(docs, id_col, text_col, stratum_col))
    judged = _judged(measured, proven_levels(measured, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The rows are written once with their measures, so that neither texts are shuffled nor measures taken twice.
    """
    rows = stored(with_measures(docs, text_col, stratum_col))
    measured = rows.select(F.col(id_col).cast("long").alias("doc_id"), f"{_MEASURES}.*")
    levels = proven_levels(measured, labels)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(_ROW)
    return _judged(rows.select(own, f"{_MEASURES}.*"), levels).where("kept").select(f"{_ROW}.*")
