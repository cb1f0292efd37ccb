"""Text functions as Column expressions, shared by batch and streaming jobs.

White space is the ASCII white space of regular expressions; lengths and cuts count code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, words that are never keywords, and the forms of dates.
MONTHS = "january february march april may june july august september october november december".split()
STOP_WORDS = (
    "the a an of and or to in for on with is are was were be been this that these those it its our we they their by as at from which used use using"
).split()
DATE_FORMS = [
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{4}\b",
    r"\b[A-Z][a-z]{2}-\d{2}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"\b\d{1,2}/\d{4}\b",
]
NUMBERING = r"^\s*(?:\d+(?:\.\d+)*|[IVX]+|\([a-z]\)|[A-Z]\.)\s+"

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Text) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def tokens(text: Text) -> Column:
    """Pieces of text that each play one token: a run of non-space with the white space before it."""
    return F.regexp_extract_all(_c(text), F.lit(r"\s*\S+"), F.lit(0))


def count_tokens(text: Text) -> Column:
    return F.size(tokens(text))


def truncate_tokens(text: Text, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), "")


def normalize_title(title: Text) -> Column:
    """Lower case without leading section numbers."""
    return F.lower(strip(F.regexp_replace(F.coalesce(_c(title), F.lit("")), NUMBERING, "")))


def summary(text: Text, sentences: int = 2, chars: int = 280) -> Column:
    """The first sentences with single spaces, cut."""
    clean = strip(F.regexp_replace(_c(text), r"\s+", " "))
    return F.substring(F.array_join(F.slice(F.split(clean, r"(?<=[.!?])\s+"), 1, sentences), " "), 1, chars)


def words_for_keywords(text: Text) -> Column:
    """Words of four letters or more that are no stop words, in lower case, with repeats."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[A-Za-z][A-Za-z\-']+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or its first three letters, else null."""
    known = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)], *[F.lit(x) for i, m in enumerate(MONTHS) if m != "may" for x in (m[:3], i + 1)])
    return F.try_element_at(known, F.lower(name))


def parse_date(text: Text) -> Column:
    """struct(y, m, d) of the first form that fits: Month YYYY, Mon-YY, YYYY-M-D, M/YYYY; null if none does."""
    t = strip(text)
    part = lambda form, i: F.regexp_extract(t, form, i)
    day = lambda y, m, d: F.struct(y.try_cast("int").alias("y"), m.try_cast("int").alias("m"), d.try_cast("int").alias("d"))
    a, b, c, e = r"(\w+)\s+(\d{4})", r"([A-Z][a-z]{2})-(\d{2})", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})/(\d{4})"
    by_name, by_short = month_number(part(a, 1)), month_number(part(b, 1))
    return (
        F.when(by_name.isNotNull(), day(part(a, 2), by_name, F.lit(1)))
        .when(by_short.isNotNull(), day(F.concat(F.lit("20"), part(b, 2)), by_short, F.lit(1)))
        .when(part(c, 1) != "", day(part(c, 1), part(c, 2), part(c, 3)))
        .when(part(e, 1) != "", day(part(e, 2), part(e, 1), F.lit(1)))
    )


def dates_in(text: Text) -> Column:
    """All dates of a text, form by form."""
    found = F.flatten(F.array(*[F.regexp_extract_all(_c(text), F.lit("(?i)" + f), F.lit(0)) for f in DATE_FORMS]))
    return F.filter(F.transform(found, parse_date), lambda d: d.isNotNull())


def date_variants(text: Text) -> Column:
    """The date and its other spellings, in order and without repeats."""
    t = _c(text)
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    short = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3].capitalize(), i + 1)])
    name = lambda n: F.try_element_at(F.array(*map(F.lit, MONTHS)), n)
    brief = lambda n: F.initcap(F.substring(name(n), 1, 3))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    none = F.array().cast("array<string>")
    a, b, e = r"(\w+)\s+(\d{4})", r"([A-Z][a-z]{2})-(\d{2})", r"(\d{1,2})/(\d{4})"
    n1, y1 = F.try_element_at(month, F.lower(F.regexp_extract(t, a, 1))), F.regexp_extract(t, a, 2)
    n2, y2 = F.try_element_at(short, F.regexp_extract(t, b, 1)), F.regexp_extract(t, b, 2)
    n3, y3 = F.regexp_extract(t, e, 1).try_cast("int"), F.regexp_extract(t, e, 2)
    first = F.array(F.concat(brief(n1), F.lit("-"), F.right(y1, F.lit(2))), F.concat_ws(" ", brief(n1), y1), F.concat_ws("/", two(n1), y1), F.concat(two(n1), F.lit("-"), F.right(y1, F.lit(2))))
    second = F.array(F.concat(name(n2), F.lit(" 20"), y2), F.concat(brief(n2), F.lit(" 20"), y2), F.concat(two(n2), F.lit("/20"), y2))
    third = F.array(F.concat_ws(" ", name(n3), y3), F.concat(brief(n3), F.lit("-"), F.right(y3, F.lit(2))), F.concat_ws(" ", brief(n3), y3))
    return F.array_distinct(
        F.concat(F.array(t), F.when(n1.isNotNull(), first).otherwise(none), F.when(n2.isNotNull(), second).otherwise(none), F.when(n3.between(1, 12), third).otherwise(none))
    )


def query_variants(text: Text) -> Column:
    """The query, and the query with each of its dates in each other spelling."""
    t = _c(text)
    forms = ["(?i)" + DATE_FORMS[0], DATE_FORMS[1], DATE_FORMS[3]]
    dates = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f), F.lit(0)) for f in forms]))
    swapped = F.flatten(F.transform(dates, lambda d: F.transform(F.filter(date_variants(d), lambda v: v != d), lambda v: F.replace(t, d, v))))
    return F.array_distinct(F.concat(F.array(t), swapped))


def printable_ratio(text: Text) -> Column:
    """Share of printable characters; 1 for an empty text."""
    t = _c(text)
    return F.when(F.length(t) == 0, F.lit(1.0)).otherwise(F.length(printable(t)) / F.length(t))


def printable(text: Text) -> Column:
    return F.regexp_replace(_c(text), r"[\p{C}\p{Z}&&[^ ]]", "")


def suspicious_repeats(text: Text) -> Column:
    """Runs of ten equal characters, at most two different ones among eight, or one word for half of twelve."""
    t = _c(text)
    dense = F.regexp_replace(t, r"\s+", "")
    words = F.regexp_extract_all(t, F.lit(r"(?U)\b\w{3,}\b"), F.lit(0))
    # The most frequent word stands in the longest run of equal neighbours of the sorted words.
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["word"] == w, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    best = F.aggregate(F.array_sort(words), start, step, lambda s: s["best"])
    return F.coalesce(
        t.rlike(r"(\S)\1{9,}") | ((F.length(dense) >= 8) & (F.size(F.array_distinct(F.split(dense, ""))) <= 2)) | ((F.size(words) >= 12) & (best >= 0.5 * F.size(words))),
        F.lit(False),
    )


def lenient_json(raw: Text) -> Column:
    """The outermost object, else array, of a model's answer without code fences; null if it doesn't parse."""
    t = strip(F.regexp_replace(strip(raw), r"(?im)^```(?:json)?\s*|\s*```$", ""))
    shapes = [F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), F.nullif(F.regexp_extract(t, r"(?s)\[.*\]", 0), F.lit("")), t]
    return F.coalesce(*[F.to_json(F.try_parse_json(s)) for s in shapes])


def caption(raw: Text) -> Column:
    """struct(caption, description): of a JSON object, else the first line and the rest; empty for other JSON."""
    j = lenient_json(raw)
    lines = F.filter(F.transform(F.split(strip(raw), "\n"), strip), lambda x: x != "")
    of = lambda c, d: F.struct(F.coalesce(c, F.lit("")).alias("caption"), F.coalesce(d, F.lit("")).alias("description"))
    return (
        F.when(j.startswith("{"), of(strip(F.get_json_object(j, "$.caption")), strip(F.get_json_object(j, "$.description"))))
        .when(j.isNotNull(), of(F.lit(None), F.lit(None)))
        .otherwise(of(F.get(lines, F.lit(0)), F.array_join(F.slice(lines, 2, 10_000), " ")))
    )


def task_prefix(text: Text, kind: str, needed: bool = True) -> Column:
    return F.concat(F.lit(f"search_{kind}: "), _c(text)) if needed else _c(text)


_ASCII_WORD = re.compile("[a-z0-9]+")


@lru_cache(1 << 18)
def _spot(word: str) -> int:
    """The first six hex digits of a word's md5; a worker keeps those of short words, which come again."""
    return int(hashlib.md5(word.encode()).hexdigest()[:6], 16)


def hash_embedding(text: Text, buckets: int = 256) -> Column:
    """Unit vector of a text's distinct words, each in a bucket by its md5: a stand-in for a model."""

    def run(texts: pa.Array) -> pa.Array:
        words = [set(_ASCII_WORD.findall(s)) if s is not None else () for s in texts.to_pylist()]
        spots = np.fromiter((_spot(w) if len(w) <= 64 else _spot.__wrapped__(w) for ws in words for w in ws), np.int64) % buckets
        row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        n = np.bincount(row * buckets + spots, minlength=len(words) * buckets).astype(float).reshape(-1, buckets)
        size = np.sqrt((n * n).sum(1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * buckets, pa.int32()), (n / np.where(size > 0, size, 1)).ravel())

    return F.arrow_udf(run, "array<double>")(F.lower(_c(text)))


def passage(display: Text, embedding: Text, chars: int = 8000) -> Column:
    """The text of a hit that a pair scorer reads."""
    best = F.substring(strip(F.coalesce(F.nullif(_c(display), F.lit("")), _c(embedding), F.lit(""))), 1, chars)
    return F.when(best == "", F.lit(" ")).otherwise(best)


def event_key(delivery: Text, kind: Text, subject: Text, ts: Text) -> Column:
    """msg:<delivery>, or type:subject:timestamp."""
    own = F.concat_ws(":", F.coalesce(_c(kind), F.lit("unknown")), F.coalesce(_c(subject), F.lit("unknown")), F.coalesce(_c(ts), F.lit("0")))
    return F.when(F.coalesce(_c(delivery), F.lit("")) != "", F.concat(F.lit("msg:"), _c(delivery))).otherwise(own)


def retry_delay(attempt: Text, base: int = 60) -> Column:
    """Seconds to the next attempt: the base, doubled for each attempt made before."""
    return (F.lit(base) * F.pow(F.lit(2), F.greatest(_c(attempt) - 1, F.lit(0)))).cast("long")
