"""Pipe tables (Markdown text) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, _c, strip

SEPARATORS = ["", "---", "---:", ":---", ":---:"]
#: Cells that look like data: thousands with spaces, decimals, placeholders. A fixed value.
DATA_CELL = r"(?U)^\s*(?:\d{1,3}(?:\s\d{3})+|\d+\.\d+|[.]{2,})\s*$"


def lines(markdown: Text) -> Column:
    return F.split(strip(markdown), "\n")


def cells(line: Column) -> Column:
    """The cells of a pipe row, between its first and its last bar."""
    parts = F.split(line, r"\|")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), strip)


def pipe_lines(markdown: Text) -> Column:
    return F.filter(lines(markdown), lambda x: x.startswith("|"))


def data_rows(markdown: Text) -> Column:
    """Rows without header and separator; 0 if there are fewer than two pipe rows."""
    n = F.size(pipe_lines(markdown))
    return F.when(n < 2, F.lit(0)).otherwise(n - 2)


def columns(markdown: Text) -> Column:
    p = pipe_lines(markdown)
    return F.when(F.size(p) < 2, F.lit(0)).otherwise(F.greatest(F.size(F.split(F.get(p, F.lit(0)), r"\|")) - 2, F.lit(0)))


def header_tokens(markdown: Text) -> Column:
    """Distinct words of the first row that is no separator, in lower case and without punctuation around them."""
    first = F.get(F.filter(pipe_lines(markdown), lambda x: ~F.forall(cells(x), lambda c: c.isin(SEPARATORS))), F.lit(0))
    words = F.flatten(F.transform(cells(first), lambda c: F.split(F.lower(c), r"\s+")))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}%$]+|[.,;:()\[\]{}%$]+$", ""))
    return F.coalesce(F.array_distinct(F.filter(bare, lambda w: w != "")), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def append_rows(base: Text, more: Text) -> Column:
    """The base table with the other's rows but for its header and separator."""
    extra = F.slice(pipe_lines(more), 3, 1_000_000)
    return F.when(F.size(extra) > 0, F.concat(strip(base), F.lit("\n"), F.array_join(extra, "\n"))).otherwise(_c(base))


def from_rows(rows: Column) -> Column:
    """A pipe table of rows of cells, the first one as header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, 1_000_000), line)), "\n")


def describe_snippet(markdown: Text, lo: Column, hi: Column, rows: int = 5) -> Column:
    """Row and page comments, then the table, or its header with its first and last rows."""
    ls = lines(markdown)
    pages = F.when(hi > lo, F.concat(F.lit("<!-- pages "), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit(" -->"))).otherwise(F.concat(F.lit("<!-- page "), lo.cast("string"), F.lit(" -->")))
    head = F.concat(F.lit("<!-- total rows incl. header+sep: "), F.size(ls).cast("string"), F.lit(" -->\n"), pages, F.lit("\n"))
    short = F.concat(F.array_join(F.slice(ls, 1, 2 + rows), "\n"), F.lit("\n...\n"), F.array_join(F.slice(ls, -rows, rows), "\n"))
    return F.concat(head, F.when(F.size(ls) <= 2 + 2 * rows, _c(markdown)).otherwise(short))


def descriptor(markdown: Text, most: int = 25) -> Column:
    """"Key indicators: " and the table's distinct row labels, first spellings first; empty without labels."""
    wide = F.filter(F.transform(pipe_lines(markdown), cells), lambda c: (F.size(c) >= 2) & F.exists(c, lambda x: F.regexp_replace(x, "[-: ]", "") != ""))
    labels = F.filter(F.transform(wide, lambda c: F.coalesce(F.nullif(c[1], F.lit("")), c[0])), lambda x: (F.length(x) >= 5) & ~F.lower(x).isin("description", "indicator", "indicator code", "code"))

    def added(kept: Column, label: Column) -> Column:
        # A fold that holds the kept labels only, so that its time grows with the rows.
        new = (F.size(kept) < most) & ~F.exists(kept, lambda x: F.lower(x) == F.lower(label))
        return F.when(new, F.array_append(kept, label)).otherwise(kept)

    first = F.aggregate(labels, F.array().cast("array<string>"), added)
    kept = F.transform(first, lambda x: F.substring(x, 1, 200))
    return F.when(F.size(kept) > 0, F.concat(F.lit("Key indicators: "), F.array_join(kept, "; "))).otherwise(F.lit(""))


def phantom(markdown: Text) -> Column:
    """Whether a found table has no more than one column and row, and most of its cells are garbled."""
    every = F.flatten(F.transform(pipe_lines(markdown), cells))
    filled = F.filter(every, lambda c: ~c.isin("", "---"))
    odd = F.filter(filled, lambda c: ~c.contains(" ") & (F.length(c) > 15) & c.rlike(r"(?U)[^\w\s]"))
    return (columns(markdown) <= 1) & (data_rows(markdown) <= 1) & (F.size(filled) > 0) & (F.size(odd) > 0.5 * F.size(filled))


def collapse_headers(markdown: Text) -> Column:
    """A table whose header fills several rows, with one header row: each column's words from top to bottom.

    The header is all before the separator, and what follows it up to the first row with three data cells (or to the last
    row, if none has as many). Texts without a separator or with a single header row stay as they are.
    """
    none = F.array().cast("array<string>")

    def row(line: Column, i: Column) -> Column:
        c = F.when(line.startswith("|"), cells(line)).otherwise(none)
        rule = (F.size(c) > 0) & F.forall(c, lambda x: F.regexp_replace(x, "[-: ]", "") == "")
        return F.struct(i.alias("i"), line.alias("line"), line.startswith("|").alias("pipe"), c.alias("cells"), rule.alias("rule"), (F.size(F.filter(c, lambda x: x.rlike(DATA_CELL))) >= 3).alias("data"))

    def collapsed(rows: Column) -> Column:
        rule = F.get(F.filter(rows, lambda r: r["rule"]), F.lit(0))
        data = F.get(F.filter(rows, lambda r: (r["i"] > rule["i"]) & r["data"]), F.lit(0))
        stop = F.coalesce(data["i"], F.array_max(F.transform(F.filter(rows, lambda r: r["pipe"]), lambda r: r["i"])) + 1)
        heads = F.filter(rows, lambda r: r["pipe"] & (r["i"] < stop) & (r["i"] != rule["i"]))
        names = F.transform(rule["cells"], lambda _, k: F.array_join(F.filter(F.transform(heads, lambda h: F.get(h["cells"], k)), lambda x: x != ""), " "))
        head = F.concat(F.lit("| "), F.array_join(names, " | "), F.lit(" |"))
        rest = F.transform(F.filter(rows, lambda r: r["i"] >= stop), lambda r: r["line"])
        return F.when(F.size(heads) > 1, F.array_join(F.concat(F.array(head, rule["line"]), rest), "\n"))

    rows = F.transform(F.split(F.regexp_replace(_c(markdown), r"\n\z", ""), "\n"), row)
    return F.coalesce(F.get(F.transform(F.array(rows), collapsed), F.lit(0)), _c(markdown))
