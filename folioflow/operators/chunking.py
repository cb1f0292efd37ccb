"""From elements to page-accurate chunks, without a row for each token: tokens stay in arrays and are sliced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.boxes import union_of
from ..functions.text import strip, tokens

TARGET, OVERLAP, TABLE_ROWS, PREVIEW_ROWS = 800, 100, 100, 30


def window_count(n: Column, target: int, overlap: int) -> Column:
    """Windows of `target` tokens, each `target - overlap` after the last, up to the first that reaches the end."""
    step = max(1, target - overlap)
    return F.when(n == 0, F.lit(0)).when(n <= target, F.lit(1)).otherwise(F.ceil((n - target) / step) + 1).cast("int")


def token_windows(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """The text's windows as strings."""
    step = max(1, target - overlap)

    def windows(toks: Column) -> Column:
        n = window_count(F.size(toks), target, overlap)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i * step + 1, F.lit(target)), ""))

    return F.get(F.transform(F.array(tokens(text)), windows), F.lit(0))  # the text is split once


def boilerplate(elements: DataFrame, chars: int = 30, pages: int = 3) -> DataFrame:
    """Texts of more than `chars` characters on at least `pages` pages of a document."""
    long = elements.where((F.col("type") == "text") & (F.length("text") > chars))
    return long.groupBy("document_id", "text").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages).select("document_id", "text")


def without_boilerplate(elements: DataFrame) -> DataFrame:
    return elements.join(boilerplate(elements), ["document_id", "text"], "left_anti")


def text_chunks(elements: DataFrame, secs: DataFrame, target: int = TARGET, overlap: int = OVERLAP, provenance: bool = True) -> DataFrame:
    """Chunks of text and formula elements: one token stream for each section and page, cut into windows.

    Elements are joined by a paragraph break that counts as one token. A window keeps the ids of the elements it overlaps, the
    union of their boxes and its page size (null where elements have none). Finished windows are the only rows made.
    Columns: document_id, sec_seq, page, first_pos, window, element_ids, bbox, page_size, section_path, display_text,
    text_for_embedding. Without provenance, element_ids, bbox and page_size are left out, and what elements a window
    overlaps is not worked out.
    """
    step, keys = max(1, target - overlap), ["document_id", "sec_seq", "page"]
    boxes = {c: F.col(c) if c in elements.columns else F.lit(None).cast("array<double>") for c in ("bbox", "page_size")}
    e = elements.where("type in ('text', 'formula')").withColumns({"toks": tokens("text"), **boxes})
    fields = F.struct("pos", "toks")
    if provenance:
        order = Window.partitionBy(*keys).orderBy("pos")
        e = e.withColumn("end", (F.sum(F.size("toks")).over(order) + F.row_number().over(order) - 1).cast("int"))
        fields = F.struct("pos", "element_id", "end", F.size("toks").alias("n"), "bbox", "page_size", "toks")
    parts = e.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("els"))
    parts = parts.withColumn("stream", F.expr("flatten(transform(els, (e, i) -> if(i = 0, e.toks, concat(array('\\n\\n'), e.toks))))"))

    n = window_count(F.size("stream"), target, overlap)
    windows = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = parts.withColumn("windows", windows)
    shown = lambda w: strip(F.array_join(F.slice("stream", w * step + 1, F.lit(target)), ""))
    if not provenance:
        made = F.transform("windows", lambda w: F.struct(w.alias("window"), shown(w).alias("display_text")))
        out = parts.select(*keys, F.col("els")[0]["pos"].alias("first_pos"), F.explode(made).alias("c")).where("c.display_text <> ''")
        return _in_sections(out.select(*keys, "first_pos", "c.window", "c.display_text"), secs)

    # Which elements a window overlaps: each element names its windows, each window a head before them, and all are sorted once.

    def named(e: Column, i: Column) -> Column:
        first = F.greatest(F.floor((e["end"] - e["n"] - target) / step) + 1, F.lit(0)).cast("int")
        last = F.least(F.ceil(e["end"] / step) - 1, F.size("windows") - 1).cast("int")
        of = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(of, lambda w: F.struct(w.alias("w"), i.alias("i")))

    heads = F.transform("windows", lambda w: F.struct(w.alias("w"), F.lit(-1).alias("i")))
    parts = parts.withColumn("named", F.array_sort(F.concat(heads, F.flatten(F.transform("els", named)))))
    spots = F.sequence(F.lit(0), F.size("named"))  # one more than there are, so that the last window ends too
    parts = parts.withColumn("heads", F.filter(spots, lambda k: (k == F.size("named")) | (F.get(F.col("named"), k)["i"] == -1)))

    def window(w: Column) -> Column:
        first, after = F.get(F.col("heads"), w) + 1, F.get(F.col("heads"), w + 1)
        of = F.slice("named", first + 1, after - first)
        inside = F.transform(F.transform(of, lambda x: F.get(F.col("els"), x["i"])), lambda x: F.struct(x["element_id"].alias("element_id"), x["bbox"].alias("bbox"), x["page_size"].alias("page_size")))
        return F.struct(w.alias("window"), inside.alias("inside"), shown(w).alias("display_text"))

    made = F.transform("windows", window)
    out = parts.select(*keys, F.col("els")[0]["pos"].alias("first_pos"), F.explode(made).alias("c")).where("c.display_text <> ''")
    out = out.withColumn("box", union_of(F.col("c.inside")))
    ids = F.transform("c.inside", lambda x: x["element_id"])
    out = out.select(*keys, "first_pos", "c.window", ids.alias("element_ids"), "box.bbox", "box.page_size", "c.display_text")
    return _in_sections(out, secs)


def _in_sections(chunks: DataFrame, secs: DataFrame) -> DataFrame:
    """The chunks with section_path and text_for_embedding."""
    named = chunks.join(secs.select("document_id", "sec_seq", "path"), ["document_id", "sec_seq"], "left").withColumn("section_path", F.coalesce("path", F.lit("Document"))).drop("path")
    return named.withColumn("text_for_embedding", F.concat("section_path", F.lit("\n\n"), "display_text"))


def table_chunk(markdown: Column, caption: Column, description: Column, lo: Column, hi: Column) -> Column:
    """struct(embed, display, rows, cols, truncated) of a table; null without table and description, or for phantoms."""
    md = F.coalesce(markdown, F.lit(""))
    head = F.concat(F.when(lo != hi, F.concat(F.lit("[Table on pp."), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[Table on p."), lo.cast("string"), F.lit("]"))), F.when(caption != "", F.concat(F.lit(" "), caption)).otherwise(F.lit("")))
    said = F.when(F.coalesce(description, F.lit("")) != "", description).otherwise(T.descriptor(md))
    rows, big = T.data_rows(md), T.data_rows(md) > TABLE_ROWS
    shown = F.when(big, preview(md)).otherwise(md)
    blank = lambda c: F.nullif(c, F.lit(""))
    more = F.when(big, F.concat(F.lit("\n[Full table has "), (rows - PREVIEW_ROWS).cast("string"), F.lit(" more rows]")))
    made = F.struct(
        F.concat_ws("\n", head, blank(said), blank(F.substring(shown, 1, 3000))).alias("embed"),
        F.concat_ws("\n\n", head, blank(said), blank(shown), more).alias("display"),
        rows.alias("rows"),
        T.columns(md).alias("cols"),
        big.alias("truncated"),
    )
    return F.when(((md != "") | (F.coalesce(description, F.lit("")) != "")) & ~T.phantom(md), made)


def preview(markdown: Column, rows: int = PREVIEW_ROWS) -> Column:
    """Header, separator and the first rows of a large table."""
    return F.array_join(F.slice(T.lines(markdown), 1, 2 + rows), "\n")


def image_chunk(caption: Column, description: Column, path: Column, section: Column, nearby: Column, page: Column, vector: Column, analyzed: Column) -> Column:
    """struct(embed, display) of an image; null without file, caption and section."""
    c, d, s, n = (F.coalesce(x, F.lit("")) for x in (caption, description, section, nearby))
    head = F.concat(F.when(vector, F.lit("[Vector chart/diagram on p.")).otherwise(F.lit("[Figure on p.")), page.cast("string"), F.lit("]"), F.when(c != "", F.concat(F.lit(" "), c)).otherwise(F.lit("")))
    label = F.when(s != "", s).otherwise(F.lit("Document"))
    near = F.when(n != "", F.concat(F.lit("Nearby text: "), F.substring(n, 1, 500)))
    embed = F.when(d != "", F.concat_ws("\n", head, d)).otherwise(F.concat_ws("\n", head, F.concat(F.lit("Section: "), label), near, F.lit("Visual analysis available on demand.")))
    display = F.concat_ws("\n", head, F.when(d != "", d).when(~analyzed, F.lit("(Visual analysis available on demand)")))
    return F.when((F.coalesce(path, F.lit("")) != "") | (c != "") | (s != ""), F.struct(embed.alias("embed"), display.alias("display")))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id doc::type::n: one counter for each document over sections, text before tables and images, pages by their
    first element, then windows. Chunks have document_id, sec_seq, type, first_pos and window."""
    order = Window.partitionBy("document_id").orderBy("sec_seq", (F.col("type") != "text").cast("int"), "first_pos", "window")
    return chunks.withColumn("chunk_no", F.row_number().over(order) - 1).withColumn("chunk_id", F.concat_ws("::", "document_id", "type", F.col("chunk_no").cast("string")))


def nearby_text(elements: DataFrame, chars: int = 600) -> DataFrame:
    """For each image, the texts of its page outside the root, in order and cut."""
    page = elements.where("type = 'text' and sec_seq > 0").groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    text = strip(F.substring(F.array_join(F.transform("t", lambda x: x["text"]), " "), 1, chars))
    return elements.where("type = 'image'").join(page, ["document_id", "page"], "left").select("document_id", "element_id", "page", F.coalesce(text, F.lit("")).alias("nearby_text"))
