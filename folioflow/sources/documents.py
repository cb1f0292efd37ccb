"""Reading inputs: upload admission, flat element records, nested section trees, event lines, and the given tables as elements."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

ELEMENT_KEYS = ["id", "type", "page", "text"]
SECTION = "document_id string, sec_seq int, sec_id string, title string, level int, path string, parent_id string, page_lo int, page_hi int, element_ids array<string>"


def admit_uploads(files: DataFrame, cap: int = 5 << 20) -> DataFrame:
    """Binary files (path, length, content) with the reason for which they are refused, or null."""
    reason = (
        F.when(F.col("length") == 0, "empty")
        .when(~F.lower("path").endswith(".pdf"), "not_pdf_name")
        .when(F.col("length") > cap, "too_large")
        .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not_pdf")
    )
    return files.select("path", "length", reason.alias("reason"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def elements_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Element records from JSON lines; keys that the schema lacks go to the map `extra`; the page is 1 if missing."""
    fields = F.from_json(column, "map<string,string>")
    named = lambda k: F.try_element_at("fields", F.lit(k))
    return lines.withColumn("fields", fields).select(
        *[c for c in lines.columns if c != column],
        named("id").alias("id"),
        F.coalesce(named("type"), F.lit("text")).alias("type"),
        F.coalesce(named("page").try_cast("int"), F.lit(1)).alias("page"),
        F.coalesce(named("text"), F.lit("")).alias("text"),
        F.map_filter("fields", lambda k, v: ~k.isin(ELEMENT_KEYS)).alias("extra"),
    )


def sections_from_tree(trees: DataFrame) -> DataFrame:
    """Ordered sections of nested JSON trees (document_id, tree): pre-order, without the root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, tree in zip(batch["document_id"], batch["tree"], strict=True):
                todo, seq = [(s, None) for s in reversed(json.loads(tree or "{}").get("sections", []))], 0
                while todo:
                    s, parent = todo.pop()
                    seq += 1
                    lo, hi = s.get("page_range") or (None, None)
                    rows.append((doc, seq, s["id"], s.get("title"), s.get("level"), s.get("path"), parent, lo, hi, [e["id"] for e in s.get("elements", [])]))
                    todo += [(c, s["id"]) for c in reversed(s.get("children", []))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION.split(", ")])

    return trees.select("document_id", "tree").mapInPandas(run, SECTION)


def tree_from_sections(sections: DataFrame) -> DataFrame:
    """document_id and its sections as one nested JSON tree.

    A document's sections stand in a row in one partition, so trees are built through whole batches, and each is given when
    the next document begins.
    """
    columns = ["document_id", "sec_seq", "sec_id", "title", "level", "path", "parent_id", "page_lo", "page_hi", "element_ids"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, document, made, top = False, None, {}, []
        written = lambda: (document, json.dumps({"document_id": str(document), "sections": top}, ensure_ascii=False))
        for batch in batches:
            done = []
            for s in batch.itertuples(index=False):
                if not begun or s.document_id != document:
                    if begun:
                        done.append(written())
                    begun, document, made, top = True, s.document_id, {}, []
                ids = [] if s.element_ids is None else list(s.element_ids)
                node = {"id": s.sec_id, "title": s.title, "level": int(s.level), "path": s.path, "page_range": [int(s.page_lo), int(s.page_hi)], "elements": [{"id": e} for e in ids], "children": []}
                made[s.sec_id] = node
                (made[s.parent_id]["children"] if s.parent_id in made else top).append(node)
            yield pd.DataFrame(done, columns=["document_id", "tree"])
        if begun:
            yield pd.DataFrame([written()], columns=["document_id", "tree"])

    ordered = sections.select(columns).repartition("document_id").sortWithinPartitions("document_id", "sec_seq")
    return ordered.mapInPandas(build, "document_id string, tree string")


def events_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of one JSON object a line."""
    schema = "request_id string, seq int, user_id string, ts timestamp, type string, content string"
    return lines.select(F.from_json(column, schema).alias("e")).select("e.*")


# The given tables as inputs.

CATEGORIES = ["Table", "Image", "Figure", "Formula", "Footer", "Address", "Header", "SectionHeader", "ListItem"]


def raw_elements(documents: DataFrame) -> DataFrame:
    """Each line of a document as a parsed element: document_id, pos, page, category, category_depth, text, bbox, page_size.

    Short lines are titles; the others take a category, a box and a page size (or none) by a rule, so every kind occurs.
    """
    d = documents.where("text is not null").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    d = d.withColumn("nw", F.size(F.regexp_extract_all("text", F.lit("[^ \t\n\r\f]+"), F.lit(0))))
    kind = F.lit("NarrativeText")
    for i, c in reversed(list(enumerate(CATEGORIES))):
        kind = F.when((F.col("doc_id") + F.col("pos")) % 13 == i, c).otherwise(kind)
    return d.select(
        F.col("doc_id").cast("string").alias("document_id"),
        "pos",
        (F.floor(F.col("pos") / 5) + 1).cast("int").alias("page"),
        F.when(F.col("nw") <= 4, "Title").otherwise(kind).alias("category"),
        F.when(F.col("nw") <= 4, F.col("nw") - 1).alias("category_depth"),
        "text",
        F.array(*((F.col("pos") % m * k + more).cast("double") for m, k, more in ((7, 10, 0), (5, 20, 0), (7, 10, 50), (5, 20, 15)))).alias("bbox"),
        F.when(F.col("pos") % 4 != 1, F.when((F.col("doc_id") + F.col("pos")) % 3 == 0, F.array(F.lit(600.0), F.lit(800.0))).otherwise(F.array(F.lit(612.0), F.lit(792.0)))).alias("page_size"),
    )


def page_elements(pages: DataFrame) -> DataFrame:
    """The blocks of raw web pages as parsed elements: titles, headings, paragraphs, list items and footers in page order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(title|h1|p|li|footer)[^>]*>(.*?)</\1>"), F.lit(0))
    d = pages.select(F.col("page_id").cast("string").alias("document_id"), F.posexplode(found).alias("pos", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([a-zA-Z0-9]+)", 1))
    kind = F.when(tag.isin("title", "h1"), "Title").when(tag == "footer", "Footer").when(tag == "li", "ListItem").otherwise("NarrativeText")
    text = strip(F.regexp_replace(F.regexp_replace("block", "<[^>]*>", " "), r"\s+", " "))
    return d.select("document_id", "pos", F.lit(1).alias("page"), kind.alias("category"), F.when(tag == "title", 0).when(tag == "h1", 1).alias("category_depth"), text.alias("text"))


def lineitem_boxes(lineitem: DataFrame) -> DataFrame:
    """Order lines as boxes on pages: document_id, page, pos, id, kind, bbox, page_size."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 400
    order = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey")
    return lineitem.select(
        F.col("l_suppkey").cast("string").alias("document_id"),
        F.col("l_linenumber").cast("int").alias("page"),
        F.row_number().over(order).alias("pos"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("id"),
        F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "image").otherwise("text").alias("kind"),
        F.array(x, y, x + 10, y + 8 + F.col("l_tax").cast("double") * 100).alias("bbox"),
        F.when(F.row_number().over(order) % 4 != 1, F.array(F.when(F.col("l_partkey") % 3 == 0, 600.0).otherwise(612.0), F.lit(800.0))).alias("page_size"),
    )


def part_tables(part: DataFrame) -> DataFrame:
    """Parts of a brand as pipe tables of ten rows: document_id, tbl_seq, page, markdown, flavor."""
    p = part.select("*", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("n"))
    p = p.withColumn("tbl_seq", F.floor((F.col("n") - 1) / 10).cast("int"))
    row = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_name"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))), lambda r: r["row"]), "\n")
    t = p.groupBy(F.col("p_brand").alias("document_id"), "tbl_seq").agg(lines.alias("lines"))
    head = F.lit("| key | part name | size |\n| --- | --- | --- |\n")
    return t.select("document_id", "tbl_seq", (F.col("tbl_seq") + 1).alias("page"), F.concat(head, "lines").alias("markdown"), F.when(F.col("tbl_seq") % 3 == 0, "stream").otherwise("lattice").alias("flavor"))
