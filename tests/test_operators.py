"""Operators on small literal inputs, with the results that follow from their rules."""

import json
import time

from pyspark.sql import functions as F

from folioflow.functions import boxes, tables, text
from folioflow.operators import chunking, index, quality, retrieval, structure, usage
from folioflow.sources import documents


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text(spark):
    lit = F.lit
    r = one(spark, text.normalize_title(lit("1.2 Bank  Notes ")), text.summary(lit("A b.  C d! E f.")), text.suspicious_repeats(lit("IIIIIIIIIIII")), text.suspicious_repeats(lit("plain words here")), text.printable_ratio(lit("")))
    assert list(r) == ["bank  notes", "A b. C d!", True, False, 1.0]
    r = one(spark, text.date_variants(lit("December 2025")), text.query_variants(lit("rate in Dec-25")), text.parse_date(lit("2025-1-2")), text.dates_in(lit("x 3/2024 y")))
    assert r[0] == ["December 2025", "Dec-25", "Dec 2025", "12/2025", "12-25"]
    assert r[1] == ["rate in Dec-25", "rate in december 2025", "rate in Dec 2025", "rate in 12/2025"]
    assert tuple(r[2]) == (2025, 1, 2) and [tuple(x) for x in r[3]] == [(2024, 3, 1)]
    r = one(spark, text.lenient_json(lit('```json\n{"a": 1}\n```')), text.lenient_json(lit("none")), text.caption(lit("Line one\nand two")), text.caption(lit("[1]")))
    assert json.loads(r[0]) == {"a": 1} and r[1] is None and tuple(r[2]) == ("Line one", "and two") and tuple(r[3]) == ("", "")
    assert [one(spark, text.retry_delay(lit(n)))[0] for n in (1, 2, 3)] == [60, 120, 240]
    r = one(spark, text.event_key(lit(None), lit("subscription.active"), lit("sub_1"), lit("t")), text.event_key(lit("evt"), lit("x"), lit("y"), lit("t")), text.hash_embedding(lit("")))
    assert r[0] == "subscription.active:sub_1:t" and r[1] == "msg:evt" and set(r[2]) == {0.0}


def test_windows(spark):
    r = one(spark, chunking.token_windows(F.lit(""), 100, 10), chunking.token_windows(F.lit("hello"), 100, 10), chunking.token_windows(F.lit("word " * 200), 20, 5))
    assert r[0] == [] and r[1] == ["hello"] and len(r[2]) == 13 and all(len(w.split()) <= 20 for w in r[2])


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, *[F.round(boxes.overlap(box(*a), box(*b)), 3) for a, b in (((0, 0, 1, 1), (5, 5, 6, 6)), ((0, 0, 2, 2), (0, 0, 2, 2)), ((0, 0, 10, 10), (5, 5, 15, 15)))], boxes.of_points(F.array().cast("array<array<double>>")))
    assert list(r) == [0.0, 1.0, 0.25, None]


def test_tables(spark):
    md = "| Region | Revenue |\n| --- | --- |\n| Africa | 10 |\n| Asia | 20 |"
    r = one(spark, tables.data_rows(F.lit(md)), tables.columns(F.lit(md)), tables.header_tokens(F.lit(md)), tables.descriptor(F.lit("| code | Description |\n| - | - |\n| a | Some label |\n| b | some LABEL |")), tables.phantom(F.lit(md)))
    assert list(r) == [2, 2, ["region", "revenue"], "Key indicators: Some label", False]


def test_labels_of_a_long_table(spark):
    # Each label once was held against all rows: a table of some thousand rows took minutes.
    md = "| code | label |\n| --- | --- |\n" + "\n".join(f"| {i} | Label {'abc'[i % 3]} {i // 100} {'x' * (i % 2)} |" if i % 2 else f"| {i} | LABEL {'abc'[i % 3]} {i // 100} |" for i in range(3000))
    first = {}
    for line in md.split("\n")[2:]:
        label = line.split("|")[2].strip()
        first.setdefault(label.lower(), label)
    began = time.monotonic()
    got = spark.createDataFrame([(md,)], "md string").select(tables.descriptor("md")).first()[0]
    assert got == "Key indicators: label; " + "; ".join(list(first.values())[:24])
    assert time.monotonic() - began < 20


def test_structure(spark):
    rows = [("d", 0, "Title", 0, 1, "A"), ("d", 1, "NarrativeText", None, 1, "first"), ("d", 2, "Title", 1, 3, "B"), ("d", 3, "Image", None, 4, "pic"), ("d", 4, "Footer", None, 4, "foot"), ("d", 5, "Title", 0, 9, "C")]
    raw = spark.createDataFrame(rows, "document_id string, pos int, category string, category_depth int, page int, text string")
    m = structure.mark(raw)
    e = structure.elements(m)
    s = structure.page_ranges(structure.sections(m), e)
    got = {r["title"]: (r["path"], r["page_lo"], r["page_hi"]) for r in s.collect()}
    assert got == {"A": ("A", 1, 4), "B": ("A > B", 3, 4), "C": ("C", 9, 9)}
    assert [r["element_id"] for r in e.orderBy("pos").collect()] == ["el-1", "el-2"]
    deep = structure.section_of_page(spark.createDataFrame([("d", 3), ("d", 7)], "document_id string, page int"), s).orderBy("page").collect()
    assert [r["section_path"] for r in deep] == ["A > B", "Document"]


def test_greedy_match_is_one_to_one(spark, sf_dir):
    b = documents.lineitem_boxes(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    m = structure.greedy_match(b.where("kind = 'table'"), b.where("kind = 'text'"), 0.0, True).toPandas()
    placed = m.dropna()
    assert len(m) == b.where("kind = 'table'").count() and not placed.duplicated(["document_id", "page", "place_id"]).any() and not m.duplicated(["document_id", "page", "found_id"]).any()


def test_quality(spark):
    good = "This is a good line of text with more than forty characters."
    raw = spark.createDataFrame([("a", 1, "NarrativeText", good), ("a", 3, "NarrativeText", good)], "document_id string, page int, category string, text string")
    expected = spark.createDataFrame([("a", 4, "fast"), ("b", 2, "fast")], "document_id string, expected_pages int, route string")
    c = quality.coverage(raw, expected)
    assert {r["document_id"]: r["missing"] for r in c.collect()} == {"a": [2, 4], "b": [1, 2]}
    warn = {r["document_id"]: r["warnings"] for r in quality.quality_gate(c).collect()}
    assert warn == {"a": ["2 of 4 pages without usable text or image"], "b": ["no usable text or images"]}


def test_packing(spark):
    rows = [("d", i, "- s", "b") for i in range(100)]
    secs = spark.createDataFrame(rows, "document_id string, sec_seq int, toc string, body string")
    assert [r["n"] for r in index.pack_sections(secs).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [40, 40, 20]


def test_quota_words(spark):
    p = spark.createDataFrame([(1, 0, "hel"), (1, 1, "lo world"), (1, 2, " next")], "request_id long, seq int, content string")
    w = usage.piece_words(p)
    assert w.agg(F.sum("words")).first()[0] == 3
    crossed = usage.quota_crossing(w.withColumn("remaining", F.lit(2))).first()
    assert (crossed["counted"], crossed["limit_seq"]) == (2, 1)


def test_filters_keep_all_when_nothing_is_left(spark):
    h = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y")], "query_id long, pos int, display_text string, text_for_embedding string")
    none = retrieval.filter_entities(h.withColumn("key_entities", F.array(F.lit("zzz"))))
    some = retrieval.filter_entities(h.withColumn("key_entities", F.array(F.lit("Y"))))
    assert none.count() == 2 and [r["pos"] for r in some.collect()] == [2]


def test_same_rows_for_any_partitioning(spark, sf_dir):
    from folioflow.plans import QUERIES

    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, QUERIES["w3_chunk_numbers"](spark, sf_dir).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_trees_through_batches(spark):
    # Documents that end in the middle of a batch or go on in the next one; no pandas frame for each document.
    rows = [(None if d == 0 else f"d{d}", i, f"s{i}", f"T{i}", 1 if i % 4 == 1 else 2, "p", f"s{i - (i - 1) % 4}" if i % 4 != 1 else None, i, i + 1, ["el-1"] if i % 2 else None) for d in range(7) for i in range(1, d + 4)]
    secs = spark.createDataFrame(rows, documents.SECTION)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        trees = documents.tree_from_sections(secs.orderBy(F.rand(1)))
        back = documents.sections_from_tree(trees)
        again = sorted(((*r[:9], list(r[9])) for r in back.collect()), key=str)
        plan = trees._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # The tree's own order is pre-order by section number, so nothing but the missing lists differs.
    assert again == sorted(((*r[:9], r[9] or []) for r in rows), key=str)
    assert "FlatMapGroupsInPandas" not in plan
