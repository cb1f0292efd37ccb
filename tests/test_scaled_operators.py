"""Operators that meet no pairs: against brute force on made-up inputs, in small blocks and with hot keys."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import tables as T
from folioflow.functions import text
from folioflow.operators import index, ordering, retrieval, store, structure, usage
from folioflow.sources import documents
from folioflow.sources.scratch import shared_dir

BOX = "document_id string, page int, pos int, id string, kind string, bbox array<double>"


def boxes(n, seed, span, sides, pages=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-span, span), rng.uniform(-span, span), rng.choice(sides), rng.choice(sides)
        if i % 7 == 0:
            x, y = float(round(x / 16) * 16), float(round(y / 16) * 16)  # on cell borders
        out.append(("d", i % pages, rng.randint(0, 50), f"b{i}", rng.choice(["table", "text", "text", "image"]), [x, y, x + w, y + h]))
    return out


def share(a, b):
    w, h = (max(min(a[i + 2], b[i + 2]) - max(a[i], b[i]), 0.0) for i in (0, 1))
    return round(w * h / max((a[2] - a[0]) * (a[3] - a[1]), 1e-6), 9)


CASES = [(150, 1, 60, [1.0, 4.0, 16.0, 33.0, 120.0], 2), (80, 2, 5, [8.0], 1), (60, 3, 500, [0.0, 0.5, 700.0], 1)]


@pytest.mark.parametrize("case", CASES)
def test_text_in_tables(spark, case):
    rows = boxes(*case)
    got = {r["id"] for r in structure.suppress_text_in_tables(spark.createDataFrame(rows, BOX)).collect()}
    gone = {a[3] for a in rows if a[4] == "text" and any(b[4] == "table" and b[1] == a[1] and share(a[5], b[5]) >= 0.5 for b in rows)}
    assert got == {r[3] for r in rows} - gone and (gone or case[1] == 3)


def greedy(rows, kind, least, by_place):
    found, places = [r for r in rows if r[4] == kind], [r for r in rows if r[4] == "text"]
    out = {f[3]: None for f in found}
    for page in {r[1] for r in rows}:
        ask, answer = (sorted((x for x in side if x[1] == page), key=lambda r: (r[2], r[3])) for side in ((places, found) if by_place else (found, places)))
        for a in ask:
            best = max((b for b in answer if share(a[5], b[5]) > least), key=lambda b: share(a[5], b[5]), default=answer[0] if answer else None)
            if best is None:
                break
            answer.remove(best)
            f, p = (best, a) if by_place else (a, best)
            out[f[3]] = p[3]
    return out


@pytest.mark.parametrize(("kind", "least", "by_place"), [("table", 0.0, True), ("image", 0.05, False)])
@pytest.mark.parametrize("case", CASES)
def test_greedy_match(spark, case, kind, least, by_place):
    rows = boxes(*case)
    b = spark.createDataFrame(rows, BOX)
    got = structure.greedy_match(b.where(F.col("kind") == kind), b.where("kind = 'text'"), least, by_place).collect()
    assert {r["found_id"]: r["place_id"] for r in got} == greedy(rows, kind, least, by_place) and len(got) == sum(r[4] == kind for r in rows)


def test_a_dense_page_costs_its_boxes(spark):
    side = 100
    rows = [("d", 1, i, f"t{i}", "table" if i % 2 else "text", [float(i % side * 10), float(i // side * 10), i % side * 10 + 9.0, i // side * 10 + 9.0]) for i in range(side * side)]
    b = spark.createDataFrame(rows, BOX)
    assert structure.touching(b.where("kind = 'table'"), b.where("kind = 'text'")).count() == 0
    assert structure.suppress_text_in_tables(b).count() == len(rows)


def test_section_of_page(spark):
    rng = random.Random(4)
    secs = [(f"d{i % 3}", i, f"s{i}", rng.randint(1, 4), f"p{i}", lo := rng.randint(1, 30), lo + rng.choice([0, 1, 5, 20])) for i in range(1, 90)]
    pages = [(f"d{d}", p) for d in range(4) for p in range(1, 56)]
    got = structure.section_of_page(spark.createDataFrame(pages, "document_id string, page int").repartition(5), spark.createDataFrame(secs, "document_id string, sec_seq int, sec_id string, level int, path string, page_lo int, page_hi int").repartition(3))
    expected = {}
    for d, p in pages:
        inside = max(((s[3], s[1], s[2], s[4]) for s in secs if s[0] == d and s[5] <= p <= s[6]), default=(0, 0, "root", "Document"))
        expected[d, p] = inside[2:]
    assert {(r["document_id"], r["page"]): (r["sec_id"], r["section_path"]) for r in got.collect()} == expected


@pytest.mark.parametrize("block", [3, 5000])
def test_vector_search_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 6))
    v[7] = v[3] = v[50]  # ties go by chunk_id
    v[9] = 0
    chunks = [(f"c{i}", "hot" if i % 3 else f"d{i % 5}", v[i].tolist() if i != 11 else None) for i in range(120)]
    asked = [(q, d, rng.normal(size=6).tolist()) for q in range(4) for d in ("hot", "d0", "none")] + [(4, "hot", v[50].tolist()), (5, "hot", [0.0] * 6), (6, "hot", None)]
    got = retrieval.vector_search(spark.createDataFrame(chunks, "chunk_id string, document_id string, embedding array<double>"), spark.createDataFrame(asked, "query_id long, document_id string, vector array<double>"), 5, block)
    unit = lambda x: np.asarray(x) / (np.linalg.norm(x) or 1)
    expected = []
    for q in range(6):
        found = sorted((-round(float(unit(c[2]) @ unit(a[2])), 6) + 0.0, c[0]) for a in asked for c in chunks if a[0] == q and a[1] == c[1] and c[2] is not None)[:5]
        expected += [(q, i + 1, c, -s + 0.0) for i, (s, c) in enumerate(found)]
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"] + 0.0) for r in got.collect()) == expected


def test_positions_and_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["Zoo", "ape", "Bee", None]), rng.choice([None, 1.0, 2.0]), i) for i in range(500)]
    files = spark.createDataFrame(rows, "user_id string, name string, size double, date int").repartition(6)
    placed = ordering.with_positions(files, [F.col("date").desc()]).collect()
    assert {r["date"]: r["position"] for r in placed} == {i: 499 - i for i in range(500)}
    got = {(r["user_id"], r["place"]): r["date"] for r in usage.library(files).collect()}
    order = lambda r: (r[1] is None, (r[1] or "").lower(), -(r[2] or 0), -r[3])
    assert got == {(u, i + 1): r[3] for u in ("hot", "b", None) for i, r in enumerate(sorted((r for r in rows if r[0] == u), key=order))}
    assert usage.library(files.where("false")).count() == 0


def test_merged_tables(spark):
    table = lambda head, *rows: "\n".join([head, "| --- | --- |", *rows])
    rows = [
        ("d", 0, 1, 5.0, table("| Key | Size |", "| a | 1 |"), "lattice"),
        ("d", 1, 1, 2.0, table("| Size | Key |", "| b | 2 |", "| c | 3 |"), "stream"),  # stands left of the first, so it comes before
        ("d", 2, 3, 0.0, table("| key | size | more | most |", "| d | 4 | 5 | 6 |"), "lattice"),
        ("d", 3, 4, 0.0, "| key |\n| --- |", "lattice"),  # nothing to add
        ("d", 4, 7, 0.0, table("| key | size |", "| far | 1 |"), "lattice"),
        ("d", 5, 7, 1.0, table("| other | words |", "| x | y |"), "lattice"),
        ("d", 6, 8, None, table("| . | ; |", "| q | r |"), "stream"),  # no words: goes on
        ("e", 0, 1, None, table("| key | size |", "| e | 1 |"), "lattice"),
    ]
    t = spark.createDataFrame(rows, "document_id string, tbl_seq int, page int, x0 double, markdown string, flavor string").repartition(4)
    got = {(r["document_id"], r["island"]): (r["page_lo"], r["page_hi"], r["flavor"], r["tables"], r["markdown"]) for r in index.merge_tables(t).collect()}
    assert got == {
        ("d", 0): (1, 4, "stream", 4, "| Size | Key |\n| --- | --- |\n| b | 2 |\n| c | 3 |\n| a | 1 |\n| d | 4 | 5 | 6 |"),
        ("d", 1): (7, 7, "lattice", 1, "| key | size |\n| --- | --- |\n| far | 1 |"),
        ("d", 2): (7, 8, "stream", 2, "| other | words |\n| --- | --- |\n| x | y |\n| q | r |"),
        ("e", 0): (1, 1, "lattice", 1, "| key | size |\n| --- | --- |\n| e | 1 |"),
    }
    assert index.merge_tables(t.where("false")).count() == 0


def test_side_table_is_replaced_and_read_back(spark):
    md = lambda n: "| h |\n| --- |\n" + "\n".join(f"| {i} |" for i in range(n))
    side = store.side_table(spark, shared_dir(spark), 4)
    t = lambda *rows: spark.createDataFrame(list(rows), "document_id string, table_index int, markdown string")
    store.overflow(t(("a/b", 0, md(500)), ("a/b", 1, md(300)), ("c", 0, md(101))), side, 0)
    shown = store.overflow(t(("a/b", 0, md(102)), ("a/b", 1, md(100)), ("z", 0, None)), side, 1)
    rows = {(r["document_id"], r["table_index"]): (r["truncated"], r["table_path"], r["markdown"]) for r in shown.collect()}
    assert rows["a/b", 0] == (True, "a/b/0", md(30)) and rows["a/b", 1] == (False, None, md(100))
    asked = spark.createDataFrame([("a/b/0",), ("a/b/1",), ("c/0",), (None,), ("none/3",)], "table_path string")
    assert {r["table_path"]: r["markdown"] for r in store.whole_tables(asked, side).collect()} == {"a/b/0": md(102), "c/0": md(101)}


def test_evaluation_summary(spark):
    judged = spark.createDataFrame([("1", "a", True, True, True), ("2", "a", True, False, False), ("3", "a", False, False, False), ("4", "b", True, True, True)], "query_id string, document_id string, text_found boolean, citation_ok boolean, top1_ok boolean")
    chunks = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, " \n"), ("b", 1, None), ("b", 4, "z"), ("c", 1, "w")], "document_id string, page int, display_text string")
    documents = spark.createDataFrame([("a", 3, 1.5), ("b", 4, None), ("c", 1, 0.5), ("d", 2, 4.0), ("e", 2, 2.0)], "document_id string, total_pages int, parse_seconds double")
    r = retrieval.evaluation_summary(judged, chunks, documents).first()
    assert (r["documents"], r["queries"], r["top1_correct"], r["pages_with_output"], r["total_pages"], r["median_parse_seconds"]) == (5, 4, 2, 3, 12, 1.75)
    assert math.isclose(r["mean_text_recall"], (0.67 + 1) / 2) and math.isclose(r["mean_citation_accuracy"], (0.33 + 1) / 2)
    none = retrieval.evaluation_summary(judged.where("false"), chunks.where("false"), documents.where("false")).first()
    assert (none["documents"], none["pages_with_output"], none["median_parse_seconds"]) == (0, 0, None)


def test_answers(spark):
    replies = [("d", 2, '{"sections": [{"id": " s1 ", "summary": " late ", "keywords": [" k ", "", "l"]}, {"id": "", "summary": "x"}, {"id": "s1", "summary": "later"}], "document": {"doc_type": "B"}}'), ("d", 1, '```json\n{"sections": [{"id": "s1", "summary": "early"}, {"id": "s2"}], "document": {"title": "no known field"}}\n```'), ("d", 3, "no JSON"), ("d", 4, None), ("d", 5, '{"document": {"doc_type": "C", "inferred_authors": ["x"]}}')]
    parsed = index.parse_answers(spark.createDataFrame(replies, "document_id string, batch int, response string"))
    fallback = spark.createDataFrame([("d", f"s{i}", "own", ["w"]) for i in (1, 2, 3)], "document_id string, sec_id string, summary string, keywords array<string>")
    got = {r["sec_id"]: (r["summary"], list(r["keywords"])) for r in index.merge_answers(index.section_answers(parsed), fallback).collect()}
    assert got == {"s1": ("later", []), "s2": ("", []), "s3": ("own", ["w"])}
    assert [r["doc_type"] for r in index.document_blocks(parsed).collect()] == ["B"]


def test_collapsed_headers(spark):
    texts = {
        "| a | b |\n| --- | --- |\n| c |  |\n| 1.5 | 2 | 3.5 |\n| 4 288 | .. | 1.0 |\n| x | y |": "| a c | b |\n| --- | --- |\n| 4 288 | .. | 1.0 |\n| x | y |",
        "| a | b |\n| --- | --- |\n| 1.5 | 2.5 | .. |": "| a | b |\n| --- | --- |\n| 1.5 | 2.5 | .. |",
        "no table": "no table",
    }
    df = spark.createDataFrame([(k,) for k in texts], "m string")
    got = {r["m"]: r["c"] for r in df.select("m", T.collapse_headers("m").alias("c")).collect()}
    assert got["no table"] == "no table" and got["| a | b |\n| --- | --- |\n| 1.5 | 2.5 | .. |"] == texts["| a | b |\n| --- | --- |\n| 1.5 | 2.5 | .. |"]


def test_upsert_breaks_ties_alike(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    updates = [("a", 5, 1), ("a", 7, 1), ("a", 9, 0), ("c", None, 1)]
    for n in (1, 4):
        got = store.upsert(base, spark.createDataFrame(updates[::-1] if n == 4 else updates, "k string, v long, at int").repartition(n), "k", "at").collect()
        assert sorted(map(tuple, got), key=str) == [("a", 7), ("b", 2), ("c", None)]


def test_uploads_from_files(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("sub/b.txt", b"%PDF-1"), ("c.pdf", b""), ("d.PDF", b"%PDF-" + b"x" * 100), ("e.pdf", b"other")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    # The file source passes over files without a byte, so c.pdf never arrives.
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in documents.admit_uploads(documents.read_uploads(spark, str(tmp_path)), cap=50).collect()}
    assert got == {"a.pdf": None, "b.txt": "not_pdf_name", "d.PDF": "too_large", "e.pdf": "not_pdf"}


def test_rows_without_a_table_do_not_meet(spark):
    # A left join on the null key had all rows without a table in one task.
    side = store.side_table(spark, shared_dir(spark), 2)
    side.replace(0, spark.createDataFrame([("a", 1, "one"), ("b", 2, "two")], store.SIDE))
    rows = spark.range(400).select("id", F.when(F.col("id") == 7, "a/1").when(F.col("id") == 8, "b/2").when(F.col("id") == 9, "b/3").alias("table_path"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = store.with_whole_tables(rows, side, "whole", ["id"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 400 and {r["id"]: r["whole"] for r in got if r["whole"]} == {7: "one", 8: "two"}
    assert len({r["task"] for r in got if r["table_path"] is None}) == 4


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize(("kind", "least", "by_place"), [("table", 0.0, True), ("image", 0.05, False)])
def test_small_pages_are_shuffled_once(spark, monkeypatch, kind, least, by_place):
    # Each page's boxes went through a dozen shuffles, with all pairs that meet.
    draw = random.Random(3)
    rows = [(d, p, i, f"{d}-{p}-{i}", draw.choice(["text", kind]), [x := float(draw.randint(0, 40)), y := draw.randint(0, 40) / 4, x + draw.randint(0, 12), y + draw.randint(0, 40) / 3]) for d in ("a", "b") for p in range(12) for i in range(draw.choice([1, 5, 60]))]
    rows += [("a", 0, 900, "same", kind, [1.0, 1.0, 9.0, 9.0]), ("a", 0, 901, "same", kind, [2.0, 1.0, 9.0, 9.0]), ("a", 1, 900, None, kind, [1.0, 1.0, 9.0, 9.0]), ("a", 2, 900, "void", kind, [None, 1.0, 9.0, None])]
    rows += [(None, 1, 1, "n1", kind, [1.0, 1.0, 9.0, 9.0]), (None, 1, 2, "n2", "text", [1.0, 1.0, 9.0, 9.0]), ("a", None, 1, "n3", kind, [1.0, 1.0, 9.0, 9.0]), ("a", None, 2, "n4", "text", [1.0, 1.0, 9.0, 9.0])]
    b = spark.createDataFrame(rows, BOX)
    sides = b.where(F.col("kind") == kind), b.where("kind = 'text'")
    order = lambda df: sorted(map(str, df.collect()))
    small = structure.greedy_match(*sides, least, by_place)
    assert exchanges(small) == 1
    want = order(structure._match_large(*sides, least, by_place))
    assert order(small) == want and len(want) >= sum(r[4] == kind for r in rows)
    monkeypatch.setattr(structure, "WHOLE", 20)
    assert order(structure.greedy_match(*sides, least, by_place)) == want


def test_small_documents_share_blocks_of_a_search(spark):
    # Each document was a group of its own, which cost more than its scores.
    draw = random.Random(5)
    vector = lambda: [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]
    chunks = [(f"c{d}-{i}", f"d{d}", vector() if i != 1 else None) for d in range(30) for i in range(draw.choice([1, 2, 5, 40]))]
    asked = [(q, f"d{d}", vector() if q else None) for q in range(12) for d in draw.sample(range(33), 9)]
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, embedding array<float>")
    q = spark.createDataFrame(asked, "query_id long, document_id string, vector array<float>")
    got = retrieval.vector_search(c, q, 4, block=8)

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    want = set()
    for query in {r[0] for r in asked}:
        scored = sorted((-cosine(e, v), i, d) for p, of, v in asked if p == query and v for i, d, e in chunks if d == of and e)[:4]
        want |= {(query, i, d, round(-s, 5), n) for n, (s, i, d) in enumerate(scored, 1)}
    assert {(r["query_id"], r["chunk_id"], r["document_id"], round(r["score"], 5), r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow [cell" in plan
    assert retrieval.vector_search(c.limit(0), q, 4).count() == 0


def test_hash_embedding_of_words_in_python(spark):
    # The hashes of all words of a text were made in the plan, again for each text.
    texts = ["Ab ab, x_9 " + "q" * 100, "Ärger 12", "", None]
    e = text.hash_embedding("t", 16)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(e.alias("e"))
    assert "md5" not in df._jdf.queryExecution().executedPlan().toString()
    for t, got in zip(texts, [r["e"] for r in df.collect()], strict=True):
        n = [0] * 16
        for w in set(re.findall("[a-z0-9]+", (t or "").lower())):
            n[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16] += 1
        size = sum(x * x for x in n) ** 0.5 or 1.0
        assert all(abs(a - b / size) < 1e-12 for a, b in zip(got, n, strict=True))
