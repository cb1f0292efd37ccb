"""Queries over ingestion operators: sources, structure, chunks, tables, quality, index, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import tables as T
from ..functions import text as X
from ..operators import chunking as C
from ..operators import index as I
from ..operators import quality as Q
from ..operators import store as S
from ..operators import structure as R
from ..sources import documents as D
from ..sources.scratch import shared_dir, stored
from . import sql as L
from .registry import query, table


def marked(spark: SparkSession, d: str) -> DataFrame:
    return R.mark(D.raw_elements(table(spark, d, "documents")))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Elements and sections of the documents."""
    m = stored(marked(spark, d))
    e = R.elements(m)
    return e, R.page_ranges(stored(R.sections(m)), e)


def elements_and_paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Elements and sections without page ranges, for chunks."""
    m = stored(marked(spark, d))
    return R.elements(m), R.sections(m)


def joined(c: str, sep: str = "|"):
    return F.array_join(c, sep)


@query(f"with {L.RAW} select document_id, pos, coalesce(element_id, '') as element_id, coalesce(cast(level as int), 0) as level, sec_seq from marked")
def p2_heading_levels(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("document_id", "pos", F.coalesce("element_id", F.lit("")).alias("element_id"), F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), "sec_seq")


@query(f"with {L.RAW} select document_id, pos, element_id, type, page, text from els")
def p1_element_typing(spark: SparkSession, d: str) -> DataFrame:
    return R.elements(marked(spark, d)).drop("sec_seq", "bbox", "page_size")


@query(f"with recursive {L.SECTIONS} select document_id, sec_seq, sec_id, title, level, path, cast(parent_seq as int) as parent_seq from secs")
def w4_heading_stack(spark: SparkSession, d: str) -> DataFrame:
    return R.sections(marked(spark, d)).drop("ancestors", "page")


@query(f"with recursive {L.SECTIONS} select document_id, sec_seq, page_lo, page_hi from secs")
def a7_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)[1].select("document_id", "sec_seq", "page_lo", "page_hi")


@query(
    f"""with recursive {L.SECTIONS}, p as (select distinct document_id, page from els),
    r as (select p.document_id, p.page, s.sec_id, s.path, row_number() over (partition by p.document_id, p.page order by s.level desc, s.sec_seq desc) as n from p left join secs s on s.document_id = p.document_id and p.page between s.page_lo and s.page_hi)
    select document_id, page, coalesce(sec_id, 'root') as sec_id, coalesce(path, 'Document') as section_path from r where n = 1"""
)
def j8_section_of_page(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    return R.section_of_page(e.select("document_id", "page").distinct(), s)


@query(
    f"""with {L.RAW} select element_id as id, type, page, text, category_list as extra from (select element_id, type, page, text, 'pos=' || pos as category_list from els)"""
)
def s2_element_records(spark: SparkSession, d: str) -> DataFrame:
    e = R.elements(marked(spark, d))
    lines = e.select(F.to_json(F.struct(F.col("element_id").alias("id"), "type", "page", "text", F.col("pos").cast("string").alias("pos"))).alias("value"))
    out = D.elements_from_json(lines)
    return out.withColumn("extra", F.array_join(F.transform(F.map_entries("extra"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


def _trees(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    ids = e.groupBy("document_id", "sec_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "element_id"))), lambda x: x["element_id"]).alias("element_ids"))
    full = s.join(ids, ["document_id", "sec_seq"], "left").withColumn("parent_id", F.when(F.col("parent_seq") > 0, F.concat(F.lit("s"), F.col("parent_seq").cast("string"))))
    return D.tree_from_sections(full)


@query(f"with recursive {L.SECTIONS} select document_id, sec_seq, sec_id, title, level, path, page_lo, page_hi from secs")
def s3_flatten_tree(spark: SparkSession, d: str) -> DataFrame:
    return D.sections_from_tree(_trees(spark, d)).drop("element_ids", "parent_id")


@query(f"""with recursive {L.SECTIONS}, i as (select document_id, sec_seq, list('"id": "' || element_id || '"' order by pos) as els from els where sec_seq > 0 group by all)
    select document_id, array_to_string(flatten(list(list_concat(['"id": "' || sec_id || '"'], coalesce(els, [])) order by sec_seq)), ',') as ids, string_agg('"level": ' || level, ',' order by sec_seq) as levels, string_agg('"page_range": [' || page_lo || ', ' || page_hi || ']', ',' order by sec_seq) as pages, count(*) as lists from secs left join i using (document_id, sec_seq) group by 1""")
def s4_write_tree(spark: SparkSession, d: str) -> DataFrame:
    # What stands in the JSON text, in its order: parents before children, a section's elements before its children.
    found = lambda form: F.array_join(F.regexp_extract_all("tree", F.lit(form), F.lit(0)), ",")
    return _trees(spark, d).select("document_id", found(r'"id": "(?:s|el-)\d+"').alias("ids"), found(r'"level": \d+').alias("levels"), found(r'"page_range": \[\d+, \d+\]').alias("pages"), F.size(F.regexp_extract_all("tree", F.lit(r'"children": \['), F.lit(0))).cast("long").alias("lists"))


@query("""select cast(doc_id as varchar) || '.pdf' as path, case when text = '' then 'empty' when doc_id % 7 = 0 then 'not_pdf_name' when strlen(text) + 5 > 8000 then 'too_large' when doc_id % 5 = 0 then 'not_pdf' end as reason from documents where text is not null""")
def s1_upload_admission(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("%TXT-")).otherwise(F.lit("%PDF-"))
    content = F.concat(F.when(F.col("text") == "", F.lit("")).otherwise(head), "text").cast("binary")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit(".txt")).otherwise(F.lit(".pdf")))
    out = D.admit_uploads(docs.select(name.alias("path"), F.length(content).cast("long").alias("length"), content.alias("content")), cap=8000)
    return out.select(F.regexp_replace("path", "txt$", "pdf").alias("path"), "reason")


_UPSERT = """with base as (select doc_id as chunk_id, lang as document_id, n_chars as v from documents where doc_id % 3 > 0),
    upd as (select chunk_id, document_id, v from (select doc_id as chunk_id, source as document_id, n_chars + k as v, row_number() over (partition by doc_id order by k desc) as n from documents, (values (1), (2)) t(k) where doc_id % 2 = 0) where n = 1)"""


@query(f"{_UPSERT} select * from upd union all select * from base where chunk_id not in (select chunk_id from upd)")
def s5_upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    base = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("document_id"), F.col("n_chars").alias("v"))
    upd = docs.where("doc_id % 2 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("n_chars") + F.col("k")).alias("v"), "k")
    return S.upsert(base, upd, "chunk_id", "k")


@query("select doc_id, source as document_id, n_chars as v from documents where doc_id % 2 = 0 and source not in (select source from documents where doc_id % 11 = 1) union all select doc_id, source, -n_chars from documents where doc_id % 11 = 1")
def s6_replace_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("source", "document_id")
    new = docs.where("doc_id % 11 = 1").select("doc_id", "document_id", (-F.col("n_chars")).alias("v"))
    return S.replace_documents(docs.where("doc_id % 2 = 0").select("doc_id", "document_id", F.col("n_chars").alias("v")), new)


_BIG = """big as (select case when c_nationkey < 20 then c_nationkey // 2 else c_nationkey end as document_id, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' |', chr(10) order by c_custkey) as markdown, count(*) as n from customer group by 1)"""  # two nations a document, one from nation 20 on


def _big_tables(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), F.col("c_name"), F.lit(" |"))
    t = table(spark, d, "customer").groupBy(F.when(F.col("c_nationkey") < 20, F.floor(F.col("c_nationkey") / 2)).otherwise(F.col("c_nationkey")).alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    return t.select("document_id", F.concat(F.lit("| key | name |\n| --- | --- |\n"), "rows").alias("markdown"))


@query(f"""with {_BIG} select cast(document_id as varchar) as document_id, n > 100 as truncated, case when n > 100 then document_id || '/0' end as table_path, case when n > 100 then array_to_string(string_split(markdown, chr(10))[1:32], chr(10)) else markdown end as markdown, case when n > 100 then markdown end as whole from big""")
def s7_overflow_tables(spark: SparkSession, d: str) -> DataFrame:
    t = stored(_big_tables(spark, d).withColumn("document_id", F.col("document_id").cast("string")).withColumn("table_index", F.lit(0)))
    side = S.side_table(spark, shared_dir(spark), 8)
    # An earlier version of all tables, which the batch replaces.
    S.overflow(t.withColumn("markdown", F.concat("markdown", F.lit("\n| old | row |"))), side, 0)
    shown = S.overflow(t, side, 1)
    whole = S.with_whole_tables(shown, side, "whole", ["document_id", "table_index"])
    return whole.select("document_id", "truncated", "table_path", "markdown", "whole")


@query("""with o as (select c_custkey as user_id, c_name as name, c_mktsegment as segment from customer where c_custkey % 3 > 0), n as (select c_custkey as user_id, case when c_custkey % 2 = 0 then 'new ' || c_name end as name, case when c_custkey % 5 = 0 then 'X' end as segment from customer where c_custkey % 4 > 0)
    select user_id, coalesce(n.name, o.name) as name, coalesce(n.segment, o.segment) as segment from o full join n using (user_id)""")
def s8_merge_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "user_id")
    old = c.where("user_id % 3 > 0").select("user_id", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("user_id % 4 > 0").select("user_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("new "), "c_name")).alias("name"), F.when(F.col("user_id") % 5 == 0, "X").alias("segment"))
    return S.merge_profiles(old, new, "user_id")


@query("select cast(conv_id as varchar) as request_id, cast(turn as int) as seq, role as user_id, case when turn % 3 > 0 then strftime(make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000), '%Y-%m-%d %H:%M:%S') end as ts, 'content' as type, text as content from conversations")
def s9_event_lines(spark: SparkSession, d: str) -> DataFrame:
    ts = F.when(F.col("turn") % 3 > 0, F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 1000 + F.col("turn")))
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("int").alias("seq"), F.col("role").alias("user_id"), ts.alias("ts"), F.lit("content").alias("type"), F.col("text").alias("content"))
    return D.events_from_lines(S.event_lines(c)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


# Chunks.

_TOK = "regexp_extract_all(text, '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+')"


@query(f"""with t as (select doc_id, {_TOK} as k from documents where text is not null), w as (select doc_id, k, unnest(range(0, case when len(k) = 0 then 0 when len(k) <= 80 then 1 else cast(ceil((len(k) - 80) / 70.0) as int) + 1 end)) as i from t)
    select doc_id, cast(i as int) as i, array_to_string(k[i * 70 + 1 : i * 70 + 80], '') as piece from w""")
def w1_token_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(C.token_windows(F.col("text"), 80, 10)).alias("i", "piece"))


_CHUNKS = f"""tk as (select document_id, sec_seq, page, pos, element_id, unnest(t) as tok, generate_subscripts(t, 1) as i from (select *, case when pos = min(pos) over (partition by document_id, sec_seq, page) then {_TOK} else list_prepend(chr(10) || chr(10), {_TOK}) end as t from els where type in ('text', 'formula'))),
    st as (select *, row_number() over (partition by document_id, sec_seq, page order by pos, i) - 1 as k, count(*) over (partition by document_id, sec_seq, page) as n, min(pos) over (partition by document_id, sec_seq, page) as first_pos from tk),
    wi as (select *, unnest(range(greatest(0, cast(ceil((k - 39) / 30.0) as int)), least(k // 30, case when n <= 40 then 0 else cast(ceil((n - 40) / 30.0) as int) end) + 1)) as w from st),
    ch as (select document_id, sec_seq, page, first_pos, w, regexp_replace(string_agg(tok, '' order by k), '^\\s+|\\s+$', '', 'g') as display_text, string_agg(distinct case when tok <> chr(10) || chr(10) or i > 1 then cast(element_id as varchar) end, '|' order by case when tok <> chr(10) || chr(10) or i > 1 then cast(element_id as varchar) end) as ids from wi group by all)"""


# Boxes of the windows' elements, of those with the first one's page size.
_CHUNK_BOXES = """bx as (select distinct wi.document_id, sec_seq, page, w, pos, case when (cast(wi.document_id as bigint) + pos) % 3 = 0 then 600 else 612 end as width from wi where (tok <> chr(10) || chr(10) or i > 1) and pos % 4 <> 1),
    fw as (select document_id, sec_seq, page, w, arg_min(width, pos) as width from bx group by all),
    cb as (select document_id, sec_seq, page, w, width, min(pos % 7 * 10) as x0, min(pos % 5 * 20) as y0, max(pos % 7 * 10 + 50) as x1, max(pos % 5 * 20 + 15) as y1 from bx join fw using (document_id, sec_seq, page, w, width) group by all)"""


def text_chunks(spark: SparkSession, d: str, target: int = 40, overlap: int = 10) -> DataFrame:
    e, s = elements_and_paths(spark, d)
    return C.text_chunks(e, s, target, overlap)


@query(f"""with recursive {L.SECTIONS}, {_CHUNKS}, """
    f"""{_CHUNK_BOXES} select c.document_id, c.sec_seq, c.page, cast(c.w as int) as w, display_text, ids, coalesce(path, 'Document') as section_path, cast(b.width as double) as page_width, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y1 as double) as y1
    from ch c left join secs using (document_id, sec_seq) left join cb b on b.document_id = c.document_id and b.sec_seq = c.sec_seq and b.page = c.page and b.w = c.w where display_text <> ''""")
def w2_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = text_chunks(spark, d)
    return c.select("document_id", "sec_seq", "page", F.col("window").alias("w"), "display_text", F.array_join(F.array_sort("element_ids"), "|").alias("ids"), "section_path", F.get("page_size", F.lit(0)).alias("page_width"), *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"""with recursive {L.SECTIONS}, {_CHUNKS}, al as (select document_id, sec_seq, 'text' as type, first_pos, w from ch where display_text <> '' union all select document_id, sec_seq, type, pos, 0 from els where type in ('table', 'image'))
    select document_id, sec_seq, type, first_pos, cast(w as int) as w, document_id || '::' || type || '::' || (row_number() over (partition by document_id order by sec_seq, type <> 'text', first_pos, w) - 1) as chunk_id from al""")
def w3_chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    e, s = elements_and_paths(spark, d)
    text = C.text_chunks(e, s, 40, 10).select("document_id", "sec_seq", F.lit("text").alias("type"), "first_pos", "window")
    other = e.where("type in ('table', 'image')").select("document_id", "sec_seq", "type", F.col("pos").alias("first_pos"), F.lit(0).alias("window"))
    return C.number_chunks(text.union(other)).select("document_id", "sec_seq", "type", "first_pos", F.col("window").alias("w"), "chunk_id")


@query(f"with {L.RAW} select document_id, text from els where type = 'text' and length(text) > 30 group by all having count(distinct page) >= 2")
def a1_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return C.boilerplate(R.elements(marked(spark, d)), pages=2)


@query(f"with {L.RAW}, b as (select document_id, text from els where type = 'text' and length(text) > 30 group by all having count(distinct page) >= 3) select document_id, pos, element_id from els where not exists (select 1 from b where b.document_id = els.document_id and b.text = els.text)")
def j9_without_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return C.without_boilerplate(R.elements(marked(spark, d))).select("document_id", "pos", "element_id")


@query(f"""with {L.RAW}, p as (select document_id, page, string_agg(text, ' ' order by pos) as t from els where type = 'text' and sec_seq > 0 group by all)
    select e.document_id, e.element_id, e.page, coalesce({L.strip('left(t, 600)')}, '') as nearby_text from els e left join p using (document_id, page) where e.type = 'image'""")
def j10_nearby_text(spark: SparkSession, d: str) -> DataFrame:
    return C.nearby_text(R.elements(marked(spark, d)))


@query(f"""with {L.BOXES} select document_id, page, round(min(x), 6) as x0, round(min(y), 6) as y0, round(max(x + 10), 6) as x1, round(max(y + h), 6) as y1, any_value(page_width) as width from (select *, arg_min(page_width, pos) over (partition by document_id, page) as first_width from boxes where pos <= 5 and pos % 4 <> 1) where page_width = first_width group by all""")
def a2_box_union(spark: SparkSession, d: str) -> DataFrame:
    few = F.array_sort(F.collect_list(F.when(F.col("pos") <= 5, F.struct("pos", "bbox", "page_size"))))
    b = D.lineitem_boxes(table(spark, d, "lineitem")).groupBy("document_id", "page").agg(B.union_of(few).alias("b")).where("b.page_size is not null")
    return b.select("document_id", "page", *[F.round(F.col("b.bbox")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("b.page_size")[0].cast("int").alias("width"))


_OVER = "greatest(least(a.x + 10, b.x + 10) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / greatest(10 * a.h, 1e-6)"


@query(f"with {L.BOXES} select a.id as a_id, b.id as b_id, round({_OVER}, 6) as share from (select id, x, y, h, lead({{'id': id, 'x': x, 'y': y, 'h': h}}) over (partition by document_id, page order by pos) as b from boxes) a where b is not null")
def f20_box_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = D.lineitem_boxes(table(spark, d, "lineitem"))
    nxt = Window.partitionBy("document_id", "page").orderBy("pos")
    pairs = b.withColumn("o", F.lead(F.struct("id", "bbox")).over(nxt)).where("o is not null")
    return pairs.select(F.col("id").alias("a_id"), F.col("o.id").alias("b_id"), F.round(B.overlap(F.col("bbox"), F.col("o.bbox")), 6).alias("share"))


@query(f"with {L.BOXES}, c as (select distinct a.document_id, a.page, a.id from boxes a join boxes b using (document_id, page) where a.kind = 'text' and b.kind = 'table' and round({_OVER}, 9) >= 0.5) select document_id, page, id, kind from boxes where (document_id, page, id) not in (select document_id, page, id from c)")
def j5_text_under_tables(spark: SparkSession, d: str) -> DataFrame:
    return R.suppress_text_in_tables(D.lineitem_boxes(table(spark, d, "lineitem"))).select("document_id", "page", "id", "kind")


@query("select l_suppkey as k, round(min(cast(l_quantity as double)), 6) as x0, round(min(cast(l_tax as double)), 6) as y0, round(max(cast(l_quantity as double)), 6) as x1, round(max(cast(l_tax as double)), 6) as y1 from lineitem group by all")
def f28_polygon_box(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list(F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double"))).alias("points"))
    b = p.select("k", B.of_points(F.col("points")).alias("b"))
    return b.select("k", *[F.round(F.col("b")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def _greedy(spark: SparkSession, d: str, kind: str, least: float, by_place: bool) -> DataFrame:
    b = D.lineitem_boxes(table(spark, d, "lineitem"))
    return R.match_boxes(b.where(F.col("kind").isin(kind, "text")).withColumn("found", F.col("kind") == kind), least, by_place)


def _greedy_sql(kind: str, least: float, by_place: bool) -> str:
    """Askers in order; each takes the first unused of its partners by overlap, else the first unused of the page."""
    ask, answer = ("text", kind) if by_place else (kind, "text")
    found, place = ("hit", "ask") if by_place else ("ask", "hit")
    return f"""with recursive {L.BOXES}, q as (select *, row_number() over (partition by document_id, page order by pos, id) as n from boxes where kind = '{ask}'), w as (select *, row_number() over (partition by document_id, page order by pos, id) as n from boxes where kind = '{answer}'),
    pr as (select a.document_id, a.page, a.n, b.n as m, round({_OVER}, 9) as share from q a join w b using (document_id, page)), li as (select document_id, page, n, list(m order by share desc, m) as best from pr where share > {least} group by all), fr as (select document_id, page, list(n order by n) as free from w group by all),
    s as (select document_id, page, n, coalesce(best, []) as best, free from q join fr using (document_id, page) left join li using (document_id, page, n)),
    g as (select document_id, page, 0::bigint as n, []::bigint[] as used, null::bigint as hit from fr union all
      select document_id, page, n, case when hit is null then used else list_append(used, hit) end, hit from (select s.document_id, s.page, s.n, g.used, list_filter(list_concat(s.best, s.free), lambda x: not list_contains(g.used, x))[1] as hit from g join s on s.document_id = g.document_id and s.page = g.page and s.n = g.n + 1)),
    mt as (select g.document_id, g.page, q.id as ask, w.id as hit from g join q using (document_id, page, n) join w on w.document_id = g.document_id and w.page = g.page and w.n = g.hit)
    select b.document_id, b.page, b.id as found_id, mt.{place} as place_id from boxes b left join mt on mt.document_id = b.document_id and mt.page = b.page and mt.{found} = b.id where b.kind = '{kind}'"""


@query(_greedy_sql("table", 0.0, True))
def j6_match_tables(spark: SparkSession, d: str) -> DataFrame:
    return _greedy(spark, d, "table", 0.0, True)


@query(_greedy_sql("image", 0.05, False))
def j7_match_figures(spark: SparkSession, d: str) -> DataFrame:
    return _greedy(spark, d, "image", 0.05, False)


# Tables.

def pipes(spark: SparkSession, d: str) -> DataFrame:
    return D.part_tables(table(spark, d, "part"))


@query(f"with {L.PIPES} select document_id, tbl_seq, len(string_split(markdown, chr(10))) - 2 as rows, 3 as cols from pipes")
def f9_table_shape(spark: SparkSession, d: str) -> DataFrame:
    return pipes(spark, d).select("document_id", "tbl_seq", T.data_rows("markdown").cast("long").alias("rows"), T.columns("markdown").alias("cols"))


#: Headers that found tables take in turn; some resemble each other, one has too many columns to go on with the others.
HEADERS = ["| key | part name | size |", "| key | name of part | size |", "| code | colour | maker | price | tax | total |", "| weight | colour | price |", "| . | ; |", "| key | part |"]
_FOUND = f"""nb as (select *, (row_number() over (partition by p_brand order by p_partkey) - 1) // 3 as s from part),
    ft as (select p_brand as document_id, cast(s as int) as tbl_seq, cast(s // 2 + 1 + 4 * (s // 6) as int) as page, cast(s * 37 % 10 as double) as x0, case when s % 4 = 2 then 'stream' else 'lattice' end as flavor, {HEADERS}[cast(s // 3 % {len(HEADERS)} as int) + 1] as head,
      string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |', chr(10) order by p_partkey) as body from nb group by p_brand, s)"""


def found_tables(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand as tables of three rows, two on a page, with gaps between pages and headers that change."""
    n = F.floor((F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 3)
    row = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    t = table(spark, d, "part").withColumn("s", n).groupBy(F.col("p_brand").alias("document_id"), "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    head = F.element_at(F.array(*map(F.lit, HEADERS)), (F.floor(F.col("s") / 3) % len(HEADERS)).cast("int") + 1)
    page = F.floor(F.col("s") / 2) + 1 + 4 * F.floor(F.col("s") / 6)
    return t.select("document_id", F.col("s").cast("int").alias("tbl_seq"), page.cast("int").alias("page"), (F.col("s") * 37 % 10).cast("double").alias("x0"), F.when(F.col("s") % 4 == 2, "stream").otherwise("lattice").alias("flavor"), F.concat(head, F.lit("\n| --- | --- |\n"), "body").alias("markdown"))


@query(f"""with {_FOUND}, t as (select document_id, tbl_seq, list_sort(list_distinct(regexp_extract_all(lower(head), '[a-z]+'))) as a from ft), n as (select *, lead(a) over (partition by document_id order by tbl_seq) as b from t)
    select document_id, tbl_seq, array_to_string(a, '|') as tokens, case when b is null then null when len(a) = 0 and len(b) = 0 then 1 when len(a) = 0 or len(b) = 0 then 0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end::double as alike from n""")
def f10_header_tokens(spark: SparkSession, d: str) -> DataFrame:
    # Each table against the next one of its document.
    t = found_tables(spark, d).select("document_id", "tbl_seq", T.header_tokens("markdown").alias("tokens"))
    after = F.lead("tokens").over(Window.partitionBy("document_id").orderBy("tbl_seq"))
    t = t.withColumn("after", after)
    return t.select("document_id", "tbl_seq", joined(F.array_sort("tokens")).alias("tokens"), F.when(F.col("after").isNotNull(), F.round(T.jaccard(F.col("tokens"), F.col("after")), 6)).alias("alike"))


@query(f"with {L.PIPES} select a.document_id, a.tbl_seq, a.markdown || chr(10) || array_to_string(string_split(b.markdown, chr(10))[3:], chr(10)) as markdown from pipes a join pipes b on a.document_id = b.document_id and b.tbl_seq = a.tbl_seq + 1")
def f11_append_rows(spark: SparkSession, d: str) -> DataFrame:
    a = pipes(spark, d)
    b = a.select("document_id", (F.col("tbl_seq") - 1).alias("tbl_seq"), F.col("markdown").alias("more"))
    return a.join(b, ["document_id", "tbl_seq"]).select("document_id", "tbl_seq", T.append_rows("markdown", "more").alias("markdown"))


#: Header shapes in turn: one below the separator, two above it, none to collapse, a gap and a stray line, no data rows, no separator.
_SHAPES = ["| {n} | {b} |\n| --- | --- |\n| part | name |\n| 1.5 | 2.5 | 3.5 |", "| {n} | {b} | size |\n|  | of | {s} |\n| :-- | --- | --: |\n| 4 288 | .. | {s}.5 |\n| x | y | z |", "| {n} | {b} | c |\n| --- | --- | --- |\n| 0.5 | 1.5 | .... |", "| {n} |  |\n| --- | --- |\nstray {s}\n|  | {b} |\n| 1.0 | 2.0 | 3.0 |\nafter", "| {n} | {b} |\n| --- | --- |\n| {s} | 7.5 |", "| {n} | {b} |\n| {s} | 1.5 | 2.5 |"]
_COLLAPSED = ["| {n} part | {b} name |\n| --- | --- |\n| 1.5 | 2.5 | 3.5 |", "| {n} | {b} of | size {s} |\n| :-- | --- | --: |\n| 4 288 | .. | {s}.5 |\n| x | y | z |", _SHAPES[2], "| {n} | {b} |\n| --- | --- |\n| 1.0 | 2.0 | 3.0 |\nafter", "| {n} {s} | {b} 7.5 |\n| --- | --- |", _SHAPES[5]]


def _shape_sql(shapes: list[str]) -> str:
    filled = ["'" + x.replace("\n", "' || chr(10) || '").format(n="' || p_name || '", b="' || p_brand || '", s="' || p_size || '") + "'" for x in shapes]
    return "case p_partkey % 6 " + " ".join(f"when {i} then {x}" for i, x in enumerate(filled)) + " end"


@query(f"select p_partkey as k, {_shape_sql(_COLLAPSED)} as markdown from part")
def f12_collapse_headers(spark: SparkSession, d: str) -> DataFrame:
    shaped = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % 6).cast("int") + 1)
    for name, column in (("{n}", "p_name"), ("{b}", "p_brand"), ("{s}", "p_size")):
        shaped = F.replace(shaped, F.lit(name), F.col(column).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.collapse_headers(shaped).alias("markdown"))


@query("select p_partkey as k, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' as markdown from part")
def f13_rows_to_table(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array(F.lit("name"), F.lit("size")), F.array("p_name", F.col("p_size").cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.from_rows(rows).alias("markdown"))


@query(f"""with {L.PIPES}, s as (select *, string_split(markdown, chr(10)) as ls from pipes) select document_id, tbl_seq, '<!-- total rows incl. header+sep: ' || len(ls) || ' -->' || chr(10) || '<!-- pages ' || page || '-' || (page + 1) || ' -->' || chr(10) ||
    case when len(ls) <= 8 then markdown else array_to_string(ls[1:5], chr(10)) || chr(10) || '...' || chr(10) || array_to_string(ls[len(ls) - 2 :], chr(10)) end as snippet from s""")
def f14_describe_snippet(spark: SparkSession, d: str) -> DataFrame:
    return pipes(spark, d).select("document_id", "tbl_seq", T.describe_snippet("markdown", F.col("page"), F.col("page") + 1, rows=3).alias("snippet"))


@query(f"""with {L.PIPES}, r as (select document_id, tbl_seq, unnest(string_split(markdown, chr(10))[3:]) as line, generate_subscripts(string_split(markdown, chr(10))[3:], 1) as i from pipes),
    f as (select document_id, tbl_seq, trim(string_split(line, '|')[3]) as label, i, row_number() over (partition by document_id, tbl_seq, lower(trim(string_split(line, '|')[3])) order by i) as n from r)
    select document_id, tbl_seq, 'Key indicators: part name; ' || string_agg(label, '; ' order by i) as said from f where n = 1 and length(label) >= 5 group by all""")
def f15_table_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return pipes(spark, d).select("document_id", "tbl_seq", T.descriptor("markdown").alias("said"))


# Tables of ten rows and large ones, with and without caption and description, on one page and on two.
_TABLES = f"""{L.PIPES}, {_BIG}, tb as (select document_id, tbl_seq, page, markdown from pipes union all select 'n' || document_id, 0, 1, markdown from big),
    li as (select document_id, tbl_seq, unnest(string_split(markdown, chr(10))) as line, generate_subscripts(string_split(markdown, chr(10)), 1) as i from tb),
    la as (select document_id, tbl_seq, i, trim(string_split(line, '|')[3]) as label from li where i <> 2), di as (select *, row_number() over (partition by document_id, tbl_seq, lower(label) order by i) as n from la where length(label) >= 5),
    ds as (select document_id, tbl_seq, 'Key indicators: ' || string_agg(label, '; ' order by r) as labels from (select *, row_number() over (partition by document_id, tbl_seq order by i) as r from di where n = 1) where r <= 25 group by all),
    pt as (select tb.*, case tbl_seq % 3 when 0 then 'parts of ' || document_id when 1 then '' end as caption, case when tbl_seq % 2 = 1 then 'about table ' || tbl_seq else labels end as said, page + tbl_seq % 2 as hi, len(string_split(markdown, chr(10))) - 2 as rows from tb left join ds using (document_id, tbl_seq)),
    he as (select *, '[Table on ' || case when hi > page then 'pp.' || page || '-' || hi else 'p.' || page end || ']' || case when caption <> '' then ' ' || caption else '' end as head, case when rows > 100 then array_to_string(string_split(markdown, chr(10))[1:32], chr(10)) else markdown end as shown from pt)"""


@query(f"""with {_TABLES} select document_id, tbl_seq, rows, rows > 100 as truncated, concat_ws(chr(10), head, said, left(shown, 3000)) as embed, concat_ws(chr(10) || chr(10), head, said, shown, case when rows > 100 then chr(10) || '[Full table has ' || (rows - 30) || ' more rows]' end) as display from he""")
def f16_table_chunks(spark: SparkSession, d: str) -> DataFrame:
    big = _big_tables(spark, d).select(F.concat(F.lit("n"), F.col("document_id").cast("string")).alias("document_id"), F.lit(0).alias("tbl_seq"), F.lit(1).alias("page"), "markdown")
    t, k = pipes(spark, d).select("document_id", "tbl_seq", "page", "markdown").unionByName(big), F.col("tbl_seq")
    caption = F.when(k % 3 == 0, F.concat(F.lit("parts of "), "document_id")).when(k % 3 == 1, F.lit(""))
    said = F.when(k % 2 == 1, F.concat(F.lit("about table "), k.cast("string")))
    made = C.table_chunk(F.col("markdown"), F.coalesce(caption, F.lit("")), said, F.col("page"), F.col("page") + k % 2)
    return t.withColumn("c", made).select("document_id", "tbl_seq", F.col("c.rows").cast("long").alias("rows"), "c.truncated", "c.embed", "c.display")


_IMAGES = f"""{L.RAW}, im as (select *, case when pos % 4 = 0 then '' else text end as c, case when pos % 5 = 0 then 'seen ' || pos else '' end as d, case when pos % 6 = 0 then 'img.png' else '' end as f, case when pos % 7 = 0 or pos % 4 = 0 then '' else 'Sec ' || sec_seq end as s, case when pos % 3 = 0 then repeat('near ' || pos || ' ', 90) else '' end as n from els where type = 'image')"""


@query(f"""with {_IMAGES}, h as (select *, case when pos % 2 = 0 then '[Vector chart/diagram on p.' else '[Figure on p.' end || page || ']' || case when c <> '' then ' ' || c else '' end as head from im)
    select document_id, element_id, case when f || c || s <> '' then head || chr(10) || case when d <> '' then d else 'Section: ' || case when s <> '' then s else 'Document' end || chr(10) || case when n <> '' then 'Nearby text: ' || left(n, 500) || chr(10) else '' end || 'Visual analysis available on demand.' end end as embed,
    case when f || c || s <> '' then head || case when d <> '' then chr(10) || d when pos % 8 > 0 then chr(10) || '(Visual analysis available on demand)' else '' end end as display from h""")
def f17_image_chunks(spark: SparkSession, d: str) -> DataFrame:
    k, no = F.col("pos"), F.lit("")
    named = {
        "caption": F.when(k % 4 == 0, no).otherwise(F.col("text")),
        "description": F.when(k % 5 == 0, F.concat(F.lit("seen "), k.cast("string"))),
        "path": F.when(k % 6 == 0, F.lit("img.png")),
        "section": F.when((k % 7 > 0) & (k % 4 > 0), F.concat(F.lit("Sec "), F.col("sec_seq").cast("string"))),
        "nearby": F.when(k % 3 == 0, F.repeat(F.concat(F.lit("near "), k.cast("string"), F.lit(" ")), 90)),
    }
    made = C.image_chunk(*(named[n] for n in named), F.col("page"), k % 2 == 0, k % 8 == 0)
    return R.elements(marked(spark, d)).where("type = 'image'").withColumn("c", made).select("document_id", "element_id", "c.embed", "c.display")


_GARBLED = r"""g as (select doc_id, ws, coalesce(ws[1], 'a') || '@' || coalesce(ws[2], 'b') || coalesce(ws[3], 'c') as x, coalesce(ws[4], 'd') as y from (select doc_id, regexp_extract_all(coalesce(replace(text, '|', '/'), ''), '[^ \t\n\r\f]+') as ws from documents)),
    o as (select *, (length(x) > 15 and regexp_matches(x, '[^\pL\pM\p{Nd}\p{Pc}\s]'))::int as ox, (length(y) > 15 and regexp_matches(y, '[^\pL\pM\p{Nd}\p{Pc}\s]'))::int as oy from g)"""


@query(f"with {_GARBLED} select doc_id, case doc_id % 4 when 0 then ox = 1 when 1 then ox + oy = 2 else false end as dropped from o")
def p10_phantom_tables(spark: SparkSession, d: str) -> DataFrame:
    # One cell; a header and a row; two columns; two rows. Only the first two shapes can be phantoms.
    ws = F.regexp_extract_all(F.coalesce(F.replace(F.col("text"), F.lit("|"), F.lit("/")), F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0))
    word = lambda i, other: F.coalesce(F.get("ws", F.lit(i)), F.lit(other))
    x, y, k = F.concat(word(0, "a"), F.lit("@"), word(1, "b"), word(2, "c")), word(3, "d"), F.col("doc_id") % 4
    rule, end = F.lit(" |\n| --- |"), F.lit(" |")
    md = F.when(k == 0, F.concat(F.lit("| "), x, rule)).when(k == 1, F.concat(F.lit("| "), x, rule, F.lit("\n| "), y, end)).when(k == 2, F.concat(F.lit("| "), x, F.lit(" | "), x, F.lit(" |\n| --- | --- |"))).otherwise(F.concat(F.lit("| "), x, rule, F.lit("\n| "), x, F.lit(" |\n| "), x, end))
    # Each text is read once, and each table made once, in a projection of its own.
    return table(spark, d, "documents").select("doc_id", ws.alias("ws")).select("doc_id", md.alias("md")).select("doc_id", T.phantom("md").alias("dropped"))


@query(f"""with recursive {_FOUND}, sh as (select *, len(string_split(head, '|')) - 2 as cols, list_distinct(regexp_extract_all(head, '[a-z]+')) as words, row_number() over (partition by document_id order by page, x0, tbl_seq) as k from ft),
    al as (select document_id, k, page, 0 as island, cols, words from sh where k = 1 union all
      select document_id, k, page, case when same then island else island + 1 end, case when same then cols else c2 end, case when same then words else w2 end from (
        select s.document_id, s.k, s.page, a.island, a.cols, a.words, s.cols as c2, s.words as w2, abs(s.cols - a.cols) <= 2 and abs(s.page - a.page) <= 2 and (len(s.words) = 0 or len(a.words) = 0 or len(list_intersect(s.words, a.words)) / len(list_distinct(list_concat(s.words, a.words))) >= 0.3) as same
        from al a join sh s on s.document_id = a.document_id and s.k = a.k + 1)),
    pt as (select sh.*, island, row_number() over (partition by sh.document_id, island order by sh.k) as i from sh join al using (document_id, k))
    select document_id, island, cast(min(page) as int) as page_lo, cast(arg_max(page, k) as int) as page_hi, case when bool_or(flavor = 'stream') then 'stream' else 'lattice' end as flavor, count(*) as tables, string_agg(case when i = 1 then head || chr(10) || '| --- | --- |' || chr(10) || body else body end, chr(10) order by k) as markdown from pt group by document_id, island""")
def w5_merge_tables(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_tables(found_tables(spark, d))


@query("""with f as (select cast(l_suppkey as varchar) as document_id, l_linenumber as page, case when l_quantity > 25 then 'stream' else 'lattice' end as flavor, l_orderkey % 3 as cols, l_orderkey as k from lineitem)
    select * from f where flavor = 'stream' or (document_id, page) not in (select document_id, page from f where flavor = 'stream' and cols > 1)""")
def w6_choose_flavor(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_quantity") > 25, "stream").otherwise("lattice").alias("flavor"), (F.col("l_orderkey") % 3).alias("cols"), F.col("l_orderkey").alias("k"))
    return I.choose_flavor(f)


@query(f"""with {L.RAW}, p as (select document_id, page, count_if(contains(text, '|') and length(text) >= 12) as pipe, count_if(contains(text, chr(9))) as tabs,
      count_if(not contains(text, chr(9)) and length(text) >= 12 and len(list_filter(string_split(text, '  '), lambda c: trim(c) <> '')) >= 3 and len(list_filter(string_split(text, '  '), lambda c: trim(c) <> '' and regexp_matches(c, '[0-9]'))) >= 2) as nums from raw where trim(text) <> '' group by all)
    select document_id, coalesce(string_agg(case when f then cast(page as varchar) end, '|' order by page), '') as detected, coalesce(string_agg(case when not f then cast(page as varchar) end, '|' order by page), '') as skipped from (select *, pipe >= 3 or tabs >= 3 or nums >= 2 as f from p) group by all""")
def a11_table_pages(spark: SparkSession, d: str) -> DataFrame:
    found = Q.table_pages(D.raw_elements(table(spark, d, "documents")).withColumnRenamed("text", "line"))
    return found.select("document_id", joined(F.col("detected").cast("array<string>")).alias("detected"), joined(F.col("skipped").cast("array<string>")).alias("skipped"))


# Quality.

def _covered(spark: SparkSession, d: str) -> DataFrame:
    raw = D.raw_elements(table(spark, d, "documents"))
    expected = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("expected_pages"), F.when(F.col("doc_id") % 2 == 0, "hi_res").otherwise("fast").alias("route"))
    return Q.coverage(raw, expected)


_COVER = f"""with {L.RAW}, ex as (select cast(doc_id as varchar) as document_id, cast(doc_id % 4 + 1 as int) as expected_pages from documents), us as (select distinct document_id, page from raw where length(text) >= 40 or category in ('Image', 'Figure', 'Table')),
    mi as (select e.document_id, e.expected_pages, p.p from ex e, (select unnest(range(1, 6)) as p) p where p.p <= e.expected_pages and not exists (select 1 from us where us.document_id = e.document_id and us.page = p.p))"""


@query(f"{_COVER} select e.document_id, coalesce(string_agg(cast(m.p as varchar), '|' order by m.p), '') as missing from ex e left join mi m using (document_id) group by all")
def a8_missing_pages(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d).select("document_id", joined(F.col("missing").cast("array<string>")).alias("missing"))


@query(
    f"""{_COVER}, {L.suspicious('raw', 'document_id, pos')}, tp as (select document_id, count(distinct page) filter (length(text) >= 40) as texts, count(distinct page) filter (category in ('Image', 'Figure', 'Table')) as images, count(distinct page) filter (length(text) >= 40 or category in ('Image', 'Figure', 'Table')) as seen, sum(length(text)) as chars, count(*) as n from raw group by 1),
    su as (select document_id, count(*) as k from suspect group by 1), g as (select document_id, expected_pages, coalesce(texts, 0) as texts, coalesce(images, 0) as images, coalesce(seen, 0) as seen, coalesce(chars, 0) as chars, coalesce(n, 0) as n, coalesce(k, 0) as k from ex left join tp using (document_id) left join su using (document_id))
    select document_id, case when texts = 0 and images = 0 then 'no usable text or images' else concat_ws('|', case when expected_pages > seen then (expected_pages - seen) || ' of ' || expected_pages || ' pages without usable text or image' end,
      case when chars > 0 and k > 0.25 * greatest(n, 1) then 'text looks garbled or repeated' end, case when chars = 0 and images > 0 then 'only images, no text' end, case when cast(document_id as bigint) % 2 = 0 and texts = 0 and images > 0 then 'recognition gave no text' end) end as warnings from g"""
)
def a9_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.quality_gate(_covered(spark, d)).select("document_id", joined("warnings").alias("warnings"))


@query(f"{_COVER}, r as (select e.document_id, count(m.p) / any_value(e.expected_pages) as s from ex e left join mi m using (document_id) group by all) select document_id, round(s, 6) as missing_share, case when s >= 0.5 then 'document' when s >= 0.1 then 'pages' else 'none' end as retry from r")
def a10_retry_decision(spark: SparkSession, d: str) -> DataFrame:
    return Q.retry_decision(_covered(spark, d)).select("document_id", F.round("missing_share", 6).alias("missing_share"), "retry")


@query("""with s as (select l_suppkey as document_id, case l_returnflag when 'R' then 'preflight' else 'parse' end as stage, case when l_orderkey % 97 = 0 then 'error' when l_orderkey % 89 = 0 then 'timeout' when l_orderkey % 83 = 0 then 'crash' when l_orderkey % 5 = 0 then 'warning' else 'ok' end as result, l_linestatus as status from lineitem),
    g as (select document_id, case when count_if(stage = 'preflight' and result = 'error') > 0 then max(case when stage = 'preflight' and result = 'error' then status end) when count_if(result = 'timeout') > 0 then 'resource_limit' when count_if(result = 'crash') > 0 then 'parser_failure' when count_if(result = 'warning') > 0 then 'partial' else 'ready' end as status from s group by 1)
    select *, status in ('parser_failure', 'resource_limit') as retryable from g""")
def a14_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    result = F.when(k % 97 == 0, "error").when(k % 89 == 0, "timeout").when(k % 83 == 0, "crash").when(k % 5 == 0, "warning").otherwise("ok")
    return Q.outcomes(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.when(F.col("l_returnflag") == "R", "preflight").otherwise("parse").alias("stage"), result.alias("result"), F.col("l_linestatus").alias("status")))


@query(f"with {L.RAW}, n as (select document_id, pos, page, 'again' as text from raw where page = 2) select document_id, pos, page, text from raw where (document_id, page) not in (select document_id, page from n) union all select * from n")
def u4_replace_pages(spark: SparkSession, d: str) -> DataFrame:
    raw = D.raw_elements(table(spark, d, "documents")).select("document_id", "pos", "page", "text")
    return R.replace_pages(raw, raw.where("page = 2").withColumn("text", F.lit("again")))


# Index.

_WORDS = """regexp_extract_all(lower({}), '[A-Za-z][A-Za-z\\-'']+')"""
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""with w as (select doc_id, unnest({_WORDS.format('text')}) as w from documents), c as (select doc_id, w, count(*) as n from w where length(w) >= 4 and w not in ({_STOP}) group by all), r as (select *, row_number() over (partition by doc_id order by n desc, w) as r from c)
    select doc_id, string_agg(w, '|' order by r) as keywords from r where r <= 8 group by 1""")
def a4_keywords(spark: SparkSession, d: str) -> DataFrame:
    return I.keywords(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", joined("keywords").alias("keywords"))


@query(f"with {L.RAW}, c as (select document_id, sec_seq, type, count(*) as n from els group by all) select document_id, sec_seq, string_agg(type || '=' || n, ',' order by type) as counts, bool_or(type = 'table') as has_tables, bool_or(type = 'image') as has_figures from c group by all")
def a3_element_counts(spark: SparkSession, d: str) -> DataFrame:
    c = I.element_counts(R.elements(marked(spark, d)))
    entries = F.transform(F.map_entries("element_counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return c.select("document_id", "sec_seq", joined(entries, ",").alias("counts"), "has_tables", "has_figures")


def entries(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    return I.sections_index(s, e)


_ENTRIES = f"""bo as (select document_id, sec_seq, left(string_agg({L.strip('text')}, chr(10) || chr(10) order by pos), 4000) as body from els where type in ('text', 'formula') group by all),
    en as (select s.*, coalesce(body, '') as body, case when coalesce(body, '') <> '' then body else title end as source from secs s left join bo using (document_id, sec_seq)),
    kw as (select document_id, sec_seq, string_agg(w, '|' order by r) as keywords from (select *, row_number() over (partition by document_id, sec_seq order by n desc, w) as r from (select document_id, sec_seq, w, count(*) as n from (select document_id, sec_seq, unnest({_WORDS.format('source')}) as w from en) where length(w) >= 4 and w not in ({_STOP}) group by all)) where r <= 8 group by all),
    ix as (select en.document_id, en.sec_seq, en.sec_id, en.title, en.path, en.level, en.page_lo, en.page_hi, coalesce(kw.keywords, '') as keywords,
      left(array_to_string(string_split(regexp_replace({L.strip("regexp_replace(body, '[ \\t\\n\\r\\f]+', ' ', 'g')")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))[1:2], ' '), 280) as summary from en left join kw using (document_id, sec_seq))"""


@query(f"with recursive {L.SECTIONS}, {_ENTRIES} select document_id, sec_seq, title, keywords, summary from ix")
def a5_sections_index(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("document_id", "sec_seq", "title", joined("keywords").alias("keywords"), "summary")


#: What a model says of each document, with blanks, overlong values and gaps; every fifth says nothing.
_SAID = """said as (select cast(doc_id as varchar) as document_id, case when doc_id % 3 > 0 then ' Report ' end as doc_type, case when doc_id % 4 > 0 then upper(coalesce(lang, '')) || '-long-tag' end as language, repeat('Title ' || source || ' ', 50) as inferred_title,
    case when doc_id % 2 = 0 then list_concat([' ' || source || ' ', '  ', null], list_transform(range(0, 30), lambda i: 'author ' || i)) end as inferred_authors, text as abstract from documents where doc_id % 5 > 0)"""


def said(spark: SparkSession, d: str) -> DataFrame:
    docs, k = table(spark, d, "documents").where("doc_id % 5 > 0"), F.col("doc_id")
    authors = F.concat(F.array(F.concat(F.lit(" "), "source", F.lit(" ")), F.lit("  "), F.lit(None).cast("string")), F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("author "), i.cast("string"))))
    return docs.select(k.cast("string").alias("document_id"), F.when(k % 3 > 0, " Report ").alias("doc_type"), F.when(k % 4 > 0, F.concat(F.upper(F.coalesce("lang", F.lit(""))), F.lit("-long-tag"))).alias("language"), F.repeat(F.concat(F.lit("Title "), "source", F.lit(" ")), 50).alias("inferred_title"), F.when(k % 2 == 0, authors).alias("inferred_authors"), F.col("text").alias("abstract"))


_META = f"""{_SAID}, n as (select document_id, count(*) as num_sections from secs group by 1),
    ft as (select e.document_id, coalesce(string_agg(case when type = 'image' then left(text, 200) end, '|' order by pos), '') as figures, coalesce(string_agg(case when type = 'table' then left(text, 200) end, '|' order by pos), '') as tables, list_sort(list(distinct page) filter (type = 'image')) as visual, coalesce(any_value(num_sections), 0) as num_sections from els e left join n using (document_id) group by 1),
    meta as (select ft.document_id, figures, tables, coalesce(visual, []) as visual, num_sections, coalesce(nullif(lower(trim(doc_type)), ''), 'other') as doc_type, coalesce(left(lower(trim(language)), 8), '') as language, coalesce(left({L.strip('inferred_title')}, 300), '') as title,
      coalesce(array_to_string(list_filter(list_transform(inferred_authors, lambda x: trim(x)), lambda x: x <> '')[1:20], '|'), '') as authors, coalesce(left({L.strip('abstract')}, 500), '') as abstract from ft left join said using (document_id))"""


def document_metas(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    return I.document_meta(e, s, said(spark, d))


@query(f"with recursive {L.SECTIONS}, {_META} select document_id, figures, tables, array_to_string(visual, '|') as visual, num_sections, doc_type, language, title, authors, abstract from meta")
def a6_document_meta(spark: SparkSession, d: str) -> DataFrame:
    m = document_metas(spark, d)
    captions = lambda c: joined(F.transform(c, lambda x: x["caption"]))
    return m.select("document_id", captions("figure_index").alias("figures"), captions("table_index").alias("tables"), joined(F.col("visual_pages").cast("array<string>")).alias("visual"), "num_sections", "doc_type", "language", F.col("inferred_title").alias("title"), joined("inferred_authors").alias("authors"), "abstract")


_WIDE = "[\u00c0-\u024f\u0370-\u1fff\u2c00-\ud7ff]"  # letters that end no word, but that RE2's \\b takes for its end
_NAMED = "list_sort(list_distinct(regexp_extract_all(t, '{}')))"


@query(
    f"""with recursive {L.SECTIONS}, {_ENTRIES}, n as (select document_id, regexp_replace(string_agg(concat_ws(' ', title, summary, replace(keywords, '|', ' ')), ' ' order by sec_seq), '{_WIDE}', 'z', 'g') as t, flatten(list(list_append(case when keywords = '' then [] else string_split(keywords, '|') end, title))) as names from ix group by 1)
    select document_id, array_to_string({_NAMED.format('\\b[A-Z]{1,3}[_-]?[A-Z0-9][A-Z0-9_-]*\\b')}, '|') as codes, array_to_string(list_filter({_NAMED.format('\\b[A-Z]{2,4}\\b')}, lambda a: not list_contains({I.COMMON}, a)), '|') as abbreviations,
      array_to_string({_NAMED.format('\\b[A-Z][a-z]{2}-[0-9]{2}\\b')}, '|') as date_formats, array_to_string({_NAMED.format('(?i)\\b[0-9]+\\s+[A-Z]+\\s+[0-9]+\\b|\\bpart\\s+number\\s+\\w+\\b')}, '|') as identifiers,
      concat_ws('|', case when regexp_matches(t, '(?i)\\bpercent(age)?\\b') then 'percentages' end, case when regexp_matches(t, '(?i)\\brate\\b') then 'rates' end, case when regexp_matches(t, '(?i)\\b(time\\s+)?series\\b') then 'time series' end,
        case when regexp_matches(t, '(?i)\\b(monetary|currency|money|amount|value)\\b') then 'monetary values' end, case when regexp_matches(t, '(?i)\\b(code|identifier)\\b') then 'codes' end) as data_types,
      array_to_string(list_sort(list_distinct(list_filter(names, lambda x: regexp_matches(regexp_replace(x, '{_WIDE}', '_', 'g'), '^[A-Z][a-z]+(\\s+[A-Z][a-z]+)+\\b'))))[1:10], '|') as entities from n"""
)
def a12_terminology(spark: SparkSession, d: str) -> DataFrame:
    t = I.terminology(entries(spark, d))
    return t.select("document_id", *[joined(c).alias(c) for c in ("codes", "abbreviations", "date_formats", "identifiers", "data_types", "entities")])


@query(f"""with recursive {L.SECTIONS}, {_ENTRIES}, r as (select *, row_number() over (partition by document_id order by sec_seq) as n from ix), {_META},
    tc as (select document_id, string_agg('- [' || document_id || ':' || sec_id || '] ' || path || '  (pp. ' || page_lo || '-' || page_hi || ')' || case when left(summary, 200) <> '' then chr(10) || '    summary: ' || left(summary, 200) else '' end || case when keywords <> '' then chr(10) || '    keywords: ' || array_to_string(string_split(keywords, '|')[1:6], ', ') else '' end, chr(10) order by n) as toc from r where n <= 20 group by 1)
    select document_id, toc, case when m.document_id is null or cast(document_id as bigint) % 7 = 0 then '(document meta unavailable)' else 'doc_type: ' || doc_type || chr(10) || 'title: ' || title || case when abstract <> '' then chr(10) || 'abstract: ' || {L.strip('abstract')} else '' end || case when len(visual) > 0 then chr(10) || 'visual_pages: ' || array_to_string(visual[1:30], ', ') else '' end end as meta from tc left join meta m using (document_id)""")
def k4_table_of_contents(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    metas = I.document_meta(e, s, said(spark, d)).where("cast(document_id as bigint) % 7 > 0")
    return I.table_of_contents(I.sections_index(s, e), metas)


@query(f"""with recursive {L.SECTIONS}, {_META} select document_id, 'section' as kind, sec_id as value from secs where cast(document_id as bigint) % 3 < 2 and cast(document_id as bigint) % 5 > 0
    union all select document_id, 'meta', cast(num_sections as varchar) || ' sections, ' || title from meta where cast(document_id as bigint) % 3 < 2 and cast(document_id as bigint) % 4 > 0""")
def j21_backfill(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id")
    state = docs.select("document_id", F.when(F.col("doc_id") % 3 == 0, "ready").when(F.col("doc_id") % 3 == 1, "partial").otherwise("error").alias("status"))
    index = I.backfill(state, docs.where("doc_id % 5 = 0"), s).select("document_id", F.lit("section").alias("kind"), F.col("sec_id").alias("value"))
    metas = I.backfill(state, docs.where("doc_id % 4 = 0"), I.document_meta(e, s, said(spark, d)))
    return index.unionByName(metas.select("document_id", F.lit("meta").alias("kind"), F.concat(F.col("num_sections").cast("string"), F.lit(" sections, "), "inferred_title").alias("value")))


#: Answers of a model for a language's documents, in batches of JSON: some cut off, some fenced, some without a document block.
_RESPONSES = """rs as (select coalesce(lang, 'none') as document_id, doc_id as batch, 's' || (n_chars % 3) as sec_id, case when doc_id % 6 > 0 then ' ' || source || ' said ' end as summary, doc_id % 4 > 0 as parsed, case when doc_id % 7 = 3 then 'type ' || source end as doc_type from documents where n_chars % 3 < 2)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    docs, k = table(spark, d, "documents").where("n_chars % 3 < 2"), F.col("doc_id")
    section = F.struct(F.concat(F.lit(" s"), (F.col("n_chars") % 3).cast("string")).alias("id"), F.when(k % 6 > 0, F.concat(F.lit(" "), "source", F.lit(" said "))).alias("summary"), F.array(F.lit(" k "), F.lit(" "), F.col("source")).alias("keywords"))
    answer = F.to_json(F.struct(F.when(k % 7 == 3, F.struct(F.concat(F.lit("type "), "source").alias("doc_type"))).alias("document"), F.array(section).alias("sections")))
    text = F.when(k % 4 == 0, F.concat(F.lit("sorry, "), F.substring(answer, 2, 20))).when(k % 4 == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    return docs.select(F.coalesce("lang", F.lit("none")).alias("document_id"), k.alias("batch"), text.alias("response"))


@query(f"""with {_RESPONSES}, l as (select document_id, sec_id, trim(coalesce(arg_max(coalesce(summary, ''), batch), '')) as summary, arg_max(source_, batch) as source_ from (select rs.*, documents.source as source_ from rs join documents on doc_id = batch) where parsed group by all),
    b as (select document_id, arg_min(doc_type, batch) filter (doc_type is not null) as doc_type from rs where parsed group by 1),
    f as (select distinct coalesce(lang, 'none') as document_id, unnest(['s0', 's1', 's2']) as sec_id from documents)
    select f.document_id, f.sec_id, case when l.sec_id is null then 'none' else l.summary end as summary, case when l.sec_id is null then 'x' else 'k|' || source_ end as keywords, doc_type from f left join l using (document_id, sec_id) left join b using (document_id)""")
def a16_merge_answers(spark: SparkSession, d: str) -> DataFrame:
    parsed = stored(I.parse_answers(responses(spark, d)))
    fallback = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("document_id")).distinct().withColumn("sec_id", F.explode(F.array(F.lit("s0"), F.lit("s1"), F.lit("s2")))).withColumn("summary", F.lit("none")).withColumn("keywords", F.array(F.lit("x")))
    merged = I.merge_answers(I.section_answers(parsed), fallback)
    blocks = I.document_blocks(parsed).select("document_id", "doc_type")
    return merged.join(blocks, "document_id", "left").select("document_id", "sec_id", "summary", joined("keywords").alias("keywords"), "doc_type")


@query(
    f"""with recursive {L.SECTIONS}, bo as (select document_id, sec_seq, left(string_agg({L.strip('text')}, chr(10) || chr(10) order by pos), 1200) as text from els where type in ('text', 'formula') group by all),
    tc as (select document_id, sec_seq, '- id=' || sec_id || ' | ' || path as text from secs), n as (select tc.document_id, tc.sec_seq, (select len({_TOK.replace('text', 'tc.text')})) as toc_n, coalesce(len({_TOK.replace('text', 'bo.text')}), 0) as n from tc left join bo using (document_id, sec_seq)),
    o as (select *, row_number() over (partition by document_id order by sec_seq) as k, sum(toc_n) over (partition by document_id) as base from n),
    f as (select document_id, sec_seq, k, 0 as batch, n as used, 1 as held from o where k = 1 union all
      select o.document_id, o.sec_seq, o.k, case when held >= 5 or base + used + n > 400 then batch + 1 else batch end, case when held >= 5 or base + used + n > 400 then n else used + n end, case when held >= 5 or base + used + n > 400 then 1 else held + 1 end from f join o on o.document_id = f.document_id and o.k = f.k + 1)
    select document_id, sec_seq, batch from f"""
)
def w14_prompt_packing(spark: SparkSession, d: str) -> DataFrame:
    e, s = parts(spark, d)
    full = s.join(I.bodies(e, 1200), ["document_id", "sec_seq"], "left")
    toc = F.concat(F.lit("- id="), "sec_id", F.lit(" | "), "path")
    return I.pack_sections(full.select("document_id", "sec_seq", toc.alias("toc"), F.coalesce("body", F.lit("")).alias("body")), budget=400, most=5)


@query("""with recursive b as (select page_id, url, html, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) as h from pages) select cast(page_id as varchar) as document_id, count(*) as headings from (select page_id, unnest(h) as x from b) group by 1""")
def s2_page_elements(spark: SparkSession, d: str) -> DataFrame:
    e = D.page_elements(table(spark, d, "pages"))
    return e.where("category_depth = 1").groupBy("document_id").agg(F.count("*").alias("headings"))
