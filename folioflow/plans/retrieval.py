"""Queries over retrieval operators, on chunk vectors and queries that the given tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import store as S
from ..sources.scratch import shared_dir, stored
from . import ingestion as N
from . import sql as L
from .registry import query, table

# Vectors as chunks: a label is a document, every 50th vector a query over its own label and the next.
_VEC = """ch as (select cast(vec_id as varchar) as chunk_id, cast(label as varchar) as document_id, embedding from embeddings where label is not null),
    qs as (select vec_id as query_id, cast((label + k) % 10 as varchar) as document_id, k as doc_pos, embedding as vector from embeddings, (values (0), (1)) t(k) where vec_id % 50 = 0 and label is not null),
    sc as (select query_id, chunk_id, ch.document_id, round(list_cosine_similarity(cast(vector as double[]), cast(embedding as double[])), 6) as score from qs join ch using (document_id)),
    hits as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc)"""


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label is not null").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0 and label is not null").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return q.select(F.col("vec_id").alias("query_id"), ((F.col("label") + F.col("k")) % 10).cast("string").alias("document_id"), F.col("embedding").alias("vector"))


def vector_hits(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    return R.vector_search(chunk_vectors(spark, d), vector_queries(spark, d), k)


@query(f"with {_VEC} select query_id, chunk_id, document_id, score, rank from hits where rank <= 8")
def j1_vector_search(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(spark, d)


# Documents as chunks: a source is a document, its languages are sections, each row a chunk; 150 ids in a row are the hits of a query.
_HITS = """hits as (select doc_id // 150 as query_id, row_number() over (partition by doc_id // 150 order by n_chars desc, doc_id) as pos, 'c' || (doc_id % 100) as chunk_id, source as document_id, lang as section_path, cast(doc_id % 9 + 1 as int) as page,
    case doc_id % 3 when 0 then 'text' when 1 then 'image' else 'table' end as type, round((doc_id % 100) / 100.0, 6) as score, text as display_text, text as text_for_embedding from documents where text is not null)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").withColumn("query_id", F.floor(F.col("doc_id") / 150))
    k = F.col("doc_id")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.select(
        "query_id",
        pos.alias("pos"),
        F.concat(F.lit("c"), (k % 100).cast("string")).alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.col("lang").alias("section_path"),
        (k % 9 + 1).cast("int").alias("page"),
        F.when(k % 3 == 0, "text").when(k % 3 == 1, "image").otherwise("table").alias("type"),
        F.round((k % 100) / 100.0, 6).alias("score"),
        F.col("text").alias("display_text"),
        F.col("text").alias("text_for_embedding"),
    )


_CHUNKS = "chunks as (select 'c' || doc_id as chunk_id, source as document_id, lang as section_path, cast(doc_id % 9 + 1 as int) as page from documents)"
_WANTED = "wanted as (select distinct item_id as query_id, 'src' || (item_id * 3 + k) % 20 as document_id, case when item_id % 2 = 0 then 'en' else 'fr' end as section_path from benchmark, (values (0), (1), (2)) t(k))"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("section_path"), (F.col("doc_id") % 9 + 1).cast("int").alias("page"))


def wanted(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), ((F.col("item_id") * 3 + F.col("k")) % 20).cast("string")).alias("document_id"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("section_path"))


@query(f"with {_CHUNKS}, {_WANTED} select query_id, document_id, section_path, chunk_id, page, rank, 1.0::double as score from (select *, row_number() over (partition by query_id order by page, chunk_id) as rank from chunks join wanted using (document_id, section_path)) where rank <= 40")
def j2_structural_fetch(spark: SparkSession, d: str) -> DataFrame:
    return R.structural_fetch(chunks(spark, d), wanted(spark, d))


@query(f"""with {_CHUNKS}, {_WANTED}, n as (select query_id, count(distinct document_id) as n from wanted group by 1), r as (select *, row_number() over (partition by query_id, document_id order by page, chunk_id) as r from chunks join wanted using (document_id, section_path)),
    q as (select r.* from r join n using (query_id) where r.r <= greatest(8, 30 // n.n)) select query_id, document_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by document_id, page, chunk_id) as rank from q) where rank <= 30""")
def j3_structural_quota(spark: SparkSession, d: str) -> DataFrame:
    return R.structural_fetch(chunks(spark, d), wanted(spark, d), 30, quota=True).select("query_id", "document_id", "chunk_id", "rank")


_ASKED = """asked as (select item_id as query_id, k as pos, case k when 0 then cast(item_id as varchar) || ':s1' when 1 then 's2' else cast(item_id + 5 as varchar) || ':s9999' end as section_id, [cast(item_id as varchar), cast(item_id + 1 as varchar)] as document_ids from benchmark, (values (0), (1), (2)) t(k))"""


@query(f"""with recursive {L.SECTIONS}, {_ASKED}, named as (select query_id, pos, s.document_id, s.path from asked a join secs s on s.document_id = split_part(a.section_id, ':', 1) and s.sec_id = split_part(a.section_id, ':', 2) where list_contains(a.document_ids, s.document_id)),
    rest as (select query_id, s.document_id, s.path from (select query_id, section_id, unnest(document_ids) as document_id from asked where (query_id, pos) not in (select query_id, pos from named)) b join secs s on s.document_id = b.document_id and s.sec_id = b.section_id)
    select distinct query_id, document_id, path as section_path from (select query_id, document_id, path from named union all select * from rest)""")
def j4_resolve_sections(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    s = lambda c: c.cast("string")
    b = table(spark, d, "benchmark").withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    sid = F.when(F.col("pos") == 0, F.concat(s(i), F.lit(":s1"))).when(F.col("pos") == 1, "s2").otherwise(F.concat(s(i + 5), F.lit(":s9999")))
    asked = b.select(i.alias("query_id"), "pos", sid.alias("section_id"), F.array(s(i), s(i + 1)).alias("document_ids"))
    return R.resolve_sections(asked, N.parts(spark, d)[1])


@query(f"with {_HITS} select query_id, pos, chunk_id from (select *, row_number() over (partition by query_id, chunk_id order by pos) as n from hits) where n = 1")
def w7_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_first(hits(spark, d)).select("query_id", "pos", "chunk_id")


_TEXTS = """texts as (select item_id as query_id, x, min(i) as i from (select item_id, unnest(v) as x, generate_subscripts(v, 1) as i from (select item_id, [case when item_id % 3 = 0 then 'gap' end, text, 'variant ' || item_id % 5, text, 'Bank', 'Rate'] as v from benchmark)) where x is not null and trim(x) <> '' group by all)"""


@query(f"with {_TEXTS} select query_id, x as text, row_number() over (partition by query_id order by i) - 1 as text_pos from texts")
def w8_query_texts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "gap").alias("gap_query"), F.col("text").alias("query"), F.array(F.concat(F.lit("variant "), (F.col("item_id") % 5).cast("string")), F.col("text")).alias("query_variants"), F.array(F.lit("Bank"), F.lit("Rate")).alias("key_entities"))
    return R.query_texts(q).select("query_id", "text", "text_pos")


@query(f"""with {_HITS}, t as (select *, pos % 3 as text_pos, row_number() over (partition by query_id, pos % 3 order by pos) as rank from hits), f as (select *, row_number() over (partition by query_id, chunk_id order by text_pos, rank) as n from t where rank <= 16)
    select query_id, chunk_id, row_number() over (partition by query_id order by text_pos, rank) as pos from f where n = 1""")
def w8_merge_variants(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("text_pos", F.col("pos") % 3).withColumn("n", F.lit(3))
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "text_pos").orderBy("pos"))).drop("pos")
    return R.merge_variants(h).select("query_id", "chunk_id", "pos")


@query(f"with {_HITS} select query_id, chunk_id, page, row_number() over (partition by query_id order by contains(lower(section_path), 'fr') desc, pos) as pos from hits")
def w9_boost_targets(spark: SparkSession, d: str) -> DataFrame:
    return R.boost_targets(hits(spark, d), F.array(F.lit("FR"))).select("query_id", "chunk_id", "page", "pos")


_TWO = f"{_HITS}, st as (select * from hits where type = 'table' and (query_id % 7 <> 3 or pos < 5)), se as (select * from hits where type <> 'table')"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = hits(spark, d)
    return h.where("type = 'table' and (query_id % 7 <> 3 or pos < 5)"), h.where("type <> 'table'")


@query(f"""with {_TWO}, b as (select *, 0 as s from st union all select *, 1 from se), c as (select *, count_if(s = 0) over (partition by query_id) as ns, row_number() over (partition by query_id, chunk_id order by s, pos) as n from b), r as (select *, row_number() over (partition by query_id order by s, pos) as p from c where n = 1)
    select query_id, chunk_id, p as pos from r where p <= greatest(48, ns + 4)""")
def u1_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(*_two(spark, d)).select("query_id", "chunk_id", "pos")


@query(f"""with {_TWO}, k as (select query_id, count(*) as n from st group by 1), b as (select *, 0 as s from st union all select se.*, 1 from se left join k using (query_id) where coalesce(k.n, 0) < 3), c as (select *, row_number() over (partition by query_id, chunk_id order by s, pos) as n from b)
    select query_id, chunk_id, row_number() over (partition by query_id order by s, pos) as pos from c where n = 1""")
def u2_augment(spark: SparkSession, d: str) -> DataFrame:
    return R.augment(*_two(spark, d)).select("query_id", "chunk_id", "pos")


@query(f"""with {L.RAW}, p as (select document_id, list_sort(list(distinct page)) as every, coalesce(list(distinct page) filter (category = 'Table'), []) as found, coalesce(list(distinct page) filter (category in ('Image', 'Figure')), []) as visual from raw group by 1)
    select document_id, array_to_string(list_filter(every, lambda x: not list_contains(found, x)), '|') as skipped, array_to_string(list_sort(visual), '|') as visual, array_to_string(list_sort(list_filter(list_distinct(list_concat(list_transform(found, lambda x: x + 1), list_transform(found, lambda x: x + 2))), lambda x: not list_contains(found, x))), '|') as adjacent from p""")
def u5_page_sets(spark: SparkSession, d: str) -> DataFrame:
    of = lambda *kinds: F.collect_set(F.when(F.col("category").isin(*kinds), F.col("page")))
    p = N.D.raw_elements(table(spark, d, "documents")).groupBy("document_id").agg(F.collect_set("page").alias("every"), of("Table").alias("found"), of("Image").alias("figures"), of("Figure").alias("vectors"))
    sets = {"skipped": B.skipped_pages(F.col("every"), F.col("found")), "visual": B.visual_pages(F.col("figures"), F.col("vectors")), "adjacent": B.adjacent_pages(F.col("found"))}
    return p.select("document_id", *[F.array_join(x.cast("array<string>"), "|").alias(n) for n, x in sets.items()])


def _with(spark: SparkSession, d: str, **columns) -> DataFrame:
    return hits(spark, d).withColumns(columns)


@query(f"""with {_HITS}, k as (select *, contains(lower(display_text || ' ' || text_for_embedding), 'tionth') or contains(lower(display_text || ' ' || text_for_embedding), 'zzzz') or (query_id % 2 = 0 and page = 3) as k from hits)
    select query_id, pos from (select *, bool_or(k) over (partition by query_id) as a from k) where k or not a""")
def p7_filter_entities(spark: SparkSession, d: str) -> DataFrame:
    named = F.array(F.lit("Other"), F.concat(F.lit("Key Zzzz3"), F.when((F.col("query_id") % 2 == 0) & (F.col("page") == 3), F.lit("-Zebra"))))
    return R.filter_entities(_with(spark, d, keywords=named, key_entities=F.array(F.lit("TIONTH"), F.lit("zzzz3-zebra"), F.lit("zzzz")))).select("query_id", "pos")


@query(f"with {_HITS}, k as (select *, query_id % 7 < 4 and (contains(chunk_id, 'c1') or contains(section_path, 'es')) as k from hits) select query_id, pos from (select *, bool_or(k) over (partition by query_id) as a from k) where k or not a")
def p8_filter_sections(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("query_id") % 7 < 4, F.array(F.lit("c1"), F.lit("es"))).otherwise(F.array(F.lit("QQ")))
    return R.filter_sections(_with(spark, d, target_sections=t)).select("query_id", "pos")


@query(f"""with {_HITS}, t as (select query_id, pos, page, (2005 + pos * 7 % 15) * 12 + pos % 12 + 1 as a, (2008 + pos * 7 % 15) * 12 + pos % 12 + 1 as b, case query_id % 3 when 1 then 2008 * 12 + 3 when 2 then 2010 * 12 + 6 else 0 end as lo, case when query_id % 2 = 1 then 2012 * 12 + 12 else 1000000 end as hi from hits),
    k as (select *, page = 9 or a between lo and hi or (page % 2 = 0 and b between lo and hi) as k from t) select query_id, pos from (select *, bool_or(k) over (partition by query_id) as any_ from k) where k or not any_""")
def p6_filter_time(spark: SparkSession, d: str) -> DataFrame:
    # One date, two on even pages, none on page 9; ranges with both ends, one or none.
    date = lambda y: F.concat((F.col("pos") % 12 + 1).cast("string"), F.lit("/"), (y + F.col("pos") * 7 % 15).cast("string"))
    said = F.when(F.col("page") == 9, F.lit("undated")).when(F.col("page") % 2 == 0, F.concat(F.lit("from "), date(2005), F.lit(" to "), date(2008), F.lit("."))).otherwise(F.concat(F.lit("in "), date(2005)))
    start = F.when(F.col("query_id") % 3 == 1, F.lit("March 2008")).when(F.col("query_id") % 3 == 2, F.lit("6/2010"))
    h = hits(spark, d).withColumn("display_text", said).withColumn("time_range_start", start).withColumn("time_range_end", F.when(F.col("query_id") % 2 == 1, F.lit("December 2012")))
    return R.filter_time(h).select("query_id", "pos")


@query("""with i as (select o_custkey as user_id, 'd' || (o_orderkey // 2 % 17) as id, min(o_orderkey) as k from orders where o_orderkey % 5 > 0 group by all),
    u as (select user_id, string_agg(id, '|' order by k) as ids, count(*) as n from i group by 1) select user_id, case when coalesce(n, 0) <= 12 then coalesce(ids, '') end as scope from (select distinct o_custkey as user_id from orders) left join u using (user_id)""")
def p5_chat_scope(spark: SparkSession, d: str) -> DataFrame:
    # A customer's orders ask for documents, some more than once, with blanks around and between them.
    k = F.col("o_orderkey")
    asked = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.repeat(F.lit(" "), (k % 3).cast("int")), F.lit("d"), (F.floor(k / 2) % 17).cast("string"), F.repeat(F.lit(" "), (k % 2).cast("int"))))
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", asked.alias("id")))).alias("ids"))
    return lists.select("user_id", F.array_join(R.chat_scope(F.transform("ids", lambda x: x["id"])), "|").alias("scope"))


@query("""with r as (select o_orderkey as request_id, k as pos, cast(o_custkey + k * 700 as varchar) as document_id from orders, (values (0), (1), (2)) t(k)), s as (select cast(p_partkey as varchar) as document_id, case when p_partkey % 4 = 0 then 'ready' when p_partkey % 4 = 1 then 'partial' else 'queued' end as status from part)
    select request_id, string_agg(case when coalesce(status, 'unknown') not in ('ready', 'partial') then r.document_id || ' is ' || coalesce(status, 'unknown') end, '; ' order by pos) as message from r left join s using (document_id) group by 1""")
def p4_readiness(spark: SparkSession, d: str) -> DataFrame:
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: (F.col("o_custkey") + k * 700).cast("string")).alias("document_ids"))
    k = F.col("p_partkey")
    state = table(spark, d, "part").select(k.cast("string").alias("document_id"), F.when(k % 4 == 0, "ready").when(k % 4 == 1, "partial").otherwise("queued").alias("status"))
    return R.readiness(req, state)


@query(f"with {_HITS} select query_id, pos as rank, chunk_id, document_id, section_path, page, score, left(display_text, 240) as preview from hits")
def p9_results(spark: SparkSession, d: str) -> DataFrame:
    return R.results(hits(spark, d).withColumnRenamed("pos", "rank"))


@query(f"""with {_HITS}, rt as (select query_id, 'src0' as document_id, p.k as pos, p.k + 2 as page, 0 as src from (select distinct query_id from hits where query_id % 2 = 0), (values (0), (1)) p(k)), b as (select * from rt union all select query_id, document_id, pos, page, 1 from hits where type = 'image' and score >= 0.75),
    o as (select *, row_number() over (partition by query_id, document_id, page order by src, pos) as n from b), r as (select *, row_number() over (partition by query_id order by src, pos) as rank from o where n = 1) select query_id, rank, document_id, page from r where rank <= 3""")
def p11_vision_candidates(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("vision_analyzed", F.lit(False))
    q = h.select("query_id").distinct().select("query_id", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("src0"))).otherwise(F.array(F.lit("src0"), F.lit("src1"))).alias("document_ids"), F.array(F.lit(2), F.lit(3)).alias("vision_pages"))
    return R.vision_candidates(q, h)


@query(f"""with {_HITS}, f as (select query_id, sum(length(display_text)) as n, bool_or(contains(lower(display_text), 'the')) as a from hits where pos <= query_id % 4 * 10 group by 1), q as (select distinct query_id from hits)
    select query_id, coalesce(a and n <= 10000, false) as sufficient, case when n is null then 'query ' || query_id end as gap_query from q left join f using (query_id)""")
def p12_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    q = h.select("query_id").distinct().select("query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query"), F.array(F.lit("The")).alias("key_entities"))
    return R.sufficiency(q, h.where("pos <= query_id % 4 * 10").withColumnRenamed("pos", "rank"))


@query(f"""with {_HITS}, s as (select *, case when query_id % 7 > 0 and query_id % 3 = 2 then (pos * 37) % 101 end as r from hits where pos <= 48) select query_id, pos, rank from (select *, row_number() over (partition by query_id order by r desc nulls last, pos) as rank from s) where rank <= 8""")
def k1_rerank(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("chunk_id", F.col("pos").cast("string"))
    scores = h.where("query_id % 7 > 0").select("query_id", "chunk_id", ((F.col("pos") * 37) % 101).alias("rerank_score"))
    scope = h.select("query_id", (F.col("query_id") % 3).alias("documents")).distinct()
    return R.rerank(h, scores, scope=scope).select("query_id", "pos", "rank")


@query(f"""with recursive {L.SECTIONS}, q as (select item_id as query_id, lower(text) as q, k as doc_pos, cast(item_id * 2 + k as varchar) as document_id from benchmark, (values (0), (1), (2)) t(k)),
    m as (select query_id, doc_pos, s.document_id, s.sec_id, s.sec_seq from q join secs s using (document_id) where lower(regexp_replace(title, '^[ ]*(?:[0-9]+(?:[.][0-9]+)*|[IVX]+|[(][a-z][)]|[A-Z][.])[ ]+', '')) <> '' and (contains(q, lower(regexp_replace(title, '^[ ]*(?:[0-9]+(?:[.][0-9]+)*|[IVX]+|[(][a-z][)]|[A-Z][.])[ ]+', '')))
      or len(list_filter(regexp_extract_all(q, '[^ \\t\\n\\r\\f]+'), lambda w: length(w) > 3 and contains(lower(regexp_replace(title, '^[ ]*(?:[0-9]+(?:[.][0-9]+)*|[IVX]+|[(][a-z][)]|[A-Z][.])[ ]+', '')), w))) > 0)),
    f as (select *, dense_rank() over (partition by query_id order by doc_pos) as d from m) select query_id, document_id, sec_id, rank from (select *, row_number() over (partition by query_id order by sec_seq) as rank from f where d = 1) where rank <= 4""")
def j20_title_route(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    q = table(spark, d, "benchmark").select(i.alias("query_id"), F.col("text").alias("query"), F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: (i * 2 + k).cast("string")).alias("document_ids"))
    return R.title_route(q, N.parts(spark, d)[1])


@query(f"""with {_HITS}, o as (select distinct query_id, page from hits where type = 'table' and pos <= 3), n as (select distinct query_id, page + k as page from o, (values (1), (2)) t(k)), x as (select * from n where (query_id, page) not in (select * from o)),
    sc as (select query_id, document_id, min(pos) as dp from hits where pos <= 3 group by 1, 2), tb as (select source as document_id, cast(doc_id % 9 + 1 as int) as page, min(doc_id) as k from documents group by 1, 2)
    select query_id, page, document_id, 'table ' || k as snippet from (select *, row_number() over (partition by query_id, page order by dp) as r from x join sc using (query_id) join tb using (document_id, page)) where r = 1""")
def j12_adjacent_tables(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).where("pos <= 3").withColumn("doc_pos", F.col("pos"))
    t = table(spark, d, "documents").groupBy(F.col("source").alias("document_id"), (F.col("doc_id") % 9 + 1).cast("int").alias("page")).agg(F.concat(F.lit("table "), F.min("doc_id").cast("string")).alias("markdown"))
    found = R.adjacent_tables(h, t)
    used = h.select("query_id").distinct().withColumn("context_chars", F.lit(0))
    return R.within_budget(found, used)


@query(f"""with {_HITS}, g as (select *, min(pos) over (partition by query_id, document_id, section_path) as gp from hits), l as (select *, row_number() over (partition by query_id order by gp, page, score desc, pos) as line from g),
    b as (select query_id, line, case when row_number() over (partition by query_id, document_id, section_path order by line) = 1 then '## ' || document_id || ' — ' || section_path || chr(10) || chr(10) else '' end || '[p.' || page || ']' || chr(10) || display_text as block from l)
    select query_id, string_agg(block, chr(10) || chr(10) order by line) as context from b group by 1""")
def w10_context(spark: SparkSession, d: str) -> DataFrame:
    return R.context(R.layout(hits(spark, d)))


# A table hit's lines as rows of a pipe table; tables of more than three rows show two.
_TABLED = f"""{_HITS}, tb as (select *, case when type = 'table' then '| line |' || chr(10) || '| --- |' || chr(10) || '| ' || replace(replace(display_text, '|', '/'), chr(10), ' |' || chr(10) || '| ') || ' |' end as md from hits),
    sh as (select *, len(string_split(md, chr(10))) - 2 > 3 as big from tb), pv as (select * exclude (display_text), case when big then array_to_string(string_split(md, chr(10))[1:4], chr(10)) when md is not null then md else display_text end as display_text from sh)"""


@query(f"""with recursive {_TABLED}, g as (select *, min(pos) over (partition by query_id, document_id, section_path) as gp from pv), l as (select *, row_number() over (partition by query_id order by gp, page, score desc, pos) as line from g),
    fo as (select query_id, 0::bigint as line, 0::bigint as used, false as whole from (select distinct query_id from l) union all
      select query_id, line, used + length('[p.' || page || ']' || chr(10)) + case when whole then length(md) else length(display_text) end, whole from (select l.*, fo.used, coalesce(big, false) and fo.used + length(md) < 20000 as whole from fo join l on l.query_id = fo.query_id and l.line = fo.line + 1)),
    b as (select l.query_id, l.line, case when row_number() over (partition by l.query_id, document_id, section_path order by l.line) = 1 then '## ' || document_id || ' — ' || section_path || chr(10) || chr(10) else '' end || '[p.' || page || ']' || chr(10) || case when fo.whole then md else display_text end as block from l join fo on fo.query_id = l.query_id and fo.line = l.line)
    select query_id, string_agg(block, chr(10) || chr(10) order by line) as context from b group by 1""")
def j11_hydrated_context(spark: SparkSession, d: str) -> DataFrame:
    h = stored(hits(spark, d).withColumn("table_index", (F.col("query_id") * 1000 + F.col("pos")).cast("int")))
    rows = F.replace(F.replace(F.col("display_text"), F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" |\n| "))
    tables = h.where("type = 'table'").select("document_id", "table_index", F.concat(F.lit("| line |\n| --- |\n| "), rows, F.lit(" |")).alias("markdown"))
    side = S.side_table(spark, shared_dir(spark), 8)
    shown = S.overflow(tables, side, 0, rows=3, shown=2)
    laid = R.layout(h.join(shown.select("document_id", "table_index", "markdown", "table_path"), ["document_id", "table_index"], "left").withColumn("display_text", F.coalesce("markdown", "display_text")).drop("markdown"))
    return R.context(R.hydrate(S.with_whole_tables(laid, side, "full_text", ["query_id", "line"]), 20_000), "text")


@query(f"""with {_HITS} select query_id, string_agg('[' || pos || '] type=' || type || ' section=' || section_path || chr(10) || '  ' || left(display_text, 200), chr(10) order by pos) as summaries from hits where pos <= 12 group by 1""")
def f27_hit_summaries(spark: SparkSession, d: str) -> DataFrame:
    return R.hit_summaries(hits(spark, d).withColumnRenamed("pos", "rank"))


@query("with k as (select doc_id, cast(doc_id % 9 + 1 as varchar) || '-' || left(sha256('m|v1|' || left(lower(trim(text)), 120)), 16) as key from documents) select doc_id, key from k where key not in (select key from k where doc_id % 2 = 0)")
def j19_vision_cache(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").select("doc_id", R.vision_key((F.col("doc_id") % 9 + 1).cast("string"), F.col("text"), "m", "v1").alias("key"))
    return k.join(k.where("doc_id % 2 = 0").select("key").distinct(), "key", "left_anti")


_EVALUATED = """c as (select source as document_id, cast(doc_id % 3 + 1 as int) as page, doc_id, text from documents), e as (select item_id as query_id, regexp_extract(lower(text), '^[^ \\t\\n\\r\\f]+') as w, 'src' || item_id % 20 as document_id, cast(item_id % 3 + 1 as int) as page from benchmark),
    f as (select query_id, bool_and(c.page = e.page) as ok from e join c using (document_id) where contains(lower(c.text), e.w) group by 1), t as (select document_id, arg_min(page, doc_id) as p from c group by 1),
    j as (select e.query_id, e.document_id, f.ok is not null as text_found, coalesce(f.ok, false) as citation_ok, coalesce(t.p = e.page, false) as top1_ok from e left join f using (query_id) left join t using (document_id))"""


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Expectations as judged, and the chunks."""
    c = table(spark, d, "documents").select(F.col("source").alias("document_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("page"), "doc_id", F.col("text").alias("display_text"))
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"), (F.col("item_id") % 3 + 1).cast("int").alias("page"))
    top = c.groupBy("document_id").agg(F.min_by("page", "doc_id").alias("page"))
    return R.evaluate(e, c, e.select("query_id", "document_id").join(top, "document_id").withColumn("rank", F.lit(1))), c


@query(f"with {_EVALUATED} select query_id, text_found, citation_ok, top1_ok from j")
def a15_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)[0].drop("document_id")


@query(f"""with {_EVALUATED}, k as (select document_id, round(avg(text_found::int), 2) as recall, round(avg(citation_ok::int), 2) as cited, count_if(top1_ok) as top1, count(*) as asked from j group by 1),
    o as (select document_id, count(distinct page) as pages from c where regexp_matches(text, '[^ \\t\\n\\r\\f\\x0B]') group by 1), m as (select source as document_id, count(*) as total_pages, round(avg(n_chars) / 100, 3) as seconds from documents where source is not null group by 1)
    select count(*) as documents, avg(recall) as mean_text_recall, avg(cited) as mean_citation_accuracy, cast(coalesce(sum(top1), 0) as bigint) as top1_correct, cast(coalesce(sum(asked), 0) as bigint) as queries, cast(coalesce(sum(pages), 0) as bigint) as pages_with_output, cast(sum(total_pages) as bigint) as total_pages, median(seconds) as median_parse_seconds
    from m left join k using (document_id) left join o using (document_id)""")
def a15_evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    judged, chunks = _evaluated(spark, d)
    documents = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("document_id")).agg(F.count("*").alias("total_pages"), F.round(F.avg("n_chars") / 100, 3).alias("parse_seconds"))
    return R.evaluation_summary(judged, chunks, documents)


_FLAGSHIP = N._CHUNKS.replace("from els where", "from kept where").replace("k - 39", "k - 199").replace("/ 30.0", "/ 175.0").replace("k // 30", "k // 175").replace("n <= 40", "n <= 200").replace("n - 40", "n - 200")
_SPOTS = "select {}, ('0x' || left(md5(w), 6))::int % 256 as b, count(*)::double as n from (select {}, unnest(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))) as w from {}) group by all"


@query(f"""with recursive {L.SECTIONS}, bp as (select document_id, text from els where type = 'text' and length(text) > 30 group by all having count(distinct page) >= 3), kept as (select * from els where not exists (select 1 from bp where bp.document_id = els.document_id and bp.text = els.text)), {_FLAGSHIP},
    nc as (select ch.*, coalesce(path, 'Document') as section_path, ch.document_id || '::text::' || (row_number() over (partition by ch.document_id order by ch.sec_seq, first_pos, w) - 1) as chunk_id from ch left join secs using (document_id, sec_seq) where display_text <> ''),
    em as (select *, section_path || chr(10) || chr(10) || display_text as t from nc), cv as ({_SPOTS.format('chunk_id', 'chunk_id', 't', 'em')}), qv as ({_SPOTS.format('item_id', 'item_id', 'text', 'benchmark')}),
    cn as (select chunk_id, sqrt(sum(n * n)) as size from cv group by 1), qn as (select item_id, sqrt(sum(n * n)) as size from qv group by 1),
    sc as (select b.item_id as query_id, c.chunk_id, c.document_id, c.section_path, c.page, c.display_text from em c join benchmark b on cast(c.document_id as bigint) % 40 = b.item_id),
    dt as (select sc.query_id, sc.chunk_id, sum(cv.n * qv.n) as dot from sc join cv using (chunk_id) join qv on qv.item_id = sc.query_id and qv.b = cv.b group by all),
    rk as (select sc.*, round(coalesce(dot / (cn.size * qn.size), 0), 6) as score from sc left join dt using (query_id, chunk_id) left join cn using (chunk_id) left join qn on qn.item_id = sc.query_id)
    select query_id, rank, chunk_id, document_id, section_path, page, score, left(display_text, 240) as preview from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from rk) where rank <= 8""")
def flagship_chunk_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Documents to page-accurate chunks with stand-in vectors, and the best eight for each benchmark text."""
    e, s = N.elements_and_paths(spark, d)
    e = N.C.without_boilerplate(e)
    c = N.C.text_chunks(e, s, 200, 25, provenance=False).withColumn("type", F.lit("text"))
    c = stored(N.C.number_chunks(c).withColumn("embedding", X.hash_embedding("text_for_embedding")))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.hash_embedding("text").alias("vector"), F.col("item_id").alias("i"))
    scope = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("doc_id") % 40).alias("i"))
    found = R.vector_search(c, q.join(scope, "i").drop("i"), 8)
    return R.results(found.join(c.select("chunk_id", "section_path", "page", "display_text"), "chunk_id"))


