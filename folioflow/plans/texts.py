"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import sql as L
from .registry import query, table

_TOK = "regexp_extract_all(text, '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a date in one of four spellings."""
    m = F.element_at(F.array(*[F.lit(x.capitalize()) for x in X.MONTHS]), (F.col("doc_id") % 12 + 1).cast("int"))
    n = lambda c: c.cast("string")
    k = F.col("doc_id")
    s = (
        F.when(k % 4 == 0, F.concat(m, F.lit(" "), n(2000 + k % 30)))
        .when(k % 4 == 1, F.concat(F.substring(m, 1, 3), F.lit("-"), n(10 + k % 20)))
        .when(k % 4 == 2, F.concat(n(2000 + k % 30), F.lit("-"), n(k % 12 + 1), F.lit("-"), n(k % 28 + 1)))
        .otherwise(F.concat(n(k % 12 + 1), F.lit("/"), n(2000 + k % 30)))
    )
    return docs(spark, d).select("doc_id", s.alias("s"), "text")


@query(f"select doc_id, lower({L.strip(chr(39) + chr(39) + ' || regexp_replace(t, ' + chr(39) + '^[ ]*(?:[0-9]+(?:[.][0-9]+)*|[IVX]+|[(][a-z][)]|[A-Z][.])[ ]+' + chr(39) + ', ' + chr(39) + chr(39) + ')')}) as title from (select doc_id, (case doc_id % 4 when 0 then '1.2 ' when 1 then 'IV ' when 2 then '(a) ' else 'A. ' end) || text as t from documents)")
def f1_normalize_title(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    lead = F.when(k == 0, "1.2 ").when(k == 1, "IV ").when(k == 2, "(a) ").otherwise("A. ")
    return docs(spark, d).select("doc_id", X.normalize_title(F.concat(lead, F.col("text"))).alias("title"))


@query(f"""with c as (select doc_id, {L.strip("regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')")} as t from documents) select doc_id, left(array_to_string(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))[1:2], ' '), 280) as summary from c""")
def f2_summary(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.summary("text").alias("summary"))


@query("select doc_id, round(length(regexp_replace(text, '[\\n\\t\\r' || chr(160) || ']', '', 'g')) / length(text), 6) as ratio from documents")
def f3_printable_ratio(spark: SparkSession, d: str) -> DataFrame:
    # Halves are those of the product, as in its SQL: Spark's round to six places goes by the decimal digits.
    ratio = F.round(X.printable_ratio("text") * 1e6) / 1e6
    return table(spark, d, "documents").select("doc_id", ratio.alias("ratio"))


@query(f"with {L.suspicious('documents', 'doc_id')} select doc_id, doc_id in (select doc_id from suspect) as suspicious from documents where text is not null")
def f4_suspicious_repeats(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.suspicious_repeats("text").alias("suspicious"))


@query(f"with {L.DATED} select doc_id, s, (case when doc_id % 4 = 1 then 2010 + doc_id % 20 else 2000 + doc_id % 30 end) || '-' || (doc_id % 12 + 1) || '-' || (case when doc_id % 4 = 2 then doc_id % 28 + 1 else 1 end) as ymd from dated")
def f5_parse_date(spark: SparkSession, d: str) -> DataFrame:
    p = X.parse_date("s")
    return dated(spark, d).select("doc_id", "s", F.concat_ws("-", *[p[c].cast("string") for c in "ymd"]).alias("ymd"))


@query(f"with {L.DATED} select doc_id, (case when doc_id % 4 = 1 then 2010 + doc_id % 20 else 2000 + doc_id % 30 end) || '-' || (doc_id % 12 + 1) || '-' || (case when doc_id % 4 = 2 then doc_id % 28 + 1 else 1 end) || '|2024-5-6' as dates from dated where doc_id % 4 < 2 union all select doc_id, case when doc_id % 4 = 2 then (2000 + doc_id % 30) || '-' || (doc_id % 12 + 1) || '-' || (doc_id % 28 + 1) || '|2024-5-6' else '2024-5-6|' || (2000 + doc_id % 30) || '-' || (doc_id % 12 + 1) || '-1' end from dated where doc_id % 4 >= 2")
def f6_dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("from "), "s", F.lit(" to 2024-5-6."))
    found = F.transform(X.dates_in(t), lambda p: F.concat_ws("-", *[p[c].cast("string") for c in "ymd"]))
    return dated(spark, d).select("doc_id", F.array_join(found, "|").alias("dates"))


_VARIANTS = f"""vars as (select doc_id, s, case doc_id % 4 when 0 then [s, left(m, 3) || '-' || lpad(cast(doc_id % 30 as varchar), 2, '0'), left(m, 3) || ' ' || (2000 + doc_id % 30), lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') || '/' || (2000 + doc_id % 30), lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(doc_id % 30 as varchar), 2, '0')]
    when 1 then [s, lower(m) || ' ' || (2010 + doc_id % 20), left(m, 3) || ' ' || (2010 + doc_id % 20), lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') || '/' || (2010 + doc_id % 20)]
    when 2 then [s] else [s, lower(m) || ' ' || (2000 + doc_id % 30), left(m, 3) || '-' || lpad(cast(doc_id % 30 as varchar), 2, '0'), left(m, 3) || ' ' || (2000 + doc_id % 30)] end as v from (select *, {L.MONTH_LIST}[cast(doc_id % 12 + 1 as int)] as m from dated)),
  spread as (select doc_id, s, unnest(v) as x, generate_subscripts(v, 1) as i from vars), firsts as (select doc_id, s, x, min(i) as i from spread group by all)"""


@query(f"with {L.DATED}, {_VARIANTS} select doc_id, string_agg(x, '|' order by i) as variants from firsts group by 1")
def f7_date_variants(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("doc_id", F.array_join(X.date_variants("s"), "|").alias("variants"))


@query(f"with {L.DATED}, {_VARIANTS} select doc_id, string_agg('sales in ' || x || ' by region', '|' order by i) as variants from firsts where doc_id % 4 <> 2 group by 1 union all select doc_id, 'sales in ' || s || ' by region' from dated where doc_id % 4 = 2")
def f8_query_variants(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("sales in "), "s", F.lit(" by region"))
    return dated(spark, d).select("doc_id", F.array_join(X.query_variants(q), "|").alias("variants"))


@query(f"with {L.DATED}, {_VARIANTS} select doc_id, string_agg('sales in ' || x, '|' order by 'sales in ' || x) as variants from firsts where doc_id % 4 <> 2 group by 1 union all select doc_id, 'sales in ' || s from dated where doc_id % 4 = 2")
def u3_variant_union(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("sales in "), "s")
    return dated(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_union(F.array(q), X.query_variants(q))), "|").alias("variants"))


@query("select doc_id, lang || '/' || source as found from documents where doc_id % 4 < 3 union all select doc_id, null from documents where doc_id % 4 = 3")
def f18_lenient_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    body = F.to_json(F.struct("lang", "source"))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).when(k == 2, body).otherwise(F.lit("no {json"))
    j = X.lenient_json(raw)
    return docs(spark, d).select("doc_id", F.concat(F.get_json_object(j, "$.lang"), F.lit("/"), F.get_json_object(j, "$.source")).alias("found"))


@query("select doc_id, case doc_id % 3 when 0 then lang || '|' || source when 1 then lang || '|' || source || ' rest' else '|' end as found from documents")
def f19_caption(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("lang").alias("caption"), F.col("source").alias("description"))), F.lit("\n```"))).when(k == 1, F.concat("lang", F.lit("\n"), "source", F.lit("\nrest"))).otherwise(F.lit("[1, 2]"))
    c = X.caption(raw)
    return docs(spark, d).select("doc_id", F.concat(c["caption"], F.lit("|"), c["description"]).alias("found"))


@query("select doc_id, 'search_document: ' || text as input from documents")
def f21_task_prefix(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.task_prefix("text", "document").alias("input"))


@query(f"select doc_id, len({_TOK}) as n, array_to_string({_TOK}[1:20], '') as head from documents")
def f23_tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.count_tokens("text").alias("n"), X.truncate_tokens("text", 20).alias("head"))


@query(f"select doc_id, case when left({L.strip('x')}, 8000) = '' then ' ' else left({L.strip('x')}, 8000) end as passage from (select doc_id, case doc_id % 3 when 0 then text when 1 then source else '' end as x from documents)")
def f24_passage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    return docs(spark, d).select("doc_id", X.passage(F.when(k == 0, F.col("text")).otherwise(F.lit("")), F.when(k == 1, F.col("source"))).alias("passage"))


@query("""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from documents), b as (select doc_id, cast('0x' || left(md5(w), 6) as int) % 256 as b, count(*) as n from w group by all)
    select doc_id, b, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as x from b""")
def f22_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = docs(spark, d).select("doc_id", F.posexplode(X.hash_embedding("text")).alias("b", "x"))
    return e.where("x > 0").select("doc_id", "b", F.round("x", 6).alias("x"))


@query("select event_id, case when event_id % 3 = 0 then 'msg:d' || event_id else event_type || ':' || user_id || ':' || case when event_id % 3 = 1 then '0' else strftime(ts, '%Y-%m-%d') end end as key from events")
def f25_event_key(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    return table(spark, d, "events").select("event_id", X.event_key(F.when(k == 0, F.concat(F.lit("d"), F.col("event_id").cast("string"))), "event_type", F.col("user_id").cast("string"), F.when(k == 2, F.date_format("ts", "yyyy-MM-dd"))).alias("key"))


@query("select event_id, cast(60 * pow(2, event_id % 5) as bigint) as delay, strftime(ts + to_seconds(cast(60 * pow(2, event_id % 5) as bigint)), '%Y-%m-%d %H:%M:%S') as next_at from events")
def f26_retry_delay(spark: SparkSession, d: str) -> DataFrame:
    delay = X.retry_delay(F.col("event_id") % 5 + 1)
    return table(spark, d, "events").select("event_id", delay.alias("delay"), F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + delay), "yyyy-MM-dd HH:mm:ss").alias("next_at"))
