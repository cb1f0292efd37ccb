"""Queries over plans, subscriptions, meters and document state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as U
from .registry import query, table

#: Plans: id, slug, product, words, uploads, bytes and files a day (-1: unlimited), active. Fixed values.
PLANS = [(1, "free", "p_free", 2000, 5, 5 << 20, 2, True), (2, "plus", "p_plus", 10000, 10, -1, 10, True), (3, "pro", "p_pro", -1, -1, -1, -1, True), (4, "old", "p_old", 100, 1, -1, 1, False)]
_PLANS_SQL = "plans(id, slug, product_id, words_per_day, uploads_per_day, upload_bytes_per_day, files_in_scope, is_active) as (values " + ", ".join(str(p) for p in PLANS) + ")"
#: Orders as subscriptions of customers.
_SUBS = """subs as (select o_custkey as user_id, o_orderkey as subscription_id, o_orderkey % 4 + 1 as plan_id, case o_orderstatus when 'O' then 'active' when 'F' then 'cancelled' else 'on_hold' end as status, cast(o_orderdate as timestamp) as created_at, cast(o_orderdate as timestamp) + interval 90 day as current_period_end from orders)"""


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "id long, slug string, product_id string, words_per_day long, uploads_per_day int, upload_bytes_per_day long, files_in_scope int, is_active boolean")


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "cancelled").otherwise("on_hold")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("subscription_id"), (F.col("o_orderkey") % 4 + 1).alias("plan_id"), status.alias("status"), day.alias("created_at"), (day + F.expr("interval 90 days")).alias("current_period_end"))


@query(f"with {_SUBS} select user_id, subscription_id, plan_id, status from (select *, row_number() over (partition by user_id order by created_at desc, subscription_id desc) as n from subs) where n = 1")
def j13_current_subscription(spark: SparkSession, d: str) -> DataFrame:
    return U.current_subscription(subscriptions(spark, d)).select("user_id", "subscription_id", "plan_id", "status")


@query(f"""with {_PLANS_SQL}, {_SUBS}, ev as (select o_orderkey as event_id, o_custkey as user_id, cast(o_orderdate as timestamp) + to_days(cast(o_orderkey % 200 as int)) as ts from orders),
    m as (select e.event_id, e.user_id, e.ts, s.plan_id, s.status, s.current_period_end, row_number() over (partition by e.event_id order by s.created_at desc, s.subscription_id desc) as n from ev e left join subs s on s.user_id = e.user_id and s.created_at <= e.ts)
    select event_id, user_id, coalesce(case when status = 'active' or (status in ('on_hold', 'cancelled') and current_period_end >= ts) then slug end, 'free') as slug from m left join plans p on p.id = m.plan_id and p.is_active where n = 1""")
def j14_plan_at_time(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ev = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((F.col("o_orderkey") % 200).cast("int"))).alias("ts"))
    return U.plan_at(ev, subscriptions(spark, d), plans(spark))


@query(f"""with {_PLANS_SQL}, r as (select event_id, case event_id % 3 when 0 then 'free' when 1 then 'plus' else 'pro' end as slug, event_id % 12000 as ai_words, event_id % 12 as uploads, event_id % 6000000 as upload_bytes, 1000 as new_bytes, event_id % 4 as files from events)
    select event_id, case when words_per_day >= 0 and ai_words >= words_per_day then 'words' when uploads_per_day >= 0 and uploads >= uploads_per_day then 'uploads' when upload_bytes_per_day >= 0 and upload_bytes + new_bytes > upload_bytes_per_day then 'bytes' when files_in_scope >= 0 and files > files_in_scope then 'files' end as limit_type,
    case when words_per_day >= 0 and ai_words >= words_per_day then words_per_day when uploads_per_day >= 0 and uploads >= uploads_per_day then uploads_per_day when upload_bytes_per_day >= 0 and upload_bytes + new_bytes > upload_bytes_per_day then upload_bytes_per_day when files_in_scope >= 0 and files > files_in_scope then files_in_scope end as "limit" from r join plans using (slug)""")
def j15_quota_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    r = table(spark, d, "events").select("event_id", F.when(k % 3 == 0, "free").when(k % 3 == 1, "plus").otherwise("pro").alias("slug"), (k % 12000).alias("ai_words"), (k % 12).alias("uploads"), (k % 6000000).alias("upload_bytes"), F.lit(1000).alias("new_bytes"), (k % 4).alias("files"))
    return U.quota_check(r, plans(spark)).select("event_id", "limit_type", "limit")


@query(f"""with {_PLANS_SQL}, e as (select o_orderkey as k, case when o_orderkey % 3 = 0 then o_custkey end as meta_user, 'mail' || o_custkey as customer, case when o_orderkey % 2 = 0 then ['free', 'plus', 'pro', 'none'][cast(o_orderkey % 4 + 1 as int)] end as meta_slug, ['p_free', 'p_plus', 'p_x'][cast(o_orderkey % 3 + 1 as int)] as product_id from orders),
    u as (select 'mail' || c_custkey as customer, c_custkey as mail_user from customer where c_custkey % 4 > 0)
    select k, coalesce(meta_user, mail_user) as user_id, coalesce(a.id, b.id) as plan_id from e left join u using (customer) left join plans a on a.slug = e.meta_slug left join plans b on b.product_id = e.product_id where coalesce(meta_user, mail_user) is not null and coalesce(a.id, b.id) is not null""")
def j16_match_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    e = table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.col("o_custkey")).alias("meta_user"), F.concat(F.lit("mail"), F.col("o_custkey").cast("string")).alias("customer"), F.when(k % 2 == 0, pick(["free", "plus", "pro", "none"], 4)).alias("meta_slug"), pick(["p_free", "p_plus", "p_x"], 3).alias("product_id"))
    users = table(spark, d, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("mail"), F.col("c_custkey").cast("string")).alias("email"), F.col("c_custkey").alias("user_id"))
    return U.match_events(e, users, plans(spark)).select("k", "user_id", "plan_id")


@query("with r as (select o_custkey as user_id, o_orderkey % 50 as document_id, o_orderkey as k from orders) select * from r where (user_id, document_id) in (select c_custkey, c_custkey % 50 from customer)")
def j17_owned(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("document_id"), F.col("o_orderkey").alias("k"))
    return U.owned(r, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50).alias("document_id")))


@query("select event_id, user_id as token_id from events where user_id not in (select c_custkey from customer where c_custkey % 3 = 0)")
def j18_not_revoked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("token_id"))
    return U.not_revoked(e, table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("token_id")))


@query("""with e as (select o_custkey as subscription_id, o_orderkey as arrival, case when o_orderkey % 50 > 0 then cast(o_orderdate as timestamp) end as ts, case when o_orderkey % 3 > 0 then o_orderkey end as period_end from orders),
    r as (select *, sum((ts is null)::int) over (partition by subscription_id order by arrival) as run from e), b as (select *, max(ts) over (partition by subscription_id, run order by arrival rows between unbounded preceding and 1 preceding) as before from r),
    a as (select *, ts is null or before is null or ts > before as applied from b)
    select subscription_id, arrival, applied, last_value(case when applied then period_end end ignore nulls) over (partition by subscription_id order by arrival rows between unbounded preceding and current row) as held_end from a""")
def w15_applied_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("subscription_id"), k.alias("arrival"), F.when(k % 50 > 0, F.col("o_orderdate").cast("timestamp")).alias("ts"), F.when(k % 3 > 0, k).alias("period_end"))
    return U.applied_events(e).select("subscription_id", "arrival", "applied", "held_end")


_USAGE = "select user_id, strftime(ts, '%Y-%m-%d') as usage_date, {} from events group by 1, 2"


@query(_USAGE.format("sum(event_id % 100) as ai_words, count_if(event_type = 'click') as uploads, cast(sum(round(coalesce(value, 0))) as bigint) as upload_bytes"))
def a13_daily_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100).alias("ai_words"), (F.col("event_type") == "click").cast("long").alias("uploads"), F.round(F.coalesce("value", F.lit(0))).cast("long").alias("upload_bytes"))
    return U.daily_usage(e).withColumn("usage_date", F.date_format("usage_date", "yyyy-MM-dd"))


# Whole turns in pieces of 50 characters.
_PIECES = "p as (select request_id, seq, content from (select conv_id as request_id, cast(turn as bigint) * 100000 + generate_subscripts(c, 1) as seq, unnest(c) as content from (select conv_id, turn, regexp_extract_all(text, '(?s).{1,50}') as c from conversations where text is not null)))"
_WORDS = f"""{_PIECES}, w as (select *, lag(content) over (partition by request_id order by seq) as last, len(regexp_extract_all(content, '[^ \\t\\n\\r\\f]+')) as n from p),
    c as (select request_id, seq, n - (coalesce(regexp_matches(last, '[^ \\t\\n\\r\\f]$'), false) and n > 0 and not regexp_matches(content, '^[ \\t\\n\\r\\f]'))::int as words from w)"""


def pieces(conversations: DataFrame, *more: str) -> DataFrame:
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,50}"), F.lit(0))
    c = conversations.where("text is not null").select(F.col("conv_id").alias("request_id"), "turn", *more, F.posexplode(cut).alias("i", "content"))
    return c.select("request_id", (F.col("turn").cast("long") * 100_000 + F.col("i") + 1).alias("seq"), "content", *more)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return U.piece_words(pieces(table(spark, d, "conversations")))


@query(f"with {_WORDS} select request_id, seq, words from c")
def w12_piece_words(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("request_id", "seq", "words")


@query(f"""with {_WORDS}, r as (select *, 20 + request_id % 40 as remaining, sum(words) over (partition by request_id order by seq) as run from c)
    select request_id, case when min(case when words > 0 and run >= remaining then seq end) is not null then any_value(remaining) else sum(words) end as counted, min(case when words > 0 and run >= remaining then seq end) as limit_seq from r group by 1""")
def w13_quota_crossing(spark: SparkSession, d: str) -> DataFrame:
    return U.quota_crossing(_pieces(spark, d).withColumn("remaining", 20 + F.col("request_id") % 40))


@query("select user_id, event_id, n as rank from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n <= 30")
def w11_newest_traces(spark: SparkSession, d: str) -> DataFrame:
    return U.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 30).select("user_id", "event_id", "rank")


@query("select o_custkey, o_orderkey, n as rank from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) where n <= 3")
def k2_newest_uploads(spark: SparkSession, d: str) -> DataFrame:
    return U.newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""select o_orderkey, row_number() over (partition by o_custkey % 7 order by lower(o_orderpriority), coalesce(case when o_orderkey % 5 > 0 then round(cast(o_totalprice as double) / 50000) end, 0) desc, o_orderdate desc, o_orderkey) as place from orders""")
def k3_library_sort(spark: SparkSession, d: str) -> DataFrame:
    # Seven users; names and sizes tie often, so the date decides, and then the order of equal rows by their key.
    files = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("user_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_totalprice").cast("double") / 50000)).alias("size"), F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k")).alias("date"), "o_orderkey")
    return U.library(files).select("o_orderkey", "place")


_STATE = """state as (select o_orderkey as document_id, case o_orderkey % 5 when 0 then 'queued' when 1 then 'processing' when 2 then 'parser_failure' when 3 then 'resource_limit' else 'ready' end as status, cast(o_orderkey % 4 as int) as attempts,
    case when o_orderkey % 3 = 0 then cast(o_orderdate as timestamp) end as next_attempt_at, case when o_orderkey % 2 = 0 then cast(o_orderdate as timestamp) + interval 10 day end as claimed_until, cast(o_orderdate as timestamp) as updated_at from orders)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(k % 5 == 0, "queued").when(k % 5 == 1, "processing").when(k % 5 == 2, "parser_failure").when(k % 5 == 3, "resource_limit").otherwise("ready")
    return table(spark, d, "orders").select(k.alias("document_id"), status.alias("status"), (k % 4).cast("int").alias("attempts"), F.when(k % 3 == 0, day).alias("next_attempt_at"), F.when(k % 2 == 0, day + F.expr("interval 10 days")).alias("claimed_until"), day.alias("updated_at"))


_NOW = "timestamp '1996-06-01 00:00:00'"


@query(f"with {_STATE} select document_id from state where status = 'queued' and coalesce(next_attempt_at <= {_NOW}, true) and coalesce(claimed_until <= {_NOW}, true) order by updated_at, document_id limit 100")
def k5_claim_due(spark: SparkSession, d: str) -> DataFrame:
    return U.claim(_state(spark, d), F.expr(_NOW), 100).select("document_id")


@query(f"""with {_STATE}, t as (select *, status in ('parser_failure', 'resource_limit') as failed, coalesce(status = 'processing' and claimed_until < {_NOW}, false) as expired from state)
    select document_id, case when failed and attempts >= 3 then 'failed' when failed or expired then 'queued' else status end as status, attempts + expired::int as attempts, strftime(case when failed and attempts < 3 then {_NOW} + to_seconds(cast(60 * pow(2, greatest(attempts - 1, 0)) as bigint)) else next_attempt_at end, '%Y-%m-%d %H:%M:%S') as next_at from t""")
def t7_housekeeping(spark: SparkSession, d: str) -> DataFrame:
    h = U.housekeeping(_state(spark, d), F.expr(_NOW))
    return h.select("document_id", "status", "attempts", F.date_format("next_attempt_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query(f"with {_STATE} select o_orderkey as document_id, case when s.status is null then 'unknown' when s.status = 'ready' then 'analyzed' when s.status in ('parser_failure', 'resource_limit') then 'error' else 'processing' end as display from orders left join (select * from state where document_id % 7 > 0) s on s.document_id = o_orderkey")
def p3_display_status(spark: SparkSession, d: str) -> DataFrame:
    uploads = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"))
    return U.display_status(uploads, _state(spark, d).where("document_id % 7 > 0")).select("document_id", "display")
