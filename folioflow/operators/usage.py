"""Plans, subscriptions, usage meters and the state of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import retry_delay
from .ordering import with_ranks

ERRORS = ["error", "failed", "invalid", "encrypted", "resource_limit", "parser_failure"]
STALE = ["queued", "processing"]


def display_status(uploads: DataFrame, state: DataFrame) -> DataFrame:
    s = F.col("status")
    shown = F.when(s.isNull(), "unknown").when(s.isin("ready", "partial"), "analyzed").when(s.isin(ERRORS), "error").otherwise("processing")
    return uploads.join(state.select("document_id", "status"), "document_id", "left").withColumn("display", shown)


def current_subscription(subscriptions: DataFrame) -> DataFrame:
    """The newest subscription of each user."""
    cols = [c for c in subscriptions.columns if c != "user_id"]
    return subscriptions.groupBy("user_id").agg(F.max_by(F.struct(*cols), F.struct("created_at", "subscription_id")).alias("s")).select("user_id", "s.*")


def entitles(at: Column) -> Column:
    return (F.col("status") == "active") | (F.col("status").isin("on_hold", "cancelled") & (F.col("current_period_end") >= at))


def plan_at(events: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan in force for each event (event_id, user_id, ts): the newest subscription made by then, if it entitles and its
    plan is active; else free.

    As-of without a pairing of all events and subscriptions: both stand in one order by user and time, and the last
    subscription seen is carried on.
    """
    cols = ["plan_id", "status", "current_period_end"]
    sub = subscriptions.select("user_id", F.col("created_at").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), F.struct(*cols).alias("s"), F.col("subscription_id").alias("tie"))
    ev = events.select("user_id", "ts", F.lit(1).alias("kind"), F.col("event_id").cast("long"), F.lit(None).cast(sub.schema["s"].dataType).alias("s"), F.lit(None).cast(sub.schema["tie"].dataType).alias("tie"))
    order = Window.partitionBy("user_id").orderBy("ts", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = sub.union(ev).withColumn("last", F.last("s", ignorenulls=True).over(order)).where("kind = 1").select("event_id", "user_id", "ts", "last.*")
    named = seen.join(plans.where("is_active").select(F.col("id").alias("plan_id"), "slug"), "plan_id", "left")
    return named.select("event_id", "user_id", F.coalesce(F.when(entitles(F.col("ts")), F.col("slug")), F.lit("free")).alias("slug"))


def quota_check(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """The first limit that a request runs into: request columns, limit_type (null: none), used, limit, next tier.

    Requests have slug, ai_words, uploads, upload_bytes, new_bytes and files; a limit of -1 never blocks.
    """
    p = plans.select("slug", "words_per_day", "uploads_per_day", "upload_bytes_per_day", "files_in_scope")
    on = lambda limit, over: (F.col(limit) >= 0) & over
    checks = [
        ("words", "words_per_day", F.col("ai_words"), F.col("ai_words") >= F.col("words_per_day")),
        ("uploads", "uploads_per_day", F.col("uploads"), F.col("uploads") >= F.col("uploads_per_day")),
        ("bytes", "upload_bytes_per_day", F.col("upload_bytes"), F.col("upload_bytes") + F.col("new_bytes") > F.col("upload_bytes_per_day")),
        ("files", "files_in_scope", F.col("files"), F.col("files") > F.col("files_in_scope")),
    ]
    kind, used, limit = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, cap, value, over in reversed(checks):
        hit = on(cap, over)
        kind, used, limit = F.when(hit, name).otherwise(kind), F.when(hit, value.cast("long")).otherwise(used), F.when(hit, F.col(cap).cast("long")).otherwise(limit)
    tier = F.when(F.col("slug") == "free", "Plus").when(F.col("slug") == "plus", "Pro")
    out = requests.join(p, "slug", "left")
    return out.select(*requests.columns, kind.alias("limit_type"), used.alias("used"), limit.alias("limit"), F.when(kind.isNotNull(), tier).alias("next_tier"))


def match_events(events: DataFrame, users: DataFrame, plans: DataFrame) -> DataFrame:
    """Webhook events with user_id (given, else by e-mail) and plan_id (by slug, else by product); others are dropped."""
    by_mail = users.groupBy(F.col("email").alias("customer")).agg(F.min("user_id").alias("mail_user"))
    by_slug, by_product = plans.select(F.col("slug").alias("meta_slug"), F.col("id").alias("slug_plan")), plans.select("product_id", F.col("id").alias("product_plan"))
    out = events.join(by_mail, "customer", "left").join(by_slug, "meta_slug", "left").join(by_product, "product_id", "left")
    out = out.withColumn("user_id", F.coalesce("meta_user", "mail_user")).withColumn("plan_id", F.coalesce("slug_plan", "product_plan"))
    return out.where("user_id is not null and plan_id is not null").drop("mail_user", "slug_plan", "product_plan")


def applied_events(events: DataFrame) -> DataFrame:
    """Events in arrival order with whether each is applied, and the period that then holds.

    An event is applied if it is newer than the last applied one; one without a time is always applied and starts the order
    anew. A missing period keeps the stored one. Events have subscription_id, arrival, ts, period_end. `last` is the newest
    time since the order began, which later events must exceed.
    """
    by = Window.partitionBy("subscription_id").orderBy("arrival")
    runs = events.withColumn("__run", F.sum(F.col("ts").isNull().cast("int")).over(by))
    before = F.max("ts").over(Window.partitionBy("subscription_id", "__run").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("applied", F.col("ts").isNull() | before.isNull() | (F.col("ts") > before))
    marked = marked.withColumn("held_end", F.last(F.when(F.col("applied"), F.col("period_end")), ignorenulls=True).over(by))
    return marked.withColumn("last", F.greatest(before, F.col("ts"))).drop("__run")


def daily_usage(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Words, uploads and bytes by user and UTC day, added to the stored rows."""
    new = events.select("user_id", F.to_date("ts").alias("usage_date"), "ai_words", "uploads", "upload_bytes")
    every = new if stored is None else new.unionByName(stored.select(new.columns))
    return every.groupBy("user_id", "usage_date").agg(*[F.sum(c).alias(c) for c in ("ai_words", "uploads", "upload_bytes")])


def piece_words(pieces: DataFrame) -> DataFrame:
    """Words that each streamed piece adds: one less if it goes on with a word that the last piece broke off."""
    last = F.lag("content").over(Window.partitionBy("request_id").orderBy("seq"))
    n = F.regexp_count("content", F.lit(r"\S+"))
    broken = F.coalesce(last.rlike(r"\S\z"), F.lit(False)) & (n > 0) & ~F.col("content").rlike(r"^\s")
    return pieces.withColumn("words", n - broken.cast("int"))


def quota_crossing(pieces: DataFrame) -> DataFrame:
    """Per request: counted words and the piece at which the remaining allowance is reached (null: never).

    Pieces have request_id, seq, words, remaining (null: unlimited).
    """
    run = F.sum("words").over(Window.partitionBy("request_id").orderBy("seq"))
    hit = F.when((F.col("words") > 0) & (run >= F.col("remaining")), F.col("seq"))
    counted = pieces.withColumn("hit", hit).groupBy("request_id").agg(F.sum("words").alias("total"), F.min("hit").alias("limit_seq"), F.first("remaining").alias("remaining"))
    return counted.select("request_id", F.when(F.col("limit_seq").isNotNull(), F.col("remaining")).otherwise(F.col("total")).alias("counted"), "limit_seq")


def newest(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def library(files: DataFrame) -> DataFrame:
    """A user's files (user_id, name, size, date, ...) with their place: by name in any case, large ones first, newest first.

    A missing size counts as 0, a missing date comes last. Places come from one order of all files, so a user with a third of
    them is spread over tasks.
    """
    order = [F.lower("name").asc_nulls_last(), F.coalesce("size", F.lit(0)).desc(), F.col("date").desc_nulls_last()]
    return with_ranks(files, ["user_id"], order, "place")


def owned(requests: DataFrame, user_documents: DataFrame) -> DataFrame:
    return requests.join(user_documents.select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")


def not_revoked(events: DataFrame, revoked: DataFrame) -> DataFrame:
    return events.join(revoked.select("token_id"), "token_id", "left_anti")


def claim(state: DataFrame, now: Column, n: int) -> DataFrame:
    """The n documents that are due, oldest first."""
    free = (F.col("status") == "queued") & F.coalesce(F.col("next_attempt_at") <= now, F.lit(True)) & F.coalesce(F.col("claimed_until") <= now, F.lit(True))
    return state.where(free).orderBy("updated_at", "document_id").limit(n)


def housekeeping(state: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Transitions at time `now`: failures are queued again with a delay or fail for good, expired claims return to the queue."""
    failed, last = F.col("status").isin("parser_failure", "resource_limit"), F.col("attempts") >= most
    expired = (F.col("status") == "processing") & (F.col("claimed_until") < now)
    tries = F.col("attempts") + F.when(expired, 1).otherwise(0)
    later = F.timestamp_seconds(F.unix_seconds(now) + retry_delay(F.col("attempts")))
    status = F.when(failed & last, "failed").when(failed | expired, "queued").otherwise(F.col("status"))
    return state.select("document_id", status.alias("status"), tries.cast("int").alias("attempts"), F.when(failed & ~last, later).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"), F.when(~failed & ~expired, F.col("claimed_until")).alias("claimed_until"))
