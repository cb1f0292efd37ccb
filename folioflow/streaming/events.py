"""Streams of webhook, usage and document events; each has a batch twin in operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.usage import applied_events, piece_words
from ..sources.keyed import KeyedTable


def once_within(events: DataFrame, key: str = "event_key", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events but for repeats of a key within the delay; state is bounded by the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


LEDGER = "event_key string, claimed_at timestamp"


def ledger_step(ledger: KeyedTable, results: str, order: str = "ts", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes the batch's events whose key no earlier batch has claimed, the first of each key.

    The batch meets only the ledger's buckets of its keys, and adds its own. A ledger forgets nothing unless it is made with
    `expired`; a repeated batch reads the ledger as it was before it, so it gives the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        cols = [c for c in batch.columns if c != "event_key"]
        first = batch.groupBy("event_key").agg(F.min_by(F.struct(*cols), order).alias("e")).select("event_key", "e.*")
        before = ledger.read(ledger.buckets_of(batch), before=number)
        out = f"{results}/batch={number}"
        first.join(before, "event_key", "left_anti").select(batch.columns).write.mode("overwrite").parquet(out)
        ledger.replace(number, batch.sparkSession.read.schema(batch.schema).parquet(out).select("event_key", F.col(ts).cast("timestamp").alias("claimed_at")))

    return step


SUBSCRIPTION = "subscription_id long, last timestamp, held_end long, seen timestamp"


def subscription_step(state: KeyedTable, results: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each event with whether it is applied and the period that then holds, by arrival.

    State of a subscription: the time that newer events must exceed, the period, and when it was last seen, by which a state
    table made with `expired` forgets ended ones. The state stands before the batch's events as one more event, so the batch
    operator decides, with windows by subscription and no Python.
    """
    fields = ["subscription_id", "arrival", "ts", "period_end"]

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(fields)
        held = state.read(state.buckets_of(new), before=number).join(new.select("subscription_id"), "subscription_id", "left_semi")
        before = held.select("subscription_id", F.lit(None).cast("long").alias("arrival"), F.col("last").alias("ts"), F.col("held_end").alias("period_end"))
        out = f"{results}/batch={number}"
        decided = applied_events(new.unionByName(before)).where("arrival is not null")
        decided.select(*fields, "applied", "held_end", "last").write.mode("overwrite").parquet(out)
        done = batch.sparkSession.read.schema(decided.select(*fields, "applied", "held_end", "last").schema).parquet(out)
        newest = done.groupBy("subscription_id").agg(F.max_by(F.struct("last", "held_end"), "arrival").alias("s"), F.max("ts").alias("seen"))
        state.replace(number, newest.select("subscription_id", "s.last", "s.held_end", "seen"))

    return step


def daily_usage(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Sums by user and UTC day; in update mode each batch gives the days that changed."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "user_id")
        .agg(*[F.sum(c).alias(c) for c in ("ai_words", "uploads", "upload_bytes")])
        .select("user_id", F.to_date("window.start").alias("usage_date"), "ai_words", "uploads", "upload_bytes")
    )


def rate_breaches(events: DataFrame, most: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Keys with more than `most` requests in a minute."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select("user_id", F.col("window.start").alias("minute"), "n")


CROSSING = "request_id long, counted long, limit_seq long, broken boolean, seen timestamp"


def quota_step(state: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: running words of each request and the piece at which its allowance is reached, given once.

    State of a request: its words so far, that piece, and whether the last piece broke off in a word, so that the word is not
    counted again; and when the request was last seen, for a table made with `expired`. Pieces have request_id, seq, content,
    remaining and ts, and arrive in order of seq. The state stands before them as a piece whose content only says how the
    last one ended.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select("request_id", "seq", "content", "remaining", "ts")
        held = state.read(state.buckets_of(new), before=number).join(new.select("request_id"), "request_id", "left_semi")
        before = held.select("request_id", F.lit(None).cast("long").alias("seq"), F.when(F.col("broken"), "x").otherwise(" ").alias("content"), "counted", "limit_seq", "seen")
        pieces = piece_words(new.unionByName(before, allowMissingColumns=True))
        old = F.col("seq").isNull()
        words = pieces.withColumn("words", F.when(old, F.col("counted")).otherwise(F.col("words")))
        run = F.sum("words").over(Window.partitionBy("request_id").orderBy("seq"))
        allowed = F.max("remaining").over(Window.partitionBy("request_id"))
        hit = F.when(old, F.col("limit_seq")).when((F.col("words") > 0) & (run >= allowed), F.col("seq"))
        ends = F.max_by(F.coalesce(F.col("content").rlike(r"\S\z"), F.lit(False)), "seq")
        sums = words.withColumn("hit", hit).groupBy("request_id").agg(
            F.sum("words").alias("total"), F.coalesce(F.max(F.when(old, F.col("limit_seq"))), F.min("hit")).alias("limit_seq"), F.max("remaining").alias("remaining"), ends.alias("broken"), F.greatest(F.max("ts"), F.max("seen")).alias("seen")
        )
        counted = F.when(F.col("limit_seq").isNotNull(), F.col("remaining")).otherwise(F.col("total"))
        state.replace(number, sums.select("request_id", counted.alias("counted"), "limit_seq", "broken", "seen"))

    return step


def ingestion_step(chunks: KeyedTable, chunked: Callable[[DataFrame], DataFrame], order: str, drop_empty: bool = True) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: new and changed documents replace their chunks in the chunk table.

    A batch may bring several versions of a document; the last by `order` counts. A document that now has no chunks loses its
    old ones (drop_empty), or keeps them.
    """

    def step(batch: DataFrame, number: int) -> None:
        key = chunks.key
        last = batch.groupBy(key).agg(F.max_by(F.struct(*(c for c in batch.columns if c != key)), order).alias("d")).select(key, "d.*")
        chunks.replace(number, chunked(last), batch if drop_empty else None)

    return step


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the last batch that has each key: updates over earlier values, or whole documents over earlier ones."""
    last = rows.withColumn("last", F.max("batch").over(Window.partitionBy(*keys)))
    return last.where("batch = last").drop("batch", "last")
