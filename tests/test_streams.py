"""Tables changed by micro-batches: replays, tombstones, buckets written anew, forgotten rows; steps fed batch by batch."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.plans import QUERIES, SQL
from folioflow.sources.keyed import KeyedTable
from folioflow.sources.scratch import drain, feed, shared_dir
from folioflow.streaming import events as E

SCHEMA = "k string, v long"


def held(table, **options):
    return sorted(map(tuple, table.read(**options).collect()), key=str)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.mark.parametrize(("buckets", "most"), [(1, 1), (4, 2), (4, 100)])
def test_keyed_table(spark, buckets, most):
    t = KeyedTable(spark, shared_dir(spark), "k", SCHEMA, buckets, most)
    assert held(t) == []
    t.replace(0, rows(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4)))
    t.replace(1, rows(spark, ("a", 5), ("c", 6)))
    after = held(t)
    assert set(after) == {("a", 5), ("b", 3), ("c", 6), (None, 4)} and len(after) == 4
    t.replace(2, rows(spark), rows(spark, ("b", 0), ("zz", 0)))
    t.replace(3, rows(spark))
    assert set(held(t)) == {("a", 5), ("c", 6), (None, 4)}
    t.replace(4, rows(spark, ("b", 9)))
    last = held(t)
    assert set(last) == {("a", 5), ("b", 9), ("c", 6), (None, 4)}
    # A repeated batch writes the same again, and sees nothing of itself.
    t.replace(4, rows(spark, ("b", 9)))
    assert held(t) == last and set(held(t, before=4)) == {("a", 5), ("c", 6), (None, 4)} and set(held(t, before=1)) == {("a", 1), ("a", 2), ("b", 3), (None, 4)}
    mine = t.buckets_of(rows(spark, ("c", 0)))
    assert ("c", 6) in held(t, buckets=mine) and (buckets == 1 or len(held(t, buckets=mine)) < 4 or len(mine) == 1)
    t.vacuum()
    assert held(t) == last


def test_expired_rows_go_when_a_bucket_is_written_anew(spark):
    t = KeyedTable(spark, shared_dir(spark), "k", SCHEMA, 1, 1, expired=lambda r: F.col("v") < 10)
    t.replace(0, rows(spark, ("old", 1), ("new", 20)))
    t.replace(1, rows(spark, ("other", 30)))
    assert held(t) == [("new", 20), ("other", 30)]


def test_ledger_drops_replays_in_and_between_batches(spark):
    path = shared_dir(spark)
    ledger = KeyedTable(spark, f"{path}/ledger", "event_key", E.LEDGER, 4)
    part = lambda *r: spark.createDataFrame(list(r), "event_key string, n long, ts timestamp")
    day = F.lit("2026-01-01").cast("timestamp")
    parts = [[("a", 2), ("a", 1), ("b", 3)], [], [("b", 4), ("c", 5)], [("a", 2), ("a", 1), ("b", 3)], [("c", 6), ("d", 7), ("d", 7)]]
    feed([part(*((k, n, None) for k, n in p)).withColumn("ts", day) for p in parts], E.ledger_step(ledger, f"{path}/rows", order="n"), path)
    got = spark.read.parquet(f"{path}/rows")
    assert sorted((r["batch"], r["event_key"], r["n"]) for r in got.collect()) == [(0, "a", 1), (0, "b", 3), (2, "c", 5), (4, "d", 7)]
    E.ledger_step(ledger, f"{path}/rows", order="n")(part(("b", 4, None), ("c", 5, None)), 2)
    assert sorted((r["batch"], r["event_key"], r["n"]) for r in spark.read.parquet(f"{path}/rows").collect()) == [(0, "a", 1), (0, "b", 3), (2, "c", 5), (4, "d", 7)]


def test_subscription_state_goes_on(spark):
    path = shared_dir(spark)
    state = KeyedTable(spark, f"{path}/state", "subscription_id", E.SUBSCRIPTION, 2)
    e = spark.createDataFrame([(1, 1, "2026-01-05", 10), (1, 2, "2026-01-05", 11), (1, 3, "2026-01-06", None), (2, 4, "2026-01-01", None), (1, 5, "2026-01-02", 12), (1, 6, None, 13), (1, 7, "2026-01-01", 14)], "subscription_id long, arrival long, day string, period_end long").withColumn("ts", F.col("day").cast("timestamp")).drop("day")
    feed([e.where("arrival <= 2"), e.where("arrival in (3, 4, 5)"), e.where("arrival = 6"), e.where("arrival = 7")], E.subscription_step(state, f"{path}/rows"), path)
    got = {r["arrival"]: (r["applied"], r["held_end"]) for r in spark.read.parquet(f"{path}/rows").collect()}
    assert got == {1: (True, 10), 2: (False, 10), 3: (True, 10), 4: (True, None), 5: (False, 10), 6: (True, 13), 7: (True, 14)}


def test_quota_counts_a_broken_word_once_over_batches(spark):
    state = KeyedTable(spark, shared_dir(spark), "request_id", E.CROSSING, 2)
    step = E.quota_step(state)
    schema = "request_id long, seq long, content string, remaining long, ts timestamp"
    for n, part in enumerate([[(1, 0, "hel", 3, None)], [(1, 1, "lo world", 3, None), (2, 0, "a b c d", 3, None)], [(1, 2, " next", 3, None), (2, 1, " e", 3, None)], []]):
        step(spark.createDataFrame(part, schema), n)
    assert sorted((r["request_id"], r["counted"], r["limit_seq"]) for r in state.read().collect()) == [(1, 3, 2), (2, 3, 0)]


def test_once_within_a_delay(spark):
    path = shared_dir(spark)
    part = lambda *r: spark.createDataFrame(list(r), "event_key string, n int, at string").select("event_key", "n", F.col("at").cast("timestamp").alias("ts"))
    part(("a", 1, "2026-01-01"), ("b", 2, "2026-01-01"), ("a", 3, "2026-01-01 01:00:00")).coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("event_key string, n int, ts timestamp").parquet(f"{path}/in")
    rows = drain(E.once_within(stream)).collect()
    assert sorted(r["event_key"] for r in rows) == ["a", "b"]


@pytest.mark.parametrize("name", ["t3_daily_meter", "t5_rate_check"])
def test_events_of_many_files(spark, tmp_path, name):
    # More files than a batch took, in no order of time; times that round into the next day; events without a user.
    k = F.col("id")
    ts = F.timestamp_micros(1_704_067_200_000_000 + (k % 30 + 1) * 86_400_000_000 - F.when(k % 4 == 0, 300_000).otherwise(40_000_000_000))
    user = F.when(k % 7 > 0, k % 11)
    e = spark.range(3000).select(k.alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), user.alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.repartition(120).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(QUERIES[name](spark, str(tmp_path)).select(columns).collect()) == text(wanted.fetchall())
