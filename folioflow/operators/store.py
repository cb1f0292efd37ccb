"""The chunk table: upsert, replacing documents, side table for large tables, profile merges, event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..sources.keyed import KeyedTable
from .chunking import PREVIEW_ROWS, TABLE_ROWS, preview


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Base rows without an update, and the last update of each key; of equally late ones the greatest by its other columns."""
    own = F.struct(*(c for c in updates.columns if c not in (key, order)))
    last = updates.groupBy(key).agg(F.max_by(own, F.struct(order, F.to_json(own))).alias("u")).select(key, "u.*")
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def replace_documents(base: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks of documents that have no new ones, and the new ones."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


SIDE = "document_id string, table_index int, markdown string"


def side_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """Whole large tables in files, in buckets by the hash of their document."""
    return KeyedTable(spark, path, "document_id", SIDE, buckets)


def overflow(tables: DataFrame, side: KeyedTable, number: int, rows: int = TABLE_ROWS, shown: int = PREVIEW_ROWS) -> DataFrame:
    """The tables (document_id, table_index, markdown) as chunks show them: markdown, truncated and table_path.

    Tables of more than `rows` data rows go whole into the side table, in batch `number`, where they replace all that the
    batch's documents had there; their chunk keeps header, separator and the first rows, and the key under which the whole is
    found. Others are as they were, with a null key.
    """
    big = T.data_rows("markdown") > rows
    side.replace(number, tables.where(big).select("document_id", "table_index", "markdown"), tables)
    key = F.when(big, F.concat_ws("/", "document_id", F.col("table_index").cast("string")))
    return tables.withColumns({"truncated": big, "table_path": key, "markdown": F.when(big, preview(F.col("markdown"), shown)).otherwise(F.col("markdown"))})


def whole_tables(asked: DataFrame, side: KeyedTable) -> DataFrame:
    """table_path and markdown of the asked tables (table_path; nulls ask for nothing); only their documents' buckets are read."""
    key = asked.where("table_path is not null").select("table_path").distinct()
    key = key.withColumn("document_id", F.regexp_extract("table_path", "^(?s)(.*)/[^/]*$", 1))
    held = side.read(side.buckets_of(key)).withColumn("table_path", F.concat_ws("/", "document_id", F.col("table_index").cast("string")))
    return held.join(key.select("table_path"), "table_path", "left_semi").select("table_path", "markdown")


def with_whole_tables(rows: DataFrame, side: KeyedTable, name: str, by: list[str]) -> DataFrame:
    """The rows and the whole of their tables in the column `name`, null where table_path is null.

    Rows without a table would all meet under the null key in one task. So they take keys of their own, from the columns `by`
    that tell rows apart; these have no slash, which all keys of tables have.
    """
    key = F.coalesce("table_path", F.xxhash64(*by).cast("string"))
    whole = whole_tables(rows, side).select(F.col("table_path").alias("__key"), F.col("markdown").alias(name))
    return rows.withColumn("__key", key).join(whole, "__key", "left").drop("__key")


def merge_profiles(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys; new values that are not null win."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in old.columns if c != key])


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
