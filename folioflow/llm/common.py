"""Helpers shared by the training-data operators: table access, shared scratch folders, broadcast of tokenizer files."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the Unicode property White_Space, as tokenizer patterns understand it.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors can reach.

    Only where that setting is absent (local tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.get("FOLIOFLOW_SCRATCH") or tempfile.mkdtemp(prefix="spark-folioflow-")
        root = f"file://{root}"
        spark.sparkContext._conf.set("spark.checkpoint.dir", root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to a shared folder and read again.

    This cuts the lineage: a lost executor costs the running tasks only, and a table used twice is computed once. The
    shuffle files of the job are deleted at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files below spark.checkpoint.dir that a table reads, once its rows are written elsewhere."""
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    root = hadoop.Path(spark.conf.get("spark.checkpoint.dir")).toUri().getPath().rstrip("/") + "/"
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = hadoop.Path(folder)
        if path.toUri().getPath().startswith(root):
            path.getFileSystem(conf).delete(path, True)


def read_bytes(path: str) -> bytes:
    """A small driver-side file, such as a tokenizer's definition."""
    with open(path, "rb") as f:
        return f.read()


def slices_by_bytes(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about `most` characters each; one longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that each holds about `most` characters, with the column `text` as Python strings (null: "")."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in slices_by_bytes(texts, most):
            yield batch.slice(a, b - a), texts[a:b]


def light_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows, unless the session asks for smaller ones: rows here hold whole texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= 1000:
        spark.conf.set(key, "1000")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever other columns there are."""
    light_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
