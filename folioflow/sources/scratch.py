"""Folders that the driver and all executors share, for results of streams and tables used more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset (local tests), below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to a shared folder and read again, for tables that a job uses more than once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain(stream: DataFrame, mode: str = "append", path: str | None = None, transform=None) -> DataFrame:
    """Run a stream over what is there now; the rows of all micro-batches, each with its batch number.

    Every batch goes to a folder of its own, which a repeated batch overwrites, so a restart writes nothing twice.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch, number) if transform else batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def feed(parts: list[DataFrame], step: Callable[[DataFrame, int], None], path: str) -> None:
    """Run a stream over parts that arrive one after the other, each in a run of its own that goes on from the last one.

    What a scheduled job sees: new files, then a micro-batch; batch numbers go on over the runs.
    """
    for part in parts:
        part.write.mode("append").parquet(f"{path}/arrived")
        arrived = part.sparkSession.readStream.schema(part.schema).parquet(f"{path}/arrived")
        arrived.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
