"""Global order: positions over all rows without a window of one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

_ID, _PART = "__folioflow_id", "__folioflow_part"
_IN_PART = (1 << 33) - 1  # monotonically_increasing_id has the row in its partition below bit 33


def with_positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The rows with their place (from 0) in the order of all rows.

    Rows are dealt out by ranges of the order and numbered inside their partition; the driver gets one count a partition,
    so neither a task nor the driver holds more than its range. Ties of the order take any place; an order that ends in a
    unique column splits a hot value over tasks. The numbered rows are written once, as a second run of the range
    partitioning could draw other borders.
    """
    numbered = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_ID, F.monotonically_increasing_id()))
    part = F.shiftright(_ID, 33)
    sizes = sorted((r[0], r[1]) for r in numbered.groupBy(part).agg(F.count("*")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, f"{_PART} long, {name} long")
    placed = numbered.join(F.broadcast(starts), part == F.col(_PART), "left")
    return placed.withColumn(name, F.col(name) + F.col(_ID).bitwiseAND(F.lit(_IN_PART))).drop(_ID, _PART)


def with_ranks(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The rows with their place (from 1) among the rows of equal keys, nulls being equal.

    A key with a third of all rows is spread over tasks: places are global, and a key's first place is taken off.
    """
    placed = with_positions(rows, [*(F.col(k) for k in keys), *order], name)
    firsts = placed.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(name).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return placed.join(firsts, same, "left").withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first", *(f"__{k}" for k in keys))
