"""Mixing sources to target weights.

Words are added up for each source, a repetition rate follows from the source's target, and each document is emitted
floor(rate) times, and once more if a draw seeded by its id's hash falls below the rate's fraction.

A source's draws come from one of SEEDS seeds: the sums that each seed would give are taken in one aggregation, and the seed
that comes nearest to the source's target holds. Each seed is a plain Bernoulli draw by document; the choice only turns down
unlucky ones, as few long documents of a small source could miss the target by a tenth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_positions
from .common import stored

#: Weights by a source's place in the order of names, repeating; share of all words; most repeats of a source.
WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 1.5, 2
SEEDS = 32
#: Sources that are broadcast to the documents, at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target and rate for each row (source, source_size).

    Weights repeat over the sources in code point order, null last. All targets together are `share` of all sizes; a target
    stops at `most` times its source's size, and what is over goes to the others by weight, until none is above. Each round
    is an aggregation over the table of sources; the driver holds its sums only. A source without words has target 0.
    """
    placed = with_positions(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("position") % len(weights)).cast("int") + 1)
    s = stored(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most")))
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, known = 0.0, -1  # the target of a unit of weight; it only rises, and so does the number of full sources
    while True:
        full = F.col("most") < F.lit(level) * F.col("weight")
        n_full, held, free = s.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n_full == known:
            break
        known, level = n_full, (total - (held or 0.0)) / free if free else math.inf
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return s.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _draws(id_col: str, seeds: int) -> Column:
    """A number in (0, 1) for each seed: eight hexadecimal digits of a hash of the id, which eight seeds share."""
    hashes = [F.sha2(F.concat(F.lit(f"{k}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256) for k in range(-(-seeds // 8))]
    number = lambda j: F.conv(F.substring(hashes[j // 8], j % 8 * 8 + 1, 8), 16, 10).cast("double")
    return F.array(*((number(j) + 0.5) / 4294967296.0 for j in range(seeds)))


def _with_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Rows with the columns of their source, a null source being one too; `sources` has it as __source."""
    return rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seeds: int = SEEDS) -> DataFrame:
    """__source, source_size, target, rate and seed of each source, for rows (doc_id, source, size)."""
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "__source"))
    fraction = F.col("rate") - F.floor("rate")
    rated = _with_source(sized, targets, targets.count() <= MOST_BROADCAST).withColumn("draws", _draws("doc_id", seeds))
    taken = [F.sum(F.when(F.col("draws")[j] < fraction, F.col("size")).otherwise(0)).alias(f"taken_{j}") for j in range(seeds)]
    sums = rated.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.floor("rate")).alias("whole"), *taken)
    off = [F.abs(F.col("whole") + F.col(f"taken_{j}") - F.col("target")) for j in range(seeds)]
    nearest = sums.select(F.col("source").alias("__nearest"), (F.array_position(F.array(*off), F.least(*off)) - 1).cast("int").alias("seed"))
    return stored(targets.join(nearest, F.col("__source").eqNullSafe(F.col("__nearest")), "left").drop("__nearest"))


def with_copies(rows: DataFrame, plan: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """Rows (with doc_id and source) with source_size, target and copies: how often the mix takes the row."""
    fraction = F.col("rate") - F.floor("rate")
    once_more = F.element_at(_draws("doc_id", seeds), F.col("seed") + 1) < fraction
    return _with_source(rows, plan, plan.count() <= MOST_BROADCAST).withColumn("copies", F.floor("rate").cast("long") + once_more.cast("long")).drop("rate", "seed")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) for each row of documents.

    Null texts have size 0; documents without a source are a source of their own, the last one. Rows of equal or null ids
    are drawn alike. An empty table gives no rows.
    """
    sized = stored(_sized(docs, id_col, text_col, source_col))
    mixed = with_copies(sized, mixing_plan(sized, **options))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mixed documents: each row with all its columns, as often as the mix takes it, with `copy` from 1."""
    plan = mixing_plan(stored(_sized(docs, id_col, text_col, source_col)), **options)
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row")
    mixed = with_copies(docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source")), plan).where("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("__row.*", "copy")
