"""Importance resampling towards a target distribution of hashed word runs.

Runs of one to three words fall into hashed buckets. Buckets that the target's texts use more than the documents do have a
positive gain, and a document's weight is the sum of the gains of its runs. Documents are drawn without repeats in
proportion to exp(weight / 1000), by adding Gumbel noise seeded by the id and taking the highest scores.

Weights come from bit-sliced aggregation. Bit i of a document's 10,000 bucket counts is one plane of 10,000 bits, and bit j of
the gains, in two's complement, another. The number of ones in the AND of two planes counts 2^(i + j) each, and the gains'
sign plane counts negative, so the sum over the planes is the exact weight.

The corpus is read twice, for the buckets' sums and for the weights; nothing of the texts is shuffled. The gains' planes (20 kB)
are all that the driver sends out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_positions
from .common import id_and_text, light_batches, stored, text_batches

BUCKETS, SHARE, MIN_WORDS, SEED = 10_000, 5, 20, 42
#: Bytes of a text that are split into words at a time, and texts whose counts are sliced together.
CHUNK, TOGETHER = 1 << 20, 64
_PLANE = -(-BUCKETS // 64)  # words of 64 bits


def _letters() -> bytes:
    """Bytes of words as they are, A-Z in lower case, all other ASCII as a space."""
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes(b if b in kept else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


_LETTERS = _letters()


def word_runs(text: str, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of one to three words that end in them) for each chunk of a whole text."""
    data, at, before = text.encode().translate(_LETTERS), 0, []
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        new = data[at:end].split()
        words = before + new
        # A checksum goes on from the checksum of what stands before, so each longer run takes one more step.
        one = list(map(crc32, words))
        after = [b" " + w for w in words[1:]]
        two = list(map(crc32, after, one))
        three = list(map(crc32, after[1:], two))
        k = len(before)
        runs = one[k:] + two[max(k - 1, 0) :] + three[max(k - 2, 0) :]
        yield len(new), (np.array(runs, np.uint32) % np.uint32(buckets)).astype(np.int64)
        at, before = end, words[-2:]


def bucket_sums(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many runs of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in text_batches(batches):
            for t in texts:
                for _, found in word_runs(t, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    light_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros(buckets, np.int64)
    for r in counted.collect():  # a row for each bucket
        sums[r["bucket"]] = r["n"]
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of B buckets, s of S runs in the corpus and t of T in the target."""
    b = len(corpus)
    whole, aim = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aim))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of rows of integers: (bits, rows, words of 64 bits)."""
    rows, n = values.shape
    out = np.zeros((bits, rows, -(-n // 64) * 8), np.uint8)
    for i in range(bits):
        out[i, :, : -(-n // 8)] = np.packbits(((values >> i) & 1).astype(bool), axis=1)
    return out.view(np.uint64)


def sliced_weights(counts: np.ndarray, gain_planes: np.ndarray) -> np.ndarray:
    """Sum of count times gain over the buckets for each row of counts; the last gain plane is the sign's."""
    weights = np.zeros(len(counts), np.int64)
    top = len(gain_planes) - 1
    for i, ours in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
        for j, gain in enumerate(gain_planes):
            ones = np.bitwise_count(ours & gain).sum(axis=1, dtype=np.int64)
            weights += (-ones if j == top else ones) << (i + j)
    return weights


def with_weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    bits = int(np.abs(gain).max()).bit_length() + 1
    sliced, buckets = planes(gain[None, :], bits), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            words, weights, features = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a in range(0, len(texts), TOGETHER):
                some = texts[a : a + TOGETHER]
                counts = np.zeros((len(some), buckets), np.int64)
                for k, t in enumerate(some):
                    for n, found in word_runs(t, buckets):
                        words[a + k] += n
                        counts[k] += np.bincount(found, minlength=buckets)
                features[a : a + TOGETHER] = counts.sum(axis=1)
                weights[a : a + TOGETHER] = sliced_weights(counts, sliced)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1, null if not drawn) of each row of documents.

    `share` percent, rounded down, of the documents with at least min_words words are drawn: the highest scores, ties to the
    smaller id. Null and empty texts have no words, no runs and weight 0, and are never drawn. Rows of equal ids have equal
    noise and are ranked one by one; a null id takes the noise of an empty one and comes first among ties. An empty target
    or table gives gains that are the same for all runs, or no rows.
    """
    gain = gains(bucket_sums(docs, buckets), bucket_sums(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(with_weights(docs, gain).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= min_words
    drawn = share * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").desc(), F.col("n_features").asc()]
    place = F.col("place") + 1
    ranked = with_positions(scored.where(able), order, "place").withColumn("rank", F.when(place <= drawn, place))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest.select("doc_id", "n_features", "weight", "score", "rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents with all their columns; rows that share a drawn id all come."""
    ids = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
