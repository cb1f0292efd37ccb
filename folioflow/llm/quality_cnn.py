"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; filters of WIDTH bytes slide over them, STRIDE bytes a step. The document is covered
by chunks of two BLOCKs that overlap by one; a chunk's vector holds the largest response of each filter in it. A hidden
layer reads each chunk's vector, its largest outputs over all chunks stand for the document, and a logistic unit turns
them into one probability. The hidden layer sees which filters stay silent in a chunk, so it also notices text that
repeats itself.

The network is trained on the driver on at most MOST_ROWS labelled rows of each class, taken by a hash of the id;
executors get its weights (a few kB) and score every whole text in one pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, slices_by_bytes, text_batches

#: Labelled rows of each class, and characters of their whole texts together, used for training at most.
MOST_ROWS, MOST_CHARS = 600, 6_000_000
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, BLOCK = 6, 8, 2, 24, 16, 64
STEPS, BATCH, RATE, SEED = 600, 24, 4e-3, 7
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"  # rows that are never learned from
_SLICE = 1024  # blocks convolved at once

Weights = dict[str, np.ndarray]


def new_weights(rng: np.random.Generator) -> Weights:
    draw = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
    return {
        "embed": draw(256, EMBED, by=0.5),
        "filters": draw(WIDTH * EMBED, FILTERS, by=(2 / (WIDTH * EMBED)) ** 0.5),
        "filter_bias": np.zeros(FILTERS, dtype=np.float32),
        "hidden": draw(FILTERS, HIDDEN, by=(2 / FILTERS) ** 0.5),
        "hidden_bias": np.zeros(HIDDEN, dtype=np.float32),
        "out": draw(HIDDEN, by=HIDDEN**-0.5),
        "out_bias": np.zeros(1, dtype=np.float32),
    }


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in whole blocks, with zeros for at least a filter's width after each; blocks of each text."""
    counts = np.asarray([-(-(len(t) + WIDTH) // BLOCK) for t in texts], dtype=np.int64)
    data = np.zeros(int(counts.sum()) * BLOCK + WIDTH, dtype=np.uint8)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(n) * BLOCK
    return data, counts


def windows(embedded: np.ndarray, first: int, n: int) -> np.ndarray:
    """The n windows from the first one on, as rows."""
    part = embedded[first * STRIDE : first * STRIDE + (n - 1) * STRIDE + WIDTH]
    step = part.strides[0]
    return np.lib.stride_tricks.as_strided(part, (n, WIDTH * EMBED), (step * STRIDE, part.strides[1]))


def block_responses(w: Weights, data: np.ndarray, argmax: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest response in each block (not below 0), and where it is."""
    per, blocks = BLOCK // STRIDE, (len(data) - WIDTH) // BLOCK
    best = np.empty((blocks, FILTERS), dtype=np.float32)
    place = np.empty((blocks, FILTERS), dtype=np.int64) if argmax else None
    for a in range(0, blocks, _SLICE):
        b = min(blocks, a + _SLICE)
        embedded = w["embed"][data[a * BLOCK : b * BLOCK + WIDTH]]
        out = (np.ascontiguousarray(windows(embedded, 0, (b - a) * per)) @ w["filters"]).reshape(b - a, per, FILTERS)
        if place is None:
            best[a:b] = out.max(1)
        else:
            at = out.argmax(1)
            best[a:b] = np.take_along_axis(out, at[:, None], 1)[:, 0]
            place[a:b] = at + np.arange(a, b)[:, None] * per
    return np.maximum(best + w["filter_bias"], 0), place


def chunk_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each chunk (a text of n blocks has max(1, n - 1)) and the first chunk of each text."""
    chunks = np.maximum(counts - 1, 1)
    first = np.cumsum(chunks) - chunks
    start = np.cumsum(counts) - counts
    return np.repeat(start - first, chunks) + np.arange(int(chunks.sum())), first


def forward(w: Weights, texts: list[bytes]) -> np.ndarray:
    """The probability of each text."""
    if not texts:
        return np.zeros(0)
    data, counts = blocks_of(texts)
    best, _ = block_responses(w, data)
    at, first = chunk_starts(counts)
    nxt = np.minimum(at + 1, np.repeat(np.cumsum(counts) - 1, np.maximum(counts - 1, 1)))
    hidden = np.maximum(np.maximum(best[at], best[nxt]) @ w["hidden"] + w["hidden_bias"], 0)
    pooled = np.maximum.reduceat(hidden, first, axis=0)
    return 1 / (1 + np.exp(-(pooled @ w["out"] + w["out_bias"]).astype(np.float64)))


def gradients(w: Weights, texts: list[bytes], y: np.ndarray) -> Weights:
    """Gradients of the mean log loss; only the responses that won a maximum get one."""
    data, counts = blocks_of(texts)
    best, place = block_responses(w, data, argmax=True)
    at, first = chunk_starts(counts)
    nxt = np.minimum(at + 1, np.repeat(np.cumsum(counts) - 1, np.maximum(counts - 1, 1)))
    left = best[at] >= best[nxt]
    chunk = np.where(left, best[at], best[nxt])
    hidden = np.maximum(chunk @ w["hidden"] + w["hidden_bias"], 0)
    ends = np.append(first[1:], len(at))
    won = np.stack([a + hidden[a:b].argmax(0) for a, b in zip(first, ends, strict=True)])  # text, hidden -> chunk
    pooled = hidden[won, np.arange(HIDDEN)]
    p = 1 / (1 + np.exp(-(pooled @ w["out"] + w["out_bias"])))
    d = (p - y).astype(np.float32) / len(y)
    g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
    d_hidden = d[:, None] * w["out"] * (pooled > 0)  # text, hidden
    rows = won.ravel()
    g["hidden_bias"] = d_hidden.sum(0)
    source = chunk[won]  # text, hidden, filter
    g["hidden"] = np.einsum("thf,th->fh", source, d_hidden)
    d_chunk = d_hidden[..., None] * w["hidden"].T  # text, hidden, filter
    block = np.where(left[rows], at[rows][:, None], nxt[rows][:, None])  # (text, hidden), filter -> block
    spot = place[block, np.arange(FILTERS)]
    d_response = d_chunk.reshape(-1, FILTERS) * (source.reshape(-1, FILTERS) > 0)
    g["filter_bias"] = d_response.sum(0)
    positions = spot[..., None] * STRIDE + np.arange(WIDTH)
    symbols = data[positions]  # row, filter, width
    seen = w["embed"][symbols].reshape(*spot.shape, WIDTH * EMBED)
    g["filters"] = np.einsum("rfi,rf->if", seen, d_response)
    d_seen = (d_response[..., None] * w["filters"].T).reshape(*symbols.shape, EMBED)
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], symbols.ravel(), d_seen.reshape(-1, EMBED))
    return g


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Weights:
    """Adam on batches with both classes in equal parts. Without rows of both classes, the class prior."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    y = np.asarray(labels)
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    if not len(classes[0]) or not len(classes[1]):
        w["out"][:] = 0
        w["out_bias"][:] = 0 if not len(y) else 6 * (2 * y[0] - 1)
        return w
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in gradients(w, [texts[i] for i in chosen], y[chosen]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int) -> list[tuple[str, int]]:
    """At most `most` rows of each class with their whole texts, in the order of a hash of the id, fit for the driver.

    The texts of one class have at most most_chars / 2 characters together: those after that sum are left out as wholes, and
    so are single texts that are longer than it. No text is cut.
    """
    order = F.xxhash64("doc_id")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    parts = [known.where(F.col("y") == c).orderBy(order, "doc_id").limit(most) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * most rows
    share = most_chars // 2
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = docs.join(chosen, "doc_id").where(length <= share).select("doc_id", "text", "y").dropDuplicates(["doc_id"])
    so_far = F.sum(length).over(Window.partitionBy("y").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # at most `most` rows a class
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= share)
    return [(r["text"] or "", r["y"]) for r in rows.orderBy(order, "doc_id").limit(2 * most).collect()]


def fit(texts: DataFrame, labels: DataFrame, held_out: str) -> Weights:
    """The network trained on the driver on the bounded sample of labelled rows for which held_out doesn't hold."""
    sample = labelled_sample(texts, labels.where(~F.expr(held_out)), "quality", MOST_ROWS, MOST_CHARS)
    return train([t.encode() for t, _ in sample], [y for _, y in sample])


def accepted(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier predicts to be good, with all their columns; null and empty texts are scored too."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(id_and_text(docs, id_col, text_col), labels, held_out))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        part = [t.encode() if t else b"" for t in texts]
        cuts = list(slices_by_bytes(part, 1 << 20))
        return pd.Series(np.concatenate([forward(weights.value, part[a:b]) for a, b in cuts]) if cuts else np.zeros(0))

    return docs.where(score(F.col(text_col)) >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Rows for which held_out holds are never learned from. Labels other than 0 and 1, of unknown documents or repeated are
    ignored or used once. A null or empty text is scored as a text without bytes. One result row for each row; without
    labels every score is 0.5.
    """
    texts = id_and_text(docs, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(fit(texts, labels, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in text_batches(batches, 1 << 20):
            score = forward(weights.value, [t.encode() for t in part])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
