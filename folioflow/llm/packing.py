"""Packing of documents into windows of a fixed number of tokens by Karmarkar-Karp multiway differencing.

Documents are encoded in one pass and cut into full windows and pieces; ids stay behind, only lengths and checksums go
on. Pieces are dealt by a hash into groups of about GROUP_WINDOWS windows, whatever document they are from. In a group the
pieces are differenced: every piece starts as a partial partition of m sums, and the two partitions with the largest
spreads are merged, the largest sums of one with the smallest of the other, until one is left with m near-equal windows.
m starts at the least number that could do and rises for as long as a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, read_bytes, stored, text_batches
from .token_files import id_bytes

WINDOW, GROUP_WINDOWS, PIECE = 4096, 128, 512


_NODE = 32  # bits for the number of a node, below a sum


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Indexes of the sizes in m sets with near-equal sums (Karmarkar-Karp).

    A partial partition is a rising list of its sums, less the least one of m, each with a node that stands for the members
    of its set; sums of sets without members are left out. A node is a size, or two nodes that were joined.
    """
    if m == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(m - 1))]
    joined: list[tuple[int, int]] = []
    low = (1 << _NODE) - 1
    heap = [(-x, i, [x << _NODE | i]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - m
        if over <= 0:
            both = sorted(a + b)
        else:  # the smallest of one with the largest of the other that would else have no set of their own
            both = []
            for x, y in zip(a[:over], reversed(b[:over]), strict=True):
                both.append(((x >> _NODE) + (y >> _NODE) << _NODE) | (n + len(joined)))
                joined.append((x & low, y & low))
            both = sorted(both + a[over:] + b[over:])
        if over >= 0 and both[0] > low:
            least = both[0] >> _NODE << _NODE
            both = [x - least for x in both]
        heapq.heappush(heap, (-(both[-1] >> _NODE), n + len(joined) + len(heap), both))
    sets = []
    for x in heap[0][2]:
        todo, members = [x & low], []
        while todo:
            k = todo.pop()
            if k < n:
                members.append(k)
            else:
                todo += joined[k - n]
        sets.append(members)
    return sets + [[] for _ in range(m - len(sets))]


def windows_of(sizes: list[int], window: int) -> list[list[int]]:
    """Indexes of the sizes (each at most `window`) in as few windows as differencing fits them into."""
    if not sizes:
        return []
    m = -(-sum(sizes) // window)
    while True:
        sets = difference(sizes, m)
        if all(sum(sizes[i] for i in s) <= window for s in sets):
            return [s for s in sets if s]
        m += 1


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, piece: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows first, then the rest in pieces of at most `piece` tokens."""
    definition = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), id_bytes(definition.value, texts, 4), strict=True):
                data = ids + end
                n = len(data) // 4
                full = n // window * window
                cuts = [*range(0, full, window), *range(full, n, piece), n]
                rows += [(doc, a, b - a, zlib.crc32(data[4 * a : 4 * b]), n) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """The pieces with sequence_id and offset.

    The number of groups follows the number of tokens, so a group stays small at any size. sequence_id is unique: the
    group's number times 2^20 and the window's number in it. Pieces of a window stand in order of doc_id and start.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (window * group_windows)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        sizes = group["length"].to_numpy()
        whole, rest = np.flatnonzero(sizes == window), np.flatnonzero(sizes < window)
        sequence[whole] = np.arange(len(whole))
        for k, members in enumerate(windows_of(sizes[rest].tolist(), window), len(whole)):
            at = rest[np.sort(members)]
            sequence[at] = k
            offset[at] = np.cumsum(sizes[at]) - sizes[at]
        return group.assign(sequence_id=group.pop("packing_group").to_numpy() * (1 << 20) + sequence, offset=offset)

    row = F.monotonically_increasing_id()  # else equal or null ids would meet in one group; a task run again numbers alike
    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start", row), F.lit(groups)))
    return dealt.groupBy("packing_group").applyInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and pack all ids: one row for each piece.

    A null text counts as empty and gives one piece with end_id. Repeated rows are packed like any others. An empty table
    gives no rows. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    return pack(stored(cut_pieces(docs, tokenizer_path, end_id, window, piece, id_col, text_col)), window)
