"""N-gram Jaccard self-join by PartEnum signatures, with classes of linked documents.

A document is the set of its distinct word shingles. If two sets have a Jaccard similarity of at least the threshold, their
sizes differ by a bounded factor, and the smaller one bounds their Hamming distance H. Sizes fall into overlapping bands
so that two such sets always share a band. A band splits the shingle domain into n1 parts by a hash. Of a set's first H + s
parts with shingles at most H differ, so s of them are equal, and they are among the other set's first H + s too: each
subset of s of them is a signature (s is 2 for small sets, else 1). Empty parts are passed over, so no two sets meet in them;
a set with too few parts is split into single shingles as well, of which it has enough.

Lines that many documents share would bring dissimilar ones together. Signatures are therefore made without common shingles:
sets without these differ in no more shingles than whole ones do, so the same numbers of parts or single shingles are enough.
A set with fewer of the others than that has the signatures of the whole set, too; of two such sets both have them, and in any
other pair the one with enough decides. Which shingles count as common is read off a bounded sample of the documents. It only
decides how many candidates there are: the classes are the same with any choice.

Documents with one set are first brought together by the set's 128-bit key. Documents that share a signature are candidates:

* each group of candidates has a hub, the one with most candidates; each document is compared with the hubs of its groups,
  and the links found make components. Pairs inside a component are never made;
* documents around a hub that still stand in different components are compared with one another, in one group for each hub,
  by parity bits and then exactly, until they are in one component;
* where too many for one group stand around a hub, they are compared with the hub. A and B with the differences
  D(A) and D(B) to the hub have a Hamming distance of |D(A)| + |D(B)| - 2 |D(A) & D(B)|, so similar ones share a number of
  differences, unless both are linked to the hub anyway. Both are then among the first few of D(A) and of D(B) in one order
  (prefix filter), what the hub lacks coming first. How few depends on both sizes, so documents are dealt into classes by
  the size of D, and a pair of classes has keys of its own.

So a large group of copies costs a comparison and a few keys for each document, and no link between different components is
lost. Before two sets are brought together, a few parity bits of each give a lower bound of their Hamming distance, which
turns most candidates down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, id_and_text, stored
from .components import connected_components

#: Width of a size band, largest size of a band whose signatures are pairs of parts, spare parts of a band.
BAND_RATIO, PAIRED, SPARE = 1.92, 28, 0.12
#: About so many documents show which shingles are common: those found in so many of them at least, and no more of these than that.
SAMPLED, COMMON, MOST_COMMON = 16_384, 12, 1 << 16
#: Documents around a hub that are paired directly, at most; those that make one group, and their shingles (8 MB); classes that
#: half the allowed difference to a hub makes.
FEW, CROWD, CROWDED, CLASSES = 64, 1024, 1 << 20, 2
#: Bits of the bitmaps that keep rows without candidates out, at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Words whose hashes a worker keeps, and the longest of them.
WORDS, LONG_WORD = 300_000, 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.zeros(0, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _N
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(n: int) -> np.uint64:
    return np.uint64(n * int(_M) & 0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; with fewer words, of the whole sequence; without words, none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * _M + h[i : len(h) - k + 1 + i])
    return np.unique(out)


@dataclass(frozen=True)
class Scheme:
    """Bands of set sizes for a similarity of at least percent / 100."""

    percent: int

    def differences(self, size: int) -> int:
        """The largest Hamming distance of a set of this size and a similar one that isn't smaller."""
        return (100 - self.percent) * size // self.percent

    def bands(self, most: int) -> list[tuple[int, int]]:
        """(smallest, largest) size of each band, up to the band of size `most`; smaller sets have no similar ones."""
        low = 1
        while self.differences(low) < 1:
            low += 1
        out = []
        while low <= most:
            high = max(-(-low * 100 // self.percent), int(low * BAND_RATIO))  # so the next band starts higher
            out.append((low, high))
            low = high * self.percent // 100 + 1
        return out

    def signatures(self, sets: list[np.ndarray], common: np.ndarray = _NONE) -> list[np.ndarray]:
        """The signatures of each set, made without the shingles that are common (sorted) as far as the others are enough."""
        out: list[list[np.ndarray]] = [[] for _ in sets]
        sizes = np.asarray([len(s) for s in sets])
        rare = _without(sets, common)
        left = np.asarray([len(s) for s in rare])
        for number, (low, high) in enumerate(self.bands(int(sizes.max(initial=0)))):
            chosen = np.flatnonzero((sizes >= low) & (sizes <= high))
            together = 2 if high <= PAIRED else 1
            need = np.asarray([self.differences(int(n)) + together for n in sizes])
            n1 = int((self.differences(high) + together) * (1 + SPARE)) + 1
            short = chosen[(left[chosen] < need[chosen]) & (left[chosen] < sizes[chosen])]
            for of, rows in ((rare, chosen[left[chosen] > 0]), (sets, short)):
                if len(rows):
                    for i, found in zip(rows, _signed([of[i] for i in rows], need[rows], n1, together, number), strict=True):
                        out[i] += found
        return [np.concatenate(x) if x else _NONE for x in out]


def _without(sets: list[np.ndarray], common: np.ndarray) -> list[np.ndarray]:
    if not len(common) or not sets:
        return sets
    every = np.concatenate(sets)
    keep = common[np.minimum(np.searchsorted(common, every), len(common) - 1)] != every
    ends = np.cumsum([len(s) for s in sets])[:-1]
    return [s[k] for s, k in zip(sets, np.split(keep, ends), strict=True)]


def _signed(sets: list[np.ndarray], need: np.ndarray, n1: int, together: int, number: int) -> list[list[np.ndarray]]:
    """For each set, none of them empty, the signatures of its first parts, and of single shingles if the parts are too few."""
    h = _mix(np.concatenate(sets) + _times(number + 1))
    cells = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * n1 + (h % np.uint64(n1)).astype(np.int64)
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.diff(cells[order], prepend=-1))
    owner, part = np.divmod(cells[order[starts]], n1)
    totals = _mix(np.add.reduceat(_mix(h)[order], starts) + part.astype(np.uint64) * _M + _times(number + 64))
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    out = []
    for i, s in enumerate(sets):
        out.append([_subsets(totals[first[i] : min(first[i + 1], first[i] + need[i])], together)])
        if first[i + 1] - first[i] < need[i]:
            out[i].append(_subsets(np.sort(_mix(s + _times(number + 128)))[: need[i]], together))
    return out


def _subsets(x: np.ndarray, together: int) -> np.ndarray:
    if together == 1:
        return x
    a, b = np.triu_indices(len(x), 1)
    return _mix(x[a] * _N + x[b])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles found in COMMON documents or more of a sample, the MOST_COMMON most frequent at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([_NONE, *(shingle_set(t or "", shingle) for t in batch.column("text").to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, texts.count()))) < SAMPLED).select("text")
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    most = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    return np.sort(np.asarray([r["shingle"] for r in most], dtype=np.int64).view(np.uint64))


def signature_table(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, key (of the set, empty without words) and signatures; of a task's equal sets, the first has them.

    Rows with a null doc_id have none and don't count as first.
    """
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, known = Scheme(percent), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(t or "", shingle) for t in part.column("text").to_pylist()]
                keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else b"" for s in sets]
                named = part.column("doc_id").is_valid().to_pylist()
                if len(known) > 1_000_000:
                    known.clear()
                fresh = []
                for i, k in enumerate(keys):
                    if k and named[i] and k not in known:
                        known.add(k)
                        fresh.append(i)
                found = dict(zip(fresh, scheme.signatures([sets[i] for i in fresh], common.value), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists([found.get(i, _NONE) for i in range(len(sets))])],
                    ["doc_id", "mark", "n_shingles", "key", "signatures"],
                )

    return texts.mapInArrow(run, "doc_id long, mark long, n_shingles long, key binary, signatures array<long>")


class Bitmap:
    """Hashed places of values in a bitmap, whose size follows their number up to a fixed bound."""

    def __init__(self, values: DataFrame, column: str):
        """values is a stored table; its column holds longs."""
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * values.count() - 1).bit_length()))
        spot = F.pmod(F.col(column), F.lit(self.bits)) + 1
        bits = values.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        bitmap = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in bits.collect():  # at most MOST_BITS / 8 bytes
            piece = np.frombuffer(r["bits"], dtype=np.uint8)
            at = (r["bucket"] - 1) * len(piece)
            bitmap[at : at + len(piece)] = piece[: len(bitmap) - at]
        self.shared = values.sparkSession.sparkContext.broadcast(bitmap)

    def has(self, values: np.ndarray) -> np.ndarray:
        """For 64-bit values, whether they are (or may be) among those of the bitmap."""
        spots = values & np.int64(self.bits - 1)
        return (self.shared.value[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)


def with_shared(signed: DataFrame, repeated: Bitmap) -> DataFrame:
    """doc_id, key and those signatures that the bitmap holds; rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("signatures")
            values, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            on = repeated.has(values)
            left = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[on], minlength=len(lengths))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), pa.array(values[on], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], ["doc_id", "key", "signatures"]).filter(pa.array(left > 0))

    return signed.select("doc_id", "key", "signatures").mapInArrow(run, "doc_id long, key binary, signatures array<long>")


def parity(hashes: np.ndarray, bits: int = 0) -> np.ndarray:
    """One bit for each of `bits` places, or of 1 to 2 times as many as shingles (a power of two, 64 at least): whether the
    number of shingles at the place is odd. The bits in which two sets differ are no more than their Hamming distance."""
    bits = bits or max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def wanted_sets(texts: DataFrame, ids: Bitmap, repeated: Bitmap, shingle: int) -> DataFrame:
    """doc_id, spot, size, parity bits and shingle hashes of (at least) the documents in the bitmap of hashed ids, stored.

    An id has a row for each of its sets. Only rows of ids in the bitmap of repeated ones are shuffled for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(ids.has(batch.column("spot").to_numpy()))
            for a in range(0, len(rows), 128):
                part = batch.take(pa.array(rows[a : a + 128]))
                sets = [shingle_set(t or "", shingle) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), part.column("spot"), pa.array([len(x) for x in sets], pa.int64()), _lists([parity(x) for x in sets]), _lists(sets), pa.array(repeated.has(part.column("spot").to_numpy()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spot", "size", "parity", "hashes", "again"])

    spotted = texts.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("spot"))
    made = stored(spotted.mapInArrow(run, "doc_id long, spot long, size long, parity array<long>, hashes array<long>, again boolean"))
    once = stored(made.where("again").drop("again").dropDuplicates(["doc_id", "hashes"]))
    return made.where("not again").drop("again").unionByName(once)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity bits don't rule out the similarity: a lower bound of the Hamming distance, so none is lost.

    The longer bits are folded to the length of the shorter ones, which keeps parities.
    """
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("size").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("na") > 0))
    long, short = F.when(F.size("pa") > F.size("pb"), F.col("pa")).otherwise(F.col("pb")), F.when(F.size("pa") > F.size("pb"), F.col("pb")).otherwise(F.col("pa"))
    joined = joined.withColumn("long", long).withColumn("short", short)
    fold = F.when(F.size("long") == F.size("short"), F.col("long")).otherwise(F.zip_with(F.slice("long", 1, F.size("short")), F.slice("long", F.size("short") + 1, F.size("short")), lambda x, y: x.bitwiseXOR(y)))
    differ = F.aggregate(F.zip_with(fold, "short", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # Similar sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
    return joined.where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select(*pairs.columns)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with both sets x and y; only the sets of stored pairs are moved."""

    return pairs.join(_needed(pairs, sets, "a", "x"), "a").join(_needed(pairs, sets, "b", "y"), "b")


def _needed(rows: DataFrame, sets: DataFrame, name: str, column: str) -> DataFrame:
    """The sets of (at least) the ids in a column of stored rows, under the names given."""
    ids = stored(rows.select(name).distinct().select(F.xxhash64(name).alias("spot")))
    needed = Bitmap(ids, "spot")
    drop_stored(ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(needed.has(batch.column("spot").to_numpy()))).select(["doc_id", "hashes"])

    return sets.select("doc_id", "spot", "hashes").mapInArrow(pick, "doc_id long, hashes array<long>").withColumnsRenamed({"doc_id": name, "hashes": column})


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of at least percent / 100."""
    pairs = stored(pairs.select("a", "b").distinct())  # an id with several sets gives a pair for each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = stored(_with_sets(pairs, sets).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    drop_stored(pairs)
    return found


def joining_links(sets: list[np.ndarray], parts: list[int], percent: int) -> list[tuple[int, int]]:
    """Places of pairs of similar sets that join the parts as all their links would, each link joining two of them."""
    sizes = np.asarray([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, part = sizes[order], np.asarray(parts)[order]
    places = min(4096, max(64, 1 << int(np.median(sizes)).bit_length()))
    bits = np.stack([parity(sets[i], places) for i in order])
    found = []
    for i in range(len(order)):
        end = np.searchsorted(sizes, 100 * sizes[i] // percent, "right")
        rest = slice(i + 1, end)
        differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = (part[rest] != part[i]) & ((100 + percent) * differ <= (100 - percent) * (sizes[rest] + sizes[i]))
        for j in i + 1 + np.flatnonzero(near):
            if part[i] != part[j]:
                both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    part[part == part[j]] = part[i]
                    found.append((int(order[i]), int(order[j])))
    return found


def linked_in_crowds(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the parts of each crowd, for stored rows (hub, a, part) of crowds that fit in memory."""

    def links(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        found = joining_links([x for _, _, x in rows], [part for _, part, _ in rows], percent)
        return pa.RecordBatch.from_arrays([pa.array([rows[k[side]][0] for k in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for batch in batches:
            column = batch.column("x")
            values, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())[:-1]
            for h, a, part, x in zip(batch.column("hub").to_pylist(), batch.column("a").to_pylist(), batch.column("part").to_pylist(), np.split(values, ends), strict=True):
                if h != hub and held:
                    yield links(held)
                    held = []
                hub = h
                held.append((a, part, x.copy()))
        if held:
            yield links(held)

    rows = crowds.join(_needed(crowds, sets, "a", "x"), "a").where("size(x) > 0").select("hub", "a", "part", "x")
    return rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, "a long, b long")


def difference_keys(x: np.ndarray, hub: np.ndarray, hub_id: int, percent: int) -> tuple[bool, np.ndarray]:
    """Whether a set is similar to its hub's, and keys of which it shares one with each similar set around the hub that
    is not linked to the hub like itself.

    With D the differences to the hub and W = (100 + percent) |D| - (100 - percent) |x|, two similar sets share at least
    (W + W') / 2 / (100 + percent) differences. Classes are ranges of W; a similar set's W differs by a bounded amount. The
    two lowest bits of a key are 0 for a pair of equal classes, else 1 in the lower class and 2 in the higher one: they are
    not shared, but add up to 0 or 3.
    """
    p, q = 100 + percent, 100 - percent
    new, gone = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    d = np.concatenate([np.sort(_mix(new)), np.sort(_mix(gone))])
    w, width = p * len(d) - q * len(x), max(1, q * len(hub) // percent // CLASSES) * p
    linked, least = p * len(d) <= q * (len(x) + len(hub)), w - 2 * q * 100 * len(x) // percent
    if linked:  # no keys are needed for others that are linked too, whose W is at most this
        least = max(least, q * len(hub) + 1)
    own, keys = w // width, []
    for other in range(least // width, (w + 2 * q * len(x)) // width + 1):
        shared = max(1, -(-(w + max(other * width, least)) // (2 * p)))
        if shared <= len(d):
            salt = _times(hub_id * 1_000_003 + min(own, other) * 65_537 + max(own, other))
            side = 0 if own == other else 1 if own < other else 2
            keys.append(_mix(d[: len(d) - shared + 1] + salt) & ~np.uint64(3) | np.uint64(side))
    return linked, np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def around_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each stored pair (a, b = hub), whether they are similar (`linked`) and the keys of a's differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, hubs = batch.column("x"), batch.column("y"), batch.column("b").to_pylist()
            found = [difference_keys(left[i].values.to_numpy().view(np.uint64), right[i].values.to_numpy().view(np.uint64), hubs[i], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("part"), pa.array([f[0] for f in found], pa.bool_()), _lists([f[1] for f in found])], ["a", "b", "part", "linked", "keys"])

    return _with_sets(pairs, sets).select("a", "b", "part", "x", "y").mapInArrow(run, "a long, b long, part long, linked boolean, keys array<long>")


def jaccard_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Documents link when 100 * intersection >= percent * union of their shingle sets. One result row for each row; rows
    with one doc_id are one document's copies. A null or wordless text has an empty set, n_shingles 0 and links with nothing:
    its component is its doc_id. A null doc_id keeps a null component and takes no part.
    """
    classes = _classes(docs, shingle, percent, id_col, text_col)
    return classes.select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of jaccard_classes() and `mark`, a hash of the row's text."""
    texts = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    signed = stored(signature_table(texts, shingle, percent))
    table = stored(signed.select("doc_id", "mark", "n_shingles", "key"))
    heads = stored(table.where("doc_id is not null and n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("head")))  # combined before the shuffle

    # Groups of documents that share a signature, with the class of equal sets in the documents' place.
    counts = signed.select(F.explode("signatures").alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))
    repeated = stored(counts.where("n > 1").select("signature"))
    sharing = with_shared(signed, Bitmap(repeated, "signature"))
    rows = stored(sharing.join(heads, "key").select("head", F.explode("signatures").alias("signature")).distinct())
    drop_stored(signed)
    drop_stored(repeated)
    sizes = rows.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1")
    groups = rows.join(sizes, "signature").select("signature", F.col("head").alias("doc_id"), "size")
    groups = stored(groups)
    drop_stored(rows)
    central = stored(groups.groupBy("doc_id").agg(F.sum("size").alias("shares")))
    wanted = stored(central.select(F.xxhash64("doc_id").alias("spot")))
    again = stored(table.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("doc_id").alias("spot")))
    sets = wanted_sets(texts, Bitmap(wanted, "spot"), Bitmap(again, "spot"), shingle)
    drop_stored(wanted)
    drop_stored(again)

    # Each document against the hubs of its groups.
    hubs = groups.join(central, "doc_id").groupBy("signature").agg(F.max_by("doc_id", F.struct("shares", -F.col("doc_id"))).alias("hub"))
    around = stored(groups.select("signature", "doc_id").join(hubs, "signature"))
    drop_stored(groups)
    drop_stored(central)
    stars = around.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links = similar(possible(stars, sets, percent), sets, percent)

    # Around hubs of groups that still hold several components.
    parts = connected_components(links).withColumnRenamed("node", "doc_id")
    placed = around.join(parts, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    open_ = placed.groupBy("signature").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("signature")
    left = stored(placed.join(open_, "signature", "left_semi").select("hub", F.col("doc_id").alias("a"), "part").distinct())
    drop_stored(around)
    lengths = sets.groupBy(F.col("doc_id").alias("a")).agg(F.sum("size").alias("size"))
    crowd = stored(left.join(lengths, "a").groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")))
    few = left.join(crowd.where(F.col("n") <= FEW), "hub")
    other = few.select("hub", F.col("a").alias("b"), F.col("part").alias("part_b"))
    pairs = few.join(other, "hub").where("a < b and part <> part_b").select("a", "b").distinct()  # at most FEW / 2 for each row
    held = (F.col("n") <= CROWD) & (F.col("shingles") <= CROWDED)
    some = stored(left.join(crowd.where((F.col("n") > FEW) & held), "hub").select("hub", "a", "part"))
    inside = stored(linked_in_crowds(some, sets, percent))
    many = stored(left.join(crowd.where((F.col("n") > FEW) & ~held), "hub").where("a <> hub").select("a", F.col("hub").alias("b"), "part"))
    keyed = stored(around_hubs(many, sets, percent))
    keys = keyed.select("a", "part", F.explode("keys").alias("key")).select("a", "part", F.shiftright("key", 2).alias("key"), F.col("key").bitwiseAND(3).alias("side"))
    other = keys.select("key", F.col("a").alias("b"), F.col("part").alias("part_b"), F.col("side").alias("side_b"))
    met = keys.join(other, "key").where("a < b and part <> part_b and (side + side_b) % 3 = 0").select("a", "b").distinct()
    more = similar(possible(pairs.union(met).distinct(), sets, percent), sets, percent)
    every = links.union(inside).union(more).union(keyed.where("linked").select("a", "b"))
    classes = connected_components(every).select(F.col("node").alias("head"), F.col("component").alias("of_head"))

    by_key = stored(heads.join(classes, "head", "left").select("key", F.coalesce("of_head", "head").alias("component")))
    for t in (sets, left, crowd, some, inside, many, keyed, links, more, heads):
        drop_stored(t)
    joined = table.join(by_key, "key", "left")
    return joined.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but for all of each class of linked ones except the one with the smallest id; all columns stay.

    Of rows that are equal in id and text one stays. Documents without words and rows with a null id link with nothing and
    stay. An id with several texts is one document; each of its rows stays or goes with the class of its own text.
    """
    classes = stored(_classes(docs, shingle, percent, id_col, text_col).where("doc_id is not null"))
    named = docs.select("*", F.col(id_col).cast("long").alias(_ID), F.xxhash64(text_col).alias(_MARK))
    key = [F.col("doc_id").alias(_ID), F.col("mark").alias(_MARK)]
    gone = classes.where("doc_id <> component_id").select(*key).distinct()
    twice = classes.where("doc_id = component_id").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    left = named.join(gone, [_ID, _MARK], "left_anti")
    once = left.join(twice, [_ID, _MARK], "left_anti")
    return once.unionByName(left.join(twice, [_ID, _MARK], "left_semi").dropDuplicates([_ID, _MARK])).select(*docs.columns)


_ID, _MARK = "__folioflow_id", "__folioflow_mark"
