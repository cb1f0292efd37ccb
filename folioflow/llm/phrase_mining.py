"""Phrase collocation mining: contiguous phrases that occur often, scored by their weakest cut.

Candidates grow by length, as every part of a frequent phrase is as frequent (Apriori). Words are counted by name. For pairs,
and then for triples, tasks add up 64-bit hashes of the phrases whose parts may all be frequent, and a shuffle adds up the
tasks' sums. A hash's sum is at least the count of each of its phrases, so phrases whose hash stays below the threshold are
safely out. The others are the candidates.

A last pass counts the candidates by their letters. Tasks add up those of some batches at a time, and send each to the shard
of its hash, some MOST_PHRASES phrases a shard. A shard builds a double-array trie over the bytes of language and phrase, and
numpy moves the states of all phrases that came in byte by byte; accepting states add up the counts. So the texts are read
four times, whatever the number of candidates, and no trie leaves its task.

What tasks look up (frequent words, pairs and triples) are bitmaps of at most MOST_BITS bits. They only turn positions away
that cannot matter: where they fill up, more candidates are counted, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, light_batches, stored, text_batches
from .double_array import Trie, build

LEAST, TOP, CONTAINED = 10, 2000, 50
#: Phrases of a trie (about 120 bytes each), batches whose candidates a task adds up together at most, bits of a bitmap, and
#: entries that a task gathers before it emits them.
MOST_PHRASES, TOGETHER, MOST_BITS, MOST_HELD = 1 << 14, 16, 1 << 28, 1 << 20
_BATCH = 1 << 20  # characters
_UND = "und"


def _shape() -> bytes:
    """A-Z in lower case, ends of pieces as a line feed, a tab as a space."""
    ends = b".,;:!?\n\x0b\x0c\r"
    return bytes(10 if b in ends else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


_SHAPE = _shape()


def _odd(label: str) -> np.uint64:
    return np.uint64(int.from_bytes(sha256(label.encode()).digest()[:8], "little") | 1)


_BYTE, _STEP, _MIX1, _MIX2 = (_odd(x) for x in ("byte", "step", "first mix", "second mix"))
_UNBYTE = np.uint64(pow(int(_BYTE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, _BATCH), base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX1
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of a batch of texts, with one space between those of a piece and one line feed after the last: their bytes,
    places, language, and whether the next word follows in the same piece."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray
    langs: list[str]
    follows: np.ndarray

    def hashes(self) -> np.ndarray:
        """Of each word with its language: a polynomial over its bytes, from sums over the batch."""
        n = len(self.buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _power(_BYTE, n), out=sums[1:])
        word = (sums[self.ends] - sums[self.starts]) * _power(_UNBYTE, n)[self.starts]
        seeds = np.array([_odd(f"language {x}") for x in self.langs], np.uint64)
        return _mixed(word ^ seeds[self.lang]) if len(word) else word

    def longer(self, shorter: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the phrases of n words from those of n - 1 words; only meaningful where the phrase is in one piece."""
        return _mixed(shorter[: len(one) - n + 1] * _STEP + one[n - 1 :])

    def within(self, n: int) -> np.ndarray:
        """For each place whether n words from it are in one piece."""
        whole = np.ones(max(len(self.starts) - n + 1, 0), bool)
        for k in range(n - 1):
            whole &= self.follows[k : k + len(whole)]
        return whole


def words_of(texts: list[str], languages: list[str | None]) -> Words:
    shaped = [t.encode().translate(_SHAPE) for t in texts]
    buf = np.frombuffer(b"\n".join(shaped) + b"\n", np.uint8)
    within = (buf != 32) & (buf != 10)
    change = np.flatnonzero(within[1:] != within[:-1]) + 1
    edges = np.concatenate([[0], change]) if within[0] else change  # the last byte is a line feed
    starts, ends = edges[::2], edges[1::2]
    pieces = np.cumsum(buf == 10, dtype=np.int32)[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = pieces[1:] == pieces[:-1]
    langs = sorted({_UND if x is None else x for x in languages})
    numbers = {x: i for i, x in enumerate(langs)}
    own = np.array([numbers[_UND if x is None else x] for x in languages], np.int64)
    in_text = np.diff(np.searchsorted(starts, np.cumsum([len(x) + 1 for x in shaped]), side="left"), prepend=0)
    lang = np.repeat(own, in_text)
    # Of what stands between two words, one byte stays.
    apart = buf.copy()
    apart[ends] = np.where(follows, 32, 10)
    within[ends] = True
    lengths = ends - starts
    places = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(starts)].astype(np.int64)
    return Words(apart[within], places, places + lengths, lang, langs, follows)


class Held:
    """Hashes with their counts and lowest classes (0: none), merged whenever many have come together; given out when more than
    MOST_HELD differ. A key is 56 bits of a hash over 8 bits of a class."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.sort((hashes & ~np.uint64(255)) | kinds)
        heads = _heads(keys)
        self.keys.append(keys[heads])
        self.counts.append(np.diff(np.append(heads, len(keys))))
        self.size += len(heads)
        if self.size > 2 * MOST_HELD:
            self.merge()
            if self.size > MOST_HELD:
                yield from self.given()

    def merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        heads = _heads(keys)
        self.keys, self.counts, self.size = [keys[heads]], [np.add.reduceat(counts, heads)], len(heads)

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            keys = self.keys[0]
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(8)).astype(np.int64)), pa.array(self.counts[0].astype(np.int64)), pa.array((keys & np.uint64(255)).astype(np.int16))], names=["h", "n", "kind"])
        self.keys, self.counts, self.size = [], [], 0


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where each hash begins in sorted keys; its first key has the lowest class."""
    hashes = keys >> np.uint64(8)
    return np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Bitmap:
    """Which hashes may be in a set: no member is missed."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(8)) & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    @classmethod
    def of(cls, hashes: DataFrame, column: str = "h") -> Bitmap:
        """From a stored table; 16 bits a member as far as MOST_BITS allow."""
        n = hashes.count()
        bits = min(MOST_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
        cell = F.col(column).bitwiseAND(F.lit(bits - 1))
        word = F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63L as int))"))
        found = hashes.groupBy(F.shiftright(cell, 6).alias("at")).agg(word.alias("word")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[found.column("at").to_numpy()] = found.column("word").to_numpy()
        return cls(words.view(np.uint64))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch, texts in text_batches(batches, _BATCH):
        yield words_of(texts, batch.column("lang").to_pylist())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word) and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

        for w in _batches(batches):
            letters = w.buf[(w.buf != 32) & (w.buf != 10)]
            offsets = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
            every = pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
            for i, lang in enumerate(w.langs):
                found = (every if len(w.langs) == 1 else every.filter(pa.array(w.lang == i))).value_counts()
                texts = found.field("values").cast(pa.binary()).cast(pa.string())
                held.append(pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": texts, "n": found.field("counts")}))
            if sum(map(len, held)) > 2 * MOST_HELD:
                held = [merged()]
                if len(held[0]) > MOST_HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    counted = docs.mapInArrow(run, "lang string, phrase string, n long")
    return counted.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))  # tasks have added up theirs


def _word_hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words_of(b.column("phrase").to_pylist(), b.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array((w.hashes() >> np.uint64(8)).astype(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h long")


def frequent_hashes(docs: DataFrame, least: int, places: Callable[[Words], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """h of the hashes whose occurrences, over all texts, come to `least`; `places` gives a batch's hashes and which of them
    count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def every() -> Iterator[pa.RecordBatch]:
            for w in _batches(batches):
                found, able = places(w)
                yield from held.add(found[able], np.uint64(0))
            yield from held.given()

        for b in every():
            yield b.select(["h", "n"])

    counted = docs.mapInArrow(run, "h long, n long").repartition("h")  # tasks have added up theirs
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


class Filters:
    """Which places of a batch may begin a frequent pair or triple, by the bitmaps there are; broadcast to the tasks."""

    def __init__(self, ones: Bitmap, twos: Bitmap | None = None, threes: Bitmap | None = None) -> None:
        self.ones, self.twos, self.threes = ones, twos, threes

    def pairs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the pair at each place, which may be frequent)."""
        return self._pairs(w, w.hashes())

    def _pairs(self, w: Words, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        two, able = w.longer(one, one, 2), w.within(2)
        good = self.ones.has(one)
        able = able & good[:-1] & good[1:]
        return two, able & self.twos.has(two) if self.twos else able

    def triples(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs, then of the triples."""
        one = w.hashes()
        two, able = self._pairs(w, one)
        three, longer = w.longer(two, one, 3), able[:-1] & able[1:]
        return two, able, three, longer & self.threes.has(three) if self.threes else longer


def _candidates(w: Words, filters: Filters, shards: int) -> Iterator[pa.Table]:
    """shard, lang, phrase and n of the candidates of a batch, each once, by language and number of words."""
    two, pair, three, triple = filters.triples(w)
    for n, h, able in ((2, two, pair), (3, three, triple)):
        for i, lang in enumerate(w.langs):
            at = np.flatnonzero(able & (w.lang[: len(able)] == i))
            if not len(at):
                continue
            starts, lengths = w.starts[at], w.ends[at + n - 1] - w.starts[at]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            letters = w.buf[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
            found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
            numbers = found.indices.to_numpy()
            shard = np.empty(len(found.dictionary), np.int64)
            shard[numbers] = (h[at] % np.uint64(shards)).astype(np.int64)
            yield pa.table({"shard": shard, "lang": pa.array([lang] * len(shard), pa.string()), "phrase": found.dictionary.cast(pa.binary()), "n": np.bincount(numbers)})


def _packed(tables: list[pa.Table]) -> pa.RecordBatch:
    """A row for each shard and language: the letters of its phrases, and as bytes their lengths and counts."""
    t = pa.concat_tables(tables).group_by(["shard", "lang", "phrase"]).aggregate([("n", "sum")])
    lang = t.column("lang").combine_chunks().dictionary_encode()
    key = t.column("shard").to_numpy() * len(lang.dictionary) + lang.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, phrases = key[order], t.column("phrase").cast(pa.large_binary()).combine_chunks().take(pa.array(order))
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    edges = np.append(heads, len(key))
    offsets = np.frombuffer(phrases.buffers()[1], np.int64)[phrases.offset : phrases.offset + len(phrases) + 1]
    binary = lambda ends, data: pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends.astype(np.int64)), data]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key[heads] // len(lang.dictionary)),
            lang.dictionary.take(pa.array(key[heads] % len(lang.dictionary))),
            binary(offsets[edges], phrases.buffers()[2]),
            binary(edges * 4, pa.py_buffer(np.diff(offsets).astype(np.int32))),
            binary(edges * 8, pa.py_buffer(t.column("n_sum").to_numpy()[order].astype(np.int64))),
        ],
        names=["shard", "lang", "letters", "lengths", "counts"],
    )


def candidate_counts(docs: DataFrame, filters: Broadcast, shards: int, together: int) -> DataFrame:
    """The candidates of all texts with their counts, as _packed gives them, some batches of a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for k, w in enumerate(_batches(batches), 1):
            held.extend(_candidates(w, filters.value, shards))
            if held and (k % together == 0 or sum(map(len, held)) > MOST_HELD // 2):
                yield _packed(held)
                held.clear()
        if held:
            yield _packed(held)

    return docs.mapInArrow(run, "shard long, lang string, letters binary, lengths binary, counts binary")


def walk(trie: Trie, root: int, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of the trie's key that each phrase is; all phrases are keys, and their letters follow each other."""
    at = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, states = at[order], np.full(len(at), root, np.int64)
    longer = len(at) - np.cumsum(np.bincount(lengths))  # phrases of more than so many bytes
    for depth, n in enumerate(longer[:-1].tolist()):
        states[:n] = trie.step(states[:n], letters[at[:n] + depth])[0]
    out = np.empty(len(at), np.int64)
    out[order] = trie.accept[states]
    return out


def phrases_of_shard(group: pa.Table, least: int) -> pa.Table:
    """lang, phrase, words and n of a shard's phrases that occur `least` times, from its rows of candidate_counts()."""
    joined = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    came, langs, texts = [], [], []
    for lang in group.column("lang").unique().to_pylist():
        t = group.filter(pc.equal(group.column("lang"), lang))
        letters, lengths = joined(t, "letters", np.uint8), joined(t, "lengths", np.int32).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        distinct = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).unique().to_pylist()
        came.append((lang, letters, lengths, joined(t, "counts", np.int64)))
        langs += [lang] * len(distinct)
        texts += distinct
    trie = build([f"{lang}\n".encode() + text for lang, text in zip(langs, texts, strict=True)], np.arange(len(texts)))
    total = np.zeros(len(texts), np.int64)
    for lang, letters, lengths, counts in came:
        np.add.at(total, trie.ids[walk(trie, trie.walk(f"{lang}\n".encode()), letters, lengths)], counts)
    kept = np.flatnonzero(total >= least)
    phrase = pa.array([texts[i] for i in kept.tolist()], pa.binary()).cast(pa.string())
    words = pc.add(pc.count_substring(phrase, " "), pa.scalar(1, pa.int32()))
    return pa.table({"lang": pa.array([langs[i] for i in kept.tolist()], pa.string()), "phrase": phrase, "words": words, "n": total[kept]})


def phrase_counts(docs: DataFrame, least: int = LEAST, most_phrases: int = MOST_PHRASES, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n of all words; lang, phrase, words, n of the phrases of 2 and 3 words with n >= least), both stored."""
    send = docs.sparkSession.sparkContext.broadcast
    words = stored(word_counts(docs))
    frequent = stored(_word_hashes(words.where(F.col("n") >= least)))
    ones = Bitmap.of(frequent)
    first = send(Filters(ones))
    pairs = stored(frequent_hashes(docs, least, lambda w: first.value.pairs(w)))
    first.destroy()

    twos = Bitmap.of(pairs)
    second = send(Filters(ones, twos))
    triples = stored(frequent_hashes(docs, least, lambda w: second.value.triples(w)[2:]))
    second.destroy()

    third = send(Filters(ones, twos, Bitmap.of(triples)))
    shards = max(1, -(-(pairs.count() + triples.count()) // most_phrases))
    rows = candidate_counts(docs, third, shards, together)
    counted = stored(rows.groupBy("shard").applyInArrow(lambda group: phrases_of_shard(group, least), "lang string, phrase string, words int, n long"))
    third.destroy()
    for t in (frequent, pairs, triples):
        drop_stored(t)
    return words, counted


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, text_col: str = "text", lang_col: str = "lang", most_phrases: int = MOST_PHRASES, together: int = TOGETHER) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the language; the score is
    floor(1,000,000 a a / (l r)), exact in decimals of 38 digits. A phrase inside a longer candidate that has at least
    `contained` percent of its occurrences is left out. Null texts have no words; a null language is `und`, together with
    documents that say so. Repeated rows count as often as they stand. Languages without a candidate give no rows.
    """
    light_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words, phrases = phrase_counts(rows, least, most_phrases, together)
    known = stored(words.where(F.col("n") >= least).select("lang", "phrase", "n").unionByName(phrases.select("lang", "phrase", "n")))

    w = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.col("words") - F.col("k")))
    count_of = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(count_of("first", "l"), ["lang", "first"]).join(count_of("rest", "r"), ["lang", "rest"])
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    whole = F.lit(1_000_000).cast("decimal(7,0)") * (exact("a", 15) * exact("a", 15))
    cuts = cuts.withColumn("whole", whole.cast("decimal(38,0)")).withColumn("score", F.expr("whole div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")

    inside = lowest.where("words = 3").select("lang", F.explode(F.array(part(F.lit(1), F.lit(2)), part(F.lit(2), F.lit(2)))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
