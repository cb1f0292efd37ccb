"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give each word a probability after the word before it. Pairs of words count as
often as they stand; they back off to single words, which count by the number of kinds of words before them, and these to
their spelling: each letter after up to ORDER - 1 letters before it, the longest n-grams counted as often as they stand, the
shorter ones by kinds. Counts are absolutely discounted, by less than one and as estimated from how many n-grams stand once
and twice, so an n-gram that stands once keeps weight. The shortest contexts of letters fall back to one distribution that
both classes share, from the letters of the whole corpus, so a rare expression is no evidence by itself, while forms of a
word that were never seen share the evidence of their stem. Runs of digits and of symbols are words too.

A word's evidence is the difference of its two log-likelihoods. A document has the difference normalised by its length,
and the evidence of its strongest word, as a few toxic words in a long ordinary text would vanish in the mean. A logistic
unit turns both into one score.

Class counts come from at most MOST_ROWS labelled documents of each class, the logistic unit from others, so what is broadcast
is bounded by that sample. The shared counts, in a table of
fixed size, are summed over all documents in one pass with map-side sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import Table
from .common import id_and_text, text_batches
from .quality_cnn import labelled_sample

#: Labelled rows of each class, and characters of them all, used for class counts and for the logistic unit, at most.
MOST_ROWS, MOST_CHARS = 2000, 16_000_000
#: Longest n-gram of letters; bits of the table of shared counts; counts by which every context is taken to be longer, so
#: that rare ones decide little; words whose evidence a worker keeps.
ORDER, SHARED_BITS, CONTEXT, KEPT = 5, 18, 4.0, 500_000
#: Characters of labelled texts whose words the driver holds at once, and words whose evidence it keeps.
SLICE, KEPT_FITTING = 500_000, 100_000
_WORD = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_START, _END = "\x01", "\x02"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, of digits and of symbols."""
    return _WORD.findall(text.lower())


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts a few at a time, so that only their words are held at once: up to SLICE characters, or one longer text."""
    part, chars = [], 0
    for t in texts:
        if part and chars + len(t) > SLICE:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


class Letters:
    """The letters of many words in one row, each word after ORDER - 1 starts and with an end, and keys of their n-grams."""

    def __init__(self, words: list[str]):
        start = _START * (ORDER - 1)
        self.codes = np.frombuffer((start + f"{_END}{start}".join(words) + _END).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.at = np.flatnonzero(self.codes != 1)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.first = np.cumsum(self.lengths) - self.lengths

    def keys(self, n: int, context: bool) -> np.ndarray:
        """Keys of the n letters that end at each letter, or of the n - 1 before it."""
        key = np.full(len(self.at), 2 * n + context + 1, dtype=np.uint64)
        for k in range(n - 1, -1 + context, -1):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (self.codes[self.at - k] + 1).astype(np.uint64)
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(1)).astype(np.int64)


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in words), np.int64, len(words))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words.astype(np.uint64)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(1)).astype(np.int64)


def discounted(keys: np.ndarray, contexts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams with what their discounted counts give them, and contexts with what they leave to shorter ones."""
    grams, one, which = np.unique(keys, return_index=True, return_inverse=True)
    contexts, back = np.unique(contexts, return_inverse=True)
    counts, owner = np.bincount(which, weight), back[one]
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
    share = (counts - discount) / (np.bincount(back, weight)[owner] + CONTEXT)
    left = 1 - np.bincount(owner, share, minlength=len(contexts))
    return grams, share.astype(np.float32), contexts, left.astype(np.float32)


class ClassModel:
    """One class: what n-grams of letters, words and pairs of words get, and what their contexts leave to shorter ones."""

    def __init__(self, texts: list[str]):
        # Words as numbers and pairs as arrays: tuples of strings take many times their memory.
        number: dict[str, int] = {"": 0}
        pairs = np.zeros(0, np.int64)
        times = np.zeros(0, np.int64)
        for part in slices(texts):
            seen = [np.fromiter((number.setdefault(w, len(number)) for w in ["", *words_of(t)]), np.int64) for t in part]
            both = np.concatenate([pairs, *((ids[:-1] << 32) | ids[1:] for ids in seen)])
            pairs, which = np.unique(both, return_inverse=True)
            times = np.bincount(which, np.concatenate([times, np.ones(len(both) - len(times), np.int64)]), len(pairs)).astype(np.int64)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(pairs):
            return
        words, after = list(number), pairs & 0xFFFFFFFF
        weights = [np.bincount(after, w, len(words))[1:] for w in (None, times)]
        letters, keys = Letters(words[1:]), word_keys(words)
        for n in range(1, ORDER + 1):
            self.orders.append(discounted(letters.keys(n, False), letters.keys(n, True), np.repeat(weights[n == ORDER].astype(np.float64), letters.lengths)))
        del letters
        self.orders.append(discounted(keys[1:], np.zeros(len(keys) - 1, np.int64), weights[0].astype(np.float64)))
        before = keys[pairs >> 32]
        self.orders.append(discounted(pair_keys(before, keys[after]), before, times.astype(np.float64)))

    def ready(self) -> ClassModel:
        """Put the n-grams into tables for look-ups."""
        if not hasattr(self, "tables"):
            self.tables = []
            for grams, share, contexts, left in self.orders:
                pair = []
                for keys, values in ((grams, share), (contexts, left)):
                    table = Table(max(4, int(2 * len(keys)).bit_length()))
                    table.put(keys, np.arange(len(keys), dtype=np.int32))
                    pair.append((table, np.append(values, 0).astype(np.float32)))
                pair[1][1][-1] = 1
                self.tables.append(pair)
        return self

    def __getstate__(self):
        return {"orders": self.orders}

    def after(self, pairs: np.ndarray, left: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of words after others: keys of both, what the first leaves, the word's own one."""
        return self._mixed(ORDER + 1, pairs, left, alone)

    def left(self, order: int, contexts: np.ndarray) -> np.ndarray:
        """Logarithms of what contexts leave to shorter ones."""
        if not self.ready().tables:
            return np.zeros(len(contexts))
        rows, left = self.tables[order][1]
        with np.errstate(divide="ignore"):
            return np.log(left[rows.get(contexts)].astype(np.float64))

    def _mixed(self, order: int, keys: np.ndarray, left: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        out = left + shorter
        if self.ready().tables:
            grams, share = self.tables[order][0]
            row = grams.get(keys)
            at = np.flatnonzero(row >= 0)  # most pairs of words were never seen
            with np.errstate(divide="ignore"):
                out[at] = np.logaddexp(np.log(share[row[at]].astype(np.float64)), out[at])
        return out


def logs_alone(models: tuple[ClassModel, ...], letters: Letters, shared: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """For each model, logarithms of the probabilities of words by themselves."""
    ps = [shared for _ in models]
    for n in range(1, ORDER + 1):
        ends, before = letters.keys(n, False), letters.keys(n, True)
        for i, m in enumerate(models):
            if m.ready().tables:
                (grams, share), (contexts, left) = m.tables[n - 1]
                ps[i] = share[grams.get(ends)] + left[contexts.get(before)] * ps[i]
    none = np.zeros(len(keys), np.int64)
    return [m._mixed(ORDER, keys, m.left(ORDER, none), np.add.reduceat(np.log(p), letters.first)) for m, p in zip(models, ps, strict=True)]


class Shared:
    """Letters of the whole corpus after up to two letters, in one table of hashed counts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    @staticmethod
    def places(letters: Letters) -> list[np.ndarray]:
        """For contexts of 0 to 2 letters, the places of n-gram and of context."""
        mask = (1 << SHARED_BITS) - 1
        return [letters.keys(n, c) & mask for n in (1, 2, 3) for c in (False, True)]

    def probability(self, letters: Letters) -> np.ndarray:
        p = np.full(len(letters.at), 1 / 256)
        places = self.places(letters)
        for gram, context in zip(places[::2], places[1::2], strict=True):
            p = (self.counts[gram] + 8 * p) / (self.counts[context] + 8)
        return np.minimum(p, 1.0)


class Evidence:
    """Differences of the log-likelihoods of words after the words before them.

    Most pairs of words stand once, so they are looked up as they come, as arrays of numbers. What a word has by itself
    (its key, its probabilities, what it leaves as a context) is kept for up to `kept` words.
    """

    def __init__(self, toxic: ClassModel, ordinary: ClassModel, shared: Shared, kept: int = KEPT):
        self.models, self.shared, self.kept = (toxic, ordinary), shared, kept
        self.clear()

    def __getstate__(self):
        return {"models": self.models, "shared": self.shared, "kept": self.kept}

    def __setstate__(self, state: dict):
        self.__dict__ |= state
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.keys, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros((4, 0))  # of each model: the word alone, what it leaves to words after it
        self._add([""])

    def _add(self, words: list[str]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        letters, keys = Letters(words), word_keys(words)
        alone = logs_alone(self.models, letters, self.shared.probability(letters), keys)
        self.keys, self.lengths = np.append(self.keys, keys), np.append(self.lengths, letters.lengths - 1)
        self.values = np.concatenate([self.values, [*alone, *(m.left(ORDER + 1, keys) for m in self.models)]], axis=1)

    def of(self, texts: list[str]) -> np.ndarray:
        """For each text the difference by letter, and the largest one of its words."""
        seen = [words_of(t) for t in texts]
        words = set().union(*seen)
        new = words.difference(self.number)
        if len(self.number) + len(new) > self.kept:
            self.clear()
            new = words
        if new:
            self._add(list(new))
        out, counts = np.zeros((len(texts), 2)), np.fromiter(map(len, seen), np.int64, len(seen))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(seen)), np.int64, counts.sum())
        if len(ids):
            some = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[some]
            before = np.append(0, ids[:-1])
            before[first] = 0
            gain = self._gains(before, ids)
            out[some, 0] = np.add.reduceat(gain, first) / (counts[some] + np.add.reduceat(self.lengths[ids], first))
            out[some, 1] = np.maximum.reduceat(gain, first)
        return out

    def _gains(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        pairs = pair_keys(self.keys[before], self.keys[words])
        one, other = (m.after(pairs, self.values[i + 2][before], self.values[i][words]) for i, m in enumerate(self.models))
        return one - other


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic unit (bias last) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def corpus_counts(texts: DataFrame) -> DataFrame:
    """Counts of the letters of all documents by their place in the shared table: summed in each task, then over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SHARED_BITS)
        for _, part in text_batches(batches):
            spaced, counts = Counter(), Counter()  # what white space parts is split into words once, not as often as it stands
            for t in part:
                spaced.update(t.lower().split())
            for piece, n in spaced.items():
                for w in _WORD.findall(piece):
                    counts[w] += n
            if counts:
                letters = Letters(list(counts))
                weight = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), letters.lengths)
                for place in Shared.places(letters):
                    total += np.bincount(place, weight, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["place", "n"])

    return texts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 5 = 0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Rows for which held_out holds are never learned from. A null or wordless text has no evidence: its score is the
    logistic unit's at 0. One result row for each row, with equal or null ids too. Labels other than 0 and 1 or of unknown
    documents are ignored; without labels of both classes every score is near 0.
    """
    texts = id_and_text(docs, id_col, text_col)
    known = labels.where(~F.expr(held_out))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(3))
    train = labelled_sample(texts, known.where(fold > 0), "toxic", MOST_ROWS, MOST_CHARS)
    tune = labelled_sample(texts, known.where(fold == 0), "toxic", MOST_ROWS, MOST_CHARS)
    ordinary, toxic = (ClassModel([t for t, y in train if y == c]) for c in (0, 1))
    counts = np.zeros(1 << SHARED_BITS)
    found = corpus_counts(texts).toArrow()  # at most 2^SHARED_BITS rows
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    shared = Shared(counts.astype(np.float32))
    y = np.asarray([c for _, c in tune])
    evidence = Evidence(toxic, ordinary, shared, KEPT_FITTING)
    unit = fit_logistic(np.concatenate([evidence.of(part) for part in slices([t for t, _ in tune])]), y) if len(set(y.tolist())) == 2 else np.asarray([0.0, 0.0, -30.0])
    evidence.clear()
    model = docs.sparkSession.sparkContext.broadcast((Evidence(toxic, ordinary, shared), unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, unit = model.value  # a worker's tasks share what it keeps of words
        for batch, part in text_batches(batches):
            score = 1 / (1 + np.exp(-np.clip(evidence.of(part) @ unit[:2] + unit[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
