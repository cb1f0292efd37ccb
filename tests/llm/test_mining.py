"""Resampling, collocations and mixing against brute force."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from folioflow.llm import importance_resampling as R
from folioflow.llm import phrase_mining as P
from folioflow.llm import source_mixing as M
from folioflow.llm.double_array import Trie, build

DOCS = "doc_id long, text string, lang string, source string, words int, n long, id string, route string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def made_up(seed=5, n=90):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "bank", "Straße", "naïve", "日本", "x1", "a-b", "#", "é"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\xa0 "]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "en", "de", None, "und"]), rng.choice(["a", "b", "ä", None, "Z", "10"])) for i in range(n)]
    rows += rows[:5] + [(None, "The of bank", "en", "a"), (n + 1, None, "en", "a"), (n + 2, "", None, None), (n + 3, "The of " * 300, "de", "big"), (n + 4, "y" * 5000 + " of bank", "de", "a")]
    return [(*r, 1, 2, "x", "y") for r in rows]


def test_trie_holds_its_keys():
    rng = random.Random(1)
    keys = list({bytes(rng.choice(b"abc d\xc3") for _ in range(rng.randint(1, 9))) for _ in range(2000)})
    trie = Trie.from_bytes(build(keys, np.arange(len(keys)) * 7).to_bytes())
    known = dict(zip(keys, np.arange(len(keys)) * 7, strict=True))
    for q in keys + [bytes(rng.choice(b"abc dz\xc3") for _ in range(rng.randint(1, 9))) for _ in range(2000)]:
        s = trie.walk(q)
        assert (trie.ids[trie.accept[s]] if s >= 0 and trie.accept[s] >= 0 else None) == known.get(q)


def phrases(rows, least, top, contained=50):
    """Collocations by dictionaries of word tuples."""
    f, n = {}, Counter()
    for r in rows:
        lang = r[2] or "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least or any(len(q) > len(p) and b >= least and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "most"), [(10, 2000, P.MOST_PHRASES), (3, 12, 40), (1, 50, 700)])
def test_collocations(spark, least, top, most):
    rows = made_up()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = P.collocations(docs, least, top, most_phrases=most, together=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == phrases(rows, least, top)


def test_collocations_of_nothing(spark):
    assert P.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert P.collocations(spark.createDataFrame([(1, None, None, None, 1, 2, "", "")], DOCS)).count() == 0


def test_passes_do_not_grow_with_candidates(spark, monkeypatch):
    # Every few tries of candidates once cost one more pass over the texts.
    docs, passes, kept = spark.createDataFrame(made_up(), DOCS), [], P.stored
    monkeypatch.setattr(P, "stored", lambda df: passes.append(df.columns) or kept(df))
    for most in (P.MOST_PHRASES, 20):
        passes.append(most)
        assert P.collocations(docs, 2, 5, most_phrases=most, together=1).count()
    assert passes[1 : passes.index(20)] == passes[passes.index(20) + 1 :]


def test_candidates_of_several_batches():
    class Every:
        def has(self, hashes):
            return np.ones(len(hashes), bool)

    rows = [(t, lang or "und") for _, t, lang, *_ in made_up() if t] + [("of " + "y" * 3000 + " bank", "de")] * 2
    filters, want = P.Filters(Every()), Counter()
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, " ".join(w[i : i + k]), k) for k in (2, 3) for i in range(len(w) - k + 1))
    cut = [rows[:1], rows[1:30], rows[30:31], rows[31:]]
    tables = [list(P._candidates(P.words_of([t for t, _ in b], [x for _, x in b]), filters, 7)) for b in cut]
    sent = pa.Table.from_batches([P._packed(sum(part, [])) for part in (tables[:2], tables[2:])])
    for least in (1, 3):
        got = [P.phrases_of_shard(sent.filter(pc.equal(sent.column("shard"), i)), least) for i in sent.column("shard").unique().to_pylist()]
        found = {(r["lang"], r["phrase"], r["words"]): r["n"] for t in got for r in t.to_pylist()}
        assert len(got) == 7 and found == {p: n for p, n in want.items() if n >= least}


def test_hash_sums_given_out_early_lose_nothing(monkeypatch):
    monkeypatch.setattr(P, "MOST_HELD", 50)
    rng, held, total, low = np.random.default_rng(2), P.Held(), Counter(), {}
    keys, kinds = rng.integers(0, 400, 6000).astype(np.uint64) << np.uint64(8), rng.integers(1, 255, 6000).astype(np.uint64)
    batches = [b for k, c in zip(np.split(keys, 60), np.split(kinds, 60), strict=True) for b in held.add(k, c)] + list(held.add(keys[:0], kinds[:0])) + list(held.given())
    for b in batches:
        for h, n, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[h] += n
            low[h] = min(kind, low.get(h, 999))
    assert len(batches) > 1 and total == Counter((keys >> np.uint64(8)).tolist())
    assert low == {h: int(kinds[keys >> np.uint64(8) == h].min()) for h in set((keys >> np.uint64(8)).tolist())}


def runs(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_word_runs_over_chunks(monkeypatch):
    text = made_up()[7][1] + " The of bank " * 30
    whole = Counter(crc32(x.encode()) % 10_000 for x in runs(text)[1])
    for chunk in (1, 2, 3, 10, 100, 1 << 20):
        monkeypatch.setattr(R, "CHUNK", chunk)
        got = list(R.word_runs(text))
        assert sum(n for n, _ in got) == len(runs(text)[0]) and Counter(np.concatenate([b for _, b in got]).tolist()) == whole


def test_sliced_weights():
    rng = np.random.default_rng(1)
    counts, gain = rng.integers(0, 900, (7, 10_000)), rng.integers(-30_000, 30_000, 10_000)
    counts[0], gain[:3] = 0, (0, -(1 << 15), 1)
    assert R.sliced_weights(counts, R.planes(gain[None, :], 17)).tolist() == (counts @ gain).tolist()


def test_resampling(spark):
    rows = made_up(6, 300)
    target = ["The bank of Straße", None, "x1 x1 x1 日本", ""]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    s, t = (Counter(crc32(x.encode()) % 10_000 for text in texts for x in runs(text)[1]) for texts in ([r[1] for r in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    expected = []
    for r in rows:
        w, x = runs(r[1])
        weight = sum(gain[crc32(y.encode()) % 10_000] for y in x)
        h = int(sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        expected.append((r[0], len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)))
    able = sorted((e for e in expected if e[4] >= 20), key=lambda e: (-e[3], e[0]))
    rank = Counter()
    drawn = [(*e[:4], i + 1) for i, e in enumerate(able[: 5 * len(able) // 100])]
    rank.update(drawn)
    assert drawn and Counter(tuple(r) for r in got.where("rank is not null").collect()) == rank
    assert sorted(map(str, (tuple(r)[:4] for r in got.collect()))) == sorted(map(str, (e[:4] for e in expected)))
    kept = R.drawn_documents(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d[0] for d in drawn}


def test_resampling_of_nothing(spark):
    none, texts = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert R.resample(none, texts).count() == 0
    one = R.resample(spark.createDataFrame(made_up()[:40], DOCS), texts).collect()
    assert len(one) == 40 and sum(r["rank"] is not None for r in one) == sum(len(runs(r[1])[0]) >= 20 for r in made_up()[:40]) * 5 // 100


def targets(sizes):
    names = sorted((x for x in sizes if x is not None), key=str) + [x for x in sizes if x is None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    left, aim, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = {x for x in free if share[x] > 2 * sizes[x]}
        if not over:
            return aim | share
        for x in over:
            aim[x] = 2.0 * sizes[x]
            left -= aim[x]
        free -= over
        if not free:
            return aim


def test_mixing(spark):
    rows = made_up(8, 3000)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = M.taken_words(docs)
    sizes, size_of = Counter({r[3]: 0 for r in rows}), {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        sizes[r[3]] += n
        size_of[r[0]] = (n, r[3])
    aim, taken = targets(sizes), Counter()
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        n, source = size_of[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[source] and r["target"] == pytest.approx(aim[source]) and r["taken"] <= 2 * n and (n == 0 or r["taken"] % n == 0)
        taken[source] += r["taken"]
    assert all(abs(taken[x] - aim[x]) <= 0.02 * aim[x] + 70 for x in aim) and sum(aim.values()) == pytest.approx(1.5 * sizes.total())
    assert sorted(map(str, found)) == sorted(map(str, M.taken_words(docs.repartition(7)).collect()))
    mixed = M.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in found if r["size"] and r["doc_id"] is not None and r["doc_id"] >= 5)


def test_mixing_of_nothing(spark):
    assert M.taken_words(spark.createDataFrame([], DOCS)).count() == 0
    empty = M.taken_words(spark.createDataFrame([(1, None, "en", None, 1, 2, "", ""), (2, "", "en", "a", 1, 2, "", "")], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0), (0, 0.0, 0)]
