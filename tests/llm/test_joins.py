"""Similarity joins and the pipeline against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import embedding_graph, jaccard_join, quality_cnn, quality_rules
from folioflow.llm.components import connected_components

SPACE = "[^\x20\x09-\x0d]+"


def shingles(t, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(SPACE, lower)
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[i:] for i in range(n))))


def classes(sets, percent):
    """Smallest reachable id of each id by comparing all pairs."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if not a or 100 * len(a) < percent * len(b):
                if a:
                    break
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def made_up(seed=3):
    """Texts of many sizes with chains of near copies, copies in other letters, short ones and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = [None, "", " \n", "one", "ONE", "one two", "a b c d", "A B C D", "a b c d e", "x " * 3000]
    for size in (5, 6, 8, 12, 13, 20, 30, 46, 60, 120, 400, 1500):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(max(1, int(size * rng.choice([0, 0.01, 0.02, 0.03, 0.06])))):
                copy[rng.randrange(size)] = word()
            base = copy if rng.random() < 0.5 else base
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
        out.append(" ".join(passage + base[: size // 4]))
    return out


def crowd(seed=5):
    """Copies of one text with different numbers of changed words, some of them changed alike."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    out = [" ".join(base)]
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(80)
            copy[at] = f"x{at if rng.random() < 0.5 else rng.random()}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n,percent,few", [(4, 85, 3), (5, 80, 32)])
def test_jaccard_classes(spark, monkeypatch, n, percent, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rows = list(enumerate(made_up() + crowd()))
    docs = spark.createDataFrame([(100 + i, t, "key", 9) for i, t in rows] + [(None, "one", "key", 9)], "doc_id long, text string, key string, component_id int").repartition(5)
    sets = {100 + i: shingles(t, n) for i, t in rows}
    want = classes(sets, percent)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_classes(docs, n, percent).collect()}
    assert len(got) == len(rows) + 1
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), want[i])
    if percent == 85:
        return
    kept = jaccard_join.without_copies(docs, n, percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i in want if want[i] == i)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for percent in (60, 80, 85, 95):
        scheme = jaccard_join.Scheme(percent)
        for size in (6, 7, 10, 19, 33, 45, 46, 80, 200, 900):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            lost = scheme.differences(size) * percent // 100
            for cut in range(0, lost + 1, max(1, lost // 4)):
                b = np.unique(a[cut:])
                if 100 * len(b) >= percent * len(a) and len(b) < len(a):
                    x, y = scheme.signatures([np.unique(a), b])
                    assert set(x.tolist()) & set(y.tolist())


def test_differences_to_a_hub_meet():
    rng = np.random.default_rng(1)
    for percent, size in ((85, 60), (85, 200), (80, 31), (60, 40)):
        hub = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        some = rng.integers(0, 2**63, 40, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(hub, size - rng.integers(0, size // 3), replace=False), rng.choice(some, rng.integers(0, min(40, size // 3)), replace=False)])) for _ in range(150)]
        found = [jaccard_join.difference_keys(x, hub, 7, percent) for x in sets]
        pairs = 0
        for i, x in enumerate(sets):
            assert found[i][0] == (100 * len(np.intersect1d(x, hub)) >= percent * len(np.union1d(x, hub)))
            for j in range(i):
                y = sets[j]
                if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) and not (found[i][0] and found[j][0]):
                    pairs += 1
                    assert set(found[i][1].tolist()) & {k - k % 4 + (3 - k % 4) % 3 for k in found[j][1].tolist()}
        assert pairs


def test_several_texts_of_an_id(spark):
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(3, text("b") + " end"), (4, text("a")), (5, text("a")), (5, text("b")), (5, text("c")), (5, text("c")), (None, text("c")), (6, "")]
    kept = jaccard_join.without_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in kept) == [(0, "c0"), (3, "b0"), (4, "a0"), (6, "")]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(500, x) for x in range(400, 440)] + [(7, 7), (3, 2)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == i // 20 * 20 for i in range(60)) and all(got[x] == 400 for x in [*range(400, 440), 500])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_graph(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for size in (1, 1, 2, 5, 40, 150):
        for label in (0, 1):
            base = rng.normal(size=16)
            for _ in range(size):
                rows.append((k, (base + rng.normal(size=16) * 0.08).tolist(), label))
                k += 1
    rows += [(k + i, rng.normal(size=16).tolist(), i % 2) for i in range(200)]
    rows += [(k + 300 + i, rows[5][1], rows[5][2]) for i in range(5)]
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, rows[0][1], None)]
    df = spark.createDataFrame([(i, v, l, 1) for i, v, l in rows + odd], "vec_id long, embedding array<double>, label int, copies int")
    result = embedding_graph.near_duplicates(df)
    got = {r["vec_id"]: r for r in result.collect()}
    x, labels, ids = np.stack([v for _, v, _ in rows]), np.array([l for *_, l in rows]), [i for i, *_ in rows]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    found = sum(min(got[i]["n_links"], int(n)) for i, n in zip(ids, link.sum(1), strict=True))
    assert found >= 0.97 * link.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, link.sum(1), strict=True))
    for i in range(9001, 9006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    audit = embedding_graph.audit_recall(df, result, every=10).first()
    assert audit["found"] >= 0.9 * audit["links"] > 0
    assert embedding_graph.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "packing"]
    good = {r["doc_id"] for r in quality_cnn.classify(docs, labels).where("predicted = 1").collect()}
    left = docs.where(F.col("doc_id").isin(*good))
    kept = {r["doc_id"] for r in quality_rules.apply_rules(left, labels).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in left.collect() if r["doc_id"] in kept}
    want = {i for i, c in classes({i: shingles(t, 5) for i, t in texts.items()}, 80).items() if i == c}
    got = corpus_pipeline.run(spark, d).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got.doc_id) == want
    assert dict(got.groupby("doc_id").length.sum()) == {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want}
    assert got.groupby("sequence_id").length.sum().max() <= 4096
