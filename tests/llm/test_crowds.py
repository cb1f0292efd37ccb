"""Common lines bring no documents together, crowds around a hub make no keys, and no link is lost by either."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_joins import classes, crowd, made_up, shingles

from folioflow.llm import jaccard_join


def with_common_line(n=300, seed=3):
    rng = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(20))
    return [line + "\n" + " ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(n)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_a_common_line_makes_no_candidates(spark, n, percent):
    docs = spark.createDataFrame(list(enumerate(with_common_line())), "doc_id long, text string").withColumn("mark", F.lit(0).cast("long"))
    assert len(jaccard_join.common_shingles(docs, n)) == 20 - n + 1
    signatures = jaccard_join.signature_table(docs, n, percent).select(F.explode("signatures").alias("s"))
    assert signatures.groupBy("s").count().where("count > 1").isEmpty()


def test_signatures_without_common_shingles_meet():
    rng = np.random.default_rng(2)
    for percent in (40, 60, 80, 85, 95):
        scheme = jaccard_join.Scheme(percent)
        for size in (7, 19, 33, 46, 80, 200):
            for share in (0.1, 0.5, 0.8, 0.9, 1.0):
                every = np.unique(rng.integers(0, 2**63, 2 * size, dtype=np.uint64))
                common = np.sort(rng.choice(every, int(share * len(every)), replace=False))
                for _ in range(20):
                    a = np.sort(rng.choice(every, size, replace=False))
                    b = np.sort(rng.choice(a, size - rng.integers(0, scheme.differences(size) * percent // 100 + 1), replace=False))
                    b = np.union1d(b, rng.choice(every, rng.integers(0, 3), replace=False))
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= percent * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                        x, y = scheme.signatures([a, b], common)
                        assert set(x.tolist()) & set(y.tolist())


def test_joining_links_make_the_classes():
    for texts in (crowd(), made_up()[:200]):
        sets = [jaccard_join.shingle_set(t or "", 4) for t in texts]
        places = [i for i, s in enumerate(sets) if len(s)]
        want = classes({i: shingles(texts[i], 4) for i in places}, 85)
        found = jaccard_join.joining_links([sets[i] for i in places], places, 85)
        label = {i: i for i in places}
        for a, b in found:
            x, y = label[places[a]], label[places[b]]
            assert x != y
            label = {i: min(x, y) if k in (x, y) else k for i, k in label.items()}
        assert label == want


@pytest.mark.parametrize("most,keyed", [(1024, False), (8, True)])
def test_crowds_are_compared_in_groups(spark, monkeypatch, most, keyed):
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    monkeypatch.setattr(jaccard_join, "CROWD", most)
    rows, around = [], jaccard_join.around_hubs

    def counted(pairs, *args):
        rows.append(pairs.count())
        return around(pairs, *args)

    monkeypatch.setattr(jaccard_join, "around_hubs", counted)
    texts = list(enumerate(crowd() + made_up()[:100]))
    got = jaccard_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 4, 85)
    want = classes({i: shingles(t, 4) for i, t in texts}, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert bool(sum(rows)) == keyed
