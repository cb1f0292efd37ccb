"""Repeated rows, ids that many rows share, links between shards, and vocabularies beyond 16 bits."""

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folioflow.llm import embedding_graph, jaccard_join, packing, token_files

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_repeated_rows_of_a_pair(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(i % 2, " ".join(words) if i % 2 else near) for i in range(400)] + [(7, f"{k} " * 40) for k in range(30)] * 2, "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_classes(docs, 4, 85).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 200), (1, 0, 200), (7, 7, 60)]
    kept = jaccard_join.without_copies(docs.where("doc_id < 7"), 4, 85).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(0, near)]


def test_sets_of_an_id_once(spark):
    texts = spark.createDataFrame([(1, "a b c d e")] * 50 + [(2, "a b c d e"), (3, "x y z w v"), (1, "p q r s t")], "doc_id long, text string").repartition(4)
    spots = texts.selectExpr("xxhash64(doc_id) as spot")
    again = texts.where("doc_id = 1").selectExpr("xxhash64(doc_id) as spot").distinct()
    sets = jaccard_join.wanted_sets(texts, jaccard_join.Bitmap(spots, "spot"), jaccard_join.Bitmap(again, "spot"), 4)
    assert sorted(r["doc_id"] for r in sets.collect()) == [1, 1, 2, 3]


def test_links_between_shards_go_both_ways(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r for r in embedding_graph.near_duplicates(df).collect()}
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    true = link.sum(1)
    assert (n <= true).all() and n.sum() >= 0.97 * true.sum() and not any(n[i] == 0 and got[i]["component_id"] != i for i in range(len(x)))


def test_packing_of_rows_without_ids(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(None, "the same words again") for _ in range(3000)] + [(5, " ".join(rng.choice(["of", "bank", "river"]) for _ in range(300))) for _ in range(200)], "doc_id long, text string").repartition(6)
    got = packing.pack_documents(docs, WORD_BPE).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert len(got) == len(got.drop_duplicates(["sequence_id", "offset"])) and used.max() <= 4096
    assert used.sum() >= 0.9 * 4096 * (len(used) - 1)


def test_wide_vocabulary(spark, tmp_path):
    d = json.loads(open(WORD_BPE, encoding="utf-8").read())
    d["model"]["vocab"] |= {f"unused{i}": 69_000 + i for i in range(1000)}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(d), encoding="utf-8")
    docs = spark.createDataFrame([(1, "Some words of the river"), (2, None)], "doc_id long, text string")
    index = token_files.write_tokens(docs, str(path), 2, f"file://{tmp_path}/out")
    assert {r["width"] for r in index.collect()} == {4}
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.token_file_digests(spark, docs, str(path)).collect()}
    assert got == {1: len(Tokenizer.from_file(str(path)).encode("Some words of the river", add_special_tokens=False).ids) + 1, 2: 1}
    try:
        token_files.write_tokens(docs, str(path), 2, f"file://{tmp_path}/narrow", width=2)
    except ValueError:
        return
    raise AssertionError("a width of two bytes was taken")


def test_vectors_without_any_link(spark):
    df = spark.createDataFrame([(i, [float(i == k) for k in range(6)], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_graph.near_duplicates(df).collect()) == [(i, 0, i) for i in range(6)]
