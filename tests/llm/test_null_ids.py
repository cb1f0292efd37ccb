"""A row with a null id before a document with the same set takes no links from it."""

from folioflow.llm.jaccard_join import jaccard_classes


def test_null_id_first(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(None, text), (1, text), (2, near), (None, near)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_classes(docs, 4, 85).collect()]
    assert sorted(got, key=str) == [(1, 1), (2, 1), (None, None), (None, None)]
