"""Labelled samples hold whole texts within their bounds."""

from folioflow.llm.quality_cnn import labelled_sample


def test_sample_of_whole_texts(spark):
    late = "x" * 900 + " late"
    rows = [(i, f"{i} " + "a" * 20, i % 2) for i in range(8)] + [(20, late, 1), (21, "y" * 5000, 0), (22, None, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts = {t or "" for _, t, _ in rows}
    got = labelled_sample(docs, labels, "toxic", 100, 4000)
    assert len(got) == 10 and all(t in texts for t, _ in got) and (late, 1) in got
    for most_chars in (60, 100, 2000):
        got = labelled_sample(docs, labels, "toxic", 100, most_chars)
        assert got and all(t in texts for t, _ in got)
        assert all(sum(len(t) for t, y in got if y == c) <= most_chars // 2 for c in (0, 1))
