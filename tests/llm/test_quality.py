"""Quality rules against brute force, the classifiers against held-out labels, extraction on literal pages."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.llm import html_extract, quality_cnn, quality_rules, toxicity

SPACE = "[^\x20\x09-\x0d]+"


def brute(t):
    words = re.findall(SPACE, t or "")
    grams = list(zip(words, words[1:], words[2:]))
    seen, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_measures(spark, tables):
    odd = [None, "", "   ", "a", "a a a a a", "x y z x y z", "l\nl\nl", "é|é ###\té", "a b c d a b c", "w " * 3000]
    rows = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(odd)] + [(1, "", "en", 2)], "doc_id long, text string, lang string, n_words int")
    got = quality_rules.base_measures(rows).where("stratum = ''").collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(odd[r["doc_id"]])
    docs, labels = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = quality_rules.apply_rules(docs, labels)
    for r in out.collect():
        n, *_, repeats = want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])
    judged = out.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in judged}
    assert kept[1] >= 1 - quality_rules.ALPHA and kept[0] < 0.5
    assert quality_rules.apply_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.apply_rules(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_binomial_tail(spark):
    cases = [(100, 0), (100, 1), (1000, 5), (50000, 900), (10, 9), (0, 0)]
    d = spark.createDataFrame(cases, "n long, k long")
    got = {(r["n"], r["k"]): r["p"] for r in d.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect()}
    for n, k in cases:
        if k < n * 0.02:
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
            assert math.isclose(got[n, k], exact, rel_tol=1e-6)
        else:
            assert got[n, k] == 1.0


def test_levels_of_refuted_and_small_strata(spark):
    # Of 1000 good documents each: all pass, a tenth is rejected from level 3 on, two in a hundred by level 6 (too many to
    # prove 3 in a hundred); a small stratum proves nothing; ids of "twice" stand ten times, which proves nothing either.
    strata = [("all", 1000, 0, 9), ("odd", 1000, 100, 3), ("some", 1000, 25, 6), ("few", 20, 0, 9), ("twice", 200, 0, 9)]
    rows = spark.createDataFrame(strata, "stratum string, n int, above int, at int").select("stratum", "above", "at", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    number = F.row_number().over(Window.orderBy("stratum", "i")).cast("long")
    measured = rows.select(F.when(F.col("stratum") == "twice", 10**6 + F.col("i") % 20).otherwise(number).cast("long").alias("doc_id"), "stratum", F.when(F.col("i") <= F.col("above"), F.col("at")).cast("long").alias("rejecting"), F.lit(False).alias("base_failed"))
    labels = measured.select("doc_id", F.lit(1).alias("quality")).union(spark.createDataFrame([(5 * 10**6, 0)], "doc_id long, quality int"))
    got = {r["stratum"]: r["level"] for r in quality_rules.proven_levels(measured, labels).collect()}
    assert got == {"all": 6, "odd": 2, "some": 5, "few": 0, "twice": 0}
    assert quality_rules.proven_levels(measured, labels.select("doc_id", F.lit(0).alias("quality"))).count() == 0


def test_false_rejections_of_every_stratum(spark):
    """A language whose good documents are full of symbols loses none of them to the cutoff that another one has proven."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words + (" #" * 40 if i % 2 and i % 10 == 1 else "") + f" {i}", "xx" if i % 2 else "en") for i in range(2000)]
    docs = spark.createDataFrame([*rows, (9000, words + " #" * 40, "en"), (9001, words + " #" * 40, "none")], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality")).where("doc_id < 5000")
    kept = {r["lang"]: (r["kept"], r["n"]) for r in quality_rules.accepted(docs, labels).groupBy("lang").agg(F.count_if(F.col("doc_id") < 5000).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept == {"xx": (1000, 1000), "en": (1000, 1000), "none": (0, 1)}


def test_accepted_keeps_columns_and_rows(spark, tables):
    docs, labels = tables
    extra = docs.withColumn("kept", F.lit("mine")).withColumn("stratum", F.lit(3))
    kept = quality_rules.accepted(extra, labels)
    assert kept.columns == extra.columns and kept.count() == quality_rules.apply_rules(docs, labels).where("kept").count()
    good = quality_cnn.accepted(extra, labels)
    assert good.columns == extra.columns and good.count() == quality_cnn.classify(docs, labels).where("predicted = 1").count()


def held_out_accuracy(out, labels, column):
    rows = out.where("held_out").join(labels, "doc_id").where(F.col(column).isNotNull()).select("predicted", F.col(column).alias("y")).collect()
    return np.mean([r["predicted"] == r["y"] for r in rows])


def test_quality_network(spark, tables):
    docs, labels = tables
    out = quality_cnn.classify(docs, labels)
    assert held_out_accuracy(out, labels, "quality") > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out.collect())
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "x" * 200_000), (None, "a")], "doc_id long, text string")
    assert quality_cnn.classify(odd, labels).count() == 4
    assert {r["score"] for r in quality_cnn.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_gradients():
    rng = np.random.default_rng(0)
    w = quality_cnn.new_weights(rng)
    texts, y = [b"some text, long enough to fill more than one block of the network's input, twice over.", b"*** !!! ***", b""], np.array([1, 0, 1])

    def loss():
        p = quality_cnn.forward(w, texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality_cnn.gradients(w, texts, y)
    for k in ("out", "hidden", "filters", "embed"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, step = w[k][at], 1e-3
        w[k][at] = old + step
        up = loss()
        w[k][at] = old - step
        down = loss()
        w[k][at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4


def test_toxicity(spark, tables):
    docs, labels = tables
    out = toxicity.score_toxicity(docs, labels)
    assert held_out_accuracy(out, labels, "toxic") > 0.9
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "12 34"), (3, "word " * 20_000)], "doc_id long, text string")
    assert toxicity.score_toxicity(odd, labels).where("predicted = 0").count() == 4
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><div class="cookie-notice"><p>We use cookies, ok, yes</p></div>
<header><h1>Site</h1></header><nav><ul><li><a href="x">Home</a></li></ul></nav><div id="wrap"><div class="post"><h2>Head &amp; line</h2><p>First, paragraph with <a href=x>link</a>, of text.<p>Second one,&nbsp; long
 text<br>more.</div><div class="sidebar"><p>Side, text, more, text</p></div><section class="comments"><p>Nice, post, really, very, much</p></section></div><form><p>Sub, scribe</p></form><footer>x</footer>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "a"), (2, "u", None, "b"), (3, None, "", "c"), (3, None, "plain &lt; text", "d"), (4, "u", "<p>" * 3000 + "deep", "e"), (5, "u", "<article><p>one<p>two</article><div class=ad>buy</div>", "f")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).orderBy("page_id", "n_chars").collect()]
    want = ["Head & line\nFirst, paragraph with link, of text.\nSecond one, long text more.", "", "", "plain < text", "deep", "one\ntwo"]
    assert [g[1] for g in got] == want and all(g[2] == len(g[1]) for g in got)
    assert html_extract.extract(pages.limit(0)).count() == 0
