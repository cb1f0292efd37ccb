"""Quality of parsed documents: page coverage, the quality gate, retries, table pages, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import printable_ratio, suspicious_repeats

MIN_CHARS, MIN_PRINTABLE = 40, 0.9


def coverage(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """document_id, expected_pages, text_pages, image_pages, missing (arrays in order)."""
    usable = (F.length("text") >= MIN_CHARS) & (printable_ratio("text") >= MIN_PRINTABLE)
    seen = raw.groupBy("document_id").agg(
        F.sort_array(F.collect_set(F.when(usable, F.col("page")))).alias("text_pages"),
        F.sort_array(F.collect_set(F.when(F.col("category").isin("Image", "Figure", "Table"), F.col("page")))).alias("image_pages"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(suspicious_repeats("text")).alias("suspicious"),
        F.count("*").alias("n"),
    )
    none = F.array().cast("array<int>")
    joined = expected.join(seen, "document_id", "left").withColumns({c: F.coalesce(c, none) for c in ("text_pages", "image_pages")})
    every = F.when(F.col("expected_pages") > 0, F.sequence(F.lit(1), "expected_pages")).otherwise(none)
    return joined.withColumn("missing", F.array_except(every, F.array_union("text_pages", "image_pages")))


def quality_gate(covered: DataFrame) -> DataFrame:
    """document_id and its warnings, for documents with expected_pages and route."""
    none = (F.col("expected_pages") > 0) & (F.size("text_pages") == 0) & (F.size("image_pages") == 0)
    gone = F.col("expected_pages") - F.size(F.array_union("text_pages", "image_pages"))
    chars, n = F.coalesce("chars", F.lit(0)), F.coalesce("n", F.lit(0))
    said = F.array_compact(
        F.array(
            F.when(gone > 0, F.concat(gone.cast("string"), F.lit(" of "), F.col("expected_pages").cast("string"), F.lit(" pages without usable text or image"))),
            F.when((chars > 0) & (F.coalesce("suspicious", F.lit(0)) > 0.25 * F.greatest(n, F.lit(1))), "text looks garbled or repeated"),
            F.when((chars == 0) & (F.size("image_pages") > 0), "only images, no text"),
            F.when((F.col("route") == "hi_res") & (F.size("text_pages") == 0) & (F.size("image_pages") > 0), "recognition gave no text"),
        )
    )
    return covered.select("document_id", F.when(none, F.array(F.lit("no usable text or images"))).otherwise(said).alias("warnings"))


def retry_decision(covered: DataFrame) -> DataFrame:
    """document_id, the share of missing pages, and whether to read the document, some pages or nothing again."""
    share = F.size("missing") / F.greatest("expected_pages", F.lit(1))
    decision = F.when(share >= 0.5, "document").when(share >= 0.1, "pages").otherwise("none")
    return covered.select("document_id", share.alias("missing_share"), decision.alias("retry"), F.when(decision == "pages", F.col("missing")).otherwise(F.array().cast("array<int>")).alias("pages"))


def table_pages(lines: DataFrame, min_chars: int = 12, pipe: int = 3, numeric: int = 2) -> DataFrame:
    """Per document the pages that look like tables, and the others; lines are document_id, page, line."""
    cells = F.filter(F.split("line", "  "), lambda c: F.trim(c) != "")
    digits = F.size(F.filter(cells, lambda c: c.rlike("[0-9]")))
    long, tab = F.length("line") >= min_chars, F.col("line").contains("\t")
    by_page = lines.where("trim(line) <> ''").groupBy("document_id", "page").agg(
        ((F.count_if(F.col("line").contains("|") & long) >= pipe) | (F.count_if(tab) >= pipe) | (F.count_if(~tab & long & (F.size(cells) >= 3) & (digits >= 2)) >= numeric)).alias("found")
    )
    return by_page.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("found"), F.col("page")))).alias("detected"), F.sort_array(F.collect_list(F.when(~F.col("found"), F.col("page")))).alias("skipped")
    )


def outcomes(stages: DataFrame) -> DataFrame:
    """Per document: a preflight error's status, resource_limit for a timeout, parser_failure for a crash, partial with a
    warning, else ready; and whether to try again. Stages are document_id, stage, result, status."""
    status = (
        F.when(F.count_if((F.col("stage") == "preflight") & (F.col("result") == "error")) > 0, F.max(F.when((F.col("stage") == "preflight") & (F.col("result") == "error"), F.col("status"))))
        .when(F.count_if(F.col("result") == "timeout") > 0, "resource_limit")
        .when(F.count_if(F.col("result") == "crash") > 0, "parser_failure")
        .when(F.count_if(F.col("result") == "warning") > 0, "partial")
        .otherwise("ready")
    )
    return stages.groupBy("document_id").agg(status.alias("status")).withColumn("retryable", F.col("status").isin("parser_failure", "resource_limit"))
