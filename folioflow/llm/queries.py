"""The training-data operators as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import mining_queries
from .bpe_automaton import encode_digests
from .common import table
from .embedding_graph import near_duplicates
from .html_extract import extract
from .jaccard_join import jaccard_classes
from .packing import pack_documents
from .quality_cnn import classify
from .quality_rules import ALPHA, DELTA, LEVELS, RULES, apply_rules
from .token_counts import count_tokens
from .token_files import token_file_digests
from .toxicity import score_toxicity

WORD_BPE, BYTE_BPE, END_ID, TOKEN_LIMIT = "word_bpe_49k.json", "byte_bpe_50k.json", 2, 1024


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), TOKEN_LIMIT)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op8_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_bpe_automaton, op4_token_counts, op5_token_files, op6_toxicity, op7_jaccard_join, op8_embedding_graph, op9_packing, op10_html_extract)} | mining_queries.queries()


def _rules_sql() -> str:
    """The counts and verdicts of op1 in DuckDB's SQL."""
    space = "\\x20\\x09-\\x0D"
    levels = ", ".join(f"({i + 1}, {', '.join(str(cs[i]) for _, cs in RULES.values())})" for i in range(LEVELS))
    over = " or ".join(f"{m} > {rule}" for rule, (m, _) in RULES.items())
    return f"""with w as (select doc_id, coalesce(lang, '') as s, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') as ws from documents),
    g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
    d as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
    r as (select doc_id, count(distinct i + k) as n_repeat_words from d, (values (0), (1), (2)) v(k) group by 1),
    l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as ls from w),
    c as (select l.doc_id, s, len(ws) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
      coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) as n_upper from l left join r using (doc_id)),
    base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
    v as (select * from (values {levels}) v(level, {', '.join(RULES)})),
    r1 as (select doc_id, s, base_failed, min(level) filter ({over}) as rejecting from base cross join v group by all),
    good as (select doc_id from labels group by 1 having min(quality) = 1 and max(quality) = 1),
    held as (select doc_id, s, min(rejecting) as rejecting from r1 where not base_failed and doc_id in (select doc_id from good) group by all),
    k as (select s, level, count(*) as n, count(*) filter (rejecting <= level) as k from held cross join v group by all),
    p as (select *, case when k >= n * {ALPHA} then 1.0 else list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({ALPHA}) + (n - x) * ln(1 - {ALPHA})))) end as p from k),
    found as (select s, coalesce(min(level) filter (p > {DELTA} / (select count(distinct s) from held)) - 1, {LEVELS}) as level from p group by 1)
    select base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base.base_failed, not base.base_failed and not coalesce(r1.rejecting <= found.level, false) as kept
      from base join r1 using (doc_id) left join found on found.s = base.s"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others rest on trained models, tokenizers, hashes or search."""
    return {"op1_quality_rules": _rules_sql()} | mining_queries.oracle_sql()
