"""From queries to hits and contexts, for many queries at once. Order is always an explicit rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dates_in, normalize_title, parse_date
from ..sources.scratch import stored
from .ordering import with_positions

TOP_K, RECALL, CONTEXT_CHARS = 8, 48, 120_000
#: Chunks of a block, and queries whose scores are held at a time.
BLOCK, ASKED = 4096, 1024
#: Expectations of a test set that are broadcast, at most.
MOST_EXPECTED = 100_000


def chat_scope(ids: Column, most: int = 12) -> Column:
    """Trimmed ids without blanks and repeats, first ones first; null if there are more than `most`."""
    clean = F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(clean) <= most, clean)


def readiness(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Per request (request_id, document_ids) one message about documents that aren't ready, or null."""
    each = requests.select("request_id", F.posexplode("document_ids").alias("pos", "document_id")).join(state.select("document_id", "status"), "document_id", "left")
    said = F.when(~F.coalesce(F.col("status").isin("ready", "partial"), F.lit(False)), F.concat("document_id", F.lit(" is "), F.coalesce("status", F.lit("unknown"))))
    return each.groupBy("request_id").agg(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("pos", said.alias("m"))))), lambda x: x["m"]), "; "), F.lit("")).alias("message"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length, zero rows as they are."""
    rows = vectors.combine_chunks()
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _runs(column: pa.ChunkedArray) -> list[tuple[object, int, int]]:
    """Each value of a sorted column, with the first of its rows and the one after them."""
    counts = column.value_counts()
    values, ends = counts.field("values").to_pylist(), np.cumsum(counts.field("counts").to_numpy()).tolist()
    return list(zip(values, [0, *ends[:-1]], ends, strict=True))


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k chunks of each query's documents with the least cosine distance: query_id, chunk_id, document_id, score, rank.

    Scope comes first: queries (query_id, document_id, vector; a row for each document in scope) meet only chunks of their
    documents. Chunks lie in blocks of about `block`: a document of more chunks has blocks of its own, so it is spread over
    tasks, and its queries go to each of them; smaller ones share blocks, as a group for each would cost more than its
    scores. A document's vectors in a block and its queries' are two matrices, and their product gives all scores: no row
    holds two vectors. A block keeps the best k of each query and document, and only those are ranked. Scores are rounded
    to 6 places; equal ones rank by chunk_id. Vectors that are null have no score.
    """
    sizes = stored(chunks.groupBy("document_id").agg(F.count("*").alias("n")))
    shared = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // block))
    spot = F.xxhash64("document_id")
    cells = sizes.select("document_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cells = cells.withColumn("cell", F.when(F.col("blocks") > 1, spot).otherwise(F.pmod(spot, F.lit(shared))))
    in_block = lambda b: F.when(F.col("blocks") > 1, b).otherwise(F.lit(-1)).cast("int").alias("block")
    x = chunks.where("embedding is not null").select("chunk_id", "document_id", "embedding").join(cells, "document_id")
    x = x.select("cell", in_block(F.pmod(F.xxhash64("chunk_id"), "blocks")), "document_id", "chunk_id", "embedding")
    q = queries.where("vector is not null").select("query_id", "document_id", "vector").join(cells, "document_id")
    q = q.select("cell", "blocks", "document_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "query_id", "vector")
    q = q.select(F.col("cell").alias("cell"), in_block(F.col("b")), "document_id", "query_id", "vector")

    def best(c: pa.Table, asked: pa.Table) -> pa.Table:
        rows, scores, whose = [], [], []
        if len(c) and len(asked):
            c, asked = c.sort_by([("document_id", "ascending"), ("chunk_id", "ascending")]), asked.sort_by("document_id")
            spans = {d: (a, b) for d, a, b in _runs(c.column("document_id"))}
            m = _matrix(c.column("embedding"))
            for document, start, end in _runs(asked.column("document_id")):
                first, after = spans.get(document, (0, 0))
                for at in range(start, end if first < after else start, ASKED):
                    part = slice(at, min(at + ASKED, end))
                    score = np.round(_matrix(asked.column("vector").slice(at, part.stop - at)) @ m[first:after].T, 6)
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # chunks are in order of their ids
                    rows.append(first + top.ravel())
                    scores.append(np.take_along_axis(score, top, 1).ravel())
                    whose.append(np.repeat(np.arange(part.start, part.stop), top.shape[1]))
        at, who = (pa.array(np.concatenate([np.zeros(0, np.int64), *y])) for y in (rows, whose))
        names = [c.column(n).take(at).cast(pa.string()) for n in ("chunk_id", "document_id")]
        return pa.table([asked.column("query_id").take(who).cast(pa.int64()), *names, np.concatenate([np.zeros(0), *scores])], ["query_id", "chunk_id", "document_id", "score"])

    keys = ["cell", "block"]
    local = x.groupBy(keys).cogroup(q.groupBy(keys)).applyInArrow(best, "query_id long, chunk_id string, document_id string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def structural_fetch(chunks: DataFrame, wanted: DataFrame, most: int = 40, quota: bool = False) -> DataFrame:
    """Chunks of the wanted (query_id, document_id, section_path), in order of page and chunk_id, with score 1.

    quota: each of a query's n documents gets max(8, most / n) of the `most` places.
    """
    hits = chunks.join(wanted.distinct(), ["document_id", "section_path"]).select("query_id", "document_id", "section_path", "chunk_id", "page").dropDuplicates(["query_id", "chunk_id"])
    if quota:
        n = wanted.groupBy("query_id").agg(F.countDistinct("document_id").alias("docs"))
        hits = hits.join(n, "query_id").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("page", "chunk_id")))
        hits = hits.where(F.col("r") <= F.greatest(F.lit(8), F.floor(F.lit(most) / F.col("docs")))).drop("r", "docs")
    order = ["document_id", "page", "chunk_id"] if quota else ["page", "chunk_id"]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most).withColumn("score", F.lit(1.0))


def resolve_sections(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Section ids of queries (query_id, pos, section_id, document_ids) to document_id and section_path.

    "document:section" counts if the document is in scope and has the section; else the whole id is looked for in every
    document in scope.
    """
    parts = F.split("section_id", ":", 2)
    named = asked.withColumn("document_id", F.when(F.size(parts) == 2, parts[0])).withColumn("sec_id", F.get(parts, F.lit(1)))
    entries = index.select("document_id", "sec_id", "path")
    own = named.where(F.array_contains("document_ids", F.col("document_id"))).join(entries, ["document_id", "sec_id"]).select("query_id", "pos", "document_id", "path")
    bare = asked.join(own.select("query_id", "pos"), ["query_id", "pos"], "left_anti").select("query_id", "pos", F.explode("document_ids").alias("document_id"), F.col("section_id").alias("sec_id"))
    rest = bare.join(entries, ["document_id", "sec_id"]).select("query_id", "pos", "document_id", "path")
    return own.union(rest).where("path <> ''").select("query_id", "document_id", F.col("path").alias("section_path")).distinct()


def keep_first(hits: DataFrame, rank: str = "pos") -> DataFrame:
    """The first hit of each chunk of a query, by chunk_id or else document, section and page."""
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat("document_id", F.lit(":"), "section_path", F.lit("::"), F.col("page").cast("string")))
    return hits.withColumn("__k", key).withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__k").orderBy(rank))).where("__n = 1").drop("__k", "__n")


def query_texts(queries: DataFrame, most: int = 8, entities: int = 5) -> DataFrame:
    """The texts searched for a query, in order: gap query, query, variants, entities; first ones first."""
    every = F.concat(F.array("gap_query"), F.array("query"), "query_variants", F.slice("key_entities", 1, entities))
    texts = F.slice(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != ""))), 1, most)
    return queries.select("query_id", F.size(texts).alias("n"), F.posexplode(texts).alias("text_pos", "text"))


def merge_variants(hits: DataFrame, recall: int = RECALL) -> DataFrame:
    """Hits of several texts of a query (query_id, n, text_pos, rank, chunk_id…): max(3, recall / n) of each, keep-first."""
    few = hits.where(F.col("rank") <= F.greatest(F.lit(3), F.floor(F.lit(recall) / F.col("n"))))
    order = F.struct("text_pos", "rank")
    first = few.withColumn("__o", order).withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("__o"))).where("__n = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("__o"))).drop("__o", "__n")


def boost_targets(hits: DataFrame, targets: Column) -> DataFrame:
    """Hits whose section path contains a target, in any case, first; stable."""
    hit = F.exists(targets, lambda t: F.contains(F.lower("section_path"), F.lower(t)))
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce(hit, F.lit(False)).desc(), "pos")))


def hybrid(structural: DataFrame, semantic: DataFrame, recall: int = RECALL) -> DataFrame:
    """Structural hits, then semantic ones, keep-first, at most max(recall, structural + 4) a query."""
    both = structural.withColumn("__s", F.lit(0)).unionByName(semantic.withColumn("__s", F.lit(1)))
    both = both.withColumn("__o", F.struct("__s", "pos")).withColumn("n_s", F.count_if(F.col("__s") == 0).over(Window.partitionBy("query_id")))
    one = both.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("__o"))).where("__n = 1")
    ranked = one.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("__o")))
    return ranked.where(F.col("pos") <= F.greatest(F.lit(recall), F.col("n_s") + 4)).drop("__s", "__o", "__n", "n_s")


def augment(structural: DataFrame, semantic: DataFrame, least: int = 3) -> DataFrame:
    """Structural hits; queries with fewer than `least` of them get the semantic ones too, keep-first."""
    n = structural.groupBy("query_id").agg(F.count("*").alias("n"))
    extra = semantic.join(n, "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).drop("n")
    both = structural.withColumn("__s", F.lit(0)).unionByName(extra.withColumn("__s", F.lit(1))).withColumn("__o", F.struct("__s", "pos"))
    one = both.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("__o"))).where("__n = 1")
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("__o"))).drop("__s", "__o", "__n")


def _keep_all(hits: DataFrame, keep: Column) -> DataFrame:
    """Hits for which keep holds; all hits of a query for which it holds nowhere."""
    marked = hits.withColumn("__k", F.coalesce(keep, F.lit(False)))
    return marked.withColumn("__any", F.max("__k").over(Window.partitionBy("query_id"))).where("__k or not __any").drop("__k", "__any")


def filter_time(hits: DataFrame, start: str = "time_range_start", end: str = "time_range_end", text: str = "display_text") -> DataFrame:
    """Hits without dates, or with one within the range; either end may be null."""
    lo, hi = parse_date(start), parse_date(end)
    inside = lambda d: (lo.isNull() | (d >= lo)) & (hi.isNull() | (d <= hi))
    found = dates_in(text)
    return _keep_all(hits, (F.size(found) == 0) | F.exists(found, inside))


def filter_entities(hits: DataFrame, entities: str = "key_entities", columns: tuple[str, ...] = ("display_text", "text_for_embedding")) -> DataFrame:
    """Hits whose texts or keywords contain an entity, in any case."""
    named = ["keywords"] if "keywords" in hits.columns else []
    text = F.lower(F.concat_ws(" ", *columns, *named))
    return _keep_all(hits, (F.size(entities) == 0) | F.exists(entities, lambda e: F.contains(text, F.lower(e))))


def filter_sections(hits: DataFrame, targets: str = "target_sections") -> DataFrame:
    """Hits whose chunk_id or section path contains a target, in this case."""
    return _keep_all(hits, (F.size(targets) == 0) | F.exists(targets, lambda t: F.contains("chunk_id", t) | F.contains("section_path", t)))


def results(hits: DataFrame, chars: int = 240) -> DataFrame:
    """The columns shown of a hit, with a preview."""
    return hits.select("query_id", "rank", "chunk_id", "document_id", "section_path", "page", "score", F.substring("display_text", 1, chars).alias("preview"))


def vision_candidates(queries: DataFrame, hits: DataFrame, most: int = 3, least: float = 0.75) -> DataFrame:
    """Pages to look at: those the router names (one document in scope only), then image hits with a high score."""
    routed = queries.where(F.size("document_ids") == 1).select("query_id", F.col("document_ids")[0].alias("document_id"), F.posexplode("vision_pages").alias("pos", "page")).withColumn("src", F.lit(0))
    seen = hits.where((F.col("type") == "image") & ~F.col("vision_analyzed") & (F.col("score") >= least)).select("query_id", "document_id", "pos", "page", F.lit(1).alias("src"))
    both = routed.select("query_id", "document_id", "pos", "page", "src").union(seen)
    one = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "document_id", "page").orderBy("src", "pos"))).where("n = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("src", "pos"))).where(F.col("rank") <= most).select("query_id", "rank", "document_id", "page")


def vision_key(page: Column, query: Column, model: str, version: str) -> Column:
    """Cache key: page and 16 hex digits of a hash of model, prompt version and the query's beginning."""
    return F.concat_ws("-", page.cast("string"), F.substring(F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), F.substring(F.lower(F.trim(query)), 1, 120)), 256), 1, 16))


def sufficiency(queries: DataFrame, hits: DataFrame, chars: int = 10_000) -> DataFrame:
    """Per query: sufficient without a model call if all entities occur in the hits' short text; the gap is the query without hits."""
    joined = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("display_text")).alias("chars"), F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "display_text"))), lambda x: x["display_text"]), "\n")).alias("text"))
    every = queries.join(joined, "query_id", "left")
    enough = (F.size("key_entities") > 0) & (F.coalesce("n", F.lit(0)) > 0) & (F.col("chars") <= chars) & F.forall("key_entities", lambda e: F.contains("text", F.lower(e)))
    return every.select("query_id", F.coalesce(enough, F.lit(False)).alias("sufficient"), F.when(F.col("n").isNull(), F.col("query")).alias("gap_query"))


def rerank(hits: DataFrame, scores: DataFrame, k: int = TOP_K, recall: int = RECALL, scope: DataFrame | None = None) -> DataFrame:
    """The first `recall` hits by pair score, stable, k of them; queries without scores keep their first k.

    So do, if scope (query_id, documents) is given, queries with fewer than two documents in scope.
    """
    if scope is not None:
        scores = scores.join(scope.where("documents >= 2").select("query_id"), "query_id", "left_semi")
    few = hits.where(F.col("pos") <= recall).join(scores, ["query_id", "chunk_id"], "left")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "pos")))
    return ranked.where(F.col("rank") <= k)


def title_route(queries: DataFrame, index: DataFrame, most: int = 4) -> DataFrame:
    """Sections whose title a query names, of the first document with any: query_id, document_id, sec_id, rank.

    A title counts if the query contains it, or if it contains one of the query's words of more than three letters. Queries
    that get no row take the semantic route.
    """
    scoped = queries.select("query_id", F.lower("query").alias("q"), F.posexplode("document_ids").alias("doc_pos", "document_id"))
    title = normalize_title("title")
    words = F.filter(F.split("q", r"\s+"), lambda w: F.length(w) > 3)
    hit = (title != "") & (F.contains(F.col("q"), title) | F.exists(words, lambda w: F.contains(title, w)))
    found = scoped.join(index.select("document_id", "sec_seq", "sec_id", "title"), "document_id").where(hit)
    found = found.withColumn("d", F.dense_rank().over(Window.partitionBy("query_id").orderBy("doc_pos"))).where("d = 1")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("sec_seq"))).where(F.col("rank") <= most).select("query_id", "document_id", "sec_id", "rank")


def adjacent_tables(hits: DataFrame, tables: DataFrame, chars: int = 2000) -> DataFrame:
    """Tables on the two pages after table hits, without pages that have one: query_id, page, document_id, snippet.

    Page numbers are pooled over a query's documents; the first document in scope that has a table there gives it. Tables
    are document_id, page, markdown; hits need query_id, document_id, doc_pos, page, type.
    """
    own = hits.where("type = 'table'").select("query_id", "page").distinct()
    near = own.select("query_id", F.explode(F.array(F.col("page") + 1, F.col("page") + 2)).alias("page")).distinct().join(own, ["query_id", "page"], "left_anti")
    scope = hits.groupBy("query_id", "document_id").agg(F.min("doc_pos").alias("doc_pos"))
    found = near.join(scope, "query_id").join(tables, ["document_id", "page"])
    first = found.groupBy("query_id", "page").agg(F.min_by(F.struct("document_id", F.substring("markdown", 1, chars).alias("snippet")), "doc_pos").alias("t"))
    return first.select("query_id", "page", "t.document_id", "t.snippet")


def within_budget(found: DataFrame, used: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Adjacent tables as long as the context before them is within the budget; each counts its snippet and 100."""
    before = F.coalesce(F.sum(F.length("snippet") + 100).over(Window.partitionBy("query_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(used, "query_id").withColumn("before", F.col("context_chars") + before).where(F.col("before") <= budget).drop("before", "context_chars")


def layout(hits: DataFrame) -> DataFrame:
    """Hits in the order of a context: groups of document and section by their first hit, pages up, scores down."""
    first = F.min("pos").over(Window.partitionBy("query_id", "document_id", "section_path"))
    marked = hits.withColumn("group_pos", first)
    return marked.withColumn("line", F.row_number().over(Window.partitionBy("query_id").orderBy("group_pos", "page", F.desc("score"), "pos")))


def hydrate(laid: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Whole tables in place of previews while they fit: laid hits with line, display_text and full_text (null: none).

    Whether one fits depends on what was decided before, so a query's hits (a few dozen) are folded in order.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, used, out = part.sort_values("line"), 0, []
        for page, shown, full in zip(part["page"], part["display_text"], part["full_text"], strict=True):
            text = full if isinstance(full, str) and used + len(full) < budget else shown
            used += len(f"[p.{page}]\n{text}")
            out.append(text)
        return part[["query_id", "line", "document_id", "section_path", "page"]].assign(text=out)

    return laid.select("query_id", "line", "document_id", "section_path", "page", "display_text", "full_text").groupBy("query_id").applyInPandas(fold, "query_id long, line int, document_id string, section_path string, page int, text string")


def context(lines: DataFrame, text: str = "display_text") -> DataFrame:
    """The context of each query as one string: a heading for each group, then its blocks."""
    first = F.row_number().over(Window.partitionBy("query_id", "document_id", "section_path").orderBy("line")) == 1
    block = F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("]\n"), F.col(text))
    head = F.when(first, F.concat(F.lit("## "), "document_id", F.lit(" — "), "section_path"))
    blocks = lines.withColumn("head", head).withColumn("block", F.concat_ws("\n\n", "head", block))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def hit_summaries(hits: DataFrame, most: int = 12) -> DataFrame:
    """The first hits of a query in a few lines."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] type="), "type", F.lit(" section="), F.substring("section_path", 1, 60), F.lit("\n  "), F.substring("display_text", 1, 200))
    return hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("summaries"))


def evaluate(expected: DataFrame, chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Per expectation (query_id, query, document_id, page): text recall, citation accuracy, top-1 correctness.

    The expectations are a test set; up to MOST_EXPECTED of them are broadcast, so that no chunk's text is shuffled, and
    larger sets take the text's first shuffle by document.
    """
    word = F.lower(F.regexp_extract("query", r"^\S+", 0))
    e = expected.withColumn("word", word)
    small = expected.limit(MOST_EXPECTED + 1).count() <= MOST_EXPECTED
    asked = e.select("query_id", "document_id", "page", "word")
    cites = chunks.select("document_id", F.col("page").alias("chunk_page"), F.lower("display_text").alias("t")).join(F.broadcast(asked) if small else asked, "document_id").where(F.contains("t", F.col("word")))
    found = cites.groupBy("query_id").agg(F.bool_and(F.col("chunk_page") == F.col("page")).alias("citation_ok"))
    top = hits.where("rank = 1").select("query_id", F.col("document_id").alias("top_doc"), F.col("page").alias("top_page"))
    out = e.join(found, "query_id", "left").join(top, "query_id", "left")
    return out.select("query_id", "document_id", F.col("citation_ok").isNotNull().alias("text_found"), F.coalesce("citation_ok", F.lit(False)).alias("citation_ok"), F.coalesce((F.col("top_doc") == F.col("document_id")) & (F.col("top_page") == F.col("page")), F.lit(False)).alias("top1_ok"))


def exact_median(values: DataFrame, column: str) -> DataFrame:
    """One row `median`: the middle value, or the mean of the two middle ones; null without values. No task holds them all."""
    placed = with_positions(values.where(F.col(column).isNotNull()).select(column), [F.col(column)])
    n = placed.agg(F.count("*")).first()[0]
    middle = [(n - 1) // 2, n // 2] if n else []
    return placed.where(F.col("position").isin(middle)).agg(F.avg(F.col(column).cast("double")).alias("median"))


def evaluation_summary(judged: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row over the corpus, from evaluate(), the chunks and documents (document_id, total_pages, parse_seconds).

    Per document: the shares of its expectations that are found and rightly cited, rounded to two places, and its pages with
    output (chunks with some text). Then: documents, median of parse seconds, means of the shares, expectations whose first
    hit is right, pages with output and all pages.
    """
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 2)
    cases = judged.groupBy("document_id").agg(share("text_found").alias("recall"), share("citation_ok").alias("cited"), F.count_if("top1_ok").alias("top1"), F.count("*").alias("asked"))
    output = chunks.where(F.regexp_like("display_text", F.lit(r"\S"))).select("document_id", "page").distinct().groupBy("document_id").agg(F.count("*").alias("pages"))
    each = stored(documents.select("document_id", "total_pages", "parse_seconds").join(cases, "document_id", "left").join(output, "document_id", "left"))
    total = each.agg(
        F.count("*").alias("documents"), F.avg("recall").alias("mean_text_recall"), F.avg("cited").alias("mean_citation_accuracy"), F.coalesce(F.sum("top1"), F.lit(0)).alias("top1_correct"), F.coalesce(F.sum("asked"), F.lit(0)).alias("queries"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_with_output"), F.coalesce(F.sum("total_pages"), F.lit(0)).cast("long").alias("total_pages"),
    )
    return total.crossJoin(exact_median(each, "parse_seconds").withColumnRenamed("median", "median_parse_seconds"))
