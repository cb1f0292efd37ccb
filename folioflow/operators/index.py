"""Section indexes and document meta: keywords, summaries, counts, captions, terminology, prompt packing, merging of answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import count_tokens, lenient_json, normalize_title, strip, summary, words_for_keywords

BODY, KEYWORDS = 4000, 8
#: What a model may say of a document, and its answer to a batch of sections.
INFERRED = ["doc_type", "language", "inferred_title", "inferred_authors", "abstract"]
ANSWER = "document struct<doc_type string, language string, inferred_title string, inferred_authors array<string>, abstract string>, sections array<struct<id string, summary string, keywords array<string>>>"
# Words that are no abbreviations, and the forms of a document's terms.
COMMON = ["THE", "AND", "FOR", "WITH", "FROM", "THIS", "THAT", "ARE", "WAS", "WERE"]
CODE_FORM = r"\b[A-Z]{1,3}[_-]?[A-Z0-9][A-Z0-9_-]*\b"
ABBREVIATION_FORM = r"\b[A-Z]{2,4}\b"
SHORT_DATE_FORM = r"\b[A-Z][a-z]{2}-\d{2}\b"
IDENTIFIER_FORM = r"(?i)\b\d+\s+[A-Z]+\s+\d+\b|\bpart\s+number\s+\w+\b"
ENTITY_FORM = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
DATA_TYPES = [(r"(?i)\bpercent(?:age)?\b", "percentages"), (r"(?i)\brate\b", "rates"), (r"(?i)\b(?:time\s+)?series\b", "time series"), (r"(?i)\bmonetary\b|\b(?:currency|money|amount|value)\b", "monetary values"), (r"(?i)\b(?:code|identifier)\b", "codes")]


def bodies(elements: DataFrame, chars: int = BODY) -> DataFrame:
    """The text of each section, in order, cut: document_id, sec_seq, body. Texts that begin behind the cut are not gathered."""
    texts = elements.where("type in ('text', 'formula')").select("document_id", "sec_seq", "pos", F.substring(strip("text"), 1, chars).alias("text"))
    before = Window.partitionBy("document_id", "sec_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    near = texts.withColumn("before", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))).where(F.col("before") < chars)
    parts = near.groupBy("document_id", "sec_seq").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return parts.select("document_id", "sec_seq", F.substring(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), 1, chars).alias("body"))


def top_words(column: str, k: int = KEYWORDS) -> Column:
    """The k most frequent words of a text, words in order on equal counts. Sorted words are counted by their runs, in the row."""

    def runs(words: Column) -> Column:
        spots = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter(spots, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return F.struct(words.alias("words"), heads.alias("heads"))

    def top(r: Column) -> Column:
        counted = F.transform(r["heads"], lambda i, n: F.struct((i - F.coalesce(F.get(r["heads"], n + 1), F.size(r["words"]))).alias("minus"), F.get(r["words"], i).alias("word")))
        return F.transform(F.slice(F.array_sort(counted), 1, k), lambda x: x["word"])

    words = F.array_sort(F.coalesce(words_for_keywords(column), F.array().cast("array<string>")))
    return F.get(F.transform(F.transform(F.array(words), runs), top), F.lit(0))


def keywords(texts: DataFrame, keys: list[str], column: str, k: int = KEYWORDS) -> DataFrame:
    """The k most frequent words of each text that has some: keys, keywords (array)."""
    return texts.select(*keys, top_words(column, k).alias("keywords")).where(F.size("keywords") > 0)


def element_counts(elements: DataFrame) -> DataFrame:
    """Per section a map of counts by type, and whether there are tables or figures."""
    by_type = elements.groupBy("document_id", "sec_seq", "type").agg(F.count("*").alias("n"))
    return by_type.groupBy("document_id", "sec_seq").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("element_counts"),
        (F.count_if(F.col("type") == "table") > 0).alias("has_tables"),
        (F.count_if(F.col("type") == "image") > 0).alias("has_figures"),
    )


def sections_index(secs: DataFrame, elements: DataFrame) -> DataFrame:
    """Index entries without a model: summary and keywords of the body, of the title where there is no body."""
    keyed = secs.join(bodies(elements), ["document_id", "sec_seq"], "left").withColumn("source", F.when(F.coalesce("body", F.lit("")) != "", F.col("body")).otherwise(F.col("title")))
    full = keyed.withColumn("keywords", top_words("source")).join(element_counts(elements), ["document_id", "sec_seq"], "left")
    return full.select(
        "document_id",
        "sec_seq",
        "sec_id",
        "title",
        normalize_title("title").alias("normalized_title"),
        "path",
        "level",
        "page_lo",
        "page_hi",
        F.coalesce(summary("body"), F.lit("")).alias("summary"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("element_counts", F.create_map().cast("map<string,bigint>")).alias("element_counts"),
        F.coalesce("has_tables", F.lit(False)).alias("has_tables"),
        F.coalesce("has_figures", F.lit(False)).alias("has_figures"),
    )


def document_meta(elements: DataFrame, secs: DataFrame, inferred: DataFrame | None = None, chars: int = 200) -> DataFrame:
    """Per document its figure and table captions in order, visual pages, number of sections, and what a model says of it.

    inferred has document_id and any of doc_type, language, inferred_title, inferred_authors and abstract, a row a document;
    values are trimmed and cut, missing ones get defaults, so the columns are the same without a model.
    """
    caption = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("pos", "page", F.substring("text", 1, chars).alias("caption"))))), lambda x: F.struct(x["caption"].alias("caption"), x["page"].alias("page")))
    by_doc = elements.groupBy("document_id").agg(caption("image").alias("figure_index"), caption("table").alias("table_index"), F.sort_array(F.collect_set(F.when((F.col("type") == "image") & (F.col("page") > 0), F.col("page")))).alias("visual_pages"))
    found = by_doc.join(secs.groupBy("document_id").agg(F.count("*").alias("num_sections")), "document_id", "left").withColumn("num_sections", F.coalesce("num_sections", F.lit(0)))
    have = [] if inferred is None else [c for c in INFERRED if c in inferred.columns]
    if have:
        found = found.join(inferred.select("document_id", *have), "document_id", "left")
    said = lambda c: F.coalesce(strip(c), F.lit("")) if c in have else F.lit("")
    authors = F.col("inferred_authors") if "inferred_authors" in have else F.lit(None).cast("array<string>")
    named = F.filter(F.transform(authors, strip), lambda x: x != "")
    return found.withColumns({
        "doc_type": F.coalesce(F.nullif(F.lower(said("doc_type")), F.lit("")), F.lit("other")),
        "language": F.substring(F.lower(said("language")), 1, 8),
        "inferred_title": F.substring(said("inferred_title"), 1, 300),
        "inferred_authors": F.coalesce(F.slice(named, 1, 20), F.array().cast("array<string>")),
        "abstract": F.substring(said("abstract"), 1, 500),
    })


def terminology(entries: DataFrame) -> DataFrame:
    """Codes, abbreviations, date formats, identifiers, data types and entities of a document's index entries, sorted."""
    text = F.concat_ws(" ", "title", "summary", F.array_join("keywords", " "))
    joined = entries.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_seq", text.alias("t")))), lambda x: x["t"]), " ").alias("t"), F.flatten(F.collect_list(F.concat("keywords", F.array("title")))).alias("names"))
    find = lambda form: F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(form), F.lit(0))))
    return joined.select(
        "document_id",
        find(CODE_FORM).alias("codes"),
        F.filter(find(ABBREVIATION_FORM), lambda a: ~a.isin(COMMON)).alias("abbreviations"),
        find(SHORT_DATE_FORM).alias("date_formats"),
        find(IDENTIFIER_FORM).alias("identifiers"),
        F.array_compact(F.array(*[F.when(F.col("t").rlike(f), n) for f, n in DATA_TYPES])).alias("data_types"),
        F.slice(F.array_sort(F.array_distinct(F.filter("names", lambda x: x.rlike(ENTITY_FORM)))), 1, 10).alias("entities"),
    )


def meta_block(most_pages: int = 30, chars: int = 500) -> Column:
    """A document's meta as text: type, title, abstract and the first visual pages."""
    pages = F.array_join(F.slice("visual_pages", 1, most_pages).cast("array<string>"), ", ")
    abstract = F.nullif(F.substring(strip("abstract"), 1, chars), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("doc_type: "), F.coalesce("doc_type", F.lit("?"))), F.concat(F.lit("title: "), F.coalesce("inferred_title", F.lit(""))), F.concat(F.lit("abstract: "), abstract), F.concat(F.lit("visual_pages: "), F.nullif(pages, F.lit(""))))


def table_of_contents(entries: DataFrame, metas: DataFrame | None = None, most: int = 20) -> DataFrame:
    """The first sections of a document as text (toc), and its meta block (meta) where metas are given."""
    few = entries.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("sec_seq"))).where(F.col("n") <= most)
    blank = lambda c: F.nullif(c, F.lit(""))
    line = F.concat(
        F.lit("- ["), "document_id", F.lit(":"), "sec_id", F.lit("] "), F.coalesce("path", "title"), F.lit("  (pp. "), F.col("page_lo").cast("string"), F.lit("-"), F.col("page_hi").cast("string"), F.lit(")"),
        F.coalesce(F.concat(F.lit("\n    summary: "), blank(F.substring(strip("summary"), 1, 200))), F.lit("")),
        F.coalesce(F.concat(F.lit("\n    keywords: "), blank(F.array_join(F.slice("keywords", 1, 6), ", "))), F.lit("")),
    )
    toc = few.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("toc"))
    if metas is None:
        return toc
    return toc.join(metas.select("document_id", meta_block().alias("meta")), "document_id", "left").withColumn("meta", F.coalesce("meta", F.lit("(document meta unavailable)")))


def backfill(state: DataFrame, index: DataFrame, made: DataFrame) -> DataFrame:
    """Index entries, or metas, for documents that are ready or partial and have none of them yet."""
    due = state.where("status in ('ready', 'partial')").join(index.select("document_id").distinct(), "document_id", "left_anti")
    return made.join(due.select("document_id"), "document_id", "left_semi")


def parse_answers(responses: DataFrame) -> DataFrame:
    """A model's answers (document_id, batch, response): document_id, batch, document and sections, without those that hold
    no JSON object."""
    parsed = F.from_json(lenient_json("response"), ANSWER)
    return responses.select("document_id", "batch", parsed.alias("a")).where("a is not null").select("document_id", "batch", "a.*")


def section_answers(parsed: DataFrame) -> DataFrame:
    """A row for each section that a batch answers: document_id, batch (with the place in the answer), sec_id, summary, keywords."""
    each = parsed.select("document_id", "batch", F.posexplode("sections").alias("place", "s")).where("s is not null")
    sec_id = F.coalesce(strip("s.id"), F.lit(""))
    return each.select("document_id", F.struct("batch", "place").alias("batch"), sec_id.alias("sec_id"), F.coalesce("s.summary", F.lit("")).alias("summary"), F.coalesce("s.keywords", F.array().cast("array<string>")).alias("keywords")).where("sec_id <> ''")


def document_blocks(parsed: DataFrame) -> DataFrame:
    """What the first batch that says anything of the document as a whole says: document_id and the fields of INFERRED."""
    said = F.coalesce(*(F.col(f"document.{c}").cast("string") for c in INFERRED)).isNotNull()
    return parsed.where(said).groupBy("document_id").agg(F.min_by("document", "batch").alias("d")).select("document_id", "d.*")


def merge_answers(answers: DataFrame, fallback: DataFrame, chars: int = 200, most: int = 6) -> DataFrame:
    """Per section the answer of the latest batch, trimmed and cut; sections without one keep the fallback's summary and keywords."""
    latest = answers.groupBy("document_id", "sec_id").agg(F.max_by(F.struct("summary", "keywords"), "batch").alias("a"))
    words = F.slice(F.filter(F.transform("a.keywords", strip), lambda w: w != ""), 1, most)
    joined = fallback.join(latest, ["document_id", "sec_id"], "left")
    return joined.select("document_id", "sec_id", F.when(F.col("a").isNotNull(), F.substring(strip("a.summary"), 1, chars)).otherwise(F.col("summary")).alias("summary"), F.when(F.col("a").isNotNull(), words).otherwise(F.col("keywords")).alias("keywords"))


def pack_sections(secs: DataFrame, budget: int = 120_000, most: int = 40) -> DataFrame:
    """Batches of sections in order, for prompts under a token budget: document_id, sec_seq, batch.

    A prompt holds the whole table of contents and its batch's bodies. secs has document_id, sec_seq, toc and body. Tokens
    are counted in Spark; the fold sees integers only. One section that is too long is a batch of its own.
    """
    counted = secs.select("document_id", "sec_seq", count_tokens("toc").alias("toc_n"), count_tokens("body").alias("body_n"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sec_seq")
        base, batch, used, held, out = int(part["toc_n"].sum()), 0, 0, 0, []
        for n in part["body_n"]:
            if held and (held >= most or base + used + n > budget):
                batch, used, held = batch + 1, 0, 0
            used, held = used + n, held + 1
            out.append(batch)
        return pd.DataFrame({"document_id": part["document_id"], "sec_seq": part["sec_seq"], "batch": out})

    return counted.groupBy("document_id").applyInPandas(fold, "document_id string, sec_seq int, batch int")


def table_islands(tables: DataFrame) -> DataFrame:
    """Tables (document_id, tbl_seq, page, x0, markdown, flavor) with `place`, their order in the document, and `island`.

    Tables are read by page and left side. A table goes on with the island before it if its columns differ from those of the
    island's first table by two at most, it stands two pages at most from the island's last one, and its header's words
    resemble that first table's; headers without words resemble all. Only shapes go through the fold, which runs through
    whole batches and starts anew with each document.
    """
    names = ["document_id", "tbl_seq", "place", "island"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, place, island, first, last_page = None, 0, -1, None, 0
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                words = set(t.tokens)
                if t.document_id != document:
                    document, place, island, first = t.document_id, 0, -1, None
                goes_on = first is not None and abs(t.cols - first[0]) <= 2 and abs(t.page - last_page) <= 2
                if goes_on and words and first[1]:
                    goes_on = len(words & first[1]) / len(words | first[1]) >= 0.3
                if not goes_on:
                    island, first = island + 1, (t.cols, words)
                last_page = t.page
                rows.append((t.document_id, t.tbl_seq, place, island))
                place += 1
            yield pd.DataFrame(rows, columns=names)

    shapes = tables.select("document_id", "tbl_seq", "page", "x0", T.columns("markdown").alias("cols"), T.header_tokens("markdown").alias("tokens"))
    ordered = shapes.repartition("document_id").sortWithinPartitions("document_id", "page", F.coalesce("x0", F.lit(0)), "tbl_seq")
    return ordered.mapInPandas(fold, "document_id string, tbl_seq int, place int, island int")


def merge_tables(tables: DataFrame) -> DataFrame:
    """Consecutive tables of a document joined: document_id, island, page_lo, page_hi, flavor, tables, markdown.

    The first table's header stands for all; the others add their rows. A stream table makes the whole a stream one. The
    pieces of an island are joined once, in one aggregation.
    """
    placed = tables.join(table_islands(tables), ["document_id", "tbl_seq"])
    rows = T.lines("markdown")
    own = F.struct("place", "page", F.array_join(rows, "\n").alias("whole"), F.array_join(F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))), "\n").alias("more"), F.col("flavor"))
    parts = placed.groupBy("document_id", "island").agg(F.array_sort(F.collect_list(own)).alias("p"))
    more = F.filter(F.transform(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda t: t["more"]), lambda m: m != "")
    whole = F.array_join(F.concat(F.array(F.col("p")[0]["whole"]), more), "\n")
    flavor = F.when(F.exists("p", lambda t: t["flavor"] == "stream"), "stream").otherwise(F.col("p")[0]["flavor"])
    return parts.select("document_id", "island", F.col("p")[0]["page"].alias("page_lo"), F.element_at("p", -1)["page"].alias("page_hi"), flavor.alias("flavor"), F.size("p").alias("tables"), whole.alias("markdown"))


def choose_flavor(found: DataFrame) -> DataFrame:
    """Rows of tables (document_id, page, flavor, cols) but for lattice ones on pages where stream found several columns."""
    wide = found.where("flavor = 'stream' and cols > 1").select("document_id", "page").distinct()
    return found.where("flavor = 'stream'").unionByName(found.where("flavor = 'lattice'").join(wide, ["document_id", "page"], "left_anti"))
