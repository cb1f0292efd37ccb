"""From parsed elements to sections: typing, levels, the heading stack, page ranges, section of a page."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import overlap
from ..functions.text import strip
from ..sources.scratch import stored

#: Boxes of a page that is matched as it stands, at most; on larger ones boxes meet in the cells of a grid.
WHOLE = 512
HEADINGS, DROPPED = ["Title", "Header", "SectionHeader"], ["PageBreak", "Footer", "Address"]


def is_heading() -> Column:
    return F.col("category").isin(HEADINGS)


def level() -> Column:
    """Heading level: depth + 1, else 1 for titles and 2 for other headings; null for other elements."""
    own = F.when(F.col("category_depth") >= 0, F.col("category_depth") + 1).when(F.col("category") == "Title", 1).otherwise(2)
    return F.when(is_heading(), F.greatest(own, F.lit(1)))


def element_type() -> Column:
    return F.when(F.col("category") == "Table", "table").when(F.col("category").isin("Image", "Figure"), "image").when(F.col("category") == "Formula", "formula").otherwise("text")


def mark(raw: DataFrame) -> DataFrame:
    """Elements with heading level, the number of the section they stand in (0: root) and their ids.

    A heading opens the section with the next number; blank headings open none. Ids number all elements that are no
    headings, also those that are dropped later.
    """
    order = Window.partitionBy("document_id").orderBy("pos")
    opens = is_heading() & (strip("text") != "")
    return (
        raw.withColumn("level", F.when(opens, level()))
        .withColumn("sec_seq", F.sum(opens.cast("int")).over(order).cast("int"))
        .withColumn("element_id", F.when(~is_heading(), F.concat(F.lit("el-"), F.sum((~is_heading()).cast("int")).over(order).cast("string"))))
    )


def elements(marked: DataFrame) -> DataFrame:
    """Typed elements without headings, page breaks, footers, addresses and empty texts, with their boxes if they have some."""
    kept = marked.where(~is_heading() & ~F.col("category").isin(DROPPED) & (strip("text") != ""))
    boxes = [c for c in ("bbox", "page_size") if c in marked.columns]
    return kept.select("document_id", "pos", "element_id", element_type().alias("type"), "page", "text", "sec_seq", *boxes)


def sections(marked: DataFrame) -> DataFrame:
    """Sections by a stack of headings: document_id, sec_seq, sec_id, title, level, path, parent_seq, ancestors, page.

    Only headings go through the fold. A document's headings stand in a row in one partition, so the fold runs through
    whole batches and starts anew with each document.
    """
    names = ["document_id", "sec_seq", "sec_id", "title", "level", "path", "parent_seq", "ancestors", "page"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, stack = None, []
        for batch in batches:
            rows = []
            for of, seq, title, depth, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != document:
                    document, stack = of, []
                while stack and stack[-1][1] >= depth:
                    stack.pop()
                parent = stack[-1] if stack else (0, 0, "")
                path = f"{parent[2]} > {title}" if parent[2] else title
                rows.append((of, seq, f"s{seq}", title, depth, path, parent[0], [s[0] for s in stack], page))
                stack.append((seq, depth, path))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    heads = marked.where("level is not null").select("document_id", "sec_seq", strip("text").alias("title"), F.col("level").cast("int"), "page")
    schema = "document_id string, sec_seq int, sec_id string, title string, level int, path string, parent_seq int, ancestors array<int>, page int"
    return heads.repartition("document_id").sortWithinPartitions("document_id", "sec_seq").mapInArrow(fold, schema)


def page_ranges(secs: DataFrame, els: DataFrame) -> DataFrame:
    """The sections with page_lo and page_hi over heading, elements and descendants."""
    own = secs.select("document_id", "sec_seq", "page").union(els.where("sec_seq > 0").select("document_id", "sec_seq", "page"))
    spans = own.groupBy("document_id", "sec_seq").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    up = secs.select("document_id", "sec_seq", F.explode(F.concat("ancestors", F.array("sec_seq"))).alias("above"))
    over = up.join(spans, ["document_id", "sec_seq"]).groupBy("document_id", F.col("above").alias("sec_seq")).agg(F.min("lo").alias("page_lo"), F.max("hi").alias("page_hi"))
    return secs.join(over, ["document_id", "sec_seq"])


def section_of_page(pages: DataFrame, secs: DataFrame) -> DataFrame:
    """Pages (document_id, page) with the deepest section whose range holds them, the last one on equal levels; else the root.

    A sweep over a document's pages: sections come in where they begin, the deepest open one is on top of a heap, and those
    that have ended leave when they come to the top. So a page is one row, however many sections hold it.
    """
    names = ["document_id", "page", "sec_id", "section_path"]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, opened = None, []
        for batch in batches:
            rows = []
            for e in batch.itertuples():
                if e.document_id != document:
                    document, opened = e.document_id, []
                if e.asked == 0:
                    heapq.heappush(opened, (-e.level, -e.sec_seq, e.page_hi, e.sec_id, e.path))
                    continue
                while opened and opened[0][2] < e.page:
                    heapq.heappop(opened)
                rows.append((e.document_id, e.page, *(opened[0][3:] if opened else ("root", "Document"))))
            yield pd.DataFrame(rows, columns=names)

    begin = secs.select("document_id", F.col("page_lo").alias("page"), F.lit(0).alias("asked"), "level", "sec_seq", "page_hi", "sec_id", "path")
    asked = pages.select("document_id", "page", F.lit(1).alias("asked"), *(F.lit(0).alias(c) for c in ("level", "sec_seq", "page_hi")), *(F.lit("").alias(c) for c in ("sec_id", "path")))
    ordered = begin.unionByName(asked).repartition("document_id").sortWithinPartitions("document_id", "page", "asked")
    return ordered.mapInPandas(sweep, "document_id string, page int, sec_id string, section_path string")


def replace_pages(elements: DataFrame, again: DataFrame) -> DataFrame:
    """Elements of pages that were not read again, and the newly read ones."""
    return elements.join(again.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti").unionByName(again)


def _cells(boxes: DataFrame, level: Column, name: str, slack: float = 0.0) -> DataFrame:
    """A row for each grid cell that a box touches on a level, whose cells are 2^level wide."""
    size = F.pow(F.lit(2.0), level)
    side = lambda i, more: F.floor((F.col("bbox")[i] + more * slack) / size)
    cells = boxes.withColumn(name, level.cast("int"))
    return cells.withColumn("cx", F.explode(F.sequence(side(0, -1), side(2, 1)))).withColumn("cy", F.explode(F.sequence(side(1, -1), side(3, 1))))


def _own_level() -> Column:
    """The level on which a box touches four cells at most: cells as wide as its longer side."""
    return F.ceil(F.log2(F.greatest(F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1], F.lit(1.0))))


def _levels(boxes: DataFrame) -> DataFrame:
    """The levels that a page's boxes have: a few, as they grow with the logarithm of the box sizes."""
    return boxes.groupBy("document_id", "page").agg(F.sort_array(F.collect_set(_own_level().cast("int"))).alias("levels"))


def touching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes of a page (document_id, page, a.*, b.* as structs a and b) whose insides meet.

    The larger box of a pair meets the smaller one on its own level of a grid, where both touch four cells at most; the pair
    counts in the cell of the lower corner of what they share. So a page costs its boxes and the pairs that do meet.
    """
    def side(x: DataFrame, y: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
        """x on its own levels, y on those levels of x that are above its own, or also on its own."""
        own = _cells(x, _own_level(), "level")
        above = y.join(_levels(x), ["document_id", "page"]).withColumn("up", F.explode("levels"))
        above = above.where(F.col("up") > _own_level() if strict else F.col("up") >= _own_level())
        return own, _cells(above, F.col("up"), "level")

    keys, found = ["document_id", "page", "level", "cx", "cy"], []
    for first, x, y in ((True, a, b), (False, b, a)):
        own, other = side(x, y, not first)
        one = own.select(*keys, F.struct(*x.columns).alias("a" if first else "b"))
        two = other.select(*keys, F.struct(*y.columns).alias("b" if first else "a"))
        found.append(one.join(two, keys).select(*keys, "a", "b"))
    pairs = found[0].unionByName(found[1])
    size = F.pow(F.lit(2.0), F.col("level"))
    corner = [F.floor(F.greatest(F.col("a.bbox")[i], F.col("b.bbox")[i]) / size) for i in (0, 1)]
    meets = [(F.least(F.col("a.bbox")[i + 2], F.col("b.bbox")[i + 2]) > F.greatest(F.col("a.bbox")[i], F.col("b.bbox")[i])) for i in (0, 1)]
    return pairs.where((F.col("cx") == corner[0]) & (F.col("cy") == corner[1]) & meets[0] & meets[1]).drop("level", "cx", "cy")


def greedy_match(found: DataFrame, places: DataFrame, least: float, by_place: bool) -> DataFrame:
    """Assign found boxes to placeholders of the same document and page, one to one.

    by_place: placeholders choose in their order (tables); otherwise found boxes do (figures). Each takes the best unused
    partner whose overlap is above `least`, of equal ones the first, else the first unused. Overlaps are rounded to 9 places.
    Columns: document_id, page, found_id, place_id (null: unmatched).
    """
    side = lambda x, is_found: x.select("document_id", "page", "pos", "id", "bbox", F.lit(is_found).alias("found"))
    return match_boxes(side(found, True).unionByName(side(places, False)), least, by_place)


def match_boxes(boxes: DataFrame, least: float, by_place: bool) -> DataFrame:
    """greedy_match() of boxes with a column `found` that tells found ones from placeholders.

    Choices of a page depend on those before, so a page is folded in its order. Pages of up to WHOLE boxes are shuffled once
    and matched as they pass; larger ones send the boxes that meet, as numbers.
    """
    keys = ["document_id", "page"]
    crowded = stored(boxes.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select(*keys))
    if crowded.isEmpty():
        return _match_whole(boxes, least, by_place)
    large = boxes.join(crowded, keys, "left_semi")
    large = _match_large(large.where("found"), large.where("not found"), least, by_place)
    return _match_whole(boxes.join(crowded, keys, "left_anti"), least, by_place).unionByName(large)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole pages of sorted rows, some at a time, with the first row of each."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([rest, part]) if rest is not None else part
        first = _first_rows(part)
        cut = first[-1] if len(first) else 0
        if cut:
            yield part.slice(0, cut), first[:-1]
        rest = part.slice(cut)
    if rest is not None and len(rest):
        yield rest, _first_rows(rest)


def _first_rows(rows: pa.Table) -> np.ndarray:
    codes = [rows.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for k in ("document_id", "page")]
    changes = np.zeros(len(rows), bool)
    changes[:1] = True
    for c in codes:
        changes[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changes)


def _preferences(sides: np.ndarray, first: np.ndarray, answers: np.ndarray, asks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each asker in turn, the numbers of the answers of its page whose overlap is above `least`, best first: where
    each asker's begin, and all of them. A page's answers stand before its askers."""
    counts = np.repeat(answers, asks)  # partners of each asker
    begin = np.cumsum(counts) - counts
    m = np.arange(counts.sum()) - np.repeat(begin, counts)
    asker = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(first + answers, asks) + np.arange(len(counts)) - np.repeat(np.cumsum(asks) - asks, asks)
    a, b = sides[:, rows[asker]], sides[:, np.repeat(np.repeat(first, asks), counts) + m]
    width, height = (np.minimum(a[i + 2], b[i + 2]) - np.maximum(a[i], b[i]) for i in (0, 1))
    meets = np.flatnonzero((width > 0) & (height > 0))  # not for boxes with nulls
    a = a[:, meets]
    share = np.floor(width[meets] * height[meets] / np.maximum((a[2] - a[0]) * (a[3] - a[1]), 1e-6) * 1e9 + 0.5) / 1e9
    above = np.flatnonzero(share > least)
    asker, m, share = asker[meets[above]], m[meets[above]], share[above]
    order = np.lexsort((m, -share, asker))
    return np.searchsorted(asker, np.arange(len(counts) + 1)), m[order]


def _match_whole(boxes: DataFrame, least: float, by_place: bool) -> DataFrame:
    """Matches of pages that are small enough to be held."""
    keys = ["document_id", "page"]
    asks = F.coalesce(~F.col("found") if by_place else F.col("found"), F.lit(False))
    rows = boxes.select(*keys, "pos", "id", asks.alias("asks"), *[F.col("bbox")[i].cast("double").alias(f"b{i}") for i in range(4)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "asks", "pos", "id").drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first in _pages(batches):
            asking = part.column("asks").to_numpy()
            sides = np.stack([part.column(f"b{i}").to_numpy() for i in range(4)])
            size = np.diff(np.append(first, len(part)))
            asks = np.add.reduceat(asking.astype(np.int64), first)
            answers = size - asks
            begin, best = _preferences(sides, first, answers, asks, least)
            begin, best, ids = begin.tolist(), best.tolist(), part.column("id").to_pylist()
            named = (part.column("document_id").is_valid().to_numpy() & part.column("page").is_valid().to_numpy())[first]
            rows, partners, asker = [], [], 0
            for at, n, q, known in zip(first.tolist(), answers.tolist(), asks.tolist(), named.tolist(), strict=True):
                used, free, matched = set(), 0, {}  # id of a found box -> its placeholders; ids may stand more than once
                for k in range(q if known else 0):
                    if len(used) == n:
                        break
                    while free in used:
                        free += 1
                    m = next((y for y in best[begin[asker + k] : begin[asker + k + 1]] if y not in used), free)
                    used.add(m)
                    one, place = (at + m, at + n + k) if by_place else (at + n + k, at + m)
                    if ids[one] is not None:
                        matched.setdefault(ids[one], []).append(place)
                asker += q
                for one in range(at, at + n) if by_place else range(at + n, at + n + q):
                    for place in matched.get(ids[one], (None,)):
                        rows.append(one)
                        partners.append(place)
            rows, partners = pa.array(rows, pa.int64()), pa.array(partners, pa.int64())
            columns = [part.column(k).take(rows) for k in (*keys, "id")] + [part.column("id").take(partners)]
            yield from pa.table(columns, [*keys, "found_id", "place_id"]).combine_chunks().to_batches()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"document_id {kinds['document_id']}, page {kinds['page']}, found_id {kinds['id']}, place_id {kinds['id']}")


def _match_large(found: DataFrame, places: DataFrame, least: float, by_place: bool) -> DataFrame:
    """Matches of pages of any size: boxes meet in the cells of a grid, and the fold sees only pairs that meet, as numbers."""
    keys = ["document_id", "page"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "id")) - 1
    ask, answer = ((places, found) if by_place else (found, places))
    ask, answer = (x.select(*keys, "id", "bbox", order.alias("n")) for x in (ask, answer))
    pairs = touching(ask, answer).withColumn("share", F.round(overlap(F.col("a.bbox"), F.col("b.bbox")), 9)).where(F.col("share") > least)
    best = pairs.groupBy(*keys, F.col("a.n").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("b.n").alias("n")))), lambda x: x["n"]).alias("best"))
    counts = answer.groupBy(*keys).agg(F.count("*").alias("free"))
    asked = ask.select(*keys, "n").join(best, [*keys, "n"], "left").join(counts, keys)
    names = [*keys, "n", "m"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, used, first = None, set(), 0
        for batch in batches:
            rows = []
            for x in batch.itertuples():
                if (x.document_id, x.page) != page:
                    page, used, first = (x.document_id, x.page), set(), 0
                if len(used) == x.free:
                    continue
                while first in used:
                    first += 1
                m = next((y for y in x.best if y not in used), first) if x.best is not None else first
                used.add(m)
                rows.append((x.document_id, x.page, x.n, m))
            yield pd.DataFrame(rows, columns=names)

    ordered = asked.repartition(*keys).sortWithinPartitions(*keys, "n").select(*keys, "n", "best", "free")
    chosen = ordered.mapInPandas(fold, "document_id string, page int, n int, m int")
    matched = chosen.join(ask.select(*keys, "n", F.col("id").alias("ask_id")), [*keys, "n"]).join(answer.select(*keys, F.col("n").alias("m"), F.col("id").alias("answer_id")), [*keys, "m"])
    found_id, place_id = ("answer_id", "ask_id") if by_place else ("ask_id", "answer_id")
    return found.select(*keys, F.col("id").alias("found_id")).join(matched.select(*keys, F.col(found_id).alias("found_id"), F.col(place_id).alias("place_id")), [*keys, "found_id"], "left")


def suppress_text_in_tables(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes without the text boxes that a table box of the page covers by the share (from a half on) or more.

    A box that covers half of another or more holds its centre. So a text stands in the one cell of its centre on each level
    of the page's tables, a table in the cells it touches on its own level, and only these meet.
    """
    if share < 0.5:
        raise ValueError("a smaller share than a half need not hold the centre")
    tables = boxes.where("kind = 'table'").select("document_id", "page", "bbox")
    t = _cells(tables, _own_level(), "level", 1e-6).withColumnRenamed("bbox", "table_box")
    size = F.pow(F.lit(2.0), F.col("level"))
    centre = lambda i: F.floor((F.col("bbox")[i] + F.col("bbox")[i + 2]) / 2 / size)
    x = boxes.where("kind = 'text'").join(_levels(tables), ["document_id", "page"]).withColumn("level", F.explode("levels"))
    x = x.withColumn("cx", centre(0)).withColumn("cy", centre(1))
    covered = x.join(t, ["document_id", "page", "level", "cx", "cy"]).where(F.round(overlap(F.col("bbox"), F.col("table_box")), 9) >= share)
    return boxes.join(covered.select("document_id", "page", "id").distinct(), ["document_id", "page", "id"], "left_anti")
