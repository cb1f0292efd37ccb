"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors of one label are clustered around centroids that a bounded sample gives, and each goes to the shards of its nearest
OVERLAP centroids. A shard of more than BLOCK vectors is dealt into blocks by a hash, so no task holds a hot cluster. In
each block every vector gets a list of neighbours by robust pruning: nearest first, dropping those that a kept neighbour
already leads to; lists are made mutual, and those of one vector in several shards are united. Then each vector is a query
in its nearest shard, against all its blocks: a greedy search from the block's medoids, and from the vector itself where
it is a node, finds the nearest nodes, and a range expansion follows neighbours for as long as nodes are within range.
Every link is verified by its cosine in double precision before it counts.

Equal vectors are one node with a number of copies. A task returns each query's number of links and, for the components,
one edge from each node to the smallest node of its part, so results grow with the vectors and not with their pairs.
audit_recall() measures the links found against brute force for a bounded number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .components import connected_components

#: Vectors the centroids are fitted on, vectors of a shard aimed at, centroids of all labels, shards of a vector, vectors
#: of a block, queries of a task.
SAMPLE, SHARD, MOST_CENTROIDS, OVERLAP, BLOCK, QUERIES = 20_000, 512, 4096, 3, 1024, 2048
#: Neighbours after pruning, candidates for pruning, the factor by which a kept neighbour must be nearer, width of a search.
DEGREE, CANDIDATES, ALPHA, BEAM, ENTRIES = 32, 192, 1.2, 16, 4


def usable(embedding: str, label: str) -> Column:
    """Neither null nor zero, finite, with a label."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    long = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + F.abs(x)) > 0
    return F.col(label).isNotNull() & F.col(embedding).isNotNull() & F.coalesce(fine & long, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(sample: list[tuple[str, np.ndarray]], rows: dict[str, int], shard: int = SHARD, rounds: int = 4) -> dict[str, np.ndarray]:
    """Spherical k-means of each group's part of the sample; about one centroid for `shard` vectors of the group."""
    every = max(1, sum(rows.values()))
    out = {}
    for group in sorted({g for g, _ in sample}):
        x = unit(np.stack([v for g, v in sample if g == group]))
        k = min(-(-rows[group] // shard), len(x), max(1, MOST_CENTROIDS * rows[group] // every))
        c = x[:k]
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            some = np.abs(sums).max(1) > 0
            c = c.copy()
            c[some] = unit(sums[some])
        out[group] = c
    return out


def prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of all rows by robust pruning, made mutual."""
    n = len(x)
    near: list[set[int]] = [set() for _ in range(n)]
    m = min(CANDIDATES, n - 1)
    for a in range(0, n, 256):
        cos = x[a : a + 256] @ x.T
        cos[np.arange(len(cos)), a + np.arange(len(cos))] = -2
        order = np.argpartition(-cos, m - 1, axis=1)[:, :m] if m < n - 1 else np.argsort(-cos, axis=1)[:, : n - 1]
        for r in range(len(cos)):
            p = a + r
            c = order[r][np.argsort(-cos[r, order[r]], kind="stable")]
            d = np.sqrt(np.maximum(2 - 2 * cos[r, c], 0))
            among = np.sqrt(np.maximum(2 - 2 * (x[c] @ x[c].T), 0)) * ALPHA
            alive = np.ones(len(c), dtype=bool)
            for i in range(len(c)):
                if alive[i]:
                    near[p].add(int(c[i]))
                    if len(near[p]) >= DEGREE:
                        break
                    alive &= among[i] > d
    for p in range(n):
        for q in list(near[p]):
            near[q].add(p)
    return [np.fromiter(sorted(s), np.int64, len(s)) for s in near]


def search(x: np.ndarray, near: list[np.ndarray], entries: np.ndarray, q: np.ndarray, own: int | None, threshold: float) -> np.ndarray:
    """Rows of x with a cosine to q of at least the threshold, found by greedy search and range expansion."""
    start = np.unique(np.append(entries, own) if own is not None else entries)
    known = np.zeros(len(x), dtype=bool)
    known[start] = True
    ids, cos = start, x[start] @ q
    expanded = np.zeros(len(x), dtype=bool)
    while True:  # greedy: expand the best of the beam until all of it is expanded
        top = ids[np.argsort(-cos, kind="stable")[:BEAM]]
        todo = top[~expanded[top]]
        if not len(todo):
            break
        todo = todo[:4]
        expanded[todo] = True
        new = np.unique(np.concatenate([near[i] for i in todo]))
        new = new[~known[new]]
        known[new] = True
        ids, cos = np.append(ids, new), np.append(cos, x[new] @ q)
    while True:  # range: expand whatever lies within it
        todo = ids[(cos >= threshold) & ~expanded[ids]]
        if not len(todo):
            return ids[cos >= threshold]
        expanded[todo] = True
        new = np.unique(np.concatenate([near[i] for i in todo]))
        new = new[~known[new]]
        known[new] = True
        ids, cos = np.append(ids, new), np.append(cos, x[new] @ q)


def medoids(x: np.ndarray, n: int = ENTRIES) -> np.ndarray:
    """The row nearest to the mean, and rows far from those taken."""
    out = [int((x @ x.mean(0)).argmax())]
    worst = x @ x[out[0]]
    while len(out) < min(n, len(x)):
        out.append(int(worst.argmin()))
        worst = np.maximum(worst, x @ x[out[-1]])
    return np.asarray(sorted(set(out)))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors are compared only when their labels are equal and not null, and their lengths too. Null vectors and vectors
    that are zero or hold null or non-finite components link with nothing: n_links 0, component_id = vec_id, kept. Rows
    repeated in id, vector and label count as one vector and have one result row each. A null vec_id takes no part (nulls).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    good = rows.where(usable("embedding", "label") & F.col("vec_id").isNotNull()).withColumn("group", F.concat_ws(" ", F.size("embedding"), "label"))
    copies = good.dropDuplicates(["vec_id", "group", "embedding"]).groupBy("group", "embedding")
    nodes = stored(copies.agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))

    links, edges = _graph_links(nodes, threshold)
    parts = connected_components(edges)
    placed = nodes.join(links, "node", "left").join(parts, "node", "left")
    found = placed.select("group", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    members = good.join(found, ["group", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable("embedding", "label") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _shards(nodes: DataFrame) -> DataFrame:
    """node, copies, embedding, group, and for each of its shards: shard, and whether it is the nearest one."""
    sizes = {r["group"]: r["n"] for r in nodes.groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(MOST_CENTROIDS).collect()}
    sample = nodes.orderBy(F.xxhash64("node", F.lit("sample")), "node").limit(SAMPLE).select("group", "embedding").collect()
    chosen = [(r["group"], np.asarray(r["embedding"])) for r in sample if r["group"] in sizes]
    centroids = nodes.sparkSession.sparkContext.broadcast(fit_centroids(chosen, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("group").to_pylist()
            out: list[list[int]] = [[0]] * len(groups)
            for g in set(groups) & set(centroids.value):
                at = [i for i, x in enumerate(groups) if x == g]
                c = centroids.value[g]
                cos = unit(np.stack([np.asarray(batch.column("embedding")[i].as_py()) for i in at])) @ c.T
                best = np.argsort(-cos, axis=1, kind="stable")[:, :OVERLAP]
                for i, b in zip(at, best.tolist(), strict=True):
                    out[i] = b
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "copies", "group", "embedding")), pa.array(out, pa.list_(pa.int32()))], ["node", "copies", "group", "embedding", "shards"])

    placed = nodes.select("node", "copies", "group", "embedding").mapInArrow(run, "node long, copies long, group string, embedding array<double>, shards array<int>")
    return placed.select("node", "copies", "group", "embedding", F.posexplode("shards").alias("place", "shard"))


def _graph_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, n): the copies of all other nodes linked with it; (a, b): edges that connect each component."""
    placed = stored(_shards(nodes))
    counts = placed.groupBy("group", "shard").agg(F.count("*").alias("members"), F.count_if(F.col("place") == 0).alias("queries"))
    dealt = placed.join(counts, ["group", "shard"])
    spread = lambda n, most: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / most)).cast("int")
    members = dealt.withColumn("block", spread("members", BLOCK))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["node"].to_numpy()
        near = prune(unit(np.stack(part["embedding"].to_numpy()))) if len(part) > 1 else [np.zeros(0, np.int64)]
        return pd.DataFrame({"node": ids, "near": [ids[x].tolist() for x in near]})

    lists = members.groupBy("group", "shard", "block").applyInPandas(build, "node long, near array<long>")
    united = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # OVERLAP lists each

    tasks = F.ceil(F.col("queries") / QUERIES)
    graph = members.join(united, "node").withColumn("task", F.explode(F.sequence(F.lit(0), F.greatest(tasks, F.lit(1)).cast("int") - 1)))
    blocks = F.ceil(F.col("members") / BLOCK)
    queries = dealt.where("place = 0").withColumn("task", F.pmod(F.xxhash64("node", F.lit("task")), tasks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))).withColumn("near", F.array().cast("array<long>"))
    cols = ["group", "shard", "block", "task", "node", "copies", "embedding", "near", "home"]
    graph, queries = (x.withColumn("home", F.col("place") == 0) for x in (graph, queries))
    both = graph.select(*cols, F.lit(0).alias("kind")).union(queries.select(*cols, F.lit(1).alias("kind")))

    def find(part: pd.DataFrame) -> pd.DataFrame:
        base, asked = part[part["kind"] == 0].reset_index(drop=True), part[part["kind"] == 1]
        ids, rows, weights = asked["node"].to_numpy(), [], base["copies"].to_numpy()
        if len(base) and len(asked):
            place = {int(v): i for i, v in enumerate(base["node"])}
            x, q = unit(np.stack(base["embedding"].to_numpy())), unit(np.stack(asked["embedding"].to_numpy()))
            near = [np.fromiter((place[v] for v in map(int, vs) if v in place), np.int64) for vs in base["near"]]
            entries, names, home = medoids(x), base["node"].to_numpy(), base["home"].to_numpy(bool)
            for k in range(len(asked)):
                own = place.get(int(ids[k]))
                hits = search(x, near, entries, q[k], own, threshold)
                hits = hits[hits != own] if own is not None else hits
                if len(hits):
                    far = hits[~home[hits]]
                    rows.append((int(ids[k]), int(weights[hits[home[hits]]].sum()), [int(v) for v in names[hits]], names[far].tolist(), weights[far].tolist()))
        # One edge from each node to the least of its part, within this task.
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for v, _, others, _, _ in rows:
            for o in others:
                a, b = top(v), top(o)
                if a != b:
                    root[max(a, b)] = min(a, b)
        found = {v: (n, far, theirs) for v, n, _, far, theirs in rows}
        every, own = sorted(set(root) | set(found)), dict(zip(asked["node"], asked["copies"], strict=True))
        each = [found.get(v, (0, [], [])) for v in every]
        lists = {c: pd.Series([x[i] for x in each], dtype=object) for i, c in ((1, "far"), (2, "theirs"))}  # also where there are none
        return pd.DataFrame({"node": every, "n": [x[0] for x in each], **lists, "own": [int(own.get(v, 0)) for v in every], "other": [top(v) for v in every]})

    result = stored(both.groupBy("group", "shard", "block", "task").applyInPandas(find, "node long, n long, far array<long>, theirs array<long>, own long, other long"))
    drop_stored(placed)
    drop_stored(united)
    # A vector searches its own shard and counts the ones at home there, which do likewise. Of another shard's vector either
    # side may know alone, so those links go both ways and count once.
    away = result.select("node", "own", F.explode(F.arrays_zip("far", "theirs")).alias("x"))
    both_ways = away.select("node", F.col("x.far").alias("other"), F.col("x.theirs").alias("n")).union(away.select("x.far", "node", F.col("own").alias("n"))).dropDuplicates(["node", "other"])
    counts = result.select("node", "n").union(both_ways.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    return counts, result.select(F.col("node").alias("a"), F.col("other").alias("b"))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, every: int = 50, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row: the links of the queries (ids divisible by `every`) by brute force in blocks, and those found for them."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label")).where(usable("embedding", "label"))
    asked = rows.where(F.col("vec_id") % every == 0)
    cosine = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda a: F.sqrt(cosine(a, a))
    q = asked.select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("e"))
    pairs = q.join(rows, "label").where((F.col("q") != F.col("vec_id")) & (cosine("e", "embedding") / (length("e") * length("embedding")) >= threshold))
    true = q.select("q").join(pairs.groupBy("q").agg(F.count("*").alias("n")), "q", "left").select(F.col("q").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n"))
    return true.join(result, "vec_id").agg(F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found"))
