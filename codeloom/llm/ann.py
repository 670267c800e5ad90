"""Approximate nearest neighbours by inner product, on balanced posting lists.

Largest inner product is made a nearest-distance search by one more coordinate, sqrt(M**2 - |x|**2), M being the largest norm; a query's is 0.

*Lists.* About ``n / LIST`` centroids, at most ``MOST_LISTS``, are fitted by balanced k-means (a cluster's size adds to its distance) on a sample of at most
``SAMPLE`` vectors and ``SAMPLE_BYTES`` bytes (twice at the most), chosen by a hash of vec_id. Every vector is then put into its nearest list, and into others, up to
``REPLICAS``, that are no more than ``BOUNDARY`` times as far.
*Centroid search.* Centroids form a graph (nearest neighbours and random links), held in memory by each task; a best-first search
walks it for many vectors at once.
*Pruning.* A query looks into all lists no farther than ``ratio`` times its nearest (or the median query's nearest, if that is more), and on until
these hold enough rows. The ratio is measured: for ``CALIBRATION`` queries the true
neighbours are found by brute force over all rows, in blocks, and the ratio covers the lists of the share ``COVER`` of them.
*Scan.* A list is cut into blocks of about ``BLOCK`` rows, each read by one task with the queries that chose the list; a task passes on
the best ``k + 1`` for each query. Equal query vectors are searched once. So a hot list or a hot vector is spread over tasks.

Defined cases: vectors null, empty, zero, of another length than most, or holding a null, NaN or infinite component take no part, nor do rows of null vec_id; rows that
repeat a vec_id are one candidate, with its best score; ties go to the smaller vec_id; with fewer candidates than k all are
returned; an empty table or one without queries gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, tuned

LIST, MOST_LISTS, SAMPLE, SAMPLE_BYTES = 512, 4096, 40_000, 64 << 20
REPLICAS, BOUNDARY = 3, 1.05
CALIBRATION, COVER = 64, 0.98
BLOCK, DEGREE, ROUNDS = 2048, 16, 8
HELD = 20_000  # queries whose best a task holds before passing them on


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    good = F.expr("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(good)
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["length"] if lengths else 0)).select("vec_id", F.col("embedding").alias("v"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of similar numbers of rows; the same for the same rows."""
    k = max(1, min(k, len(x)))
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(ROUNDS):
        near = np.empty(len(x), np.int64)
        half = (c**2).sum(1)
        for a in range(0, len(x), 4096):
            d = half - 2 * x[a : a + 4096] @ c.T
            scale = np.abs(d.min(1) + (x[a : a + 4096] ** 2).sum(1)).mean()
            near[a : a + 4096] = (d + 0.2 * scale * (size * k / len(x) - 1)).argmin(1)
        size = np.bincount(near, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class Graph:
    """Centroids with links to near and to random others; finds near centroids of many vectors by walking the links."""

    def __init__(self, centroids: np.ndarray):
        self.c, n = centroids, len(centroids)
        rng = np.random.default_rng(11)
        half = (centroids**2).sum(1)
        links = []
        for a in range(0, n, 1024):
            d = half - 2 * centroids[a : a + 1024] @ centroids.T
            links.append(np.argsort(d, axis=1, kind="stable")[:, : DEGREE + 1])
        near = np.concatenate(links)
        if near.shape[1] < DEGREE + 1:
            near = np.pad(near, ((0, 0), (0, DEGREE + 1 - near.shape[1])), mode="edge")
        chain = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)  # so that the graph is connected
        self.links = np.concatenate([near, chain, rng.integers(0, n, (n, 4))], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def walk(self, x: np.ndarray, least: int, ratio: float, floor: float = 0.0) -> np.ndarray:
        """(rows of x, centroids): distances, infinite where the walk did not come.

        It opens all centroids within ``ratio`` times the nearest so far or ``floor``, and the ``least`` nearest at least.
        """
        n, k = len(x), len(self.c)
        d = np.full((n, k), np.inf)
        opened = np.zeros((n, k), bool)
        half, own = (self.c**2).sum(1), (x**2).sum(1)
        near = np.maximum(0.0, own[:, None] + half[self.entries] - 2 * x @ self.c[self.entries].T)
        d[:, self.entries] = np.sqrt(near)
        active = np.arange(n)
        least = min(least, k)
        while len(active):
            da = d[active]
            bound = np.maximum(np.partition(da, least - 1, axis=1)[:, least - 1], ratio * np.maximum(da.min(1), floor))
            wait = np.where(opened[active] | ~np.isfinite(da), np.inf, da)
            best = np.argpartition(wait, min(3, k - 1), axis=1)[:, : min(4, k)]
            at = np.take_along_axis(wait, best, axis=1)
            use = np.isfinite(at) & (at <= bound[:, None])
            more = use.any(1)
            active, best, use = active[more], best[more], use[more]
            if not len(active):
                break
            r, j = np.nonzero(use)
            row, node = active[r], best[r, j]
            opened[row, node] = True
            to = self.links[node]
            rr, cc = np.repeat(row, to.shape[1]), to.ravel()
            new = ~np.isfinite(d[rr, cc])
            rr, cc = rr[new], cc[new]
            if len(rr):
                flat = np.unique(rr * k + cc)
                rr, cc = flat // k, flat % k
                d[rr, cc] = np.sqrt(np.maximum(0.0, own[rr] + half[cc] - 2 * np.einsum("ij,ij->i", x[rr], self.c[cc])))
        return d


def augmented(x: np.ndarray, top: float | None) -> np.ndarray:
    """With the coordinate that makes inner products distances; ``top`` is None for queries."""
    extra = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(0.0, top * top - (x**2).sum(1)))
    return np.concatenate([x, extra[:, None]], axis=1)


def lists_of(d: np.ndarray, most: int, ratio: float, floor: float = 1e-12, sizes: np.ndarray | None = None, rows: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each row's lists within ``ratio`` times its nearest or ``floor``, at most ``most``.

    With ``sizes``, further lists, nearest first, until those chosen hold ``rows`` rows.
    """
    order = np.argsort(d, axis=1, kind="stable")[:, :most]
    near = np.take_along_axis(d, order, axis=1)
    use = near <= ratio * np.maximum(near[:, :1], floor)
    if sizes is not None:
        held = sizes[order]
        use |= (np.cumsum(held, axis=1) - held < rows) & np.isfinite(near)
    row, j = np.nonzero(use)
    return row, order[row, j]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Best:
    """The best k of each query so far, exact in double precision."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray) -> None:
        if len(rough) > 2 * self.k:  # what the rounding of a matrix product may hide stays in
            at = np.flatnonzero(rough >= np.partition(rough, len(rough) - self.k)[len(rough) - self.k] - 1e-9 * (1 + np.abs(rough).max()))
            ids, vectors = ids[at], vectors[at]
        scores = (vectors * q).sum(axis=1)
        if query in self.of:
            i, s = self.of[query]
            ids, scores = np.concatenate([i, ids]), np.concatenate([s, scores])
            order = np.lexsort((-scores, ids))
            ids, scores = ids[order], scores[order]
            keep = np.ones(len(ids), bool)
            keep[1:] = ids[1:] != ids[:-1]
            ids, scores = ids[keep], scores[keep]
        at = best(scores, ids, self.k)
        self.of[query] = ids[at], scores[at]

    def told(self):
        if self.of:
            n = [len(x[0]) for x in self.of.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(self.of), np.int64), n)), pa.array(np.concatenate([x[0] for x in self.of.values()])), pa.array(np.concatenate([x[1] for x in self.of.values()]))], names=["rep", "vec_id", "score"])
            self.of.clear()


def _merged(found: DataFrame, k: int) -> DataFrame:
    """rep, vec_id, score, rank of the best k of each query over all tasks."""
    found = found.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """rep, vec_id, score, rank over all rows, for a bounded list of queries."""
    sent = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        held, q = Best(k), np.array([x for _, x in sent.value])
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column("v"), batch.num_rows), batch.column("vec_id").to_numpy()
                for (i, _), row, rough in zip(sent.value, q, q @ x.T, strict=True):
                    held.add(i, row, ids, x, rough)
        yield from held.told()

    return _merged(vectors.mapInArrow(run, "rep long, vec_id long, score double"), k)


def search(rows: DataFrame, is_query: Column, k: int = 20, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of (vec_id, embedding) where ``is_query`` holds, its k nearest among the others."""
    spark = tuned(rows.sparkSession)
    scratch, context = Scratch(spark), spark.sparkContext
    vectors = scratch.save(valid(rows), "vectors")
    queries = scratch.save(vectors.where(is_query).dropDuplicates(["vec_id", "v"]), "queries")
    n, top = vectors.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).first()
    if not n or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reps = scratch.save(queries.groupBy("v").agg(F.min("vec_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "reps")

    # centroids
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * vectors.select(F.size("v")).first()[0])))
    limit = int(min(1.0, most / n) * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= limit).orderBy("vec_id").limit(2 * most).select("v").toArrow()
    sample = augmented(matrix(sample.column("v").combine_chunks(), sample.num_rows), top) if sample.num_rows else np.zeros((1, 1))
    k_lists = max(1, min(MOST_LISTS, math.ceil(n / LIST)))
    graph = context.broadcast(Graph(balanced_centroids(sample, k_lists)))

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                x = augmented(matrix(batch.column("v"), batch.num_rows), top)
                row, at = lists_of(graph.value.walk(x, 8, BOUNDARY), REPLICAS, BOUNDARY)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["list", "vec_id", "v"])

    lists = scratch.save(vectors.mapInArrow(placed, "list int, vec_id long, v array<double>"), "lists")

    # how far a query must look
    chosen = reps.orderBy(F.xxhash64("first"), "first", "rep").limit(CALIBRATION).collect()
    tried, own = [(r["rep"], list(r["v"])) for r in chosen], {r["rep"]: r["first"] for r in chosen}
    true = brute_force(vectors, tried, k + 1).select("rep", "vec_id")
    true = true.join(lists.select("vec_id", "list"), "vec_id").groupBy("rep", "vec_id").agg(F.collect_set("list").alias("lists")).collect()
    far = dict(zip([i for i, _ in tried], _all_distances(graph.value, augmented(np.array([v for _, v in tried]), None)), strict=True))
    floor = float(np.median([x.min() for x in far.values()]))
    needed = [far[r["rep"]][r["lists"]].min() / max(far[r["rep"]].min(), floor, 1e-12) for r in true if r["vec_id"] != own[r["rep"]]]
    ratio = float(np.quantile(needed, cover, method="higher")) * (1 + 1e-9) if needed else 1.0

    sizes = np.zeros(len(graph.value.c), np.int64)
    for r in lists.groupBy("list").count().collect():  # at most MOST_LISTS numbers
        sizes[r["list"]] = r["count"]
    blocks = {i: -(-int(x) // BLOCK) for i, x in enumerate(sizes)}
    rows_for = (REPLICAS + 1) * (k + 1)
    cut = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() if kv[1] > 1 for x in kv]), F.col("list")), F.lit(1)) if any(x > 1 for x in blocks.values()) else F.lit(1)

    def routed(batches):
        for batch in batches:
            if batch.num_rows:
                x = augmented(matrix(batch.column("v"), batch.num_rows), None)
                d = graph.value.walk(x, 32, ratio, floor)
                if len(few := np.flatnonzero(np.isfinite(d) @ sizes < rows_for)):
                    d[few] = _all_distances(graph.value, x[few])
                row, at = lists_of(d, d.shape[1], ratio, floor, sizes, rows_for)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("rep").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["list", "id", "v"])

    routes = reps.select("rep", "v").mapInArrow(routed, "list int, id long, v array<double>").withColumn("block", F.explode(F.sequence(F.lit(0), cut - 1)))
    members = lists.select("list", F.col("vec_id").alias("id"), "v").withColumn("block", F.pmod(F.xxhash64("id"), cut).cast("int"))
    both = members.withColumn("kind", F.lit(0)).unionByName(routes.withColumn("kind", F.lit(1)))

    def scan(batches):
        held, cell, ids, parts, x = Best(k + 1), None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, b_ids = matrix(batch.column("v"), batch.num_rows), batch.column("id").to_numpy()
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("list", "block", "kind")], axis=1)
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for a, b in zip(edges, np.append(edges[1:], len(key)), strict=True):
                if cell != (here := tuple(key[a, :2])):
                    cell, ids, parts, x = here, [], [], None
                if not key[a, 2]:
                    ids.append(b_ids[a:b])
                    parts.append(v[a:b])
                    continue
                if x is None and parts:
                    x, own = np.concatenate(parts), np.concatenate(ids)
                if x is not None:
                    for i, q, rough in zip(b_ids[a:b].tolist(), v[a:b], v[a:b] @ x.T, strict=True):
                        held.add(i, q, own, x, rough)
            if len(held.of) > HELD:
                yield from held.told()
        yield from held.told()

    scanned = both.repartition("list", "block").sortWithinPartitions("list", "block", "kind").select("list", "block", "kind", "id", "v").mapInArrow(scan, "rep long, vec_id long, score double")
    found = scratch.save(_merged(scanned, k + 1), "found")
    every = queries.join(reps, "v").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    out = every.join(found, "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_distances(graph: Graph, x: np.ndarray) -> np.ndarray:
    c = graph.c
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T))


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true neighbours (query_id, vec_id) that were found."""
    n = true.count()
    return true.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
