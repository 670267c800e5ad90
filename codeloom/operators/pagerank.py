"""Weighted personalized PageRank over an edge table.

Rank flows src -> dst in proportion to weight. Self-loops and edges to unknown nodes are dropped, a weight that isn't positive counts as 1, and the
rank of nodes without out-edges goes back to the teleport vector. It stops after the step whose total change is below ``tol``.

Large graphs take one join, one aggregation and one written step per iteration, with the dangling mass and the change found by
the same aggregate. A graph of at most ``KERNEL_EDGES`` edges and nodes takes the same arithmetic in one task on arrays: its
size is counted first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import placed, release, stable

KERNEL_EDGES = 1_000_000
#: Ranks that differ by less than this many places are ties: sums in another order must not change an order of results.
PLACES = 12


def summed(edges: DataFrame) -> DataFrame:
    """src, dst, weight: duplicates added up, a weight that isn't positive counting as 1. Self-loops stay, as they make nodes known."""
    return edges.select("src", "dst", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0).alias("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def transitions(sums: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of ``summed`` that count: no self-loops, and both ends among ``nodes``."""
    rows = sums.where(F.col("src") != F.col("dst"))
    return rows.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def teleport(nodes: DataFrame, n: int, personalization: DataFrame | None) -> DataFrame:
    """(node, p): the normalized personalization, or 1 / n each where it has no positive value on a known node."""
    if personalization is None:
        return nodes.select("node", F.lit(1.0 / n if n else 0.0).alias("p"))
    given = personalization.where(F.col("value") > 0).groupBy("node").agg(F.sum("value").alias("value"))
    rows = stable(nodes.join(given, "node", "left"))
    total = rows.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
    return rows.select("node", (F.coalesce("value", F.lit(0.0)) / total if total else F.lit(1.0 / n if n else 0.0)).alias("p"))


def _kernel(rows: DataFrame, damping: float, tol: float, max_iter: int) -> DataFrame:
    """All rows in one task: (src, null, p) for nodes and (src, dst, weight) for edges, of which those with an unknown end don't count."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        src, dst, w = (table.column(c).combine_chunks() for c in ("src", "dst", "w"))
        edge = np.asarray(dst.is_valid())
        w, kept = w.to_numpy(), dst.is_valid()
        node = src.filter(pc.invert(kept))
        order = pc.sort_indices(node)
        node, p = node.take(order), w[~edge][order.to_numpy()]
        a, b = (pc.index_in(x.filter(kept), value_set=node).fill_null(-1).to_numpy() for x in (src, dst))
        order = np.lexsort((b, a))
        order = order[(a[order] >= 0) & (b[order] >= 0)]
        a, b, w = a[order], b[order], w[edge][order]
        n = len(node)
        out = np.bincount(a, w, n)
        share, r = w / out[a], p.copy()
        for _ in range(max_iter):
            new = (1 - damping) * p + damping * r[out == 0].sum() * p + damping * np.bincount(b, r[a] * share, n)
            change, r = np.abs(new - r).sum(), new
            if change < tol:
                break
        yield pa.RecordBatch.from_arrays([node, pa.array(r)], names=["node", "rank"])

    return rows.coalesce(1).mapInArrow(run, "node string, rank double")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, personalization: DataFrame | None = None, damping: float = S.DAMPING, tol: float = S.TOLERANCE, max_iter: int = S.MAX_ITERATIONS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(node, rank) for each of ``nodes`` (node), by default all ends of ``edges`` (src, dst, weight).

    ``personalization`` is (node, value).
    """
    return _ranked(stable(summed(edges)), nodes, personalization, damping, tol, max_iter, kernel_edges)


def _ranked(sums: DataFrame, nodes: DataFrame | None = None, personalization: DataFrame | None = None, damping: float = S.DAMPING, tol: float = S.TOLERANCE, max_iter: int = S.MAX_ITERATIONS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``pagerank`` of a written table of ``summed`` edges."""
    given = nodes is not None
    nodes = stable(nodes.select("node").distinct() if given else sums.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    moves = sums.where(F.col("src") != F.col("dst"))
    n, n_moves = nodes.count(), moves.count()
    base = teleport(nodes, n, personalization)
    if max(n, n_moves) <= kernel_edges:
        rows = base.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("p").alias("w")).unionAll(moves.select("src", "dst", F.col("weight").alias("w")))
        return _kernel(rows, damping, tol, max_iter)
    moves = stable(transitions(sums, nodes)) if given else moves
    out = moves.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = placed(moves.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "src")

    def flow(rank: DataFrame) -> DataFrame:
        return rank.select(F.col("node").alias("src"), "r").join(moves, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("share")).alias("s"))

    rank = iterated(base, out.select("src"), flow, damping, tol, max_iter)
    release(moves)
    return rank


def iterated(base: DataFrame, sources: DataFrame, flow: Callable[[DataFrame], DataFrame], damping: float = S.DAMPING, tol: float = S.TOLERANCE, max_iter: int = S.MAX_ITERATIONS) -> DataFrame:
    """(node, rank) from ``base`` (node, p); ``sources`` (src) are the nodes with out-edges, and ``flow`` gives (node, s) that ranks (node, r) pass on."""
    base = base.join(sources.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left")
    base = stable(base.withColumn("dangling", F.coalesce("dangling", F.lit(True))))
    rank = base.select("node", "p", "dangling", F.col("p").alias("r"), F.lit(0.0).alias("before"))
    lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0))).first()[0]
    for step in range(max_iter):
        before = rank
        new = (1 - damping) * F.col("p") + F.lit(damping * lost) * F.col("p") + damping * F.coalesce("s", F.lit(0.0))
        rank = stable(rank.join(flow(rank), "node", "left").select("node", "p", "dangling", new.alias("r"), F.col("r").alias("before")))
        change, lost = rank.agg(F.sum(F.abs(F.col("r") - F.col("before"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0))).first()
        if step:
            release(before)
        if change is None or change < tol:
            break
    return rank.select("node", F.col("r").alias("rank"))


def hubs(edges: DataFrame, limit: int = S.HUBS, **options) -> DataFrame:
    """path, pagerank (6 places) and in_degree of the highest ranks."""
    sums = stable(summed(edges))
    degree = sums.where("src <> dst").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    top = _ranked(sums, **options).withColumnRenamed("node", "path").orderBy(F.desc(F.round("rank", PLACES)), "path").limit(limit)
    return top.join(degree, "path", "left").select("path", F.round("rank", 6).alias("pagerank"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    """path and the number of different others that point to it."""
    return edges.where("src <> dst").groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("in_degree"))


def related(edges: DataFrame, start: str, limit: int = S.RELATED) -> DataFrame:
    """path and score of the files nearest to ``start``: a walk with restart over edges in both directions, each of weight 1."""
    ends = edges.select("src", "dst").distinct()
    both = ends.union(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    seed = edges.sparkSession.createDataFrame([(start, 1.0)], "node string, value double")
    rank = pagerank(both, personalization=seed).where(F.col("node") != start)
    return rank.orderBy(F.desc(F.round("rank", PLACES)), "node").limit(limit).select(F.col("node").alias("path"), F.round("rank", 6).alias("score"))
