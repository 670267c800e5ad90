"""Edge tables: weights by names, dependents, compile-time edges, neighbourhoods and drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import tier


def named_edges(sites: DataFrame) -> DataFrame:
    """src, dst, names, weight of resolved sites (src, dst, name): the different names that cross, at least weight 1."""
    rows = sites.where("dst is not null").groupBy("src", "dst").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return rows.withColumn("weight", F.greatest(F.size("names"), F.lit(1)).cast("double"))


def dependents(edges: DataFrame) -> DataFrame:
    """path, dependents: who points to each file, sorted."""
    return edges.where("src <> dst").groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))


def type_only(type_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst that are erased at compile time and have no runtime twin."""
    return type_edges.select("src", "dst").distinct().join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def neighborhood(edges: DataFrame, focus: str) -> DataFrame:
    """(path): the file, what it imports and what imports it."""
    near = edges.where((F.col("src") == focus) | (F.col("dst") == focus))
    return near.select(F.explode(F.array("src", "dst")).alias("path")).distinct()


def drawn(edges: DataFrame, ranks: DataFrame, within: DataFrame | None = None, limit: int = S.EXPORT_NODES) -> tuple[DataFrame, DataFrame]:
    """(path, rank, tier) of the best files, and the edges (src, dst) between them."""
    pool = ranks if within is None else ranks.join(within, "path", "left_semi")
    nodes = pool.orderBy(F.desc("rank"), "path").limit(limit)
    top = ranks.agg(F.max("rank")).first()[0] or 0.0
    nodes = nodes.select("path", "rank", tier(F.col("rank"), F.lit(top)).alias("tier"))
    ends = edges.where("src <> dst").select("src", "dst").distinct()
    ends = ends.join(nodes.select(F.col("path").alias("src")), "src", "left_semi").join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi")
    return nodes, ends.select("src", "dst")


def dot(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(line_no, line) of a Graphviz drawing; at most ``EXPORT_NODES`` nodes."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    head = ends.sparkSession.createDataFrame([(0, "", "digraph map {"), (1, "", "  rankdir=LR;")], "part int, sort string, line string")
    tail = ends.sparkSession.createDataFrame([(9, "", "}")], "part int, sort string, line string")
    shape = F.concat(F.lit("  "), quoted(F.col("path")), F.lit(' [class="'), F.col("tier"), F.lit('"];'))
    arrow = F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(";"))
    rows = head.union(nodes.select(F.lit(2), F.col("path"), shape)).union(ends.select(F.lit(3), F.concat_ws("\x01", "src", "dst"), arrow)).union(tail)
    return rows.select(F.row_number().over(W.orderBy("part", "sort", "line")).alias("line_no"), "line")


def mermaid(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(line_no, line) of a Mermaid flowchart with nodes n0, n1, .. by rank; at most ``EXPORT_NODES`` nodes."""
    ids = nodes.withColumn("i", F.row_number().over(W.orderBy(F.desc("rank"), "path")) - 1)
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("path"), "&", "&amp;"), '"', "&quot;"), "<", "&lt;")
    shape = F.concat(F.lit("  n"), F.col("i"), F.lit('["'), label, F.lit('"]:::'), F.col("tier"))
    links = ends.join(ids.select(F.col("path").alias("src"), F.col("i").alias("a")), "src").join(ids.select(F.col("path").alias("dst"), F.col("i").alias("b")), "dst")
    head = ends.sparkSession.createDataFrame([(0, 0, 0, "flowchart LR")], "part int, x int, y int, line string")
    rows = head.union(ids.select(F.lit(1), "i", F.lit(0), shape)).union(links.select(F.lit(2), "a", "b", F.concat(F.lit("  n"), F.col("a"), F.lit(" --> n"), F.col("b"))))
    return rows.select(F.row_number().over(W.orderBy("part", "x", "y")).alias("line_no"), "line")


def precision_recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """precision, recall, f1 (6 places) of (query, path) pairs against the true ones, averaged over queries."""
    both = found.select("query", "path").distinct().withColumn("f", F.lit(1)).join(true.select("query", "path").distinct().withColumn("t", F.lit(1)), ["query", "path"], "full_outer")
    each = both.groupBy("query").agg(F.sum(F.coalesce("f", F.lit(0)) * F.coalesce("t", F.lit(0))).alias("hit"), F.sum(F.coalesce("f", F.lit(0))).alias("f"), F.sum(F.coalesce("t", F.lit(0))).alias("t"))
    p = F.when(F.col("f") > 0, F.col("hit") / F.col("f")).otherwise(F.when(F.col("t") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("t") > 0, F.col("hit") / F.col("t")).otherwise(1.0)
    each = each.select(p.alias("p"), r.alias("r"))
    out = each.agg(F.count("*").alias("queries"), F.avg("p").alias("p"), F.avg("r").alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select("queries", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def hit_rates(ranked: DataFrame, true: DataFrame, tops: tuple[int, ...] = (1, 3)) -> DataFrame:
    """queries, top1, top3 (6 places): the share of the queries of ``true`` (query, path) with a true path among the first of ``ranked`` (query, path, pos)."""
    asked = true.select("query").distinct()
    best = ranked.join(true.select("query", "path").distinct(), ["query", "path"], "left_semi").groupBy("query").agg(F.min("pos").alias("pos"))
    rows = asked.join(best, "query", "left")
    return rows.agg(F.count("*").alias("queries"), *[F.round(F.avg(F.coalesce((F.col("pos") <= k).cast("double"), F.lit(0.0))), 6).alias(f"top{k}") for k in tops])


def token_ratio(rows: DataFrame) -> DataFrame:
    """cases, median_ratio (6 places) of (baseline, answer) token counts; answers without tokens are left out."""
    return rows.where("answer > 0").agg(F.count("*").alias("cases"), F.round(F.median(F.col("baseline") / F.col("answer")), 6).alias("median_ratio"))
