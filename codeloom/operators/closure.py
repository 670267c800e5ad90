"""Closures: what a change reaches, and who calls what within a number of hops.

Each level is one join of the frontier with the edges less what is already reached, written before the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import is_test_file
from ..session import release, stepped

#: Levels of a closure that are read apart before they become one table.
FOLD = 8


def transitive_dependents(edges: DataFrame, start: DataFrame, type_edges: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """path, hop of all that reach ``start`` (path), which is left out; hop is the first level.

    A level is written once and never again: what is reached is the union of all levels, folded into one table every ``FOLD`` levels.
    """
    back = edges.select("src", "dst")
    if type_edges is not None:
        back = back.union(type_edges.select("src", "dst"))
    back = stepped(back.where("src <> dst").distinct(), "dst")
    frontier = stepped(start.select("path", F.lit(0).alias("hop")).distinct())
    levels, hop = [frontier], 0
    while max_hops is None or hop < max_hops:
        hop += 1
        new = back.join(frontier.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path")).distinct()
        for level in levels:
            new = new.join(level, "path", "left_anti")
        frontier = stepped(new.withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > FOLD:
            whole = stepped(reduce(DataFrame.unionAll, levels))
            release(*levels[:-1])
            levels = [whole]
    release(back)
    return reduce(DataFrame.unionAll, levels).where("hop > 0")


def affected(edges: DataFrame, start: DataFrame, type_edges: DataFrame | None = None, is_test=is_test_file) -> DataFrame:
    """path, hop, is_test of all that a change of ``start`` may break."""
    return transitive_dependents(edges, start, type_edges).withColumn("is_test", is_test(F.col("path")))


def coverage(edges: DataFrame, start: DataFrame, type_edges: DataFrame | None = None, is_test=is_test_file) -> DataFrame:
    """file, dependents, tests, covered of one file: covered if a test reaches it, or if it is a test itself."""
    reach = affected(edges, start, type_edges, is_test).agg(F.count("*").alias("dependents"), F.coalesce(F.sum(F.col("is_test").cast("long")), F.lit(0)).alias("tests"))
    one = start.select(F.col("path").alias("file"), F.lit(1).alias("one")).join(reach.withColumn("one", F.lit(1)), "one")
    return one.select("file", "dependents", "tests", ((F.col("tests") > 0) | is_test(F.col("file"))).alias("covered"))


def clamp_depth(depth: int) -> int:
    return max(1, min(S.MAX_DEPTH, depth))


def callers(calls: DataFrame, file: str, name: str) -> DataFrame:
    """The different call sites of one symbol: caller_file, caller_name, caller_decl_line, caller_line."""
    rows = calls.where((F.col("callee_file") == file) & (F.col("callee_name") == name))
    return rows.groupBy("caller_file", "caller_line").agg(F.min("caller_name").alias("caller_name"), F.min("caller_decl_line").alias("caller_decl_line")).select("caller_file", "caller_name", "caller_decl_line", "caller_line")


def callees(calls: DataFrame, file: str, name: str) -> DataFrame:
    """The different symbols that one calls, itself left out: callee_file, callee_name, callee_line, callee_kind."""
    rows = calls.where((F.col("caller_file") == file) & (F.col("caller_name") == name))
    rows = rows.where(~((F.col("callee_file") == file) & (F.col("callee_name") == name)))
    return rows.groupBy("callee_file", "callee_name", "callee_line").agg(F.min("callee_kind").alias("callee_kind"))


def ranked_sites(rows: DataFrame, ranks: DataFrame, file: str, order: list[str], limit: int = S.SYMBOL_MATCHES) -> DataFrame:
    """The first ``limit`` by the rank of ``file``'s file, with total."""
    total = rows.count()
    rows = rows.join(ranks.select(F.col("path").alias(file), "rank"), file, "left").orderBy(F.desc(F.coalesce("rank", F.lit(0.0))), *order).limit(limit)
    return rows.drop("rank").withColumn("total", F.lit(total).cast("long"))


def call_closure(calls: DataFrame, file: str, name: str, depth: int, ranks: DataFrame | None = None, direction: str = "callers", frontier_cap: int | None = S.FRONTIER, node_cap: int | None = S.MAX_NODES) -> DataFrame:
    """file, name, line, depth, via, truncated of the call sites (or called symbols) within ``depth`` hops.

    Sites count once, symbols are followed once, top-level code is not followed; ``via`` is the parent as file:name:line, null at the
    first hop. A level follows at most ``frontier_cap`` symbols, best files first, and no level begins once ``node_cap`` rows are found;
    ``truncated`` tells that either may have left rows out. A cap of None is none: every symbol is followed, every row returned.
    """
    depth = clamp_depth(depth)
    if direction == "callers":
        rows = calls.select(F.col("callee_file").alias("to_file"), F.col("callee_name").alias("to_name"), F.col("caller_file").alias("file"), F.col("caller_name").alias("name"), F.col("caller_line").alias("line"), F.col("caller_decl_line").alias("own_line"))
        site = ["file", "line"]
    else:
        rows = calls.select(F.col("caller_file").alias("to_file"), F.col("caller_name").alias("to_name"), F.col("callee_file").alias("file"), F.col("callee_name").alias("name"), F.col("callee_line").alias("line"), F.col("callee_line").alias("own_line"))
        site = ["file", "name", "line"]
    spark = calls.sparkSession
    rows = stepped(rows.distinct(), "to_file", "to_name")
    frontier = spark.createDataFrame([(file, name, None)], "to_file string, to_name string, via string")
    followed = spark.createDataFrame([(file, name)], "file string, name string")
    out, total, cut = None, 0, False
    ranks = stepped(ranks.select(F.col("path").alias("file"), "rank")) if ranks is not None else None
    for hop in range(1, depth + 1):
        new = rows.join(frontier, ["to_file", "to_name"]).where(~((F.col("file") == file) & (F.col("name") == name))) if direction != "callers" else rows.join(frontier, ["to_file", "to_name"])
        new = new.groupBy(*site).agg(F.min(F.struct("name", "own_line", "via")).alias("m")).select(*site, *[F.col(f"m.{c}").alias(c) for c in ("name", "own_line", "via") if c not in site])
        if out is not None:
            new = new.join(out, site, "left_anti")
        new = stepped(new.select("file", "name", "line", "own_line", "via", F.lit(hop).alias("depth")))
        n = new.count()
        if not n:
            break
        out, total = new if out is None else stepped(out.unionByName(new)), total + n
        if node_cap is not None and total >= node_cap:
            cut = True
            break
        if hop == depth:
            break
        step = new.where("name <> '<module>'").groupBy("file", "name").agg(F.min("own_line").alias("own_line")).join(followed, ["file", "name"], "left_anti")
        if frontier_cap is None:
            step = stepped(step)
        else:
            step = step.join(ranks, "file", "left") if ranks is not None else step.withColumn("rank", F.lit(0.0))
            step = stepped(step.orderBy(F.desc(F.coalesce("rank", F.lit(0.0))), "file", "name").limit(frontier_cap + 1))
            if step.count() > frontier_cap:
                cut, step = True, step.orderBy(F.desc(F.coalesce("rank", F.lit(0.0))), "file", "name").limit(frontier_cap)
        followed = stepped(followed.union(step.select("file", "name")))
        frontier = step.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.concat_ws(":", "file", "name", "own_line").alias("via"))
    release(rows)
    if out is None:
        return spark.createDataFrame([], "file string, name string, line int, depth int, via string, truncated boolean")
    out = out.join(ranks, "file", "left") if ranks is not None else out.withColumn("rank", F.lit(0.0))
    top = out.orderBy("depth", F.desc(F.coalesce("rank", F.lit(0.0))), "file", "line", "name")
    top = top if node_cap is None else top.limit(node_cap)
    return top.select("file", "name", F.col("line").cast("int").alias("line"), "depth", "via", F.lit(cut).alias("truncated"))
