"""Finding symbols, owners and files by name; features; the language census; the map's health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import basename, declaration_site
from ..session import stable


def _origin(symbols: DataFrame) -> DataFrame:
    """With defined_in, external and is_export, where the table lacks them."""
    for name, value in (("defined_in", F.lit(None).cast("string")), ("external", F.lit(None).cast("boolean")), ("is_export", F.lit(True)), ("is_reexport", F.lit(False))):
        if name not in symbols.columns:
            symbols = symbols.withColumn(name, value)
    return symbols


def find_symbol(symbols: DataFrame, ranks: DataFrame, query: str, kind: str | None = None, include_locals: bool = True, limit: int = S.SYMBOL_MATCHES) -> DataFrame:
    """path, name, kind, pos, total, truncated of symbols whose name holds ``query``: declarations first, then by rank of the file."""
    rows = _origin(symbols).where(F.lower("name").contains(query.lower()))
    if kind:
        rows = rows.where(F.lower("kind").contains(kind.lower()))
    if not include_locals:
        rows = rows.where("is_export")
    total = rows.count()
    order = [F.desc(declaration_site(F.col("defined_in"), F.col("external"))), F.desc(F.coalesce("rank", F.lit(0.0))), F.col("path"), F.col("name")]
    top = rows.join(ranks.select("path", "rank"), "path", "left").orderBy(*order).limit(limit)
    return top.select("path", "name", "kind", F.row_number().over(W.orderBy(*order)).alias("pos"), F.lit(total).cast("long").alias("total"), F.lit(total > limit).alias("truncated"))


def owners(symbols: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """path, kind, local of the files that declare ``name`` exactly; exports hide locals, and forwarding files own nothing."""
    rows = _origin(symbols).where(F.col("name") == name)
    if within:
        rows = rows.where(F.col("path").contains(within))
    own = rows.where(F.col("is_export") & ~F.coalesce("is_reexport", F.lit(False)) & declaration_site(F.col("defined_in"), F.col("external"))).withColumn("local", F.lit(False))
    rest = rows.where(~F.col("is_export")).withColumn("local", F.lit(True))
    every = own.unionByName(rest)
    first = F.min(F.col("local").cast("int")).over(W.partitionBy("name"))
    return every.withColumn("first", first).where(F.col("local").cast("int") == F.col("first")).select("path", "kind", "local").distinct()


def grams(text: Column, n: int) -> Column:
    """All runs of n characters, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def _holding(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """query, path of the paths that hold a query in either case.

    Each query is looked up by its rarest run of three characters (or by all of it, if it is shorter) among the runs of the paths.
    """
    low = paths.select("path", F.lower("path").alias("low"))
    asked = queries.select("query", F.lower("query").alias("q")).where("query <> ''")
    size = F.least(F.length("q"), F.lit(3))
    asked = asked.select("query", "q", F.explode(F.when(size == 3, grams(F.col("q"), 3)).otherwise(F.array("q"))).alias("gram"))
    wanted = asked.select("gram", F.length("gram").alias("n")).distinct()
    sizes = [r["n"] for r in wanted.select("n").distinct().collect()]  # of 1, 2 and 3
    every = paths.select(F.lit("").alias("query"), "path").join(queries, "query", "left_semi")  # the empty text is in all paths
    if not sizes:
        return every
    held = reduce(DataFrame.unionAll, [low.select("path", "low", F.explode(grams(F.col("low"), n)).alias("gram")) for n in sizes])
    held = stable(held.join(wanted, "gram", "left_semi"))
    rare = asked.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("query", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rare.join(held, "gram").where(F.col("low").contains(F.col("q"))).select("query", "path").unionAll(every)


def resolve_file(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """query, path, candidates: for each ``query`` its file. Exact path, else the only file of that name, else the only path that holds it.

    ``path`` is null where none or several fit; ``candidates`` counts the files of the deciding rung. Paths are searched for what the
    first two rungs leave open only.
    """
    q, p = queries.select("query").distinct(), paths.select("path").distinct()
    exact = q.join(p, F.col("query") == F.col("path")).select("query", "path", F.lit(1).alias("rung"))
    named = q.join(p.withColumn("base", F.lower(basename(F.col("path")))), F.lower("query") == F.col("base")).select("query", "path", F.lit(2).alias("rung"))
    first = stable(exact.union(named).groupBy("query", "rung").agg(F.count("*").alias("n"), F.min("path").alias("path")))
    open_ = q.join(first.where("n = 1"), "query", "left_anti")
    held = _holding(open_, p).withColumn("rung", F.lit(3))
    rungs = first.unionByName(held.groupBy("query", "rung").agg(F.count("*").alias("n"), F.min("path").alias("path")))
    # the first rung with exactly one file decides; without one, the last rung with any
    best = rungs.groupBy("query").agg(F.min_by(F.struct("path", "n"), F.struct(F.col("n") != 1, F.when(F.col("n") == 1, F.col("rung")).otherwise(-F.col("rung")))).alias("b"))
    out = q.join(best, "query", "left")
    return out.select("query", F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"), F.coalesce("b.n", F.lit(0)).cast("long").alias("candidates"))


def suffix_matches(paths: DataFrame, query: str) -> DataFrame:
    """(path): exact, or ending in /query."""
    return paths.where((F.col("path") == query) | F.col("path").endswith("/" + query)).select("path").distinct()


def features(files: DataFrame) -> DataFrame:
    """feature, n_files, largest first."""
    return files.where("feature is not null").groupBy("feature").agg(F.countDistinct("path").alias("n_files")).orderBy(F.desc("n_files"), "feature")


def match_feature(files: DataFrame, query: str) -> DataFrame:
    """(feature): the exact name in either case, else the first that holds it."""
    names = files.where("feature is not null").select("feature").distinct().where(F.lower("feature").contains(query.lower()))
    return names.orderBy(F.lower("feature") != query.lower(), "feature").limit(1)


def feature_dependents(files: DataFrame, edges: DataFrame, feature: str) -> DataFrame:
    """(path): files outside a feature that import one of its files."""
    own = files.where(F.col("feature") == feature).select("path").distinct()
    used = edges.join(own.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path")).distinct()
    return used.join(own, "path", "left_anti")


def census(groups: DataFrame, key: str, supported: Column, share: float = S.CENSUS_SHARE) -> DataFrame:
    """top, n, supported, total, share: the largest unsupported group, if it has at least ``share`` of all rows."""
    rows = groups.select(F.col(key).alias("top"), supported.alias("ok"))
    counts = rows.groupBy("top", "ok").agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("supported"), F.min_by("top", F.struct((-F.col("n")).alias("n"), "top")).alias("_"))
    top = counts.where(~F.col("ok")).orderBy(F.desc("n"), "top").limit(1)
    out = top.join(all_.drop("_").withColumn("one", F.lit(1)), F.col("one") == F.lit(1))
    return out.select("top", "n", "supported", "total", F.round(F.col("n") / F.col("total"), 6).alias("share")).where(F.col("share") >= share)


def health(n_files: int, sites: DataFrame) -> DataFrame:
    """local_sites, resolved_sites, edge_coverage (4 places), degraded of import sites (expected_local, resolved)."""
    rows = sites.agg(F.coalesce(F.sum(F.col("expected_local").cast("long")), F.lit(0)).alias("local_sites"), F.coalesce(F.sum((F.col("expected_local") & F.col("resolved")).cast("long")), F.lit(0)).alias("resolved_sites"))
    cover = F.when(F.col("local_sites") > 0, F.round(F.col("resolved_sites") / F.col("local_sites"), 4)).otherwise(F.lit(1.0))
    rows = rows.withColumn("edge_coverage", cover)
    return rows.withColumn("degraded", F.lit(n_files > S.DEGRADED_FILES) & (F.col("edge_coverage") < S.DEGRADED_COVERAGE))


def skips(ledger: DataFrame) -> DataFrame:
    """reason, n of files that could not be read."""
    return ledger.where("error is not null").groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))


def doctor(meta: DataFrame) -> DataFrame:
    """status: incomplete, empty, degraded, stale or ok, in this order, of one meta row."""
    status = F.when(F.col("skipped_count") > 0, "incomplete").when(F.col("file_count") == 0, "empty").when(F.col("degraded"), "degraded").when(F.col("source_version") != F.col("current_version"), "stale").otherwise("ok")
    return meta.select("file_count", "skipped_count", "edge_coverage", status.alias("status"))
