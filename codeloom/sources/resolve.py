"""Module resolution as joins: every name makes candidates in order of priority, and the first that is a file wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import release, stable


def collapsed(path: Column) -> Column:
    """A path without empty, . and .. segments."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "") | (x == "."), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def candidates(base: Column) -> Column:
    """The files that a path may mean, best first.

    An exact component file, the path itself, with each code extension, an index file in it, a component file; then the same
    without an emitted extension.
    """

    def ladder(x: Column) -> list[Column]:
        return [x, *[F.concat(x, F.lit(f".{e}")) for e in S.CODE_EXTENSIONS], *[F.concat(x, F.lit(f"/index.{e}")) for e in S.CODE_EXTENSIONS], F.concat(x, F.lit(f".{S.SFC_EXTENSION}"))]

    bare = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    return F.concat(F.array(*ladder(base)), F.when(bare != base, F.array(*ladder(bare))).otherwise(F.array().cast("array<string>")))


def _first_file(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """site, target of rows (site, base, rung): the candidate file of the lowest rung, then of the best place."""
    tried = rows.select("site", "rung", F.posexplode(candidates(F.col("base"))).alias("at", "path"))
    return tried.join(paths.select("path").distinct(), "path").groupBy("site").agg(F.min_by("path", F.struct("rung", "at")).alias("target"))


def resolve(sites: DataFrame, paths: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``sites`` (path, spec, ..) with target: the file that each name means, or null.

    Relative names start at the importer's folder. Others are tried as workspace packages, then by the rules of the nearest configured
    folder above the importer: exact names, longer prefixes, targets in order.
    """
    keys = sites.select("path", "spec").distinct().withColumn("site", F.struct("path", "spec"))
    relative = keys.where(F.col("spec").startswith(".")).select("site", F.lit(0).alias("rung"), collapsed(F.concat_ws("/", folder_of(F.col("path")), "spec")).alias("base"))
    rows = relative
    if rules is not None:
        bare = keys.where(~F.col("spec").startswith("."))
        fill = F.expr("substring(spec, length(prefix) + 1, length(spec) - length(prefix) - length(suffix))")
        fits = (F.col("exact") & (F.col("spec") == F.col("prefix"))) | (~F.col("exact") & F.col("spec").startswith(F.col("prefix")) & F.col("spec").endswith(F.col("suffix")) & (F.length("spec") >= F.length("prefix") + F.length("suffix") + F.col("package").cast("int")))
        filled = F.when(F.col("exact"), F.col("target")).otherwise(F.replace("target", F.lit("*"), fill))
        # a rule is found by the part of a name before its first slash or by its first character
        named = rules.where("package").withColumn("head", _package_head(F.col("prefix")))
        packages = bare.withColumn("head", _package_head(F.col("spec"))).join(named, "head").where(fits)
        packages = packages.select("site", F.col("priority").alias("rung"), filled.alias("base"))
        own = rules.where("not package")
        above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/")))
        nearest = bare.select("site", "spec", F.explode(above).alias("dir")).join(own.select("dir").distinct(), "dir").groupBy("site", "spec").agg(F.max_by("dir", F.length("dir")).alias("dir"))
        aliases = nearest.join(own, "dir").where(fits).select("site", (F.col("priority") + 10_000_000).alias("rung"), filled.alias("base"))
        rows = rows.union(packages).union(aliases)
    found = _first_file(rows.withColumn("base", collapsed(F.col("base"))), paths).select("site.path", "site.spec", "target")
    return sites.join(found, ["path", "spec"], "left")


def _package_head(name: Column) -> Column:
    """A package's own name: up to the first slash, or the second with a scope."""
    return F.regexp_extract(name, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def expected_local(spec: Column) -> Column:
    """Names that should mean a file of this repository."""
    return spec.startswith(".") | spec.rlike(r"^(@/|~/|~|#)")


def origins(exports: DataFrame, forwards: DataFrame) -> DataFrame:
    """path, name, origin, origin_name, hops: the file that declares what a file forwards, over any number of hops.

    A file's name is reached once, so circles end; a level is written once, and folded into one table every eighth time.
    ``exports``: (path, name) declared; ``forwards``: (path, name, target, target_name), "*" for all but default.
    """
    new = stable(exports.select("path", "name", F.col("path").alias("origin"), F.col("name").alias("origin_name"), F.lit(0).alias("hops")).distinct())
    levels, hops = [new], 0
    named = forwards.where("name <> '*'")
    star = forwards.where("name = '*'")
    while True:
        hops += 1
        through = new.select(F.col("path").alias("target"), F.col("name").alias("target_name"), "origin", "origin_name")
        one = named.join(through, ["target", "target_name"]).select("path", "name", "origin", "origin_name")
        many = star.select("path", "target").join(through.where("target_name <> 'default'"), "target").select("path", F.col("target_name").alias("name"), "origin", "origin_name")
        step = one.union(many).groupBy("path", "name").agg(F.min(F.struct("origin", "origin_name")).alias("o")).select("path", "name", "o.*", F.lit(hops).alias("hops"))
        for level in levels:
            step = step.join(level, ["path", "name"], "left_anti")
        new = stable(step)
        if new.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        levels.append(new)
        if len(levels) > 8:
            whole = stable(reduce(DataFrame.unionAll, levels))
            release(*levels[:-1])
            levels = [whole]
