"""Ranking of symbols over the graph of who refers to whose names, and the digest within a token budget.

The edges are the product of the files that refer to a name and of those that define it, so one common name makes a quadratic number of them.
They are counted first; beyond ``KERNEL_EDGES`` none is made: ranks flow from files to names and from names to files, less what a file
would pass to itself. Both forms give the same ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import ident_multiplier, stem
from ..session import placed, release, stable
from .pagerank import KERNEL_EDGES, PLACES, iterated, pagerank, teleport


def multipliers(exports: DataFrame, mentioned: DataFrame | None = None) -> DataFrame:
    """name, definers, multiplier of each exported name. ``mentioned``: (name)."""
    rows = exports.groupBy("name").agg(F.countDistinct("path").alias("definers"))
    if mentioned is None:
        return rows.withColumn("multiplier", ident_multiplier(F.col("name"), F.col("definers")))
    rows = rows.join(mentioned.select("name").distinct().withColumn("m", F.lit(True)), "name", "left")
    return rows.withColumn("multiplier", ident_multiplier(F.col("name"), F.col("definers"), F.coalesce("m", F.lit(False)))).drop("m")


def weighted_references(exports: DataFrame, references: DataFrame, mentioned: DataFrame | None = None, focus: list[str] = ()) -> DataFrame:
    """src, name, weight of each edge that ``src`` has to another file that defines the name it refers to."""
    refs = references.where(~F.col("name").isin("*", "default")).groupBy("path", "name").agg(F.sum("n").alias("n"))
    rows = refs.withColumnRenamed("path", "src").join(multipliers(exports, mentioned), "name")
    weight = F.col("multiplier") * F.sqrt(F.col("n").cast("double"))
    if focus:
        weight = weight * F.when(F.col("src").isin(*focus), S.FOCUS_BOOST).otherwise(1.0)
    return rows.select("src", "name", weight.alias("weight"))


def definers(exports: DataFrame) -> DataFrame:
    """dst, name: who defines what, each once."""
    return exports.where("path is not null").select(F.col("path").alias("dst"), "name").distinct()


def reference_edges(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """src, dst, name, weight: a file that refers to a name n times points to each other file that defines it."""
    return refs.join(defs, "name").where("src <> dst").select("src", "dst", "name", "weight")


def spread(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``refs`` with own (1 if src defines the name itself, else 0) and fan (its edges by this name), where there are any."""
    fan = defs.groupBy("name").agg(F.count("*").alias("fan"))
    own = defs.select(F.col("dst").alias("src"), "name", F.lit(1).alias("own"))
    rows = refs.join(fan, "name").join(own, ["src", "name"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return rows.withColumn("fan", F.col("fan") - F.col("own")).where("fan > 0")


def rank_through_names(refs: DataFrame, defs: DataFrame, nodes: DataFrame, personalization: DataFrame | None = None) -> DataFrame:
    """What ``pagerank`` gives for ``reference_edges`` on ``nodes``, in a time of references and definitions instead of their product.

    A step adds up what flows into each name, so a name that many files refer to is one row when it meets its definers.
    """
    nodes = stable(nodes.select("node").distinct())
    known = nodes.withColumnRenamed("node", "src")
    defs = stable(defs.join(known.withColumnRenamed("src", "dst"), "dst", "left_semi"))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    rows = stable(spread(refs.join(known, "src", "left_semi").select("src", "name", weight.alias("weight")), defs))
    total = rows.groupBy("src").agg(F.sum(F.col("weight") * F.col("fan")).alias("total"))
    moves = placed(rows.join(total, "src").select("src", "name", "own", (F.col("weight") / F.col("total")).alias("share")), "src")

    def flow(rank: DataFrame) -> DataFrame:
        sent = rank.select(F.col("node").alias("src"), "r").join(moves, "src").select("src", "name", "own", (F.col("r") * F.col("share")).alias("s"))
        given = defs.join(sent.groupBy("name").agg(F.sum("s").alias("s")), "name").select(F.col("dst").alias("node"), "s")
        back = sent.where("own = 1").select(F.col("src").alias("node"), (-F.col("s")).alias("s"))
        return given.unionAll(back).groupBy("node").agg(F.sum("s").alias("s"))

    rank = iterated(teleport(nodes, nodes.count(), personalization), total.select("src"), flow)
    release(moves)
    return rank


def mentions(exports: DataFrame, focus: list[str]) -> DataFrame:
    """(name): what the focus files export, and their own stems."""
    own = exports.where(F.col("path").isin(*focus)).select("name")
    stems = exports.sparkSession.createDataFrame([(x,) for x in focus], "path string").select(stem(F.col("path")).alias("name"))
    return own.union(stems).distinct()


def symbol_rank(exports: DataFrame, references: DataFrame, nodes: DataFrame | None = None, focus: list[str] = (), limit: int = S.RANKED_SYMBOLS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """path, name, kind, rank, pos of the ``limit`` best exports.

    ``exports``: (path, name, kind); ``references``: (path, name, n); ``nodes``: (node), by default all paths of both.
    Names that nobody refers to follow at a rank just below the lowest.
    """
    exports, references = stable(exports.select("path", "name", "kind")), stable(references.select("path", "name", "n"))
    if nodes is None:
        nodes = exports.select(F.col("path").alias("node")).union(references.select(F.col("path").alias("node"))).distinct()
    mentioned = mentions(exports, list(focus)) if focus else None
    defs = stable(definers(exports))
    ways = stable(spread(weighted_references(exports, references, mentioned, list(focus)), defs))
    n_edges = ways.agg(F.coalesce(F.sum("fan"), F.lit(0))).first()[0]
    seeds = None
    if focus:
        unit = 100.0 / nodes.count()
        parts = F.explode(F.array_union(F.split("node", "/"), F.array(stem(F.col("node")))))
        hit = nodes.select("node", parts.alias("name")).join(mentioned, "name", "left_semi").select("node").distinct().withColumn("value", F.lit(unit))
        seeds = hit.union(nodes.where(F.col("node").isin(*focus)).withColumn("value", F.lit(unit)))
    refs = ways.select("src", "name", "weight")
    rank = pagerank(reference_edges(refs, defs), nodes, seeds) if n_edges <= kernel_edges else rank_through_names(refs, defs, nodes, seeds)
    total = ways.groupBy("src").agg(F.sum(F.col("weight") * F.col("fan")).alias("total"))
    sent = ways.join(rank.withColumnRenamed("node", "src").withColumnRenamed("rank", "r"), "src").join(total, "src")
    sent = stable(sent.select("src", "name", "own", (F.col("r") * F.col("weight") / F.col("total")).alias("s")))
    into = sent.groupBy("name").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    back = sent.where("own = 1").select(F.col("src").alias("dst"), "name", F.col("s").alias("back"), F.lit(1).alias("own"))
    scored = defs.join(into, "name").join(back, ["dst", "name"], "left").where(F.col("n") > F.coalesce("own", F.lit(0)))
    scored = scored.select(F.col("dst").alias("path"), "name", (F.col("s") - F.coalesce("back", F.lit(0.0))).alias("share"))
    kinds = exports.groupBy("path", "name").agg(F.min("kind").alias("kind"))
    every = kinds.join(scored, ["path", "name"], "left")
    if focus:
        every = every.where(~F.col("path").isin(*focus))
    every = stable(every)
    least = every.agg(F.min(F.round("share", 6))).first()[0] or 0.0
    floor = round(least - 1e-6 if least - 1e-6 > 0 else 1e-6, 6)
    order = [F.col("share").isNull(), F.desc(F.round("share", PLACES)), F.when(F.col("share").isNotNull(), F.concat_ws("|", "path", "name")), F.col("path"), F.col("name")]
    top = every.orderBy(*order).limit(limit)
    return top.select("path", "name", "kind", F.coalesce(F.round("share", 6), F.lit(floor)).alias("rank"), F.row_number().over(W.orderBy(*order)).alias("pos"))


def unreferenced(exports: DataFrame, references: DataFrame) -> DataFrame:
    """path, name, kind of exports that no other file refers to."""
    defs = definers(exports)
    refs = references.where(~F.col("name").isin("*", "default") & F.col("path").isNotNull()).select(F.col("path").alias("dst"), "name").distinct()
    own = refs.join(defs, ["dst", "name"], "left_semi").withColumn("own", F.lit(1))
    used = defs.join(refs.groupBy("name").agg(F.count("*").alias("n")), "name").join(own, ["dst", "name"], "left").where(F.col("n") > F.coalesce("own", F.lit(0)))
    used = used.select(F.col("dst").alias("path"), "name")
    return exports.groupBy("path", "name").agg(F.min("kind").alias("kind")).join(used, ["path", "name"], "left_anti")


def digest(ranked: DataFrame, budget: int = S.MAP_TOKENS) -> DataFrame:
    """path, at, names, cost: blocks of a file's best symbols that fit the budget, files by their best symbol.

    A block that doesn't fit is passed over; the first one may be cut instead. The fold runs over one row per file, of at most
    ``RANKED_SYMBOLS`` ranked symbols.
    """
    top = ranked.orderBy("pos").limit(S.RANKED_SYMBOLS)
    own = W.partitionBy("path").orderBy("pos")
    rows = top.withColumn("i", F.row_number().over(own)).where(F.col("i") <= S.SYMBOLS_PER_FILE)
    files = rows.groupBy("path").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("i", "name", "kind"))).alias("symbols"))
    blocks = files.agg(F.sort_array(F.collect_list(F.struct("first", "path", "symbols"))).alias("blocks"))
    fold = f"""aggregate(blocks, named_struct('used', 0L, 'first', true, 'out', cast(array() as array<struct<path: string, n: int, cost: bigint>>)),
      (acc, b) -> aggregate(reverse(sequence(1, if(acc.first, size(b.symbols), 1))),
        named_struct('done', false, 'used', acc.used, 'first', false, 'out', acc.out),
        (x, k) -> if(x.done, x, if(x.used + {_cost("b", "if(acc.first, k, size(b.symbols))")} <= {budget},
          named_struct('done', true, 'used', x.used + {_cost("b", "if(acc.first, k, size(b.symbols))")}, 'first', false,
            'out', concat(x.out, array(named_struct('path', b.path, 'n', cast(if(acc.first, k, size(b.symbols)) as int), 'cost', {_cost("b", "if(acc.first, k, size(b.symbols))")})))), x)),
        x -> named_struct('used', x.used, 'first', x.first, 'out', x.out)),
      acc -> acc.out)"""
    shown = blocks.select(F.posexplode(F.expr(fold)).alias("at", "b")).select((F.col("at") + 1).alias("at"), "b.path", "b.n", "b.cost")
    names = files.select("path", F.transform("symbols", lambda s: s["name"]).alias("names"))
    return shown.join(names, "path").select("path", "at", F.array_join(F.slice("names", F.lit(1), F.col("n")), ",").alias("names"), "cost")


def _cost(b: str, n: str) -> str:
    """A quarter, rounded up, of the characters of a block: a newline, the path and a colon, then one indented line per symbol."""
    return f"cast(ceil((length({b}.path) + 2 + aggregate(slice({b}.symbols, 1, {n}), 0, (t, s) -> t + length(s.name) + length(s.kind) + 6)) / 4.0) as bigint)"
