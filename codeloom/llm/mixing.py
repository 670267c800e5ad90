"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share 150% of all words; no target is above twice its source's
words, the excess going to the others by weight. With sources in order of cap / weight, the level L that each weight's unit gets is the
largest of (all - caps before) / (weights - weights before), and a target is min(cap, L * weight): one pass, no loop.

A source's target is met by complete epochs first. What is left over is drawn without replacement: a document of quality
weight w and uniform u has the key -ln(u) / w; in order of keys, documents are taken until their words reach the rest. Where that
falls is found by sums over 1024 classes of keys, then 1024 classes within one of them, and only the documents in there
are sorted; so a source of any size is never in one task. u is from the md5 of the seed and doc_id: reruns agree.

Defined cases: null text has size 0; null source is a source; rows that repeat a document are told apart by
a running number, so that a target is met whatever repeats; all sizes 0 give targets and taken 0;
an empty table gives an empty result; other columns are kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh

WEIGHTS = (5, 2, 1)
BUDGET, MOST_EPOCHS = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that lower a document's quality weight, by their share of its text.
POOR = "0123456789#*$%&|<>{}[]\\^~="
CLASSES = 1024


def quality_weight(text: Column) -> Column:
    """The share of characters that are not in ``POOR``, at least 0.05."""
    share = F.length(F.translate(text, POOR, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(share, F.lit(0.05)), F.lit(0.05))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def measured(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, epochs and rest, for each source of (source, size)."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rows.withColumn("r", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("r") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("weight"), "r").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.lit(BUDGET) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    unit = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("unit", unit).withColumn("level", F.max("unit").over(every))
    target = F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("level") * F.col("weight")))
    out = leveled.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs)
    return out.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))


def _class(key: Column, level: int) -> Column:
    """The class of a key: keys of weight 1 fill the classes evenly, and larger keys never get a smaller class."""
    spread = (F.lit(1.0) - F.exp(-key)) * CLASSES
    first = F.least(F.floor(spread), F.lit(CLASSES - 1))
    return first if level == 1 else F.least(F.greatest(F.floor((spread - first) * CLASSES), F.lit(0)), F.lit(CLASSES - 1))


def cuts(sizes: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """``plan`` with the place where a source's rest is reached.

    ``cut`` is (key, doc_id, size) there; of the ``alike`` rows that share these, ``full`` are taken whole and the next one to ``part``.
    Equal rows are added up before they are put in order, so no number of them is in one task.
    """
    rows = sizes.join(plan.where(F.col("rest") > 0).select(F.col("source").alias("own"), "rest"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    for level in (1, 2):
        rows = rows.withColumn("class", _class(F.col("key"), level))
        sums = rows.groupBy("source", "class").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("class"))
        hit = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        hit = scratch.save(hit.select(F.col("source").alias("s"), F.col("class").alias("c"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left")), f"class{level}")
        rows = rows.join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select("doc_id", "source", "size", "key", F.col("left").alias("rest"))
    rows = rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("alike"), F.first("rest").alias("rest")).withColumn("words", F.col("size") * F.col("alike"))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("words").over(order)).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    left = F.col("rest") - F.col("upto") + F.col("words")
    at = rows.select(F.col("source").alias("s"), F.struct("key", "doc_id", "size").alias("cut"), "alike", F.expr("(rest - upto + words) div size").alias("full"), (left % F.col("size")).alias("part"))
    return plan.join(at, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _at_cut(key: Column, doc_id: Column, size: Column, s: str) -> Column:
    at = F.col(f"{s}.cut")
    return F.coalesce((key == at["key"]) & doc_id.eqNullSafe(at["doc_id"]) & (size == at["size"]), F.lit(False))


def _numbered(rows: DataFrame, source: Column, column: str) -> DataFrame:
    """``rows``, a written table, with a running number from 0 within each source: tasks number their own, after the counts of those before."""
    part, own, place = fresh(rows, "part"), fresh(rows, "own"), fresh(rows, "place")
    rows = rows.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)).withColumn(own, source)
    before = rows.groupBy(own, part).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(own).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col(own).alias("o_"), F.col(part).alias("p_"), "before").select(F.struct("*").alias(mark := fresh(rows, "before")))
    rows = rows.join(before, F.col(own).eqNullSafe(F.col(f"{mark}.o_")) & (F.col(part) == F.col(f"{mark}.p_")))
    number = F.row_number().over(W.partitionBy(own, part).orderBy(place)) - 1 + F.col(f"{mark}.before")
    return rows.withColumn(column, number).drop(part, own, place, mark)


def _taken(key: Column, doc_id: Column, size: Column, s: str, whole: bool, number: Column) -> Column:
    """Words taken of a document, by its source's row ``s``; ``number`` tells it from rows like it."""
    at = F.col(f"{s}.cut")
    lower = F.coalesce(doc_id < at["doc_id"], doc_id.isNull() & at["doc_id"].isNotNull())
    earlier = (key < at["key"]) | ((key == at["key"]) & (lower | (doc_id.eqNullSafe(at["doc_id"]) & (size < at["size"]))))
    part = F.when(2 * F.col(f"{s}.part") >= size, size).otherwise(F.lit(0)) if whole else F.col(f"{s}.part")
    here = F.when(number < F.col(f"{s}.full"), size).when(number == F.col(f"{s}.full"), part).otherwise(F.lit(0))
    rest = F.when(at.isNull(), 0).when(_at_cut(key, doc_id, size, s), here).when(earlier, size).otherwise(F.lit(0))
    return (F.col(f"{s}.epochs") * size + rest).cast("long")


def _planned(docs: DataFrame, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """The sizes and the plan of ``docs``, and whether any cut is among rows that are alike."""
    sizes = scratch.save(measured(docs, seed), "sizes")
    plan = scratch.save(cuts(sizes, scratch.save(targets(sizes), "targets"), scratch), "plan")
    return sizes, plan, not plan.where("alike > 1").isEmpty()


def _split(rows: DataFrame, here: Column, source: Column, ties: bool, scratch: Scratch, column: str) -> DataFrame:
    """``rows`` with a number: 0, but for rows ``here`` that are alike their number in their source."""
    if not ties:
        return rows.withColumn(column, F.lit(0).cast("long"))
    alike = _numbered(scratch.save(rows.where(here), "alike"), source, column)
    return rows.where(~here).withColumn(column, F.lit(0).cast("long")).unionByName(alike.select(*rows.columns, F.col(column).cast("long").alias(column)))


def mix(docs: DataFrame, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    A target is met to the word, the last document being taken in part; with ``whole`` that one is taken or left, whichever is nearer.
    """
    scratch = Scratch(docs.sparkSession)
    sizes, plan, ties = _planned(docs, seed, scratch)
    rows = sizes.join(plan.select(F.struct("*").alias("p")), F.col("source").eqNullSafe(F.col("p.source")))
    three = F.col("key"), F.col("doc_id"), F.col("size")
    rows = _split(rows, _at_cut(*three, "p"), F.col("source"), ties, scratch, "number")
    return rows.select("doc_id", "size", F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), _taken(*three, "p", whole, F.col("number")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: each row as often as it is taken whole, with the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    _, plan, ties = _planned(docs, seed, scratch)
    p, n = fresh(docs, "p"), fresh(docs, "n")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    three = sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed), F.col("doc_id"), size
    rows = docs.join(plan.select(F.struct("*").alias(p)), F.col("source").eqNullSafe(F.col(f"{p}.source")))
    rows = _split(rows, _at_cut(*three, p), F.col("source"), ties, scratch, n)
    times = (_taken(*three, p, True, F.col(n)) / F.greatest(size, F.lit(1))).cast("int")
    return rows.withColumn(n, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
