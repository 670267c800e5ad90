"""Substring deduplication by de Bruijn compaction.

A window of ``WIDTH`` words is an edge from its first ``WIDTH - 1`` words to its last. A node where the graph branches, or where some
document begins or ends, is a turn; between turns edges form a nonbranching path, and every document that holds one edge of a path holds it whole.
So all edges of a path have their first occurrence in one place, side by side, and paths compact by joins:

1. windows are cut into pieces of consecutive windows of one document whose least ``ANCHOR``-word hash (their anchor) is at the same place.
   Equal windows have equal anchors, so anchors found once hold no repeat; a filter of bounded size drops most of their pieces, and
   where a dropped piece follows or precedes, the document counts as ending or beginning;
2. equal pieces collapse to one with their number and the coordinates (doc_id, start) of the first; their windows, added up, are the edges;
3. nodes get their degrees from the edges; edges that leave a turn are heads of paths, those that enter one are tails, and coordinates of heads
   and tails give each repeated path its first place and its length;
4. pieces that hold a head give every occurrence of its path; those whose coordinates aren't the first place are removed, whole.

An edge is told by the hashes of both its nodes (128 bits); words are not compared again. Windows are judged on the input.

Defined cases: null text has no words; a document of fewer than ``WIDTH`` words keeps all; rows that repeat a doc_id are one document, whose
equal windows at the same start are not repeats of each other, whatever its texts; rows of null doc_id come last; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, WordHashes, flat, inside, map_arrow, table, texts, tuned, windows

WIDTH, ANCHOR = 20, 10
LAST = (1 << 63) - 1


def pieces_of(docs: list[str], hashes: WordHashes, width: int, anchor: int) -> dict[str, np.ndarray]:
    """Word hashes of all documents, and of their windows in order: the document, the start in it and in the hashes, the anchor's hash, and where pieces begin."""
    words, bounds = flat([x.encode("utf-8", "surrogatepass").split() for x in docs])
    h = hashes.of(words)
    at = np.flatnonzero(inside(bounds, width))
    if not len(at):
        none = np.empty(0, np.int64)
        return {"words": h, "doc": none, "start": none, "at": none, "anchor": none.view(np.uint64), "begin": none}
    grams = windows(h, anchor)
    n = len(h) - width + 1
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width - anchor + 1):
        other = grams[j : j + n]
        less = other < least
        least[less], place[less] = other[less], j
    doc = np.repeat(np.arange(len(docs)), np.diff(bounds))[at]
    where, least = at + place[at], least[at]
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    return {"words": h, "doc": doc, "start": at - bounds[doc], "at": at, "anchor": least, "begin": np.flatnonzero(new)}


def repeated_anchors(docs: DataFrame, scratch: Scratch, width: int, anchor: int) -> tuple[np.ndarray, int]:
    """A filter of the anchors that begin more than one piece."""
    hashes = WordHashes()

    def work(batch: pa.RecordBatch):
        p = pieces_of(texts(batch), hashes, width, anchor)
        values, n = np.unique(p["anchor"][p["begin"]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["anchor", "n"])

    counted = map_arrow(docs.select("text"), work, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))
    again = scratch.save(counted.where("n > 1").select("anchor"), "anchors")
    bits = bloom.bits_for(again.count())
    held = bloom.build(again, bits)
    scratch.drop("anchors")
    return held, bits


def _occurrences(docs: DataFrame, scratch: Scratch, width: int, anchor: int) -> DataFrame:
    """Pieces that may repeat: doc_id, text_hash, start, key, the hashes of the nodes passed, and whether the document begins or ends with it."""
    held, bits = repeated_anchors(docs, scratch, width, anchor)
    sent, hashes = docs.sparkSession.sparkContext.broadcast(held), WordHashes()

    def work(batch: pa.RecordBatch):
        p = pieces_of(texts(batch), hashes, width, anchor)
        begin = p["begin"]
        if not len(begin):
            return
        size = np.diff(np.append(begin, len(p["doc"])))
        hit = bloom.has(sent.value, bloom.probes(p["anchor"][begin], bits))
        same = np.diff(p["doc"][begin]) == 0
        opens, closes = np.ones(len(begin), bool), np.ones(len(begin), bool)
        opens[1:], closes[:-1] = ~(same & hit[:-1]), ~(same & hit[1:])
        begin, size = begin[hit], size[hit] + 1
        bounds = np.append(0, np.cumsum(size))
        nodes = windows(p["words"], width - 1)[np.arange(bounds[-1]) + np.repeat(p["at"][begin] - bounds[:-1], size)]
        raw = nodes.tobytes()
        keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in itertools.pairwise(bounds.tolist())]
        doc = pa.array(p["doc"][begin])
        yield table(doc_id=batch.column("doc_id").take(doc), text_hash=batch.column("text_hash").take(doc), start=pa.array(p["start"][begin]), piece=pa.array(keys, pa.binary()), nodes=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(nodes.view(np.int64))), opens=pa.array(opens[hit]), closes=pa.array(closes[hit]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return scratch.save(map_arrow(rows, work, f"doc_id {kind}, text_hash long, start long, piece binary, nodes array<long>, opens boolean, closes boolean"), "occurrences")


def _walked(pieces: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per window i of each piece, from node l to node r."""
    steps = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("nodes") - 2)))
    return steps.select(*columns, "i", F.col("nodes")[F.col("i")].alias("l"), F.col("nodes")[F.col("i") + 1].alias("r"))


def compacted(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """The nonbranching paths of windows found more than once: the first edge (l, r), the place (d, s) of the first occurrence, n windows."""
    last = F.col("i") == F.size("nodes") - 2
    steps = _walked(pieces, F.struct("at.d", (F.col("at.s") + F.col("i")).alias("s"), "at.x").alias("at"), "c", (F.col("opens") & (F.col("i") == 0)).alias("opens"), (F.col("closes") & last).alias("closes"))
    summed = steps.groupBy("l", "r").agg(F.min("at").alias("at"), F.sum("c").alias("c"), F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    edges = scratch.save(summed.select("l", "r", F.when(F.col("c") > 1, F.col("at")).alias("at"), "opens", "closes"), "edges")
    ends = F.array(F.struct(F.col("l").alias("v"), F.lit(0).alias("into"), F.lit(1).alias("out"), F.col("opens").alias("cut")), F.struct(F.col("r").alias("v"), F.lit(1).alias("into"), F.lit(0).alias("out"), F.col("closes").alias("cut")))
    nodes = edges.select(F.inline(ends)).groupBy("v").agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.max("cut").alias("cut"))
    turns = scratch.save(nodes.where("into <> 1 or out <> 1 or cut").select("v"), "turns")
    again = edges.where("at is not null").select("l", "r", "at.*")
    none = F.lit(None).cast("long")
    heads = again.join(turns, F.col("l") == F.col("v"), "left_semi").select("d", "x", "s", "l", "r", none.alias("tail"))
    tails = again.join(turns, F.col("r") == F.col("v"), "left_semi").select("d", "x", "s", none.alias("l"), none.alias("r"), F.col("s").alias("tail"))
    # Both of one text in order, from its end: the least tail so far is the one that a head's path ends with.
    until = F.min("tail").over(Window.partitionBy("d", "x").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    paths = scratch.save(heads.unionAll(tails).withColumn("until", until).where("l is not null").select("l", "r", "d", "s", (F.col("until") - F.col("s") + 1).alias("n")), "paths")
    scratch.drop("edges", "turns")
    return paths


def _removed(docs: DataFrame, scratch: Scratch, width: int, anchor: int) -> DataFrame:
    """doc_id, text_hash (which tells rows of one doc_id apart), and runs (start, n) of windows that start earlier elsewhere."""
    rows = _occurrences(docs, scratch, width, anchor)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    place = F.struct(order.alias("d"), F.col("start").alias("s"), F.col("text_hash").alias("x"))
    pieces = scratch.save(rows.groupBy("piece").agg(F.min(place).alias("at"), F.count("*").alias("c"), F.max("opens").alias("opens"), F.max("closes").alias("closes"), F.first("nodes").alias("nodes")), "pieces")
    paths = compacted(pieces, scratch)
    known = _walked(pieces, "piece").join(paths, ["l", "r"]).groupBy("piece").agg(F.collect_list(F.struct("i", "n", "d", "s")).alias("heads"))
    known = scratch.save(known, "known")
    scratch.drop("pieces", "paths")
    found = rows.select("doc_id", "text_hash", order.alias("own"), "start", "piece").join(known, "piece").select("doc_id", "text_hash", "own", "start", F.inline("heads"))
    begin = F.col("start") + F.col("i")
    return found.where((F.col("d") != F.col("own")) | (F.col("s") != begin)).select("doc_id", "text_hash", F.struct(begin.alias("start"), "n").alias("span"))


def substring_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by spaces) and kept_sha256 for each row."""
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark)
    spans = _removed(docs, scratch, width, anchor).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.collect_list("span").alias("spans"))
    rows = docs.select("doc_id", "text").join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h")), "left").select("doc_id", "text", "spans")

    def work(batch: pa.RecordBatch):
        words = [x.encode("utf-8", "surrogatepass").split() for x in texts(batch)]
        spans, kept = batch.column("spans"), []
        bounds = spans.offsets.to_numpy()
        start, n = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        empty = spans.is_null().to_pylist()
        for k, w in enumerate(words):
            a, b = bounds[k], bounds[k + 1]
            if empty[k] or a == b:
                kept.append(w)
                continue
            cover = np.zeros(len(w) + 1, np.int64)
            np.add.at(cover, start[a:b], 1)
            np.add.at(cover, np.minimum(start[a:b] + n[a:b] - 1 + width, len(w)), -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept.append([x for x, y in zip(w, gone.tolist(), strict=True) if not y])
        joined = [b" ".join(x) for x in kept]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in words], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(words, kept, strict=True)], pa.int64()), pa.array([x.decode("utf-8", "surrogatepass") for x in joined], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, work, f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
