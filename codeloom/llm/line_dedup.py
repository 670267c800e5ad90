"""Line deduplication by two Bloom filters, for hashes seen once and seen twice.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Each task streams its
documents into two filters; a key found by two tasks has all its bits in both tasks' first filters, so merging by
``twice |= once & other`` never misses a repeat. Only keys in the second filter shuffle, as 128-bit hashes added up before the
shuffle, and are counted exactly. Filters are sized by the number of documents up to ``bloom.MOST_BITS``; beyond that more keys
shuffle, and results stay the same. The ``BROADCAST_KEYS`` most common keys go to all tasks; others, none of which is hot, are
joined to the texts that hold them.

Defined cases: each row is a document, also if its doc_id repeats; null or empty text is one empty line; a line without
a key is never dropped; the first occurrence is the smallest (doc_id, line); an empty table gives an empty
result; other columns are kept as they are.
"""

from __future__ import annotations

import zlib
from collections import ChainMap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .bloom import BLOCK
from .common import Scratch, fresh, map_arrow, texts, tuned

STRIP = b" \t\n\x0b\x0c\r"
BITS_PER_DOCUMENT = 256
BROADCAST_KEYS = 200_000


def _keys(text: bytes) -> list[bytes]:
    return [x.strip(STRIP).lower() for x in text.split(b"\n")]


def _batch_hashes(docs: list[str]) -> np.ndarray:
    """The hashes of each document's different keys."""
    return np.array([xxhash.xxh3_64_intdigest(k) for x in docs for k in set(_keys(x.encode("utf-8", "surrogatepass"))) if k], np.uint64)


def repeated(docs: DataFrame, bits: int) -> np.ndarray:
    """The filter of keys that may be in two documents; at most ``bloom.MOST_BITS`` bits reach the driver."""

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(_batch_hashes(texts(batch)), return_counts=True)
            if len(h):
                probes = bloom.probes(h, bits)
                bloom.put(twice, probes[:, (n > 1) | bloom.has(once, probes)])
                bloom.put(once, probes)
        yield from rows((at // BLOCK, once[at : at + BLOCK], twice[at : at + BLOCK]) for at in range(0, len(once), BLOCK))

    def rows(blocks):
        for k, once, twice in blocks:
            if once.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "once": [zlib.compress(once, 1)], "twice": [zlib.compress(twice, 1)]})

    def fold(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                once, twice = (np.frombuffer(zlib.decompress(r[x]), np.uint8) for x in ("once", "twice"))
                if r["block"] in held:
                    a, b = held[r["block"]]
                    b |= twice | (a & once)
                    a |= once
                else:
                    held[r["block"]] = [once.copy(), twice.copy()]
        yield from rows((k, *v) for k, v in held.items())

    schema = "block int, once binary, twice binary"
    merged = docs.select("text").mapInArrow(fill, schema).repartition("block").mapInArrow(fold, schema).select("block", "twice")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():
        block = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(block)] = block
    return out


def common_lines(docs: DataFrame, min_docs: int, bits: int = 0) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, by 128-bit hash, and where each comes first."""
    spark = docs.sparkSession
    bits = bits or bloom.bits_for(docs.count(), BITS_PER_DOCUMENT)
    seen = spark.sparkContext.broadcast(repeated(docs, bits))

    def suspects(batch: pa.RecordBatch):
        keys, owner, line = [], [], []
        for i, x in enumerate(texts(batch)):
            first: dict[bytes, int] = {}
            for j, k in enumerate(_keys(x.encode("utf-8", "surrogatepass"))):
                if k:
                    first.setdefault(k, j)
            keys += first
            line += first.values()
            owner += [i] * len(first)
        if keys:
            hit = np.flatnonzero(bloom.has(seen.value, bloom.probes(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits)))
            found = [xxhash.xxh3_128_digest(keys[i]) for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("doc_id").take(pa.array(np.array(owner, np.int64)[hit])), pa.array(np.array(line, np.int64)[hit])], names=["key", "doc_id", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(docs.select("doc_id", "text"), suspects, f"key binary, doc_id {kind}, line long")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).where(F.col("n") >= min_docs)


def line_dedup(docs: DataFrame, min_docs: int = 10, keep: str = "none", column: str = "lines", bits: int = 0, broadcast_keys: int = BROADCAST_KEYS) -> tuple[DataFrame, str]:
    """``docs`` with a struct of the kept text, n_lines and n_dropped, and that struct's name.

    ``keep``: "none" drops a common line everywhere, "first" leaves its first occurrence.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark = tuned(docs.sparkSession)
    scratch, column = Scratch(spark), fresh(docs, column)
    common = scratch.save(common_lines(docs, min_docs, bits), "common")
    first = keep == "first"
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))])
    names = docs.columns

    def cut(batch: pa.RecordBatch, common_of):
        """common_of: for the i-th row, its keys to drop, as a dict to (doc_id, line) of the first."""
        kept, total, dropped = [], [], []
        ids = batch.column("doc_id").to_pylist()
        for i, x in enumerate(texts(batch)):
            drop = common_of(i)
            lines = x.split("\n")
            if drop:
                stay = []
                for j, k in enumerate(_keys(x.encode("utf-8", "surrogatepass"))):
                    h = xxhash.xxh3_128_digest(k) if k else b""
                    if h not in drop or first and drop[h] == (ids[i], j):
                        stay.append(lines[j])
            else:
                stay = lines
            kept.append("\n".join(stay))
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
        struct = pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), struct], names=[*names, column])

    often = most_common(common, broadcast_keys)
    held = {bytes(r["key"]): (r["first"]["doc_id"], r["first"]["line"]) for r in common.where(often).select("key", "first").collect()}
    sent, others = spark.sparkContext.broadcast(held), common.where(~often)
    if others.isEmpty():
        return map_arrow(docs, lambda batch: cut(batch, lambda i: sent.value), out), column

    def mine(batch: pa.RecordBatch):
        rows = [(i, h) for i, x in enumerate(texts(batch)) for k in set(_keys(x.encode("utf-8", "surrogatepass"))) if k and (h := xxhash.xxh3_128_digest(k)) not in sent.value]
        if rows:
            at, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(keys, pa.binary())], names=["id", "key"])

    # by text, not by row: rows of one text lose the same lines, and lines of another text of the same hash are not in this one
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("id"), "text")
    found = map_arrow(rows, mine, "id long, key binary").distinct().join(others.select("key", "first"), "key")
    found = found.groupBy("id").agg(F.collect_set(F.struct("key", "first")).alias("drops"))
    mark = fresh(docs, "drops")
    rows = docs.join(found.select(F.struct("id", "drops").alias(mark)), F.xxhash64("text") == F.col(f"{mark}.id"), "left")

    def joined(batch: pa.RecordBatch):
        drops = [{bytes(y["key"]): (y["first"]["doc_id"], y["first"]["line"]) for y in x["drops"]} if x else {} for x in batch.column(mark).to_pylist()]
        yield from cut(batch, lambda i: ChainMap(drops[i], sent.value) if drops[i] else sent.value)

    return map_arrow(rows, joined, out), column


def most_common(common: DataFrame, keys: int) -> Column:
    """Whether a key of ``common`` (key, n) is among the ``keys`` most common ones, and never among more; of equal classes of n, all or none."""
    low = "greatest(length(bin(n)) - 6, 0)"
    level = F.expr(f"shiftleft(shiftright(n, {low}), {low})")
    least = 1 << 62
    for r in common.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if (keys := keys - r["n"]) < 0:
            break
        least = r["level"]
    return level >= least


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: str = "first") -> DataFrame:
    """``docs`` with the kept lines as text and, where there is such a column, n_chars brought up to date."""
    rows, column = line_dedup(docs, min_docs, keep)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(f"{column}.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{column}.n_dropped") > 0, F.length(F.col(f"{column}.text"))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
