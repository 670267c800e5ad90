"""MinHash near-deduplication: universal hash minima, banding, signature and exact checks, connected components.

A document's set holds 64-bit hashes of its different word shingles (A-Z lower-cased; with fewer words than a shingle, all words as one).
Documents with the same set form a class, numbered, with its smallest doc_id beside it, and only classes are compared. A class has
``BANDS * ROWS`` minima of x -> a * x + b mod 2**64; classes that share a band's minima form a bucket. A pair at similarity 0.8 shares
none of 50 bands of 6 with probability 3e-7.

No bucket emits all its pairs. In rounds, every open bucket compares its members with one of them, the most connected not yet
taken, and components are formed of the links that hold on full sets; a bucket is open while its members are in
different components. Rounds go on while they find links, ``ROUNDS`` at most. What is open after that is compared across
components in cells of bounded size (``_cells``), first by byte signatures, which must agree in at least 0.8 less five standard errors,
then by sets, and cells pass on only links. So a link is lost only if no band or no signature tells of it.

Defined cases: without words or text a set is empty, and the row is linked with nothing, its component being its own
doc_id; rows of null doc_id take part like others, and are a component of null where no doc_id is in it; rows that repeat a doc_id are
judged each by their own set, so two components may bear one doc_id, and ``kept`` holds for each row of it; ``near_dedup`` keeps one row of each
component; an empty table gives an empty result; other columns are kept by ``near_dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, WordHashes, flat, fresh, map_arrow, mixed, texts, tuned, windows
from .components import components

BANDS, ROWS = 50, 6
ROUNDS, CELL, CELL_SHINGLES = 3, 512, 1 << 20
#: Members of a bucket that meet its pivot in one place.
SPREAD = 4096
#: Another round is worth it if this share of the last one's pairs were links.
GAIN = 0.02
_CHUNK = 1 << 15


def shingles(docs: list[str], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Each document's set as sorted different hashes."""
    words, bounds = flat([x.encode("utf-8", "surrogatepass").lower().split() for x in docs])
    h = hashes.of(words)
    w = windows(h, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(w[a : b - width + 1]))
        else:
            out.append(mixed(windows(h[a:b], b - a) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(documents, n): the least value of each hash function over each set; sets are not empty."""
    a, b = _coefficients(n)
    out = np.empty((len(sets), n), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.zeros(end - at, np.int64)
        np.cumsum([len(s) for s in sets[at : end - 1]], out=starts[1:])
        for k in range(n):
            y = x * a[k]
            y += b[k]
            out[at:end, k] = np.minimum.reduceat(y, starts)
        at = end
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_id, n, set (hi, lo), bands and a byte signature for each row; the last four are null for an empty set."""
    hashes = WordHashes()

    def work(batch: pa.RecordBatch):
        sets = shingles(texts(batch), hashes, width)
        full = [i for i, s in enumerate(sets) if len(s)]
        hi, lo, bands, bytes_ = ([None] * len(sets) for _ in range(4))
        if full:
            m = minima([sets[i] for i in full], BANDS * ROWS)
            keys = np.stack([mixed(windows_of(m[:, k * ROWS : (k + 1) * ROWS]) + np.uint64(k + 1)) for k in range(BANDS)], axis=1).view(np.int64)
            low = mixed(m).astype(np.uint8)
            for j, i in enumerate(full):
                d = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                hi[i], lo[i] = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
                bands[i], bytes_[i] = keys[j], low[j].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())], names=["doc_id", "text_id", "n", "hi", "lo", "bands", "signature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_id")), work, "doc_id long, text_id long, n long, hi long, lo long, bands array<long>, signature binary")


def windows_of(rows: np.ndarray) -> np.ndarray:
    """One hash of each row."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = mixed(out + rows[:, k])
    return out


def _ref() -> F.Column:
    """A hash of a row's doc_id and text_id: rows of the same are alike."""
    return F.xxhash64("doc_id", "text_id")


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, set) of the classes in ``nodes``: sorted hashes as bytes. A bounded filter of their rows spares other texts the shuffle."""
    spark = docs.sparkSession
    wanted = scratch.save(nodes.select("ref"), "wanted")
    bits = bloom.bits_for(wanted.count())
    held = spark.sparkContext.broadcast(bloom.build(wanted, bits))
    hashes = WordHashes()

    def work(batch: pa.RecordBatch):
        hit = np.flatnonzero(bloom.has(held.value, bloom.probes(batch.column("ref").to_numpy().view(np.uint64), bits)))
        if len(hit):
            data = [s.tobytes() for s in shingles(texts(batch.take(pa.array(hit))), hashes, width)]
            keys = [xxhash.xxh3_128_intdigest(x) for x in data]
            yield pa.RecordBatch.from_arrays([pa.array([(k >> 64) - (1 << 63) for k in keys], pa.int64()), pa.array([(k & ((1 << 64) - 1)) - (1 << 63) for k in keys], pa.int64()), pa.array(data, pa.binary())], names=["hi", "lo", "set"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    rows = map_arrow(rows.select(_ref().alias("ref"), "text"), work, "hi long, lo long, set binary").dropDuplicates(["hi", "lo"])
    return scratch.save(rows.join(nodes.select("node", "hi", "lo"), ["hi", "lo"]).select("node", "set"), "sets")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, salt, salts) whose full sets are similar enough. a: in few pairs; b, which may be in many, is dealt to ``salts`` places."""
    places = pairs.select("b", "salts").distinct().groupBy("b").agg(F.max("salts").alias("salts"))
    pivots = sets.select(F.col("node").alias("b"), F.col("set").alias("y")).join(places, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    rows = pairs.select("a", "b", "salt").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(pivots, ["b", "salt"])

    def work(batch: pa.RecordBatch):
        x, y = (batch.column(c).to_pylist() for c in "xy")
        good = []
        for i in range(batch.num_rows):
            u, v = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
            both = common(u, v)
            if 100 * both >= percent * (len(u) + len(v) - both):
                good.append(i)
        if good:
            yield batch.select(["a", "b"]).take(pa.array(good))

    return map_arrow(rows.select("a", "b", "x", "y"), work, "a long, b long")


def _cells(rows: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) of one bucket and different labels, found on full sets.

    Members outside a bucket's largest label meet all its members. Both are dealt to blocks, and each pair of blocks is a cell that
    holds about ``CELL`` members and ``CELL_SHINGLES`` hashes a side. A cell compares a pair if the bucket is the pair's first
    common one, the sizes and signatures allow it, and no link found in the cell joins their labels already; so it
    passes on fewer links than it has labels.
    """
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    info = counts.groupBy("key").agg(F.max(F.struct("m", "label")).alias("g"), F.sum("s").alias("s"))
    rows = rows.join(scratch.save(info.select("key", F.col("g.label").alias("main"), F.col("g.m").alias("m"), "s"), "main"), "key")
    few = F.col("label") != F.col("main")
    blocks = lambda members: F.greatest(F.ceil(members / CELL), F.ceil(F.col("s") * members / F.col("c") / CELL_SHINGLES), F.lit(1)).cast("int")
    rows = rows.withColumn("ku", blocks(F.col("c") - F.col("m"))).withColumn("ka", blocks(F.col("c"))).withColumn("few", few)
    rows = rows.join(nodes.select("node", "signature", "bands"), "node").join(sets, "node")
    heavy = ["node", "label", "n", "few", "signature", "bands", "set"]
    block = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    left = rows.where("few").select("key", block(F.col("ku")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("j"), F.lit(True).alias("left"), *heavy)
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("ku") - 1)).alias("i"), block(F.col("ka")).alias("j"), F.lit(False).alias("left"), *heavy)
    share = percent / 100
    least = share - 5 * (share * (1 - share) / (BANDS * ROWS)) ** 0.5

    def links(key: int, group: list[dict]):
        us, all_ = [g for g in group if g["left"]], [g for g in group if not g["left"]]
        if not us or not all_:
            return
        node, label, n = (np.array([g[x] for g in all_], np.int64) for x in ("node", "label", "n"))
        rare = np.array([g["few"] for g in all_])
        bands, signature = np.array([g["bands"] for g in all_], np.int64), np.frombuffer(b"".join(g["signature"] for g in all_), np.uint8).reshape(len(all_), -1)
        full = [np.frombuffer(g["set"], np.uint64) for g in all_]
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        for u in us:
            at = np.flatnonzero((label != u["label"]) & (100 * np.minimum(n, u["n"]) >= percent * np.maximum(n, u["n"])) & ~(rare & (node < u["node"])))
            if len(at):
                same = bands[at] == np.array(u["bands"], np.int64)
                at = at[bands[at, same.argmax(axis=1)] == key]
            if len(at):
                at = at[(signature[at] == np.frombuffer(u["signature"], np.uint8)).mean(axis=1) >= least]
            mine = np.frombuffer(u["set"], np.uint64)
            for k in at.tolist():
                a, b = find(u["label"]), find(int(label[k]))
                if a != b:
                    both = common(mine, full[k])
                    if 100 * both >= percent * (u["n"] + int(n[k]) - both):
                        top[a] = b
                        yield u["node"], int(node[k])

    def run(batches):
        group, cell, found = [], None, []

        def told():
            if found:
                a, b = zip(*found, strict=True)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["i"], r["j"]) != cell:
                    if cell:
                        found.extend(links(cell[0], group))
                    group, cell = [], (r["key"], r["i"], r["j"])
                group.append(r)
            yield from told()
        if cell:
            found.extend(links(cell[0], group))
        yield from told()

    return left.unionAll(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_id, n, hi, lo, label (of the component's classes; null for none) and component_id for each row."""
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.save(signed(docs, width), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_id"))
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(first.alias("f")).select("hi", "lo", F.col("f.doc_id").alias("first"), F.xxhash64("f.doc_id", "f.text_id").alias("ref"))
    named = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = rows.withColumn("ref", _ref()).join(named.drop("first"), ["hi", "lo", "ref"]).dropDuplicates(["node"])

    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = scratch.save(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = scratch.save(banded.join(shared, "key"), "members")
    fame = scratch.save(members.groupBy("node").agg(F.sum("c").alias("fame")), "fame")
    links, labels = None, None
    if not fame.isEmpty():
        sets = _sets_of(docs, named.join(fame, "node", "left_semi"), width, scratch)
        members = scratch.save(members.join(fame, "node"), "famous")
        open_ = members.withColumn("label", F.col("node"))
        used, gain = None, 1.0
        for turn in range(ROUNDS + 1):
            if turn:
                open_ = members if labels is None else members.join(labels, "node", "left")
                open_ = open_.withColumn("label", F.coalesce("label", "node") if labels is not None else F.col("node"))
                split = scratch.save(open_.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), f"split{turn}")
                if split.isEmpty():
                    break
                open_ = scratch.save(open_.join(split, "key"), f"open{turn}")
            last = turn == ROUNDS or gain < GAIN
            if last:
                found = scratch.save(_cells(open_, nodes, sets, scratch, percent), f"links{turn}")
                n_pairs = 1
            else:
                free = open_ if used is None else open_.join(used, ["key", "node"], "left_anti")
                pivot = free.groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("least"), "label", "n")).alias("p"), F.max("c").alias("members"))
                pivot = scratch.save(pivot.select("key", (-F.col("p.least")).alias("b"), F.col("p.label").alias("b_label"), F.col("p.n").alias("b_n"), F.ceil(F.col("members") / SPREAD).cast("int").alias("salts")), f"pivot{turn}")
                new = pivot.select("key", F.col("b").alias("node"))
                used = new if used is None else used.unionAll(new)
                fits = 100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")
                # a bucket of very many members meets its pivot in many places
                at = pivot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                pairs = open_.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / SPREAD)).cast("int")).join(at, ["key", "salt"])
                pairs = pairs.where((F.col("label") != F.col("b_label")) & fits).groupBy(F.col("node").alias("a"), "b").agg(F.max(F.struct("salts", "salt")).alias("at"))
                pairs = scratch.save(pairs.select("a", "b", "at.salt", "at.salts"), f"pairs{turn}")
                found = scratch.save(_confirmed(pairs, sets, percent), f"links{turn}")
                n_pairs = pairs.count()
            n_found = found.count()
            gain = n_found / max(1, n_pairs)
            if n_found:
                links = found if labels is None else found.unionAll(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
                labels = scratch.save(components(links, scratch, f"part{turn}").select("node", F.col("component").alias("label")), f"labels{turn}")
            if last:
                break
        scratch.drop("members", "famous", "sets", "shared", "fame")
    named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.save(named.select("hi", "lo", "label", "first"), "named")
    named = scratch.save(named.select("hi", "lo", "label").join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label"), "components")
    out = rows.select("doc_id", "text_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    return _grouped(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, of its smallest doc_id; rows without words stay."""
    mark, text = fresh(docs, "kept"), fresh(docs, "text_id")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_grouped(docs.select("doc_id", "text"), width, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "kept")
    own = F.col("doc_id").cast("long")
    many = scratch.save(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "many")
    if many.isEmpty() and docs.where("doc_id is null").isEmpty():
        return docs.join(rows.select(F.col("doc_id").alias(mark)), own == F.col(mark), "left_semi")
    # Rows that share a doc_id are told apart by their texts, and one of each component stays.
    several = rows.join(many, rows["doc_id"].eqNullSafe(many["doc_id"]), "left_semi")
    once = rows.join(many, rows["doc_id"].eqNullSafe(many["doc_id"]), "left_anti").select(F.col("doc_id").alias(mark), F.col("text_id").alias(text))
    key = F.when(F.col("n") > 0, F.struct("label"))
    group = fresh(docs, "key")
    told = several.select(F.col("doc_id").alias(mark), F.col("text_id").alias(text), key.alias(group)).distinct()
    hit = own.eqNullSafe(F.col(mark)) & (F.xxhash64("text") == F.col(text))
    left = docs.join(told, hit)
    left = left.where(F.col(group).isNotNull()).dropDuplicates([group]).unionByName(left.where(F.col(group).isNull())).select(*docs.columns)
    return docs.join(once, hit, "left_semi").unionByName(left)
