"""Language-model scoring by a subword lattice: the marginal probability of a text over all its segmentations.

Pieces are those of an existing vocabulary file, which is not trained. Their weights start from the file's own scores (a piece of score -r, the r-th
best, weighs 1 / (1 + r)) and are then fitted to the training documents by ``ROUNDS`` steps of expectation-maximization over
all segmentations of all their words; each piece keeps a share ``FLOOR`` of the uniform weight. A word with its leading mark
has the probability of its lattice, summed forward in log space; a character that is no piece is spelled by its bytes' pieces.
A text's probability is the product over its words and the end, which is the file's ``</s>`` piece, counted as the base counts it.

Word counts are added up in each task and again by word. The most frequent words, at most ``FREQUENT``, go to all tasks with
their counts and scores; other words of a document are joined to theirs, and none of these is hot (``often_used``). So the table of words may be of any size.

Training documents are those whose crc32 of the doc_id as text leaves no remainder of ``held`` by ``folds``; a null doc_id counts as the text "null".
Base: sum over tokens of log10((c + 1) / (N + V + 1)); tokens are lower-cased (A-Z) words and one end.

Defined cases: null text is empty and has the end only; without training documents N and V are 0 and pieces keep the weights of the file; rows
that repeat a doc_id are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_arrow, texts, tuned

MARK = "▁"
ROUNDS, FLOOR = 2, 1e-3
FREQUENT = 100_000
FLUSH = 1 << 18
LOG10 = math.log(10)


class Pieces:
    """A vocabulary file of ``sentencepiece``: pieces' ids by string, bytes' ids, and start weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size, self.end = n, model.eos_id()
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.start = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            else:
                self.ids[piece] = i
            self.start[i] = 1 / (1 + max(0.0, -model.get_score(i)))
        self.usable = self.start > 0

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        known: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))}
        more = set(known)
        known.update(self.ids)
        found = {}
        for x, i in known.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in x:
                    h = (h + np.uint64(ord(c)) + np.uint64(1)) * _SPREAD
                    h ^= h >> np.uint64(29)
            found[int(h)] = 2 * i + (x in more)
        if len(found) < len(known):
            raise ValueError("two pieces have the same hash")
        keys = np.array(sorted(found), np.uint64)
        return keys, np.array([found[int(k)] for k in keys], np.int64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of pieces and of their beginnings; 2 * piece (or -2) + whether longer pieces begin so."""
        return self._table


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """The lattices of many words of one length (in code points, with the mark), held as one arc list over all words.

    An arc (begin, end) exists for a word where that stretch is a piece, found by hash among the vocabulary's
    pieces and their beginnings, or is a single character, spelled by bytes where it is no piece.
    """

    def __init__(self, vocabulary: Pieces, words: list[str]):
        self.n, self.vocabulary = len(words), vocabulary
        self.length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(self.n, self.length)
        keys, values = vocabulary.table()
        self.arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # begin, end, words, pieces or -1 - code for bytes
        for begin in range(self.length):
            alive, h = np.arange(self.n), np.zeros(self.n, np.uint64)
            for end in range(begin + 1, self.length + 1):
                h = (h + codes[alive, end - 1].astype(np.uint64) + np.uint64(1)) * _SPREAD
                h ^= h >> np.uint64(29)
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h
                piece = np.where(hit, values[at] >> 1, -1)
                if end == begin + 1:
                    piece = np.where(piece >= 0, piece, -2 - codes[:, begin].astype(np.int64))
                    self.arcs.append((begin, end, alive, piece))
                elif (full := piece >= 0).any():
                    self.arcs.append((begin, end, alive[full], piece[full]))
                go = hit & (values[at] & 1 > 0)
                if not go.any():
                    break
                alive, h = alive[go], h[go]
        spelled = np.unique(np.concatenate([x[3][x[3] < 0] for x in self.arcs]))
        self.spelled = {int(x): [vocabulary.bytes[y] for y in chr(-2 - int(x)).encode("utf-8", "surrogatepass")] for x in spelled}

    def weights(self, logs: np.ndarray) -> list[np.ndarray]:
        """The log weight of each arc of each arc list."""
        if not self.spelled:
            return [logs[x[3]] for x in self.arcs]
        names = np.array(sorted(self.spelled))
        own = np.array([sum(logs[i] for i in self.spelled[int(x)]) for x in names])
        return [np.where(p >= 0, logs[np.maximum(p, 0)], own[np.minimum(np.searchsorted(names, p), len(names) - 1)]) for _, _, _, p in self.arcs]

    def forward(self, weights: list[np.ndarray]) -> np.ndarray:
        """(length + 1, words): the log probability of all segmentations up to each place."""
        alpha = np.full((self.length + 1, self.n), -np.inf)
        alpha[0] = 0.0
        for (begin, end, word, _), w in zip(self.arcs, weights, strict=True):
            alpha[end, word] = np.logaddexp(alpha[end, word], alpha[begin, word] + w)
        return alpha

    def expected(self, logs: np.ndarray, times: np.ndarray, uses: np.ndarray) -> None:
        """Adds to ``uses`` the expected uses of pieces over all segmentations of all words."""
        weights = self.weights(logs)
        alpha = self.forward(weights)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        for (begin, end, word, piece), w in zip(reversed(self.arcs), reversed(weights), strict=True):
            x = beta[end, word] + w
            beta[begin, word] = np.logaddexp(beta[begin, word], x)
            use = times[word] * np.exp(alpha[begin, word] + x - alpha[-1, word])
            real = piece >= 0
            np.add.at(uses, piece[real], use[real])
            if not real.all():
                for code in np.unique(piece[~real]):
                    for i in self.spelled[int(code)]:
                        uses[i] += use[piece == code].sum()


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lattices(vocabulary: Pieces, words: list[bytes]):
    """(places, lattices) for words of each length. A very long word is a group of its own."""
    marked = [MARK + _text(x) for x in words]
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(marked):
        by_length.setdefault(len(x), []).append(i)
    for length, at in by_length.items():
        step = max(1, (1 << 18) // length)
        for k in range(0, len(at), step):
            yield at[k : k + step], Lattices(vocabulary, [marked[i] for i in at[k : k + step]])


def held_out(doc_id, held: int, folds: int) -> bool:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % folds == held


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [x.encode("utf-8", "surrogatepass").lower().split() for x in texts(batch)]


def word_counts(docs: DataFrame, held: int, folds: int) -> DataFrame:
    """word, c (in training documents), d (anywhere). The empty word counts the ends."""

    def run(batches):
        train, every = Counter(), Counter()

        def told():
            words = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([every[w] for w in words], pa.int64())], names=["word", "c", "d"])
            train.clear()
            every.clear()

        for batch in batches:
            for i, w in zip(batch.column("doc_id").to_pylist(), _words(batch), strict=True):
                every.update(w)
                every[b""] += 1
                if not held_out(i, held, folds):
                    train.update(w)
                    train[b""] += 1
            if len(every) > FLUSH:
                yield from told()
        yield from told()

    return docs.mapInArrow(run, "word binary, c long, d long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def _gathered(batches, *names: str):
    """(words, columns) of many batches at a time: lattices are summed over all words of a length at once."""
    held: list[pa.RecordBatch] = []

    def told():
        t = pa.Table.from_batches(held)
        yield t.column("word").to_pylist(), tuple(t.column(x).to_numpy() for x in names)
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= 1 << 15:
            yield from told()
    if held:
        yield from told()


def fitted(words: DataFrame, path: str, rounds: int) -> np.ndarray:
    """The natural logs of the pieces' weights. One number per piece reaches the driver."""
    spark, vocabulary = words.sparkSession, pieces(path)
    n, vocabulary_size = vocabulary.usable.sum(), vocabulary.size

    def normalized(weight: np.ndarray) -> np.ndarray:
        total = weight.sum()
        share = (weight / total if total else weight) * (1 - FLOOR) + FLOOR / n
        return np.where(vocabulary.usable | (np.arange(vocabulary.size) == vocabulary.end), share, 1.0)

    ends = words.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    weight = vocabulary.start.copy()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(np.log(normalized(weight)))

        def run(batches, sent=sent):
            uses = np.zeros(vocabulary_size)
            for words_, (times,) in _gathered(batches, "c"):
                for at, lattice in lattices(pieces(path), words_):
                    lattice.expected(sent.value, times[at].astype(float), uses)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(uses[used])], names=["piece", "n"])

        got = words.where("c > 0").where(F.length("word") > 0).select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not got:
            break
        weight = np.zeros(vocabulary.size)
        for r in got:
            weight[r["piece"]] = r["n"]
        weight[vocabulary.end] = ends
    return np.log(normalized(weight))


def often_used(known: DataFrame, frequent: int) -> Column:
    """Whether a word of ``known`` (word, d) is among about the ``frequent`` most used ones, and never among more.

    Counts are classed by their highest six bits, at most 2,000 classes. Classes are taken whole from the top; of the first that doesn't fit, the words
    of the smallest hashes. So a word that is left out is used no more than each of nearly ``frequent`` others: none is hot.
    """
    low = "greatest(length(bin(d)) - 6, 0)"
    level = F.expr(f"shiftleft(shiftright(d, {low}), {low})")
    room, least, share = frequent, 1 << 62, 0
    for r in known.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if r["n"] > room:
            share = int((1 << 30) * max(0.0, room - 4 * math.sqrt(room)) / r["n"])
            return (level > r["level"]) | (level == r["level"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share)
        room, least = room - r["n"], r["level"]
    return level >= least


def score(docs: DataFrame, path: str, held: int = 2, folds: int = 7, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = tuned(docs.sparkSession)
    scratch, docs = Scratch(spark), docs.select("doc_id", "text")
    counts = scratch.save(word_counts(docs, held, folds), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    logs = spark.sparkContext.broadcast(fitted(counts, path, rounds))

    def measured(batches):
        for words, (c, d) in _gathered(batches, "c", "d"):
            p, full = np.full(len(words), logs.value[pieces(path).end]), [i for i, x in enumerate(words) if x]
            for at, lattice in lattices(pieces(path), [words[i] for i in full]):
                p[np.array(full)[at]] = lattice.forward(lattice.weights(logs.value))[-1]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(d), pa.array(p / LOG10)], names=["word", "c", "d", "p"])

    known = scratch.save(counts.mapInArrow(measured, "word binary, c long, d long, p double"), "known")
    frequent_words = known.where(often_used(known, frequent) | (F.length("word") == 0))
    often = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"], r["p"]) for r in frequent_words.collect()})
    bottom = math.log10(total + kinds + 1)

    def run(batch: pa.RecordBatch):
        rows, words, times = [], [], []
        held_ = often.value
        for i, w in zip(batch.column("doc_id").to_pylist(), _words(batch), strict=True):
            w.append(b"")
            n_known, base, p, rare, n_rare = 0, 0.0, 0.0, [], []
            for x, n in Counter(w).items():
                if hit := held_.get(x):
                    n_known += n if hit[0] else 0
                    base += n * (math.log10(hit[0] + 1) - bottom)
                    p += n * hit[1]
                else:
                    rare.append(x)
                    n_rare.append(n)
            rows.append((held_out(i, held, folds), len(w), n_known, base, p))
            words.append(rare)
            times.append(n_rare)
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(docs, run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<long>")
    mark = fresh(rows, "row")
    rows = scratch.save(rows.withColumn(mark, F.monotonically_increasing_id()), "rows")
    rare = rows.select(mark, F.explode(F.arrays_zip("rare", "times")).alias("r")).select(mark, F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    added = rare.join(known.where(~often_used(known, frequent)), "word")
    added = added.groupBy(mark).agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * (F.log10(F.col("c") + 1) - F.lit(bottom))).alias("b"), F.sum(F.col("n") * F.col("p")).alias("p"))
    out = rows.drop("rare", "times").join(added, mark, "left")
    plus = lambda x, y, zero: F.col(x) + F.coalesce(F.col(y), F.lit(zero))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k", 0).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), plus("base_score", "b", 0.0).alias("base_score"), plus("score", "p", 0.0).alias("score"))
