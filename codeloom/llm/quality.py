"""Quality rules whose limits come from the data: quantile sketches per language and source.

Each document gets integer metrics. A sketch counts, for each group and metric, the values with all but
their highest six bits cleared: its error is below 1/32 of a value, and two sketches merge by adding counts, in
any order. It holds the documents that pass the base rule. No limit is a number set beforehand: with a metric's level p (``LEVELS``),
a document's limits are

    upper = q(p) + REACH * (q(p) - q(1/2)),   lower = q(1 - p) - REACH * (q(1/2) - q(1 - p)),

so the spread of its own group decides how far its values may lie out. The levels are shares: how much of a group each metric presumes sound.
Where that share of a group has one and the same value, this value is the limit. One event alone (a symbol, a repeated line) never decides:
a document is judged by the class of what it would have with one event fewer.
Groups are (lang, source); one with fewer than ``MIN_GROUP`` documents takes the merged sketch of its language,
and a language with fewer that of all documents. Documents and limits are joined, and what lies beyond is rejected.

Defined cases: null text has no words and fails the base rule; null lang and null source are groups of their
own; an empty table gives an empty result; repeated rows are judged each alike; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, Scratch, WordHashes, flat, fresh, inside, map_arrow, mixed, sums, texts, tuned, windows

SYMBOLS = "#*$%&|<>"
MIN_GROUP = 100
#: Metric: its level p; word_length is held from both sides.
LEVELS = {"symbols": 0.9, "dup_lines": 0.98, "repeats": 0.98, "adjacent": 0.95, "upper": 0.95, "word_length": 0.95}
REACH = 3
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_upper"]
_UPPER = bytes(range(65, 91))


def _features(docs: list[str], hashes: WordHashes) -> dict[str, np.ndarray]:
    raw = [x.encode("utf-8", "surrogatepass") for x in docs]
    words, bounds = flat([x.split() for x in raw])
    h = hashes.of(words)
    owner = np.repeat(np.arange(len(docs), dtype=np.uint64), np.diff(bounds))
    covered = np.zeros(len(h) + 1, np.int64)
    if len(keep := np.flatnonzero(inside(bounds, 8))):
        w = windows(h, 8)[keep] ^ mixed(owner[keep] + np.uint64(1))
        _, back, count = np.unique(w, return_inverse=True, return_counts=True)
        starts = keep[count[back] > 1]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + 8, -1)
    adjacent = np.zeros(len(h), bool)
    if len(pair := inside(bounds, 2)):
        adjacent[: len(pair)] = pair & (h[:-1] == h[1:])
    lines = [x.split("\n") for x in docs]
    full = [[y for y in x if y.strip(WHITE)] for x in lines]
    return {
        "n_words": np.diff(bounds),
        "word_chars": np.array([len(x) - sum(map(x.count, WHITE)) for x in docs]),
        "n_symbols": np.array([sum(map(x.count, SYMBOLS)) for x in docs]),
        "n_lines": np.array([len(x) for x in lines]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in full]),
        "n_repeat_words": sums(np.cumsum(covered[:-1]) > 0, bounds),
        "n_adjacent": sums(adjacent, bounds),
        "n_upper": np.array([len(x) - len(x.translate(None, _UPPER)) for x in raw]),
    }


def with_features(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a struct of the counts of ``FEATURES`` under ``column``."""
    kind = T.StructType([T.StructField(x, T.LongType()) for x in FEATURES])
    hashes = WordHashes()

    def work(batch: pa.RecordBatch):
        got = _features(texts(batch), hashes)
        struct = pa.StructArray.from_arrays([pa.array(got[x], pa.int64()) for x in FEATURES], FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, column])

    tuned(docs.sparkSession)
    return map_arrow(docs, work, T.StructType([*docs.schema.fields, T.StructField(column, kind)]))


def metrics(f: str, less: int = 0) -> dict[str, F.Column]:
    """The metrics of a document, with ``less`` events fewer of what they count."""
    share = lambda top, bottom, by=10000: F.expr(f"{by} * greatest({f}.{top} - {less}, 0) div greatest({f}.{bottom}, 1)")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "adjacent": share("n_adjacent", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "word_length": F.expr(f"100 * {f}.word_chars div greatest({f}.n_words, 1)"),
    }


def base_failed(f: str) -> F.Column:
    """Under 20 words, or over 30 in 100 words in repeated windows."""
    return F.expr(f"{f}.n_words < 20 or 100 * {f}.n_repeat_words > 30 * {f}.n_words")


def cleared(v: F.Column) -> F.Column:
    """The class of a value in the sketch: all but its highest six bits cleared."""
    low = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(features: DataFrame, f: str) -> DataFrame:
    """Counts by lang, source, metric and value class, over every document that passes the base rule."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in metrics(f).items()])
    rows = features.where(~base_failed(f)).select("lang", "source", F.explode(pairs).alias("m"))
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), cleared(F.col("m.v")).alias("value")).agg(F.count("*").alias("n"))


def _quantile(q: str) -> str:
    """Of bins [(value, n)] in order: the first value with at least the share q of all at or below it."""
    return f"""aggregate(bins, named_struct('left', cast(ceil({q} * total) as bigint), 'value', cast(null as bigint)),
        (a, x) -> named_struct('left', a.left - x.n, 'value', if(a.value is null and a.left - x.n <= 0, x.value, a.value)), a -> a.value)"""


def limits(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with a lower and an upper limit for each metric."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("metric"))

    def fences(keys: list[str], depth: int) -> DataFrame:
        merged = counts.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))
        merged = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("bins"), F.sum("n").alias("total")).withColumn("p", level)
        merged = merged.select(*keys, "metric", "total", F.expr(_quantile("p")).alias("high"), F.expr(_quantile("0.5D")).alias("mid"), F.expr(_quantile("(1 - p)")).alias("low"))
        pair = F.struct((F.col("high") + REACH * (F.col("high") - F.col("mid"))).alias("most"), (F.col("low") - REACH * (F.col("mid") - F.col("low"))).alias("least"))
        return merged.groupBy(*keys).agg(F.first("total").alias(f"n{depth}"), *[F.first(F.when(F.col("metric") == k, pair), True).alias(f"{k}{depth}") for k in LEVELS])

    by_lang = fences(["lang"], 1).withColumnRenamed("lang", "lang_")
    grouped = fences(["lang", "source"], 0).join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")), "left").drop("lang_")
    every = fences([], 2).first()  # one row of two numbers a metric
    for k in LEVELS:
        most, least = every[f"{k}2"] if every is not None and every["n2"] is not None else (None, None)
        grouped = grouped.withColumn(f"{k}2", F.struct(F.lit(most).cast("long").alias("most"), F.lit(least).cast("long").alias("least")))
    out = ["lang", "source"]
    for k in LEVELS:
        q = F.when(F.col("n0") >= min_group, F.col(f"{k}0")).when(F.col("n1") >= min_group, F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
        out += [q["most"].alias(f"{k}_most"), q["least"].alias(f"{k}_least")]
    return grouped.select(*out)


def judged(docs: DataFrame, min_group: int = MIN_GROUP, column: str = "quality", text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct of counts and verdicts, and that struct's name. Without ``text`` that column is left out, and texts are read once.

    ``base_failed``: under 20 words, or over 30 in 100 words in repeated windows; ``kept``: passes that and all limits.
    """
    column = fresh(docs, column)
    scratch = Scratch(docs.sparkSession)
    if text:
        narrow = with_features(docs.select("lang", "source", "text"), column).select("lang", "source", column)
    else:
        narrow = scratch.save(with_features(docs, column).drop("text"), "features")
    most = scratch.save(limits(scratch.save(sketches(narrow, column), "sketches"), min_group), "limits")
    most = most.select(F.struct("*").alias(lim := fresh(docs, "limits")))
    full = with_features(docs, column) if text else narrow
    rows = full.join(most, F.col("lang").eqNullSafe(F.col(f"{lim}.lang")) & F.col("source").eqNullSafe(F.col(f"{lim}.source")), "left")
    failed = base_failed(column)
    fits = F.lit(True)
    for k, v in metrics(column, 1).items():
        fits &= cleared(v) <= F.col(f"{lim}.{k}_most")
        if k == "word_length":
            fits &= cleared(v) >= F.col(f"{lim}.{k}_least")
    verdict = F.struct(f"{column}.*", failed.alias("base_failed"), (~failed & F.coalesce(fits, F.lit(False))).alias("kept"))
    return rows.select(*[F.col(f"`{c}`") for c in full.columns if c != column], verdict.alias(column)), column


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they had."""
    rows, column = judged(docs, min_group)
    return rows.where(F.col(f"{column}.kept")).drop(column)
