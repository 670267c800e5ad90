"""Full-text ranking of symbols and texts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import subtokens, subtokens_of
from ..session import stable


@dataclass
class LexicalIndex:
    """postings (*key, len, token, tf), docs (*key, len), df (token, n) and stats (one row: n_docs, avgdl)."""

    postings: DataFrame
    docs: DataFrame
    df: DataFrame
    stats: DataFrame


def symbol_documents(symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """path, name, kind, tokens: parts of the name, the path without a code extension, the feature, and the kind in one word.

    All symbols by default: no file has to hold the index, so it needs no cap.
    """
    bare = F.regexp_replace("path", r"\.(?:" + "|".join((*S.CODE_EXTENSIONS, S.SFC_EXTENSION)) + r")$", "")
    kind = F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), "Declaration$", ""))
    feature = subtokens(F.coalesce("feature", F.lit(""))) if "feature" in symbols.columns else F.array().cast("array<string>")
    tokens = F.concat(subtokens(F.col("name")), subtokens(bare), feature, F.when(kind != "", F.array(kind)).otherwise(F.array().cast("array<string>")))
    rows = symbols.select("path", "name", "kind", tokens.alias("tokens"))
    return rows if limit is None else rows.orderBy("path", "name", "kind").limit(limit)


def build_index(documents: DataFrame, key: list[str]) -> LexicalIndex:
    """An index of (*key, tokens), for many questions; texts are cut into tokens once. ``key`` tells documents apart."""
    docs = stable(documents.withColumn("len", F.size("tokens")))
    postings = stable(docs.select(*key, "len", F.explode("tokens").alias("token")).groupBy(*key, "len", "token").agg(F.count("*").alias("tf")))
    df = postings.groupBy("token").agg(F.count("*").alias("n"))
    docs = docs.drop("tokens")
    return LexicalIndex(postings, docs, df, statistics(docs))


def statistics(docs: DataFrame) -> DataFrame:
    """One row, n_docs and avgdl (4 places), of (len)."""
    return docs.agg(F.count("*").alias("n_docs"), F.round(F.avg("len"), 4).alias("avgdl"))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """token, n: the documents (tokens) that hold each token."""
    return documents.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def query_tokens(query: str) -> list[str]:
    """The query's parts without stop words."""
    return [x for x in subtokens_of(query) if x not in S.STOPWORDS]


def _part(n: int, n_docs: int, avgdl: float, tf: Column) -> Column:
    """What one token adds to a document's score, its length being ``len``."""
    idf = F.log(F.lit(1 + (n_docs - n + 0.5) / (n + 0.5)))
    return idf * (tf * (S.BM25_K1 + 1)) / (tf + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * (F.col("len") / (avgdl or 1.0))))


def _fused(scored: DataFrame, key: list[str], ranks: DataFrame | None) -> DataFrame:
    """*key and score (6 places) of positive sums ``s``, weighed by the rank of the path relative to the largest."""
    scored = scored.where("s > 0")
    if ranks is not None:
        top = ranks.agg(F.max("rank")).first()[0] or 0.0
        scored = scored.join(ranks.select("path", "rank"), "path", "left")
        scored = scored.withColumn("s", F.col("s") * (1 + S.RANK_WEIGHT * (F.coalesce("rank", F.lit(0.0)) / top if top else F.lit(0.0))))
    return scored.select(*key, F.round("s", 6).alias("score"))


def bm25(index: LexicalIndex, query: str, key: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """*key and score (6 places) of documents with a positive score. ``ranks``: (path, rank), weighed in relative to the largest.

    Only the query's tokens are read, as a filter on the postings; a token that the query repeats counts each time.
    """
    times = Counter(query_tokens(query))
    if not times:
        return index.docs.limit(0).select(*key, F.lit(0.0).alias("score"))
    stats = index.stats.first()  # two numbers
    hits = index.postings.where(F.col("token").isin(*times))
    part = F.lit(0.0)
    for r in index.df.where(F.col("token").isin(*times)).collect():  # at most one row per query token
        part = F.when(F.col("token") == r["token"], _part(r["n"], stats["n_docs"], stats["avgdl"], F.col("tf")) * float(times[r["token"]])).otherwise(part)
    return _fused(hits.groupBy(*key).agg(F.sum(part).alias("s")), key, ranks)


def _times(token: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == F.lit(token)))


def bm25_scan(documents: DataFrame, query: str, key: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """What ``bm25`` gives, for one question without an index: one pass counts the query's tokens in (*key, tokens), and no posting shuffles."""
    times = Counter(query_tokens(query))
    if not times:
        return documents.limit(0).select(*key, F.lit(0.0).alias("score"))
    names = [f"tf{i}" for i in range(len(times))]
    counts = [_times(t).alias(c) for c, t in zip(names, times, strict=True)]
    counted = stable(documents.select(*key, F.size("tokens").alias("len"), *counts))
    stats = counted.agg(F.count("*").alias("n_docs"), F.round(F.avg("len"), 4).alias("avgdl"), *[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in names]).first()
    total = F.lit(0.0)
    for c, n in zip(names, times.values(), strict=True):
        if stats[c]:
            total = total + F.when(F.col(c) > 0, _part(stats[c], stats["n_docs"], stats["avgdl"], F.col(c)) * float(n)).otherwise(0.0)
    return _fused(counted.select(*key, total.alias("s")), key, ranks)


def top_matches(scored: DataFrame, order: list[str], limit: int = S.SYMBOL_MATCHES) -> DataFrame:
    """The best ``limit`` rows with total, pos."""
    total = scored.count()
    top = scored.orderBy(F.desc("score"), *order).limit(limit)
    return top.withColumn("total", F.lit(total).cast("long")).withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), *order)))


def content_search(texts: DataFrame, query: str, limit: int = S.CONTENT_LINES) -> DataFrame:
    """path, line_no, line, total: lines that hold the query in either case, control characters replaced."""
    lines = texts.where(F.lower("text").contains(query.lower())).select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hits = lines.where(F.lower("line").contains(query.lower())).select("path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("line", S.CONTROL_CHARACTERS, "�").alias("line"))
    total = hits.count()
    return hits.orderBy("path", "line_no").limit(limit).withColumn("total", F.lit(total).cast("long"))


def searchable(files: DataFrame) -> DataFrame:
    """Files without those that may hold credentials, by the globs and name parts of the schema."""
    globs = "|".join(re.escape(g).replace(r"\*", "[^/]*") for g in S.SENSITIVE_FILES)
    low = F.lower("path")
    hidden = F.col("path").rlike(f"(^|/)({globs})$")
    for part in S.SENSITIVE_PARTS:
        hidden = hidden | low.contains(part)
    return files.where(~hidden)
