"""A map of a source tree, and the questions that it answers as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import is_test_file
from ..operators import closure, edges, lexical, lookup, pagerank, routes, symbols
from ..session import stable


class UsageError(ValueError):
    """A question that can't be asked so."""


#: The last map of each stored root, and the state of its source.
_HELD: dict[tuple[str, str], tuple[tuple[str, str], CodeMap]] = {}


@dataclass
class CodeMap:
    """Facts, and what follows from them.

    files (path, text, feature, rsc), symbols (path, name, kind, ..), edges (src, dst, names, weight), type_edges (src, dst),
    references (path, name, n), ranks (path, rank), calls (call edges), meta (one row), texts (path, text) to search in,
    skipped (path, error) of files that could not be read, and the lexical index of the exports, made once.
    """

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame | None = None
    ranks: DataFrame | None = None
    references: DataFrame | None = None
    type_edges: DataFrame | None = None
    calls: DataFrame | None = None
    meta: DataFrame | None = None
    texts: DataFrame | None = None
    skipped: DataFrame | None = None
    index: lexical.LexicalIndex | None = None

    @classmethod
    def build(cls, files: DataFrame, facts, root: str | None = None, source_version: str = "", fingerprint: str = "") -> CodeMap:
        """A map of ``files`` by a provider of facts: ``facts(files)`` gives symbols, edges, type_edges, references, calls and meta.

        With ``root`` the tables are stored there as a new version of that source.
        """
        got = {k: stable(v) for k, v in facts(files).items()}
        nodes = got["files"].select(F.col("path").alias("node"))
        ranks = pagerank.pagerank(got["edges"], nodes).select(F.col("node").alias("path"), F.round("rank", 6).alias("rank"))
        meta = got["meta"].withColumn("source_version", F.lit(source_version))
        out = cls(got["files"], got["symbols"], got["edges"], stable(ranks), got["references"], got["type_edges"], got["calls"], meta, got["files"].select("path", "text"), got.get("skipped"))
        out.index = out._index()
        if root:
            out.save(root, source_version, fingerprint)
        return out

    TABLES = ("files", "symbols", "edges", "ranks", "references", "type_edges", "calls")

    def save(self, root: str, source_version: str = "", fingerprint: str = "") -> None:
        from ..sources.store import MapStore

        store, row = MapStore(self.files.sparkSession, root), self.meta.first()
        tables = {k: getattr(self, k) for k in self.TABLES}
        if self.skipped is not None:
            tables["skipped"] = self.skipped
        if self.index is not None:
            tables |= {"postings": self.index.postings, "lexical_docs": self.index.docs, "lexical_df": self.index.df}
        store.write((store.latest() or 0) + 1, tables, source_version, fingerprint, row["file_count"], row["skipped_count"], row["edge_coverage"], row["degraded"])

    @classmethod
    def load(cls, spark, root: str) -> CodeMap | None:
        """The latest stored version; None where there is none of this schema."""
        from ..sources.store import MapStore

        store = MapStore(spark, root)
        if (last := store.latest()) is None:
            return None
        tables = {k: store.read(k, last) for k in cls.TABLES}
        out = cls(**tables, meta=store.versions().where(F.col("version") == last), texts=tables["files"].select("path", "text"), skipped=store.read("skipped", last))
        if (postings := store.read("postings", last)) is not None:
            docs = store.read("lexical_docs", last)
            out.index = lexical.LexicalIndex(postings, docs, store.read("lexical_df", last), lexical.statistics(docs))
        return out

    @classmethod
    def of(cls, spark, source: str, root: str, facts=None) -> CodeMap:
        """The map of a working tree as it is now: the one in memory or the stored one if nothing has changed since, else a new one.

        What counts as unchanged is the commit and every differing file's time and size; without a repository, those of all source files.
        """
        from ..sources.provider import source_facts
        from ..sources.store import MapStore
        from ..sources.worktree import current_state, read_worktree

        state = current_state(spark, source)
        key = (spark.sparkContext.applicationId, root)
        if key in _HELD and _HELD[key][0] == state:
            return _HELD[key][1]
        code = cls.load(spark, root) if MapStore(spark, root).fresh(*state) else None
        if code is None:
            code = cls.build(read_worktree(spark, source), facts or source_facts, root, *state)
        _HELD[key] = (state, code)
        return code

    def _index(self) -> lexical.LexicalIndex:
        own = self.symbols.where("is_export") if "is_export" in self.symbols.columns else self.symbols
        own = own.join(self.files.select("path", "feature"), "path", "left") if "feature" in self.files.columns else own
        key = ["path", "name", "kind"]
        return lexical.build_index(lexical.symbol_documents(own.dropDuplicates(key)), key)

    # names and texts

    def find(self, name: str, kind: str | None = None, include_locals: bool = True) -> DataFrame:
        _asked(name)
        return lookup.find_symbol(self.symbols, self.ranks, name, kind, include_locals)

    def search(self, text: str, kind: str | None = None) -> DataFrame:
        """BM25 over symbols, fused with ranks; ``kind`` filters what is shown, and then total counts that."""
        _asked(text)
        key = ["path", "name", "kind"]
        if self.index is None:
            self.index = self._index()
        found = lexical.top_matches(lexical.bm25(self.index, text, key, self.ranks), key)
        if kind:
            found = stable(found.where(F.lower("kind").contains(kind.lower())))
            found = found.withColumn("total", F.lit(found.count()).cast("long"))
        return found

    def content(self, text: str) -> DataFrame:
        return lexical.content_search(lexical.searchable(self.texts), text)

    def any(self, query: str) -> DataFrame:
        """answer, path, name, detail, pos, total: the first that has an answer of file, symbols and features, candidates, texts of symbols, lines.

        A file's answer also lists the symbols and features that fit.
        """
        _asked(query)
        nothing = F.lit(None).cast("string")
        one = F.lit(1)
        spark = self.files.sparkSession
        asked = spark.createDataFrame([(query,)], "query string")
        file = lookup.resolve_file(self.files, asked).first()
        found = stable(lookup.find_symbol(self.symbols, self.ranks, query))
        names = stable(lookup.features(self.files.where(F.lower("feature").contains(query.lower()))))
        structure = found.select(F.lit("symbol").alias("answer"), "path", "name", F.col("kind").alias("detail"), "pos", "total")
        structure = structure.union(names.select(F.lit("feature"), nothing, "feature", F.col("n_files").cast("string"), one, F.lit(names.count()).cast("long")))
        if file["path"]:
            return spark.createDataFrame([("file", file["path"], None, None, 1, 1)], "answer string, path string, name string, detail string, pos int, total long").union(structure)
        if not structure.isEmpty():
            return structure
        if file["candidates"] > 1:
            rows = self.files.where(F.lower("path").contains(query.lower())).select("path").distinct()
            return rows.select(F.lit("candidate").alias("answer"), "path", nothing.alias("name"), nothing.alias("detail"), one.alias("pos"), F.lit(file["candidates"]).cast("long").alias("total"))
        texts = stable(self.search(query))
        if not texts.isEmpty():
            return texts.select(F.lit("lexical").alias("answer"), "path", "name", F.col("score").cast("string").alias("detail"), "pos", "total")
        lines = self.content(query)
        return lines.select(F.lit("content").alias("answer"), "path", F.col("line_no").cast("string").alias("name"), F.col("line").alias("detail"), one.alias("pos"), "total")

    # ranks

    def hubs(self) -> DataFrame:
        top = self.ranks.orderBy(F.desc("rank"), "path").limit(S.HUBS).join(pagerank.in_degree(self.edges), "path", "left")
        return top.select("path", "rank", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree")).orderBy(F.desc("rank"), "path")

    def top_symbols(self, n: int = S.DEFAULT_SYMBOLS, focus: list[str] = ()) -> DataFrame:
        own = self.symbols.where("is_export") if "is_export" in self.symbols.columns else self.symbols
        return symbols.symbol_rank(own, self.references, self.files.select(F.col("path").alias("node")), focus, n)

    def digest(self, focus: list[str] = (), tokens: int | None = None) -> DataFrame:
        if tokens is not None and tokens <= 0:
            raise UsageError("tokens must be positive")
        budget = tokens or (S.FOCUS_TOKENS if focus else S.MAP_TOKENS)
        return symbols.digest(self.top_symbols(S.RANKED_SYMBOLS, focus), budget)

    def relates(self, path: str) -> DataFrame:
        """part, path, detail, score: the file itself, its exports, imports, dependents and compile-time twins, then the files nearest to it."""
        file = self._file(path)
        text = lambda c: (F.lit(None) if c is None else c).cast("string")

        def part(name: str, rows: DataFrame, path_, detail=None, score=None) -> DataFrame:
            return rows.select(F.lit(name).alias("part"), text(path_).alias("path"), text(detail).alias("detail"), (F.lit(None) if score is None else score).cast("double").alias("score"))

        own = self.files.where(F.col("path") == file)
        out = part("file", own.join(self.ranks, "path", "left"), F.col("path"), F.col("rsc") if "rsc" in own.columns else None, F.col("rank"))
        exports = self.symbols.where(F.col("path") == file)
        out = out.union(part("export", exports.where("is_export") if "is_export" in exports.columns else exports, F.col("name"), F.col("kind")))
        for kind, edges_ in (("", self.edges), ("type-only ", self.type_edges)):
            if edges_ is not None:
                out = out.union(part(f"{kind}import", edges_.where(F.col("src") == file).select("dst").distinct(), F.col("dst")))
                out = out.union(part(f"{kind}dependent", edges_.where(F.col("dst") == file).select("src").distinct(), F.col("src")))
        return out.union(part("related", pagerank.related(self.edges, file), F.col("path"), None, F.col("score")))

    # features

    def features(self) -> DataFrame:
        return lookup.features(self.files)

    def feature(self, name: str) -> DataFrame:
        """path, inside: a feature's files, and the files that use them from outside."""
        _asked(name)
        hit = lookup.match_feature(self.files, name).first()
        if hit is None:
            return self.files.limit(0).select("path", F.lit(True).alias("inside"))
        own = self.files.where(F.col("feature") == hit[0]).select("path", F.lit(True).alias("inside"))
        return own.union(lookup.feature_dependents(self.files, self.edges, hit[0]).withColumn("inside", F.lit(False)))

    # closures

    def _suffix(self, path: str) -> DataFrame:
        _asked(path)
        hits = stable(lookup.suffix_matches(self.files.select("path"), path))
        exact = hits.where(F.col("path") == path)
        if not exact.isEmpty():
            return exact
        if (n := hits.count()) != 1:
            raise UsageError(f"{path} fits several files" if n else f"no file fits {path}")
        return hits

    def affected(self, path: str) -> DataFrame:
        """path, hop, is_test of all that a change of a file may break."""
        return closure.affected(self.edges, self._suffix(path), self.type_edges)

    def covered(self, path: str) -> DataFrame:
        """file, dependents, tests, covered: whether a test reaches a file, or it is one itself."""
        return closure.coverage(self.edges, self._suffix(path), self.type_edges)

    def affected_with_verdict(self, path: str) -> DataFrame:
        """path, hop, is_test, covered: the file itself at hop 0, with whether a test covers it, and all that its change may break."""
        own = self.covered(path).select(F.col("file").alias("path"), F.lit(0).alias("hop"), is_test_file(F.col("file")).alias("is_test"), "covered")
        return own.unionByName(self.affected(path).withColumn("covered", F.lit(None).cast("boolean")))

    def _owner(self, name: str, within: str | None) -> str | None:
        got = [r["path"] for r in lookup.owners(self.symbols, name, within).select("path").distinct().limit(2).collect()]
        if len(got) > 1:
            raise UsageError(f"several files declare {name}; name one")
        return got[0] if got else None

    def _calls(self, name: str, within: str | None, depth: int, direction: str) -> DataFrame:
        _asked(name)
        file = self._owner(name, within)
        return closure.call_closure(self.calls, file or "", name, depth, self.ranks, direction)

    def callers(self, name: str, within: str | None = None, depth: int = 1) -> DataFrame:
        return self._calls(name, within, depth, "callers")

    def callees(self, name: str, within: str | None = None, depth: int = 1) -> DataFrame:
        return self._calls(name, within, depth, "calls")

    # routes

    def routes(self) -> DataFrame | None:
        """None where there is no app folder: the question doesn't apply."""
        return routes.route_table(self.files)

    def route(self, url_or_file: str) -> DataFrame | None:
        """url, path, imports, server_modules of the matching routes."""
        _asked(url_or_file)
        table = self.routes()
        if table is None:
            return None
        hit = routes.match_routes(table, self.files.sparkSession.createDataFrame([(url_or_file,)], "query string")).select("url", "path")
        used = self.edges.select(F.col("src").alias("path"), "dst").join(self.files.select(F.col("path").alias("dst"), "rsc"), "dst", "left")
        used = used.groupBy("path").agg(F.sort_array(F.collect_set("dst")).alias("imports"), F.sort_array(F.collect_set(F.when(F.col("rsc") == "server", F.col("dst")))).alias("server_modules"))
        return hit.join(used, "path", "left").select("url", "path", "imports", "server_modules")

    # drawings and state

    def export(self, form: str = "dot", focus: str | None = None) -> DataFrame:
        if form not in ("dot", "mermaid"):
            raise UsageError("form is dot or mermaid")
        drawn = edges.drawn(self.edges, self.ranks, edges.neighborhood(self.edges, self._file(focus)) if focus else None)
        return (edges.dot if form == "dot" else edges.mermaid)(*drawn)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}

    def summary(self) -> DataFrame:
        return self.meta

    def skips(self) -> DataFrame:
        """reason, n of files that could not be read."""
        return lookup.skips(self.skipped if self.skipped is not None else self.files.select("path", F.lit(None).cast("string").alias("error")))

    def doctor(self, current_version: str = "") -> DataFrame:
        return lookup.doctor(self.meta.withColumn("current_version", F.lit(current_version)))

    def _file(self, path: str) -> str:
        _asked(path)
        got = lookup.resolve_file(self.files, self.files.sparkSession.createDataFrame([(path,)], "query string")).first()["path"]
        if got is None:
            raise UsageError(f"no single file fits {path}")
        return got


def _asked(query: str) -> None:
    if not query:
        raise UsageError("an empty question")


def as_json(rows: DataFrame) -> DataFrame:
    """(json): one object per row; absent values are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
