"""Facts of a source tree: files in, fact tables out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as S
from ..functions import feature_of
from ..operators import edges as E
from ..operators import lookup
from ..session import prepared, stable
from .configs import read_rules
from .files import sources
from .lexer import read_source
from .resolve import expected_local, origins, resolve
from .sfc import script_of

_SITE = "struct<spec: string, names: array<string>, locals: array<struct<local: string, name: string>>, form: string, type_only: boolean, line: int>"
_SYMBOL = "struct<name: string, kind: string, is_export: boolean, is_default: boolean, local: string, line: int>"
_CALL = "struct<base: string, name: string, kind: string, line: int, owner: string, owner_line: int>"
_RAW = f"path string, rsc string, error string, symbols array<{_SYMBOL}>, imports array<{_SITE}>, calls array<{_CALL}>"


def raw_facts(files: DataFrame) -> DataFrame:
    """One row per file (path, text): what its text says, or why it could not be read."""
    prepared(files.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row = {"path": path, "rsc": None, "error": None, "symbols": [], "imports": [], "calls": []}
                if text is not None and path.endswith(f".{S.SFC_EXTENSION}"):
                    text = (script_of(text) or (None, None, None))[2]
                    if text is None:
                        row["error"] = "no-script"
                if text is not None:
                    try:
                        f = read_source(text)
                        row |= {"rsc": f.rsc, "symbols": f.symbols, "imports": f.imports, "calls": f.calls}
                    except RecursionError:
                        row["error"] = "stack-overflow"
                    except Exception:  # noqa: BLE001 - one file that can't be read must not end the build
                        row["error"] = "parse-error"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    schema = files.sparkSession.createDataFrame([], _RAW).schema
    arrow = to_arrow_schema(schema)
    return files.select("path", "text").mapInArrow(run, schema)


def source_facts(files: DataFrame, ignore: list[str] = (), declarations: bool = False, raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a map is built of, from ``files`` (path, text). ``raw``: what ``raw_facts`` said of them before, kept by file.

    Declaration files can be meant by imports but are no part of the map unless ``declarations``.
    """
    spark = prepared(files.sparkSession)
    known = sources(files, ignore)
    raw = stable(raw_facts(known) if raw is None else raw.join(known.select("path"), "path", "left_semi"))
    listed = stable(known.join(raw.where("error is null or error <> 'no-script'").select("path", "rsc", "error"), "path").select("path", "text", "rsc", "error", "is_node", feature_of(F.col("path")).alias("feature")))
    nodes = listed.where("error is null").where(F.lit(declarations) | F.col("is_node")).select("path")

    sites = raw.select("path", F.posexplode("imports").alias("at", "s")).select("path", "at", "s.*")
    sites = stable(resolve(sites, listed.select("path"), read_rules(spark, files)))
    here = sites.join(nodes, "path", "left_semi")

    # what files declare, and what they only pass on
    declared = raw.select("path", F.explode("symbols").alias("s")).select("path", "s.*").join(nodes, "path", "left_semi")
    exported = declared.where("is_export")
    public = exported.select("path", F.when(F.col("is_default"), "default").otherwise(F.col("name")).alias("name"), "kind", "line", F.col("name").alias("shown"))
    public = stable(public.union(exported.where("is_default").select("path", "name", "kind", "line", "name")).distinct())
    passed = here.where("form = 'reexport'").select("path", "target", "spec", F.explode("locals").alias("l")).select("path", "target", "spec", F.col("l.local").alias("name"), F.col("l.name").alias("target_name"))
    imported = here.where("form = 'static'").select("path", "target", "spec", F.explode("locals").alias("l")).select("path", "target", "spec", F.col("l.local").alias("local"), F.col("l.name").alias("target_name"))
    # import { a } from; export { a }: passed on as well
    again = exported.join(imported.select("path", "local", "target", "spec", "target_name"), ["path", "local"]).where("kind = '?'")
    forwards = passed.union(again.select("path", "target", "spec", F.when(F.col("is_default"), "default").otherwise(F.col("name")).alias("name"), "target_name")).distinct()
    own = public.join(again.select("path", F.col("name").alias("shown")).distinct(), ["path", "shown"], "left_anti")
    inside = nodes.withColumnRenamed("path", "target")
    found = stable(origins(own.select("path", "name"), forwards.where("target is not null").join(inside, "target", "left_semi").select("path", "name", "target", "target_name")))
    kinds = own.groupBy(F.col("path").alias("origin"), F.col("name").alias("origin_name")).agg(F.min("kind").alias("kind"), F.min("shown").alias("shown"), F.min("line").alias("line"))
    reached = found.where("hops > 0").join(kinds, ["origin", "origin_name"], "left")
    shown = F.when(F.col("name") == "default", F.coalesce("shown", "name")).otherwise(F.col("name"))
    through = reached.select("path", shown.alias("name"), F.coalesce("kind", F.lit("?")).alias("kind"), F.lit(True).alias("is_export"), F.col("origin").alias("defined_in"), F.lit(None).cast("boolean").alias("external"), F.lit(True).alias("is_reexport"), (F.col("name") == "default").alias("is_default"), "line")
    lost = forwards.where("name <> '*'").join(found.select("path", "name"), ["path", "name"], "left_anti").join(nodes, "path", "left_semi")
    lost = lost.select("path", "name", F.lit("?").alias("kind"), F.lit(True).alias("is_export"), F.lit(None).cast("string").alias("defined_in"), F.lit(True).alias("external"), F.lit(True).alias("is_reexport"), (F.col("name") == "default").alias("is_default"), F.lit(None).cast("int").alias("line"))
    plain = declared.join(again.select("path", "name").distinct(), ["path", "name"], "left_anti")
    plain = plain.select("path", "name", "kind", "is_export", F.lit(None).cast("string").alias("defined_in"), F.lit(None).cast("boolean").alias("external"), F.lit(False).alias("is_reexport"), "is_default", "line")
    symbols = stable(plain.unionByName(through).unionByName(lost).dropDuplicates(["path", "name", "is_export"]))

    # edges: default imports take the name of what is the default there
    default = exported.where("is_default").groupBy(F.col("path").alias("target")).agg(F.min("name").alias("default_name"))
    runtime = here.where("not type_only").join(inside, "target", "left_semi").join(default, "target", "left")
    crossing = runtime.select(F.col("path").alias("src"), F.col("target").alias("dst"), "form", F.explode_outer(F.transform("names", lambda n: F.when((n == "default") & F.col("default_name").isNotNull(), F.col("default_name")).otherwise(n))).alias("name"))
    all_edges = stable(E.named_edges(crossing.where("src <> dst")))
    types = stable(E.type_only(here.where("type_only").join(inside, "target", "left_semi").select(F.col("path").alias("src"), F.col("target").alias("dst")).where("src <> dst"), all_edges))
    # a name that a file passes on is not a reference to it
    outward = forwards.select(F.col("path").alias("src"), F.col("target_name").alias("name")).distinct()
    references = crossing.where("name is not null and name not in ('*', 'default')").join(outward, ["src", "name"], "left_anti").groupBy(F.col("src").alias("path"), "name").agg(F.countDistinct("dst").alias("n"))

    calls = _call_edges(raw.join(nodes, "path", "left_semi"), imported, found, declared, exported)
    health = lookup.health(nodes.count(), here.where("not type_only and form = 'static' or form = 'side_effect'").select(expected_local(F.col("spec")).alias("expected_local"), F.col("target").isNotNull().alias("resolved")))
    skipped = raw.where("error in ('stack-overflow', 'parse-error')").count()
    meta = health.select(F.lit(S.SCHEMA_VERSION).alias("schema"), F.lit("").alias("source_version"), F.lit(nodes.count()).cast("long").alias("file_count"), F.lit(skipped).cast("long").alias("skipped_count"), "edge_coverage", "degraded")
    return {
        "files": listed.join(nodes, "path", "left_semi").select("path", "text", "rsc", "feature"), "symbols": symbols, "edges": all_edges, "type_edges": types,
        "references": references, "calls": calls, "meta": meta, "skipped": raw.where("error in ('stack-overflow', 'parse-error')").select("path", "error"),
    }


def _call_edges(raw: DataFrame, imported: DataFrame, found: DataFrame, declared: DataFrame, exported: DataFrame) -> DataFrame:
    """Call edges whose callee an import or the file's own top level binds; all others are left out rather than guessed."""
    calls = raw.select("path", F.explode("calls").alias("c")).select("path", "c.*")
    sites = ["path", "line", "owner", "owner_line", "kind"]
    bare = calls.where("base is null")
    # the file's own declarations, under their name and under all names that they are exported as
    top = declared.where("kind <> '?'").select("path", F.col("local").alias("name"), F.col("name").alias("callee_name"), F.col("kind").alias("callee_kind"), F.col("line").alias("callee_line"))
    top = top.union(top.select("path", "name", F.col("name").alias("callee_name"), "callee_kind", "callee_line")).distinct()
    own = bare.join(top, ["path", "name"]).select(*sites, F.col("path").alias("callee_file"), "callee_name", "callee_line", "callee_kind")
    direct = bare.join(imported.where("target is not null and target_name <> '*'").select("path", F.col("local").alias("name"), "target", "target_name"), ["path", "name"])
    spaces = calls.where("base is not null").join(imported.where("target is not null and target_name = '*'").select("path", F.col("local").alias("base"), "target"), ["path", "base"]).withColumn("target_name", F.col("name"))
    reached = direct.select(*sites, "target", "target_name").union(spaces.select(*sites, "target", "target_name"))
    reached = reached.join(found.select(F.col("path").alias("target"), F.col("name").alias("target_name"), "origin", "origin_name"), ["target", "target_name"])
    # where it is declared, under that name and all others it is exported as there
    held = exported.where("kind <> '?'").select(F.col("path").alias("origin"), F.when(F.col("is_default"), "default").otherwise(F.col("name")).alias("origin_name"), "local", F.col("kind").alias("callee_kind"), F.col("line").alias("callee_line"))
    held = held.union(held.join(exported.where("is_default").select(F.col("path").alias("origin"), "local", "name"), ["origin", "local"]).select("origin", "name", "local", "callee_kind", "callee_line")).distinct()
    names = exported.select(F.col("path").alias("origin"), "local", F.col("name").alias("callee_name"))
    names = names.union(names.select("origin", "local", "local")).where("callee_name <> 'default'").distinct()
    reached = reached.join(held, ["origin", "origin_name"]).join(names, ["origin", "local"])
    every = own.unionByName(reached.select(*sites, F.col("origin").alias("callee_file"), "callee_name", "callee_line", "callee_kind")).distinct()
    return stable(every.select(F.col("path").alias("caller_file"), F.col("line").alias("caller_line"), F.col("owner").alias("caller_name"), F.col("owner_line").alias("caller_decl_line"), "callee_file", "callee_name", "callee_line", "callee_kind", "kind"))
