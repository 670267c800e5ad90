"""Route tables from file names, and matching URLs against them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import ancestors, normalize_url, url_of
from ..session import prepared
from ..sources.lexer import read_source

ROUTE_FILE = r"(^|/)(page|route|layout)\.(t|j)sx?$"


def app_folder(files: DataFrame) -> str | None:
    """app, else src/app, whichever has route files; None where the question doesn't apply."""
    hit = files.where(F.col("path").rlike(ROUTE_FILE)).agg(F.max(F.col("path").startswith("app/")), F.max(F.col("path").startswith("src/app/"))).first()
    return "app" if hit[0] else "src/app" if hit[1] else None


def exported(files: DataFrame) -> DataFrame:
    """path, methods, alias of route files (path, text): the HTTP methods that a file exports, and where it forwards its default from."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                facts = read_source(text or "")
                names = {s["name"] for s in facts.symbols if s["is_export"]}
                alias = [i["spec"] for i in facts.imports if i["form"] == "reexport" and {"local": "default", "name": "default"} in i["locals"]]
                rows.append({"path": path, "methods": [m for m in S.HTTP_METHODS if m in names], "alias": alias[0] if alias else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("methods", pa.list_(pa.string())), ("alias", pa.string())]))

    prepared(files.sparkSession)
    return files.select("path", "text").mapInArrow(run, "path string, methods array<string>, alias string")


def route_table(files: DataFrame) -> DataFrame | None:
    """url, kind, path, methods, alias, layouts, boundary of ``files`` (path, text, rsc); None without an app folder.

    ``layouts`` are those of all folders above a page, outermost first, groups included; handlers have none.
    """
    app = app_folder(files)
    if app is None:
        return None
    own = files.where(F.col("path").startswith(f"{app}/") & F.col("path").rlike(ROUTE_FILE))
    for c in ("text", "rsc"):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast("string"))
    kind = F.when(F.col("path").rlike(r"(^|/)page\."), "page").when(F.col("path").rlike(r"(^|/)route\."), "route")
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    rows = own.withColumn("kind", kind).withColumn("folder", folder)
    said = rows.where("kind is not null").select("path", "text")
    routes = rows.where("kind is not null").join(exported(said), "path", "left").select(
        url_of(F.expr(f"substring(folder, {len(app) + 1})")).alias("url"), "kind", "path",
        F.when(F.col("kind") == "route", F.coalesce("methods", F.array().cast("array<string>"))).alias("methods"), "alias", F.col("rsc").alias("boundary"),
    )
    layouts = rows.where(F.col("path").rlike(r"(^|/)layout\.(t|j)sx?$")).groupBy("folder").agg(F.max("path").alias("layout"))
    above = routes.where("kind = 'page'").select("path", F.explode(ancestors(F.col("path"))).alias("folder")).where(F.col("folder").startswith(app))
    chains = above.join(layouts, "folder").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.length("folder").alias("n"), "layout"))), lambda x: x["layout"]).alias("layouts"))
    out = routes.join(chains, "path", "left").withColumn("layouts", F.coalesce("layouts", F.array().cast("array<string>")))
    return out.select("url", "kind", "path", "methods", "alias", "layouts", "boundary").orderBy("url", "kind", "path")


def match_routes(routes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, url, path: the routes of each ``query``, a URL or a file.

    A route's own URL, file or file ending wins over patterns. A catch-all compares its fixed segments only, so a required
    one matches its bare URL too.
    """
    q = queries.select("query").distinct().withColumn("norm", normalize_url(F.col("query")))
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    q = q.withColumn("parts", parts(F.col("norm")))
    r = routes.select("url", "path").distinct()
    own_url = q.join(r, F.col("norm") == F.col("url")).select("query", "url", "path")
    folders = F.split("path", "/")
    ends = r.select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, n, F.size(folders)), "/"))).alias("query"))
    direct = own_url.union(q.select("query").join(ends, "query").select("query", "url", "path")).distinct()

    # Patterns join by their number of segments (catch-alls by none) and their first segment, where that is fixed.
    own = parts(F.col("url"))
    r = r.withColumn("rest", F.exists(own, lambda s: s.startswith("*"))).withColumn("size", F.size(own)).withColumn("fixed", F.filter(own, lambda s: ~s.startswith("*")))
    first = F.coalesce(F.get("fixed", F.lit(0)), F.lit(":"))
    r = r.withColumn("key", F.concat_ws("/", F.when(F.col("rest"), "*").otherwise(F.col("size").cast("string")), F.when(first.startswith(":"), ":").otherwise(first)))
    begin = F.coalesce(F.get("parts", F.lit(0)), F.lit(":"))
    keys = F.array_distinct(F.array(*[F.concat_ws("/", a, b) for a in (F.lit("*"), F.size("parts").cast("string")) for b in (F.lit(":"), begin)]))
    fits = F.forall(F.arrays_zip(F.col("fixed").alias("s"), F.transform("fixed", lambda s, i: F.get(F.col("parts"), i)).alias("p")), lambda x: x["s"].startswith(":") | F.coalesce(x["s"] == x["p"], F.lit(False)))
    patterns = q.withColumn("key", F.explode(keys)).join(r, "key").where(fits).select("query", "url", "path").distinct()
    return direct.union(patterns.join(direct.select("query").distinct(), "query", "left_anti"))
