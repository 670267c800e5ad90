"""Fact tables read from the driver's business tables, shaped like those of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import feature_of


_FACTS: dict[tuple[str, str], dict[str, DataFrame]] = {}


class Tables:
    """The tables of one folder, and the facts made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def trade(self) -> DataFrame:
        """Edges customer -> part, weight: the lines bought."""
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
        rows = lines.join(self.read("orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
        return rows.select(F.concat(F.lit("customer/"), "o_custkey").alias("src"), F.concat(F.lit("part/"), "l_partkey").alias("dst"), F.col("n").cast("double").alias("weight"))

    def _sales(self) -> DataFrame:
        """One row per line with the nations of its buyer and its seller."""
        nation = self.read("nation").select("n_nationkey", "n_name")
        buyer = self.read("customer").join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("buyer"))
        seller = self.read("supplier").join(nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("seller"))
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
        return lines.join(self.read("orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(buyer, "o_custkey").join(seller, "l_suppkey").select("buyer", "seller", "l_partkey")

    def nations(self) -> DataFrame:
        """Edges buyer nation -> seller nation, weight: the lines sold."""
        return self._sales().groupBy(F.col("buyer").alias("src"), F.col("seller").alias("dst")).agg(F.count("*").cast("double").alias("weight"))

    def brand_sites(self) -> DataFrame:
        """Import sites src, dst, name: the brands that cross between nations."""
        brand = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
        return self._sales().join(brand, "l_partkey").select(F.col("buyer").alias("src"), F.col("seller").alias("dst"), "name").distinct()

    def supply(self) -> DataFrame:
        """Edges customer -> part -> supplier -> nation -> region, without weights."""
        line = self.read("lineitem").select("l_partkey", "l_suppkey").distinct()
        part_supplier = line.select(F.concat(F.lit("part/"), "l_partkey").alias("src"), F.concat(F.lit("supplier/"), "l_suppkey").alias("dst"))
        supplier_nation = self.read("supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("src"), F.concat(F.lit("nation/"), "s_nationkey").alias("dst"))
        nation_region = self.read("nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("src"), F.concat(F.lit("region/"), "n_regionkey").alias("dst"))
        return self.trade().select("src", "dst").union(part_supplier).union(supplier_nation).union(nation_region)

    def exports(self) -> DataFrame:
        """path, name, kind: a part's plain name and its long one, defined in the file brand/type."""
        part = self.read("part")
        names = F.explode(F.array(F.col("p_name"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_size")))
        return part.select(F.concat_ws("/", "p_brand", "p_type").alias("path"), names.alias("name"), F.col("p_type").alias("kind")).distinct()

    def references(self) -> DataFrame:
        """path, name, n: a nation's buyers refer to the names of the parts they buy."""
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.array(F.col("p_name"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_size"))).alias("name"))
        bought = self._sales().groupBy("buyer", "l_partkey").agg(F.count("*").alias("n"))
        return bought.join(part, "l_partkey").groupBy(F.concat(F.lit("nation/"), "buyer").alias("path"), "name").agg(F.sum("n").alias("n"))

    def file_ranks(self) -> DataFrame:
        """path, rank of the files of ``exports``: their share of all lines."""
        lines = self.read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
        rows = self.read("part").join(lines, "p_partkey").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("path")).agg(F.sum("n").alias("n"))
        total = self.read("lineitem").count()
        return rows.select("path", F.round(F.col("n") / F.lit(total), 6).alias("rank"))

    def pages(self) -> DataFrame:
        """path, feature, text: pages as files app/<section>/<number>/page.tsx."""
        inner = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/+$", "")
        path = F.concat(F.lit("app/"), inner, F.lit("/page.tsx"))
        return self.read("pages").select(path.alias("path"), "html").groupBy("path").agg(F.min("html").alias("text")).withColumn("feature", feature_of(F.col("path")))

    def links(self) -> DataFrame:
        """src, spec: the links of each page."""
        return self.pages().select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit('href="([^"]*)"'), F.lit(1))).alias("spec")).distinct()

    def route_files(self) -> DataFrame:
        """path, text, rsc: pages as routes with groups, parameters, catch-alls and layouts."""
        rows = self.read("pages").select(F.regexp_extract("url", "^(https?)://", 1).alias("group"), F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("section"), F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)/", 1).alias("top")).distinct()
        paths = F.explode(F.array(F.concat(F.lit("app/("), "group", F.lit(")/"), "section", F.lit("/[id]/page.tsx")), F.concat(F.lit("app/("), "group", F.lit(")/"), "section", F.lit("/layout.tsx")), F.concat(F.lit("app/api/"), "top", F.lit("/[...rest]/route.ts")), F.lit("app/layout.tsx"), F.lit("app/page.tsx")))
        files = rows.select(paths.alias("path")).distinct()
        text = F.when(F.col("path").endswith("route.ts"), "export async function GET() {}\nexport const POST = handler").otherwise("export default function Page() {}")
        return files.select("path", text.alias("text"), F.when(F.col("path").endswith("page.tsx"), "client").alias("rsc"))

    def source_tree(self) -> DataFrame:
        """path, text: a TypeScript repository written from the tables: regions, nations that import them, suppliers that import nations.

        It has a barrel and a barrel of that, path aliases, a workspace package, tests, a component, a declaration file and what a map must leave out.
        """
        text = lambda *lines: F.concat_ws("\n", *[F.format_string(x, *args) if args else F.lit(x) for x, *args in lines])
        k = F.col("k")
        regions = self.read("region").select(F.col("r_regionkey").alias("k"), "r_name")
        nations = self.read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), F.pmod(F.col("n_regionkey") + 1, F.lit(5)).alias("j"))
        suppliers = self.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
        out = regions.select(F.format_string("src/regions/r%d.ts", k).alias("path"), text(
            ('export const REGION%d = "%s";', k, F.col("r_name")), ("export interface Shape%d { id: number }", k), ("export default function region%d() { return REGION%d; }", k, k),
        ).alias("text"))
        out = out.union(nations.select(F.format_string("src/nations/n%d.ts", k), text(
            ("'use %s';", F.when(k % 2 == 1, "client").otherwise("strict")), ("import region, { REGION%d as label } from '../regions/r%d.js';", F.col("r"), F.col("r")),
            ("import type { Shape%d } from '@/regions/r%d';", F.col("j"), F.col("j")), ("import './setup';",), ("// import { no } from './comment';",), ("const local%d = `import x from './no'`;", k),
            ("export class Nation%d {}", k), ("export function nation%d() { return region(label) + helper%d(); }", k, k), ("function helper%d() { return new Nation%d(); }", k, k),
        )))
        out = out.union(nations.select(F.format_string("src/nations/__tests__/n%d.test.ts", k), text(("import { nation%d } from '../n%d';", k, k), ("nation%d();", k))))
        out = out.union(suppliers.select(F.format_string("src/suppliers/s%d.tsx", k), text(
            ("import { nation%d as home } from '@/nations';", F.col("n")), ("import { Nation%d } from '@acme/nations/n%d';", F.col("n"), F.col("n")), ("const lazy = import('../nations/n%d');", F.col("n")),
            ("export const Supplier%d = () => { home(); return <Card%d /> };", k, k), ("export { Supplier%d as Alias%d };", k, k), ("const Card%d = () => null;", k),
        )))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: F.concat(F.lit("export * from './n"), x.cast("string"), F.lit("';"))), "\n")
        out = out.union(nations.agg(lines.alias("text")).select(F.lit("src/nations/index.ts"), "text"))
        fixed = {
            "src/index.ts": "export { Nation0 as First } from './nations';\nexport * from './nations';", "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"]}}}',
            "src/nations/package.json": '{"name": "@acme/nations"}', "src/Card.vue": "<template/><script setup lang=\"ts\">import { REGION0 } from './regions/r0'; const shown = REGION0</script>",
            "types/globals.d.ts": "export type X = 1;", "node_modules/x/index.js": "export const no = 1;", "dist/out.js": "export const no = 1;", "README.md": "text",
        }
        return out.union(self.spark.createDataFrame(list(fixed.items()), "path string, text string"))

    def source_facts(self) -> dict[str, DataFrame]:
        """The facts of ``source_tree``, made once in a session."""
        from .provider import source_facts

        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _FACTS:
            _FACTS[key] = source_facts(self.source_tree(), ["dist/"])
        return _FACTS[key]

    def steps(self) -> DataFrame:
        """Call edges: within a user, each event type calls the type of the user's next event."""
        order = W.partitionBy("user_id").orderBy("ts", "event_id")
        rows = self.read("events").select("user_id", "event_id", "event_type", F.lead("event_type").over(order).alias("callee")).where("callee is not null")
        own, other = F.concat(F.lit("user/"), F.pmod("user_id", F.lit(40))), F.concat(F.lit("user/"), F.pmod(F.col("user_id") + 1, F.lit(40)))
        return rows.select(own.alias("caller_file"), F.col("event_id").cast("int").alias("caller_line"), F.col("event_type").alias("caller_name"), F.length("event_type").alias("caller_decl_line"), other.alias("callee_file"), F.col("callee").alias("callee_name"), F.length("callee").alias("callee_line"), F.lit("FunctionDeclaration").alias("callee_kind"), F.lit("call").alias("kind"))

    def documents(self) -> DataFrame:
        """path, text."""
        return self.read("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
