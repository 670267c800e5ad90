import pytest
from pyspark.sql import functions as F

from codeloom.functions import ident_multiplier, subtokens
from codeloom.operators import closure, edges, lookup, pagerank, symbols


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def ranks(df):
    return {r["node"]: r["rank"] for r in df.collect()}


@pytest.mark.parametrize("kernel", [1_000_000, 0])
def test_hub_outranks_leaves_and_self_loops_are_ignored(spark, kernel):
    plain = ranks(pagerank.pagerank(edge_table(spark, [("a", "b", 1.0), ("c", "b", 1.0)]), kernel_edges=kernel))
    looped = ranks(pagerank.pagerank(edge_table(spark, [("a", "b", 1.0), ("c", "b", 1.0), ("b", "b", 5.0)]), kernel_edges=kernel))
    assert plain["b"] > plain["a"] == pytest.approx(plain["c"])
    assert sum(plain.values()) == pytest.approx(1) and looped == pytest.approx(plain)


def test_both_physical_forms_agree(spark):
    rows = [(f"n{i * 7 % 13}", f"n{i * 5 % 11}", float(i % 4)) for i in range(60)]
    seeds = spark.createDataFrame([("n3", 2.0), ("n5", 1.0), ("zz", 9.0), ("n4", -1.0)], "node string, value double")
    a = ranks(pagerank.pagerank(edge_table(spark, rows), personalization=seeds))
    b = ranks(pagerank.pagerank(edge_table(spark, rows), personalization=seeds, kernel_edges=0))
    assert a == pytest.approx(b, abs=1e-12)


def test_edges_of_unknown_nodes_do_not_count(spark):
    rows = edge_table(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("c", "zz", 9.0), ("zz", "a", 4.0), ("c", "a", 1.0)])
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    small, large = (ranks(pagerank.pagerank(rows, nodes, kernel_edges=k)) for k in (1_000_000, 0))
    assert set(small) == {"a", "b", "c", "d"} and small == pytest.approx(large, abs=1e-12) and sum(small.values()) == pytest.approx(1)


def test_empty_graph(spark):
    assert pagerank.pagerank(edge_table(spark, [])).count() == 0


def test_hubs_of_a_star(spark):
    star = [(f"f{i}", "core", 1.0) for i in range(5)] + [("f0", "mid", 1.0), ("f1", "mid", 1.0)]
    got = pagerank.hubs(edge_table(spark, star)).orderBy(F.desc("pagerank"), "path").collect()
    assert [(r["path"], r["in_degree"]) for r in got[:2]] == [("core", 5), ("mid", 2)]
    assert all(a["pagerank"] >= b["pagerank"] for a, b in zip(got, got[1:]))


def test_multiplier(spark):
    rows = spark.createDataFrame([("foo", 1), ("longSnake_name", 1), ("_x", 1), ("foo", 9), ("camelCaseName", 9)], "name string, n int")
    got = [r[0] for r in rows.select(ident_multiplier(F.col("name"), F.col("n"))).collect()]
    assert got == pytest.approx([1.0, 10.0, 0.1, 0.1, 1.0])


def test_tokens(spark):
    rows = spark.createDataFrame([("rankMatches",), ("HTTPClient2x",), ("src/lib/http2Client.ts",), ("",)], "s string")
    assert [r[0] for r in rows.select(subtokens(F.col("s"))).collect()] == [["rank", "matches"], ["http", "client", "2", "x"], ["src", "lib", "http", "2", "client", "ts"], []]


def test_affected_hops_cycles_and_type_edges(spark):
    run = edge_table(spark, [("mid", "core", 1.0), ("x/mid.test.ts", "mid", 1.0), ("tests/core.ts", "core", 1.0), ("core", "mid", 1.0), ("latest/a.ts", "mid", 1.0)])
    types = spark.createDataFrame([("typed", "core")], "src string, dst string")
    start = spark.createDataFrame([("core",)], "path string")
    got = {r["path"]: (r["hop"], r["is_test"]) for r in closure.affected(run, start, types).collect()}
    assert got == {"mid": (1, False), "x/mid.test.ts": (2, True), "tests/core.ts": (1, True), "latest/a.ts": (2, False), "typed": (1, False)}


def call_table(spark, rows):
    full = [(f"{a}.ts", i + 1, a, 10, f"{b}.ts", b, 10, "FunctionDeclaration", "call") for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(full, "caller_file string, caller_line int, caller_name string, caller_decl_line int, callee_file string, callee_name string, callee_line int, callee_kind string, kind string")


def test_call_closure(spark):
    calls = call_table(spark, [("top", "mid"), ("mid", "leaf"), ("a", "b"), ("b", "a")])
    got = {r["name"]: (r["depth"], r["via"]) for r in closure.call_closure(calls, "leaf.ts", "leaf", 2).collect()}
    assert got == {"mid": (1, None), "top": (2, "mid.ts:mid:10")}
    down = {r["name"]: r["depth"] for r in closure.call_closure(calls, "top.ts", "top", 9, direction="calls").collect()}
    assert down == {"mid": 1, "leaf": 2}
    assert closure.call_closure(calls, "a.ts", "a", 5).count() == 2
    assert closure.call_closure(calls, "no.ts", "no", 3).count() == 0
    assert [closure.clamp_depth(x) for x in (-1, 3, 99)] == [1, 3, 5]


def test_symbol_cap_puts_the_hub_first(spark):
    names = spark.createDataFrame([("leaf.ts", f"symLeaf{i}", "FunctionDeclaration") for i in range(60)] + [("hub.ts", "symHub", "FunctionDeclaration")], "path string, name string, kind string")
    got = lookup.find_symbol(names, spark.createDataFrame([("hub.ts", 0.5), ("leaf.ts", 0.1)], "path string, rank double"), "SYM").orderBy("pos").collect()
    assert len(got) == 50 and got[0]["name"] == "symHub" and got[0]["total"] == 61 and got[0]["truncated"]


def test_declarations_come_before_barrels(spark):
    rows = spark.createDataFrame([("index.ts", "x", "k", "real.ts"), ("real.ts", "x", "k", None)], "path string, name string, kind string, defined_in string")
    got = lookup.find_symbol(rows, spark.createDataFrame([("index.ts", 0.9), ("real.ts", 0.1)], "path string, rank double"), "x").orderBy("pos").collect()
    assert [r["path"] for r in got] == ["real.ts", "index.ts"]
    assert [r["path"] for r in lookup.owners(rows, "x").collect()] == ["real.ts"]


def name_tables(spark):
    """Files that define and refer to names: common ones, one's own, one that only its definer refers to, missing ones, a null path."""
    defs = [(f"f{i}", f"name{i * j % 9}", "K") for i in range(14) for j in (1, 2, 5)] + [("f1", "mine", "K"), ("f2", "lone", "K"), (None, "name1", "K")]
    refs = [(f"f{i * 3 % 17}", f"name{i % 11}", i % 4 + 1) for i in range(60)] + [("f1", "mine", 3), ("f3", "default", 2), (None, "name2", 1), (None, "lone", 1)]
    return spark.createDataFrame(defs, "path string, name string, kind string"), spark.createDataFrame(refs, "path string, name string, n long")


@pytest.mark.parametrize("focus", [[], ["f2", "f5"]])
@pytest.mark.parametrize("nodes", [None, 12])
def test_ranks_through_names_equal_ranks_over_edges(spark, focus, nodes):
    exports, refs = name_tables(spark)
    nodes = nodes and spark.range(nodes).select(F.concat(F.lit("f"), "id").alias("node"))
    a, b = ([tuple(r) for r in symbols.symbol_rank(exports.where("path is not null"), refs.where("path is not null"), nodes, focus, kernel_edges=k).orderBy("pos").collect()] for k in (1_000_000, 0))
    assert a == b and len(a) > 20


def test_nobody_refers_to_these(spark):
    exports, refs = name_tables(spark)
    defs, used = [(r["path"], r["name"]) for r in exports.collect()], [(r["path"], r["name"]) for r in refs.collect()]
    want = {(p, n) for p, n in defs if not any(n == m and p and q and p != q for q, m in used)}
    assert {(r["path"], r["name"]) for r in symbols.unreferenced(exports, refs).collect()} == want and ("f1", "mine") in want


def test_digest_cuts_the_first_block_and_skips_what_does_not_fit(spark):
    rows = [("a.ts", f"name{i}" + "x" * 15, "Kind", i + 1) for i in range(4)] + [("a-very-long-file-name-that-does-not-fit-at-all.ts", "other", "Kind", 5), ("b.ts", "z", "K", 6)]
    ranked = spark.createDataFrame(rows, "path string, name string, kind string, pos int")
    got = {r["path"]: (r["at"], r["names"]) for r in symbols.digest(ranked, 14).collect()}
    assert got == {"a.ts": (1, "name0" + "x" * 15), "b.ts": (2, "z")}


def test_drawings(spark):
    run = edge_table(spark, [('a"b', "c", 1.0), ("c", "d", 1.0)])
    rank = spark.createDataFrame([('a"b', 0.2), ("c", 1.0), ("d", 0.5)], "path string, rank double")
    dot = [r["line"] for r in edges.dot(*edges.drawn(run, rank)).orderBy("line_no").collect()]
    assert dot[0] == "digraph map {" and dot[-1] == "}" and '  "a\\"b" -> "c";' in dot and '  "c" [class="hub"];' in dot
    mermaid = [r["line"] for r in edges.mermaid(*edges.drawn(run, rank)).orderBy("line_no").collect()]
    assert mermaid == ["flowchart LR", '  n0["c"]:::hub', '  n1["d"]:::hub', '  n2["a&quot;b"]:::mid', "  n0 --> n1", "  n2 --> n0"]


def test_doctor_and_census(spark):
    meta = spark.createDataFrame([(5, 1, 1.0, False, "a", "a"), (0, 0, 1.0, False, "a", "a"), (5, 0, 0.0, True, "a", "a"), (5, 0, 1.0, False, "a", "b"), (5, 0, 1.0, False, "a", "a")], "file_count long, skipped_count long, edge_coverage double, degraded boolean, source_version string, current_version string")
    assert [r["status"] for r in lookup.doctor(meta).collect()] == ["incomplete", "empty", "degraded", "stale", "ok"]
    files = spark.createDataFrame([("supported",)] * 7 + [("Python",)] * 3, "language string")
    assert lookup.census(files, "language", F.col("language") == "supported").collect()[0]["top"] == "Python"
    assert lookup.census(files, "language", F.col("language") == "supported", 0.31).count() == 0
