"""Trees of all names, logs of changed files, maps that follow a working tree, and a lexer that stays linear."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import closure, edges, lexical, routes
from codeloom.plans.api import CodeMap, UsageError
from codeloom.session import release, stable
from codeloom.sources.files import list_tree, read_tree
from codeloom.sources.lexer import read_source
from codeloom.sources.provider import source_facts
from codeloom.sources.store import FactLog
from codeloom.sources.worktree import current_state, read_worktree
from codeloom.streaming.refresh import refresh_map


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


TREE = {"core.ts": "export function core() {}", "lib/_app.tsx": "import { core } from '../core'; core();", "lib/__tests__/a.test.ts": "import { core } from '../../core'; core();", ".eslintrc.js": "module.exports = {}", "a/b/c/.hidden/x.ts": "", "node_modules/y.ts": ""}


def test_tree_has_all_names(spark, tmp_path):
    put(tmp_path, TREE | {"/".join("d" * 39) + "/in.ts": "1", "/".join("d" * 45) + "/out.ts": "1"})
    os.symlink(tmp_path / "core.ts", tmp_path / "link.ts")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    got = {r["path"] for r in list_tree(spark, str(tmp_path)).collect()}
    assert got == (set(TREE) - {"node_modules/y.ts"}) | {"/".join("d" * 39) + "/in.ts"}
    texts = {r["path"]: (r["text"], r["size"]) for r in read_tree(spark, f"file://{tmp_path}").collect()}
    assert set(texts) == got and texts["core.ts"] == (TREE["core.ts"], len(TREE["core.ts"]))
    assert list_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_map_follows_a_worktree(spark, tmp_path):
    repo, root = tmp_path / "repo", str(tmp_path / "map")
    put(repo, TREE)
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(repo), *args], check=True)
    first = CodeMap.of(spark, str(repo), root)
    assert {(r["path"], r["is_test"]) for r in first.affected("core.ts").collect()} == {("lib/_app.tsx", False), ("lib/__tests__/a.test.ts", True)}
    assert first.covered("core.ts").first().asDict() == {"file": "core.ts", "dependents": 2, "tests": 1, "covered": True}
    with pytest.raises(UsageError):
        first.affected("nowhere.ts")
    parts = {(r["part"], r["path"]) for r in first.relates("core.ts").collect()}
    assert {("file", "core.ts"), ("export", "core"), ("dependent", "lib/_app.tsx"), ("related", "lib/_app.tsx")} <= parts
    assert CodeMap.of(spark, str(repo), root) is first
    stored = CodeMap.load(spark, root)
    assert [r["name"] for r in stored.search("core").collect()] == ["core"] and stored.index is not None and stored.skips().count() == 0
    put(repo, {"core.ts": "export function center() {}"})
    os.remove(repo / "lib/_app.tsx")
    second = CodeMap.of(spark, str(repo), root)
    assert second is not first and second.find("center").count() == 1 and {r["path"] for r in second.affected("core.ts").collect()} == {"lib/__tests__/a.test.ts"}
    assert {r["path"] for r in read_worktree(spark, str(repo)).collect()} == set(TREE) - {"lib/_app.tsx"}
    plain = tmp_path / "plain"
    put(plain, {"a.ts": "1"})
    before = current_state(spark, str(plain))
    put(plain, {"a.ts": "12"})
    assert before[0] == "" and before != current_state(spark, str(plain))


def test_fact_log(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "path string, n int")
    log = FactLog(spark, str(tmp_path / "log"))
    assert log.read() is None
    log.compact()
    log.write(0, rows(("a", 0), ("b", 0), ("c", 0)), rows(("a", 1), ("a", 2), ("b", 3)))
    log.write(1, rows(("a", 0), ("c", 0)), rows(("c", 4)))
    want = [("b", 3), ("c", 4)]
    held = lambda: sorted(tuple(r) for r in log.read().select("path", "n").collect())
    assert held() == want
    log.compact()
    assert held() == want and len(os.listdir(tmp_path / "log" / "facts")) == 1
    log.write(1, rows(("a", 0), ("c", 0)), rows(("c", 4)))  # a batch that runs again
    log.write(2, rows(("b", 0)), rows().limit(0))
    log.compact()
    assert held() == [("c", 4)]


def test_map_of_a_stream_equals_a_full_build(spark, tmp_path):
    schema, folder = "path string, text string, removed boolean", str(tmp_path / "changes")
    batches = [
        [("a.ts", "export const a = 1;\nexport const z = 1;", False), ("b.ts", "import { a } from './a';", False), ("c.ts", "export * from './a';", False), ("d.ts", "import { a } from './c';", False)],
        [("a.ts", "export const a = 2;", False), ("b.ts", None, True), ("e.ts", "import { a } from './c'; import './d'", False)],
        [("c.ts", "", False), ("d.ts", None, True), ("f.ts", "import { a } from './c';\nimport { a as x } from './a';", False)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    refresh_map(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), str(tmp_path / "kept"), spark)
    got = CodeMap.load(spark, str(tmp_path / "kept" / "map"))
    files = spark.createDataFrame([("a.ts", batches[1][0][1]), ("c.ts", ""), ("e.ts", batches[1][2][1]), ("f.ts", batches[2][2][1])], "path string, text string")
    want = CodeMap.build(files, source_facts)
    for table in ("symbols", "edges", "ranks", "references", "calls", "type_edges"):
        rows = [sorted(map(str, getattr(m, table).select(*sorted(getattr(want, table).columns)).collect())) for m in (got, want)]
        assert rows[0] == rows[1], table


def test_truncation_is_told(spark):
    calls = spark.createDataFrame([(f"f{i}", i, f"c{i}", i, "core", "x", 1, "F", "call") for i in range(6)] + [("g", 9, "top", 9, "f3", "c3", 3, "F", "call")], "caller_file string, caller_line int, caller_name string, caller_decl_line int, callee_file string, callee_name string, callee_line int, callee_kind string, kind string")
    told = lambda **caps: {(r["truncated"]) for r in closure.call_closure(calls, "core", "x", 3, **caps).collect()}
    count = lambda **caps: closure.call_closure(calls, "core", "x", 3, **caps).count()
    assert told() == {False} and count() == 7
    assert told(node_cap=6) == {True} and count(node_cap=6) == 6
    assert told(frontier_cap=2) == {True} and count(frontier_cap=2) == 6
    assert told(frontier_cap=6) == {False}


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(20)], "src string, dst string")
    got = {r["path"]: r["hop"] for r in closure.transitive_dependents(chain, spark.createDataFrame([("n0",)], "path string")).collect()}
    assert got == {f"n{i}": i for i in range(1, 21)}


def test_released_checkpoints_are_gone(spark, tmp_path):
    df = stable(spark.range(5))
    path = df.written.split(":", 1)[1]
    assert os.path.isdir(path)
    release(df)
    assert not os.path.exists(path)


@pytest.mark.parametrize("text", ["function f(a){ return g(a) }\n" * 8000, "<div " * 20000, "function a " * 20000, "const f = (a: " * 10000, "class A { m(){ x() } }\n" * 8000])
def test_lexer_takes_linear_time(text):
    begin = time.perf_counter()
    read_source(text)
    assert time.perf_counter() - begin < 20


def test_routes_take_methods_from_exports(spark):
    text = "// export function DELETE() {}\nexport async function GET() {}\nconst POST = 1;\nexport { POST };"
    files = spark.createDataFrame([("app/api/route.ts", text), ("app/x/page.tsx", "export { default } from '../y/page';")], "path string, text string")
    got = {r["url"]: (r["methods"], r["alias"]) for r in routes.route_table(files).collect()}
    assert got == {"/api": (["GET", "POST"], None), "/x": (None, "../y/page")}


def test_scan_equals_index(spark):
    rows = [(f"d{i}", ["red"] * (i % 3) + ["big"] * (i % 2) + ["x"] * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "path string, tokens array<string>")
    want = lexical.bm25(lexical.build_index(docs, ["path"]), "red big red", ["path"]).collect()
    assert sorted(want) == sorted(lexical.bm25_scan(docs, "red big red", ["path"]).collect()) and len(want) > 10


def test_searchable_hides_credentials(spark):
    names = ["a.ts", ".env", "x/.env.local", "prod.env", "k/id_rsa.pub", "mySecrets.ts", "deep/a.pem", "token.ts", ".npmrc", "env.ts"]
    left = {r["path"] for r in lexical.searchable(spark.createDataFrame([(x, "") for x in names], "path string, text string")).collect()}
    assert left == {"a.ts", "token.ts", "env.ts"}


def test_hit_rates(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1), ("r", "d", 4)], "query string, path string, pos int")
    true = spark.createDataFrame([("q", "b"), ("r", "d"), ("s", "z")], "query string, path string")
    assert edges.hit_rates(ranked, true).first().asDict() == {"queries": 3, "top1": 0.0, "top3": 0.333333}
    assert edges.token_ratio(spark.createDataFrame([(10, 5), (9, 3), (4, 1), (1, 0)], "baseline long, answer long")).first()["median_ratio"] == 3.0 and F is not None
