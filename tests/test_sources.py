import re

import pytest
from pyspark.sql import functions as F

from codeloom.plans.api import CodeMap, UsageError, as_json
from codeloom.sources.configs import bundler_aliases, compiler_paths, import_map, package_rules, relaxed_json
from codeloom.sources.files import ignore_pattern, languages, read_tree, sources
from codeloom.sources.lexer import read_source
from codeloom.sources.provider import source_facts
from codeloom.sources.sfc import script_of
from codeloom.sources.store import MapStore, upsert

TREE = {
    "src/core.ts": "export function foo() { return 1; }\nexport const bar = 2;\nfunction priv() { foo(); }\n",
    "src/a.ts": 'import { foo } from "./core";\nimport Def from "./def.js";\nexport function useA() { foo(); Def(); }\n',
    "src/def.ts": "export default function Deflt() { return bar2(); }\nfunction bar2() {}\n",
    "src/index.ts": 'export * from "./core";\nexport { useA as renamed } from "./a";\nimport { bar } from "./core"; export { bar as bar3 };\n',
    "src/b.tsx": 'import { foo, renamed } from ".";\nimport * as ns from "./core";\nimport type { X } from "./types";\nexport const B = () => { renamed(); ns.foo(); return <Deep/>; };\nimport { Deep } from "@/deep";\n',
    "src/deep/index.ts": "export const Deep = () => null;\n",
    "src/types.ts": "export type X = number;\n",
    "src/decoy.ts": "function foo() {}\nexport const use = (foo) => foo();\n",
    "tsconfig.json": '{"compilerOptions":{"baseUrl":".","paths":{"@/*":["src/*"]}}}',
    "packages/p/package.json": '{"name":"@o/p","main":"dist/x.js","types":"src/main.ts","exports":{".":"./dist/x.js","./wild/*":"./src/w/*.ts"}}',
    "packages/p/src/main.ts": "export const pm = 1;\n",
    "packages/p/src/w/one.ts": "export const one1 = 1;\n",
    "app/layout.tsx": "export default function L() {}\n",
    "app/page.tsx": '"use client"\nimport { pm } from "@o/p";\nimport { one1 } from "@o/p/wild/one";\nimport missing from "./nope";\nimport none from "@o/p/wild/";\nexport default function Page() { pm(); }\n',
    "app/(shop)/cart/[id]/page.tsx": "export { default } from '../../../page';\n",
    "app/api/x/route.ts": "export async function GET() {}\nexport const POST = 1;\n",
    "src/a.test.ts": 'import "./a";\n',
    "src/C.vue": '<template><p/></template><script lang="ts" generic="T extends R<a>">export default { name: 1 }</script><script setup lang="ts">import { foo } from "./core";\nfoo();</script>',
    "src/T.vue": "<template><p/></template>",
    "src/g.d.ts": "export const dts = 1;\n",
}


@pytest.fixture(scope="module")
def code(spark):
    return CodeMap.build(spark.createDataFrame(list(TREE.items()), "path string, text string"), source_facts)


def pairs(df):
    return {(r["src"], r["dst"]): r["names"] for r in df.collect()}


def test_edges(code):
    got = pairs(code.edges)
    assert got["src/a.ts", "src/def.ts"] == ["Deflt"] and got["src/b.tsx", "src/index.ts"] == ["foo", "renamed"]
    assert got["src/b.tsx", "src/deep/index.ts"] == ["Deep"] and got["src/b.tsx", "src/core.ts"] == ["*"]
    assert got["app/page.tsx", "packages/p/src/main.ts"] == ["pm"] and got["app/page.tsx", "packages/p/src/w/one.ts"] == ["one1"]
    assert got["src/C.vue", "src/core.ts"] == ["foo"] and not any("nope" in d for _, d in got)
    assert [tuple(r) for r in code.type_edges.collect()] == [("src/b.tsx", "src/types.ts")]


def test_symbols_know_where_they_are_declared(code):
    got = {(r["path"], r["name"]): (r["defined_in"], r["is_export"]) for r in code.symbols.collect()}
    assert got["src/index.ts", "foo"] == ("src/core.ts", True) and got["src/index.ts", "bar3"] == ("src/core.ts", True)
    assert got["src/index.ts", "renamed"] == ("src/a.ts", True) and got["src/core.ts", "priv"] == (None, False) and got["src/core.ts", "foo"] == (None, True)
    assert not any(p.endswith((".d.ts", "T.vue")) for p, _ in got)


def test_call_edges(code):
    got = {(r["caller_file"], r["caller_name"], r["callee_file"], r["callee_name"], r["kind"]) for r in code.calls.collect()}
    assert {("src/a.ts", "useA", "src/core.ts", "foo", "call"), ("src/a.ts", "useA", "src/def.ts", "Deflt", "call"), ("src/b.tsx", "B", "src/a.ts", "useA", "call"), ("src/b.tsx", "B", "src/core.ts", "foo", "call")} <= got
    assert ("src/b.tsx", "B", "src/deep/index.ts", "Deep", "jsx") in got and ("src/C.vue", "<module>", "src/core.ts", "foo", "call") in got
    assert not any(a == "src/decoy.ts" for a, *_ in got)


def test_questions(code):
    assert [r["path"] for r in code.find("FOO").orderBy("pos").collect()][-1] == "src/index.ts"
    assert code.find("priv", include_locals=False).count() == 0
    assert {r["path"]: r["hop"] for r in code.affected("core.ts").collect()}["src/a.test.ts"] == 2
    assert {r["name"] for r in code.callers("foo", within="core").collect()} == {"useA", "B", "priv", "<module>"}
    assert {r["name"] for r in code.callees("useA").collect()} == {"foo", "Deflt"}
    assert code.hubs().first()["path"] == "src/core.ts"
    assert code.any("src/core.ts").first()["answer"] == "file" and code.any("priv").first()["answer"] == "symbol"
    assert code.any("where is the deflt").first()["answer"] == "lexical" and code.any("return 1").first()["answer"] in ("content", "lexical")
    assert code.search("the of and").count() == 0
    assert code.relates("def.ts").count() > 0 and code.digest(tokens=50).count() >= 1
    assert code.top_symbols(3).count() == 3 and code.top_symbols(5, focus=["src/a.ts"]).where("path = 'src/a.ts'").count() == 0
    with pytest.raises(UsageError):
        code.find("")
    with pytest.raises(UsageError):
        code.relates("nothing-here")
    assert "defined_in" not in as_json(code.symbols.where("path = 'src/core.ts'")).first()["json"]


def test_routes(code):
    got = {r["url"]: r for r in code.routes().collect()}
    assert set(got) == {"/", "/cart/:id", "/api/x"}
    assert got["/cart/:id"]["alias"] == "../../../page" and got["/cart/:id"]["layouts"] == ["app/layout.tsx"]
    assert got["/api/x"]["methods"] == ["GET", "POST"] and got["/api/x"]["layouts"] == [] and got["/"]["boundary"] == "client"
    assert code.route("/cart/7/").first()["path"] == "app/(shop)/cart/[id]/page.tsx"
    assert code.feature("cart").where("inside").count() == 1


def test_no_app_folder_is_not_an_empty_table(spark):
    from codeloom.operators.routes import route_table

    assert route_table(spark.createDataFrame([("src/x.ts", "")], "path string, text string")) is None


def test_store(code, spark, tmp_path):
    root = str(tmp_path / "map")
    assert CodeMap.load(spark, root) is None
    code.save(root, "v1")
    code.save(root, "v2")
    back = CodeMap.load(spark, root)
    assert pairs(back.edges) == pairs(code.edges) and back.doctor("v2").first()["status"] == "ok" and back.doctor("v3").first()["status"] == "stale"
    store = MapStore(spark, root)
    assert store.fresh("v2") and not store.fresh("v1") and store.latest() == 2


def test_upsert_equals_full(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, n int")
    old, new, gone = make([("a", 1), ("a", 2), ("b", 3), ("c", 4)]), make([("a", 9), ("d", 5)]), make([("c", 0)])
    assert sorted(map(tuple, upsert(old, new, gone).collect())) == [("a", 9), ("b", 3), ("d", 5)]


def test_ignore():
    p = re.compile(ignore_pattern(["# c", "", "/top", "dist/", "*.gen.ts", "a" * 600, "x" + "*" * 50 + "y"]))
    hit = lambda s: bool(p.search(s))
    assert hit("top") and not hit("a/top") and hit("pkg/dist/z.ts") and hit("q/w.gen.ts") and not hit("distant/a") and hit("x1y") and not hit("x/y")
    assert ignore_pattern(["# only"]) is None and not re.search(ignore_pattern(["dist"]), "dist/x")


def test_listing(spark, tmp_path):
    for name in ("a.ts", "node_modules/b.ts", "sub/c.d.ts", "sub/d.py", "sub/e.vue"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files = read_tree(spark, str(tmp_path))
    got = {r["path"]: r["is_node"] for r in sources(files).collect()}
    assert got == {"a.ts": True, "sub/c.d.ts": False, "sub/e.vue": True}
    assert {r["language"] for r in languages(files).collect()} == {"supported", "Python"}


def test_sfc():
    assert script_of('<script src="./x.js"></script><script>1</script>') == ("js", False, "1")
    assert script_of('<script>a</script><SCRIPT setup lang="TS">b</SCRIPT>') == ("ts", True, "b")
    assert script_of('<script generic="T extends Record<string, X>" lang="ts">k</script>') == ("ts", False, "k")
    assert script_of("<template/>") is None and script_of("<script>never ends") is None and script_of("<script> </script>") is None


def test_configs():
    assert relaxed_json('{"a": "// no", /* c */ "b": 1 // x\n}') == {"a": "// no", "b": 1} and relaxed_json("{,}") is None
    files = {"tsconfig.json": '{"extends": ["./base", "./tsconfig.json"], "compilerOptions": {}}', "base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["*"]}}}'}
    assert compiler_paths("tsconfig.json", files) == ("src", {"~/*": ["*"]})
    assert import_map({"imports": {"#a/*": {"node": "./n.js", "default": "./src/a/*.js"}, "b": "x"}}) == {"#a/*": ["src/a/*", "src/a/*.js"]}
    text = "export default { resolve: { alias: { '@': path.resolve(__dirname, 'src'), lib: './lib', fn: f, re: /x/ } } }"
    assert bundler_aliases(text) == {"@": "src", "lib": "./lib"}
    rules = package_rules("p/package.json", {"name": "n", "exports": {"./lib/*": "./a/*.js", "./lib/*.js": "./b/*.ts", "./no": None, ".": {"node": {"import": "./deep.js"}}}})
    order = [(r[1], r[2], r[4]) for r in sorted(rules, key=lambda r: r[5]) if r[1].startswith("n/lib")]
    assert order == [("n/lib/", ".js", "p/b/*.ts"), ("n/lib/", "", "p/a/*.js")] and ("", "n", "", True, "p/deep.js", 0, True) in rules


def test_lexer_on_hard_texts():
    f = read_source('const re = /["\'`{]/g, s = `a ${`b ${c()} }`} {`;\nexport { s as t };\n<p>don\'t {d()}</p>;\n// import "no"\n/* import "no" */ x = "import(\'no\')";')
    assert [s["name"] for s in f.symbols if s["is_export"]] == ["t"] and not f.imports
    assert {c["name"] for c in f.calls if c["kind"] == "call"} == {"c", "d"}
    f = read_source("'use strict'; 'use server';\nimport type, { a } from './x'; export default class extends Y {}")
    assert f.rsc == "server" and f.imports[0]["names"] == ["default", "a"] and f.symbols[0]["is_default"]
    for text in ("", "{", "import", "export {", "export default", "`${", "class", "const {", "import {a", "export * from"):
        read_source(text)


def test_worktree(spark, tmp_path):
    import subprocess

    from codeloom.sources.worktree import changes, head, parse_changes, read_worktree, state_token, tracked

    assert tracked(str(tmp_path)) == [] and head(str(tmp_path)) == ""
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for name, text in {"a.ts": "1", "b.ts": "2", ".gitignore": "out\n", "out/x.ts": "3"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "x")
    git("mv", "a.ts", "c d.ts")
    (tmp_path / "new").mkdir()
    (tmp_path / "new/é.ts").write_text("4")
    assert tracked(str(tmp_path)) == [".gitignore", "b.ts", "c d.ts", "new/é.ts"]
    assert changes(str(tmp_path)) == [("R", "c d.ts", "a.ts"), ("??", "new/é.ts", None)]
    assert {r["path"] for r in read_worktree(spark, str(tmp_path)).collect()} == {".gitignore", "b.ts", "c d.ts", "new/é.ts"}  # Spark passes over names that begin with a dot
    moved, apart = [("R", "b", "a")], [("A", "b", None), ("D", "a", None)]
    assert state_token("h", moved, {"b": "1"}) != state_token("h", apart, {"b": "1"}) != state_token("g", apart, {"b": "1"})
    assert state_token("h", apart, {}) == state_token("h", apart[::-1], {}) and parse_changes(b"") == []


def test_server(code):
    import io
    import json

    from codeloom.plans.server import serve

    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"method": "initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "find", "arguments": {"name": "foo"}}}, {"id": 4, "method": "tools/call", "params": {"name": "find", "arguments": {}}}, {"id": 5, "method": "tools/call", "params": {"name": "relates", "arguments": {"path": "zz"}}}, {"id": 6, "method": "nope"}, [1]]
    out = io.StringIO()
    serve(code, io.StringIO("\n".join(["{bad", "", *map(json.dumps, asked)])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x.get("id") for x in got] == [None, 1, 2, 3, 4, 5, 6, None] and got[0]["error"]["code"] == -32700 and got[6]["error"]["code"] == -32601
    assert len(got[2]["result"]["tools"]) == 14 and json.loads(got[3]["result"]["content"][0]["text"])["rows"][0]["name"] == "foo"
    assert got[4]["result"]["isError"] and got[5]["result"]["isError"] and not got[3]["result"]["isError"]
