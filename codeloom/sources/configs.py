"""Rules for resolving bare module names, read from a repository's own configuration files.

Configuration files are few and small beside the sources: they are filtered by name, and their rules become a table. Nothing
in them is ever run.
"""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .lexer import tokens

CONFIG_FILE = r"(^|/)(tsconfig|jsconfig|package)\.json$|(^|/)(vite|vitest|webpack)\.config\.[cm]?[jt]s$|(^|/)tsconfig[^/]*\.json$"
MOST_EXTENDS = 10
#: One rule: in files below ``dir``, a name fitting ``prefix*suffix`` (or equal to ``prefix``) means ``target``, tried in order of ``priority``.
RULES = "dir string, prefix string, suffix string, exact boolean, target string, priority int, package boolean"
_CODE = re.compile(r"\.(" + "|".join(S.CODE_EXTENSIONS) + ")$")


def joined(*parts: str) -> str:
    """A path below the root, without . and .. segments; one that leaves the root stays at it."""
    out: list[str] = []
    for x in "/".join(parts).split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def relaxed_json(text: str) -> object | None:
    """JSON, or JSON with comments; None for anything else."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    try:
        return json.loads(bare)
    except ValueError:
        return None


def strict_json(text: str | None) -> dict:
    try:
        got = json.loads(text or "")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def compiler_paths(path: str, files: dict[str, str], depth: int = 0, seen: set[str] | None = None) -> tuple[str | None, dict]:
    """(base folder, paths) of a compiler configuration and of what it extends; each file is read once."""
    seen = set() if seen is None else seen
    if path in seen or path not in files:
        return None, {}
    seen.add(path)
    raw, here = strict_json(files[path]), posixpath.dirname(path)
    base, paths = None, {}
    above = raw.get("extends") or []
    for other in above if isinstance(above, list) else [above]:
        if depth < MOST_EXTENDS and isinstance(other, str) and re.match(r"\.{1,2}/|/", other):
            at = joined(here, other)
            for found in (at, f"{at}.json", f"{at}/tsconfig.json"):
                if found in files:
                    b, p = compiler_paths(found, files, depth + 1, seen)
                    base, paths = b if b is not None else base, p or paths
                    break
    own = raw.get("compilerOptions") or {}
    if isinstance(own.get("baseUrl"), str) and own["baseUrl"]:
        base = joined(here, own["baseUrl"])
    if isinstance(own.get("paths"), dict):
        paths = own["paths"]
    return base, paths


def import_map(package: dict) -> dict[str, list[str]]:
    """The # names of a package: the import condition, else the default, else the first text; sources before emitted files."""
    out = {}
    given = package.get("imports")
    for key, value in (given.items() if isinstance(given, dict) else ()):
        if isinstance(value, dict):
            texts = [value.get(k) for k in ("import", "default")] + list(value.values())
            value = next((x for x in texts if isinstance(x, str)), None)
        if key.startswith("#") and isinstance(value, str) and value:
            value = value.removeprefix("./")
            out[key] = list(dict.fromkeys([_CODE.sub("", value), value]))
    return out


def bundler_aliases(text: str) -> dict[str, str]:
    """alias: { name: "text" or call(.., "text") } of a bundler's configuration, read as tokens."""
    t, out = tokens(text), {}
    mark = lambda i, x: i < len(t) and t[i].kind == "mark" and t[i].text == x
    for i in range(len(t)):
        if t[i].text == "alias" and t[i].kind in ("name", "string") and mark(i + 1, ":") and mark(i + 2, "{"):
            k, depth = i + 3, 0
            while k < len(t) and not (depth == 0 and mark(k, "}")):
                if depth == 0 and t[k].kind in ("name", "string") and mark(k + 1, ":"):
                    key, v = t[k].text, k + 2
                    if v < len(t) and t[v].kind == "string":
                        out[key] = t[v].text
                    else:
                        last, d, called = None, 0, False
                        while v < len(t) and not (d == 0 and (mark(v, ",") or mark(v, "}"))):
                            d += t[v].text in "([{" if t[v].kind == "mark" else 0
                            d -= t[v].text in ")]}" if t[v].kind == "mark" else 0
                            called = called or mark(v, "(") and t[v - 1].kind == "name" and t[v - 1].text not in ("URL",)
                            last = t[v].text if t[v].kind == "string" and d == 1 else last
                            v += 1
                        if called and last is not None:
                            out[key] = last
                        k = v
                        continue
                depth += mark(k, "{") or mark(k, "(") or mark(k, "[")
                depth -= mark(k, "}") or mark(k, ")") or mark(k, "]")
                k += 1
    return out


def _targets(value: object, depth: int = 0) -> list[str]:
    """All files of an exports condition, in the order in which sources are likely to be: types, typings, import, default, the rest."""
    if isinstance(value, str):
        return [value] if value else []
    if depth > 8:
        return []
    if isinstance(value, list):
        inner = value
    elif isinstance(value, dict):
        inner = [value[k] for k in ("types", "typings", "import", "default") if k in value] + list(value.values())
    else:
        return []
    return list(dict.fromkeys(x for v in inner for x in _targets(v, depth + 1)))


def package_rules(path: str, package: dict) -> list[tuple]:
    """Rules for a workspace package's bare name, its declared subpaths (a pattern's fill is never empty) and all others."""
    name, here = package.get("name"), posixpath.dirname(path)
    if not isinstance(name, str) or not name:
        return []
    exports = package.get("exports")
    entries = [package.get("types"), package.get("typings")]
    subpaths: dict[str, list[str]] = {}
    if isinstance(exports, dict) and any(k.startswith(".") for k in exports):
        entries += _targets(exports.get("."))
        subpaths = {k[2:]: t for k, v in exports.items() if k.startswith("./") and (t := _targets(v))}
    else:
        entries += _targets(exports)
    entries += [package.get("module"), package.get("main"), "./index", "./src/index"]
    rules = [("", name, "", True, joined(here, e), i, True) for i, e in enumerate(dict.fromkeys(e for e in entries if isinstance(e, str) and e))]
    order = sorted(subpaths, key=lambda k: ("*" in k, -(k.index("*") if "*" in k else 0), -len(k), k))
    for n, key in enumerate(order):
        pre, star, post = key.partition("*")
        rules += [("", f"{name}/{pre}", post, not star, joined(here, t), 1000 * (n + 1) + i, True) for i, t in enumerate(subpaths[key])]
    rules.append(("", f"{name}/", "", False, joined(here, "*"), 1_000_000, True))
    return rules


def alias_rules(folder: str, base: str, paths: dict) -> list[tuple]:
    """Rules of one configuration: exact names first, then longer prefixes; a name's targets in order."""
    names = sorted(paths, key=lambda k: ("*" in k, -(k.index("*") if "*" in k else len(k))))
    out = []
    for n, key in enumerate(names):
        pre, star, post = key.partition("*")
        targets = paths[key] if isinstance(paths[key], list) else [paths[key]]
        out += [(folder, pre, post, not star, joined(base, t), 100 * n + i, False) for i, t in enumerate(targets) if isinstance(t, str)]
    return out


def read_rules(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The rules of all configuration files among ``files`` (path, text)."""
    rows = files.where(F.col("path").rlike(CONFIG_FILE) & ~F.array_contains(F.split("path", "/"), "node_modules")).select("path", "text").collect()
    texts = {r["path"]: r["text"] or "" for r in rows}
    by_folder: dict[str, tuple[str, dict]] = {}
    for path in sorted(texts):
        if re.search(r"(^|/)(tsconfig|jsconfig)\.json$", path):
            base, paths = compiler_paths(path, texts)
            folder = posixpath.dirname(path)
            if (base is not None or paths) and (folder not in by_folder or path.endswith("tsconfig.json")):
                by_folder[folder] = (base if base is not None else folder, paths)
    rules: list[tuple] = []

    def merge(folder: str, paths: dict) -> None:
        """Names from elsewhere stand behind a compiler configuration of the same folder and base, else on their own."""
        base, own = by_folder.get(folder, (folder, {}))
        if base == folder:
            by_folder[folder] = (folder, {**paths, **own})
        else:
            rules.extend(alias_rules(folder, folder, paths))

    for path in sorted(texts):
        folder = posixpath.dirname(path)
        if re.search(r"\.config\.[cm]?[jt]s$", path):
            paths = {}
            for key, value in bundler_aliases(texts[path]).items():
                value = value.removeprefix("./")
                paths |= {key: [value], f"{key}/*": [f"{value}/*"]}
            if paths:
                merge(folder, paths)
        elif path.rsplit("/", 1)[-1] == "package.json":
            package = strict_json(texts[path])
            if found := import_map(package):
                merge(folder, found)
            rules += package_rules(path, package)
    for folder, (base, paths) in by_folder.items():
        rules += alias_rules(folder, base, paths)
    return spark.createDataFrame(rules, RULES)
