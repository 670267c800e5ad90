"""Facts of one source file: what it declares, exports, imports and calls.

A scanner makes tokens; a reader walks them once, with a stack of brackets that tells whose body a token is in. It needs no
compiler: names are bound by imports and top-level declarations, and a name that an inner scope binds again is left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from heapq import heappop, heappush

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$)|^\#![^\n]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
    |(?P<number>\d[\w.]*)
    |(?P<mark>=>|\?\.|\.\.\.|[{}()\[\];,.<>=:?*&|!+\-/%^~@\#`"'\\])
    |(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/>])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^") | {"=>", "return", "typeof", "case", "in", "of", "new", "delete", "void", "throw"}
KEYWORDS = frozenset("if for while switch catch return typeof await yield function class new delete void throw else do try finally case in of instanceof import export from as const let var super this async static get set extends implements interface type enum namespace declare abstract default with".split())


@dataclass(slots=True)
class Token:
    kind: str  # name, string, template, mark, number, other
    text: str
    line: int


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, n = 0, 1, len(text)
    resume: list[int] = []  # for each open ${, the number of braces open within it
    while at < n:
        c = text[at]
        if c == "`" or (c == "}" and resume and resume[-1] == 0):
            if c == "}":
                resume.pop()
            else:
                out.append(Token("template", "`", line))
            at, line, more = _template(text, at + 1, line)
            if more:
                resume.append(0)
            continue
        if c == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            out.append(Token("other", "regex", line))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        kind, found = m.lastgroup, m[0]
        if kind != "space":
            if resume and found in "{}":
                resume[-1] += 1 if found == "{" else -1
            out.append(Token(kind, found[1:-1] if kind == "string" else found, line))
        line += found.count("\n")
        at = m.end()
    return out


def _template(text: str, at: int, line: int) -> tuple[int, int, bool]:
    """Where a template's text ends, the line there, and whether an expression follows."""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "`":
            return at + 1, line, False
        if c == "$" and text.startswith("${", at):
            return at + 2, line, True
        line += c == "\n"
        at += 1
    return at, line, False


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)  # name, kind, is_export, is_default, local (name in the file), line
    imports: list[dict] = field(default_factory=list)  # spec, names, locals, form, type_only, line
    calls: list[dict] = field(default_factory=list)  # base, name, kind, line, owner, owner_line
    rsc: str | None = None


#: Words that begin a new statement where they begin a line.
_STATEMENTS = frozenset("import export const let var function class interface type enum async abstract declare namespace".split())
_DECLARED = {"function": "FunctionDeclaration", "class": "ClassDeclaration", "interface": "InterfaceDeclaration", "type": "TypeAliasDeclaration", "enum": "EnumDeclaration", "namespace": "ModuleDeclaration"}


class Reader:
    def __init__(self, text: str):
        self.t, self.i, self.facts = tokens(text), 0, Facts()
        self.close = self._pairs()
        self.generic = self._generics()
        self._ahead()

    def _pairs(self) -> dict[int, int]:
        pairs, stack = {}, []
        for i, x in enumerate(self.t):
            if x.kind == "mark" and x.text in "{([":
                stack.append(i)
            elif x.kind == "mark" and x.text in "})]":
                want = {"}": "{", ")": "(", "]": "["}[x.text]
                for k in range(len(stack) - 1, -1, -1):  # an unmatched bracket (text between tags) doesn't spoil the outer ones
                    if self.t[stack[k]].text == want:
                        pairs[stack[k]] = i
                        del stack[k:]
                        break
        return pairs

    def _generics(self) -> dict[int, int]:
        """Where type arguments like <A, B<C>> that begin at a token end, found in one pass; they stand on one line."""
        out, stack, line = {}, [], 0
        for k, x in enumerate(self.t):
            if x.line != line:
                stack, line = [], x.line
            if x.kind == "mark" and x.text == "<":
                stack.append(k)
            elif x.kind == "mark" and x.text == ">" and stack:
                out[stack.pop()] = k
            elif x.kind == "mark" and x.text in (";", "{", "(", "=>"):
                stack = []
        return out

    def _ahead(self) -> None:
        """For each token, the next one that ends something: found backwards, so that no search runs through the same tokens twice."""
        n = len(self.t)
        self.body, self.typed, self.arrow, self.stop = ([n] * (n + 2) for _ in range(4))
        for i in range(n - 1, -1, -1):
            word = self.text(i)
            after = min(self.close.get(i, i) + 1, n)
            self.body[i] = i if word in ("{", ";") else self.body[after if word == "(" else i + 1]
            self.typed[i] = i if word in ("{", ";", ")", ",") else self.typed[i + 1]
            self.arrow[i] = i if word in ("=>", ";", "{") else self.arrow[i + 1]
            x = self.t[i]
            if x.kind == "mark" and x.text == ";":
                self.stop[i] = i + 1
            elif i and x.kind == "name" and x.line > self.t[i - 1].line and x.text in _STATEMENTS:
                self.stop[i] = i
            else:
                self.stop[i] = self.stop[after if i in self.close else i + 1]

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind != "string" else ""

    def string(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "string" else None

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def read(self) -> Facts:
        self._prologue()
        declared: dict[str, tuple[str, int]] = {}
        exported: list[tuple[str, str, bool, int]] = []  # exported as, local name, default, line
        i = 0
        while i < len(self.t):
            word = self.text(i)
            if word == "import" and self.text(i + 1) not in ("(", "."):
                i = self._import(i)
            elif word == "export":
                i = self._export(i, declared, exported)
            elif (got := self._declaration(i)) is not None:
                names, i = got
                for name, kind, line in names:
                    declared.setdefault(name, (kind, line))
            elif self.t[i].kind == "mark" and word in "{([" and i in self.close:
                i = self.close[i] + 1
            else:
                i += 1
        self._symbols(declared, exported)
        self._dynamic()
        self._calls(declared)
        return self.facts

    def _prologue(self) -> None:
        i = 0
        while (s := self.string(i)) is not None and self.text(i + 1) in (";", "") or s is not None and i + 1 < len(self.t) and self.t[i + 1].line > self.t[i].line:
            if s in ("use client", "use server"):
                self.facts.rsc = s.removeprefix("use ")
                return
            i += 2 if self.text(i + 1) == ";" else 1

    def _braced_names(self, i: int) -> tuple[list[tuple[str, str, bool]], int]:
        """(name, alias, type only) of { a, b as c, type d } and the index after it."""
        end, out, i = self.close.get(i, len(self.t) - 1), [], i + 1
        while i < end:
            only = self.text(i) == "type" and self.text(i + 1) not in (",", "}", "as", "") or self.text(i) == "type" and self.text(i + 1) == "as" and self.text(i + 2) == "as"
            i += only
            if self.is_name(i) or self.string(i) is not None:
                name = self.t[i].text
                alias = self.t[i + 2].text if self.text(i + 1) == "as" else name
                out.append((name, alias, only))
            while i < end and self.text(i) != ",":
                i += 1
            i += 1
        return out, end + 1

    def _import(self, i: int) -> int:
        line, i = self.t[i].line, i + 1
        if (spec := self.string(i)) is not None:
            self._site(spec, ["*"], [], "side_effect", False, line)
            return i + 1
        erased = self.text(i) == "type" and self.text(i + 1) not in ("from", ",", "=") or self.text(i) == "type" and self.text(i + 1) == "from" and self.text(i + 2) == "from"
        i += erased
        names, bound, named, whole = [], [], [], False
        while i < len(self.t) and self.text(i) not in ("from", ";", "="):
            if self.text(i) == "{":
                named, i = self._braced_names(i)
                names += [n for n, _, only in named if not only]
                bound += [(a, n) for n, a, _ in named]
            elif self.text(i) == "*" and self.text(i + 1) == "as":
                names.append("*")
                bound.append((self.text(i + 2), "*"))
                whole, i = True, i + 3
            elif self.is_name(i):
                names.append("default")
                bound.append((self.text(i), "default"))
                whole, i = True, i + 1
            else:
                i += 1
        if self.text(i) == "from" and (spec := self.string(i + 1)) is not None:
            erased = erased or bool(named) and all(only for *_, only in named) and not whole
            self._site(spec, names or ["*"], bound, "static", erased, line)
            return i + 2
        return i + 1

    def _site(self, spec: str, names: list[str], bound: list[tuple[str, str]], form: str, type_only: bool, line: int) -> None:
        self.facts.imports.append({"spec": spec, "names": names, "locals": [{"local": a, "name": n} for a, n in bound], "form": form, "type_only": type_only, "line": line})

    def _export(self, i: int, declared: dict, exported: list) -> int:
        line, i = self.t[i].line, i + 1
        if self.text(i) == "type" and self.text(i + 1) in ("{", "*"):
            return self._forwarded(i + 1, True, line, exported)
        if self.text(i) in ("{", "*"):
            return self._forwarded(i, False, line, exported)
        if self.text(i) == "default":
            i += 1
            got = self._declaration(i)
            if got and got[0] and got[0][0][0]:
                (name, kind, at), i = got[0][0], got[1]
                declared.setdefault(name, (kind, at))
                exported.append((name, name, True, at))
                return i
            if self.is_name(i) and self.text(i) not in ("function", "class", "async", "new") and self.text(i + 1) in (";", "") or self.is_name(i) and self.text(i) not in KEYWORDS and i + 1 < len(self.t) and self.t[i + 1].line > self.t[i].line:
                exported.append((self.text(i), self.text(i), True, line))
                return i + 1
            declared.setdefault("default", ("ExportAssignment", line))
            exported.append(("default", "default", True, line))
            return got[1] if got else i
        got = self._declaration(i)
        if got is None:
            return i
        for name, kind, at in got[0]:
            declared.setdefault(name, (kind, at))
            exported.append((name, name, False, at))
        return got[1]

    def _forwarded(self, i: int, erased: bool, line: int, exported: list) -> int:
        """export { .. } [from], export * [as x] from."""
        if self.text(i) == "*":
            alias = self.text(i + 2) if self.text(i + 1) == "as" else None
            i += 3 if alias else 1
            if self.text(i) == "from" and (spec := self.string(i + 1)) is not None:
                self._site(spec, [], [(alias or "*", "*")], "reexport", erased, line)
                return i + 2
            return i
        named, i = self._braced_names(i)
        if self.text(i) == "from" and (spec := self.string(i + 1)) is not None:
            erased = erased or bool(named) and all(only for *_, only in named)
            self._site(spec, [n for n, _, only in named if not only], [(a, n) for n, a, _ in named], "reexport", erased, line)
            return i + 2
        for name, alias, _ in named:
            exported.append((name if alias == "default" else alias, name, alias == "default", line))
        return i

    def _declaration(self, i: int) -> tuple[list[tuple[str, str, int]], int] | None:
        """Names, kinds and lines of the declaration that begins here, and where reading goes on; None if none begins."""
        while self.text(i) in ("declare", "abstract", "async") and (self.text(i + 1) in _DECLARED or self.text(i + 1) in ("const", "let", "var", "abstract", "async")):
            i += 1
        word = self.text(i)
        if word == "const" and self.text(i + 1) == "enum":
            i, word = i + 1, "enum"
        if word in ("const", "let", "var"):
            return self._variables(i + 1)
        if word not in _DECLARED or word in ("type", "namespace") and not (self.is_name(i + 1) and self.text(i + 2) in ("=", "<", "{", ".")):
            return None
        line, i = self.t[i].line, i + 1
        i += self.text(i) == "*"
        name = self.text(i) if self.is_name(i) and self.text(i) not in ("extends", "implements") else ""
        if word == "type":
            return [(name, _DECLARED[word], line)], self._end(i + 1)
        while i < len(self.t) and self.text(i) not in ("{", ";"):
            i = self.close.get(i, i) + 1 if self.text(i) in ("(", "[") else i + 1
        return [(name, _DECLARED[word], line)], self.close.get(i, i) + 1 if self.text(i) == "{" else i + 1

    def _end(self, i: int) -> int:
        """After the statement that goes on here: at a semicolon, or where a line begins a new one."""
        if i >= len(self.t):
            return i
        if self.t[i].kind == "mark" and self.t[i].text == ";":
            return i + 1
        return self.stop[min(self.close.get(i, i) + 1, len(self.t))]

    def _variables(self, i: int) -> tuple[list[tuple[str, str, int]], int]:
        names, end = [], self._end(i)
        expect = True
        while i < end:
            if expect and self.is_name(i):
                names.append((self.text(i), "VariableDeclaration", self.t[i].line))
                expect = False
            elif expect and self.text(i) in ("{", "["):
                close = self.close.get(i, i)
                for k in range(i + 1, close):
                    if self.is_name(k) and self.text(k + 1) in (",", "}", "]", "=") and self.text(k - 1) not in ("=",):
                        names.append((self.text(k), "BindingElement", self.t[k].line))
                expect = False
            if self.text(i) == "," and self.t[i].kind == "mark":
                expect = True
            if self.text(i) == "<" and (close := self.generic.get(i)):
                i = close
            i = self.close[i] + 1 if i in self.close else i + 1
        return names, end

    def _symbols(self, declared: dict, exported: list) -> None:
        seen = set()
        for name, local, default, line in exported:
            kind, at = declared.get(local, ("?", line))
            if name not in seen:
                seen.add(name)
                self.facts.symbols.append({"name": name, "kind": kind, "is_export": True, "is_default": default, "local": local, "line": at})
        out = {local for _, local, *_ in exported}
        for name, (kind, line) in declared.items():
            if name and name not in seen and name not in out:
                self.facts.symbols.append({"name": name, "kind": kind, "is_export": False, "is_default": False, "local": name, "line": line})

    def _dynamic(self) -> None:
        for i, x in enumerate(self.t):
            if x.kind == "name" and x.text in ("import", "require") and self.text(i + 1) == "(" and self.text(i - 1) not in (".", "?.") and (spec := self.string(i + 2)) is not None:
                self._site(spec, ["*"], [], "dynamic" if x.text == "import" else "require", False, x.line)

    def _owners(self) -> list[tuple[int, int, str, int]]:
        """(begin, end, name, line) of bodies that have a name."""
        out = []
        for i, x in enumerate(self.t):
            if x.kind != "name":
                continue
            if x.text in ("function", "class"):
                k = i + 1 + (self.text(i + 1) == "*")
                if self.is_name(k) and self.text(k) not in ("extends", "implements"):
                    body = self.body[k]
                    if self.text(body) == "{":
                        out.append((k + 1, self.close.get(body, len(self.t)), self.text(k), x.line))
            elif self.text(i + 1) in ("=", ":") and self.text(i - 1) not in (".", "?.") and (end := self._function_value(i + 2)):
                out.append((i + 2, end, x.text, x.line))
            elif self.text(i + 1) == "(" and x.text not in KEYWORDS and self.text(i - 1) not in (".", "?.", "new", "function", "=", "=>", "(", ",", "return"):
                body = self.close.get(i + 1, len(self.t)) + 1
                if self.text(body) == ":":
                    body = self.typed[body]
                if self.text(body) == "{" and (self.text(i - 1) in ("{", "}", ";", "async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "*", ",") or self.t[i - 1].line < x.line):
                    out.append((i + 1, self.close.get(body, len(self.t)), "" if x.text == "constructor" else x.text, x.line))
        return out

    def _function_value(self, i: int) -> int | None:
        """Where the function value that begins here ends; None if it is none."""
        i += self.text(i) == "async"
        if self.text(i) == "function":
            return self.close.get(self.body[min(i, len(self.t))])
        k = self.close.get(i, i) + 1 if self.text(i) == "(" else i + 1 if self.is_name(i) else None
        if k is None:
            return None
        if self.text(k) == ":" and self.text(i) == "(":
            k = self.arrow[k]
        if self.text(k) != "=>":
            return None
        return self.close.get(k + 1) if self.text(k + 1) == "{" else self._end(k + 1)

    def _calls(self, declared: dict) -> None:
        """Calls, each with the smallest named body that it is in. Bodies open and end as the tokens pass by."""
        owners = self._owners()
        heads, methods = {b - 1 for b, *_ in owners}, {b for b, *_ in owners if self.text(b) == "("}
        begin: dict[int, list[int]] = {}
        for k, (b, *_) in enumerate(owners):
            begin.setdefault(b, []).append(k)
        inner = [names for *_, names in self._inner_bindings(owners)]
        bound: Counter = Counter()
        open_, ends = [], []
        for i, x in enumerate(self.t):
            for k in begin.get(i, ()):
                open_.append(k)
                heappush(ends, (owners[k][1], k))
                bound.update(inner[k])
            while ends and ends[0][0] < i:
                _, k = heappop(ends)
                open_.remove(k)
                bound.subtract(inner[k])
            if x.kind != "name" or x.text in KEYWORDS:
                continue
            if self.text(i - 1) == "<" and self._is_tag(i):
                base, name, k = self._dotted(i)
                kind = "jsx"
            elif self.text(i - 1) in (".", "?."):
                continue  # read with its first name
            else:
                base, name, k = self._dotted(i)
                after = k + 1
                if self.text(after) == "<" and (close := self.generic.get(after)):
                    after = close + 1
                new = self.text(i - 1) == "new"
                if self.text(after) == "?." and self.text(after + 1) == "(":
                    after += 1
                if not new and self.text(after) != "(" or i in heads or self.text(i - 1) in ("function", "class", "interface", "type", "enum", "@") or i + 1 in methods:
                    continue
                kind = "call"
            if bound[base or name] > 0:
                continue
            own = [(owners[j][1] - owners[j][0], *owners[j][2:]) for j in open_ if owners[j][2]]
            owner, line = min(own)[1:] if own else ("<module>", self.t[k].line)
            self.facts.calls.append({"base": base, "name": name, "kind": kind, "line": self.t[k].line, "owner": owner, "owner_line": line})

    def _is_tag(self, i: int) -> bool:
        before = self.t[i - 2] if i >= 2 else None
        return before is None or before.kind == "mark" and before.text not in (")", "]") or before.text in ("return", "default", "else") or before.line < self.t[i].line or self.t[i].text[0].isupper() and before.kind != "name"

    def _dotted(self, i: int) -> tuple[str | None, str, int]:
        """(what stands before the last dot if it is one name, the last name, its index)."""
        parts, k = [self.t[i].text], i
        while self.text(k + 1) in (".", "?.") and self.is_name(k + 2):
            k += 2
            parts.append(self.t[k].text)
        return (None if len(parts) == 1 else parts[0] if len(parts) == 2 else ".".join(parts[:-1])), parts[-1], k

    def _inner_bindings(self, owners: list) -> list[tuple[int, int, set[str]]]:
        """Names that bodies bind for themselves: parameters and variables."""
        out = []
        for b, e, *_ in owners:
            names, k = set(), b
            k += self.text(k) == "async"
            while k < e and self.text(k) not in ("(", "{", "=>"):
                if self.is_name(k) and self.text(k + 1) == "=>":
                    names.add(self.text(k))
                k += 1
            if self.text(k) == "(":
                close = self.close.get(k, k)
                for j in range(k + 1, close):
                    if self.is_name(j) and self.text(j - 1) in ("(", ",", "{", "[", "...", ":") and self.text(j + 1) in (",", ")", ":", "=", "}", "]", "?") and not (self.text(j - 1) == ":" and self.text(j + 1) == ":"):
                        names.add(self.text(j))
                k = close
            for j in range(k, e):
                if self.text(j) in ("const", "let", "var") and self.t[j].kind == "name":
                    names |= {n for n, *_ in self._variables(j + 1)[0]}
                elif self.text(j) == "function" and self.is_name(j + 1):
                    names.add(self.text(j + 1))
            out.append((b, e, names))
        return out


def read_source(text: str) -> Facts:
    return Reader(text).read()
