"""Secret scans: three base patterns, and an assignment-aware lexer that adds what they miss.

The lexer reads name-literal pairs from source and configuration syntax (``name = "x"``, ``name: x``, ``"name" => 'x'``, typed declarations, literals
joined by ``+``), follows names whose value is another name to the literal that name holds, and scores a literal by how
sensitive its target's name is and how random the literal looks. Literals scoring at least ``LEAST`` are added as kind ``literal``,
where no ``assign`` match covers them already.

Defined cases: null text is empty; spans are in code points, the end exclusive; a name that is assigned twice keeps every literal;
names that refer to each other in a circle have none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts, tuned

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: How much a part of a name tells of a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "api": 0.4, "signing": 0.5, "encryption": 0.5, "client": 0.2, "key": 0.5, "salt": 0.6, "dsn": 0.6, "pass": 0.8}
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|^(true|false|null|none|nil|undefined|string|str|int|bool)$", re.ASCII)
LEAST = 0.8
#: Words joined by capitals or marks, as names are.
WORDS = re.compile(r"[A-Za-z]?[a-z]+(?:(?:[_./-][A-Z]?|[A-Z])[a-z]{2,})*", re.ASCII)

_STRING = r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`"
_PAIR = re.compile(rf"(?<![\w.$-])[\"']?([A-Za-z_][\w.-]{{0,127}})[\"']?[ \t]*(?::[ \t]*[A-Za-z_][\w<>\[\]|]{{0,40}}[ \t]*(?==))?(?::=|=>|[:=])[ \t]*(?:{_STRING}|([\w+/.$@!%^&*{{}}~-]+(?:={{1,2}}(?![\w+/.$@!%^&*{{}}~=\"'-]))?))", re.ASCII)
_JOIN = re.compile(rf"[ \t]*\+[ \t]*(?:{_STRING})")
_NAME = re.compile(r"\$?\{?([A-Za-z_][\w.-]*)\}?;?", re.ASCII)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


def name_score(name: str) -> float:
    parts = {x.lower() for x in _PART.findall(name)}
    return min(1.0, sum(SENSITIVE.get(x, 0.0) for x in parts))


def literal_score(value: str) -> float:
    """0 for what is short, a placeholder or plain words; towards 1 for long random strings.

    A literal of two classes that is not made of words scores 1 from three bits a character on, which random ones of 16 characters have.
    """
    if len(value) < 8 or " " in value or PLACEHOLDER.search(value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes > 1 and not WORDS.fullmatch(value):
        return min(1.0, entropy / 3.0)
    return min(1.0, entropy / 3.5) * (0.6 + 0.2 * min(classes, 3)) / 1.2


def pairs(text: str) -> list[tuple[str, str | None, int, int, str | None]]:
    """(name, literal, start, end, name referred to or None), read from left to right by one cursor.

    A bare value ends before an equals sign that goes on, so what may begin the next pair is at most one value, read twice.
    """
    out, at = [], 0
    while m := _PAIR.search(text, at):
        name, at = m[1], m.end()
        group = next(i for i in range(2, 6) if m[i] is not None)
        if group < 5:
            parts, start, end = [m[group]], m.start(group), m.end(group)
            while j := _JOIN.match(text, at):
                g = next(i for i in range(1, 4) if j[i] is not None)
                parts.append(j[g])
                end, at = j.end(g), j.end()
            out.append((name, "".join(parts), start, end, None))
            continue
        if (r := _NAME.fullmatch(m[5])) and r[1]:
            out.append((name, m[5], m.start(5), m.end(5), r[1]))
        else:
            out.append((name, m[5].rstrip(";"), m.start(5), m.start(5) + len(m[5].rstrip(";")), None))
        if text[at : at + 1] in ("=", ":", " ", "\t"):
            at = m.start(5)  # the value may itself be the name of a pair
    return out


def lexed(text: str) -> set[tuple[int, int]]:
    """Spans of the literals that sensitive names hold, directly or through other names.

    Each name takes the weight of the most sensitive name that leads to it: names are visited once, by falling weight.
    """
    low = text.lower()
    if sum(w for x, w in SENSITIVE.items() if x in low) < LEAST - 1e-9:
        return set()  # no name can reach it: a name's parts stand in the text
    held: dict[str, list[tuple]] = defaultdict(list)
    for p in pairs(text):
        held[p[0]].append(p)
    weights = {name: name_score(name) for name in held}
    best: dict[str, float] = {}
    for first in sorted((x for x in held if weights[x] >= LEAST), key=lambda x: -weights[x]):
        todo = [first]
        while todo:
            if (name := todo.pop()) not in best:
                best[name] = weights[first]
                todo += [p[4] for p in held[name] if p[4] in held]
    return {(start, end) for name, weight in best.items() for _, value, start, end, other in held[name] if (other is None or other not in held) and weight * literal_score(value) >= LEAST}


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    taken = list(out)
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    out += [("literal", s, e) for s, e in lexed(text) if not any(a <= s and e <= b for _, a, b in taken)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans for each row."""

    def work(batch: pa.RecordBatch):
        rows = [scan(x) for x in texts(batch)]
        count = [Counter(k for k, _, _ in r) for r in rows]
        base = [hashlib.sha256(_told([x for x in r if x[0] != "literal"]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[k] for c in count], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array([_told(r) for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    tuned(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")
