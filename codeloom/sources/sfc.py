"""The script of a single-file component."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import prepared


def _tag(text: str, at: int) -> tuple[dict[str, str | None], int] | None:
    """The attributes of the tag whose name ends at ``at``, and where it ends; None if it isn't a proper tag.

    Values are quoted, and a > within quotes belongs to them.
    """
    found, n = {}, len(text)
    while at < n:
        begin = at
        while at < n and text[at].isspace():
            at += 1
        if at < n and text[at] == ">":
            return found, at + 1
        if text.startswith("/>", at):
            return found, at + 2
        if at == begin or at >= n or not (text[at].isascii() and text[at].isalpha()):
            return None
        start = at
        while at < n and (text[at] in "-_" or text[at].isascii() and text[at].isalnum()):
            at += 1
        name, value, back = text[start:at].lower(), None, at
        while at < n and text[at].isspace():
            at += 1
        if at < n and text[at] == "=":
            at += 1
            while at < n and text[at].isspace():
                at += 1
            if at >= n or text[at] not in "\"'":
                return None
            close = text.find(text[at], at + 1)
            if close < 0:
                return None
            value, at = text[at + 1 : close], close + 1
        else:
            at = back
        found.setdefault(name, value)
    return None


def script_of(text: str) -> tuple[str, bool, str] | None:
    """(language, setup, body) of the block that counts: the first with setup, else the first.

    Blocks with a source elsewhere and empty ones don't count; reading ends at a block without an end.
    """
    low, at, first = text.lower(), 0, None
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    while (at := low.find("<script", at)) >= 0:
        tag = _tag(text, at + 7)
        if tag is None:
            at += 7
            continue
        attributes, body = tag
        end = low.find("</script>", body)
        if end < 0:
            break
        at = end + 9
        if attributes.get("src") or not text[body:end].strip():
            continue
        block = ((attributes.get("lang") or "js").lower(), "setup" in attributes, text[body:end])
        if block[1]:
            return block
        first = first or block
    return first


def script_blocks(files: DataFrame) -> DataFrame:
    """path, lang, setup, script of ``files`` (path, text) that have one."""

    def run(batches):
        for batch in batches:
            rows = [(p, *s) for p, x in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if x and (s := script_of(x))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["path", "lang", "setup", "script"])

    prepared(files.sparkSession)
    return files.select("path", "text").mapInArrow(run, "path string, lang string, setup boolean, script string")
