"""Chat formatting with linked tool calls, by DataFrame functions only.

A message is one row (conv_id, turn, role, text). A text that is a JSON object may

* call tools: ``{"tool_calls": [{"id": .., "name": .., "arguments": {..}}], "content": ..}``;
* be a result: ``{"tool_call_id": .., "content": ..}``;
* declare tools: ``{"tools": [{"name": .., "parameters": {"properties": {p: {"type": .., "enum": [..]}}, "required": [..]}}]}``.

A call's and a tool's name, arguments and parameters may also stand in a ``function`` object, and arguments may be the text of a JSON object.
Calls and results are hash-joined by (conv_id, identifier): a result belongs to the first call of its id in the conversation, and
the first result of an id answers it. A message's place is (order_turn, order_step): its own turn and step 0, but a result that stands before
its call's place comes right after it, at the turn of that place and one step on; so along every link order grows. Chains of results that call
again are followed by doubling, and no conversation is gathered in one task.
Arguments are valid if all required ones are there, each has its declared type, and is one of its enum's values.
Each message is written as canonical JSON, with all fields of its object and its role: keys sorted, no spaces, null fields of the object left out.

Defined cases: null text is an empty content; text that is no JSON object, or an object with none of these keys, is plain content; null conv_id or turn link with nothing; a call
without id is never answered; calls that lead back to themselves keep their own turns; a call of a tool that its conversation does not declare has no verdict (``n_unknown``); where a
tool is declared twice the first declaration holds; rows that repeat a message are formatted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_PARSED = """struct<
  content: variant, tool_call_id: string,
  tool_calls: array<struct<id: string, name: string, arguments: variant, function: struct<name: string, arguments: variant>>>,
  tools: array<struct<name: string, parameters: PARAMETERS, function: struct<name: string, parameters: PARAMETERS>>>>""".replace("PARAMETERS", "struct<properties: map<string, struct<type: string, enum: array<variant>>>, required: array<string>>")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and m: the parsed object, or null."""
    text = F.when(F.ltrim(F.col("text")).startswith("{") & F.expr("try_parse_json(text) is not null"), F.col("text"))
    m = F.from_json(text, _PARSED.replace("\n", ""), {"mode": "PERMISSIVE"})
    known = F.coalesce(m["tool_calls"].isNotNull() | m["tool_call_id"].isNotNull() | m["tools"].isNotNull(), F.lit(False))
    return messages.select("conv_id", "turn", "role", "text", F.when(known, m).alias("m"))


def _json_type(value: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number").when(kind.startswith("ARRAY"), "array").otherwise("object")
    )


def calls(messages: DataFrame) -> DataFrame:
    """One row per call: conv_id, turn, at, call_id, name, arguments."""
    rows = messages.where("m.tool_calls is not null").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("at", "c"))
    given = F.coalesce("c.arguments", "c.function.arguments")
    told = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(given.cast("string"))).otherwise(given)
    return rows.select("conv_id", "turn", "at", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("name"), told.alias("arguments"))


def declarations(messages: DataFrame) -> DataFrame:
    """conv_id, name and the first declared parameters."""
    rows = messages.where("m.tools is not null").select("conv_id", "turn", F.posexplode("m.tools").alias("at", "t"))
    rows = rows.select("conv_id", F.coalesce("t.name", "t.function.name").alias("name"), "turn", "at", F.coalesce("t.parameters", "t.function.parameters").alias("parameters")).where("name is not null")
    return rows.groupBy("conv_id", "name").agg(F.min_by("parameters", F.struct("turn", "at")).alias("parameters"))


def validated(all_calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with ``valid``: null for an undeclared tool."""
    rows = all_calls.join(tools.withColumn("declared", F.lit(True)).hint("shuffle_hash"), ["conv_id", "name"], "left")
    given = F.from_json(F.to_json("arguments"), "map<string, variant>")
    p = F.col("parameters")
    types = F.coalesce(p["properties"], F.from_json(F.lit("{}"), "map<string, struct<type: string, enum: array<variant>>>"))

    def fits(key: Column, value: Column) -> Column:
        rule = F.try_element_at(types, key)
        kind, allowed = _json_type(value), F.transform(rule["enum"], lambda x: F.to_json(x))
        typed = rule["type"].isNull() | (kind == rule["type"]) | ((kind == "integer") & (rule["type"] == "number"))
        return F.coalesce(typed, F.lit(True)) & F.coalesce(rule["enum"].isNull() | F.array_contains(allowed, F.to_json(value)), F.lit(True))

    has = F.coalesce(F.forall(p["required"], lambda x: F.map_contains_key(given, x)), F.lit(True))
    good = F.coalesce(has & F.forall(F.map_entries(given), lambda e: fits(e["key"], e["value"])), F.lit(False))
    return rows.withColumn("valid", F.when(F.col("declared"), good)).select("conv_id", "turn", "at", "call_id", "name", "valid")


def call_places(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, call_turn of the first call of each id, and its message's place as (place_turn, place_step)."""
    made = rows.where("m.tool_calls is not null and turn is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("up"), F.explode("m.tool_calls.id").alias("call_id")).where("conv_id is not null and call_id is not null")
    first = made.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "up")).alias("c")).select("conv_id", "call_id", F.col("c.turn").alias("call_turn"), F.col("c.up").alias("up"))
    placed = first.select("conv_id", "call_id", "call_turn", F.col("call_turn").alias("place_turn"), F.lit(0).alias("place_step"))
    # The calls of messages that answer other calls; all others are roots at their own turn.
    known = first.select("conv_id", F.col("call_id").alias("up"))
    below = scratch.save(first.where("up is not null").join(known, ["conv_id", "up"], "left_semi").select("conv_id", "call_id", "up"), "below")
    if below.isEmpty():
        return placed
    most, reach, turn = below.groupBy("conv_id").count().agg(F.max("count")).first()[0], 1, 0
    # best: the greatest (turn, steps from it) over a call and its nearest ancestors, ``reach`` in all; up: the next one.
    below = first.drop("up").join(below, ["conv_id", "call_id"], "left")
    below = scratch.save(below.select("conv_id", "call_id", F.struct(F.col("call_turn").alias("t"), F.lit(0).alias("k")).alias("best"), "up"), "chain0")
    while reach <= most and not below.where("up is not null").isEmpty():
        over = below.select("conv_id", F.col("call_id").alias("up"), F.col("best").alias("over"), F.col("up").alias("next"))
        told = F.when(F.col("over").isNotNull(), F.struct(F.col("over.t").alias("t"), (F.col("over.k") + reach).alias("k")))
        turn += 1
        below = scratch.save(below.join(over, ["conv_id", "up"], "left").select("conv_id", "call_id", F.greatest("best", told).alias("best"), F.col("next").alias("up")), f"chain{turn}")
        scratch.drop(f"chain{turn - 1}")
        reach *= 2
    moved = below.where("up is null").select("conv_id", "call_id", "best")
    placed = placed.join(moved, ["conv_id", "call_id"], "left")
    return placed.select("conv_id", "call_id", "call_turn", F.coalesce("best.t", "place_turn").alias("place_turn"), F.coalesce("best.k", "place_step").alias("place_step"))


def whole(text: Column, role: Column) -> Column:
    """The object of ``text`` with the message's role, as canonical JSON."""
    fields = F.map_filter(F.from_json(text, "map<string, variant>"), lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~((k == "role") & role.isNotNull()))
    fields = F.map_concat(fields, F.when(role.isNotNull(), F.create_map(F.lit("role"), role.cast("variant"))).otherwise(F.from_json(F.lit("{}"), "map<string, variant>")))
    keys = F.array_sort(F.map_keys(fields))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(fields, k))))


def formatted(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, kind, n_calls, n_answered, n_valid, n_unknown, call_turn, order_turn, order_step, json."""
    every = parsed(messages.select("conv_id", "turn", "role", "text"))
    rows, scratch = every.where("m is not null"), Scratch(messages.sparkSession)
    made = calls(rows)
    first_call = call_places(rows, scratch)
    results = rows.where("m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(1))
    # written, so that a conversation of very many calls of one tool can be split
    told = validated(made, scratch.save(declarations(rows), "tools")).withColumn("alone", F.when(F.col("call_id").isNull(), F.xxhash64("turn", "at")).otherwise(F.lit(0)))
    told = told.join(answered.withColumn("alone", F.lit(0)).hint("shuffle_hash"), ["conv_id", "call_id", "alone"], "left")
    told = told.groupBy("conv_id", "turn").agg(
        F.sum(F.coalesce("answered", F.lit(0))).alias("n_answered"), F.sum(F.coalesce(F.col("valid").cast("long"), F.lit(0))).alias("n_valid"), F.sum(F.col("valid").isNull().cast("long")).alias("n_unknown")
    )

    # Messages without an identifier join by their own turn, not all by null.
    linked = rows.withColumn("call_id", F.col("m.tool_call_id")).withColumn("alone", F.when(F.col("call_id").isNull(), F.xxhash64("turn")).otherwise(F.lit(0)))
    linked = linked.join(first_call.withColumn("alone", F.lit(0)).hint("shuffle_hash"), ["conv_id", "call_id", "alone"], "left").join(told.hint("shuffle_hash"), ["conv_id", "turn"], "left")
    called, late = F.col("m.tool_calls").isNotNull(), F.coalesce(F.col("place_turn") >= F.col("turn"), F.lit(False))
    kind = F.when(called, "calls").when(F.col("call_id").isNotNull(), "result").when(F.col("m.tools").isNotNull(), "tools").otherwise("message")
    own = whole(F.col("text"), F.col("role"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    linked = linked.select(
        "conv_id", "turn", "role", kind.alias("kind"), count(F.when(called, F.size("m.tool_calls"))).alias("n_calls"),
        *[count(F.when(called, F.col(c))).alias(c) for c in ("n_answered", "n_valid", "n_unknown")], "call_turn",
        F.when(late, F.col("place_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(late, F.col("place_step") + 1).otherwise(0).alias("order_step"), own.alias("json"),
    )
    zero = F.lit(0).cast("long")
    plain = every.where("m is null").select(
        "conv_id", "turn", "role", F.lit("message").alias("kind"), *[zero.alias(c) for c in ("n_calls", "n_answered", "n_valid", "n_unknown")], F.lit(None).cast(linked.schema["call_turn"].dataType).alias("call_turn"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("role"))).alias("json"),
    )
    return plain.unionByName(linked)
