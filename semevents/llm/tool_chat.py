"""Chat formatting by tool-call linking (DataFrame functions only).

Calls and results are hash-joined by identifier, ordered topologically by who waits for whom, checked against the
tools' argument schemas, and written as canonical JSON. Everything is per message: no conversation is ever
gathered into one row or one task, so a conversation with a third of all messages is no special case.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, saved

# JSON Schema type names and the type names of Spark's variants that satisfy them.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*$",
    "array": "^ARRAY.*$",
    "null": "^VOID$",
}


def accepts(v: Column, schema: dict) -> Column:
    """Whether a variant is what a schema asks for: ``type`` (a name or a list of names), ``enum``, for objects
    ``properties``, ``required`` and ``additionalProperties`` (true or false), for arrays ``items``, for numbers ``minimum`` and
    ``maximum``. Schemas nest. What a schema says of another type than the value's does not bear on it."""
    kind = F.schema_of_variant(v)
    is_object, is_array = kind.rlike(TYPES["object"]), kind.rlike(TYPES["array"])
    out = F.lit(True)
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if unknown := set(names) - set(TYPES):
            raise ValueError(f"unknown types in a schema: {sorted(unknown)}")
        out = out & kind.rlike("|".join(TYPES[n] for n in names))
    if "enum" in schema:
        out = out & F.to_json(v).isin([json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]])
    keys = F.json_object_keys(F.when(is_object, F.to_json(v)))
    fields = schema.get("properties", {})
    for key in schema.get("required", []):
        out = out & (~is_object | F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False)))
    for key, rule in fields.items():
        there = F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False))
        out = out & (~there | F.coalesce(accepts(F.try_variant_get(v, f"$['{key}']", "variant"), rule), F.lit(False)))
    if not schema.get("additionalProperties", True):
        out = out & (~is_object | (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in fields]).cast("array<string>"))) == 0))
    if "items" in schema:
        each = F.coalesce(F.when(is_array, F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))
        out = out & F.forall(each, lambda x: F.coalesce(accepts(x, schema["items"]), F.lit(False)))
    number = F.when(kind.rlike(TYPES["number"]), F.try_variant_get(v, "$", "double"))
    for name, holds in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n)):
        if name in schema:
            out = out & F.coalesce(holds(F.lit(float(schema[name]))), F.lit(True))
    return out


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """True if ``arguments`` is a JSON object that the named tool's schema accepts (see ``accepts``).

    A tool without a schema, or text that is no JSON object, is not valid.
    """
    v = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, schema in schemas.items():
        out = F.when(name == F.lit(tool), F.coalesce(accepts(v, {"type": "object"} | schema), F.lit(False))).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 for a call that waits for nothing, else one more than the highest of those it waits for.

    ``calls`` has one row per call_id, and ``after``: the call it waits for, an array of calls, or null. Calls that aren't
    there are not waited for. Each round takes what is already ordered into account, and where a call has one call left
    to wait for, waits for what that one waits for (pointer doubling): chains of n calls take log2(n) rounds, and more
    rounds are needed only along calls that wait for several open ones. Each is written to the shared folder, and orders some
    call as long as any can be; if none is, what is left are cycles and what waits for them, which keep level null.
    """
    many = isinstance(calls.schema["after"].dataType, T.ArrayType)
    after = F.col("after") if many else F.array("after")
    pairs = calls.select("call_id", F.explode_outer(after).alias("up")).filter("up IS NOT NULL").distinct()
    there = pairs.join(calls.select(F.col("call_id").alias("up")), "up").select("call_id", "up", F.lit(1).cast("long").alias("far"))
    none = F.lit(None).cast(calls.schema["call_id"].dataType)
    # a row a call: the highest level known so far, how many calls are open before it, and one of them with its distance
    sums = lambda steps: steps.groupBy("call_id").agg(
        F.max("least").alias("least"), F.count("up").alias("open"), F.max("up").alias("up"), F.max(F.when(F.col("up").isNotNull(), F.col("far"))).alias("far")
    )
    start = calls.select("call_id", none.alias("up"), F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("least"))
    steps = saved(start.unionByName(there.withColumn("least", F.lit(0).cast("long"))))
    before = None
    while True:
        at = saved(sums(steps))
        left = at.filter("open > 0").count()
        if not left or left == before:
            return at.select("call_id", F.when(F.col("open") == 0, F.col("least")).alias("level"))
        before = left
        info = at.select(F.col("call_id").alias("up"), F.col("open").alias("open2"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("least").alias("least2"))
        on = F.when(F.col("open2") == 1, F.col("up2")).when(F.col("open2") > 1, F.col("up"))
        moved = steps.filter("up IS NOT NULL").join(info, "up").select(
            "call_id", on.alias("up"), F.when(F.col("open2") == 1, F.col("far") + F.col("far2")).otherwise(F.col("far")).alias("far"), (F.col("far") + F.col("least2")).alias("least")
        )
        # several ways to one call count once, by the longest
        merged = moved.groupBy("call_id", "up").agg(F.max("far").alias("far"), F.max("least").alias("least"))
        old = steps
        steps = saved(at.select("call_id", none.alias("up"), F.lit(0).cast("long").alias("far"), "least").unionByName(merged))
        release(old, at)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every message with its link, topological place, validity and canonical JSON.

    ``messages``: conv_id, turn, role, kind ('call', 'result' or other), call_id, after (for calls: the call it
    waits for, or an array of them), tool, arguments (JSON text, for calls), content. Added: ``linked`` (a call that has a result, a
    result that has a call; false for others), ``level``, ``place`` (2 x level for calls, one more for their
    results; null for messages that are neither, and on cycles), ``valid`` (for calls), ``json``: one object with sorted
    keys and no nulls, arguments as a canonical JSON object where they parse. Rows are kept as they are: a
    repeated call or result is linked by its identifier; of repeated calls the smallest (turn) stands for all in
    the order. A null call_id links nothing.
    """
    calls = messages.filter("kind = 'call' AND call_id IS NOT NULL")
    heads = calls.groupBy("call_id").agg(F.min_by("after", F.struct("turn", "after")).alias("after"))
    order = levels(heads)
    answered = messages.filter("kind = 'result' AND call_id IS NOT NULL").select("call_id").distinct().withColumn("answered", F.lit(True))
    info = order.join(answered, "call_id", "left")
    # Messages without an identifier match nothing; they are spread by what they are, not dealt to one task.
    spread = F.coalesce("call_id", F.concat_ws("\0", F.lit(""), "conv_id", "turn", "kind"))
    out = messages.withColumn("_key", spread).join(info.withColumnRenamed("call_id", "_key"), "_key", "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    place = F.when(is_call, 2 * F.col("level")).when(is_result, 2 * F.col("level") + 1)
    found = F.col("level").isNotNull() | F.col("answered").isNotNull()
    canonical = F.to_json(F.try_parse_json(F.col("arguments")))
    member = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    some = lambda c, value: F.when(F.col(c).isNotNull(), value)
    written = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(is_call, some("arguments", member("arguments", F.coalesce(canonical, quoted("arguments"))))),
            some("call_id", member("call_id", quoted("call_id"))),
            some("content", member("content", quoted("content"))),
            some("role", member("role", quoted("role"))),
            some("tool", member("tool", quoted("tool"))),
        ),
        F.lit("}"),
    )
    return out.select(
        "conv_id", "turn", "role", "kind", "call_id",
        F.coalesce(F.when(is_call, F.col("answered")).when(is_result, found), F.lit(False)).alias("linked"),
        "level", place.alias("place"),
        F.when(is_call, valid_arguments(F.col("tool"), F.col("arguments"), schemas)).alias("valid"),
        written.alias("json"),
    )


# The one tool of the conversations query.
ANSWER = {"answer": {"properties": {"question": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["question", "turn"], "additionalProperties": False}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """``conversations`` has no tool calls of its own: a user turn calls the tool "answer", the next turn, if the
    assistant's, is its result, and a call waits for the one two turns before it. Null texts give null arguments."""
    key = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("text").alias("kind"),
        F.when(user, key(F.col("turn"))).when(assistant, key(F.col("turn") - 1)).alias("call_id"),
        F.when(user, key(F.col("turn") - 2)).alias("after"),
        F.when(user, "answer").alias("tool"),
        F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text").alias("question")))).alias("arguments"),
        F.when(~user | F.col("role").isNull(), F.col("text")).alias("content"),
    )


ORACLE = """WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
    CASE role WHEN 'user' THEN conv_id || '-' || turn WHEN 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id
  FROM conversations),
c AS (SELECT DISTINCT conv_id, turn, call_id FROM m WHERE kind = 'call'),
lv AS (
  SELECT call_id, conv_id, turn, CAST(0 AS BIGINT) AS level FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.call_id, c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
a AS (SELECT DISTINCT call_id FROM m WHERE kind = 'result')
SELECT m.conv_id, m.turn, m.role, m.kind, m.call_id,
  CASE kind WHEN 'call' THEN a.call_id IS NOT NULL WHEN 'result' THEN lv.call_id IS NOT NULL ELSE false END AS linked,
  lv.level, CASE kind WHEN 'call' THEN 2 * lv.level WHEN 'result' THEN 2 * lv.level + 1 END AS place,
  CASE WHEN kind = 'call' THEN text IS NOT NULL END AS valid,
  CASE kind WHEN 'call' THEN '{"arguments":{"question":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || m.turn || '},"call_id":"' || m.call_id || '","role":"user","tool":"answer"}'
    WHEN 'result' THEN '{"call_id":"' || m.call_id || '","content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"assistant"}'
    ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS json
FROM m LEFT JOIN lv ON lv.call_id = m.call_id LEFT JOIN a ON a.call_id = m.call_id"""
