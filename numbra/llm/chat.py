"""Chat formatting with linked tool calls.

Calls and results are hash-joined by identifier, arguments are parsed and checked against the tools' JSON
schemas, messages get the level of the longest chain of messages they depend on, and each becomes one line of
canonical JSON. Rows of a conversation are never gathered in one task: the order is columns to sort by, not a list.
"""

from __future__ import annotations

import functools
import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from numbra.llm.common import cut

_SURROGATE = re.compile("[\ud800-\udfff]")


def _number(x: Decimal | int) -> str:
    """Exact, without needless zeros; plain between 1e-7 and 1e21, as digits and an exponent beyond."""
    d = Decimal(x)
    if not d:
        return "0"
    sign, digits, exponent = d.as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    exponent += len(digits) - len(text)
    point = len(text) + exponent
    if len(text) <= point <= 21:
        body = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        body = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + body


def canonical(value) -> str:
    """A parsed value as JSON: keys by code point, no spaces, exact numbers, only controls escaped."""
    if isinstance(value, str):
        return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, Decimal)):
        return _number(value)
    if isinstance(value, list):
        return f"[{','.join(map(canonical, value))}]"
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"


def parse(text: str):
    """The value of a JSON text; ValueError for anything else, such as NaN. Of repeated keys the last one counts."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=refuse)
    except (RecursionError, ArithmeticError) as e:
        raise ValueError("nested too deep, or a number beyond any range") from e


_IS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, Decimal) and v == v.to_integral_value(),
    "number": lambda v: isinstance(v, Decimal),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def conforms(value, schema) -> bool:
    """Whether a parsed value suits a JSON schema: type, enum, const, anyOf, bounds, lengths, and inside of objects
    properties, required and additionalProperties, inside of arrays items; other keywords are not looked at."""
    if not isinstance(schema, dict):
        return schema is not False
    kinds = schema.get("type")
    if kinds is not None and not any(_IS.get(k, lambda v: False)(value) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if "anyOf" in schema and not any(conforms(value, x) for x in schema["anyOf"]):
        return False
    if isinstance(value, Decimal):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(conforms(x, schema.get("items", True)) for x in value)
    if isinstance(value, dict):
        inside, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        return all(k in value for k in schema.get("required", [])) and all(conforms(x, inside.get(k, rest)) for k, x in value.items())
    return True


@functools.lru_cache(maxsize=4096)
def tool_schema(properties: str, required: str | None) -> dict:
    """The schema of a tool's arguments: each property is named by its JSON type or by a schema as JSON text."""
    rules = {k: {"type": v} if v in _IS else parse(v) for k, v in json.loads(properties).items() if v is not None}
    return {"type": "object", "properties": rules, "required": json.loads(required or "[]"), "additionalProperties": False}


def check_arguments(keys, values, properties: str | None, required: str | None) -> tuple[str, bool]:
    """Canonical JSON of the arguments, and whether they suit the tool. A value that is no JSON text stands as a
    JSON string of that text, so the line is always JSON, and the call is not valid."""
    out, ok = {}, properties is not None
    for k, v in zip(keys, values, strict=True):
        try:
            out[k] = None if v is None else parse(v)
            canonical(out[k])
        except (ValueError, RecursionError):
            out[k], ok = v, False
    try:
        return canonical(out), ok and conforms(out, tool_schema(properties, required))
    except (ValueError, RecursionError):  # a schema that is none
        return canonical(out), False


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("valid", BooleanType())]))
def _checked(keys: pd.Series, values: pd.Series, properties: pd.Series, required: pd.Series) -> pd.DataFrame:
    none = lambda x: None if x is None or isinstance(x, float) else x
    rows = [check_arguments(k, v, none(p), none(r)) for k, v, p, r in zip(keys, values, properties, required, strict=True)]
    return pd.DataFrame(rows, columns=["json", "valid"])


def json_string(text: Column) -> Column:
    """A JSON string: quote, backslash and the controls are escaped, all other characters stand as they are."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    for c, e in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    rest = [chr(i) for i in range(32) if chr(i) not in "\b\f\n\r\t"]
    escaped = out
    for c in rest:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    out = F.when(out.rlike(r"[\x00-\x1F]"), escaped).otherwise(out)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def json_object(fields: dict[str, Column]) -> Column:
    """A JSON object of JSON values with its keys in order and no spaces; null values are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the highest of them; null on or after a cycle.

    `edges` has (node, after); those of unknown nodes are ignored. A node with one predecessor points at it,
    and pointers double until they end at a root or at a node with several predecessors, so a chain takes as
    many rounds as its length has bits. What is left, nodes with several predecessors, settles level by level.
    """
    nodes = cut(nodes.select("node").dropna().distinct())
    edges = edges.select("node", "after").dropna().distinct().join(nodes, "node", "left_semi")
    edges = cut(edges.join(nodes.select(F.col("node").alias("after")), "after", "left_semi").select("node", "after"))
    fan = cut(edges.groupBy("node").agg(F.count("*").alias("n"), F.min("after").alias("after")))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    pointers = cut(
        nodes.join(fan, "node", "left").select(
            "node", F.when(one, F.col("after")).otherwise(F.col("node")).alias("anchor"), F.when(one, 1).otherwise(0).alias("steps"), one.alias("moving")
        )
    )
    left = None
    while True:
        ends = pointers.select(F.col("node").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"), F.col("moving").alias("on"))
        moved = pointers.filter("moving").join(ends, "anchor").select("node", F.col("next").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("moving"))
        now = pointers.filter("moving").count()
        # each round settles the nearest nodes that are left of every chain; those of cycles never settle
        if not now or now == left:
            break
        pointers, left = cut(pointers.filter("not moving").unionByName(moved)), now
    still = pointers.filter("not moving").drop("moving")
    several = fan.filter("n > 1").select("node")
    settled = cut(still.filter("node = anchor").select("node").join(several, "node", "left_anti").withColumn("level", F.lit(0)))
    ends = still.select(F.col("node").alias("after"), "anchor", (F.col("steps") + 1).alias("weight"))
    # a predecessor on a cycle has no end: its anchor stays null and is never settled
    waiting = cut(edges.join(several, "node", "left_semi").join(ends, "after", "left").select("node", "anchor", "weight"))
    while not waiting.isEmpty():
        known = settled.select(F.col("node").alias("anchor"), "level")
        blocked = waiting.join(known, "anchor", "left_anti").select("node").distinct()
        ready = waiting.join(blocked, "node", "left_anti").join(known, "anchor").groupBy("node").agg(F.max(F.col("level") + F.col("weight")).alias("level"))
        ready = cut(ready)
        if ready.isEmpty():
            break
        settled, waiting = cut(settled.unionByName(ready)), cut(waiting.join(ready, "node", "left_anti"))
    found = still.join(settled.select(F.col("node").alias("anchor"), "level"), "anchor", "left")
    found = found.select("node", (F.col("level") + F.col("steps")).cast("int").alias("level"))
    return nodes.join(found, "node", "left")


def link_tool_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, level, part, call_id, linked, valid, json.

    `messages`: conv_id long, turn long, role string, text string, call_id string, tool string, arguments
    map<string, string> (JSON texts) and after array<string> (identifiers of calls this one uses).
    A row with a tool is a call, one with a call_id and no tool is a result, all others are plain messages.
    `tools`: tool string, properties map<string, string> (a JSON type or a JSON schema as text), required
    array<string>. Further columns of either are not read, whatever their names.

    Identifiers are compared within a conversation. `linked`: a call has a result, a result has a call; null
    for plain messages. `valid`: a call's arguments are JSON and suit its tool's schema, see conforms(); null
    otherwise. Sort by conv_id, level, turn, part, json for the topological order: a result is one level below
    its call, and a call one below the results of the calls that it uses; members of cycles have a null level.
    Repeated identifiers: every result of an identifier is linked to the group of its calls (named by the
    least of their tools), and no row is multiplied; of repeated tools the definition that is least as text
    counts. Nulls: a null conv_id, turn or role is kept, a null text is JSON null, null arguments are none; calls
    and results without identifier or conversation are never linked. An empty table gives an empty result.
    """
    m = messages.select("conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "after")
    m = m.withColumn("part", F.when(F.col("tool").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("message"))
    # messages without an identifier meet nothing, so they are not shuffled by their nulls
    has_key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    named = m.filter(has_key)
    # one row for each identifier: what a hash join by identifier needs of either side
    sides = named.groupBy("conv_id", "call_id").agg(
        F.min("tool").alias("of_tool"), (F.count("tool") > 0).alias("has_call"), (F.count("*") > F.count("tool")).alias("has_result")
    )
    # levels over identifiers: a call waits for the calls it uses
    uses = named.filter("part = 'call' and size(after) > 0").select("conv_id", "call_id", F.explode("after").alias("other"))
    key = lambda c, i: F.concat_ws("\u0001", c.cast("string"), i)
    edges = uses.filter("other is not null").select(key(F.col("conv_id"), F.col("call_id")).alias("node"), key(F.col("conv_id"), F.col("other")).alias("after"))
    sides = sides.withColumn("node", key(F.col("conv_id"), F.col("call_id")))
    if edges.isEmpty():
        sides = sides.withColumn("depth", F.lit(0))
    else:
        depth = levels(sides.filter("has_call").select("node"), edges).withColumnRenamed("level", "depth")
        sides = sides.join(depth, "node", "left").withColumn("depth", F.when(F.col("has_call"), F.col("depth")).otherwise(0))
    # cut, so that the join below is between two plain exchanges, which Spark splits where an identifier is hot
    sides = cut(sides.select("conv_id", "call_id", "of_tool", "has_call", "has_result", "depth"))
    linked = named.join(sides, ["conv_id", "call_id"], "left")
    alone = m.filter(~has_key)
    rows = linked.unionByName(alone, allowMissingColumns=True)
    rows = rows.withColumns({"depth": F.when(has_key, F.col("depth")).otherwise(0), "has_call": F.coalesce("has_call", F.lit(False)), "has_result": F.coalesce("has_result", F.lit(False))})
    is_result = F.col("part") == "result"
    calls = rows.filter("part = 'call'")
    rules = tools.filter("tool is not null").groupBy("tool").agg(F.min(F.struct(F.to_json("properties").alias("properties"), F.to_json("required").alias("required"))).alias("_rule"))
    calls = calls.join(rules, "tool", "left")
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce("arguments", none)
    calls = calls.withColumn("_checked", _checked(F.map_keys(given), F.map_values(given), F.col("_rule.properties"), F.col("_rule.required")))
    call = json_object({
        "arguments": F.col("_checked.json"),
        "id": F.when(F.col("call_id").isNotNull(), json_string(F.col("call_id"))),
        "name": json_string(F.col("tool")),
    })
    body = {"content": json_string(F.col("text")), "role": json_string(F.col("role"))}
    calls = calls.select(
        "conv_id", "turn", (F.col("depth") * 2).cast("int").alias("level"), "part", "call_id", F.col("has_result").alias("linked"),
        F.col("_checked.valid").alias("valid"), json_object({**body, "tool_calls": F.concat(F.lit("["), call, F.lit("]"))}).alias("json"),
    )
    others = rows.filter("part <> 'call'").select(
        "conv_id", "turn", (F.col("depth") * 2 + F.when(is_result & F.col("has_call"), 1).otherwise(0)).cast("int").alias("level"), "part", "call_id",
        F.when(is_result, F.col("has_call")).alias("linked"), F.lit(None).cast("boolean").alias("valid"),
        json_object({
            **body,
            "name": F.when(is_result & F.col("of_tool").isNotNull(), json_string(F.col("of_tool"))),
            "tool_call_id": F.when(is_result, json_string(F.col("call_id"))),
        }).alias("json"),
    )
    return calls.unionByName(others)


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """Messages of link_tool_calls() from plain turns: a user turn calls the tool `answer` with its text and
    turn, has the identifier of conversation and turn and uses the call two turns before, if there is one; an
    assistant turn is the result of the turn before it; a system turn is a message. Nulls are kept; a null role
    is a message, a null conversation or turn gives no identifier."""
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    call_id = F.when(user, name(F.col("turn"))).when(answer, name(F.col("turn") - 1))
    arguments = F.create_map(F.lit("turn"), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("text"), json_string(F.col("text")))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.when(~F.coalesce(user, F.lit(False)), F.col("text").cast("string")).alias("text"),
        call_id.alias("call_id"),
        F.when(user, F.lit("answer")).alias("tool"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, F.array(name(F.col("turn") - 2))).alias("after"),
    )


def answer_tool(conversations: DataFrame) -> DataFrame:
    """The schema of the tool that conversation_calls() uses."""
    return conversations.sparkSession.createDataFrame([("answer", {"text": "string", "turn": "integer"}, ["text"])], "tool string, properties map<string,string>, required array<string>")
