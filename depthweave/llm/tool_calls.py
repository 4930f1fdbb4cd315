"""Chat formatting: tool calls linked to results, ordered, validated, as canonical JSON.

A message text may hold tool calls, as a JSON object with a list `tool_calls` of {id, name or
function.name, arguments (object or JSON text), depends_on (identifiers, optional)}, or be a
result: an object with `tool_call_id` (the role tool, or any). A message may also declare tools, as
a JSON object with a list `tools` of {name or function.name, parameters (a JSON schema)}. Calls and
results of a conversation are hash-joined by identifier; arguments are checked against the schemas
of the tools that the conversation declares (of equal names the first by turn), else of the given
table; messages are ordered so that a call comes before its result and after the results it depends on,
else by turn; each message is serialised with sorted keys and no spare white space.

The order is a pair: order_turn, the greatest turn among a message and all before it in the
links, and order_depth, the length of the longest chain behind it; messages of a conversation
sort by (order_turn, order_depth, turn, message). A call that depends on one of its own message
stays in that message. Both come from rounds of joins over the links
alone, so a conversation of any size needs no task of its own. Messages on a cycle keep their
own turn and are marked.

Null or empty texts are messages without content; texts that aren't such JSON are plain content.
A null conversation is one conversation; a null turn sorts first; of calls with equal identifiers
the first by turn is linked and the others are marked duplicates; a result without a call is an
orphan. A tool that neither the conversation nor the table has is a violation, but where there is no
schema at all nothing is checked, and n_checked is 0. Repeated rows give a row each; an empty table gives an empty result. A text that holds
NaN, an infinity or a number beyond a double isn't JSON; whole numbers have one form (1.0 is 1).
A text of any length is parsed whole; columns other than the four named are not read, so they may
have any names.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import discard, written
from .words import pieces

_MAYBE = re.compile(r"tool_call")
_DECLARES = re.compile(r'"tools"')
_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("depends_on", pa.list_(pa.string()))])
_CALL_SQL = "struct<id:string,name:string,arguments:string,depends_on:array<string>>"
_TOOL = pa.struct([("name", pa.string()), ("schema", pa.string())])
_TOOL_SQL = "struct<name:string,schema:string>"
_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


#: Keywords of a schema whose value must be of a kind to be a rule.
_RULES = {"enum": list, "required": list, "properties": dict, "minimum": (int, float), "maximum": (int, float), "minLength": int, "maxLength": int, "pattern": str}


def canonical(value) -> str:
    """JSON with sorted keys, no spare white space, and characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _number(text: str) -> int | float:
    """A whole number is one, however it is written (1.0, 1e2): equal numbers have one form."""
    x = float(text)
    if math.isinf(x):
        raise ValueError("beyond a double")
    return int(x) if x.is_integer() and abs(x) <= 2**53 else x


def _no_number(text: str):
    raise ValueError(f"{text} isn't JSON")


def read_json(text: str):
    """The value of a JSON text; ValueError or RecursionError where canonical() couldn't write it."""
    value = json.loads(text, parse_float=_number, parse_constant=_no_number)
    canonical(value).encode()  # a lone surrogate can't be written
    return value


def _is_kind(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS.get(kind, object))


def _rules(schema: dict, at: str) -> tuple[dict, list[str]]:
    """The keywords that are rules, and a violation for each that can't be one."""
    rules, faults = {}, []
    for k, kind in _RULES.items():
        if k in schema:
            good = isinstance(schema[k], kind) and not isinstance(schema[k], bool)
            if good and k == "pattern":
                try:
                    re.compile(schema[k])
                except (re.error, RecursionError, OverflowError):
                    good = False
            if good:
                rules[k] = schema[k]
            else:
                faults.append(f"{at}: {k} is no rule")
    return rules, faults


def violations(value, schema, at: str = "$") -> list[str]:
    """Where the value breaks the schema: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength, pattern.

    True allows everything, False nothing. A keyword that can't be a rule (`required: null`, a text
    as `minimum`, a pattern that is none) is a violation itself, and so is a schema that is none.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: schema is no rule"]
    rules, out = _rules(schema, at)
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not all(isinstance(k, str) for k in kinds):
            out.append(f"{at}: type is no rule")
        elif not any(_is_kind(value, k) for k in kinds):
            return [*out, f"{at}: type"]
    if "enum" in rules and canonical(value) not in [canonical(x) for x in rules["enum"]]:
        out.append(f"{at}: enum")
    if isinstance(value, dict):
        own = rules.get("properties", {})
        out += [f"{at}.{k}: required" for k in rules.get("required", []) if str(k) not in value]
        for k, v in value.items():
            if k in own:
                out += violations(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unexpected")
            elif "additionalProperties" in schema:
                out += violations(v, schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if _is_kind(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < rules.get("minimum", value)), ("maximum", value > rules.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < rules.get("minLength", 0)), ("maxLength", len(value) > rules.get("maxLength", len(value)))) if bad]
        if "pattern" in rules and not re.search(rules["pattern"], value):
            out.append(f"{at}: pattern")
    return out


def parse(role: str | None, text: str | None) -> tuple[list[dict], str | None, object]:
    """(calls, identifier of the call this is the result of, content)."""
    if not text or not _MAYBE.search(text):
        return [], None, text or ""
    try:
        value = read_json(text)
    except (ValueError, RecursionError):
        return [], None, text
    if not isinstance(value, dict):
        return [], None, text
    calls = []
    given = value.get("tool_calls")
    for c in given if isinstance(given, list) else []:
        f = c.get("function") if isinstance(c, dict) else None
        f = f if isinstance(f, dict) else c
        if not isinstance(c, dict) or c.get("id") is None:
            return [], None, text
        args = f.get("arguments", {})
        if isinstance(args, str):
            try:
                args = read_json(args)
            except (ValueError, RecursionError):
                pass
        after = c.get("depends_on")
        calls.append({"id": str(c["id"]), "name": str(f.get("name") or ""), "arguments": canonical(args), "depends_on": sorted({str(x) for x in after}) if isinstance(after, list) else []})
    answers = value.get("tool_call_id")
    if not calls and answers is None:
        return [], None, text
    content = value.get("content")
    return calls, None if answers is None else str(answers), "" if content is None else content


def declared(text: str | None) -> list[dict]:
    """The tools that a message declares, with their schemas as JSON; without parameters, all are allowed."""
    if not text or not _DECLARES.search(text):
        return []
    try:
        value = read_json(text)
    except (ValueError, RecursionError):
        return []
    given = value.get("tools") if isinstance(value, dict) else None
    out = []
    for c in given if isinstance(given, list) else []:
        f = c.get("function") if isinstance(c, dict) else None
        f = f if isinstance(f, dict) else c
        if isinstance(f, dict) and isinstance(f.get("name"), str):
            out.append({"name": f["name"], "schema": canonical(f.get("parameters", True))})
    return out


def checked(call: str, arguments: str, schema) -> list[str]:
    """What of a call's arguments, as JSON, breaks its tool's schema."""
    try:
        return [f"{call}: {v}" for v in violations(json.loads(arguments), schema)]
    except RecursionError:
        return [f"{call}: too deep to check"]


def _parsed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per message: its calls, what it answers, the tools it declares, canonical JSON."""

    def run(batches):
        for b in pieces(batches, text):
            rows = [parse(r, t) for r, t in zip(b.column(role).to_pylist(), b.column(text).to_pylist(), strict=True)]
            lines = []
            for r, (calls, answers, content) in zip(b.column(role).to_pylist(), rows, strict=True):
                whole = {"role": r, "content": content}
                if calls:
                    whole["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"])} | ({"depends_on": c["depends_on"]} if c["depends_on"] else {}) for c in calls]
                if answers is not None:
                    whole["tool_call_id"] = answers
                lines.append(canonical(whole))
            cols = [b.column(conv), b.column(turn), b.column(role), pa.array([r[0] for r in rows], pa.list_(_CALL)), pa.array([r[1] for r in rows], pa.string()), pa.array([declared(t) for t in b.column(text).to_pylist()], pa.list_(_TOOL)), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv", "turn", "role", "calls", "answers", "tools", "line"])

    types = dict(df.dtypes)
    return df.select(conv, turn, role, text).mapInArrow(run, f"conv {types[conv]}, turn {types[turn]}, role {types[role]}, calls array<{_CALL_SQL}>, answers string, tools array<{_TOOL_SQL}>, line string")


def _checks(rows: DataFrame, calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(uid, n_checked, broken): each call's arguments against its tool's schema."""
    tools = rows.where(F.size("tools") > 0).select("uid", "conv", "turn", F.posexplode("tools").alias("pos", "t"))
    first = F.min(F.struct(F.coalesce("turn", F.lit(-(2**31))).alias("t"), "uid", "pos", "t.schema"))
    own = written(tools.groupBy("conv", F.col("t.name").alias("name")).agg(first.alias("f")).select("conv", "name", F.col("f.schema").alias("schema")), "tools")
    told = own.select(F.col("conv").alias("_conv"), F.lit(True).alias("tells")).distinct()
    own = own.select(F.col("conv").alias("_own"), F.col("name").alias("_name"), "schema")

    @F.udf("array<string>")
    def check(call, name, arguments, schema, tells):
        if schema is None and name not in schemas:
            return [f"{call}: unknown tool"] if tells or schemas else None
        return checked(call, arguments, schemas[name] if schema is None else json.loads(schema))

    j = calls.join(own, calls["conv"].eqNullSafe(F.col("_own")) & (calls["name"] == F.col("_name")), "left").join(told, calls["conv"].eqNullSafe(F.col("_conv")), "left")
    j = j.select("uid", "pos", check("id", "name", "arguments", "schema", "tells").alias("bad")).where("bad is not null")
    found = j.groupBy("uid").agg(F.count("*").alias("n_checked"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bad"))), lambda x: x["bad"])).alias("broken"))
    return written(found, "checks")  # its size is known then: messages don't move while it is small


def _ordered(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """(uid, order_turn, order_depth) of nodes behind an edge (before, after); cycles are left out."""
    known = written(turns.join(edges.select(F.col("after").alias("uid")).distinct(), "uid", "left_anti").select("uid", "turn", F.lit(0).alias("depth")), "order")
    left = written(edges, "edges")
    while True:
        done = known.select(F.col("uid").alias("before"), F.col("turn").alias("t"), F.col("depth").alias("d"))
        ready = left.join(done, "before", "left").groupBy("after").agg(F.max("t").alias("t"), F.max("d").alias("d"), F.sum(F.col("d").isNull().cast("int")).alias("open")).where("open = 0")
        new = written(ready.join(turns.withColumnRenamed("uid", "after"), "after").select(F.col("after").alias("uid"), F.greatest("turn", "t").alias("turn"), (F.col("d") + 1).alias("depth")), "order")
        if new.isEmpty():
            break
        rest = written(left.join(new.select(F.col("uid").alias("after")), "after", "left_anti"), "edges")
        after = written(known.union(new), "order")
        discard(known)
        discard(left)
        known, left = after, rest
        if left.isEmpty():
            break
    return known


def link_tools(df: DataFrame, schemas: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, order_turn, order_depth, n_calls, n_linked,
    n_duplicate, answers, orphan, cyclic, n_checked, valid, violations, line.

    schemas: by tool name, its JSON schema, for tools that a conversation doesn't declare itself; a
    short table by nature, it goes to all tasks. n_checked: calls held against a schema or the names.
    """
    parsed = _parsed(df, conv, turn, role, text).withColumn("uid", F.monotonically_increasing_id())
    rows = written(parsed, "messages")
    calls = rows.where(F.size("calls") > 0).select("uid", "conv", "turn", F.posexplode("calls").alias("pos", "c")).select("uid", "conv", "turn", "pos", "c.id", "c.name", "c.arguments", "c.depends_on")
    firsts = calls.groupBy("conv", "id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(2**31))).alias("t"), "uid", "pos")).alias("f")).select("conv", "id", F.col("f.uid").alias("call_uid"), F.col("f.pos").alias("call_pos"))
    firsts = written(firsts, "calls")
    results = rows.where("answers is not null").select(F.col("uid").alias("result_uid"), "conv", F.col("answers").alias("id"))
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["id"] == b["id"])
    linked = written(results.join(firsts, same(results, firsts)).select("result_uid", "call_uid", "call_pos", firsts["conv"], firsts["id"]), "links")
    needs = calls.select(F.col("uid").alias("after"), "conv", F.explode("depends_on").alias("id"))
    answered = linked.select("conv", "id", F.col("result_uid").alias("before"), "call_uid")
    edges = linked.select(F.col("call_uid").alias("before"), F.col("result_uid").alias("after")).union(needs.join(answered, same(needs, answered)).where("call_uid <> after").select("before", "after")).distinct()
    edges = written(edges, "edges")
    ends = edges.select(F.col("before").alias("uid")).union(edges.select("after")).distinct()
    turns = written(rows.join(ends, "uid").select("uid", "turn"), "turns")
    order = _ordered(edges, turns) if not edges.isEmpty() else turns.select("uid", "turn", F.lit(0).alias("depth"))
    order = order.select("uid", F.col("turn").alias("order_turn"), F.col("depth").alias("order_depth"))
    per_call = linked.select(F.col("call_uid").alias("uid"), "call_pos").distinct().groupBy("uid").agg(F.count("*").alias("n_linked"))
    own = firsts.groupBy(F.col("call_uid").alias("uid")).agg(F.count("*").alias("n_first"))
    hit = linked.select(F.col("result_uid").alias("uid"), F.lit(True).alias("found")).distinct()
    cyclic = turns.select("uid").join(order, "uid", "left_anti").withColumn("cyclic", F.lit(True))
    out = rows
    for part in (order, per_call, own, hit, cyclic, _checks(rows, calls, dict(schemas or {}))):
        out = out.join(part, "uid", "left")
    n = F.size("calls").cast("long")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_depth", F.lit(0)).cast("long").alias("order_depth"),
        n.alias("n_calls"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), (n - F.coalesce("n_first", F.lit(0))).cast("long").alias("n_duplicate"),
        "answers", (F.col("answers").isNotNull() & F.col("found").isNull()).alias("orphan"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("n_checked", F.lit(0)).cast("long").alias("n_checked"), F.coalesce(F.size("broken") <= 0, F.lit(True)).alias("valid"), F.concat_ws("; ", "broken").alias("violations"), "line",
    )


def transcript_order(linked: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """linked with `position`, a message's place in its conversation: one sort, which spills, and no state."""
    return linked.withColumn("position", F.row_number().over(W.partitionBy(conv).orderBy("order_turn", "order_depth", turn, "line")))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES = {"op5_tool_call_linking": op5_tool_call_linking}
SQL: dict[str, str] = {}
