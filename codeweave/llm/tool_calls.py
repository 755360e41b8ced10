"""Chat formatting: linking tool calls with their results.

* Calls and results are hash-joined on (conversation, call id). Ids used twice are reduced to their
  earliest row first, so the join is one to one, whatever an id repeats.
* A call may depend on others (results it uses). Levels, the longest chain of dependencies below
  a call, give the topological order (level, turn, id). They are found by substitution over all
  conversations at once: an edge to a call with a single open dependency is replaced by
  an edge to that one, so chains halve in every round, however long a conversation is; no
  conversation is ever gathered in a task. Calls in or behind cycles have no level.
* Arguments are parsed and validated against the tool's JSON schema (``validate``: type, enum, const,
  required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength, minItems, maxItems).
* Each link becomes canonical JSON: keys by UTF-16 units, no blanks, shortest numbers, minimal escapes.

Statuses: linked, no_result, orphan_result (no such call), no_id (null id or conversation: never linked).

Defined cases: later rows of a repeated id only count in ``n_calls`` and ``n_results``; null arguments
are no JSON (invalid), and so are texts that do not parse; arguments with numbers beyond doubles, unpaired surrogates or
more than ``MAX_DEPTH`` levels stay their text, with an error; integers beyond 2^53 become the nearest double;
an unknown tool and a schema that is none are errors; null dependencies and those on missing calls are ignored;
null content is JSON null; empty tables give an empty result; other columns are ignored."""
from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, load, own_columns, stage

# -- canonical JSON and schemas -----------------------------------------------------------


class NotCanonical(ValueError):
    """A value without canonical JSON; the text says why."""


#: Arguments nested deeper than this are refused.
MAX_DEPTH = 100
_UNPAIRED = re.compile("[\ud800-\udfff]")


def _string(x: str) -> str:
    if _UNPAIRED.search(x):
        raise NotCanonical("unpaired surrogate")
    return json.dumps(x, ensure_ascii=False)


def _number(x) -> str:
    if isinstance(x, int):
        if abs(x) <= 1 << 53:
            return str(x)
        x = float(x) if abs(x) < 1 << 1023 else math.inf  # numbers are doubles
    if not math.isfinite(x):
        raise NotCanonical("number out of range")
    if x == 0:
        return "0"
    # digits and decimal exponent of the shortest text that reads back as x
    sign, digits, exp = Decimal(repr(x)).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + exp
    if 0 < point <= 21:
        out = d[:point] + "." + d[point:] if point < len(d) else d + "0" * (point - len(d))
    elif -6 < point <= 0:
        out = "0." + "0" * -point + d
    else:
        out = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def canonical(x, deep: int = MAX_DEPTH) -> str:
    """Canonical JSON text of a parsed value. Raises NotCanonical for unpaired surrogates, numbers beyond
    doubles and values nested deeper than ``deep``."""
    if deep < 0:
        raise NotCanonical("too deep")
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, (int, float)):
        return _number(x)
    if isinstance(x, str):
        return _string(x)
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical(x[k], deep - 1)}" for k in keys) + "}"
    return "[" + ",".join(canonical(y, deep - 1) for y in x) + "]"


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(x, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer())
    if kind == "number":
        return not isinstance(x, bool) and isinstance(x, (int, float))
    return isinstance(x, _TYPES[kind])


def validate(x, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, as 'path: reason' in a fixed order; empty if it is valid."""
    bad = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(x, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and x not in schema["enum"]:
        bad.append(f"{at}: not in enum")
    if "const" in schema and x != schema["const"]:
        bad.append(f"{at}: not the constant")
    if _is(x, "number"):
        if "minimum" in schema and x < schema["minimum"]:
            bad.append(f"{at}: under minimum")
        if "maximum" in schema and x > schema["maximum"]:
            bad.append(f"{at}: over maximum")
    for kind, size, low, high in ((str, "length", "minLength", "maxLength"), (list, "items", "minItems", "maxItems")):
        if isinstance(x, kind):
            if low in schema and len(x) < schema[low]:
                bad.append(f"{at}: too few {size}")
            if high in schema and len(x) > schema[high]:
                bad.append(f"{at}: too many {size}")
    if isinstance(x, dict):
        known = schema.get("properties", {})
        bad += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in x]
        for k in sorted(x):
            if k in known:
                bad += validate(x[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                bad.append(f"{at}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                bad += validate(x[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(x, list) and "items" in schema:
        for i, y in enumerate(x):
            bad += validate(y, schema["items"], f"{at}[{i}]")
    return bad


def _no_constant(name):
    raise ValueError(name)


def format_link(call_id, name, arguments, schema, content, has_call, has_result):
    """(errors, canonical JSON of the call's and the result's message) of one link."""
    errors, messages = [], []
    if has_call:
        args, errors = read_arguments(arguments, schema)
        messages.append({"role": "assistant", "tool_calls": [{"id": call_id, "type": "function", "function": {"name": name, "arguments": args}}]})
    if has_result:
        messages.append({"role": "tool", "tool_call_id": call_id, "content": content})
    return errors, canonical(messages)


def read_arguments(arguments: str | None, schema: str | None):
    """(parsed arguments, errors); arguments that cannot be read or written canonically stay their text."""
    try:
        args = json.loads(arguments, parse_constant=_no_constant)
        canonical(args)
    except NotCanonical as e:
        return arguments, [f"$: {e}"]
    except RecursionError:
        return arguments, ["$: too deep"]
    except (TypeError, ValueError):
        return arguments, ["$: no JSON"]
    if schema is None:
        return args, ["$: unknown tool"]
    try:
        return args, validate(args, json.loads(schema))
    except (ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError):
        return args, ["$: bad schema"]


# -- levels ------------------------------------------------------------------------------------

def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, parents); calls in or behind cycles are left out."""
    nodes = calls.select("conv_id", "call_id").distinct()
    edges = (calls.select("conv_id", F.col("call_id").alias("c"), F.explode("parents").alias("p")).filter("p is not null").distinct()
             .join(nodes.withColumnRenamed("call_id", "p"), ["conv_id", "p"], "left_semi").select("conv_id", "c", "p", F.lit(1).cast("long").alias("w")))
    # ground: levels below which a call cannot be; open edges: still to be replaced
    open_edges = stage(edges, "edges")
    ground = stage(nodes.select("conv_id", F.col("call_id").alias("c"), F.lit(0).cast("long").alias("g")), "ground")
    count, mark = nodes.count(), None
    while True:
        now = open_edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("conv_id", "c", "p", "w"), F.lit(1 << 31)))).first()
        if not now[0] or tuple(now) == mark:
            break
        mark = tuple(now)
        node = (ground.join(open_edges.groupBy("conv_id", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("p", "w")).alias("one")),
                            ["conv_id", "c"], "left")
                .select("conv_id", F.col("c").alias("p"), "g", F.coalesce("k", F.lit(0)).alias("k"), F.col("one.p").alias("pp"), F.col("one.w").alias("pw")))
        j = stage(open_edges.join(node, ["conv_id", "p"]), "substitute")
        few = F.col("k") <= 1
        lift = j.filter(few).select("conv_id", "c", (F.col("g") + F.col("w")).alias("g"))
        ground = stage(ground.unionByName(lift).groupBy("conv_id", "c").agg(F.max("g").alias("g")), "ground")
        nxt = j.filter("k >= 1").select("conv_id", "c", F.when(few, F.col("pp")).otherwise(F.col("p")).alias("p"),
                                        F.when(few, F.col("w") + F.col("pw")).otherwise(F.col("w")).alias("w"))
        # a chain longer than all calls goes round in a circle: its edge becomes one to the call
        # itself, which is replaced by itself from then on
        circle = F.col("w") > count
        nxt = nxt.select("conv_id", "c", F.when(circle, F.col("c")).otherwise(F.col("p")).alias("p"), F.least("w", F.lit(count + 1)).alias("w"))
        nxt = nxt.groupBy("conv_id", "c", "p").agg(F.max("w").alias("w"))
        open_edges = stage(nxt, "edges")
    stuck = open_edges.select("conv_id", "c").distinct()
    return ground.join(stuck, ["conv_id", "c"], "left_anti").select("conv_id", F.col("c").alias("call_id"), F.col("g").alias("level"))


# -- linking ---------------------------------------------------------------------------------

def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per (conversation, id) of calls (conv_id, call_id, turn, name, arguments, parents) and
    results (conv_id, call_id, turn, content): conv_id, call_id, status, turn, result_turn, n_calls,
    n_results, level, valid, errors, json. Order a conversation by level, turn, call_id.
    Rows without an id come one by one."""
    c = own_columns(calls, conv_id=("conv_id", "long"), call_id=("call_id", "string"), turn=("turn", "long"),
                    name=("name", "string"), arguments=("arguments", "string"), parents=("parents", "array<string>"))
    r = own_columns(results, conv_id=("conv_id", "long"), call_id=("call_id", "string"), turn=("turn", "long"), content=("content", "string"))
    t = own_columns(tools, name=("name", "string"), schema=("schema", "string")).groupBy("name").agg(F.min("schema").alias("schema"))
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    late = F.col("turn").isNull()
    c1 = (c.filter(keyed).groupBy("conv_id", "call_id")
          .agg(F.min(F.struct(late.alias("late"), "turn", "name", "arguments", "parents")).alias("call"), F.count(F.lit(1)).alias("n_calls")))
    r1 = (r.filter(keyed).groupBy("conv_id", "call_id")
          .agg(F.min(F.struct(late.alias("late"), "turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results")))
    both = c1.join(r1, ["conv_id", "call_id"], "full")
    lone_c = c.filter(~keyed).select("conv_id", "call_id", F.struct(late.alias("late"), "turn", "name", "arguments", "parents").alias("call"),
                                     F.lit(1).cast("long").alias("n_calls"))
    lone_r = r.filter(~keyed).select("conv_id", "call_id", F.struct(late.alias("late"), "turn", "content").alias("result"),
                                     F.lit(1).cast("long").alias("n_results"))
    both = both.withColumn("keyed", F.lit(True)).unionByName(lone_c.withColumn("keyed", F.lit(False)), allowMissingColumns=True) \
        .unionByName(lone_r.withColumn("keyed", F.lit(False)), allowMissingColumns=True)
    status = F.when(~F.col("keyed"), "no_id").when(F.col("call").isNull(), "orphan_result").when(F.col("result").isNull(), "no_result").otherwise("linked")
    lv = levels(c1.select("conv_id", "call_id", "call.parents"))
    rows = both.join(lv, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", status.alias("status"), F.col("call.turn").alias("turn"), F.col("result.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "level",
        F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"), F.col("result.content").alias("content"),
        F.col("call").isNotNull().alias("has_call"), F.col("result").isNotNull().alias("has_result"))
    rows = rows.join(t, "name", "left")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            got = [format_link(*x) for x in zip(*(b.column(k).to_pylist() for k in (
                "call_id", "name", "arguments", "schema", "content", "has_call", "has_result")))]
            valid = [not e if h else None for (e, _), h in zip(got, b.column("has_call").to_pylist())]
            keep = ["conv_id", "call_id", "status", "turn", "result_turn", "n_calls", "n_results", "level"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(valid, pa.bool_()),
                                              pa.array(["; ".join(e) for e, _ in got], pa.string()), pa.array([j for _, j in got], pa.string())],
                                             names=[*keep, "valid", "errors", "json"])
    return rows.mapInArrow(run, "conv_id long, call_id string, status string, turn long, result_turn long, n_calls long, n_results long, "
                                "level long, valid boolean, errors string, json string")


# -- the query -----------------------------------------------------------------------------------

#: Tools of the demonstration: a turn's number picks one.
TOOLS = (
    ("search", {"type": "object", "required": ["text", "turn", "words"], "additionalProperties": False,
                "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0},
                               "words": {"type": "integer", "maximum": 60}}}),
    ("summarise", {"type": "object", "required": ["text", "words"],
                   "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 20}}}),
    ("reply", {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}}),
)


def from_conversations(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: every assistant turn is a call with its text and
    size as arguments, which needs the result of the call two turns before; every user turn after
    the first is the result of the turn before it."""
    c = own_columns(conv, conv_id=("conv_id", "long"), turn=("turn", "long"), role=("role", "string"), text=("text", "string"))

    def ident(turn):
        return F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in TOOLS]), (F.pmod("turn", F.lit(len(TOOLS))) + 1).cast("int"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    calls = c.filter("role = 'assistant'").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text"), words.alias("words"))).alias("arguments"),
        F.array(ident(F.col("turn") - 2)).alias("parents"))
    results = c.filter("role = 'user' and turn > 0").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark, sf_dir):
    calls, results = from_conversations(load(spark, sf_dir, "conversations"))
    tools = spark.createDataFrame([(n, json.dumps(s)) for n, s in TOOLS], "name string, schema string")
    return link(calls, results, tools)


QUERIES = {"op1_tool_calls": op1_tool_calls}
ORACLES = {"op1_tool_calls": r"""
WITH c AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role, text,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations ORDER BY conv_id, turn),
a AS (SELECT *, turn % 2 AS par, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS rn FROM c WHERE role = 'assistant'),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, par, turn // 2 - rn ORDER BY turn) - 1 AS level FROM a),
r AS (SELECT * FROM c WHERE role = 'user' AND turn > 0),
j AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn - 1) AS t, l.turn, r.turn AS result_turn,
        l.level, l.text, l.words, r.text AS content, l.conv_id IS NOT NULL AS has_call, r.conv_id IS NOT NULL AS has_result
      FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn - 1),
k AS (SELECT *, 'call-' || conv_id || '-' || t AS call_id, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'reply' END AS name,
        CASE WHEN NOT has_call THEN '' WHEN turn % 3 = 0 THEN array_to_string(list_filter([
            CASE WHEN text IS NULL THEN '$.text: missing' END,
            CASE WHEN length(text) < 1 THEN '$.text: too few length' END, CASE WHEN words > 60 THEN '$.words: over maximum' END],
            lambda x: x IS NOT NULL), '; ')
          WHEN turn % 3 = 1 THEN array_to_string(list_filter([CASE WHEN text IS NULL THEN '$.text: missing' END,
            CASE WHEN words < 20 THEN '$.words: under minimum' END], lambda x: x IS NOT NULL), '; ')
          ELSE CASE WHEN text IS NULL THEN '$.text: missing' ELSE '' END END AS errors FROM j)
SELECT conv_id, call_id, CASE WHEN NOT has_call THEN 'orphan_result' WHEN NOT has_result THEN 'no_result' ELSE 'linked' END AS status,
  turn, result_turn, CAST(has_call AS BIGINT) AS n_calls, CAST(has_result AS BIGINT) AS n_results, level,
  CASE WHEN has_call THEN errors = '' END AS valid, errors,
  '[' || array_to_string(list_filter([
    CASE WHEN has_call THEN '{"role":"assistant","tool_calls":[{"function":{"arguments":{' ||
      coalesce('"text":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || turn || ',"words":' || words ||
      '},"name":"' || name || '"},"id":"' || call_id || '","type":"function"}]}' END,
    CASE WHEN has_result THEN '{"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') ||
      ',"role":"tool","tool_call_id":"' || call_id || '"}' END], lambda x: x IS NOT NULL), ',') || ']' AS json FROM k"""}
