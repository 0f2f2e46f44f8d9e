"""Chat formatting: links tool calls to their results and writes conversations as canonical JSON.

Calls and results are hash-joined by conversation and identifier. Calls are ordered topologically: a call that uses
another's result (by its identifier in a string argument, as ``$id``) comes after it. Arguments are checked against
the tools' schemas. What is wrong is told, never dropped: each call and each result has a status.

A message of role assistant makes calls where its text is JSON with ``tool_calls``: a list of objects with ``id``,
``name`` and ``arguments`` (an object, or its JSON as a string). A message of role tool is a result where its text is
JSON with ``tool_call_id`` and ``content``. Any other message is text. JSON that nests deeper than 100, or holds what
is no JSON (NaN, Infinity, numbers beyond a double), is text as a message and invalid as arguments.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Tools of the query: a schema of the arguments by name.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]},
}
DEEPEST = 100


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes but those that JSON needs; lone surrogates are escaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8", "backslashreplace").decode()


def sound(text: str | None) -> str | None:
    """text without lone surrogates, which are no characters: they are written as escapes."""
    return None if text is None else text.encode("utf-8", "backslashreplace").decode()


def _number(text: str) -> float:
    if math.isinf(x := float(text)):
        raise ValueError(f"{text} is beyond a double")
    return x


def _integer(text: str) -> int:
    if len(text) > 400:
        raise ValueError("an integer of over 400 digits")
    return int(text)


def _no_constant(text: str):
    raise ValueError(f"{text} is no JSON")


def as_json(text: str | None):
    """The value of a JSON text; ValueError if it is none or nests too deeply."""
    try:
        value = json.loads(text or "", parse_constant=_no_constant, parse_float=_number, parse_int=_integer)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    layer = [value]
    for _ in range(DEEPEST):
        layer = [v for x in layer if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not layer:
            return value
    raise ValueError("nested too deeply")


def _as_object(text: str | None) -> dict:
    try:
        v = as_json(text)
    except ValueError:
        return {}
    return v if isinstance(v, dict) else {}


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What in value breaks the schema: type, enum, minimum, maximum, properties, required, additionalProperties, items."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    if kind == "integer":
        right = isinstance(value, int) and not isinstance(value, bool)
    elif kind == "number":
        right = isinstance(value, (int, float)) and not isinstance(value, bool)
    else:
        right = kind is None or isinstance(value, kinds[kind])
    if not right:
        return [f"{at}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values allowed")
    if kind in ("integer", "number"):
        out += [f"{at}: below the minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above the maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{at}[{i}]")
    return out


def _references(value) -> set[str]:
    if isinstance(value, str):
        return {value[1:]} if value.startswith("$") else set()
    if isinstance(value, (dict, list)):
        return set().union(*map(_references, value.values() if isinstance(value, dict) else value))
    return set()


ROWS = "conv_id long, turn long, role string, message long, content string, nth int, kind string, id string, name string, body string, uses array<string>, faults array<string>"


def parsed(conversations: DataFrame, tools: dict) -> DataFrame:
    """A row for each text, call and result; message is a hash of the text, nth numbers the rows of a message.

    content, on every row of a message that makes calls, is what it says besides.
    """

    def call(c, where: tuple) -> tuple:
        c = c if isinstance(c, dict) else {}
        args, name, wrong = c.get("arguments"), c.get("name"), []
        if isinstance(args, str):
            try:
                args = as_json(args)
            except ValueError:
                wrong = ["$: no JSON"]
        schema = tools.get(name) if isinstance(name, str) else None
        wrong = wrong or (["$: no such tool"] if schema is None else faults(args, schema))
        ident = sound(c["id"]) if isinstance(c.get("id"), str) else None
        return (*where, "call", ident, sound(name) if isinstance(name, str) else None, canonical(args), sorted(map(sound, _references(args))), [sound(w) for w in wrong])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for conv, turn, role, text, key in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"], pdf["message"], strict=True):
                o = _as_object(text) if role in ("assistant", "tool") else {}
                calls = o.get("tool_calls") if role == "assistant" else None
                head = (None if pd.isna(conv) else int(conv), None if pd.isna(turn) else int(turn), role, key)
                if isinstance(calls, list) and calls:
                    said = canonical(o["content"]) if o.get("content") is not None else None
                    out += [call(c, (*head, said, i)) for i, c in enumerate(calls)]
                elif role == "tool" and isinstance(o.get("tool_call_id"), str):
                    out.append((*head, None, 0, "result", sound(o["tool_call_id"]), None, canonical(o.get("content")), [], []))
                else:
                    out.append((*head, None, 0, "text", None, None, canonical(text), [], []))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "message", "content", "nth", "kind", "id", "name", "body", "uses", "faults"]).astype({"conv_id": "Int64", "turn": "Int64"})

    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text"), F.xxhash64(F.col("text").isNull(), "text").alias("message")]
    return conversations.select(*cols).mapInPandas(run, ROWS)


def depths(calls: DataFrame, named: DataFrame) -> DataFrame:
    """d_key, n, cyclic of calls (conv_id, c_key, uses) that use results of named ones (conv_id, id, c_key).

    n is one more than that of the deepest call whose result is used; calls that use none have no row. By doubling:
    known[i] holds, per call, the calls at the end of paths of 2**i uses; a chain of n calls takes log2(n) rounds, and
    the longest path of a call is read off the powers from the largest down. A path longer than its conversation has
    calls comes from a cycle, and its calls are cyclic.
    """
    by_id = named.select(F.col("conv_id").alias("u_conv"), F.col("id").alias("u_id"), F.col("c_key").alias("u_key"))
    edges = calls.select("conv_id", "c_key", F.explode("uses").alias("used")).join(by_id, (F.col("conv_id") == F.col("u_conv")) & (F.col("used") == F.col("u_id")))
    known = [cut(edges.select("conv_id", F.col("c_key").alias("a"), F.col("u_key").alias("b")).distinct())]
    sizes = known[0].groupBy("conv_id").agg((F.countDistinct("a") + 1).alias("most"))
    most = sizes.agg(F.max("most")).first()[0] or 0

    def onwards(paths: DataFrame, step: DataFrame) -> DataFrame:
        nexts = step.select(F.col("a").alias("m"), F.col("b").alias("c"))
        return paths.join(nexts, F.col("b") == F.col("m"))

    while 1 << (len(known) - 1) < most and not known[-1].isEmpty():
        known.append(cut(onwards(known[-1], known[-1]).select("conv_id", "a", F.col("c").alias("b")).distinct()))
    # at: where a call's paths of n uses end; those that can go on by 2**i uses do, from the largest i down
    starts = known[0].select("a").distinct()
    at = starts.select("a", F.col("a").alias("b"), F.lit(0).alias("n"))
    for i in range(len(known) - 1, -1, -1):
        longer = cut(onwards(at, known[i]).select("a", F.col("c").alias("b"), (F.col("n") + (1 << i)).alias("n")).distinct())
        went = longer.select(F.col("a").alias("w")).distinct()
        at = cut(at.join(went, F.col("a") == F.col("w"), "left_anti").union(longer))
    longest = at.groupBy("a").agg(F.max("n").alias("n"))
    conv = known[0].groupBy("a").agg(F.first("conv_id").alias("conv_id")).select(F.col("a").alias("v"), F.col("conv_id").alias("v_conv"))
    longest = longest.join(conv, F.col("a") == F.col("v")).join(sizes, F.col("v_conv").eqNullSafe(F.col("conv_id")))
    return cut(longest.select(F.col("a").alias("d_key"), "n", (F.col("n") >= F.col("most")).alias("cyclic")))


def linked(conversations: DataFrame, tools: dict) -> DataFrame:
    """A row for each text, call and result, with its status; of a call the turn that answers it, of a result the call's.

    Calls: invalid (arguments or tool), cyclic, unanswered or ok; results: orphan (no call before it), duplicate (a
    later one of the same call) or ok; the first that holds. depth orders a message's calls: a call follows those whose
    results it uses, wherever they were made; null on or after a cycle.
    Conversation and identifier are the join's key, so an identifier that many conversations share meets only its own.
    An identifier that calls of a conversation repeat belongs to the first of them, as does the first result. Null
    identifiers link to nothing. A repeated row of conversations is one message, said once.
    """
    where = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "message", "nth")
    m = cut(parsed(conversations, tools).distinct().withColumn("c_key", F.xxhash64("conv_id", "turn", "role", "message", "nth")))
    named = m.where("kind <> 'text' and id is not null")
    first = named.groupBy("conv_id", "kind", "id").agg(F.min(F.struct(where.alias("at"), "c_key")).alias("f"))
    first = cut(first.select(F.col("conv_id").alias("l_conv"), F.col("id").alias("l_id"), "kind", F.col("f.c_key").alias("l_key"), F.col("f.at.turn").alias("l_turn")))
    same = F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id"))
    made, said = (first.where(F.col("kind") == k).drop("kind") for k in ("call", "result"))
    answers = named.where("kind = 'result'").select("conv_id", "id", "turn", "c_key").join(said.select("l_conv", "l_id", F.col("l_key").alias("lead")).hint("shuffle_hash"), same).drop("l_conv", "l_id")
    answers = answers.join(made.hint("shuffle_hash"), same, "left")
    answers = cut(answers.select("c_key", F.col("turn").alias("a_turn"), (F.col("c_key") == F.col("lead")).alias("leads"), "l_key", "l_turn", F.coalesce(F.col("l_turn") < F.col("turn"), F.lit(False)).alias("after")))
    replied = answers.where("leads and after").select(F.col("l_key").alias("r_key"), F.col("a_turn").alias("linked_turn"))
    calls = m.where("kind = 'call'")
    first_calls = calls.join(made.select("l_key"), F.col("c_key") == F.col("l_key"), "left_semi")
    deep = depths(calls.select("conv_id", "c_key", "uses"), first_calls.select("conv_id", "id", "c_key"))
    c = calls.join(deep, F.col("c_key") == F.col("d_key"), "left").join(replied, F.col("c_key") == F.col("r_key"), "left")
    c = c.withColumn("depth", F.when(F.coalesce("cyclic", F.lit(False)), F.lit(None)).otherwise(F.coalesce("n", F.lit(0))))
    c = c.withColumn("status", F.when(F.size("faults") > 0, "invalid").when(F.col("depth").isNull(), "cyclic").when(F.col("r_key").isNull(), "unanswered").otherwise("ok"))
    told = answers.select(F.col("c_key").alias("a_key"), F.when(~F.col("after"), "orphan").when(~F.col("leads"), "duplicate").otherwise("ok").alias("status"), F.when(F.col("after"), F.col("l_turn")).alias("linked_turn"))
    r = m.where("kind = 'result'").join(told, F.col("c_key") == F.col("a_key"), "left").withColumn("depth", F.lit(0))
    t = m.where("kind = 'text'").withColumns({"status": F.lit("ok"), "depth": F.lit(0), "linked_turn": F.lit(None).cast("long")})
    out = ["conv_id", "turn", "role", "message", "content", "nth", "kind", "id", "name", "body", "faults", "depth", "status", "linked_turn"]
    return c.select(out).union(r.select(out)).union(t.select(out))


def formatted(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """A row a message: conv_id, turn, role, json, calls, problems, answers.

    json: canonical, an object with ``role`` and ``content`` (a message of text), with ``tool_calls`` in topological
    order and ``content`` if there is, or with ``tool_call_id`` and ``content``. calls: how many calls the message
    makes; problems: the statuses other than ok, sorted; answers: of a result the turn of its call. A message is a
    group of its own, so no task holds a conversation. Repeated rows are one message, said once; null texts are null
    content; null ids and turns are kept; an empty table gives no rows; other columns are not read.
    """
    x = linked(conversations, TOOLS if tools is None else tools)
    call = F.struct(F.coalesce("depth", F.lit(1 << 30)).alias("d"), "nth", F.concat(F.lit('{"arguments":'), "body", F.lit(',"id":'), _quoted("id"), F.lit(',"name":'), _quoted("name"), F.lit("}")).alias("json"))
    g = x.groupBy("conv_id", "turn", "role", "message").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "call", call))).alias("c"),
        F.max(F.when(F.col("kind") != "call", F.col("body"))).alias("body"),
        F.max("content").alias("content"),
        F.max(F.when(F.col("kind") == "result", F.col("id"))).alias("result_of"),
        F.max(F.when(F.col("kind") == "result", F.col("linked_turn"))).alias("answers"),
        F.sort_array(F.collect_set(F.when(F.col("status") != "ok", F.col("status")))).alias("problems"),
    )
    said = F.when(F.col("content").isNull(), F.lit("")).otherwise(F.concat(F.lit('"content":'), "content", F.lit(",")))
    made = F.concat(F.lit("{"), said, F.lit('"role":'), _quoted("role"), F.lit(',"tool_calls":['), F.array_join(F.transform("c", lambda s: s["json"]), ","), F.lit("]}"))
    plain = F.concat(F.lit('{"content":'), F.coalesce("body", F.lit("null")), F.lit(',"role":'), _quoted("role"))
    result = F.concat(plain, F.lit(',"tool_call_id":'), _quoted("result_of"), F.lit("}"))
    json_of = F.when(F.size("c") > 0, made).when(F.col("result_of").isNotNull(), result).otherwise(F.concat(plain, F.lit("}")))
    return g.select("conv_id", "turn", "role", json_of.alias("json"), F.size("c").alias("calls"), "problems", "answers")


def _quoted(name: str) -> Column:
    """A string column as JSON; null is null."""
    plain = F.regexp_replace(F.to_json(F.struct(F.col(name).alias("v"))), r'^\{"v":|\}$', "")
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(plain)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
