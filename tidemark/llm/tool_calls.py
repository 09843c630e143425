"""Chat formatting: link tool calls with their results, order them, validate and serialise them.

A message of role ``assistant`` whose text is a JSON object with a list ``tool_calls`` makes
calls ({"id", "name", "arguments", optional "depends_on"}); a message of role ``tool`` whose
text is a JSON object with ``tool_call_id`` is a result. Everything else is plain text. A call
depends on the ids in ``depends_on`` and on those that its arguments name as "$id". ``as_tools`` makes
such messages of plain turns.

Calls and results are hash-joined on (conversation, id). Calls are ordered topologically: depth 0
has no dependencies, and each round of joins settles the calls whose dependencies are settled.
Sorting by (depth, turn, call_no) is a valid order. Arguments are checked against a schema of
their tool, and each row is serialised as canonical JSON (sorted keys, no blanks, UTF-8).

One row comes back for each call and for each other message, so no conversation is ever
collected into one task, however long it is.

Edge cases (``problem``): ``orphan_result`` (no such call), ``no_result``, ``duplicate_id`` (a
later call of an id used before, an equal row included; it is not linked), ``result_before_call``, ``bad_arguments``,
``unknown_tool``, ``missing_dependency``, ``cycle``; the first that applies, in the order
duplicate_id, unknown_tool, bad_arguments, missing_dependency, cycle, no_result for calls. Null
text serialises as null content; null conversation ids link with nothing. Texts that are not
valid JSON, nest too deeply or hold what JSON in UTF-8 can't (NaN, lone surrogates) are plain
text, and such arguments in a string stay that string. Repeated results are all linked; equal rows
stay apart. An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import bind_batches, discard, written

#: JSON schemas (type, properties, required, enum, items) of the tools that the queries know.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "method": {"type": "string", "enum": ["GET", "POST"]}}, "required": ["url"]},
}

_KINDS: dict[str, tuple[type, ...]] = {"object": (dict,), "array": (list,), "string": (str,), "boolean": (bool,), "number": (int, float), "integer": (int,), "null": (type(None),)}


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, UTF-8; a ValueError for what that cannot hold."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    text.encode("utf-8")
    return text


def conforms(value: Any, schema: dict) -> bool:
    """Whether a JSON value fits a schema; keys that the schema does not name are allowed."""
    kind = schema.get("type")
    if kind is not None:
        if not isinstance(value, _KINDS[kind]) or (isinstance(value, bool) and kind in ("number", "integer")):
            return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        if any(k not in value for k in schema.get("required", ())):
            return False
        return all(conforms(value[k], s) for k, s in schema.get("properties", {}).items() if k in value)
    if isinstance(value, list) and "items" in schema:
        return all(conforms(v, schema["items"]) for v in value)
    return True


def references(value: Any) -> set[str]:
    """Ids that arguments name as "$id"."""
    if isinstance(value, str):
        return {value[1:]} if len(value) > 1 and value[0] == "$" else set()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(references, inner))


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The rows of one message: kind, call_no, call_id, name, valid, known, deps, json."""
    if role in ("assistant", "tool") and text and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text)
            canonical(body)
            if rows := _tool_rows(role, body, schemas):
                return rows
        except (ValueError, RecursionError):
            pass  # plain text
    return [_row("text", {"content": text, "role": role})]


def _row(kind: str, body: dict, call_no: int = 0, call_id: str | None = None, name: str | None = None, valid: bool | None = None, known: bool | None = None, deps: tuple | list = ()) -> dict:
    return {"kind": kind, "call_no": call_no, "call_id": call_id, "name": name, "valid": valid, "known": known, "deps": list(deps), "json": canonical(body)}


def _tool_rows(role: str, body: Any, schemas: dict[str, dict]) -> list[dict]:
    """Rows of the calls or the result in a message; none if it has neither."""
    if not isinstance(body, dict):
        return []
    if role == "tool":
        if body.get("tool_call_id") is None:
            return []
        cid = str(body["tool_call_id"])
        return [_row("result", {"content": body.get("content"), "role": role, "tool_call_id": cid}, call_id=cid)]
    calls = body.get("tool_calls")
    rows = []
    for no, call in enumerate(calls if isinstance(calls, list) else ()):
        call = call if isinstance(call, dict) else {}
        name = call["name"] if isinstance(call.get("name"), str) else None
        args = _arguments(call.get("arguments"))
        cid = None if call.get("id") is None else str(call["id"])
        named = call.get("depends_on")
        deps = sorted(({str(d) for d in named} if isinstance(named, list) else set()) | references(args))
        made = {"arguments": args, "depends_on": deps, "id": cid, "name": name, "role": role}
        rows.append(_row("call", made, no, cid, name, name in schemas and conforms(args, schemas[name]), name in schemas, deps))
    return rows


def _arguments(value: Any) -> Any:
    """Arguments, which are often JSON in a string."""
    if isinstance(value, str):
        try:
            inner = json.loads(value)
            canonical(inner)
            references(inner)
            return inner
        except (ValueError, RecursionError):
            pass
    return value


def as_tools(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: plain turns as calls and results, as if each user asked a search tool.

    A user's turn t becomes an assistant's call "t<t>" of ``search`` with its text as query; every second
    one depends on the user's turn before it. An assistant's turn becomes the tool's result for
    the turn before it. Other turns stay as they are.
    """
    turn = F.col("turn")
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    before = F.when(F.pmod(turn, F.lit(4)) == 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(name(turn).alias("id"), F.lit("search").alias("name"), F.struct(F.col("text").alias("query")).alias("arguments"), before.alias("depends_on"))
    result = F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    text = F.when(user, F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(assistant, F.to_json(result)).otherwise(F.col("text"))
    role = F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def linked(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """conv_id, turn, role, kind, call_no, call_id, name, linked_turn, depth, args_valid, problem, json."""
    bind_batches(messages.sparkSession, 2000)
    kinds = [(c, messages.schema[c].dataType.simpleString()) for c in ("conv_id", "turn", "role")]
    made = pa.schema([("kind", pa.string()), ("call_no", pa.int32()), ("call_id", pa.string()), ("name", pa.string()), ("valid", pa.bool_()), ("known", pa.bool_()), ("deps", pa.list_(pa.string())), ("json", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, origin = [], []
            for k, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                for row in parse(role, text, schemas):
                    rows.append(row)
                    origin.append(k)
            take = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c, _ in kinds], *[pa.array([r[f.name] for r in rows], f.type) for f in made]], [*[c for c, _ in kinds], *made.names])

    ddl = ", ".join(f"{c} {t}" for c, t in kinds) + ", kind string, call_no int, call_id string, name string, valid boolean, known boolean, deps array<string>, json string"
    rows = messages.select("conv_id", "turn", "role", "text").mapInArrow(run, ddl)
    empty = {"linked_turn": F.lit(None).cast(kinds[1][1]), "depth": F.lit(None).cast("int"), "problem": F.lit(None).cast("string")}
    out = ["conv_id", "turn", "role", "kind", "call_no", "call_id", "name", "linked_turn", "depth", F.col("valid").alias("args_valid"), "problem", "json"]
    plain = rows.where("kind = 'text'").withColumns(empty).select(*out)
    tools = written(rows.where("kind <> 'text'").withColumn("row_no", F.monotonically_increasing_id()))  # numbered once: the table is read from here on
    if tools.isEmpty():
        return plain
    calls, results = tools.where("kind = 'call'"), tools.where("kind = 'result'")
    # The first call of an id owns it; of equal rows one.
    owners = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "call_no", "row_no")).alias("own"))
    owners = owners.select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_id"), F.col("own.turn").alias("o_turn"), F.col("own.row_no").alias("o_row"))
    answers = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("r_turn")).select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), "r_turn")
    same = (F.col("conv_id") == F.col("o_conv")) & (F.col("call_id") == F.col("o_id"))
    calls = calls.join(owners, same, "left").withColumn("owner", F.coalesce(F.col("row_no") == F.col("o_row"), F.lit(False)))
    calls = calls.join(answers, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")) & F.col("owner"), "left")
    depths = _depths(calls.where("owner"))
    calls = calls.join(depths, (F.col("conv_id") == F.col("d_conv")) & (F.col("call_id") == F.col("d_id")) & F.col("owner"), "left")
    calls = calls.withColumn(
        "problem",
        F.when(~F.col("owner") & F.col("o_id").isNotNull(), "duplicate_id")
        .when(~F.col("known"), "unknown_tool")
        .when(~F.col("valid"), "bad_arguments")
        .when(F.col("missing"), "missing_dependency")
        .when(F.col("owner") & F.col("depth").isNull(), "cycle")
        .when(F.col("r_turn").isNull(), "no_result"),
    ).withColumn("linked_turn", F.col("r_turn"))
    results = results.join(owners, same, "left").withColumn("linked_turn", F.col("o_turn")).withColumn("depth", F.lit(None).cast("int"))
    results = results.withColumn("problem", F.when(F.col("o_id").isNull(), "orphan_result").when(F.col("turn") < F.col("o_turn"), "result_before_call"))
    return plain.unionByName(calls.select(*out)).unionByName(results.select(*out))


def _depths(calls: DataFrame) -> DataFrame:
    """d_conv, d_id, depth (null in or behind a cycle), missing, by rounds that settle what has no open dependency.

    A round reads what the round before settled and the dependencies that were open then, and
    writes what is left; there are as many rounds as the longest chain has calls.
    """
    key = ["d_conv", "d_id"]
    nodes = written(calls.select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_id"), F.array_distinct("deps").alias("deps")))
    needs = nodes.select(*key, F.explode("deps").alias("on"))
    real = needs.join(nodes.select(F.col("d_conv").alias("n_conv"), F.col("d_id").alias("n_id")), (F.col("d_conv") == F.col("n_conv")) & (F.col("on") == F.col("n_id")), "left")
    missing = real.where("n_id is null").select(*key).distinct().withColumn("missing", F.lit(True))
    open_ = written(real.where("n_id is not null").select(*key, "on"))
    ready = written(nodes.select(*key).join(open_.select(*key).distinct(), key, "left_anti"))
    layers = [ready.withColumn("depth", F.lit(0))]
    while not open_.isEmpty() and not ready.isEmpty():
        settled = ready.select("d_conv", F.col("d_id").alias("on"))
        left = written(open_.join(settled, ["d_conv", "on"], "left_anti").select(*key, "on"))
        ready = written(open_.select(*key).distinct().join(left.select(*key).distinct(), key, "left_anti"))
        discard(open_)
        open_ = left
        layers.append(ready.withColumn("depth", F.lit(len(layers))))
    done = functools.reduce(DataFrame.unionByName, layers)
    return nodes.select(*key).join(done, key, "left").join(missing, key, "left").withColumn("missing", F.coalesce("missing", F.lit(False)))
