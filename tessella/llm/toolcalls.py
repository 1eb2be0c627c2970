"""Tool calls of chats, linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import small_batches
from tessella.plans.lineage import cut

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def problems(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, bounds of numbers and lengths, required and further properties, items."""
    found = []
    kind = schema.get("type")
    if kind and not _TYPES[kind](value):
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            found.append(f"{at}: too long")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in own:
                found += problems(value[name], own[name], f"{at}.{name}")
            elif not schema.get("additionalProperties", True):
                found.append(f"{at}.{name}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{at}[{i}]")
    return found


_ALONE = re.compile("[\ud800-\udfff]")


def utf8(text: str) -> str:
    """``text`` with each surrogate that stands alone, which UTF-8 cannot hold, written as a JSON escape."""
    return _ALONE.sub(lambda found: f"\\u{ord(found[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and no escapes but those that JSON or UTF-8 needs."""
    return utf8(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_constants(name: str) -> None:
    raise ValueError(name)


def _finite(digits: str) -> float:
    number = float(digits)
    if not math.isfinite(number):
        raise ValueError(digits)
    return number


def checked(text: str | None, schema: Mapping | None) -> tuple[object, list[str]]:
    """The value of JSON ``text`` and what is wrong with it; no value for what is not JSON, or no finite number, or nested
    deeper than Python follows."""
    try:
        value = json.loads(text or "", parse_constant=_no_constants, parse_float=_finite)
        canonical(value)
        return value, ["unknown name"] if schema is None else problems(value, schema)
    except (ValueError, RecursionError):
        return None, ["$: not JSON"]


def _with(left: DataFrame, right: DataFrame, call: str, prefix: str, how: str = "inner") -> DataFrame:
    """``left`` with the row of ``right`` (conv_id, call_id and more, unique) for its column ``call``; the new columns prefixed."""
    right = right.select([F.col(c).alias(prefix + c) for c in right.columns])
    return left.join(right, F.col("conv_id").eqNullSafe(F.col(f"{prefix}conv_id")) & (F.col(call) == F.col(f"{prefix}call_id")), how)


def levels(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, parents) with ``level``: 0 for a call without a known parent, else its highest parent's plus 1.

    Ways up through calls with one parent are followed by pointer jumping to the next call with none or with several: each
    round doubles the distance that is known, so a chain of n calls takes log2(n) joins. What is left is a small graph of
    the calls with several parents, each of which waits until those above it have their levels, a round a layer. A call on
    or behind a cycle never gets its turn: its level is null.
    """
    keys = calls.select("conv_id", "call_id")
    edges = cut(_with(calls.select("conv_id", "call_id", F.explode("parents").alias("up")).distinct(), keys, "up", "k_", "left_semi"))
    above = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    one = F.coalesce(F.col("a_n") == 1, F.lit(False))
    way = cut(
        _with(keys, above, "call_id", "a_", "left").select(
            "conv_id", "call_id", F.coalesce(F.col("a_n") > 1, F.lit(False)).alias("joint"), F.when(one, F.col("a_up")).otherwise(F.col("call_id")).alias("end"), one.cast("long").alias("dist"), (~one).alias("done")
        )
    )
    reach, total = 1, way.count()
    while reach <= 2 * total and way.where("NOT done").limit(1).count():
        step = way.select("conv_id", "call_id", "end", "dist", "done")
        way = cut(_with(way, step, "end", "s_").select("conv_id", "call_id", "joint", F.col("s_end").alias("end"), (F.col("dist") + F.when(F.col("done"), 0).otherwise(F.col("s_dist"))).alias("dist"), F.col("s_done").alias("done")))
        reach *= 2
    # roots have level 0; a call with several parents has one above the highest of theirs
    ends = cut(way.where("NOT joint AND done AND call_id = end").select("conv_id", "call_id", F.lit(0).cast("long").alias("level")))
    open_ = way.where("joint").select("conv_id", "call_id")
    if open_.limit(1).count():
        up = _with(edges, open_, "call_id", "o_", "left_semi")
        up = cut(_with(up, way.select("conv_id", "call_id", "end", "dist", "done"), "up", "w_").select("conv_id", "call_id", F.when(F.col("w_done"), F.col("w_end")).alias("end"), (F.col("w_dist") + 1).alias("dist")))
        while True:
            settled = cut(
                _with(_with(up, ends, "call_id", "g_", "left_anti"), ends, "end", "e_", "left")
                .groupBy("conv_id", "call_id")
                .agg(F.max(F.col("dist") + F.col("e_level")).alias("level"), F.count_if(F.col("e_level").isNull()).alias("waits"))
                .where("waits = 0")
                .select("conv_id", "call_id", "level")
            )
            if not settled.limit(1).count():
                break
            ends = cut(ends.union(settled))
    level = _with(way.where("done").select("conv_id", "call_id", "end", "dist"), ends, "end", "e_").select("conv_id", "call_id", (F.col("dist") + F.col("e_level")).alias("level"))
    return _with(calls, level, "call_id", "l_", "left").drop("l_conv_id", "l_call_id").withColumnRenamed("l_level", "level")


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call, and per result without a call, of ``messages`` (conv_id, turn, role, text).

    An assistant's text that is JSON with ``tool_calls`` makes calls (id, name, arguments, and ``after``, the id of the
    call it builds on, or a list of ids); a tool's text that is JSON with ``tool_call_id`` is a result (``content``). Calls and results
    meet in a hash join on conversation and id, each id reduced before to its first row in the order of turns, so
    repeated rows and a hot id cost nothing; ``copies`` counts them. ``level`` is the place in topological order (see
    ``levels``): in the order of level, turn and id every call follows those it builds on. Arguments are validated
    against the schema of the call's name; ``errors`` lists what is wrong, ``valid`` tells if nothing is. ``json`` is
    canonical: equal calls have equal bytes.

    ``status`` is linked, unanswered (no result) or orphan (a result without a call: no level, name null, not valid).
    Null or other texts, and calls without id, are plain messages and give no row; null conversations match each other.
    An unknown name is an error of the call; so are arguments that are no JSON, hold a number that is not finite, or nest
    deeper than Python follows: they are written as null. Surrogates that stand alone stay JSON escapes. Further columns are not used. An empty table
    gives an empty result.
    """
    small_batches(messages.sparkSession)
    call = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:string>>>"
    after = F.col("c.after")
    parents = F.when(after.isNull(), F.array().cast("array<string>")).when(after.startswith("["), F.coalesce(F.from_json(after, "array<string>"), F.array(after))).otherwise(F.array(after))
    calls = (
        messages.where("role = 'assistant' AND text LIKE '%\"tool_calls\"%'")
        .select("conv_id", "turn", F.inline(F.from_json("text", call)["tool_calls"]))
        .where("id IS NOT NULL")
        .groupBy("conv_id", "id")
        .agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("copies"))
        .select("conv_id", F.col("id").alias("call_id"), F.col("c.turn").alias("call_turn"), "c.name", "c.arguments", parents.alias("parents"), "copies")
    )
    results = (
        messages.where("role = 'tool' AND text LIKE '%\"tool_call_id\"%'")
        .select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
        .where("r.tool_call_id IS NOT NULL")
        .groupBy("conv_id", F.col("r.tool_call_id").alias("id"))
        .agg(F.min(F.struct("turn", "r.content")).alias("r"), F.count("*").alias("n"))
        .select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.col("n").alias("r_copies"))
    )
    ordered = levels(cut(calls))
    both = ordered.join(results.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
    known = dict(schemas)

    @F.pandas_udf("errors string, json string")
    def written(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for ids, names, arguments, contents, statuses in batches:
            rows = []
            for i, name, given, content, status in zip(ids, names, arguments, contents, statuses, strict=True):
                value, found = checked(given, known.get(name)) if status != "orphan" else (None, ["no call"])
                rows.append((utf8("; ".join(found)), canonical({"arguments": value, "id": i, "name": name, "result": content})))
            yield pd.DataFrame(rows, columns=["errors", "json"])

    out = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_id").alias("call_id"),
        "name",
        "level",
        "call_turn",
        "result_turn",
        F.when(F.col("call_id").isNull(), "orphan").when(F.col("r_id").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.coalesce("copies", "r_copies").alias("copies"),
        "arguments",
        "content",
    ).withColumn("w", written("call_id", "name", "arguments", "content", "status"))
    return out.select("conv_id", "call_id", "name", "level", "call_turn", "result_turn", "status", "copies", (F.col("w.errors") == "").alias("valid"), "w.errors", "w.json")
