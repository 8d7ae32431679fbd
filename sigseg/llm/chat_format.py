"""Linking of tool calls and results, in dependency order, as canonical JSON.

DataFrame functions only. Calls and results are hash-joined by identifier.
Each step (a call, or the result of one) may depend on one earlier step; the
depth of a step is found by pointer doubling, so a conversation of n steps
takes log2(n) rounds of joins over ids and no conversation is ever gathered.
Steps that depend on themselves through a cycle have no depth. Arguments are
parsed as variants and checked against a table of parameters. Every exchange
is one line of JSON with sorted keys and no spaces.

Calls with no result and results with no call are kept and named so in
``status``; if an identifier repeats within a conversation, the first by turn
is linked and later ones are ``duplicate``. A null conversation or identifier
links with nothing. Null text is JSON null. Empty tables give empty tables.
Rows of both tables that repeat wholly are calls and results each: the first
of each pair up, the second of each pair up as duplicates, and so on; what one
side has more of has no result or no call. Texts of any length are results.
Arguments are parsed as a variant, whose size Spark limits; longer ones (a prompt
of tens of MiB) cannot be checked: such a call stays linked, with null
arguments and the error that they are not JSON. Columns other than those named
are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigseg.llm.shared import Scratch

#: Parameters of the function that a plain chat turn calls.
CHAT_SCHEMA = [("respond", "prompt", "STRING", True), ("respond", "turn", "BIGINT", True), ("respond", "system", "STRING", False)]


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations.

    Each user turn calls ``respond`` under the identifier ``call_N``, N its
    turn, after the turn before it; the next turn, if the assistant's, is the
    result that names this identifier. Other assistant turns name the turn
    before them and so find no call. System turns call nothing; they
    are the ``system`` argument of the turn after them.
    """
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), "role", F.col("text").cast("string").alias("text"))
    system = rows.filter("role = 'system'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text").groupBy("conv_id", "turn").agg(F.min("text").alias("system"))
    users = rows.filter("role = 'user'").join(system, ["conv_id", "turn"], "left")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("system"), F.col("turn")))
    calls = users.select(
        "conv_id",
        F.concat(F.lit("call_"), F.col("turn")).alias("call_id"),
        "turn",
        F.lit("respond").alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") > 0, F.concat(F.lit("call_"), F.col("turn") - 2)).alias("after"),
    )
    results = rows.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def _first(rows: DataFrame, other: str) -> DataFrame:
    """Rows with ``n``, the place among the rows of the same conversation and identifier; rows that lack either spread by a hash."""
    spread = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.xxhash64("conv_id", "turn", other)).otherwise(0)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "call_id", spread).orderBy("turn", other)))


def _depths(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, depth: steps before each call along ``after``; null in a cycle."""
    up = F.when(F.col("known"), F.col("after"))
    names = steps.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    start = steps.join(names, ["conv_id", "after"], "left").select("conv_id", "call_id", up.alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"))
    at = scratch.write(start, "depth-0")
    rounds = 0
    limit = max(1, steps.count()).bit_length() + 1
    while rounds < limit and at.filter("up is not null").limit(1).count():
        above = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = at.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        rounds += 1
        at = scratch.write(step, f"depth-{rounds}")
        scratch.drop(f"depth-{rounds - 1}")
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def check_arguments(schema: list[tuple[str, str, str, bool]]) -> Column:
    """Sorted messages on what is wrong with ``arguments`` of the function ``name``; empty if nothing is.

    ``schema`` holds (function, parameter, type, required); a type is one that
    ``schema_of_variant`` names. Unknown functions and parameters are errors.
    """
    parsed = F.try_parse_json("arguments")
    parts = [F.when(parsed.isNull(), F.lit("arguments are not JSON")), F.when(~F.col("name").isin([s[0] for s in schema]) | F.col("name").isNull(), F.lit("unknown function"))]
    for function, parameter, kind, required in schema:
        value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
        there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
        mine = (F.col("name") == function) & parsed.isNotNull()
        parts.append(F.when(mine & there & (F.schema_of_variant(value) != kind), F.lit(f"{parameter} is not {kind}")))
        if required:
            parts.append(F.when(mine & ~there, F.lit(f"{parameter} is missing")))
    known = F.array(*[F.lit(f"{f}.{p}") for f, p, _, _ in schema])
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    extra = F.when(F.col("name").isin([s[0] for s in schema]), F.transform(F.filter(keys, lambda k: ~F.array_contains(known, F.concat("name", F.lit("."), k))), lambda k: F.concat(k, F.lit(" is unknown"))))
    return F.array_sort(F.concat(F.array_compact(F.array(*parts)), F.coalesce(extra, F.array().cast("array<string>"))))


def link_tool_calls(calls: DataFrame, results: DataFrame, schema: list[tuple[str, str, str, bool]]) -> DataFrame:
    """conv_id, call_id, turn, depth, status, valid, errors and json for each call and each result without a call.

    calls: conv_id, call_id, turn, name, arguments (JSON), after (call_id or
    null). results: conv_id, call_id, turn, content. In a conversation,
    (depth, turn) is a topological order. status: linked, no_result, no_call
    or duplicate.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    calls = _first(calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", "after"), "arguments")
    results = _first(results.select("conv_id", "call_id", F.col("turn").cast("long").alias("result_turn"), "content").withColumnRenamed("result_turn", "turn"), "content")
    results = results.withColumnRenamed("turn", "result_turn")
    both = calls.join(results, ["conv_id", "call_id", "n"], "full").withColumn("is_call", F.col("turn").isNotNull())
    depths = _depths(calls.filter("n = 1").select("conv_id", "call_id", "after"), scratch)
    linked = both.join(depths, ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("n") > 1, "duplicate")
        .when(~F.col("is_call"), "no_call")
        .when(F.col("result_turn").isNull(), "no_result")
        .otherwise("linked")
    )
    errors = F.when(F.col("is_call"), check_arguments(schema)).otherwise(F.array().cast("array<string>"))
    out = linked.withColumn("status", status).withColumn("errors", errors).withColumn("valid", F.col("is_call") & (F.size("errors") == 0))
    # keys in alphabetical order; a variant sorts those of the arguments
    fields = F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "content", "depth", "errors", "name", "status", "valid")
    return out.select(
        "conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "depth", "status", "valid", "errors", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json")
    )
