"""Tool-call linking: calls joined with results by identifier, put in topological order, validated, serialised.

Everything is DataFrame operations. Results are hash-joined to calls by (conversation, call id). A call may name the
call whose result it uses; the depth of every call below its root is found by pointer doubling, so a chain of any length
needs a logarithmic number of joins, and calls that never reach a root are on or behind a cycle. The order inside a
conversation is (depth, turn, call id). Arguments are parsed and compared field by field with the tool's schema, and a
message is written as JSON without spaces, with keys in ascending order at every level.

Defined results: a call without result is not linked; of several results the first by turn is used and the others are
counted. Of several calls with one id the first by turn (then by text) is the call; the others are counted as repeats.
A parent that does not exist makes the call a root with a problem; calls on or behind a cycle have no depth and come
last. Arguments that are NULL, no JSON or no object give one problem and no message; unknown tools one problem. Rows
without conversation or call id are left out. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..session import cut

KEY = ["conv_id", "call_id"]
#: Names of argument types and the types that parsed JSON values may have for them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call once, with ``repeats``, and its first result (``result_turn``, ``content``, ``extra_results``)."""
    known = calls.where("conv_id is not null and call_id is not null")
    first = known.groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("c"), (F.count(F.lit(1)) - 1).alias("repeats")
    )
    first = first.select(*KEY, "c.*", "repeats")
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(
        F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"), (F.count(F.lit(1)) - 1).alias("extra_results")
    )
    answers = answers.select(*KEY, "r.*", "extra_results", F.lit(True).alias("linked"))
    return first.join(answers.hint("shuffle_hash"), KEY, "left").withColumns(
        {"linked": F.coalesce("linked", F.lit(False)), "extra_results": F.coalesce("extra_results", F.lit(0)).cast("long")}
    )


def with_depth(linked: DataFrame) -> DataFrame:
    """Adds ``unknown_parent`` and ``depth`` (NULL on or behind a cycle); writes the calls once for each doubling."""
    ids = linked.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.lit(True).alias("_there"))
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("parent_id") == F.col("_call"))
    tree = linked.select(*KEY, "parent_id").join(ids, same, "left")
    tree = cut(
        tree.select(
            *KEY, F.when(F.col("_there"), F.col("parent_id")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("steps"),
            (F.col("parent_id").isNotNull() & F.col("_there").isNull()).alias("unknown_parent"),
        )
    )
    longest = tree.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    reach = 1
    while reach < longest + 1 and not tree.where("up is not null").isEmpty():
        above = tree.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        jumped = tree.join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("up") == F.col("_call")), "left")
        tree = cut(jumped.select(*KEY, F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), "unknown_parent"))
        reach *= 2
    # Whoever still has an ancestor after more steps than there are calls goes round in a cycle.
    depth = tree.select(*KEY, "unknown_parent", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))
    return linked.join(depth, KEY)


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``parsed`` and ``problems``, the sorted differences from the tool's schema (name, field, type, required)."""
    parsed = F.expr("try_parse_json(arguments)")
    object_ = F.expr("schema_of_variant(parsed) like 'OBJECT%'")
    rows = calls.withColumn("parsed", parsed).withColumn("parsed", F.when(object_, F.col("parsed")))
    rows = rows.withColumn("_fields", F.expr("cast(parsed as map<string, variant>)"))
    tools = schemas.where("name is not null and field is not null").groupBy("name").agg(
        F.sort_array(F.collect_set(F.struct("field", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("_schema")
    )  # a tool's few fields
    joined = rows.join(tools, "name", "left")
    value = lambda s: F.get(F.filter(F.map_entries("_fields"), lambda e: e["key"] == s["field"]), F.lit(0))["value"]
    kind = lambda s: F.call_function("schema_of_variant", value(s))
    pattern = lambda s: F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[s["type"]]
    there = lambda s: F.array_contains(F.map_keys("_fields"), s["field"])
    missing = F.transform(F.filter("_schema", lambda s: s["required"] & ~there(s)), lambda s: F.concat(F.lit("missing "), s["field"]))
    wrong = F.transform(
        F.filter("_schema", lambda s: there(s) & ~F.regexp(kind(s), F.concat(F.lit("^("), pattern(s), F.lit(")$")))),
        lambda s: F.concat(F.lit("type of "), s["field"]),
    )
    more = F.transform(
        F.array_except(F.map_keys("_fields"), F.transform("_schema", lambda s: s["field"])), lambda f: F.concat(F.lit("unknown "), f)
    )
    problems = (
        F.when(F.col("parsed").isNull(), F.array(F.lit("arguments are no object")))
        .when(F.col("_schema").isNull(), F.array(F.lit("unknown tool")))
        .otherwise(F.sort_array(F.concat(missing, wrong, more)))
    )
    return joined.withColumn("problems", problems).drop("_fields", "_schema")


def messages(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its place, link, validity and canonical JSON message.

    calls: (conv_id, call_id, turn, name, arguments, parent_id); results: (conv_id, call_id, turn, content); schemas:
    (name, field, type, required).
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "parent_id")
    results = results.select("conv_id", "call_id", "turn", "content")
    checked = validate(with_depth(cut(link(calls, results))), schemas)
    problems = F.concat(
        "problems", F.when(F.col("unknown_parent"), F.array(F.lit("unknown parent"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("depth").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
    )
    message = F.when(
        F.col("parsed").isNotNull(),
        F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))),
    )
    rows = checked.select(
        *KEY, "turn", "name", "depth", "linked", "result_turn", "extra_results", "repeats",
        (F.size(problems) == 0).alias("valid"), F.array_join(problems, ", ").alias("problems"), message.alias("message"),
    )
    placed = positions(rows, ["conv_id"], [F.col("depth").asc_nulls_last(), F.col("turn").asc(), F.col("call_id").asc()], "place")
    return placed.withColumn("place", F.col("place") - 1)
