"""Captured operations: reading, validating, exploding, de-duplicating and nesting them back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import query_shape, shape_id
from ..schemas import OPERATION_EVENT

#: Fixed value: the only schema version understood.
SCHEMA_VERSION = 1


def _same_keys(found: Column, names: Sequence[str]) -> Column:
    return F.sort_array(F.map_keys(found)) == F.array(*[F.lit(n) for n in sorted(names)])


def _typed(found: Column, read: Column, names: Sequence[str]) -> Column:
    """Whether every value that the text holds could be read as its type."""
    return reduce(lambda a, b: a & b, [found[n].isNull() == read[n].isNull() for n in names])


def _rules(names: Sequence[str], statement_names: Sequence[str]) -> dict[str, Column]:
    """What an event must satisfy, in the order in which a broken rule is reported."""
    e = F.col("_event")
    statement_ok = lambda s, found: (
        _same_keys(found, statement_names) & _typed(found, s, statement_names) & s["sql"].isNotNull()
        & (s["paramCount"] >= 0) & s["kind"].isin("query", "execute") & (s["durationMs"] >= 0)
    )
    return {
        "not a JSON object": F.col("_found").isNotNull(),
        "keys": _same_keys(F.col("_found"), names),
        "types": _typed(F.col("_found"), e, names),
        "schemaVersion": e["schemaVersion"] == SCHEMA_VERSION,
        "app": F.length(e["app"]) > 0,
        "operationId": F.length(e["operationId"]) > 0,
        "operation": F.length(e["operation"]) > 0,
        "startedAt": e["startedAt"].isNotNull(),
        "durationMs": e["durationMs"] >= 0,
        "error": e["error"].isNotNull(),
        "statements": F.forall(
            F.zip_with(e["statements"], "_statements", lambda s, found: F.coalesce(statement_ok(s, found), F.lit(False))),
            lambda ok: ok,
        ),
    }


def parse_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) from lines of JSON text (column ``value``): every line is in exactly one.

    An event holds exactly the known keys, each of its type; a NULL where a value is required counts as
    broken. Quarantined rows are (value, reason): the line as it came and the first rule that it breaks.
    """
    parsed = F.struct(
        F.from_json("value", OPERATION_EVENT).alias("_event"), F.from_json("value", "map<string,string>").alias("_found"),
        F.from_json(F.get_json_object("value", "$.statements"), "array<map<string,string>>").alias("_statements"),
    )
    # One generated row per line: a filter on the reason would parse the text again for every rule.
    read = lines.select("value", F.explode(F.array(parsed)).alias("_p")).select("value", "_p.*")
    kind = read.schema["_event"].dataType
    rules = _rules(kind.names, kind["statements"].dataType.elementType.names)
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    judged = read.withColumn("reason", broken)
    return judged.where(F.col("reason").isNull()).select("_event.*"), judged.where(F.col("reason").isNotNull()).select("value", "reason")


def read_events(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Operation events from files of JSON lines, split into valid and quarantined ones."""
    reader = spark.readStream if stream else spark.read
    return parse_events(reader.text(path))


def operations(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("operationId").alias("operation_id"), "app", F.col("requestId").alias("request_id"), "route", "model",
        "operation", F.col("startedAt").alias("started_at"), F.col("durationMs").alias("duration_ms"),
        F.col("rowsReturned").alias("rows_returned"), "error",
    )


def explode_statements(events: DataFrame) -> DataFrame:
    """One row per statement with its 0-based position, shape and fingerprint."""
    rows = events.select(
        F.col("operationId").alias("operation_id"), "app", F.col("requestId").alias("request_id"), "route", "model",
        "operation", F.col("startedAt").alias("started_at"), F.posexplode("statements").alias("position", "s"),
    )
    rows = rows.withColumn("normalized_sql", query_shape("s.sql"))
    return rows.select(
        "operation_id", "app", "request_id", "route", "model", "operation", "started_at", "position", "s.sql",
        shape_id("normalized_sql").alias("fingerprint"), "normalized_sql",
        F.col("s.paramCount").alias("param_count"), "s.kind", F.col("s.durationMs").alias("duration_ms"), "s.rows",
    )


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``: later inserts of a stored key change nothing."""
    return _pick(df, keys, F.min_by, order)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: the last write wins."""
    return _pick(df, keys, F.max_by, order)


def versioned_hits(stored: DataFrame, wanted: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The stored rows that answer a request: the same key in the same version; an older version is no hit."""
    return stored.join(wanted.select(*keys, version).distinct(), [*keys, version], "left_semi")


def _pick(df: DataFrame, keys: Sequence[str], choose, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def dedupe_events(df: DataFrame, keys: Sequence[str] = ("operation_id",)) -> DataFrame:
    """One row per key where repeats are identical (retried sends)."""
    return df.dropDuplicates(list(keys))


def operations_nested(
    ops: DataFrame, statements: DataFrame, app: str | None = None, request_id: str | None = None,
    route: str | None = None, limit: int = 100,
) -> DataFrame:
    """The newest operations with their statements in order ([] if none).

    The limit is applied before the join, so only the listed operations' statements are collected.
    """
    for name, value in (("app", app), ("request_id", request_id), ("route", route)):
        if value is not None:
            ops = ops.where(F.col(name) == value)
    page = ops.orderBy(F.desc("started_at"), "operation_id").limit(limit)
    item = F.struct("position", "sql", "fingerprint", "normalized_sql", "param_count", "kind", "duration_ms", "rows")
    listed = statements.join(page.select("operation_id"), "operation_id", "left_semi")
    listed = listed.groupBy("operation_id").agg(F.array_sort(F.collect_list(item)).alias("statements"))
    joined = page.join(listed, "operation_id", "left")
    kind = joined.schema["statements"].dataType
    return joined.withColumn("statements", F.coalesce("statements", F.array().cast(kind))).orderBy(
        F.desc("started_at"), "operation_id"
    )


def in_session(ops: DataFrame, runs: DataFrame, session: str) -> DataFrame:
    """Operations started inside any non-warm-up run of the session, both ends included.

    Each run covers whole minutes; joining on the minute avoids comparing every operation with
    every run.
    """
    minute = lambda c: F.date_trunc("minute", c)
    spans = runs.where((F.col("session_id") == session) & ~F.col("warmup")).select(
        "window_start", "window_end",
        F.explode(F.sequence(minute("window_start"), minute("window_end"), F.expr("INTERVAL 1 MINUTE"))).alias("_minute"),
    )
    inside = (
        (minute("started_at") == F.col("_minute"))
        & (F.col("started_at") >= F.col("window_start")) & (F.col("started_at") <= F.col("window_end"))
    )
    return ops.join(spans, inside, "left_semi")
