"""Streaming queries: the driver's events as a file stream, compared with the batch result.

A window is reported once the watermark has passed its end, so the newest, still open ones are not.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pick
from ..session import fresh_path
from ..sources.tables import Tables
from ..streaming import jobs
from . import runtime
from .quality import SCHEMA, _sql_profile, sql_backtest, sql_pick
from .registry import query

_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _files(df: DataFrame, name: str, order: str | None = None) -> str:
    """``df`` as a folder of files, in ranges of ``order`` if given."""
    path = fresh_path(df.sparkSession, name)
    (df.repartitionByRange(4, order) if order else df).write.parquet(path)
    return path


#: Rows of the stream's first part that are sent with its last part.
_LATE = f"{sql_pick('event_id', ':late')} < 26 AND epoch(ts) < epoch(lo) + 0.3 * (epoch(hi) - epoch(lo))"
_SQL_LATE = f"(SELECT *, {_LATE} AS late FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events))"


def _in_order(parts: list[DataFrame], name: str) -> str:
    """A folder of one file per part, written one after the other, so that a stream reads them in this order."""
    path = fresh_path(parts[0].sparkSession, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _arrivals(t: Tables) -> tuple[str, DataFrame]:
    """Events in three files by time; some of the first tenths come with the last file, behind the watermark."""
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    at = lambda share: F.lit(first + (last - first) * share)
    events = t.events.drop("props")
    late = (pick("event_id", ":late") < 26) & (F.col("ts") < at(0.3))
    parts = [
        events.where(~late & (F.col("ts") < at(0.4))), events.where((F.col("ts") >= at(0.4)) & (F.col("ts") < at(0.7))),
        events.where(late | (F.col("ts") >= at(0.7))),
    ]
    return _in_order(parts, "arrivals"), events


def _statement_stream(t: Tables) -> DataFrame:
    return jobs.stream_statements(jobs.stream_table(t.spark, _files(runtime.nested_events(t), "operations")))


@query("stream_dedupe", "SELECT route, count(*) AS operations FROM (SELECT '/r/' || (user_id % 10) AS route FROM events) GROUP BY route")
def stream_dedupe(t: Tables) -> DataFrame:
    """Retried sends counted once, over several micro-batches: a retry may come with the next file."""
    sent = t.events.select(F.concat(F.lit("op"), "event_id").alias("operation_id"), F.concat(F.lit("/r/"), F.col("user_id") % 10).alias("route"), F.col("ts").alias("started_at"))
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    arrives = F.floor((F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / ((last - first).total_seconds() * 1e6 + 1) * 4)
    again = sent.where(pick("operation_id", ":retry") < 50).withColumn("_part", F.least(arrives + 1, F.lit(3)))
    every = sent.withColumn("_part", arrives).unionByName(again)
    path = _in_order([every.where(F.col("_part") == i).drop("_part") for i in range(4)], "sent")
    stream = jobs.stream_table(t.spark, path, files_per_trigger=1)
    kept = jobs.run_available(jobs.stream_dedupe(stream, "20 days"), "deduped")
    return kept.groupBy("route").agg(F.count(F.lit(1)).alias("operations"))


@query(
    "stream_late",
    f"""WITH e AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS window_start FROM {_SQL_LATE} WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED}),
        d AS (SELECT window_start, count(*) FILTER (WHERE late) AS late FROM e GROUP BY ALL) SELECT p.*, d.late FROM (
    """ + " UNION ALL ".join(
        _sql_profile("events", c, "e GROUP BY window_start", "window_start,") for c in ("event_id", "user_id", "event_type", "value")
    ) + ") p JOIN d USING (window_start)",
)
def stream_late(t: Tables) -> DataFrame:
    """Daily profiles of a stream with late rows: the windows they belong to are computed again from the stored rows."""
    path, events = _arrivals(t)
    columns, kept = ["event_id", "user_id", "event_type", "value"], fresh_path(t.spark, "stored")
    stream = lambda: jobs.stream_table(t.spark, path, files_per_trigger=1)
    jobs.run_batches(stream(), jobs.store_batch(kept), "stored")
    histogram, reports = jobs.run_reported(jobs.stream_histogram(stream(), "events", columns, "ts", "1 day", "1 hour"), "late")
    stored = t.spark.read.parquet(kept).drop("batch")
    whole, dirty = jobs.with_late_rows(stored, histogram, "events", columns, "ts", "1 day", jobs.watermark_reached(reports))
    late = dirty.select("window_start", (F.col("stored") - F.col("counted")).alias("late"))
    rows = jobs.stream_profile(whole).drop("data_type").join(late, "window_start", "left")
    return rows.withColumn("late", F.coalesce("late", F.lit(0)))


@query(
    "stream_fingerprints",
    f"""WITH {runtime._SQL_STATEMENTS} SELECT date_trunc('day', started_at)::TIMESTAMP AS window_start, fp AS fingerprint, count(*) AS executions FROM st
        WHERE date_trunc('day', started_at) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""",
)
def stream_fingerprints(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.stream_fingerprint_counts(_statement_stream(t), "1 hour", "1 day"), "shapes")


@query(
    "stream_profile",
    " UNION ALL ".join(
        _sql_profile("events", c, f"events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY date_trunc('day', ts)",
                     "date_trunc('day', ts)::TIMESTAMP AS window_start,")
        for c in SCHEMA["events"]
    ),
)
def stream_profile(t: Tables) -> DataFrame:
    stream = jobs.stream_table(t.spark, _files(t.events, "events"))
    histogram = jobs.stream_histogram(stream, "events", SCHEMA["events"], "ts", "1 day", "1 hour")
    return jobs.stream_profile(jobs.run_available(histogram, "histogram")).drop("data_type")


@query(
    "stream_repetition",
    f"""WITH {runtime._SQL_STATEMENTS} SELECT route, request_id, fp AS fingerprint, count(*) AS executions FROM st WHERE request_id IS NOT NULL
        GROUP BY ALL HAVING count(*) > 2 AND max(started_at) + INTERVAL 1 DAY <= {_CLOSED}""",
)
def stream_repetition(t: Tables) -> DataFrame:
    """Repetition per request, reported when the request has been quiet for a day."""
    return jobs.run_available(jobs.stream_repetition(_statement_stream(t), "1 day", "1 hour"), "repetition").drop("app")


@query(
    "stream_rates",
    f"""WITH {runtime._SQL_STATEMENTS}, w AS (SELECT date_trunc('day', started_at)::TIMESTAMP - to_days(CAST(k AS INTEGER)) AS window_start, route, value FROM st, range(2) r(k))
        SELECT window_start, route, count(*) AS statements, max(value) AS max_ms, quantile_disc(value, 0.95) AS p95_ms FROM w WHERE window_start + INTERVAL 2 DAY <= {_CLOSED} GROUP BY ALL""",
)
def stream_rates(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.stream_rates(_statement_stream(t), "2 days", "1 day", "1 hour"), "rates")


@query("stream_upsert", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_upsert(t: Tables) -> DataFrame:
    """The last value per key over several micro-batches, compacted after every second."""
    stream = jobs.stream_table(t.spark, _files(t.events.drop("props"), "events", "ts"), files_per_trigger=1)
    path = fresh_path(t.spark, "latest")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    jobs.run_batches(stream, jobs.upsert_batch(path, keys, order, compact_every=2), "upsert")
    return jobs.latest(t.spark, path, keys, order).select(*keys, "value")


@query("stream_accounting", f"SELECT count(*) AS captured, count(*) FILTER (WHERE late) AS dropped FROM {_SQL_LATE}")
def stream_accounting(t: Tables) -> DataFrame:
    """Rows seen by the micro-batches, and the late ones that the deduplicating operator dropped."""
    path, _ = _arrivals(t)
    stream = jobs.stream_dedupe(jobs.stream_table(t.spark, path, files_per_trigger=1), "1 hour", "event_id", "ts")
    counts = jobs.accounting(jobs.run_reported(stream, "accounting")[1])
    return t.spark.createDataFrame([(counts["captured"], counts["dropped"])], "captured long, dropped long")


#: Events that lost user ids on one day, two thirds of the way through the stream.
_SQL_SPIKE_DAY = "(SELECT date_trunc('day', min(ts))::TIMESTAMP + to_days(CAST(date_diff('day', min(ts), max(ts)) * 2 // 3 AS INTEGER)) FROM events)"
_SQL_SPIKED = f"""(SELECT event_id, ts, CASE WHEN date_trunc('day', ts) = {_SQL_SPIKE_DAY} AND {sql_pick('event_id', ':stream')} < 150
    THEN NULL ELSE user_id END AS user_id, event_type, value, props FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED})"""


@query(
    "stream_judgements",
    sql_backtest(_SQL_SPIKED) + """ SELECT 'events' AS "table", col AS "column", metric, ws AS window_start, round(o, 9) AS observation, fired, evaluated,
        anomalous, direction FROM votes JOIN (SELECT col, i, ws FROM ix) USING (col, i)""",
)
def stream_judgements(t: Tables) -> DataFrame:
    """Every closed window of the stream judged on the windows closed before it."""
    first, last = t.events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    spike = first + timedelta(days=(last - first).days * 2 // 3) if first else None
    lost = (F.to_date("ts") == F.lit(spike)) & (pick("event_id", ":stream") < 150)
    spiked = t.events.withColumn("user_id", F.when(~lost, F.col("user_id")))
    stream = jobs.stream_table(t.spark, _files(spiked, "spiked"))
    histogram = jobs.stream_histogram(stream, "events", SCHEMA["events"], "ts", "1 day", "1 hour")
    path = fresh_path(t.spark, "judged")
    jobs.run_batches(histogram, jobs.judge_batch(path), "judged")
    judged = t.spark.read.parquet(path)
    return judged.select(
        "table", "column", "metric", "window_start", F.round("observation", 9).alias("observation"), "fired", "evaluated", "anomalous", "direction"
    )
