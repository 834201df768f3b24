"""The event path as Structured Streaming jobs.

Every job takes and returns a streaming DataFrame; state is bounded by the watermark. Results go to files,
so nothing passes through the driver, and each sink can be replayed after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clock, time_literal, utc_session
from ..operators import anomaly, behaviour, profile
from ..session import cut, fresh_path
from ..sources import events as ev


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over parquet files, with the schema of the files there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Sets the watermark; a time without zone is read as UTC, because watermarks need an instant."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        named = F.to_timestamp(F.concat(F.col(ts).cast("string"), F.lit("Z")))
        df = df.withColumn(ts, F.col(ts).cast("timestamp") if utc_session(df.sparkSession) else named)
    return df.withWatermark(ts, watermark)


def _clock(instant: str) -> Column:
    """An instant as UTC wall-clock time."""
    return F.to_utc_timestamp(F.col(instant), F.current_timezone()).cast("timestamp_ntz")


def stream_dedupe(events: DataFrame, watermark: str, key: str = "operation_id", ts: str = "started_at") -> DataFrame:
    """Each key once, however often it is sent again within the watermark."""
    return event_time(events, ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_statements(events: DataFrame) -> DataFrame:
    """Exploded, fingerprinted statements; keeps no state."""
    return ev.explode_statements(events)


def stream_fingerprint_counts(statements: DataFrame, watermark: str, window: str, ts: str = "started_at") -> DataFrame:
    """Executions of each shape per closed window."""
    counted = event_time(statements, ts, watermark).groupBy(F.window(ts, window), "fingerprint").agg(
        F.count(F.lit(1)).alias("executions")
    )
    return counted.select(_clock("window.start").alias("window_start"), "fingerprint", "executions")


def stream_histogram(df: DataFrame, table: str, columns: Sequence[str], ts: str, window: str, watermark: str) -> DataFrame:
    """Value counts per column for every closed window; profile.column_profile reads them like a batch
    histogram, so distinct counts stay exact."""
    types = dict(df.dtypes)
    text = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"), profile.value_key(df, c).alias("value")) for c in columns]
    long = event_time(df, ts, watermark).select(ts, F.explode(F.array(*text)).alias("v")).select(ts, "v.*")
    counted = long.groupBy(F.window(ts, window), "column", "data_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.lit(table).alias("table"), "column", "data_type", _clock("window.start").alias("window_start"), "value", "n"
    )


def stream_profile(histogram: DataFrame) -> DataFrame:
    """Column profiles from written histograms of closed windows."""
    return profile.column_profile(histogram)


def stream_repetition(
    statements: DataFrame, gap: str, watermark: str, threshold: int = behaviour.DEFAULT_THRESHOLD, ts: str = "started_at"
) -> DataFrame:
    """Shapes that ran more than ``threshold`` times in a request; a request closes after ``gap``."""
    inside = statements.where(F.col("request_id").isNotNull() & F.col("route").isNotNull())
    counted = event_time(inside, ts, watermark).groupBy(
        F.session_window(ts, gap), "app", "route", "request_id", "fingerprint"
    ).agg(F.count(F.lit(1)).alias("executions"))
    return counted.where(F.col("executions") > threshold).select("app", "route", "request_id", "fingerprint", "executions")


def stream_rates(statements: DataFrame, window: str, slide: str, watermark: str, ts: str = "started_at") -> DataFrame:
    """Sliding statement counts per route with an approximate p95 of their duration."""
    counted = event_time(statements, ts, watermark).groupBy(F.window(ts, window, slide), "route").agg(
        F.count(F.lit(1)).alias("statements"), F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_ms"),
    )
    return counted.select(
        _clock("window.start").alias("window_start"), "route", "statements", "max_ms", "p95_ms"
    )


def run_reported(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Runs a stream over everything available now; what it wrote, and the reports of its batches."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    reports = _finish(df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append"))
    return spark.read.schema(df.schema).parquet(path), reports


def run_available(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Runs a stream over everything available now and returns what it wrote."""
    return run_reported(df, name, path)[0]


def run_batches(df: DataFrame, batch: Callable[[DataFrame, int], None], name: str) -> list[dict]:
    """Hands every micro-batch to ``batch`` (which must be repeatable); returns the progress reports."""
    state = fresh_path(df.sparkSession, f"{name}-state")
    return _finish(df.writeStream.foreachBatch(batch).option("checkpointLocation", state))


def _finish(writer) -> list[dict]:
    """Runs to the end and returns the report of every batch, gathered while they appear."""
    query = writer.trigger(availableNow=True).start()
    reports: dict[int, dict] = {}
    running = True
    while running:
        running = not query.awaitTermination(timeout=2)
        for p in query.recentProgress:
            report = dict(p) if isinstance(p, dict) else p.jsonValue
            reports[report["batchId"]] = report
    return [reports[i] for i in sorted(reports)]


def accounting(progress: Sequence[dict]) -> dict[str, int]:
    """Rows captured, and rows the stateful operators dropped for arriving behind their watermark."""
    dropped = sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p.get("stateOperators", []))
    return {"batches": len(progress), "captured": sum(int(p.get("numInputRows", 0)) for p in progress), "dropped": dropped}


def watermark_reached(progress: Sequence[dict]) -> datetime | None:
    """The last watermark of a run, as UTC wall-clock time: windows that end by then are closed."""
    reached = [p["eventTime"]["watermark"] for p in progress if "watermark" in (p.get("eventTime") or {})]
    return max(datetime.fromisoformat(w.replace("Z", "+00:00")) for w in reached).replace(tzinfo=None) if reached else None


# ---- late rows -----------------------------------------------------------------------------------
#
# The stream drops what arrives behind its watermark; the stored rows have it. Windows whose stored rows are more than
# the stream counted are found by their counts and computed again from the store, the others stay as they are.


def store_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps every row; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def _window_starts(df: DataFrame, ts: str, window: str) -> DataFrame:
    start = F.window(F.col(ts), window)["start"]
    plain = start if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else _naive(start)
    return df.withColumn("window_start", plain.cast("timestamp_ntz"))


def _naive(instant: Column) -> Column:
    return F.to_utc_timestamp(instant, F.current_timezone())


def dirty_windows(stored: DataFrame, histogram: DataFrame, ts: str, window: str, closed: datetime) -> DataFrame:
    """(window_start, stored, counted): closed windows of which the stream counted fewer rows than are stored.

    ``histogram`` is what the stream wrote (one of its columns tells the rows of a window); a closed window that it
    never wrote, because all its rows came late, counts 0.
    """
    one = histogram.agg(F.min("column")).scalar()
    counted = histogram.where(F.col("column") == one).groupBy("window_start").agg(F.sum("n").alias("counted"))
    rows = _window_starts(stored, ts, window).groupBy("window_start").agg(F.count(F.lit(1)).alias("stored"))
    ended = rows.where(F.col("window_start") + F.expr(f"INTERVAL {window}") <= clock(closed))
    unequal = ended.join(counted, "window_start", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return unequal.where("stored <> counted").select("window_start", "stored", "counted")


def recomputed(
    stored: DataFrame, dirty: DataFrame, table: str, columns: Sequence[str], ts: str, window: str
) -> DataFrame:
    """The histogram of the dirty windows only, from the stored rows.

    ``dirty`` should be a written table: its first and last window bound the scan, and its few windows choose the rows.
    """
    first, last = dirty.agg(F.min("window_start"), F.max(F.col("window_start") + F.expr(f"INTERVAL {window}"))).first()
    kind = stored.schema[ts].dataType
    types = dict(stored.dtypes)
    out = "table string, column string, data_type string, window_start timestamp_ntz, value string, n long"
    if first is None:
        return stored.sparkSession.createDataFrame([], out)
    near = stored.where((F.col(ts) >= time_literal(first, kind)) & (F.col(ts) < time_literal(last, kind)))
    again = _window_starts(near, ts, window).join(dirty.select("window_start"), "window_start", "left_semi")
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"), profile.value_key(stored, c).alias("value")) for c in columns])
    counted = again.select("window_start", F.explode(values).alias("v")).groupBy("window_start", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(table).alias("table"), "v.column", "v.data_type", "window_start", "v.value", "n")


def with_late_rows(
    stored: DataFrame, histogram: DataFrame, table: str, columns: Sequence[str], ts: str, window: str, closed: datetime
) -> tuple[DataFrame, DataFrame]:
    """(histogram, dirty): the stream's histogram with its dirty windows computed again, and those windows."""
    dirty = cut(dirty_windows(stored, histogram, ts, window, closed))
    kept = histogram.join(dirty.select("window_start"), "window_start", "left_anti").select(*histogram.columns)
    return kept.unionByName(recomputed(stored, dirty, table, columns, ts, window)), dirty


def counted_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that records how many rows each micro-batch held."""

    def write(batch: DataFrame, epoch: int) -> None:
        sizes = batch.groupBy().agg(F.count(F.lit(1)).alias("rows"))
        sizes.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def upsert_batch(path: str, keys: Sequence[str], order: Sequence[str], compact_every: int = 0) -> Callable[[DataFrame, int], None]:
    """Keyed upsert as a log: each micro-batch overwrites its own folder with its latest row per key, so
    a replayed batch changes nothing. ``latest`` reads the log.

    With ``compact_every`` the rows so far are written as one generation after every so many batches.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        ev.latest_by_key(batch, list(keys), list(order)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if compact_every and (epoch + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys, order, epoch)

    return write


def _generations(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-generations")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}-generations")


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], upto: int) -> None:
    """Writes the latest rows of the batches up to ``upto`` as a generation; a generation written again is the same."""
    rows = latest(spark, path, keys, order, upto, below=upto)
    rows.write.mode("overwrite").parquet(f"{path}-generations/generation={upto}")


def latest(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], upto: int | None = None, below: int | None = None
) -> DataFrame:
    """The latest row per key: the newest generation (older than ``below``) and the batches after it (to ``upto``)."""
    log = spark.read.parquet(path)
    if upto is not None:
        log = log.where(F.col("batch") <= upto)
    stored = _generations(spark, path)
    if stored is not None and below is not None:
        stored = stored.where(F.col("generation") < below)
    newest = None if stored is None else stored.agg(F.max("generation")).first()[0]
    if newest is None:
        return ev.latest_by_key(log.drop("batch"), list(keys), list(order))
    kept = stored.where(F.col("generation") == newest).drop("generation")
    return ev.latest_by_key(kept.unionByName(log.where(F.col("batch") > newest).drop("batch")), list(keys), list(order))


def judge_batch(
    path: str, baseline: tuple[DataFrame, DataFrame] | None = None, vote: str = "majority"
) -> Callable[[DataFrame, int], None]:
    """A batch function for closed histogram windows: every window of the batch is judged on all windows
    before it, those of ``baseline`` (columns, categories), of earlier batches and of the batch itself.

    Judgements go to ``path``, the batch's profiles to ``path``-columns and ``path``-categories, each to a
    folder of the batch, so a replayed batch changes nothing. Windows with fewer earlier ones than the
    detectors need are stored and not judged.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        profiles = profile.settle(
            {"columns": profile.column_profile(batch), "categories": profile.category_frequency(batch)}
        )
        oldest = profiles[0].agg(F.min("window_start")).first()[0]
        if oldest is None:
            return
        history = []
        for i, (part, rows) in enumerate(zip(("columns", "categories"), profiles)):
            rows.write.mode("overwrite").parquet(f"{path}-{part}/batch={epoch}")
            stored = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}-{part}")
            stored = stored.where(F.col("batch") <= epoch).drop("batch")
            if baseline is not None:
                stored = baseline[i].where(F.col("window_start") < clock(oldest)).select(*rows.columns).unionByName(stored)
            history.append(stored)
        judged = anomaly.backtest(*history, vote=vote, since=oldest)
        judged.drop("summary").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write
