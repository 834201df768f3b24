"""Append-only store of profile runs: five parquet tables partitioned by app and label.

A run is never changed after it is written; history is read back by filtering on the run.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("run", "table", "column", "category", "integrity")


def run_row(
    spark: SparkSession,
    run_id: str,
    app: str,
    label: str | None,
    profiled_at: datetime,
    window: tuple[datetime, datetime] | None = None,
    max_categories: int = 50,
    time_columns: Mapping[str, str] | None = None,
    skipped_tables: Mapping[str, str] | None = None,
) -> DataFrame:
    start, end = window or (None, None)
    return spark.createDataFrame(
        [(run_id, app, label, profiled_at, start, end, max_categories,
          dict(time_columns or {}), dict(skipped_tables or {}))],
        "run_id string, app string, label string, profiled_at timestamp_ntz, "
        "window_start timestamp_ntz, window_end timestamp_ntz, max_categories int, "
        "time_columns map<string,string>, skipped_tables map<string,string>",
    )


def run_rows(
    windows: DataFrame, app: str, label: str | None, profiled_at: datetime, max_categories: int = 50,
    time_columns: Mapping[str, str] | None = None, skipped_tables: Mapping[str, str] | None = None,
) -> DataFrame:
    """One run per window, named after the day on which the window starts."""
    one = run_row(windows.sparkSession, "", app, label, profiled_at, None, max_categories, time_columns, skipped_tables)
    named = windows.select(F.date_format("window_start", "'w'yyyyMMdd").alias("run_id"), "window_start", "window_end")
    pairs = lambda values: F.map_from_arrays(
        F.array(*[F.lit(k) for k in values]).cast("array<string>"), F.array(*[F.lit(v) for v in values.values()]).cast("array<string>")
    )
    full = named.withColumns({
        "app": F.lit(app), "label": F.lit(label), "max_categories": F.lit(max_categories), "profiled_at": F.lit(profiled_at).cast("timestamp_ntz"),
        "time_columns": pairs(dict(time_columns or {})), "skipped_tables": pairs(dict(skipped_tables or {})),
    })
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in one.schema])


def append_profile(path: str, **parts: DataFrame) -> None:
    """Appends the given parts (``run``, ``table``, ``column``, ``category``, ``integrity``).

    Every part carries app, label and run_id.
    """
    for name in parts:
        if name not in PARTS:
            raise ValueError(f"unknown part {name!r}; choose from {PARTS}")
    for name, df in parts.items():
        df.write.mode("append").partitionBy("app", "label").parquet(f"{path}/{name}")


def read_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def profile_runs(runs: DataFrame, columns: DataFrame, app: str, label: str | None = None) -> DataFrame:
    """Runs of an app with their column count, by window (snapshots last), then time taken."""
    counted = columns.groupBy("run_id").agg(F.count(F.lit(1)).alias("columns"))
    chosen = runs.where(F.col("app") == app)
    if label is not None:
        chosen = chosen.where(F.col("label") == label)
    return (
        chosen.join(counted, "run_id", "left")
        .select("run_id", "app", "label", "profiled_at", "window_start", "window_end",
                F.coalesce("columns", F.lit(0)).alias("columns"))
        .orderBy(F.asc_nulls_last("window_start"), "profiled_at")
    )


def _windowed(runs: DataFrame, app: str, label: str | None) -> DataFrame:
    chosen = runs.where((F.col("app") == app) & F.col("window_start").isNotNull())
    return chosen if label is None else chosen.where(F.col("label") == label)


def column_history(
    runs: DataFrame, columns: DataFrame, app: str, table: str, column: str, label: str | None = None
) -> DataFrame:
    """Windowed profiles of one column, oldest first; snapshots excluded."""
    picked = columns.where((F.col("table") == table) & (F.col("column") == column)).select(
        "run_id", "row_count", "null_count", "null_rate", "distinct_count", "duplicate_rate"
    )
    keep = ["run_id", "label", "window_start", "window_end", "profiled_at"]
    return _windowed(runs, app, label).select(*keep).join(picked, "run_id").orderBy("window_start")


def category_history(
    runs: DataFrame, categories: DataFrame, app: str, table: str, column: str,
    label: str | None = None,
) -> DataFrame:
    """Per window the value -> count map of one column, counts descending, oldest first.

    A map holds at most the profiler's max_categories entries.
    """
    picked = categories.where((F.col("table") == table) & (F.col("column") == column)).select(
        "run_id", "value", "count"
    )
    joined = _windowed(runs, app, label).select("run_id", "window_start", "window_end").join(picked, "run_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "value", "count")))
    return (
        joined.groupBy("run_id", "window_start", "window_end")
        .agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["value"], x["count"]))).alias("distribution"))
        .orderBy("window_start")
    )


def windowed_columns(runs: DataFrame, columns: DataFrame, app: str, label: str | None = None) -> DataFrame:
    keep = _windowed(runs, app, label).select("run_id", "window_start", "window_end")
    return columns.drop("window_start", "app", "label").join(keep, "run_id")


def windowed_categories(runs: DataFrame, categories: DataFrame, app: str, label: str | None = None) -> DataFrame:
    keep = _windowed(runs, app, label).select("run_id", "window_start")
    return categories.drop("window_start", "app", "label").join(keep, "run_id")


def run_summary(
    runs: DataFrame, tables: DataFrame, columns: DataFrame, categories: DataFrame,
    integrity: DataFrame | None = None,
) -> DataFrame:
    """Counts of tables, columns, category rows and integrity checks per run."""
    result = runs.select("run_id", "app", "label", "window_start", "window_end")
    parts = {"tables": tables, "columns": columns, "category_rows": categories}
    if integrity is not None:
        parts["integrity_checks"] = integrity
    for name, part in parts.items():
        result = result.join(part.groupBy("run_id").agg(F.count(F.lit(1)).alias(name)), "run_id", "left")
    return result.fillna(0, list(parts))
