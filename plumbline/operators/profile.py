"""Column profiles from one value histogram.

Asking for ``count(DISTINCT c)`` of many columns makes Spark copy every row once per column and
group all copies together; asking per column scans the table once per column. Here the requested
columns are unpivoted to (column, value) and counted once. Row counts, null counts, distinct
counts, duplicate rates and category frequencies are all derived from that one histogram.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clock, ratio, time_literal, utc_session
from ..session import cut
from ..sources.tables import BOOKKEEPING_TABLES

#: Columns with more distinct values than this store no categories (a storage limit).
DEFAULT_MAX_CATEGORIES = 50
#: Bytes up to which a text is its own key; a longer one is grouped by its digest and shown by its first characters.
KEY_BYTES, SHOWN = 256, 64

Window = tuple[datetime, datetime]


def consecutive_windows(end: datetime, count: int, days: int = 30) -> list[Window]:
    """``count`` half-open windows of ``days`` ending at ``end``, oldest first."""
    if count < 1 or days < 1:
        raise ValueError("count and days must be at least 1")
    step = timedelta(days=days)
    return [(end - step * (i + 1), end - step * i) for i in reversed(range(count))]


def make_windows(spark: SparkSession, end: datetime, count: int, days: int = 30) -> DataFrame:
    """The same windows as a DataFrame."""
    return spark.createDataFrame(
        consecutive_windows(end, count, days),
        "window_start timestamp_ntz, window_end timestamp_ntz",
    )


def detect_time_column(schema: T.StructType, override: str | None = None) -> str | None:
    """The creation-time column: the first timestamp column defaulting to the current time.

    Files record no defaults, so when no timestamp column carries one the first one is taken.
    """
    if override is not None:
        if override not in schema.names:
            raise ValueError(f"no column {override!r} to window on")
        return override
    stamps = [f for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    defaulting = [
        f for f in stamps
        if any(w in str(f.metadata.get("CURRENT_DEFAULT", "")).lower() for w in ("now", "current_timestamp"))
    ]
    chosen = defaulting or ([] if any("CURRENT_DEFAULT" in f.metadata for f in schema.fields) else stamps)
    return chosen[0].name if chosen else None


def window_start_of(ts: Column, windows: Sequence[Window]) -> Column:
    """Array of starts of the windows holding ``ts``: [start, end), so windows may overlap."""
    for start, end in windows:
        if start >= end:
            raise ValueError("window start must be before its end")
    holding = [
        F.when((ts >= clock(start)) & (ts < clock(end)), clock(start)) for start, end in windows
    ]
    return F.array_compact(F.array(*holding))


def _in_windows(df: DataFrame, ts: str, windows: Sequence[Window]) -> DataFrame:
    """Rows of ``df`` tagged with ``window_start``. The outer bounds reach the scan as filters."""
    moment = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        moment = F.to_utc_timestamp(moment, F.current_timezone()).cast("timestamp_ntz")
    first, last = min(w[0] for w in windows), max(w[1] for w in windows)
    kind = df.schema[ts].dataType
    bounded = df.where((F.col(ts) >= time_literal(first, kind)) & (F.col(ts) < time_literal(last, kind)))
    width = windows[0][1] - windows[0][0]
    regular = all(
        w == (windows[0][0] + width * i, windows[0][0] + width * (i + 1))
        for i, w in enumerate(windows)
    )
    # Spark's timestamp arithmetic follows the session's zone; comparisons of naive times do not.
    if regular and utc_session(df.sparkSession):
        passed = F.timestamp_diff("MICROSECOND", clock(first), moment)
        length = F.lit(int(width / timedelta(microseconds=1)))
        start = F.timestamp_add("MICROSECOND", passed - F.pmod(passed, length), clock(first))
        return bounded.withColumn("window_start", start.cast("timestamp_ntz"))
    return bounded.withColumn("window_start", F.explode(window_start_of(moment, windows)))


def value_key(df: DataFrame, name: str) -> Column:
    """A column's value as text to count by: long texts, arrays and structs as their beginning and a 128-bit digest."""
    text = F.col(name).cast("string")
    if isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return text
    short = F.concat(F.substring(text, 1, SHOWN), F.lit(" … "), F.md5(text.cast("binary")))
    return F.when(F.octet_length(text) <= KEY_BYTES, text).otherwise(short)


def value_histogram(
    df: DataFrame,
    table: str,
    columns: Sequence[str] | None = None,
    ts: str | None = None,
    windows: Sequence[Window] | None = None,
) -> DataFrame:
    """(table, column, data_type, window_start, value, n): one scan, one shuffle.

    Values are compared as text, so every type is handled alike; whole documents are not shuffled, but their digests. A
    row with n = 0 stands for each (column, window), so that windows without rows are still reported.
    """
    spark = df.sparkSession
    names = list(columns) if columns is not None else df.columns
    types = dict(df.dtypes)
    if windows is None:
        tagged = df.withColumn("window_start", F.lit(None).cast("timestamp_ntz"))
        starts: list[datetime | None] = [None]
    else:
        tagged = _in_windows(df, ts, windows)
        starts = [w[0] for w in windows]
    text = [value_key(df, c).alias(f"v_{i}") for i, c in enumerate(names)]
    long = tagged.select("window_start", *text).unpivot(
        ["window_start"], [f"v_{i}" for i in range(len(names))], "_c", "value"
    )
    counted = long.groupBy("_c", "window_start", "value").agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame(
        [(f"v_{i}", s, None, 0) for i in range(len(names)) for s in starts],
        "_c string, window_start timestamp_ntz, value string, n bigint",
    )
    pairs = lambda values: F.create_map(
        *[x for i, v in enumerate(values) for x in (F.lit(f"v_{i}"), F.lit(v))]
    )
    return counted.unionByName(frame).select(
        F.lit(table).alias("table"),
        pairs(names)[F.col("_c")].alias("column"),
        pairs([types[c] for c in names])[F.col("_c")].alias("data_type"),
        "window_start",
        "value",
        "n",
    )


_KEY = ("table", "column", "data_type", "window_start")


def column_profile(histogram: DataFrame) -> DataFrame:
    """Row, null and distinct counts with their rates, per column (and window)."""
    counted = histogram.groupBy(*_KEY).agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )
    present = F.col("row_count") - F.col("null_count")
    return counted.select(
        *_KEY,
        "row_count",
        "null_count",
        ratio("null_count", "row_count").alias("null_rate"),
        "distinct_count",
        ratio(present - F.col("distinct_count"), present).alias("duplicate_rate"),
    )


def category_frequency(
    histogram: DataFrame,
    profile: DataFrame | None = None,
    max_categories: int = DEFAULT_MAX_CATEGORIES,
) -> DataFrame:
    """Value counts of columns with few, repeating values: (table, column, window_start, value, count)."""
    if max_categories < 1:
        raise ValueError("max_categories must be at least 1")
    profile = column_profile(histogram) if profile is None else profile
    present = F.col("row_count") - F.col("null_count")
    listed = profile.where(
        (present > 0) & (F.col("distinct_count") <= max_categories) & (F.col("distinct_count") < present)
    ).select("table", "column", "window_start")
    # One row per column and window: the table's width times the windows asked for.
    h, p = histogram.where(F.col("value").isNotNull()).alias("h"), F.broadcast(listed).alias("p")
    same = (
        (F.col("h.table") == F.col("p.table"))
        & (F.col("h.column") == F.col("p.column"))
        & F.col("h.window_start").eqNullSafe(F.col("p.window_start"))
    )
    return h.join(p, same, "left_semi").select(
        "table", "column", "window_start", "value", F.col("n").alias("count")
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def profile(
    tables: Mapping[str, DataFrame],
    windows: Sequence[Window] | None = None,
    time_columns: Mapping[str, str] | None = None,
    columns: Mapping[str, Sequence[str]] | None = None,
    max_categories: int = DEFAULT_MAX_CATEGORIES,
    ignored: Sequence[str] = BOOKKEEPING_TABLES,
) -> dict[str, DataFrame]:
    """Profiles every table: ``tables``, ``columns``, ``categories`` and ``skipped``.

    With windows, a table without a creation-time column is skipped and the reason recorded.
    """
    spark = next(iter(tables.values())).sparkSession
    histograms, used, skipped = [], [], []
    for name, df in sorted(tables.items()):
        if name in ignored:
            continue
        stamp = detect_time_column(df.schema, (time_columns or {}).get(name))
        if windows is not None and stamp is None:
            skipped.append((name, "no creation-time column to window on"))
            continue
        wanted = (columns or {}).get(name)
        histograms.append(value_histogram(df, name, wanted, stamp, windows))
        used.append((name, stamp if windows is not None else None))
    skipped_tables = spark.createDataFrame(skipped, "table string, reason string")
    time_used = spark.createDataFrame(used, "table string, time_column string")
    if not histograms:
        raise ValueError("no table can be profiled")
    histogram = _union(histograms)
    profiled = column_profile(histogram)
    counts = profiled.groupBy("table", "window_start").agg(F.max("row_count").alias("row_count"))
    return {
        "tables": counts.join(time_used, "table"),
        "columns": profiled,
        "categories": category_frequency(histogram, profiled, max_categories),
        "skipped": skipped_tables,
        "time_columns": time_used,
    }


def settle(profiled: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Materialises a profile in one job; returns its columns and categories.

    Columns and categories share the histogram's shuffle only within one job, so they are written
    as one table: a row per column and window, with its categories (max_categories at most).
    """
    listed = profiled["categories"].groupBy("table", "column", "window_start").agg(
        F.collect_list(F.struct("value", "count")).alias("_categories")
    )
    p, c = profiled["columns"].alias("p"), listed.alias("c")
    same = (
        (F.col("p.table") == F.col("c.table"))
        & (F.col("p.column") == F.col("c.column"))
        & F.col("p.window_start").eqNullSafe(F.col("c.window_start"))
    )
    written = cut(p.join(c, same, "left").select("p.*", "c._categories"))
    categories = written.select(
        "table", "column", "window_start", F.explode("_categories").alias("c")
    ).select("table", "column", "window_start", "c.value", "c.count")
    return written.drop("_categories"), categories


def approx_profile(df: DataFrame, table: str, rsd: float = 0.02, columns: Sequence[str] | None = None) -> DataFrame:
    """Column profile with approximate distinct counts: one scan, a fixed-size sketch per column."""
    names = list(columns) if columns is not None else df.columns
    sketches = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        sketches += [
            F.count(c).alias(f"n{i}"),
            F.approx_count_distinct(F.col(c).cast("string"), rsd).alias(f"d{i}"),
        ]
    wide = df.agg(*sketches)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(t).alias("data_type"),
                F.col(f"n{i}").alias("present"), F.least(f"d{i}", f"n{i}").alias("distinct_count"),
            )
            for i, (c, t) in enumerate((c, dict(df.dtypes)[c]) for c in names)
        ]
    )
    long = wide.select("rows", F.explode(rows).alias("r")).select("rows", "r.*")
    return long.select(
        F.lit(table).alias("table"),
        "column",
        "data_type",
        F.col("rows").alias("row_count"),
        (F.col("rows") - F.col("present")).alias("null_count"),
        ratio(F.col("rows") - F.col("present"), "rows").alias("null_rate"),
        "distinct_count",
        ratio(F.col("present") - F.col("distinct_count"), "present").alias("duplicate_rate"),
    )
