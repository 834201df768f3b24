"""Load-run analysis: repeatability of a workload and the cost of observing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import exact_percentiles

#: Fixed value: counts across runs must differ by less than this share.
REPEATABILITY_LIMIT = 0.05


def route_repeatability(counts: DataFrame) -> DataFrame:
    """(route, runs, max_relative_deviation) of statement counts; a route a run lacks counts 0.

    ``counts``: run_id, route, operations, statements.
    """
    runs = counts.agg(F.countDistinct("run_id")).scalar()
    per_route = counts.groupBy("route").agg(
        F.sum("statements").alias("s"), F.max("statements").alias("hi"), F.min("statements").alias("lo"),
        F.countDistinct("run_id").alias("present"),
    ).withColumn("runs", runs)
    mean = F.col("s") / F.col("runs")
    low = F.when(F.col("present") < F.col("runs"), F.lit(0)).otherwise(F.col("lo"))
    away = F.greatest(F.col("hi") - mean, mean - low)
    return per_route.select(
        "route", "runs", F.when(mean == 0, F.lit(0.0)).otherwise(away / mean).alias("max_relative_deviation")
    )


def repeatability(counts: DataFrame, limit: float = REPEATABILITY_LIMIT) -> DataFrame:
    """One row: runs, deviation of the totals, of the worst route, and whether all stay below limit."""
    totals = counts.groupBy("run_id").agg(F.sum("operations").alias("o"), F.sum("statements").alias("s"))
    spread = totals.agg(
        F.count(F.lit(1)).alias("runs"),
        *[x for c in ("o", "s") for x in (F.avg(c).alias(f"{c}m"), F.max(c).alias(f"{c}h"), F.min(c).alias(f"{c}l"))],
    )
    away = lambda c: F.when(F.col(f"{c}m") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.col(f"{c}h") - F.col(f"{c}m"), F.col(f"{c}m") - F.col(f"{c}l")) / F.col(f"{c}m")
    )
    worst = route_repeatability(counts).agg(F.max("max_relative_deviation")).scalar()
    row = spread.select(
        "runs", away("o").alias("operations_deviation"), away("s").alias("statements_deviation"),
        F.coalesce(worst, F.lit(0.0)).alias("worst_route_deviation"),
    )
    largest = F.greatest("operations_deviation", "statements_deviation", "worst_route_deviation")
    return row.withColumn("passes", (F.col("runs") >= 2) & (largest < limit))


def latency_stats(requests: DataFrame, by: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """n, median, p95 and mean per group."""
    totals = requests.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"))
    return totals.join(exact_percentiles(requests, by, value, {"median_ms": 0.5, "p95_ms": 0.95}), list(by), "left")


def measured(requests: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Successful requests of non-warm-up runs, with their run's condition."""
    joined = requests if runs is None else requests.join(runs.select("run_id", "collector_enabled", "warmup"), "run_id")
    return joined.where(~F.col("warmup") & (F.col("status") == 200))


def _state() -> F.Column:
    return F.when(F.col("collector_enabled"), "on").otherwise("off")


def overhead(requests: DataFrame) -> DataFrame:
    """One row: latency with and without collection, and the difference."""
    stats = latency_stats(requests.withColumn("state", _state()), ["state"])
    side = lambda state, c: F.max(F.when(F.col("state") == state, F.col(c))).alias(f"{c}_{state}")
    wide = stats.agg(*[side(s, c) for s in ("on", "off") for c in ("n", "median_ms", "p95_ms", "mean_ms")])
    return wide.select(
        "*", (F.col("median_ms_on") - F.col("median_ms_off")).alias("median_overhead_ms"),
        F.try_divide(F.col("median_ms_on"), F.col("median_ms_off")).alias("_r"),
        (F.col("p95_ms_on") - F.col("p95_ms_off")).alias("p95_overhead_ms"),
    ).withColumn("median_overhead_ratio", F.col("_r") - 1).drop("_r")


def per_entry_delta(requests: DataFrame) -> DataFrame:
    """Median latency per entry with and without collection; entries seen in both only."""
    medians = exact_percentiles(requests.withColumn("state", _state()), ["entry_id", "state"], "latency_ms", {"m": 0.5})
    wide = medians.groupBy("entry_id").agg(
        F.max(F.when(F.col("state") == "on", F.col("m"))).alias("median_on_ms"),
        F.max(F.when(F.col("state") == "off", F.col("m"))).alias("median_off_ms"),
    )
    both = wide.where(F.col("median_on_ms").isNotNull() & F.col("median_off_ms").isNotNull())
    return both.withColumn("median_delta_ms", F.col("median_on_ms") - F.col("median_off_ms"))


def cpu_cost(counters: DataFrame, requests: DataFrame, runs: DataFrame) -> DataFrame:
    """CPU time per successful request and memory, per service and condition.

    ``counters``: run_id, service, phase (start/end), cpu_usage_usec, memory_current_bytes,
    memory_peak_bytes. Runs without a successful request are left out.
    """
    at = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    deltas = counters.groupBy("run_id", "service").agg(
        (at("end", "cpu_usage_usec") - at("start", "cpu_usage_usec")).alias("cpu_usec"),
        at("end", "memory_current_bytes").alias("memory_end_bytes"), at("end", "memory_peak_bytes").alias("memory_peak_bytes"),
    ).where(F.col("cpu_usec").isNotNull())
    served = requests.where(F.col("status") == 200).groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"))
    usable = deltas.join(runs.where(~F.col("warmup")).select("run_id", "collector_enabled"), "run_id").join(served, "run_id")
    return usable.groupBy("service", _state().alias("state")).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("cpu_usec") / F.col("requests") / 1000).alias("cpu_ms_per_request"),
        (F.avg("memory_end_bytes") / 1024**2).alias("memory_mib_end"), (F.max("memory_peak_bytes") / 1024**2).alias("memory_mib_peak"),
    )


def resource_stats(samples: DataFrame) -> DataFrame:
    """Mean CPU, mean and largest memory per service and condition; warm-up left out."""
    return samples.where(~F.col("warmup")).groupBy("service", _state().alias("state")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("cpu_percent").alias("cpu_percent_mean"),
        (F.avg("memory_bytes") / 1024**2).alias("memory_mib_mean"), (F.max("memory_bytes") / 1024**2).alias("memory_mib_max"),
    )


def candidates(parent: DataFrame, key: str, child: DataFrame, child_key: str, at_least: int = 1, limit: int | None = 100) -> DataFrame:
    """Parents with at least so many children, in key order: values to fill request parameters."""
    enough = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    chosen = parent.select(key).join(enough.select(key), key, "left_semi").orderBy(key)
    return chosen if limit is None else chosen.limit(limit)
