"""Is an observation outside the range its own history predicts?

A judgement is one row per (table, column, metric, window) carrying the observation and its history
as an ordered array with one entry per earlier window. Expected ranges are expressions over that
array, so adding a detector adds no shuffle. No number here limits a metric itself: every bound is
learned from the history.

Walk-forward judgements carry a ``summary`` of the earlier windows in place of the array: size, moments, quartiles
and the last points, brought forward from window to window.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clock, digest
from ..session import cut

#: Method parameters of the detectors.
DEFAULT_SIGMAS = 3.0
DEFAULT_IQR_MULTIPLIER = 1.5
DEFAULT_MOVING_WINDOW = 6
MIN_HISTORY = 5

#: Categories listed as the explanation of a distribution shift.
EXPLAIN_TOP = 5

#: The rule each metric reports.
RULE_FOR_METRIC = {
    "null_rate": "NULL_SPIKE",
    "duplicate_rate": "DUPLICATE_SPIKE",
    "distribution_shift": "DISTRIBUTION_SHIFT",
}

_DETECTION = (
    "struct<detector:string,evaluated:boolean,anomalous:boolean,observation:double,lower:double,"
    "upper:double,center:double,spread:double,deviation:double,direction:string,history_size:int,"
    "parameters:map<string,double>,degenerate:boolean>"
)


# ---- ranges learned from a history -----------------------------------------------------------


def _mean(values: Column) -> Column:
    """Arithmetic mean; exactly the common value when all are equal."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.array_min(values) == F.array_max(values), F.array_min(values)).otherwise(
        total / F.size(values)
    )


def _deviation(values: Column, center: Column) -> Column:
    """Sample standard deviation; exactly 0 when all values are equal."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - center) * (x - center))
    return F.when(F.array_min(values) == F.array_max(values), F.lit(0.0)).otherwise(
        F.sqrt(squares / (F.size(values) - 1))
    )


def _size(df: DataFrame) -> Column:
    return F.col("summary.size") if "summary" in df.columns else F.size("history")


def _quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation at (n-1)p."""
    position = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(position).cast("int")
    at = lambda i: F.get(ordered, i)
    high = F.least(low + 1, F.size(ordered) - 1)
    return at(low) + (at(high) - at(low)) * (position - low)


def _with_verdict(
    df: DataFrame, name: str, enough: Column, factor: float, parameters: dict[str, float]
) -> DataFrame:
    """Adds the detection struct ``name`` from the settled ``_center``, ``_spread``, ``_low`` and
    ``_high`` (the range runs ``factor`` spreads beyond low and high)."""
    settled = (
        df.withColumn("_enough", enough)
        .withColumn("_lower", F.col("_low") - F.lit(float(factor)) * F.col("_spread"))
        .withColumn("_upper", F.col("_high") + F.lit(float(factor)) * F.col("_spread"))
        .withColumn(
            "_side",
            F.when(F.col("_enough") & (F.col("observation") < F.col("_lower")), "below").when(
                F.col("_enough") & (F.col("observation") > F.col("_upper")), "above"
            ),
        )
    )
    able = lambda c: F.when(F.col("_enough"), F.col(c) if isinstance(c, str) else c)
    away = F.when(F.col("_spread") != 0, (F.col("observation") - F.col("_center")) / F.col("_spread"))
    detection = F.struct(
        F.lit(name).alias("detector"),
        F.col("_enough").alias("evaluated"),
        F.col("_side").isNotNull().alias("anomalous"),
        F.col("observation"),
        able("_lower").alias("lower"),
        able("_upper").alias("upper"),
        able("_center").alias("center"),
        able("_spread").alias("spread"),
        able(away).alias("deviation"),
        F.col("_side").alias("direction"),
        _size(df).alias("history_size"),
        F.create_map(*[F.lit(x) for kv in parameters.items() for x in kv]).alias("parameters"),
        F.coalesce(able(F.col("_spread") == 0), F.lit(False)).alias("degenerate"),
    ).cast(_DETECTION)
    return settled.withColumn(name, detection).drop(
        "_enough", "_low", "_high", "_lower", "_upper", "_side", "_center", "_spread"
    )


def _enough(df: DataFrame, min_history: int) -> Column:
    return _size(df) >= max(min_history, 2)


# A detector adds one detection column to judgements (``history`` or ``summary``, ``observation``). It works in
# steps, because a value used twice inside one expression is computed twice.


def zscore(
    judgements: DataFrame, sigmas: float = DEFAULT_SIGMAS, min_history: int = MIN_HISTORY
) -> DataFrame:
    """Mean +/- ``sigmas`` sample standard deviations of the whole history, bounds included."""
    if "summary" in judgements.columns:
        df = judgements.withColumn("_center", F.col("summary.mean")).withColumn("_spread", F.col("summary.deviation"))
    else:
        df = judgements.withColumn("_center", _mean(F.col("history")))
        df = df.withColumn("_spread", _deviation(F.col("history"), F.col("_center")))
    df = df.withColumn("_low", F.col("_center")).withColumn("_high", F.col("_center"))
    return _with_verdict(df, "zscore", _enough(df, min_history), sigmas, {"sigmas": float(sigmas)})


def iqr(
    judgements: DataFrame, multiplier: float = DEFAULT_IQR_MULTIPLIER,
    min_history: int = MIN_HISTORY,
) -> DataFrame:
    """Tukey's fences around the inclusive quartiles."""
    if "summary" in judgements.columns:
        quartiles = [F.col(f"summary.{q}") for q in ("q1", "median", "q3")]
        df = judgements
    else:
        df = judgements.withColumn("_ordered", F.array_sort("history"))
        quartiles = [_quantile(F.col("_ordered"), p) for p in (0.25, 0.5, 0.75)]
    df = df.withColumns(dict(zip(("_low", "_center", "_high"), quartiles))).drop("_ordered")
    df = df.withColumn("_spread", F.col("_high") - F.col("_low"))
    return _with_verdict(df, "iqr", _enough(df, min_history), multiplier, {"multiplier": float(multiplier)})


def moving_average(
    judgements: DataFrame, window: int = DEFAULT_MOVING_WINDOW, sigmas: float = DEFAULT_SIGMAS,
    min_history: int = MIN_HISTORY,
) -> DataFrame:
    """Mean +/- ``sigmas`` deviations of the last ``window`` points, so it follows a drift."""
    points = "history"
    if "summary" in judgements.columns:
        points = "summary.recent"
        if window > DEFAULT_MOVING_WINDOW:
            raise ValueError(f"a summary keeps the last {DEFAULT_MOVING_WINDOW} points")
    size = F.size(points)
    recent = F.slice(points, F.greatest(size - window + 1, F.lit(1)), window)
    df = judgements.withColumn("_recent", recent)
    df = df.withColumn("_center", _mean(F.col("_recent")))
    df = df.withColumn("_spread", _deviation(F.col("_recent"), F.col("_center"))).drop("_recent")
    df = df.withColumn("_low", F.col("_center")).withColumn("_high", F.col("_center"))
    enough = _enough(df, min_history) & (F.least(size, F.lit(window)) >= 2)
    return _with_verdict(
        df, "moving_average", enough, sigmas, {"window": float(window), "sigmas": float(sigmas)}
    )


#: Detectors by name; register another function (judgements) -> judgements to extend them.
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "zscore": zscore, "iqr": iqr, "moving_average": moving_average
}


def detectors_by_name(names: Sequence[str] | None = None) -> dict[str, Callable[..., DataFrame]]:
    chosen = list(DETECTORS) if names is None else list(names)
    unknown = [n for n in chosen if n not in DETECTORS]
    if unknown:
        raise ValueError(f"unknown detector(s) {unknown}; choose from {sorted(DETECTORS)}")
    return {n: DETECTORS[n] for n in chosen}


def finite(history: Column, observation: Column) -> Column:
    """The observation; an error when it or any history value is NaN or infinite."""
    bad = lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf"))
    wrong = bad(observation) | F.exists(history, bad)
    message = F.lit("history and observation must be finite numbers")
    return F.when(wrong, F.raise_error(message).cast("double")).otherwise(observation)


def passes_vote(fired: Column, evaluated: Column, vote: str) -> Column:
    rule = {
        "any": fired >= 1,
        "all": fired == evaluated,
        "majority": fired * 2 > evaluated,
    }
    if vote not in rule:
        raise ValueError(f"unknown vote {vote!r}; choose from {sorted(rule)}")
    return (evaluated > 0) & rule[vote]


def judge(
    judgements: DataFrame, detectors: Sequence[str] | None = None, vote: str = "majority"
) -> DataFrame:
    """Adds ``detections``, ``fired``, ``evaluated``, ``anomalous`` and ``direction``.

    Expects ``history`` (array of doubles, oldest first) or ``summary``, and ``observation``. The result is written
    once: it is small (a row per column, metric and window), several reports read it, and a filter
    on a verdict would otherwise be pushed down as a copy of every expression behind it.
    """
    chosen = detectors_by_name(detectors)
    # Written first as well: the observations are a union, and each branch would otherwise get and
    # compile its own copy of the detectors.
    judged = cut(judgements)
    if "summary" not in judged.columns:
        judged = judged.withColumn("observation", finite(F.col("history"), F.col("observation")))
    for detector in chosen.values():
        judged = detector(judged)
    judged = judged.withColumn("detections", F.array(*chosen)).drop(*chosen)
    fired = F.size(F.filter("detections", lambda d: d["anomalous"]))
    evaluated = F.size(F.filter("detections", lambda d: d["evaluated"]))
    sides = F.array_distinct(
        F.transform(F.filter("detections", lambda d: d["anomalous"]), lambda d: d["direction"])
    )
    return cut(
        judged.withColumn("fired", fired)
        .withColumn("evaluated", evaluated)
        .withColumn("anomalous", passes_vote(F.col("fired"), F.col("evaluated"), vote))
        .withColumn("_sides", sides)
        .withColumn(
            "direction",
            F.when(F.size("_sides") == 1, F.get("_sides", F.lit(0))).when(F.size("_sides") > 1, "mixed"),
        )
        .drop("_sides")
    )


# ---- category distributions ------------------------------------------------------------------
#
# Shares are doubles; distances are rounded to DIGITS decimals, which brings windows that hold the
# same mix back to exactly 0 apart.

DIGITS = 12
COLUMN = ("table", "column")


def shares(categories: DataFrame) -> DataFrame:
    """Adds ``share``: the value's count over its window's total."""
    window = Window.partitionBy(*COLUMN, "window_start")
    return categories.withColumn("share", F.col("count") / F.sum("count").over(window))


def mean_shares(categories: DataFrame) -> DataFrame:
    """(table, column, value, mean_share, windows): each window weighs the same."""
    per_value = shares(categories).groupBy(*COLUMN, "value").agg(F.sum("share").alias("_s"))
    counts = categories.groupBy(*COLUMN).agg(F.countDistinct("window_start").alias("windows"))
    return per_value.join(counts, [*COLUMN]).select(
        *COLUMN, "value", (F.col("_s") / F.col("windows")).alias("mean_share"), "windows"
    )


def total_variation(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half the L1 distance between two share tables (keys, value, share): 0 same, 1 disjoint."""
    both = left.select(*keys, "value", F.col("share").alias("p"), F.lit(0.0).alias("q")).unionByName(
        right.select(*keys, "value", F.lit(0.0).alias("p"), F.col("share").alias("q"))
    )
    per_value = both.groupBy(*keys, "value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return per_value.groupBy(*keys).agg(
        F.round(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), DIGITS).alias("distance")
    )


def leave_one_out(categories: DataFrame) -> DataFrame:
    """(table, column, window_start, distance): each window against the mean of all the others.

    Only values a window holds need a row: the values it lacks add up to what remains of the
    others' mean, whose shares sum to 1.
    """
    by_value = Window.partitionBy(*COLUMN, "value")
    counts = categories.groupBy(*COLUMN).agg(F.countDistinct("window_start").alias("m"))
    with_sum = shares(categories).withColumn("s", F.sum("share").over(by_value))
    joined = with_sum.join(counts.where("m >= 2"), [*COLUMN])
    others = (F.col("s") - F.col("share")) / (F.col("m") - 1)
    return joined.groupBy(*COLUMN, "window_start").agg(
        F.abs(F.round(0.5 * (1 + F.sum(F.abs(F.col("share") - others) - others)), DIGITS)).alias("distance")
    )


def distance_from_mean(categories: DataFrame, baseline: DataFrame) -> DataFrame:
    """(table, column, window_start, distance): each window against the baseline's mean shares."""
    mean = mean_shares(baseline).select(*COLUMN, "value", "mean_share")
    joined = shares(categories).join(mean, [*COLUMN, "value"], "left")
    q = F.coalesce("mean_share", F.lit(0.0))
    return joined.groupBy(*COLUMN, "window_start").agg(
        F.abs(F.round(0.5 * (1 + F.sum(F.abs(F.col("share") - q) - q)), DIGITS)).alias("distance")
    )


def explain(baseline: DataFrame, current: DataFrame, top: int = EXPLAIN_TOP) -> DataFrame:
    """(table, column, explanation): the categories that moved most, ties by name."""
    before = mean_shares(baseline).select(
        *COLUMN, "value", F.col("mean_share").alias("b"), F.lit(0.0).alias("c")
    )
    now = shares(current).select(*COLUMN, "value", F.lit(0.0).alias("b"), F.col("share").alias("c"))
    moved = before.unionByName(now).groupBy(*COLUMN, "value").agg(
        F.sum("b").alias("baseline_share"), F.sum("c").alias("current_share")
    )
    size = F.round(F.abs(F.col("current_share") - F.col("baseline_share")), DIGITS)
    ranked = moved.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*COLUMN).orderBy(size.desc(), "value"))
    ).where(F.col("rank") <= top)
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "baseline_share", "current_share")))
    return ranked.groupBy(*COLUMN).agg(listed.alias("explanation"))


# ---- judging one window ------------------------------------------------------------------------


def _rate_history(columns: DataFrame, metric: str) -> DataFrame:
    """Ordered non-null values of a rate per column."""
    points = F.collect_list(F.when(F.col(metric).isNotNull(), F.struct("window_start", metric)))
    return columns.groupBy(*COLUMN).agg(
        F.transform(F.array_sort(points), lambda x: x[metric]).alias("history")
    )


def observations(
    baseline: DataFrame,
    baseline_categories: DataFrame,
    current: DataFrame,
    current_categories: DataFrame,
    window_start=None,
    history_before_window: bool = False,
) -> DataFrame:
    """(table, column, metric, window_start, observation, history) for one window of ``current``.

    The null rate is judged for every column; a column whose baseline ever carried a distribution
    is judged on its shift, any other on its duplicate rate. The default window is the latest.
    """
    start = current.agg(F.max("window_start")).scalar() if window_start is None else clock(window_start)
    now = current.where(F.col("window_start") == start)
    now_categories = current_categories.where(F.col("window_start") == start)
    if history_before_window:
        baseline = baseline.where(F.col("window_start") < start)
        baseline_categories = baseline_categories.where(F.col("window_start") < start)

    known = baseline.groupBy(*COLUMN).agg(F.lit(True).alias("_known"))
    distributions = baseline_categories.groupBy(*COLUMN).agg(
        F.countDistinct("window_start").alias("_distributions")
    )
    now = (
        now.select(*COLUMN, "window_start", "null_rate", "duplicate_rate")
        .join(known, [*COLUMN])
        .join(distributions, [*COLUMN], "left")
    )
    parts = []
    for metric in ("null_rate", "duplicate_rate"):
        judged = now.where(F.col(metric).isNotNull())
        if metric == "duplicate_rate":
            judged = judged.where(F.col("_distributions").isNull())
        parts.append(
            judged.join(_rate_history(baseline, metric), [*COLUMN]).select(
                *COLUMN, F.lit(metric).alias("metric"), "window_start",
                F.col(metric).alias("observation"), "history",
            )
        )
    distances = leave_one_out(baseline_categories).groupBy(*COLUMN).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("window_start", "distance"))), lambda x: x["distance"]
        ).alias("history")
    )
    shift = distance_from_mean(now_categories, baseline_categories)
    parts.append(
        now.select(*COLUMN, "window_start").join(distances, [*COLUMN])
        .join(shift, [*COLUMN, "window_start"])
        .select(
            *COLUMN, F.lit("distribution_shift").alias("metric"), "window_start",
            F.col("distance").alias("observation"), "history",
        )
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def detect(
    baseline: DataFrame,
    baseline_categories: DataFrame,
    current: DataFrame,
    current_categories: DataFrame,
    window_start=None,
    history_before_window: bool = False,
    detectors: Sequence[str] | None = None,
    vote: str = "majority",
) -> DataFrame:
    """One judged row per (table, column, metric) of one window."""
    return judge(
        observations(
            baseline, baseline_categories, current, current_categories, window_start,
            history_before_window,
        ),
        detectors,
        vote,
    )


def report(analyses: DataFrame) -> DataFrame:
    """Counts of what was analysed, could be evaluated, and was flagged, per metric and direction."""
    return analyses.groupBy("metric").agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.count_if(F.col("evaluated") > 0).alias("evaluated"),
        F.count_if(F.col("anomalous")).alias("anomalous"),
        F.count_if(F.col("anomalous") & (F.col("direction") == "above")).alias("above"),
        F.count_if(F.col("anomalous") & (F.col("direction") == "below")).alias("below"),
        F.count_if(F.col("anomalous") & (F.col("direction") == "mixed")).alias("mixed"),
    )


# ---- findings ----------------------------------------------------------------------------------


def anomaly_findings(analyses: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """One finding per analysis the vote flags as an increase, in the order file, rule, fingerprint."""
    flagged = analyses.where(F.col("anomalous") & (F.col("direction") == "above"))
    if explanations is not None:
        flagged = flagged.join(explanations, [*COLUMN], "left")
    else:
        flagged = flagged.withColumn("explanation", F.lit(None))
    rule = F.create_map(*[F.lit(x) for kv in RULE_FOR_METRIC.items() for x in kv])[F.col("metric")]
    meaning = (
        F.when(F.col("metric") == "null_rate", "NULLs per row of the window")
        .when(F.col("metric") == "duplicate_rate", "values seen before in the window, per value that is not NULL")
        .otherwise("half the summed differences of value shares between this window and an average earlier one")
    )
    headline = (
        F.when(F.col("metric") == "null_rate", "%.1f%% NULL, more than usual")
        .when(F.col("metric") == "duplicate_rate", "%.1f%% repeated values, more than usual")
        .otherwise("values spread differently, by %.1f%%")
    )
    percent = F.format_string("%.1f%%", F.col("observation") * 100)
    name = F.concat_ws(".", "table", "column")
    file = F.concat(F.lit("table:"), F.col("table"))
    where = [
        F.col("table"), F.col("column"), F.col("metric"),
        F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss").alias("windowStart"),
    ]

    def sentence(d: Column) -> Column:
        verdict = F.when(d["anomalous"], d["direction"]).otherwise("inside")
        return F.format_string(
            "%s learned %.3f to %.3f from %d windows (middle %.3f, width %.3f); %.3f is %s",
            d["detector"], d["lower"], d["upper"], d["history_size"], d["center"], d["spread"],
            d["observation"], verdict,
        )

    def item(description: Column, data: Column) -> Column:
        return F.struct(
            F.lit("DATA_QUALITY").alias("source"), description.alias("description"),
            F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
            data.alias("data"),
        )

    able = F.filter("detections", lambda d: d["evaluated"])
    from_detectors = F.transform(
        able,
        lambda d: item(
            sentence(d),
            F.to_json(
                F.struct(
                    *where, d["detector"].alias("detector"), d["anomalous"].alias("anomalous"),
                    d["observation"].alias("observation"), d["lower"].alias("expectedLower"),
                    d["upper"].alias("expectedUpper"), d["center"].alias("center"),
                    d["spread"].alias("spread"), d["deviation"].alias("deviation"),
                    d["direction"].alias("direction"), d["history_size"].alias("historySize"),
                    d["parameters"].alias("parameters"), d["degenerate"].alias("degenerate"),
                ),
            ),
        ),
    )
    if explanations is not None:
        categories = F.transform(
            "explanation",
            lambda x: F.struct(
                x["value"].alias("value"), x["baseline_share"].alias("baselineShare"),
                x["current_share"].alias("currentShare"),
            ),
        )
        moved = F.array(
            item(
                F.lit("shares before and now of the values that changed most"),
                F.to_json(F.struct(*where, categories.alias("categories"))),
            )
        )
        told = (F.col("metric") == "distribution_shift") & F.col("explanation").isNotNull()
        evidence = F.when(told, F.concat(from_detectors, moved)).otherwise(from_detectors)
    else:
        evidence = from_detectors
    return flagged.select(
        F.lit(1).alias("schema_version"),
        rule.alias("rule_id"),
        F.lit("MEDIUM").alias("severity"),
        F.when(F.col("fired") == F.col("evaluated"), "HIGH")
        .when(F.col("fired") * 2 > F.col("evaluated"), "MEDIUM").otherwise("LOW").alias("confidence"),
        file.alias("file"),
        F.lit(0).alias("line"),
        F.lit(None).cast("int").alias("end_line"),
        F.concat(name, F.lit(": "), F.replace(headline, F.lit("%.1f%%"), percent)).alias("title"),
        F.concat(
            F.format_string(
                "Window of %s: %s, %.3f. Out of the ordinary by %d votes of %d:\n\n",
                F.date_format("window_start", "yyyy-MM-dd"), meaning, F.col("observation"),
                F.col("fired"), F.col("evaluated"),
            ),
            F.array_join(F.transform(able, lambda d: F.concat(F.lit("- "), sentence(d))), "\n"),
        ).alias("body"),
        evidence.alias("evidence"),
        F.format_string(
            "Look at the values themselves:\n```sql\nSELECT \"%2$s\", count(*) AS n FROM \"%1$s\"\n"
            "GROUP BY \"%2$s\" ORDER BY n DESC;\n```",
            F.col("table"), F.col("column"),
        ).alias("suggested_fix"),
        digest([rule, file, F.col("column"), F.col("metric")]).alias("fingerprint"),
    ).orderBy("file", "rule_id", "fingerprint")


# ---- walk-forward backtest -----------------------------------------------------------------------


def _walk_forward(min_history: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per column: for each judged window, the leave-one-out distances of the earlier windows and
    the window's own distance from their mean. Rows with ``wanted`` false are history only.

    A group is one column's stored history: its windows times at most max_categories values.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = {"table": [], "column": [], "window_index": [], "observation": [], "history": []}
        rows = group[group["value"].notna()].sort_values(["window_index", "value"])
        index = rows["window_index"].to_numpy()
        code, _ = pd.factorize(rows["value"])
        count = rows["count"].to_numpy(dtype=float)
        totals = pd.Series(count).groupby(index).transform("sum").to_numpy()
        share = count / totals if len(count) else count
        values = int(code.max()) + 1 if len(code) else 0
        wanted = rows["wanted"].to_numpy(dtype=bool)
        for i in np.unique(index[(index >= min_history) & wanted]) if len(index) else []:
            earlier = index < i
            windows, slot = np.unique(index[earlier], return_inverse=True)
            m = len(windows)
            if m < 2:
                continue
            total = np.bincount(code[earlier], weights=share[earlier], minlength=values)
            others = (total[code[earlier]] - share[earlier]) / (m - 1)
            away = np.bincount(slot, weights=np.abs(share[earlier] - others) - others, minlength=m)
            mine = index == i
            mean = total[code[mine]] / m
            own = 0.5 * (1 + float(np.sum(np.abs(share[mine] - mean) - mean)))
            out["table"].append(group["table"].iloc[0])
            out["column"].append(group["column"].iloc[0])
            out["window_index"].append(int(i))
            out["observation"].append(abs(round(own, DIGITS)))
            out["history"].append([abs(round(float(d), DIGITS)) for d in 0.5 * (1 + away)])
        return pd.DataFrame(out, dtype=object)  # an empty list column must not become a number column

    return run


def walk_forward_observations(
    columns: DataFrame, categories: DataFrame, min_history: int = MIN_HISTORY, since=None
) -> DataFrame:
    """Each window from ``min_history`` on, judged on the windows before it only.

    The metric and the leave-one-out distances are re-derived for every prefix. With ``since``, windows
    that start before it are history only.
    """
    wanted = lambda start: F.lit(True) if since is None else F.col(start) >= clock(since)
    carried = categories.groupBy(*COLUMN, "window_start").agg(F.lit(True).alias("has"))
    point = F.struct("window_start", "null_rate", "duplicate_rate", F.coalesce("has", F.lit(False)).alias("has"))
    series = (
        columns.select(*COLUMN, "window_start", "null_rate", "duplicate_rate")
        .join(carried, [*COLUMN, "window_start"], "left")
        .groupBy(*COLUMN)
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
    )
    stepped = (
        series.where(F.size("points") > min_history)
        .withColumn("i", F.explode(F.sequence(F.lit(min_history), F.size("points") - 1)))
        .withColumn("point", F.get("points", F.col("i")))
        .where(wanted("point.window_start"))
        .withColumn("earlier", F.slice("points", F.lit(1), F.col("i")))
        .withColumn("categorical", F.exists("earlier", lambda p: p["has"]))
    )

    def rate(metric: str, rows: DataFrame) -> DataFrame:
        known = F.filter("earlier", lambda p: p[metric].isNotNull())
        return rows.where(F.col(f"point.{metric}").isNotNull()).select(
            *COLUMN, F.lit(metric).alias("metric"), F.col("point.window_start").alias("window_start"),
            F.col(f"point.{metric}").alias("observation"),
            F.transform(known, lambda p: p[metric]).alias("history"),
        )

    indexed = series.select(
        *COLUMN, F.posexplode(F.transform("points", lambda p: p["window_start"])).alias("window_index", "window_start")
    )
    shifts = (
        categories.join(indexed, [*COLUMN, "window_start"])
        .select(*COLUMN, "window_index", "value", "count", wanted("window_start").alias("wanted"))
        .groupBy(*COLUMN)
        .applyInPandas(
            _walk_forward(min_history),
            "table string, column string, window_index int, observation double, history array<double>",
        )
        .join(indexed, [*COLUMN, "window_index"])
        .select(*COLUMN, F.lit("distribution_shift").alias("metric"), "window_start", "observation", "history")
    )
    return (
        rate("null_rate", stepped)
        .unionByName(rate("duplicate_rate", stepped.where(~F.col("categorical"))))
        .unionByName(shifts)
    )


_SUMMARY = {"size": "int", "mean": "double", "deviation": "double", "q1": "double", "median": "double", "q3": "double", "recent": "array<double>"}


def _summary(ordered: Sequence[float], mean: float, deviation: float, recent: Sequence[float]) -> tuple:
    """The fields of _SUMMARY; equal points have exactly their value as mean and no deviation."""
    size = len(ordered)
    if size == 0:
        return (0, None, None, None, None, None, [])
    if ordered[0] == ordered[-1]:
        mean, deviation = ordered[0], 0.0

    def at(p: float) -> float:
        low = math.floor((size - 1) * p)
        return float(ordered[low] + (ordered[min(low + 1, size - 1)] - ordered[low]) * ((size - 1) * p - low))

    return (size, float(mean), float(deviation), at(0.25), at(0.5), at(0.75), [float(x) for x in recent])


class _Running:
    """The points of a series so far: a point is added in place, nothing is read again."""

    def __init__(self) -> None:
        self.ordered: list[float] = []
        self.recent: deque[float] = deque(maxlen=DEFAULT_MOVING_WINDOW)
        self.total = self.mean = self.squares = 0.0

    def add(self, x: float) -> None:
        insort(self.ordered, x)
        self.recent.append(x)
        self.total += x
        before, self.mean = self.mean, self.mean + (x - self.mean) / len(self.ordered)
        self.squares += (x - before) * (x - self.mean)

    def summary(self) -> tuple:
        size = len(self.ordered)
        deviation = math.sqrt(self.squares / (size - 1)) if size > 1 else 0.0
        return _summary(self.ordered, self.total / size if size else 0.0, deviation, self.recent)


def _running_rates(points: pd.DataFrame, carried: set[int], min_history: int) -> list[tuple]:
    """(window_start, metric, observation, summary fields) of the rates of one column's ordered windows."""
    out = []
    first = min(carried, default=len(points))
    for metric in ("null_rate", "duplicate_rate"):
        running = _Running()
        known, wanted, starts = points[f"{metric}_known"], points["wanted"], points["window_start"]
        for i, x in enumerate(points[metric].astype(float)):
            if not known[i]:
                continue
            if not math.isfinite(x):
                raise ValueError("history and observation must be finite numbers")
            if i >= min_history and wanted[i] and (metric == "null_rate" or i <= first):
                out.append((starts[i], metric, x, *running.summary()))
            running.add(x)
    return out


def _running_shifts(points: pd.DataFrame, mixes: pd.DataFrame, min_history: int) -> list[tuple]:
    """The same of the distances between distributions. The value shares of the windows so far are summed up as the
    windows go by; each window's distance from the mean of the others depends on all of them and is taken again."""
    index, count = mixes["window_index"].to_numpy(), mixes["count"].to_numpy(dtype=float)
    code, _ = pd.factorize(mixes["value"])
    windows, begin = np.unique(index, return_index=True)
    ends = [*begin[1:], len(index)]
    share = np.concatenate([count[a:b] / count[a:b].sum() for a, b in zip(begin, ends)])
    total = np.zeros(int(code.max()) + 1)
    out = []
    for m, (i, a, b) in enumerate(zip(windows, begin, ends)):
        if m >= 2 and i >= min_history and points["wanted"][i]:
            others = (total[code[:a]] - share[:a]) / (m - 1)
            away = np.abs(np.round(0.5 * (1 + np.add.reduceat(np.abs(share[:a] - others) - others, begin[:m])), DIGITS))
            mean = total[code[a:b]] / m
            own = abs(float(np.round(0.5 * (1 + np.sum(np.abs(share[a:b] - mean) - mean)), DIGITS)))
            found = _summary(np.sort(away), away.mean(), away.std(ddof=1), away[-DEFAULT_MOVING_WINDOW:])
            out.append((points["window_start"][i], "distribution_shift", own, *found))
        np.add.at(total, code[a:b], share[a:b])
    return out


def running_observations(
    columns: DataFrame, categories: DataFrame, min_history: int = MIN_HISTORY, since=None
) -> DataFrame:
    """``walk_forward_observations`` with a ``summary`` in place of each window's list of earlier points.

    A group is one column: its windows and their listed categories, both bounded by the windows asked for.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        points = group[group["count"].isna()].sort_values("window_start", ignore_index=True)
        if len(points):
            place = pd.Series(points.index, index=points["window_start"])
            mixes = group[group["value"].notna()]
            mixes = mixes.assign(window_index=mixes["window_start"].map(place)).dropna(subset=["window_index"])
            mixes = mixes.astype({"window_index": int}).sort_values(["window_index", "value"])
            rows = _running_rates(points, set(mixes["window_index"]), min_history)
            if len(mixes):
                rows += _running_shifts(points, mixes, min_history)
        keys = points.iloc[0][list(COLUMN)].to_list() if rows else []
        return pd.DataFrame([(*keys, *r) for r in rows], columns=names, dtype=object)

    names = [*COLUMN, "window_start", "metric", "observation", *_SUMMARY]
    kind = columns.schema["window_start"].dataType.simpleString()
    fields = ", ".join(f"{k} {v}" for k, v in _SUMMARY.items())
    rates = ("null_rate", "duplicate_rate")
    points = columns.select(
        *COLUMN, "window_start", *[F.col(c).cast("double").alias(c) for c in rates],
        *[F.col(c).isNotNull().alias(f"{c}_known") for c in rates],
        (F.lit(True) if since is None else F.col("window_start") >= clock(since)).alias("wanted"),
    )
    mixes = categories.select(*COLUMN, "window_start", F.col("value").cast("string").alias("value"), F.col("count").cast("double").alias("count"))
    walked = points.unionByName(mixes, allowMissingColumns=True).groupBy(*COLUMN).applyInPandas(
        run, f"table string, column string, window_start {kind}, metric string, observation double, {fields}"
    )
    return walked.select(*COLUMN, "metric", "window_start", "observation", F.struct(*_SUMMARY).alias("summary"))


def backtest(
    columns: DataFrame,
    categories: DataFrame,
    detectors: Sequence[str] | None = None,
    vote: str = "majority",
    min_history: int = MIN_HISTORY,
    since=None,
) -> DataFrame:
    """Walk-forward judgements; over clean history every alarm is a false alarm.

    A registered detector that reads the points themselves is judged with
    ``judge(walk_forward_observations(...))``.
    """
    return judge(running_observations(columns, categories, min_history, since), detectors, vote)


def backtest_summary(judged: DataFrame) -> DataFrame:
    """(kind, name, evaluations, alarms, alarms_above) per detector, per metric and for the vote."""
    single = judged.select(F.explode("detections").alias("d")).where("d.evaluated").groupBy(
        F.lit("detector").alias("kind"), F.col("d.detector").alias("name")
    ).agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_if("d.anomalous").alias("alarms"),
        F.count_if(F.col("d.anomalous") & (F.col("d.direction") == "above")).alias("alarms_above"),
    )
    voted = (
        judged.where("evaluated > 0")
        .groupingSets([["metric"], []], "metric")
        .agg(
            F.grouping("metric").alias("_all"),
            F.count(F.lit(1)).alias("evaluations"),
            F.count_if("anomalous").alias("alarms"),
            F.count_if(F.col("anomalous") & (F.col("direction") == "above")).alias("alarms_above"),
        )
        .select(
            F.when(F.col("_all") == 1, "vote").otherwise("metric").alias("kind"),
            F.when(F.col("_all") == 1, "all").otherwise(F.col("metric")).alias("name"),
            "evaluations", "alarms", "alarms_above",
        )
    )
    return single.unionByName(voted)


def false_alarms(judged: DataFrame) -> DataFrame:
    return judged.where("anomalous").select(
        *COLUMN, "metric", "window_start", "direction", "observation", "fired", "evaluated"
    )


def data_quality_view(analyses: DataFrame, profile: DataFrame) -> DataFrame:
    """Per judged column: its current profile and every metric with the detectors' ranges."""
    short = F.transform(
        "detections",
        lambda d: F.struct(
            d["detector"].alias("detector"), d["evaluated"].alias("evaluated"),
            d["anomalous"].alias("anomalous"), d["lower"].alias("lower"), d["upper"].alias("upper"),
            d["center"].alias("center"),
        ),
    )
    metrics = analyses.groupBy(*COLUMN).agg(
        F.array_sort(
            F.collect_list(
                F.struct("metric", "observation", "anomalous", "direction", "fired", "evaluated", short.alias("detections"))
            )
        ).alias("metrics")
    )
    current = profile.select(
        *COLUMN, F.col("row_count").alias("rows"), "null_rate", "duplicate_rate",
        F.col("distinct_count").alias("distinct"),
    )
    return metrics.join(current, [*COLUMN], "left").orderBy(*COLUMN)


def flagged_columns(view: DataFrame) -> DataFrame:
    """Columns profiled, columns flagged and tables in a data-quality view."""
    flagged = F.exists("metrics", lambda m: m["anomalous"])
    return view.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(flagged).alias("flagged"),
        F.countDistinct("table").alias("tables"),
    )
