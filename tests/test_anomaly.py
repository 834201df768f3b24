from __future__ import annotations

import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators import anomaly

BASE = [10.0, 12.0, 11.0, 13.0, 9.0]


def judged(spark, cases, names=None, vote="majority"):
    """Detections by name for each (history, observation)."""
    rows = [(i, [float(x) for x in h], float(o)) for i, (h, o) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, history array<double>, observation double")
    result = sorted(anomaly.judge(df, names, vote).collect(), key=lambda r: r["i"])
    return [({d["detector"]: d for d in r["detections"]}, r) for r in result]


def test_hand_computed_ranges(spark):
    cases = [(BASE, 15), (BASE, 20), (BASE, 15.7), (BASE, 6.3), (BASE, 6.2), (BASE, 15.5), (BASE, 6.9), (BASE[:4], 1000)]
    results = [d for d, _ in judged(spark, cases)]
    z = results[0]["zscore"]
    assert z["center"] == 11 and z["spread"] == pytest.approx(math.sqrt(2.5)) and not z["anomalous"]
    iqr = results[0]["iqr"]
    assert (iqr["lower"], iqr["upper"], iqr["anomalous"]) == (7, 15, False)
    assert [r["zscore"]["direction"] for r in results[1:5]] == ["above", None, None, "below"]
    assert [r["iqr"]["direction"] for r in results[5:7]] == ["above", "below"]
    assert not any(d["evaluated"] or d["anomalous"] for d in results[7].values())


def test_moving_average_looks_at_the_last_points(spark):
    rows = [(i, h, float(o)) for i, (h, o) in enumerate([(BASE, 17), (BASE, 17.5), ([float(x) for x in range(1, 11)], 10.5), ([float(x) for x in range(1, 11)], 14)])]
    df = spark.createDataFrame(rows, "i int, history array<double>, observation double")
    out = {r["i"]: r["moving_average"] for r in anomaly.moving_average(df, window=3).collect()}
    assert (out[0]["center"], out[0]["spread"], out[0]["lower"], out[0]["upper"]) == (11, 2, 5, 17)
    assert [out[i]["anomalous"] for i in range(4)] == [False, True, False, True]


def test_constant_history_collapses_exactly(spark):
    (zeros, _), (moved, _), (tenths, _) = judged(spark, [([0] * 6, 0.0), ([0] * 6, 0.01), ([0.1] * 7, 0.1)])
    assert all(d["degenerate"] and not d["anomalous"] for d in zeros.values())
    assert all(d["direction"] == "above" and d["deviation"] is None for d in moved.values())
    assert all(d["spread"] == 0 and not d["anomalous"] for d in tenths.values())


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_numbers_are_errors(spark, bad):
    for case in [(BASE, bad), ([*BASE, bad], 1.0)]:
        with pytest.raises(Exception, match="finite"):
            judged(spark, [case])


def test_votes_and_unknown_names(spark):
    case = [(BASE, 15.5)]  # only the quartile fences flag it
    assert [judged(spark, case, vote=v)[0][1]["anomalous"] for v in ("any", "majority", "all")] == [True, False, False]
    assert not judged(spark, [(BASE[:4], 1000)], vote="all")[0][1]["anomalous"]
    with pytest.raises(ValueError):
        anomaly.detectors_by_name(["nope"])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_verdicts_do_not_change_under_scaling(spark, seed):
    rng = random.Random(seed)
    plain, scaled = [], []
    for _ in range(40):
        history = [rng.randint(0, 50) for _ in range(rng.randint(5, 12))]
        observation = rng.randint(-30, 80)
        plain.append((history, observation))
        scaled.append(([4 * x + 16 for x in history], 4 * observation + 16))
    directions = lambda cases: [{n: d["direction"] for n, d in r.items()} for r, _ in judged(spark, cases)]
    assert directions(plain) == directions(scaled)


def exact_shares(counts):
    total = sum(counts.values())
    return {k: Fraction(n, total) for k, n in counts.items()}


def exact_distance(p, q):
    return float(sum(abs(p.get(k, 0) - q.get(k, 0)) for k in p.keys() | q.keys()) / 2)


def exact_mean(windows):
    total = {}
    for w in windows:
        for k, s in exact_shares(w).items():
            total[k] = total.get(k, 0) + s / len(windows)
    return total


def random_windows(seed, n):
    rng = random.Random(seed)
    return [{f"v{k}": rng.randint(1, 40) for k in rng.sample(range(7), rng.randint(1, 6))} for _ in range(n)]


def frame(spark, windows, start=datetime(2026, 1, 1)):
    rows = [("t", "c", start + timedelta(days=i), v, n) for i, w in enumerate(windows) if w for v, n in w.items()]
    return spark.createDataFrame(rows, "table string, column string, window_start timestamp_ntz, value string, count bigint")


def profiles(spark, windows, start=datetime(2026, 1, 1)):
    rows = [("t", "c", start + timedelta(days=i), 0.0, 0.5) for i in range(len(windows))]
    return spark.createDataFrame(rows, "table string, column string, window_start timestamp_ntz, null_rate double, duplicate_rate double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leave_one_out_equals_exact_rationals(spark, seed):
    windows = random_windows(seed, 8)
    got = {r["window_start"].day - 1: r["distance"] for r in anomaly.leave_one_out(frame(spark, windows)).collect()}
    for i, w in enumerate(windows):
        others = [o for j, o in enumerate(windows) if j != i]
        assert got[i] == pytest.approx(exact_distance(exact_shares(w), exact_mean(others)), abs=1e-11)


def test_identical_mixes_are_exactly_zero_apart(spark):
    windows = [{"a": 1 * k, "b": 2 * k, "c": 7 * k} for k in (1, 3, 7, 11, 13, 17)]
    assert {r["distance"] for r in anomaly.leave_one_out(frame(spark, windows)).collect()} == {0.0}


def test_a_brand_new_category_counts(spark):
    distance = anomaly.distance_from_mean(frame(spark, [{"new": 5}]), frame(spark, [{"a": 1}, {"a": 3}]))
    assert [r["distance"] for r in distance.collect()] == [1.0]


def test_walk_forward_equals_exact_rationals(spark):
    windows = random_windows(9, 9)
    windows[3] = None  # a window without a distribution
    observed = anomaly.walk_forward_observations(profiles(spark, windows), frame(spark, windows))
    got = {r["window_start"].day - 1: r for r in observed.where("metric = 'distribution_shift'").collect()}
    assert set(got) == {5, 6, 7, 8}
    for i, row in got.items():
        earlier = [w for w in windows[:i] if w]
        assert row["observation"] == pytest.approx(exact_distance(exact_shares(windows[i]), exact_mean(earlier)), abs=1e-11)
        for j, w in enumerate(earlier):
            others = [o for k, o in enumerate(earlier) if k != j]
            assert row["history"][j] == pytest.approx(exact_distance(exact_shares(w), exact_mean(others)), abs=1e-11)


def test_walk_forward_without_enough_history_is_empty(spark):
    windows = [{"a": 1, "b": 2}] + [None] * 5 + [{"a": 2}]
    observed = anomaly.walk_forward_observations(profiles(spark, windows), frame(spark, windows))
    assert observed.where("metric = 'distribution_shift'").collect() == []


def test_explanation_breaks_ties_by_name(spark):
    explained = anomaly.explain(frame(spark, [{"x": 1, "a": 1}]), frame(spark, [{"x": 3, "a": 1}])).collect()[0]["explanation"]
    assert [(e["value"], e["baseline_share"], e["current_share"]) for e in explained] == [("a", 0.5, 0.25), ("x", 0.5, 0.75)]


def test_history_before_the_window_only(spark):
    windows = [{"a": 10, "b": 10}] * 6 + [{"a": 19, "b": 1}]
    columns, categories = profiles(spark, windows), frame(spark, windows)
    rows = anomaly.detect(columns, categories, columns, categories, history_before_window=True).collect()
    shift = next(r for r in rows if r["metric"] == "distribution_shift")
    assert shift["anomalous"] and shift["direction"] == "above" and shift["detections"][0]["history_size"] == 6


def _judgements(rows):
    found = {}
    for r in rows:
        for d in r["detections"]:
            numbers = tuple(None if d[c] is None else pytest.approx(d[c], abs=1e-9) for c in ("lower", "upper", "center", "spread"))
            found[(r["column"], r["metric"], r["window_start"], d["detector"])] = (r["anomalous"], d["anomalous"], d["history_size"], numbers)
    return found


def test_running_summaries_judge_like_whole_histories(spark):
    rng = random.Random(5)
    windows = [{v: rng.randint(0, 9) for v in "abcd"[: rng.randint(2, 4)]} for _ in range(25)]
    windows = [w if any(w.values()) else {"a": 1} for w in windows]
    columns, categories = profiles(spark, windows), frame(spark, windows).where("count > 0")
    whole = anomaly.judge(anomaly.walk_forward_observations(columns, categories)).collect()
    running = anomaly.backtest(columns, categories).collect()
    assert len(running) == len(whole) > 20 and _judgements(running) == _judgements(whole)


def test_a_thousand_windows(spark):
    from pyspark.sql import functions as F

    days = spark.range(1000).select(
        F.lit("t").alias("table"), F.lit("c").alias("column"), F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(id)").alias("window_start"), "id"
    )
    rate = F.when(F.col("id") == 900, 0.5).otherwise((F.col("id") * 7 % 11) / 1000)
    columns = days.withColumn("null_rate", rate).withColumn("duplicate_rate", F.lit(0.25))
    categories = days.limit(0).select("table", "column", "window_start", F.lit("x").alias("value"), F.lit(1).alias("count"))
    observed = anomaly.running_observations(columns.drop("id"), categories)
    assert observed.columns == ["table", "column", "metric", "window_start", "observation", "summary"]
    judged = anomaly.judge(observed)
    assert judged.count() == 2 * 995
    alarm, = judged.where("anomalous").collect()
    assert (alarm["metric"], alarm["window_start"], alarm["fired"]) == ("null_rate", datetime(2022, 6, 19), 3)
    numbers = judged.where("metric = 'null_rate'").orderBy("window_start").tail(1)[0]["detections"]
    values = sorted(0.5 if i == 900 else i * 7 % 11 / 1000 for i in range(999))
    center = math.fsum(values) / 999
    assert numbers[0]["center"] == pytest.approx(center)
    assert numbers[0]["spread"] == pytest.approx(math.sqrt(math.fsum((x - center) ** 2 for x in values) / 998))
    assert numbers[1]["center"] == pytest.approx(values[499])
