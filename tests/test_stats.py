from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import tails
from plumbline.functions.exprs import wilson
from plumbline.functions.ranking import exact_percentiles, first_by_hash, hash_order, positions, running_totals
from plumbline.operators import stats
from pyspark.sql import functions as F


def test_binomial_tails():
    assert tails.binomial_two_sided(0, 0) == 1 and tails.binomial_two_sided(3, 6) == 1
    assert tails.binomial_two_sided(1, 10) == pytest.approx(0.021484375)
    assert tails.binomial_two_sided(9, 10) == pytest.approx(0.021484375)
    assert tails.binomial_two_sided(0, 6) == pytest.approx(0.03125)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60).flatmap(lambda n: st.tuples(st.integers(0, n), st.just(n))))
def test_binomial_equals_the_sum(pair):
    k, n = pair
    low = min(k, n - k)
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
    assert tails.binomial_two_sided(k, n) == pytest.approx(1.0 if 2 * low == n else exact, rel=1e-10)


def test_fisher_textbook():
    assert tails.hypergeometric_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503495)
    assert tails.hypergeometric_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857142857)
    assert tails.hypergeometric_two_sided(0, 5, 0, 7) == 1


def test_signed_rank_exact_equals_enumeration():
    n = 8
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in (0, 3, 10, 18):
        exact = min(1.0, 2 * sum(x <= w for x in sums) / len(sums))
        assert tails.signed_rank_two_sided(w, n, 0) == pytest.approx(exact)
    assert tails.signed_rank_two_sided(100, 60, 0) == pytest.approx(math.erfc(abs((100 - 915) / math.sqrt(18452.5)) / math.sqrt(2)))


@pytest.mark.parametrize("df, value", [(1, 12.706204736), (2, 4.3026527297), (9, 2.2621571628), (19, 2.0930240544), (100, 1.9839715185)])
def test_t_quantiles(df, value):
    assert tails.t_quantile(0.975, df) == pytest.approx(value, rel=1e-8)


def test_mean_ci(spark):
    rows = [("a", float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)] + [("b", 0.1)] * 7 + [("c", 3.0)]
    got = {r["k"]: r for r in stats.mean_ci(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    half = 2.364624251592785 * math.sqrt(32 / 7) / math.sqrt(8)
    assert got["a"]["low"] == pytest.approx(5 - half, rel=1e-9) and got["a"]["high"] == pytest.approx(5 + half, rel=1e-9)
    assert (got["b"]["mean"], got["b"]["low"], got["b"]["high"], got["b"]["n_distinct"]) == (0.1, 0.1, 0.1, 1)
    assert got["c"]["low"] == got["c"]["high"] == 3.0


def test_wilson(spark):
    low, high = wilson("s", "n")
    rows = spark.createDataFrame([(0, 0), (0, 10), (8, 10), (10, 10)], "s int, n int").select("s", "n", low.alias("l"), high.alias("h")).collect()
    assert rows[0]["l"] is None and rows[1]["l"] == 0 and rows[3]["h"] == pytest.approx(1)
    assert (rows[2]["l"], rows[2]["h"]) == (pytest.approx(0.4901624715), pytest.approx(0.9433178285))


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "k string, p double")
    got = {r["k"]: r["p_holm"] for r in stats.holm(df, "p").collect()}
    assert got == {k: pytest.approx(v) for k, v in {"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06}.items()}


def test_rank_tests_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i % 2, rng.randint(0, 12), rng.randint(0, 12)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = {r["k"]: r for r in stats.wilcoxon(df, ["k"], "a", "b").collect()}
    long = df.select("k", F.explode(F.array(F.struct(F.lit(1).alias("g"), F.col("a").alias("v")), F.struct(F.lit(2).alias("g"), F.col("b").alias("v")))).alias("x")).select("k", "x.*")
    delta = {r["k"]: r["cliffs_delta"] for r in stats.cliffs_delta(long, ["k"], "g", "v", 1, 2).collect()}
    for k in (0, 1):
        pairs = [(a, b) for key, a, b in rows if key == k]
        diffs = sorted(b - a for a, b in pairs)
        nonzero = [d for d in diffs if d]
        size = sorted(abs(d) for d in nonzero)
        rank = {v: (size.index(v) + 1 + size.index(v) + size.count(v)) / 2 for v in set(size)}
        w = min(sum(rank[abs(d)] for d in nonzero if d > 0), sum(rank[abs(d)] for d in nonzero if d < 0))
        assert (got[k]["n"], got[k]["n_nonzero"], got[k]["statistic"]) == (len(pairs), len(nonzero), w)
        assert got[k]["median_difference"] == (diffs[len(diffs) // 2] + diffs[(len(diffs) - 1) // 2]) / 2
        wins = sum((b > a) - (b < a) for a, _ in pairs for _, b in pairs)
        assert delta[k] == pytest.approx(wins / len(pairs) ** 2)


def test_mcnemar_and_verdicts(spark):
    rows = [("B1", f"p{i}", i < 5) for i in range(30)] + [("B2", f"p{i}", i < 20) for i in range(30)]
    canonical = spark.createDataFrame([(c, "x", e, "null_spike", d) for c, e, d in rows], "config string, app string, entry_id string, problem_type string, detected boolean")
    (row,) = stats.compare(canonical).collect()
    assert (row["both"], row["only_first"], row["only_second"], row["neither"]) == (5, 0, 15, 10)
    assert row["p_value"] == pytest.approx(2 / 2**15) and row["discordant_odds_ratio"] == math.inf
    assert row["verdict"].startswith("supported")


def test_kappa_is_undefined_when_chance_is_total(spark):
    df = spark.createDataFrame([("x", "TP", "TP")] * 3 + [("y", "TP", "FP"), ("y", "FP", "FP"), ("y", "TP", "TP"), ("y", "FP", "FP")], "g string, a string, b string")
    got = {r["g"]: r for r in stats.kappa(df, "a", "b", ["g"]).collect()}
    assert got["x"]["kappa"] is None and got["y"]["kappa"] == pytest.approx(0.5)


def test_poisson_tables(spark):
    """The tabled distribution and the place of a uniform number in it."""
    rows = {r["n"]: r for r in stats.poisson_tables(spark.createDataFrame([(1,), (40,), (100_000,), (0,)], "n long")).collect()}
    assert set(rows) == {1, 40, 100_000}
    for n, r in rows.items():
        want = 0.0
        for k, c in enumerate(r["cumulative"], r["low"]):
            want += math.exp(k * math.log(n) - n - math.lgamma(k + 1))
            assert c == pytest.approx(want, abs=1e-9)


def test_bootstrap_is_seeded_and_close_to_the_normal_limit(spark):
    cells = spark.createDataFrame([(1, 0, 600), (0, 1, 400)], "tp int, fp int, n bigint")
    first, again = (stats.precision_interval(cells, [], seed=5).collect()[0] for _ in range(2))
    assert first == again and first != stats.precision_interval(cells, [], seed=6).collect()[0]
    half = 1.96 * math.sqrt(0.24 / 1000)
    assert first["low"] == pytest.approx(0.6 - half, abs=0.004) and first["high"] == pytest.approx(0.6 + half, abs=0.004)
    nothing = spark.createDataFrame([(0, 0, 5)], "tp int, fp int, n bigint")
    assert stats.precision_interval(nothing, []).collect()[0]["low"] is None
    drawn = stats.resampled(cells, ["tp", "fp"], 4000).groupBy("tp").agg(F.avg("weight").alias("m"), F.var_samp("weight").alias("v")).collect()
    for r in drawn:
        n = 600 if r["tp"] else 400
        assert r["m"] == pytest.approx(n, rel=0.01) and r["v"] == pytest.approx(n, rel=0.1)


def test_holm_of_many_ranges_and_families(spark):
    rng = random.Random(2)
    rows = [(f, i, None if i % 17 == 0 else rng.choice([rng.random() ** 6, 0.001])) for f in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "f string, i int, p double").repartition(6)
    got = {(r["f"], r["i"]): r["p_holm"] for r in stats.holm(df, "p", ["f"]).collect()}
    for f in "ab":
        mine = sorted((p, i) for g, i, p in rows if g == f and p is not None)
        largest = 0.0
        for k, (p, i) in enumerate(mine):
            largest = max(largest, min(1.0, (len(mine) - k) * p))
            assert got[f, i] == pytest.approx(largest)
    assert all(got[f, i] is None for f, i, p in rows if p is None) and len(got) == len(rows)


def test_percentiles_are_narrowed_by_counts(spark, monkeypatch):
    """Skewed, repeated, negative and huge values: whatever the distribution, brackets shrink to the exact rank."""
    monkeypatch.setattr("plumbline.functions.ranking.BRACKET", 50)
    monkeypatch.setattr("plumbline.functions.ranking.PARTS", 8)
    rng = random.Random(8)
    groups = {
        "spread": [rng.choice([-1, 1]) * 10 ** rng.uniform(-250, 250) for _ in range(900)], "same": [3.0] * 400,
        "two": [1.0] * 300 + [2.0] * 301, "plain": [rng.uniform(-5, 5) for _ in range(777)], "few": [4.0, 9.0], "none": [None],
        "up": [10 ** rng.uniform(0, 200) for _ in range(300)], "down": [-(10 ** rng.uniform(0, 200)) for _ in range(300)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    asked = {"a": 0.0, "m": 0.5, "p": 0.95, "z": 1.0}
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", asked).collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        for name, p in asked.items():
            assert r[name] == pytest.approx(float(np.percentile(groups[k], 100 * p)), rel=1e-9)


def test_percentiles_of_a_hot_key_are_exact(spark):
    """One key holds most rows and is too large to be ranked whole."""
    df = spark.range(300_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    got = {r["k"]: (r["m"], r["p"]) for r in exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}).collect()}
    want = {r["k"]: tuple(r["q"]) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95))).alias("q")).collect()}
    assert got == {k: (pytest.approx(a), pytest.approx(b)) for k, (a, b) in want.items()}


def test_positions_and_totals_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("o"))
    got = positions(df, ["k"], [F.desc("o")]).collect()
    for key in "ab":
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["o"], reverse=True)
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
    counted = spark.range(5_000).select(F.lit("x").alias("k"), F.pow("id", 2.0).alias("v"), (F.col("id") % 5).alias("w"))
    rows = sorted(running_totals(counted, ["k"], "v", ["w"]).collect(), key=lambda r: r["v"])
    assert [r["w_before"] for r in rows] == list(itertools.accumulate([0, *[i % 5 for i in range(4_999)]]))


def test_first_by_hash_keeps_exactly_the_limit(spark):
    df = spark.range(3_000).withColumn("o", hash_order(F.lit("1"), F.col("id").cast("string")))
    assert first_by_hash(df, [], "o", F.lit(777)).count() == 777
    assert first_by_hash(df, [], "o", F.ceil(F.col("_n") * 0.25)).count() == 750
    want = sorted(r["o"] for r in df.collect())[:777]
    assert sorted(r["o"] for r in first_by_hash(df, [], "o", F.lit(777)).collect()) == want
