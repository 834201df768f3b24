from __future__ import annotations

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import scoring
from plumbline.schemas import ENTRY, EVIDENCE

FINDING = f"app string, rule_id string, confidence string, file string, line int, end_line int, fingerprint string, evidence array<{EVIDENCE}>"


def finding(name, rule, file="x", line=0, end=None, confidence="HIGH", **data):
    evidence = [("RUNTIME", "d", None, None, json.dumps(data) if data else None)]
    return ("shop", rule, confidence, file, line, end, name, evidence)


def entry(name, kind, **v):
    return (name, kind, scoring.PROBLEM_CATEGORY[kind], v.get("file"), v.get("line"), v.get("end"), v.get("endpoint"), None,
            v.get("table"), v.get("column"), "R", "d", None, "shop")


def run(spark, findings, entries):
    f = spark.createDataFrame(findings, FINDING)
    e = spark.createDataFrame(entries, ENTRY + ", app string")
    return scoring.score(f, e)


def totals(spark, findings, entries):
    rows = scoring.counts_rollup(run(spark, findings, entries)).where("level = 'total'").collect()
    return tuple(rows[0][c] for c in ("tp", "fp", "fn", "duplicates"))


def test_each_way_of_matching(spark):
    findings = [
        finding("a", "MISSING_INDEX_ON_FILTERED_FIELD", "./src\\q.ts", 14, 20), finding("b", "NULL_SPIKE", table='public."User"', column="Phone"),
        finding("c", "RUNTIME_N_PLUS_ONE", route="/api/orders/[id]"), finding("d", "DUPLICATE_SPIKE", table="user", columns=["other"]),
        finding("e", "NULL_SPIKE", table="user", column="email"), finding("f", "SQL_UNBOUNDED_MUTATION"),
    ]
    entries = [
        entry("1", "missing_index", file="src/q.ts", line=10, end=14, endpoint="GET /none"), entry("2", "null_spike", table="user", column='"phone"'),
        entry("3", "n_plus_one", file="src/o.ts", line=1, endpoint="GET /api/orders/:id?x=1"), entry("4", "duplicate_spike", table="USER"),
        entry("5", "distribution_shift", table="user", column="phone"),
    ]
    assert totals(spark, findings, entries) == (4, 2, 1, 0)


def test_second_answer_is_a_duplicate(spark):
    spike = [finding(n, "NULL_SPIKE", table="t", column="c") for n in "ab"]
    assert totals(spark, spike, [entry("1", "null_spike", table="t", column="c")]) == (1, 0, 0, 1)
    assert totals(spark, [spike[0], spike[0]], [entry("1", "null_spike", table="t", column="c")]) == (1, 0, 0, 1)


def test_touching_ranges_match_and_apart_do_not(spark):
    rule = "MISSING_INDEX_ON_FILTERED_FIELD"
    one = [entry("1", "missing_index", file="f", line=60, end=70, endpoint="/")]
    assert totals(spark, [finding("a", rule, "f", 70, 140)], one) == (1, 0, 0, 0)
    assert totals(spark, [finding("a", rule, "f", 71, 140)], one) == (0, 1, 1, 0)


def largest(findings, entries):
    """Brute force: the largest one-to-one pairing, by augmenting paths over single findings."""
    options = [[i for i, f in enumerate(findings) if f[4] <= e[5] and e[4] <= f[5]] for e in entries]
    owner = {}

    def place(e, seen):
        for f in options[e]:
            if f not in seen:
                seen.add(f)
                if f not in owner or place(owner[f], seen):
                    owner[f] = e
                    return True
        return False

    matched = {entries[e][0] for e in range(len(entries)) if place(e, set())}
    claimable = {f for o in options for f in o}
    # Kuhn keeps an entry once matched, so `matched` is complete.
    return matched, len(findings) - len(claimable), len(claimable) - len(matched)


@pytest.mark.parametrize("seed", range(4))
def test_random_overlaps_match_as_many_as_possible(spark, seed):
    rng = random.Random(seed)
    span = lambda: (lambda a: (a, a + rng.randint(0, 25)))(rng.randint(1, 200))
    entries = [entry(f"e{i:02d}", "missing_index", file="f", line=a, end=b, endpoint="/") for i, (a, b) in ((i, span()) for i in range(30))]
    findings = [finding(f"f{i:02d}", "MISSING_INDEX_ON_FILTERED_FIELD", "f", a, b) for i, (a, b) in ((i, span()) for i in range(24))]
    scored = run(spark, findings, entries)
    matched, fp, duplicates = largest(findings, entries)
    assert {r["id"] for r in scored["entries"].where("outcome = 'tp'").collect()} == matched
    pairs = scored["matches"].collect()
    assert len(pairs) == len(matched) == len({p["fingerprint"] for p in pairs}) == len({p["entry_id"] for p in pairs})
    ranges = {e[0]: (e[4], e[5]) for e in entries}
    spans = {f[6]: (f[4], f[5]) for f in findings}
    for p in pairs:
        (a, b), (c, d) = ranges[p["entry_id"]], spans[p["fingerprint"]]
        assert c <= b and a <= d
    row = scoring.counts_rollup(scored).where("level = 'total'").collect()[0]
    assert (row["fp"], row["duplicates"]) == (fp, duplicates)


def test_busy_place_keeps_every_finding(spark):
    findings = [finding(f"f{i}", "NULL_SPIKE", table="t", column="c") for i in range(500)]
    entries = [entry(f"e{i}", "null_spike", table="t", column="c") for i in range(3)]
    assert totals(spark, findings, entries) == (3, 0, 0, 497)


def test_undefined_rates_are_null(spark):
    row = scoring.counts_rollup(run(spark, [finding("f", "SQL_UNBOUNDED_MUTATION")], [entry("1", "null_spike", table="t")])).collect()
    kind = next(r for r in row if r["level"] == "problem_type")
    assert kind["precision"] is None and kind["recall"] == 0 and kind["f1"] is None


def test_manifest_rules(spark):
    good = entry("1", "null_spike", table="t")
    rows = [good[:10] + ("NULL_SPIKE",) + good[11:], entry("2", "null_spike")]
    bad = spark.createDataFrame(rows, ENTRY + ", app string")
    got = {(r["id"], r["problem"]) for r in scoring.validate_manifest(bad).collect()}
    assert got == {("2", "unknown rule"), ("2", "data problem without table")}


def test_one_type_with_most_entries(spark):
    """A busy problem type is searched by component: groups stay as small as the places that share findings."""
    rng = random.Random(3)
    entries = [entry(f"e{i:04d}", "null_spike", table=f"t{i % 90}", column=f"c{i % 3}") for i in range(900)]
    entries += [entry(f"x{i:03d}", "missing_index", file=f"f{i % 9}", line=10 * i, end=10 * i + 14, endpoint="/") for i in range(100)]
    findings = [finding(f"a{i:04d}", "NULL_SPIKE", table=f"t{rng.randrange(100)}", column=f"c{rng.randrange(4)}") for i in range(700)]
    findings += [finding(f"b{i:04d}", "MISSING_INDEX_ON_FILTERED_FIELD", f"f{i % 9}", line, line + rng.choice([0, 40, 2_000_000])) for i, line in ((i, rng.randrange(1000)) for i in range(60))]
    scored = run(spark, findings, entries)
    count = lambda rows, key: collections.Counter(key(r) for r in rows)
    e = count([x for x in entries if x[1] == "null_spike"], lambda x: (x[8], x[9]))
    f = count([x for x in findings if x[1] == "NULL_SPIKE"], lambda x: (json.loads(x[7][0][4])["table"], json.loads(x[7][0][4])["column"]))
    spikes = sum(min(n, f[k]) for k, n in e.items())
    code = [(x[0], x[1], x[2], x[3], x[4], x[5]) for x in entries if x[1] == "missing_index"]
    found = [x for x in findings if x[1] != "NULL_SPIKE"]
    matched = set()
    for file in {x[3] for x in code}:
        mine = [x for x in code if x[3] == file]
        near = [(None, None, None, None, x[4], x[5]) for x in found if x[3] == file]
        matched |= largest(near, mine)[0]
    hits = [r["id"] for r in scored["entries"].where("outcome = 'tp'").collect()]
    assert sum(h.startswith("e") for h in hits) == spikes and {h for h in hits if h.startswith("x")} == matched
    pairs = scored["matches"].collect()
    assert len({r["entry_id"] for r in pairs}) == len({r["fingerprint"] for r in pairs}) == len(pairs) == len(hits)


def test_interval_blocks(spark):
    from plumbline.functions import intervals

    rng = random.Random(1)
    rows = [(i, a, a + rng.choice([0, 1, 7, 300, -1])) for i, a in ((i, rng.randrange(0, 500)) for i in range(200))]
    left = spark.createDataFrame(rows, "i int, a int, b int")
    right = left.selectExpr("i as j", "a + 3 as c", "b as d")
    got = {(r["i"], r["j"]) for r in intervals.overlaps(left, right, [], ("a", "b"), ("c", "d")).collect()}
    want = [(r["i"], r["j"]) for r in left.crossJoin(right).where("a <= b and c <= d and a <= d and c <= b").collect()]
    assert got == set(want) and len(want) == len(got)
    long = spark.range(1).select(intervals.cover(F.lit(1), F.lit(1_000_000), 20).alias("x")).first()["x"]
    assert len(long) <= 40 and sum(1 << x["level"] for x in long) == 1_000_000


def test_outcomes_are_dealt_before_they_are_grouped(spark):
    rows = [("A", "app", r, e, "n_plus_one", (e + r) % 2 == 0) for e in range(50) for r in (1, 2, 3)]
    outcomes = spark.createDataFrame(rows, "config string, app string, repetition int, entry_id int, problem_type string, detected boolean")
    judged = scoring.canonical_detection(outcomes)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Aggregate(") < plan.index("Exchange hashpartitioning(app")  # no group is kept by the task that reads
    assert {(r.entry_id, r.detected) for r in judged.collect()} == {(e, e % 2 == 1) for e in range(50)}


def test_findings_of_one_spot_are_searched_once(spark, monkeypatch):
    searched, overlaps = [], scoring.overlaps
    monkeypatch.setattr(scoring, "overlaps", lambda left, *rest: searched.append(left.count()) or overlaps(left, *rest))
    findings = [finding(f"a{i}", "MISSING_INDEX_ON_FILTERED_FIELD", "./f.ts", 3, confidence="LOW" if i % 2 else "HIGH") for i in range(40)]
    findings += [finding(f"b{i}", "NULL_SPIKE", table="t", column="c") for i in range(30)] + [finding("c", "SQL_UNBOUNDED_MUTATION")] * 3
    entries = [entry(f"i{i}", "missing_index", file="f.ts", line=1, end=5, endpoint="/") for i in range(4)]
    entries += [entry("n", "null_spike", table="t", column="c"), entry("o", "null_spike", table="t", column="d")]
    assert totals(spark, findings, entries) == (5, 3, 1, 65)
    assert searched == [2]
    contents = scoring._contents(spark.createDataFrame(findings, FINDING))
    plan = contents._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(" not in plan and "Exchange hashpartitioning(finding" in plan
    assert sorted(r["n"] for r in contents.collect()) == [1] * 70 + [3]


def test_result_rows_read_outcomes_once(spark, tmp_path):
    findings = [finding(f"a{i}", "NULL_SPIKE", table="t", column="c") for i in range(5)] + [finding("u", "SQL_UNBOUNDED_MUTATION")] * 2
    findings += [finding("x", "NULL_SPIKE", table="other", column="c")]
    entries = [entry("1", "null_spike", table="t", column="c"), entry("2", "null_spike", table="t", column="d")]
    scored = run(spark, findings, entries)
    for name, rows in scored.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    scored = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in scored}
    universe = spark.createDataFrame([("shop", "null_spike", 12)], "app string, problem_type string, units long")
    rows = scoring.result_rows(scored, universe)
    left = {file.split("/")[-2] for file in rows.inputFiles() if str(tmp_path) in file}
    assert left <= {"matches"}  # outcomes were read when they were summed
    got = {r["problem_type"]: (r["entries"], r["tp"], r["fp"], r["fn"], r["duplicates"], r["fpr"], r["mean_tp_confidence"]) for r in rows.collect()}
    assert got == {"null_spike": (2, 1, 1, 1, 4, 0.1, 3.0), "unmapped": (0, 0, 2, 0, 0, None, None)}
