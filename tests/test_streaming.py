"""Batch functions of the streaming jobs."""

from __future__ import annotations

from datetime import datetime, timedelta

from plumbline.streaming import jobs

FIRST = datetime(2024, 1, 1)
HISTOGRAM = "table string, column string, data_type string, window_start timestamp_ntz, value string, n long"


def histogram(spark, days, nulls):
    """Two values a day, with ``nulls[day]`` of 100 rows lost."""
    rows = []
    for day in days:
        start, lost = FIRST + timedelta(days=day), nulls.get(day, day % 2)
        rows += [("t", "c", "string", start, None, lost)] if lost else []
        rows += [("t", "c", "string", start, f"v{i}", 1) for i in range(100 - lost)]
    return spark.createDataFrame(rows, HISTOGRAM)


def alarms(spark, path):
    return sorted((r["metric"], (r["window_start"] - FIRST).days) for r in spark.read.parquet(path).where("anomalous").collect())


def test_every_window_of_a_batch_is_judged(spark, tmp_path):
    path = str(tmp_path / "judged")
    write = jobs.judge_batch(path)
    write(histogram(spark, range(10), {}), 0)
    write(histogram(spark, [], {}), 1)
    write(histogram(spark, [10, 11, 12], {10: 60}), 2)
    assert ("null_rate", 10) in alarms(spark, path)
    judged = spark.read.parquet(path)
    assert {(r["window_start"] - FIRST).days for r in judged.where("batch = 2").collect()} == {10, 11, 12}
    sizes = {(r["window_start"] - FIRST).days: r["detections"][0]["history_size"] for r in judged.where("metric = 'null_rate'").collect()}
    assert sizes == {d: d for d in range(5, 13)}
    before = alarms(spark, path)
    write(histogram(spark, [10, 11, 12], {10: 60}), 2)  # a replayed batch changes nothing
    assert alarms(spark, path) == before


def test_windows_with_late_rows(spark, tmp_path):
    """Only closed windows whose stored rows outnumber the counted ones are computed again; all-late windows appear."""
    rows = [(FIRST + timedelta(days=d, hours=h), d * 10 + h % 3) for d in range(6) for h in range(0, 24, 6)]
    late = [(FIRST + timedelta(days=1, hours=1), 99), (FIRST + timedelta(days=3), None)]
    lost = [(FIRST + timedelta(days=-2), 7)]
    schema = "ts timestamp_ntz, v long"
    stored = spark.createDataFrame(rows + late + lost, schema)
    columns = ["v"]
    write = jobs.store_batch(str(tmp_path / "s"))
    write(spark.createDataFrame(rows, schema), 0)
    write(spark.createDataFrame(late + lost, schema), 1)
    write(spark.createDataFrame(late + lost, schema), 1)  # a replayed batch
    kept = spark.read.parquet(str(tmp_path / "s")).drop("batch")
    assert kept.count() == stored.count()
    days = spark.createDataFrame([(FIRST + timedelta(days=d),) for d in range(5)], "window_start timestamp_ntz")
    counted = jobs.recomputed(spark.createDataFrame(rows, schema), days, "t", columns, "ts", "1 day")
    whole, dirty = jobs.with_late_rows(kept, counted, "t", columns, "ts", "1 day", FIRST + timedelta(days=5))
    found = {((r["window_start"] - FIRST).days, r["stored"], r["counted"]) for r in dirty.collect()}
    assert found == {(1, 5, 4), (3, 5, 4), (-2, 1, 0)}
    everything = spark.createDataFrame([(FIRST + timedelta(days=d),) for d in (-2, *range(5))], "window_start timestamp_ntz")
    want = jobs.recomputed(stored, everything, "t", columns, "ts", "1 day")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(whole) == plain(want)
    again, none = jobs.with_late_rows(kept, want, "t", columns, "ts", "1 day", FIRST + timedelta(days=5))
    assert none.count() == 0 and plain(again) == plain(want)


def test_compacted_log(spark, tmp_path):
    """Generations change nothing that is read, also when batches and generations are written again."""
    path, plain = str(tmp_path / "log"), str(tmp_path / "plain")
    batches = [[(k, t, t * 10 + k) for k in range(3 + t)] for t in range(5)]
    schema = "k int, t int, v int"
    write, simple = jobs.upsert_batch(path, ["k"], ["t"], compact_every=2), jobs.upsert_batch(plain, ["k"], ["t"])
    for epoch, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), epoch)
        simple(spark.createDataFrame(rows, schema), epoch)
    for epoch in (3, 4):
        write(spark.createDataFrame(batches[epoch], schema), epoch)
    got, want = ({tuple(r) for r in jobs.latest(spark, p, ["k"], ["t"]).collect()} for p in (path, plain))
    assert got == want == {(k, 4, 40 + k) for k in range(7)}
    assert {r[0] for r in spark.read.parquet(f"{path}-generations").select("generation").distinct().collect()} == {1, 3}
