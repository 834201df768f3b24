from __future__ import annotations

from datetime import datetime

import pytest

from plumbline.operators import profile

ROWS = [
    (1, "111", "gold", "a", datetime(2026, 1, 5)), (2, None, "gold", "b", datetime(2026, 1, 10)),
    (3, "333", "silver", "c", datetime(2026, 1, 15)), (4, "333", "silver", "d", datetime(2026, 1, 20)),
    (5, None, "gold", "e", datetime(2026, 1, 31, 23, 59, 59)), (6, "666", "gold", "f", datetime(2026, 2, 1)),
    (7, "777", "silver", "g", datetime(2026, 2, 10)), (8, "888", "bronze", "h", datetime(2026, 2, 15)),
    (9, "999", "bronze", "i", datetime(2026, 2, 28)),
]
JANUARY = (datetime(2026, 1, 1), datetime(2026, 2, 1))
FEBRUARY = (datetime(2026, 2, 1), datetime(2026, 3, 1))
DECEMBER = (datetime(2025, 12, 1), datetime(2026, 1, 1))


@pytest.fixture(scope="module")
def customer(spark):
    return spark.createDataFrame(ROWS, "id int, phone string, tier string, email string, createdAt timestamp_ntz")


def column(result, name, start=None):
    rows = [r for r in result["columns"].collect() if r["column"] == name and r["window_start"] == start]
    assert len(rows) == 1
    return rows[0]


def test_snapshot(customer):
    result = profile.profile({"Customer": customer})
    phone = column(result, "phone")
    assert (phone["null_count"], phone["distinct_count"]) == (2, 6)
    assert phone["null_rate"] == pytest.approx(2 / 9)
    assert phone["duplicate_rate"] == pytest.approx(1 / 7)
    tiers = {r["value"]: r["count"] for r in result["categories"].collect() if r["column"] == "tier"}
    assert tiers == {"gold": 4, "silver": 3, "bronze": 2}


def test_category_limit_stores_nothing_but_keeps_the_count(customer):
    result = profile.profile({"Customer": customer}, max_categories=2)
    assert [r for r in result["categories"].collect() if r["column"] == "tier"] == []
    assert column(result, "tier")["distinct_count"] == 3


@pytest.mark.parametrize("windows", [[DECEMBER, JANUARY, FEBRUARY], [JANUARY, FEBRUARY, DECEMBER]])
def test_windows_are_half_open_and_empty_ones_are_reported(customer, windows):
    result = profile.profile({"Customer": customer}, windows)
    january, february, december = (column(result, "phone", w[0]) for w in (JANUARY, FEBRUARY, DECEMBER))
    assert (january["row_count"], february["row_count"], december["row_count"]) == (5, 4, 0)
    assert (january["null_count"], january["distinct_count"]) == (2, 2)
    assert january["duplicate_rate"] == pytest.approx(1 / 3)
    assert (february["null_rate"], february["duplicate_rate"]) == (0, 0)
    assert december["null_rate"] is None and december["duplicate_rate"] is None


def test_overlapping_windows_count_a_row_in_each(customer):
    wide = (datetime(2026, 1, 15), datetime(2026, 2, 15))
    result = profile.profile({"Customer": customer}, [JANUARY, wide])
    assert column(result, "id", wide[0])["row_count"] == 5
    assert column(result, "id", JANUARY[0])["row_count"] == 5


def test_regular_windows_of_a_day(customer):
    days = profile.consecutive_windows(datetime(2026, 2, 1), 31, 1)
    result = profile.profile({"Customer": customer}, days, columns={"Customer": ["id"]})
    counts = {r["window_start"].day: r["row_count"] for r in result["columns"].collect()}
    assert len(counts) == 31 and counts[31] == 1 and counts[5] == 1 and counts[6] == 0


def test_tables_without_a_time_column_are_skipped(spark, customer):
    note = spark.createDataFrame([(1, "x"), (2, "x")], "id int, body string")
    result = profile.profile({"Customer": customer, "Note": note}, [JANUARY])
    assert [(r["table"], r["reason"]) for r in result["skipped"].collect()] == [
        ("Note", "no creation-time column to window on")
    ]


def test_override_and_unknown_override(spark):
    event = spark.createDataFrame(
        [(1, datetime(2026, 1, 2)), (2, datetime(2026, 1, 3)), (3, datetime(2026, 2, 2))], "id int, happenedAt timestamp_ntz"
    )
    result = profile.profile({"Event": event}, [JANUARY], {"Event": "happenedAt"})
    assert column(result, "id", JANUARY[0])["row_count"] == 2
    with pytest.raises(ValueError):
        profile.profile({"Event": event}, [JANUARY], {"Event": "nope"})


def test_zoned_time_column_is_compared_in_utc(spark):
    log = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2026-01-10 12:00:00Z'), (2, TIMESTAMP '2026-02-10 12:00:00Z') AS t(id, at)")
    result = profile.profile({"Log": log}, [JANUARY, FEBRUARY])
    assert column(result, "id", JANUARY[0])["row_count"] == 1


def test_bad_windows_and_limits(customer):
    with pytest.raises(ValueError):
        profile.profile({"Customer": customer}, [(JANUARY[1], JANUARY[0]), JANUARY])
    with pytest.raises(ValueError):
        profile.profile({"Customer": customer}, max_categories=0)


def test_approximate_profile_is_exact_on_few_values(customer):
    rows = {r["column"]: r for r in profile.approx_profile(customer, "Customer").collect()}
    assert rows["phone"]["null_count"] == 2 and rows["tier"]["distinct_count"] == 3
