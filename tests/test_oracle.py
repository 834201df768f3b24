"""Registered queries against their SQL on the smallest tables.

By default a part of each group; ORACLE_ALL=1 runs every query. ``python tests/oracle.py`` does the same on
any data folder.
"""

from __future__ import annotations

import os

import pytest

from oracle import check, connect
from plumbline.plans.catalogue import ORACLES, QUERIES

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: Queries whose rows come from sketches.
WITHOUT_SQL = {"approx_profile"}


#: What runs by default.
USUAL = (
    "q01", "q08", "q15", "q22", "q28", "profile_s", "profile_w", "profile_r", "value_h", "category_f", "orphans", "integrity_s", "column_div", "key_div",
    "verify", "corrupt", "anomaly_detect", "backtest_s", "read_events", "operations_n", "sql_fingerprint", "n_plus_one", "shape_stats",
    "split_st", "source_c", "findings_json", "repeatability", "finding_ids", "findings_diff", "select_until", "stratified",
    "correlate_f", "score_counts", "compare_conf", "cliffs", "kappa", "fisher", "stream_dedupe", "stream_profile", "stream_upsert", "stream_judge", "worksheet",
)
CHOSEN = [n for n in QUERIES if os.environ.get("ORACLE_ALL") or n.startswith(USUAL)]


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    problem, _, _ = check(spark, DIRECTORY, name, duck)
    assert problem is None
