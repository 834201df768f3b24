"""Profiling, integrity, contract and anomaly queries on the driver tables.

The tables are clean, so a column is corrupted or rows are removed by hash where a problem is needed.
Daily windows of ``events`` are the history; the corrupted last day is the window judged.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clock, pick
from ..operators import anomaly, contract, integrity, profile, sampling
from ..session import fresh_path
from ..sources import profile_store
from ..sources.tables import Tables, expected_type, narrowed, read_contract, spark_type
from .registry import query

#: The driver's tables and their columns.
SCHEMA = {
    name: columns.split() for name, columns in {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
        "events": "event_id ts user_id event_type value props",
        "documents": "doc_id text lang source n_chars",
        "embeddings": "vec_id embedding label",
        "pages": "page_id url html",
        "benchmark": "item_id text",
        "labels": "doc_id quality toxic",
        "conversations": "conv_id turn role text",
    }.items()
}
PERIOD = 90


def sql_pick(row_id: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({row_id} AS VARCHAR) || '{salt}'), 1, 2) AS INTEGER)"


# ---- profiles ------------------------------------------------------------------------------------


def _sql_profile(table: str, column: str, source: str | None = None, window: str = "") -> str:
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", {window} count(*) AS row_count,
        count(*) - count({column}) AS null_count, (count(*) - count({column})) / nullif(count(*), 0) AS null_rate,
        count(DISTINCT CAST({column} AS VARCHAR)) AS distinct_count,
        (count({column}) - count(DISTINCT CAST({column} AS VARCHAR))) / nullif(count({column}), 0) AS duplicate_rate
      FROM {source or table}"""


def _snapshot(t: Tables, names=None) -> dict[str, DataFrame]:
    return profile.profile({n: getattr(t, n) for n in (names or SCHEMA)})


@query("profile_snapshot", " UNION ALL ".join(_sql_profile(t, c) for t, cs in SCHEMA.items() for c in cs))
def profile_snapshot(t: Tables) -> DataFrame:
    return _snapshot(t)["columns"].drop("data_type", "window_start")


@query(
    "profile_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count, CAST(NULL AS VARCHAR) AS time_column FROM {t}" for t in SCHEMA),
)
def profile_tables(t: Tables) -> DataFrame:
    return _snapshot(t)["tables"].drop("window_start")


@query("profile_lineitem", " UNION ALL ".join(_sql_profile("lineitem", c) for c in SCHEMA["lineitem"]))
def profile_lineitem(t: Tables) -> DataFrame:
    histogram = profile.value_histogram(t.lineitem, "lineitem")
    return profile.column_profile(histogram).drop("data_type", "window_start")


def _periods(t: Tables) -> list[profile.Window]:
    """Windows of PERIOD days that end after the day of the newest order and cover the oldest."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    oldest, newest = t.orders.agg(day(F.min("o_orderdate")), day(F.max("o_orderdate"))).first()
    if oldest is None:
        return profile.consecutive_windows(datetime(2000, 1, 1), 1, PERIOD)
    end = newest + timedelta(days=1)
    return profile.consecutive_windows(end, -(-(end - oldest).days // PERIOD), PERIOD)


_SQL_MONTHS = f"""(SELECT e - to_days(CAST({PERIOD} * (n + 1) AS INTEGER)) AS ws, e - to_days(CAST({PERIOD} * n AS INTEGER)) AS we FROM (
    SELECT e, unnest(range(CAST(ceil(date_diff('day', s, e) / {PERIOD}.0) AS BIGINT))) AS n FROM (
      SELECT date_trunc('day', min(o_orderdate))::TIMESTAMP AS s, date_trunc('day', max(o_orderdate))::TIMESTAMP + INTERVAL 1 DAY AS e FROM orders)))"""
_WINDOWED_COLUMNS = SCHEMA["orders"]


@query(
    "profile_windowed",
    " UNION ALL ".join(
        _sql_profile("orders", c, f"{_SQL_MONTHS} w LEFT JOIN orders ON o_orderdate >= ws AND o_orderdate < we GROUP BY ws",
                     "ws AS window_start,").replace("count(*)", "count(o_orderkey)")
        for c in _WINDOWED_COLUMNS
    ),
)
def profile_windowed(t: Tables) -> DataFrame:
    """Windows without rows are reported with 0 rows and undefined rates."""
    histogram = profile.value_histogram(t.orders, "orders", _WINDOWED_COLUMNS, "o_orderdate", _periods(t))
    return profile.column_profile(histogram).drop("data_type")


@query(
    "profile_skips",
    f"""SELECT 'orders' AS "table", ws AS window_start, count(o_orderkey) AS row_count, 'o_orderdate' AS time_column, CAST(NULL AS VARCHAR) AS reason FROM {_SQL_MONTHS} w
        LEFT JOIN orders ON o_orderdate >= ws AND o_orderdate < we GROUP BY ws
        UNION ALL SELECT 'lineitem', ws, count(l_orderkey), 'l_shipdate', NULL FROM {_SQL_MONTHS} w LEFT JOIN lineitem ON l_shipdate >= ws AND l_shipdate < we GROUP BY ws
        UNION ALL SELECT 'customer', NULL, NULL, NULL, 'no creation-time column to window on'""",
)
def profile_skips(t: Tables) -> DataFrame:
    """Windows on the column found, on the one named, and a table skipped for having none."""
    tables = {"orders": t.orders, "lineitem": t.lineitem, "customer": t.customer}
    found = profile.profile(tables, _periods(t), time_columns={"lineitem": "l_shipdate"})
    counts = found["tables"].select("table", "window_start", "row_count", "time_column")
    return counts.unionByName(found["skipped"], allowMissingColumns=True)


@query(
    "make_windows",
    f"""SELECT ws AS window_start, we AS window_end, count(o_orderkey) AS orders FROM {_SQL_MONTHS} w
        LEFT JOIN orders ON o_orderdate >= ws AND o_orderdate < we GROUP BY ws, we""",
)
def make_windows(t: Tables) -> DataFrame:
    """Consecutive windows over all orders, with the orders in each."""
    spans = _periods(t)
    windows = profile.make_windows(t.spark, spans[-1][1], len(spans), PERIOD)
    starts = F.explode(profile.window_start_of(F.col("o_orderdate"), spans))
    counted = t.orders.select(starts.alias("window_start")).groupBy("window_start").agg(F.count(F.lit(1)).alias("orders"))
    return windows.join(counted, "window_start", "left").fillna(0, ["orders"])


_SQL_CATEGORY = """SELECT 'orders' AS "table", '{c}' AS "column", ws AS window_start, value, n AS count FROM (
    SELECT ws, value, n, count(*) OVER (PARTITION BY ws) AS d, sum(n) OVER (PARTITION BY ws) AS t FROM (
      SELECT ws, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {m} w JOIN orders ON o_orderdate >= ws AND o_orderdate < we
      WHERE {c} IS NOT NULL GROUP BY ALL)) WHERE d <= 50 AND d < t"""


@query("category_frequency", " UNION ALL ".join(_SQL_CATEGORY.format(c=c, m=_SQL_MONTHS) for c in _WINDOWED_COLUMNS))
def category_frequency(t: Tables) -> DataFrame:
    histogram = profile.value_histogram(t.orders, "orders", _WINDOWED_COLUMNS, "o_orderdate", _periods(t))
    return profile.category_frequency(histogram)


@query(
    "value_histogram",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY ALL""" for c in SCHEMA["lineitem"]
    ),
)
def value_histogram(t: Tables) -> DataFrame:
    histogram = profile.value_histogram(t.lineitem, "lineitem")
    return histogram.where(F.col("n") > 0).select("column", "value", "n")


@query("approx_profile")
def approx_profile(t: Tables) -> DataFrame:
    return profile.approx_profile(t.lineitem, "lineitem")


def _stored(t: Tables) -> dict[str, DataFrame]:
    """A store with one snapshot run and a run of ``orders`` for each window."""
    path = fresh_path(t.spark, "profiles")
    spans = _periods(t)
    columns, categories = profile.settle(profile.profile({"orders": t.orders}, spans))
    named = lambda df: df.withColumn("run_id", F.date_format("window_start", "'w'yyyyMMdd")).withColumns(
        {"app": F.lit("shop"), "label": F.lit("clean")}
    )
    windows = profile.make_windows(t.spark, spans[-1][1], len(spans), PERIOD)
    runs = profile_store.run_rows(windows, "shop", "clean", datetime(2001, 8, 3), time_columns={"orders": "o_orderdate"})
    profile_store.append_profile(path, run=runs, column=named(columns), category=named(categories))
    whole = profile.profile({"orders": t.orders})["columns"]
    snapshot = {"run_id": F.lit("snapshot"), "app": F.lit("shop"), "label": F.lit("clean")}
    profile_store.append_profile(
        path, run=profile_store.run_row(t.spark, "snapshot", "shop", "clean", datetime(2001, 8, 4)),
        column=whole.withColumns(snapshot),
    )
    return {p: profile_store.read_part(t.spark, path, p) for p in ("run", "column", "category")}


@query(
    "column_history",
    f"""SELECT 'w' || strftime(ws, '%Y%m%d') AS run_id, ws AS window_start, we AS window_end, count(o_orderkey) AS row_count,
          count(DISTINCT o_custkey) AS distinct_count, (count(o_custkey) - count(DISTINCT o_custkey)) / nullif(count(o_custkey), 0) AS duplicate_rate
        FROM {_SQL_MONTHS} w LEFT JOIN orders ON o_orderdate >= ws AND o_orderdate < we GROUP BY ws, we""",
)
def column_history(t: Tables) -> DataFrame:
    s = _stored(t)
    history = profile_store.column_history(s["run"], s["column"], "shop", "orders", "o_custkey", "clean")
    return history.select("run_id", "window_start", "window_end", "row_count", "distinct_count", "duplicate_rate")


@query(
    "category_history",
    f"""SELECT ws AS window_start, list(value || '=' || n ORDER BY n DESC, value) AS distribution FROM (
          SELECT ws, o_orderpriority AS value, count(*) AS n FROM {_SQL_MONTHS} w
          JOIN orders ON o_orderdate >= ws AND o_orderdate < we GROUP BY ALL) GROUP BY ws
        HAVING sum(n) > count(*)""",
)
def category_history(t: Tables) -> DataFrame:
    s = _stored(t)
    history = profile_store.category_history(s["run"], s["category"], "shop", "orders", "o_orderpriority", "clean")
    text = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return history.select("window_start", text.alias("distribution"))


@query(
    "profile_runs",
    f"""SELECT 'w' || strftime(ws, '%Y%m%d') AS run_id, 'shop' AS app, 'clean' AS label, TIMESTAMP '2001-08-03' AS profiled_at, ws AS window_start,
          we AS window_end, {len(SCHEMA['orders'])} AS columns FROM {_SQL_MONTHS}
        UNION ALL SELECT 'snapshot', 'shop', 'clean', TIMESTAMP '2001-08-04', NULL, NULL, {len(SCHEMA['orders'])}""",
)
def profile_runs(t: Tables) -> DataFrame:
    s = _stored(t)
    return profile_store.profile_runs(s["run"], s["column"], "shop")


@query(
    "profile_run_summary",
    f"""SELECT 'w' || strftime(ws, '%Y%m%d') AS run_id, 'shop' AS app, 'clean' AS label, ws AS window_start, we AS window_end, 1 AS tables,
          {len(SCHEMA['orders'])} AS columns, coalesce(n, 0) AS category_rows FROM {_SQL_MONTHS} LEFT JOIN (SELECT window_start AS ws, count(*) AS n
          FROM ({" UNION ALL ".join(f"SELECT * FROM ({_SQL_CATEGORY.format(c=c, m=_SQL_MONTHS)})" for c in _WINDOWED_COLUMNS)}) GROUP BY 1) USING (ws)
        UNION ALL SELECT 'snapshot', 'shop', 'clean', NULL, NULL, 1, {len(SCHEMA['orders'])}, 0""",
)
def profile_run_summary(t: Tables) -> DataFrame:
    s = _stored(t)
    tables = s["column"].select("run_id", "table").distinct()
    return profile_store.run_summary(s["run"], tables, s["column"], s["category"])


# ---- integrity -------------------------------------------------------------------------------------

_KEPT_ORDERS = f"(SELECT * FROM orders WHERE {sql_pick('o_orderkey', ':archive')} >= 40)"
_KEPT_PARTS = f"(SELECT * FROM part WHERE {sql_pick('p_partkey', ':discontinued')} >= 6)"


def _orders(t: Tables) -> DataFrame:
    return sampling.remove(t.orders, "o_orderkey", ":archive", 40)


def _parts(t: Tables) -> DataFrame:
    return sampling.remove(t.part, "p_partkey", ":discontinued", 6)


@query(
    "orphans_single",
    f"""SELECT count(*) AS checked_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS orphan_rows,
          count(*) FILTER (WHERE o_orderkey IS NULL) / count(*) AS orphan_rate
        FROM lineitem LEFT JOIN {_KEPT_ORDERS} o ON o_orderkey = l_orderkey""",
)
def orphans_single(t: Tables) -> DataFrame:
    return integrity.orphans(t.lineitem, ["l_orderkey"], _orders(t), ["o_orderkey"])


_SUPPLY = "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem WHERE l_quantity > 10)"
_HOLED = f"(SELECT *, CASE WHEN {sql_pick('l_orderkey', ':supp')} >= 30 THEN l_suppkey END AS supp FROM lineitem)"


def _supply(t: Tables) -> tuple[DataFrame, DataFrame]:
    child = t.lineitem.withColumn("supp", F.when(pick("l_orderkey", ":supp") >= 30, F.col("l_suppkey")))
    parent = t.lineitem.where(F.col("l_quantity") > 10).select(
        F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")
    )
    return child, parent


@query(
    "orphans_composite",
    f"""SELECT count(*) AS checked_rows, count(*) FILTER (WHERE ps_partkey IS NULL) AS orphan_rows,
          count(*) FILTER (WHERE ps_partkey IS NULL) / count(*) AS orphan_rate
        FROM {_HOLED} c LEFT JOIN {_SUPPLY} p ON ps_partkey = l_partkey AND ps_suppkey = supp WHERE supp IS NOT NULL""",
)
def orphans_composite(t: Tables) -> DataFrame:
    """Two key columns; a row with a NULL in either is not checked."""
    child, parent = _supply(t)
    return integrity.orphans(child, ["l_partkey", "supp"], parent, ["ps_partkey", "ps_suppkey"])


@query(
    "orphans_self",
    """SELECT count(*) AS checked_rows, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = c.o_custkey)) AS orphan_rows,
          count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = c.o_custkey)) / count(*) AS orphan_rate FROM orders c""",
)
def orphans_self(t: Tables) -> DataFrame:
    return integrity.orphans(t.orders, ["o_custkey"], t.orders, ["o_orderkey"])


@query(
    "orphan_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS
          (SELECT 1 FROM {_KEPT_ORDERS} o WHERE o_orderkey = l_orderkey)""",
)
def orphan_rows(t: Tables) -> DataFrame:
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.orphan_rows(child, ["l_orderkey"], _orders(t), ["o_orderkey"])


RELATIONS = [
    integrity.Relation("Item", "order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), 10),
    integrity.Relation("Item", "product", "lineitem", ("l_partkey",), "part", ("p_partkey",), 11),
    integrity.Relation("Order", "customer", "orders", ("o_custkey",), "customer", ("c_custkey",), 20),
    integrity.Relation("Order", "coupon", "orders", ("o_coupon",), "coupon", ("id",), 21),
    integrity.Relation("Ghost", "team", "ghost", ("team_id",), None, ("id",), 30, referenced_model="Team"),
    integrity.Relation("Customer", "orders", "customer", (), "orders", (), 40, foreign_key_on="other"),
]


def _checks(t: Tables) -> tuple[DataFrame, DataFrame]:
    tables = {"lineitem": t.lineitem, "orders": _orders(t), "part": _parts(t), "customer": t.customer}
    return integrity.check_integrity(tables, RELATIONS)


def _sql_sweep(select: str) -> str:
    one = """SELECT '{m}' AS model, '{r}' AS relation, '{t}' AS tab, '{c}' AS col, '{p}' AS parent, count(*) AS checked_rows,
          count(*) FILTER (WHERE {pk} IS NULL) AS orphan_rows, {line} AS line FROM {child} c LEFT JOIN {parent} p ON {pk} = {c}"""
    parts = [
        one.format(m="Item", r="order", t="lineitem", c="l_orderkey", p="orders", pk="o_orderkey", line=10, child="lineitem", parent=_KEPT_ORDERS),
        one.format(m="Item", r="product", t="lineitem", c="l_partkey", p="part", pk="p_partkey", line=11, child="lineitem", parent=_KEPT_PARTS),
        one.format(m="Order", r="customer", t="orders", c="o_custkey", p="customer", pk="c_custkey", line=20, child=_KEPT_ORDERS, parent="customer"),
    ]
    return f"{select} FROM ({' UNION ALL '.join(parts)})"


@query(
    "integrity_sweep",
    _sql_sweep('SELECT model, relation, tab AS "table", checked_rows, orphan_rows, orphan_rows / nullif(checked_rows, 0) AS orphan_rate, line'),
)
def integrity_sweep(t: Tables) -> DataFrame:
    return _checks(t)[0].select("model", "relation", "table", "checked_rows", "orphan_rows", "orphan_rate", "line")


@query(
    "integrity_report",
    _sql_sweep("SELECT model || '.' || relation AS relation, checked_rows, orphan_rows, CAST(NULL AS VARCHAR) AS reason")
    + """ UNION ALL SELECT 'Order.coupon', NULL, NULL, 'table or columns missing from the database'
          UNION ALL SELECT 'Ghost.team', NULL, NULL, 'referenced model Team is not declared'""",
)
def integrity_report(t: Tables) -> DataFrame:
    """Every relation of the sweep: what was counted, or why it could not be."""
    checks, skipped = _checks(t)
    counted = checks.select(F.concat_ws(".", "model", "relation").alias("relation"), "checked_rows", "orphan_rows")
    return counted.unionByName(skipped, allowMissingColumns=True)


@query(
    "integrity_findings",
    _sql_sweep(
        """SELECT 'ORPHANED_FOREIGN_KEY' AS rule_id, line, tab || '(' || col || '): ' || orphan_rows || ' rows lack their ' || parent AS title,
             substr(sha256('ORPHANED_FOREIGN_KEY' || chr(0) || 'schema.json' || chr(0) || tab || chr(0) || col), 1, 32) AS fingerprint,
             checked_rows || ' keys looked up, ' || orphan_rows || ' not found' AS evidence"""
    ) + " WHERE orphan_rows > 0",
)
def integrity_findings(t: Tables) -> DataFrame:
    found = integrity.integrity_findings(_checks(t)[0], "schema.json")
    return found.select("rule_id", "line", "title", "fingerprint", F.col("evidence")[0]["description"].alias("evidence"))


# ---- contracts -------------------------------------------------------------------------------------
#
# A catalog with one "column" per part and one key per (part, supplier) pair; the declared side is the
# same rows with some removed or changed by hash.


def _written_contract(t: Tables) -> dict[str, DataFrame]:
    """A model per customer, written as JSON lines and read back; every seventh is a view, every third is renamed."""
    key = F.col("c_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    field = lambda name, db, kind, type, optional, native, args, line: F.struct(
        F.lit(name).alias("name"), db.cast("string").alias("dbName"), F.lit(kind).alias("kind"), F.lit(type).alias("type"),
        F.lit(optional).cast("boolean").alias("optional"), F.lit(False).alias("list"), F.lit(native).cast("string").alias("nativeType"),
        args.cast("array<int>").alias("nativeArgs"), line.cast("int").alias("line"),
    )
    models = t.customer.select(
        F.concat(F.lit("M"), key).alias("name"), F.when(key % 3 == 0, F.concat(F.lit("t_"), key)).alias("dbName"),
        F.when(key % 7 == 0, "view").otherwise("model").alias("blockType"), (key * 10).cast("int").alias("line"),
        F.array(
            field("id", none("string"), "scalar", "Int", None, None, none("array<int>"), key * 10 + 1),
            field("fullName", F.lit("full_name"), "scalar", "String", True, "VarChar", F.array(F.col("c_nationkey") + 1), key * 10 + 2),
            field("parent", none("string"), "object", "Parent", None, None, none("array<int>"), key * 10 + 3),
        ).alias("fields"),
        F.array(F.struct(
            F.lit("parent").alias("field"), none("string").alias("name"), F.lit("self").alias("foreignKeyOn"), F.concat(F.lit("M"), key - 1).alias("referencedModel"),
            F.array(F.lit("id")).alias("fields"), F.array(F.lit("fullName")).alias("references"), (key * 10 + 3).cast("int").alias("line"),
        )).alias("relations"),
        F.array(F.struct(
            F.lit("unique").alias("kind"), F.array(F.lit("fullName"), F.lit("id")).alias("columns"), none("string").alias("name"), (key * 10 + 4).cast("int").alias("line"),
        )).alias("keys"),
    )
    path = fresh_path(t.spark, "contract")
    models.write.json(path)
    return read_contract(t.spark, path)


_SQL_MODELS = "(SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 3 = 0 THEN 't_' ELSE 'M' END || c_custkey AS tab FROM customer WHERE c_custkey % 7 <> 0)"


@query(
    "contract_columns",
    f"""SELECT tab AS "table", 'id' AS "column", 'integer' AS expected_type, false AS expected_nullable, k * 10 + 1 AS line FROM {_SQL_MODELS}
        UNION ALL SELECT tab, 'full_name', 'character varying(' || (n + 1) || ')', true, k * 10 + 2 FROM {_SQL_MODELS}
        UNION ALL SELECT tab, 'parent', NULL, false, k * 10 + 3 FROM {_SQL_MODELS}""",
)
def contract_columns(t: Tables) -> DataFrame:
    """Columns of a contract read from files, under their database names, with the types they should have."""
    columns = expected_type(_written_contract(t)["columns"])
    return columns.select("table", "column", "expected_type", "expected_nullable", "line")


@query(
    "contract_relations",
    f"""SELECT tab AS "table", 'id' AS columns, CASE WHEN c_custkey IS NOT NULL THEN CASE WHEN (k - 1) % 3 = 0 THEN 't_' ELSE 'M' END || (k - 1) END AS referenced_table,
          CASE WHEN c_custkey IS NOT NULL THEN 'full_name' ELSE 'fullName' END AS referenced_columns, 'full_name,id' AS unique_key FROM {_SQL_MODELS} LEFT JOIN customer ON c_custkey = k - 1""",
)
def contract_relations(t: Tables) -> DataFrame:
    """Relations and keys of that contract; a parent that is not declared has no table and keeps its field names."""
    contract_ = _written_contract(t)
    keys = contract_["keys"].select("table", F.array_join("columns", ",").alias("unique_key"))
    named = contract_["relations"].select(
        "table", F.array_join("columns", ",").alias("columns"), "referenced_table", F.array_join("referenced_columns", ",").alias("referenced_columns")
    )
    return named.join(keys, "table")


def _catalog(t: Tables) -> DataFrame:
    base = t.part.select(
        F.col("p_brand").alias("table"), F.concat(F.lit("c"), "p_partkey").alias("column"),
        F.when(F.col("p_size") % 2 == 0, "text").otherwise("integer").alias("data_type"),
        (F.col("p_size") > 25).alias("nullable"), "p_partkey",
    )
    return sampling.remove(base, "p_partkey", ":column", 20)


_SQL_CATALOG = f"""(SELECT p_brand AS tab, 'c' || p_partkey AS col, CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'integer' END AS data_type,
    p_size > 25 AS nullable FROM part WHERE {sql_pick('p_partkey', ':column')} >= 20)"""


def _declared(t: Tables) -> DataFrame:
    base = t.part.select(
        F.initcap("p_brand").alias("model"), F.col("p_brand").alias("table"),
        F.concat(F.lit("f"), "p_partkey").alias("field"), F.concat(F.lit("c"), "p_partkey").alias("column"),
        F.lit("scalar").alias("kind"),
        F.when((F.col("p_size") % 2 == 0) & (pick("p_partkey", ":type") >= 25), "String").otherwise("Int").alias("type"),
        (F.when(pick("p_partkey", ":null") < 15, F.col("p_size") <= 25).otherwise(F.col("p_size") > 25)).alias("optional"),
        F.lit(False).alias("list"), F.lit(None).cast("string").alias("native_type"),
        F.lit(None).cast("array<int>").alias("native_args"), F.col("p_partkey").cast("int").alias("line"), "p_partkey",
    )
    return expected_type(sampling.remove(base, "p_partkey", ":declared", 10))


_SQL_DECLARED = f"""(SELECT p_brand AS tab, 'c' || p_partkey AS col, p_partkey,
    CASE WHEN p_size % 2 = 0 AND {sql_pick('p_partkey', ':type')} >= 25 THEN 'String' ELSE 'Int' END AS type,
    CASE WHEN p_size % 2 = 0 AND {sql_pick('p_partkey', ':type')} >= 25 THEN 'text' ELSE 'integer' END AS expected,
    CASE WHEN {sql_pick('p_partkey', ':null')} < 15 THEN p_size <= 25 ELSE p_size > 25 END AS optional
    FROM part WHERE {sql_pick('p_partkey', ':declared')} >= 10)"""
_SQL_COLUMN_DIVERGENCE = f"""WITH j AS (SELECT d.*, a.data_type, a.nullable FROM {_SQL_DECLARED} d LEFT JOIN {_SQL_CATALOG} a
      ON a.tab = d.tab AND a.col = d.col WHERE d.tab IN (SELECT tab FROM {_SQL_CATALOG})), v AS (
    SELECT tab, col, p_partkey, 'missing' AS problem, type AS declared, CAST(NULL AS VARCHAR) AS actual FROM j WHERE data_type IS NULL
    UNION ALL SELECT tab, col, p_partkey, 'type', expected, data_type FROM j WHERE data_type <> expected
    UNION ALL SELECT tab, col, p_partkey, 'nullability', CASE WHEN optional THEN 'NULL' ELSE 'NOT NULL' END,
      CASE WHEN nullable THEN 'NULL' ELSE 'NOT NULL' END FROM j WHERE nullable <> optional)"""


@query("column_divergence", _SQL_COLUMN_DIVERGENCE + ' SELECT tab AS "table", col AS "column", problem, declared, actual FROM v')
def column_divergence(t: Tables) -> DataFrame:
    return contract.column_divergence(_declared(t), _catalog(t)).select("table", "column", "problem", "declared", "actual")


def _keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    table = F.concat(F.lit("t"), "l_suppkey")
    columns = F.array(F.concat(F.lit("c"), "l_partkey"), F.lit("id"))
    row_id = F.concat_ws("-", "l_partkey", "l_suppkey")
    based = pairs.withColumn("id", row_id)
    declared = sampling.remove(based, "id", ":dkey", 30).select(
        F.concat(F.lit("T"), "l_suppkey").alias("model"), table.alias("table"),
        F.when(F.col("l_partkey") % 2 == 0, "unique").otherwise("fulltext").alias("kind"),
        columns.alias("columns"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("line"),
    )
    actual = sampling.remove(based, "id", ":akey", 30).select(
        table.alias("table"), F.when(F.col("l_partkey") % 2 == 0, "unique").otherwise("index").alias("kind"),
        columns.alias("columns"), columns.alias("referenced_columns"),
        F.when(pick("id", ":partial") < 10, "id > 0").alias("predicate"), F.concat(F.lit("ix_"), "id").alias("name"),
        F.concat(F.lit("INDEX ix_"), "id").alias("definition"), F.lit(False).alias("has_expression"),
    )
    return declared, actual


_SQL_KEYS = f"""WITH b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_partkey || '-' || l_suppkey AS id FROM lineitem),
    d AS (SELECT 't' || s AS tab, CASE WHEN p % 2 = 0 THEN 'unique' ELSE 'index' END AS kind, 'c' || p AS c, id FROM b WHERE {sql_pick('id', ':dkey')} >= 30),
    a AS (SELECT 't' || s AS tab, CASE WHEN p % 2 = 0 THEN 'unique' ELSE 'index' END AS kind, 'c' || p AS c, id,
            {sql_pick('id', ':partial')} < 10 AS partial FROM b WHERE {sql_pick('id', ':akey')} >= 30),
    v AS (SELECT 'not_applied' AS divergence, tab, kind, c, CAST(NULL AS VARCHAR) AS index_name FROM d WHERE id NOT IN (SELECT id FROM a WHERE NOT partial)
      UNION ALL SELECT 'not_declared', tab, kind, c, 'ix_' || id FROM a WHERE partial OR id NOT IN (SELECT id FROM d))"""


@query("key_divergence", _SQL_KEYS + ' SELECT divergence, tab AS "table", kind, [c, \'id\'] AS columns, index_name FROM v')
def key_divergence(t: Tables) -> DataFrame:
    return contract.key_divergence(*_keys(t)).select("divergence", "table", "kind", "columns", "index_name")


@query(
    "divergence_findings",
    _SQL_KEYS.replace("WITH b AS", _SQL_COLUMN_DIVERGENCE.replace(", v AS (", ", cv AS (") + ", b AS") + """
      SELECT rule_id, count(*) AS findings, count(DISTINCT rule_id) AS rules FROM (
        SELECT CASE divergence WHEN 'not_applied' THEN 'DECLARED_INDEX_NOT_APPLIED' ELSE 'INDEX_NOT_DECLARED' END AS rule_id FROM v
        UNION ALL SELECT CASE problem WHEN 'type' THEN 'COLUMN_TYPE_MISMATCH' WHEN 'missing' THEN 'COLUMN_NOT_APPLIED'
          ELSE 'COLUMN_NULLABILITY_MISMATCH' END FROM cv) GROUP BY rule_id""",
)
def divergence_findings(t: Tables) -> DataFrame:
    keys = contract.key_divergence(*_keys(t))
    columns = contract.column_divergence(_declared(t), _catalog(t))
    found = contract.divergence_findings(keys, columns, "schema.json")
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("rule_id").alias("rules"))


@query(
    "fk_divergence",
    f"""WITH d AS (SELECT DISTINCT 't' || l_suppkey AS tab, 'p' || l_partkey AS ref FROM lineitem WHERE {sql_pick('l_partkey', ':fk')} >= 30),
        a AS (SELECT DISTINCT 't' || l_suppkey AS tab, 'p' || l_partkey AS ref FROM lineitem WHERE {sql_pick('l_suppkey', ':fk')} >= 30)
        SELECT tab AS "table", ['part_id'] AS columns, ref AS referenced_table, 'not_applied' AS divergence FROM (SELECT * FROM d EXCEPT SELECT * FROM a)
        UNION ALL SELECT tab, ['part_id'], ref, 'not_declared' FROM (SELECT * FROM a EXCEPT SELECT * FROM d)""",
)
def fk_divergence(t: Tables) -> DataFrame:
    rows = lambda row_id: sampling.remove(t.lineitem, row_id, ":fk", 30).select(
        F.concat(F.lit("t"), "l_suppkey").alias("table"), F.array(F.lit("part_id")).alias("columns"),
        F.concat(F.lit("p"), "l_partkey").alias("referenced_table"),
    )
    declared = rows("l_partkey").withColumns({"foreign_key_on": F.lit("self"), "referenced_model": F.lit(None).cast("string")})
    return contract.fk_divergence(declared, rows("l_suppkey"))


@query(
    "table_divergence",
    f"""WITH d AS (SELECT 't' || c_custkey AS tab FROM customer WHERE {sql_pick('c_custkey', ':d')} >= 20),
        a AS (SELECT 't' || c_custkey AS tab FROM customer WHERE {sql_pick('c_custkey', ':a')} >= 20)
        SELECT tab AS "table", 'not_applied' AS divergence FROM d WHERE tab NOT IN (SELECT tab FROM a)
        UNION ALL SELECT tab, 'not_declared' FROM a WHERE tab NOT IN (SELECT tab FROM d)""",
)
def table_divergence(t: Tables) -> DataFrame:
    named = lambda salt: sampling.remove(t.customer, "c_custkey", salt, 20).select(F.concat(F.lit("t"), "c_custkey").alias("table"))
    return contract.table_divergence(named(":d"), named(":a"))


@query(
    "schema_view",
    f"""SELECT coalesce(d.tab, a.tab) AS "table", declared, actual FROM
          (SELECT tab, list(col || ':' || type ORDER BY col || ':' || type) AS declared FROM {_SQL_DECLARED} GROUP BY tab) d
          FULL JOIN (SELECT tab, list(col || ':' || data_type ORDER BY col || ':' || data_type) AS actual FROM {_SQL_CATALOG} GROUP BY tab) a ON a.tab = d.tab""",
)
def schema_view(t: Tables) -> DataFrame:
    return contract.schema_view(_declared(t), _catalog(t))


def _broken_orders(t: Tables) -> DataFrame:
    df = sampling.corrupt(t.orders, "o_custkey", "o_orderkey", ":cust", 20, F.lit(None))
    df = sampling.corrupt(df, "o_orderstatus", "o_orderkey", ":status", 9, F.lit("X"))
    copies = {"o_totalprice": F.lit(0.0)}
    df = sampling.duplicate(df, "o_orderkey", ":copy", 12, copies)
    return df.withColumn("ref", F.when(pick("o_orderkey", ":ref") < 33, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string")))


_SQL_BROKEN = f"""(WITH c AS (SELECT o_orderkey, CASE WHEN {sql_pick('o_orderkey', ':cust')} >= 20 THEN o_custkey END AS o_custkey,
      CASE WHEN {sql_pick('o_orderkey', ':status')} < 9 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
      CASE WHEN {sql_pick('o_orderkey', ':ref')} < 33 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS ref FROM orders)
    SELECT * FROM c UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 0.0, ref FROM c WHERE {sql_pick('o_orderkey', ':copy')} < 12)"""


@query(
    "verify_contract",
    f"""SELECT 'orders' AS "table", 'not_null' AS "check", 'o_orderkey' AS target, count(*) FILTER (WHERE o_orderkey IS NULL) AS violations FROM {_SQL_BROKEN}
        UNION ALL SELECT 'orders', 'not_null', 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM {_SQL_BROKEN}
        UNION ALL SELECT 'orders', 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM {_SQL_BROKEN}
        UNION ALL SELECT 'orders', 'enum', 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) FROM {_SQL_BROKEN}
        UNION ALL SELECT 'orders', 'type', 'ref:bigint', count(*) FILTER (WHERE try_cast(ref AS BIGINT) IS NULL) FROM {_SQL_BROKEN}""",
)
def verify_contract(t: Tables) -> DataFrame:
    return contract.verify_contract(
        _broken_orders(t), "orders", ["o_orderkey", "o_custkey"], [["o_orderkey"]],
        {"o_orderstatus": ["F", "O", "P"]}, {"ref": "bigint"},
    )


@query(
    "expected_types",
    f"""SELECT col AS "column", expected AS expected_type, optional AS expected_nullable,
          CASE expected WHEN 'text' THEN 'string' ELSE 'int' END AS spark_type, false AS narrowed FROM {_SQL_DECLARED}""",
)
def expected_types(t: Tables) -> DataFrame:
    return _declared(t).select(
        "column", "expected_type", "expected_nullable", spark_type("expected_type").alias("spark_type"),
        narrowed("expected_type").alias("narrowed"),
    )


# ---- corruption ------------------------------------------------------------------------------------

_RECENT = "ts >= (SELECT date_trunc('day', max(ts)) FROM events)"
_SQL_CORRUPT = f"""(WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 3 AS g FROM events WHERE {_RECENT}),
    h AS (SELECT g, min(event_id) AS head FROM r GROUP BY g), m AS (SELECT event_id, head FROM r JOIN h USING (g) WHERE {sql_pick('head', ':retry')} < 230)
    SELECT e.event_id, ts, CASE WHEN {_RECENT} AND {sql_pick('e.event_id', ':user')} < 166 THEN NULL ELSE user_id END AS user_id,
      CASE WHEN {_RECENT} AND {sql_pick('e.event_id', ':type')} < 180 THEN 'error' ELSE event_type END AS event_type,
      CASE WHEN head IS NULL THEN value ELSE CAST(head AS DOUBLE) END AS value, props FROM events e LEFT JOIN m ON m.event_id = e.event_id)"""


def event_days(t: Tables) -> list[profile.Window]:
    """One window for each day from the first event's to the last one's."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    oldest, newest = t.events.agg(day(F.min("ts")), day(F.max("ts"))).first()
    if oldest is None:
        return profile.consecutive_windows(datetime(2000, 1, 1), 1, 1)
    end = newest + timedelta(days=1)
    return profile.consecutive_windows(end, (end - oldest).days, 1)


def corrupted_events(t: Tables, days: list[profile.Window] | None = None) -> DataFrame:
    """Events whose last day lost user ids, repeats values and drifted towards one type."""
    recent = F.col("ts") >= clock((days or event_days(t))[-1][0])
    df = sampling.corrupt(t.events, "user_id", "event_id", ":user", 166, F.lit(None), recent)
    df = sampling.corrupt(df, "event_type", "event_id", ":type", 180, F.lit("error"), recent)
    return sampling.corrupt_groups(df, "value", "event_id", ["ts", "event_id"], ":retry", 230, recent)


@query("corrupt_events", f"SELECT * FROM {_SQL_CORRUPT}")
def corrupt_events(t: Tables) -> DataFrame:
    return corrupted_events(t)


# ---- anomalies -------------------------------------------------------------------------------------

_WATCHED = SCHEMA["events"]


def _days(df: DataFrame, windows) -> tuple[DataFrame, DataFrame]:
    return profile.settle(profile.profile({"events": df}, windows, {"events": "ts"}, {"events": _WATCHED}))


def _pair(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Columns and categories of the clean history and of the corrupted last day."""
    days = event_days(t)
    return (*_days(t.events, days), *_days(corrupted_events(t, days), days[-1:]))


def _sql_profiles(source: str, name: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT date_trunc('day', ts)::TIMESTAMP AS ws, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {source}" for c in _WATCHED
    )
    return f"""{name}_h AS (SELECT ws, col, v, count(*) AS n FROM ({long}) GROUP BY ALL),
      {name}_w AS (SELECT unnest(generate_series(min(ws), max(ws), INTERVAL 1 DAY)) AS ws FROM {name}_h),
      {name}_p AS (SELECT w.ws, k.col, coalesce(sum(n), 0) AS r, coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS nn, count(v) AS d
                   FROM {name}_w w CROSS JOIN (SELECT DISTINCT col FROM {name}_h) k LEFT JOIN {name}_h h ON h.ws = w.ws AND h.col = k.col GROUP BY ALL),
      {name}_c AS (SELECT h.ws, h.col, h.v, h.n / p.nn AS s FROM {name}_h h JOIN {name}_p p USING (ws, col)
                   WHERE h.v IS NOT NULL AND p.d <= 50 AND p.d < p.nn),
      {name}_r AS (SELECT ws, col, (r - nn) / nullif(r, 0) AS null_rate, (nn - d) / nullif(nn, 0) AS duplicate_rate FROM {name}_p)"""


#: Detector verdicts in SQL over obs(key columns, o) and hist(key columns, ws, x).
def _sql_judge(key: str) -> str:
    return f"""n AS (SELECT {key}, count(*) AS n, CASE WHEN min(x) = max(x) THEN min(x) ELSE avg(x) END AS m,
        CASE WHEN min(x) = max(x) THEN 0 ELSE stddev_samp(x) END AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
        quantile_cont(x, 0.75) AS q3 FROM hist GROUP BY {key}),
      l AS (SELECT {key}, CASE WHEN min(x) = max(x) THEN min(x) ELSE avg(x) END AS m, CASE WHEN min(x) = max(x) THEN 0 ELSE stddev_samp(x) END AS sd
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ws DESC) AS back FROM hist) WHERE back <= 6 GROUP BY {key}),
      d AS (SELECT {key}, 'zscore' AS detector, o, coalesce(n, 0) AS n, m AS center, sd AS spread, m - 3 * sd AS lo, m + 3 * sd AS hi FROM obs LEFT JOIN n USING ({key})
        UNION ALL SELECT {key}, 'iqr', o, coalesce(n, 0), q2, q3 - q1, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1) FROM obs LEFT JOIN n USING ({key})
        UNION ALL SELECT {key}, 'moving_average', o, coalesce(n, 0), l.m, l.sd, l.m - 3 * l.sd, l.m + 3 * l.sd FROM obs LEFT JOIN n USING ({key}) LEFT JOIN l USING ({key})),
      j AS (SELECT *, n >= 5 AS ev, n >= 5 AND (o < lo OR o > hi) AS an, CASE WHEN n >= 5 AND o < lo THEN 'below' WHEN n >= 5 AND o > hi THEN 'above' END AS side FROM d),
      votes AS (SELECT {key}, any_value(o) AS o, count(*) FILTER (WHERE an) AS fired, count(*) FILTER (WHERE ev) AS evaluated,
        2 * count(*) FILTER (WHERE an) > count(*) FILTER (WHERE ev) AND count(*) FILTER (WHERE ev) > 0 AS anomalous,
        CASE WHEN count(DISTINCT side) = 1 THEN max(side) WHEN count(DISTINCT side) > 1 THEN 'mixed' END AS direction FROM j GROUP BY {key})"""


_SQL_LOO = """grid AS (SELECT w.ws, v.col, v.v, coalesce(c.s, 0) AS s FROM (SELECT DISTINCT ws, col FROM b_c) w
        JOIN (SELECT DISTINCT col, v FROM b_c) v USING (col) LEFT JOIN b_c c ON c.ws = w.ws AND c.col = v.col AND c.v = v.v),
      m AS (SELECT col, count(DISTINCT ws) AS m FROM b_c GROUP BY col),
      loo AS (SELECT ws, col, round(sum(abs(s - (t - s) / (m - 1))) / 2, 12) AS x FROM
        (SELECT *, sum(s) OVER (PARTITION BY col, v) AS t FROM grid) JOIN m USING (col) WHERE m >= 2 GROUP BY ALL)"""
_SQL_DETECT = f"""WITH {_sql_profiles('events', 'b')}, {_sql_profiles(f"(SELECT * FROM {_SQL_CORRUPT} WHERE {_RECENT})", 'c')}, {_SQL_LOO},
      mean AS (SELECT col, v, sum(s) / any_value(m) AS q FROM grid JOIN m USING (col) GROUP BY ALL),
      shift AS (SELECT coalesce(c.col, q.col) AS col, round(sum(abs(coalesce(c.s, 0) - coalesce(q, 0))) / 2, 12) AS o
        FROM c_c c FULL JOIN mean q ON q.col = c.col AND q.v = c.v GROUP BY 1),
      obs AS (SELECT col, 'null_rate' AS metric, null_rate AS o FROM c_r
        UNION ALL SELECT col, 'duplicate_rate', duplicate_rate FROM c_r WHERE col NOT IN (SELECT col FROM m) AND duplicate_rate IS NOT NULL
        UNION ALL SELECT col, 'distribution_shift', o FROM shift JOIN m USING (col) WHERE m >= 2 AND col IN (SELECT col FROM c_c)),
      hist AS (SELECT col, 'null_rate' AS metric, ws, null_rate AS x FROM b_r WHERE null_rate IS NOT NULL
        UNION ALL SELECT col, 'duplicate_rate', ws, duplicate_rate FROM b_r WHERE duplicate_rate IS NOT NULL
        UNION ALL SELECT col, 'distribution_shift', ws, x FROM loo), {_sql_judge('col, metric')}"""


def _analyses(t: Tables) -> tuple[DataFrame, tuple]:
    pair = _pair(t)
    return anomaly.detect(*pair), pair


@query(
    "anomaly_detect",
    _SQL_DETECT + """ SELECT 'events' AS "table", col AS "column", metric, round(o, 9) AS observation, fired, evaluated, anomalous, direction FROM votes""",
)
def anomaly_detect(t: Tables) -> DataFrame:
    judged, _ = _analyses(t)
    return judged.select("table", "column", "metric", F.round("observation", 9).alias("observation"), "fired", "evaluated", "anomalous", "direction")


@query(
    "anomaly_ranges",
    _SQL_DETECT + """ SELECT col AS "column", metric, detector, ev AS evaluated, an AS anomalous, n AS history_size, round(center, 9) AS center,
        round(spread, 9) AS spread, round(lo, 9) AS lower, round(hi, 9) AS upper, CASE WHEN spread <> 0 THEN round((o - center) / spread, 6) END AS deviation,
        spread = 0 AS degenerate FROM j""",
)
def anomaly_ranges(t: Tables) -> DataFrame:
    judged, _ = _analyses(t)
    rows = judged.select("column", "metric", F.explode("detections").alias("d"))
    return rows.select(
        "column", "metric", "d.detector", "d.evaluated", "d.anomalous", F.col("d.history_size").cast("bigint").alias("history_size"),
        *[F.round(f"d.{c}", 9).alias(c) for c in ("center", "spread", "lower", "upper")],
        F.round("d.deviation", 6).alias("deviation"), "d.degenerate",
    )


def _single_rate(metric: str, column: str):
    def run(t: Tables) -> DataFrame:
        judged, _ = _analyses(t)
        return judged.where((F.col("metric") == metric) & (F.col("column") == column)).select(
            "column", F.round("observation", 9).alias("observation"), "fired", "anomalous"
        )
    return run


for _name, _metric, _column in (("anomaly_null_spike", "null_rate", "user_id"), ("anomaly_duplicate_spike", "duplicate_rate", "value"),
                                ("anomaly_distribution_shift", "distribution_shift", "event_type")):
    query(_name, _SQL_DETECT + f""" SELECT col AS "column", round(o, 9) AS observation, fired, anomalous FROM votes
        WHERE metric = '{_metric}' AND col = '{_column}'""")(_single_rate(_metric, _column))


@query(
    "anomaly_findings",
    _SQL_DETECT + """ SELECT rule_id, file, confidence, substr(sha256(rule_id || chr(0) || file || chr(0) || col || chr(0) || metric), 1, 32) AS fingerprint FROM (
        SELECT *, CASE metric WHEN 'null_rate' THEN 'NULL_SPIKE' WHEN 'duplicate_rate' THEN 'DUPLICATE_SPIKE' ELSE 'DISTRIBUTION_SHIFT' END AS rule_id,
          'table:events' AS file, CASE WHEN fired = evaluated THEN 'HIGH' WHEN 2 * fired > evaluated THEN 'MEDIUM' ELSE 'LOW' END AS confidence
        FROM votes WHERE anomalous AND direction = 'above')""",
)
def anomaly_findings(t: Tables) -> DataFrame:
    judged, pair = _analyses(t)
    found = anomaly.anomaly_findings(judged, anomaly.explain(pair[1], pair[3]))
    return found.select("rule_id", "file", "confidence", "fingerprint")


@query(
    "anomaly_report",
    _SQL_DETECT + """ SELECT metric, count(*) AS analyzed, count(*) FILTER (WHERE evaluated > 0) AS evaluated, count(*) FILTER (WHERE anomalous) AS anomalous,
        count(*) FILTER (WHERE anomalous AND direction = 'above') AS above, count(*) FILTER (WHERE anomalous AND direction = 'below') AS below,
        count(*) FILTER (WHERE anomalous AND direction = 'mixed') AS mixed FROM votes GROUP BY metric""",
)
def anomaly_report(t: Tables) -> DataFrame:
    return anomaly.report(_analyses(t)[0])


@query(
    "anomaly_explanation",
    _SQL_DETECT + """ SELECT col AS "column", v AS value, round(q, 9) AS baseline_share, round(s, 9) AS current_share FROM (
        SELECT col, v, q, s, row_number() OVER (PARTITION BY col ORDER BY round(abs(s - q), 12) DESC, v) AS rank FROM (
          SELECT coalesce(c.col, q.col) AS col, coalesce(c.v, q.v) AS v, coalesce(q, 0) AS q, coalesce(c.s, 0) AS s
          FROM c_c c FULL JOIN mean q ON q.col = c.col AND q.v = c.v)) WHERE rank <= 5""",
)
def anomaly_explanation(t: Tables) -> DataFrame:
    pair = _pair(t)
    rows = anomaly.explain(pair[1], pair[3]).select("column", F.explode("explanation").alias("e"))
    return rows.select("column", "e.value", F.round("e.baseline_share", 9).alias("baseline_share"), F.round("e.current_share", 9).alias("current_share"))


@query(
    "data_quality_view",
    _SQL_DETECT + """ SELECT col AS "column", any_value(rows) AS rows, list(metric || ':' || fired || '/' || evaluated ORDER BY metric) AS metrics
        FROM votes JOIN (SELECT col, r::BIGINT AS rows FROM c_p) USING (col) GROUP BY col""",
)
def data_quality_view(t: Tables) -> DataFrame:
    judged, pair = _analyses(t)
    view = anomaly.data_quality_view(judged, pair[2])
    short = F.transform("metrics", lambda m: F.concat(m["metric"], F.lit(":"), m["fired"], F.lit("/"), m["evaluated"]))
    return view.select("column", "rows", short.alias("metrics"))


@query(
    "flagged_columns",
    _SQL_DETECT + """ SELECT count(*) AS columns, count(*) FILTER (WHERE f) AS flagged, 1 AS tables FROM (SELECT col, bool_or(anomalous) AS f FROM votes GROUP BY col)""",
)
def flagged_columns(t: Tables) -> DataFrame:
    judged, pair = _analyses(t)
    return anomaly.flagged_columns(anomaly.data_quality_view(judged, pair[2]))


@query(
    "leave_one_out",
    f"""WITH {_sql_profiles('events', 'b')}, {_SQL_LOO} SELECT col AS "column", ws AS window_start, round(x, 9) AS distance FROM loo""",
)
def leave_one_out(t: Tables) -> DataFrame:
    distances = anomaly.leave_one_out(_days(t.events, event_days(t))[1])
    return distances.select("column", "window_start", F.round("distance", 9).alias("distance"))


@query(
    "total_variation",
    """WITH n AS (SELECT l_returnflag AS k, l_linenumber AS v, count(*) FILTER (WHERE l_linestatus = 'O') AS a,
          count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity < 25) AS b FROM lineitem GROUP BY ALL),
        s AS (SELECT k, v, a / sum(a) OVER (PARTITION BY k) AS p, b / sum(b) OVER (PARTITION BY k) AS q FROM n)
       SELECT k AS "table", round(sum(abs(p - q)) / 2, 9) AS distance FROM s GROUP BY k""",
)
def total_variation(t: Tables) -> DataFrame:
    def mix(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy(F.col("l_returnflag").alias("table"), F.col("l_linenumber").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return anomaly.shares(counted.withColumns({"column": F.lit("c"), "window_start": F.lit(0)}))
    left = mix(t.lineitem.where(F.col("l_linestatus") == "O"))
    right = mix(t.lineitem.where((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 25)))
    result = anomaly.total_variation(left, right, ["table"])
    return result.select("table", F.round("distance", 9).alias("distance"))


def sql_backtest(source: str) -> str:
    return f"""WITH {_sql_profiles(source, 'b')}, ix AS (SELECT ws, col, null_rate, duplicate_rate, row_number() OVER (PARTITION BY col ORDER BY ws) - 1 AS i FROM b_r),
      bc AS (SELECT b_c.*, i FROM b_c JOIN ix USING (ws, col)),
      pm AS (SELECT x.col, x.i, count(DISTINCT c.ws) AS m FROM ix x JOIN bc c ON c.col = x.col AND c.i < x.i WHERE x.i >= 5 GROUP BY ALL),
      vals AS (SELECT DISTINCT col, v FROM bc), wins AS (SELECT DISTINCT col, i, ws FROM bc),
      dense AS (SELECT w.col, w.i, w.ws, v.v, coalesce(c.s, 0) AS s FROM wins w JOIN vals v USING (col) LEFT JOIN bc c ON c.col = w.col AND c.i = w.i AND c.v = v.v),
      pre AS (SELECT p.col, p.i, p.m, d.ws, d.v, d.s, sum(d.s) OVER (PARTITION BY p.col, p.i, d.v) AS t FROM pm p JOIN dense d ON d.col = p.col AND d.i < p.i WHERE p.m >= 2),
      hs AS (SELECT col, i, ws, round(sum(abs(s - (t - s) / (m - 1))) / 2, 12) AS x FROM pre GROUP BY ALL),
      os AS (SELECT q.col, q.i, round(sum(abs(d.s - q.q)) / 2, 12) AS o FROM (SELECT col, i, v, any_value(t) / any_value(m) AS q FROM pre GROUP BY ALL) q
        JOIN dense d ON d.col = q.col AND d.i = q.i AND d.v = q.v GROUP BY ALL),
      obs AS (SELECT col, i, 'null_rate' AS metric, null_rate AS o FROM ix WHERE i >= 5 AND null_rate IS NOT NULL
        UNION ALL SELECT col, i, 'duplicate_rate', duplicate_rate FROM ix WHERE i >= 5 AND duplicate_rate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pm WHERE pm.col = ix.col AND pm.i = ix.i)
        UNION ALL SELECT col, i, 'distribution_shift', o FROM os),
      hist AS (SELECT a.col, a.i, 'null_rate' AS metric, b.ws, b.null_rate AS x FROM ix a JOIN ix b ON a.col = b.col AND b.i < a.i WHERE a.i >= 5 AND b.null_rate IS NOT NULL
        UNION ALL SELECT a.col, a.i, 'duplicate_rate', b.ws, b.duplicate_rate FROM ix a JOIN ix b ON a.col = b.col AND b.i < a.i WHERE a.i >= 5 AND b.duplicate_rate IS NOT NULL
        UNION ALL SELECT col, i, 'distribution_shift', ws, x FROM hs), {_sql_judge('col, i, metric')}"""


@query(
    "backtest_summary",
    sql_backtest("events") + """ SELECT 'detector' AS kind, detector AS name, count(*) AS evaluations, count(*) FILTER (WHERE an) AS alarms,
          count(*) FILTER (WHERE an AND side = 'above') AS alarms_above FROM j WHERE ev GROUP BY detector
        UNION ALL SELECT 'metric', metric, count(*), count(*) FILTER (WHERE anomalous), count(*) FILTER (WHERE anomalous AND direction = 'above') FROM votes WHERE evaluated > 0 GROUP BY metric
        UNION ALL SELECT 'vote', 'all', count(*), count(*) FILTER (WHERE anomalous), count(*) FILTER (WHERE anomalous AND direction = 'above') FROM votes WHERE evaluated > 0""",
)
def backtest_summary(t: Tables) -> DataFrame:
    return anomaly.backtest_summary(anomaly.backtest(*_days(t.events, event_days(t))))


@query(
    "backtest_false_alarms",
    sql_backtest("events") + """ SELECT col AS "column", metric, ws AS window_start, direction, round(o, 9) AS observation, fired, evaluated
        FROM votes JOIN (SELECT col, i, ws FROM ix) USING (col, i) WHERE anomalous""",
)
def backtest_false_alarms(t: Tables) -> DataFrame:
    alarms = anomaly.false_alarms(anomaly.backtest(*_days(t.events, event_days(t))))
    return alarms.select("column", "metric", "window_start", "direction", F.round("observation", 9).alias("observation"), "fired", "evaluated")


@query(
    "universe_units",
    f"""WITH {_sql_profiles('events', 'b')}, k AS (SELECT DISTINCT col FROM b_c), a AS (SELECT DISTINCT col FROM b_r)
        SELECT 'null_spike' AS problem_type, count(*) AS units FROM a UNION ALL SELECT 'distribution_shift', count(*) FROM k
        UNION ALL SELECT 'duplicate_spike', count(*) FROM a WHERE col NOT IN (SELECT col FROM k)""",
)
def universe_units(t: Tables) -> DataFrame:
    """How many (column, metric) series could carry each data-quality problem."""
    columns, categories = _days(t.events, event_days(t))
    carried = categories.select("table", "column").distinct().withColumn("c", F.lit(True))
    kinds = columns.select("table", "column").distinct().join(carried, ["table", "column"], "left")
    units = kinds.select(
        F.explode(F.array(F.lit("null_spike"), F.when(F.col("c").isNotNull(), "distribution_shift").otherwise("duplicate_spike"))).alias("problem_type")
    )
    return units.groupBy("problem_type").agg(F.count(F.lit(1)).alias("units"))
