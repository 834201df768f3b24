"""Event, statement, load-run and scan-history queries on the driver tables.

An event is one operation: its request is the user's day, its route the user's number modulo 10, its
model the event type, its duration the value. It issues one to three statements.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.exprs import pick
from ..operators import behaviour, loadruns, sampling, scans
from ..session import cut, fresh_path
from ..sources import events as ev
from ..sources import files
from ..sources.tables import Tables
from .quality import sql_pick
from .registry import query

# ---- operations and their statements ---------------------------------------------------------------


def nested_events(t: Tables) -> DataFrame:
    statement = lambda sql, kind: F.struct(
        sql.alias("sql"), F.lit(1).cast("bigint").alias("paramCount"), F.lit(kind).alias("kind"),
        F.col("value").alias("durationMs"), F.col("user_id").alias("rows"),
    )
    first = F.format_string('SELECT * FROM "%s" -- all\n WHERE "id" = %d', "event_type", "event_id")
    second = F.format_string("select COUNT(*) from \"tag\" WHERE \"k\" IN (%d, %d) AND name = 'it''s'", "event_id", "user_id")
    third = F.format_string("UPDATE log SET n = %d", "event_id")
    kind = F.col("event_type")
    statements = F.array_compact(
        F.array(
            statement(first, "query"), F.when(kind == "view", statement(second, "query")),
            F.when(kind == "error", statement(third, "execute")),
        )
    )
    inside = pick("event_id", ":request") >= 5
    return t.events.select(
        F.lit(1).alias("schemaVersion"), F.lit("shop").alias("app"), F.concat(F.lit("op"), "event_id").alias("operationId"),
        F.when(inside, F.concat_ws(":", "user_id", F.to_date("ts"))).alias("requestId"),
        F.concat(F.lit("/r/"), F.col("user_id") % 10).alias("route"), F.col("event_type").alias("model"),
        F.lit("findMany").alias("operation"), F.col("ts").alias("startedAt"), F.col("value").alias("durationMs"),
        F.col("user_id").alias("rowsReturned"), (kind == "error").alias("error"), statements.alias("statements"),
    )


_SQL_OPS = f"""ops AS (SELECT 'op' || event_id AS operation_id, CASE WHEN {sql_pick('event_id', ':request')} >= 5 THEN user_id || ':' || CAST(ts AS DATE) END AS request_id,
    '/r/' || (user_id % 10) AS route, event_type AS model, ts AS started_at, value, event_id, user_id FROM events)"""
_SQL_STATEMENTS = f"""{_SQL_OPS}, st0 AS (
    SELECT *, 0 AS position, 'select * from "' || model || '" where "id"=?' AS norm FROM ops
    UNION ALL SELECT *, 1, 'select count(*) from "tag" where "k" in(?) and name=?' FROM ops WHERE model = 'view'
    UNION ALL SELECT *, 1, 'update log set n=?' FROM ops WHERE model = 'error'),
  st AS (SELECT *, substr(sha256(norm), 1, 16) AS fp FROM st0)"""


def _statements(t: Tables) -> DataFrame:
    return ev.explode_statements(nested_events(t))


def _stored_statements(t: Tables) -> DataFrame:
    """The statements as an event store keeps them: shaped once, on the way in."""
    return cut(_statements(t))


def _operations(t: Tables) -> DataFrame:
    return ev.operations(nested_events(t))


@query(
    "explode_statements",
    f"WITH {_SQL_STATEMENTS} SELECT operation_id, position, fp AS fingerprint, norm AS normalized_sql, value AS duration_ms, route FROM st",
)
def explode_statements(t: Tables) -> DataFrame:
    return _statements(t).select("operation_id", "position", "fingerprint", "normalized_sql", "duration_ms", "route")


@query(
    "read_events",
    f"""SELECT reason, count(*) AS events, round(sum(CASE WHEN reason IS NULL THEN value END), 2) AS duration FROM (SELECT value,
          CASE WHEN {sql_pick('event_id', ':cut')} < 8 THEN 'not a JSON object' WHEN {sql_pick('event_id', ':key')} < 8 THEN 'keys'
            WHEN {sql_pick('event_id', ':type')} < 8 THEN 'types' WHEN {sql_pick('event_id', ':version')} < 8 THEN 'schemaVersion'
            WHEN {sql_pick('event_id', ':empty')} < 8 THEN 'operationId' WHEN {sql_pick('event_id', ':neg')} < 8 THEN 'statements' END AS reason
          FROM events) GROUP BY reason""",
)
def read_events(t: Tables) -> DataFrame:
    """Events written as JSON lines, some of them broken, and read back."""
    path = fresh_path(t.spark, "events-json")
    kept = nested_events(t).withColumn("_id", F.substring("operationId", 3, 20))
    broken = kept.withColumns({
        "operationId": F.when(pick("_id", ":empty") < 8, F.lit("")).otherwise(F.col("operationId")),
        "schemaVersion": F.when(pick("_id", ":version") < 8, F.lit(2)).otherwise(F.col("schemaVersion")),
        "statements": F.when(
            pick("_id", ":neg") < 8, F.transform("statements", lambda s: s.withField("durationMs", F.lit(-1.0)))
        ).otherwise(F.col("statements")),
    })
    text = F.to_json(F.struct(*[c for c in broken.columns if c != "_id"]), {"ignoreNullFields": "false"})
    text = F.when(pick("_id", ":type") < 8, F.regexp_replace(text, '"rowsReturned":[^,]*', '"rowsReturned":"many"')).otherwise(text)
    text = F.when(pick("_id", ":key") < 8, F.regexp_replace(text, "^[{]", '{"extra":1,')).otherwise(text)
    text = F.when(pick("_id", ":cut") < 8, F.lit('{"schemaVersion":')).otherwise(text)
    broken.select(text.alias("value")).write.text(path)
    valid, quarantine = ev.read_events(t.spark, path)
    both = valid.select(F.lit(None).cast("string").alias("reason"), "durationMs").unionByName(
        quarantine.select("reason", F.lit(None).cast("double").alias("durationMs"))
    )
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("durationMs"), 2).alias("duration"))


def _resent(t: Tables) -> DataFrame:
    """Operations with some of them sent again an hour later."""
    ops = _operations(t).select("operation_id", "route", "started_at", "duration_ms").withColumn("sent_at", F.col("started_at"))
    again = ops.where(pick("operation_id", ":retry") < 50)
    return ops.unionByName(again.withColumns({"sent_at": F.col("sent_at") + F.expr("INTERVAL 1 HOUR"), "duration_ms": F.col("duration_ms") + 1}))


@query("insert_once", "SELECT 'op' || event_id AS operation_id, value AS duration_ms, ts AS sent_at FROM events")
def insert_once(t: Tables) -> DataFrame:
    return ev.first_by_key(_resent(t), ["operation_id"], ["sent_at"]).select("operation_id", "duration_ms", "sent_at")


@query("dedupe_events", "SELECT route, count(*) AS operations FROM (SELECT '/r/' || (user_id % 10) AS route FROM events) GROUP BY route")
def dedupe_events(t: Tables) -> DataFrame:
    return ev.dedupe_events(_resent(t)).groupBy("route").agg(F.count(F.lit(1)).alias("operations"))


@query(
    "latest_by_key",
    """SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""",
)
def latest_by_key(t: Tables) -> DataFrame:
    latest = ev.latest_by_key(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "ts", "value")


@query(
    "versioned_hits",
    """WITH l AS (SELECT user_id, event_type, arg_max(event_id % 3, (ts, event_id)) AS version, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
         w AS (SELECT DISTINCT user_id, event_type, (user_id + 1) % 3 AS version FROM events)
       SELECT l.* FROM l JOIN w USING (user_id, event_type, version)""",
)
def versioned_hits(t: Tables) -> DataFrame:
    """Stored rows asked for in one version each: a row written by another version is no hit."""
    stored = ev.latest_by_key(t.events.withColumn("version", F.col("event_id") % 3), ["user_id", "event_type"], ["ts", "event_id"])
    wanted = t.events.select("user_id", "event_type", ((F.col("user_id") + 1) % 3).alias("version"))
    return ev.versioned_hits(stored, wanted, ["user_id", "event_type"]).select("user_id", "event_type", "version", "value")


@query(
    "operations_nested",
    f"""WITH {_SQL_STATEMENTS}, page AS (SELECT * FROM ops WHERE route = '/r/3' ORDER BY started_at DESC, operation_id LIMIT 100)
        SELECT p.operation_id, p.started_at, coalesce((SELECT list(position || ':' || fp ORDER BY position) FROM st WHERE st.operation_id = p.operation_id AND position > 0), []) AS statements FROM page p""",
)
def operations_nested(t: Tables) -> DataFrame:
    later = _statements(t).where(F.col("position") > 0)
    nested = ev.operations_nested(_operations(t), later, app="shop", route="/r/3", limit=100)
    text = F.transform("statements", lambda s: F.concat_ws(":", s["position"], s["fingerprint"]))
    return nested.select("operation_id", "started_at", text.alias("statements"))


# ---- query shapes -----------------------------------------------------------------------------------


def _lookups(t: Tables) -> DataFrame:
    """One lookup per order, listing the order's part keys."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ", ")
    listed = t.lineitem.groupBy("l_orderkey").agg(keys.alias("keys"))
    text = "/* order */ SELECT * FROM part  WHERE p_partkey IN (%s) AND p_name <> 'a;b' -- tail"
    return listed.select("l_orderkey", F.format_string(text, "keys").alias("sql"))


_SQL_LOOKUPS = """(SELECT l_orderkey, list_transform(list_sort(list(DISTINCT l_partkey)), lambda x: CAST(x AS VARCHAR)) AS keys FROM lineitem GROUP BY l_orderkey)"""


@query(
    "sql_fingerprint",
    f"""SELECT 'select * from part where p_partkey in(?) and p_name<>?' AS shape,
          substr(sha256('select * from part where p_partkey in(?) and p_name<>?'), 1, 16) AS fingerprint, count(*) AS statements FROM {_SQL_LOOKUPS}""",
)
def sql_fingerprint(t: Tables) -> DataFrame:
    """Every order's lookup has one shape, however many keys it lists."""
    return _lookups(t).groupBy(exprs.query_shape("sql").alias("shape"), exprs.fingerprint("sql").alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("statements")
    )


@query(
    "naive_normalize",
    f"""SELECT 'SELECT * FROM part WHERE p_partkey IN (' || array_to_string(list_transform(keys, lambda x: '?'), ', ') || ') AND p_name <> ?' AS shape,
          count(*) AS statements FROM {_SQL_LOOKUPS} GROUP BY 1""",
)
def naive_normalize(t: Tables) -> DataFrame:
    return _lookups(t).groupBy(exprs.naive_normalize("sql").alias("shape")).agg(F.count(F.lit(1)).alias("statements"))


@query(
    "lexical_normalize",
    f"SELECT 'SELECT * FROM part WHERE p_partkey IN (?) AND p_name <> ?' AS shape, count(*) AS statements FROM {_SQL_LOOKUPS}",
)
def lexical_normalize(t: Tables) -> DataFrame:
    return _lookups(t).groupBy(exprs.lexical_normalize("sql").alias("shape")).agg(F.count(F.lit(1)).alias("statements"))


@query(
    "text_normalize",
    """SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\$[0-9]+', '?', 'g'),
          '(^|[^\\w$"])-?[0-9]+(\\.[0-9]+)?\\b', '\\1?', 'g'), '\\s+', ' ', 'g'))) > 0 AS kept FROM documents""",
)
def text_normalize(t: Tables) -> DataFrame:
    """Normalisation of whole texts: none becomes empty."""
    return t.documents.select("doc_id", (F.length(exprs.lexical_normalize("text")) > 0).alias("kept"))


@query(
    "request_counts",
    f"WITH {_SQL_STATEMENTS} SELECT route, request_id, fp AS fingerprint, count(*) AS executions FROM st WHERE request_id IS NOT NULL GROUP BY ALL",
)
def request_counts(t: Tables) -> DataFrame:
    return behaviour.request_counts(_statements(t)).drop("app")


_SQL_N1 = f"""WITH {_SQL_STATEMENTS}, per AS (SELECT route, request_id, fp, count(*) AS n FROM st WHERE request_id IS NOT NULL GROUP BY ALL),
    a AS (SELECT route, fp, max(n) AS peak, median(n) AS med, count(*) AS affected FROM per WHERE n > 2 GROUP BY ALL),
    o AS (SELECT route, count(DISTINCT request_id) AS observed FROM ops WHERE request_id IS NOT NULL GROUP BY route),
    n1 AS (SELECT *, CASE WHEN peak >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM a JOIN o USING (route))"""


@query(
    "n_plus_one",
    _SQL_N1 + """ SELECT route, fp AS fingerprint, peak AS max_executions, CAST(med AS DOUBLE) AS median_executions, affected AS requests_affected,
        observed AS requests_observed, confidence FROM n1""",
)
def n_plus_one(t: Tables) -> DataFrame:
    return behaviour.n_plus_one(_statements(t), _operations(t)).drop("app")


@query(
    "n_plus_one_findings",
    _SQL_N1 + """, m AS (SELECT fp, arg_min(model, (operation_id, position)) AS model FROM st GROUP BY fp)
      SELECT 'route:' || route AS file, route || ' calls ' || model || '.findMany again and again, ' || peak || ' times at worst' AS title,
        substr(sha256('RUNTIME_N_PLUS_ONE' || chr(0) || 'shop' || chr(0) || route || chr(0) || fp), 1, 32) AS fingerprint, confidence
      FROM n1 JOIN m USING (fp)""",
)
def n_plus_one_findings(t: Tables) -> DataFrame:
    statements = _stored_statements(t)
    detected = behaviour.n_plus_one(statements, _operations(t))
    found = behaviour.n_plus_one_findings(detected, behaviour.shape_representative(statements))
    return found.select("file", "title", "fingerprint", "confidence")


@query(
    "shape_representative",
    f"""WITH {_SQL_STATEMENTS} SELECT fp AS fingerprint, arg_min(norm, (operation_id, position)) AS normalized_sql,
          arg_min(model, (operation_id, position)) AS model, 'findMany' AS operation FROM st GROUP BY fp""",
)
def shape_representative(t: Tables) -> DataFrame:
    return behaviour.shape_representative(_statements(t))


@query(
    "repeated_identical",
    f"""WITH {_SQL_STATEMENTS} SELECT route, fp AS fingerprint, count(*) AS requests FROM (
          SELECT route, request_id, fp FROM st WHERE request_id IS NOT NULL GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL""",
)
def repeated_identical(t: Tables) -> DataFrame:
    return behaviour.repeated_identical(_statements(t)).drop("app")


def _numbered(t: Tables) -> DataFrame:
    """Events with ``d``, the number of their day, counted from the first event's day as 1."""
    first = t.events.agg(F.to_date(F.min("ts"))).scalar()
    return t.events.withColumn("d", F.datediff(F.to_date("ts"), first) + 1)


_SQL_NUMBERED = "(SELECT *, date_diff('day', (SELECT min(ts) FROM events), ts) + 1 AS d FROM events)"


def _runs(t: Tables) -> DataFrame:
    """A run per day: the day's morning; every seventh day warms up; sessions alternate."""
    return _numbered(t).where(F.hour("ts") < 12).groupBy("d").agg(
        F.min("ts").alias("window_start"), F.max("ts").alias("window_end")
    ).select(
        F.concat(F.lit("s"), F.col("d") % 2).alias("session_id"), F.concat(F.lit("run"), "d").alias("run_id"),
        (F.col("d") % 7 == 0).alias("warmup"), "window_start", "window_end",
    )


@query(
    "in_session",
    f"""WITH runs AS (SELECT 's' || (d % 2) AS s, d % 7 = 0 AS warmup, min(ts) AS a, max(ts) AS b FROM {_SQL_NUMBERED} WHERE hour(ts) < 12 GROUP BY d)
       SELECT 'op' || event_id AS operation_id FROM events WHERE EXISTS (SELECT 1 FROM runs WHERE s = 's1' AND NOT warmup AND ts BETWEEN a AND b)""",
)
def in_session(t: Tables) -> DataFrame:
    return ev.in_session(_operations(t), _runs(t), "s1").select("operation_id")


_SQL_STATS = f"""WITH {_SQL_STATEMENTS}, s AS (SELECT fp AS fingerprint, any_value(norm) AS sql, count(*) AS executions, round(avg(value), 6) AS mean_ms,
    round(quantile_cont(value, 0.95), 6) AS p95_ms, max(value) AS max_ms, round(sum(value), 2) AS total_ms, list_sort(list(DISTINCT route)) AS routes FROM st GROUP BY fp)"""


def _stats(t: Tables) -> DataFrame:
    stats = behaviour.shape_stats(_stored_statements(t))
    return stats.withColumns({"mean_ms": F.round("mean_ms", 6), "p95_ms": F.round("p95_ms", 6), "total_ms": F.round("total_ms", 2)})


@query("shape_stats", _SQL_STATS + " SELECT * FROM s")
def shape_stats(t: Tables) -> DataFrame:
    return _stats(t)


@query("slowest_shapes", _SQL_STATS + " SELECT fingerprint, p95_ms FROM s ORDER BY p95_ms DESC, fingerprint LIMIT 12")
def slowest_shapes(t: Tables) -> DataFrame:
    return behaviour.top_shapes(_stats(t), "p95_ms").select("fingerprint", "p95_ms")


@query("frequent_shapes", _SQL_STATS + " SELECT fingerprint, executions FROM s ORDER BY executions DESC, fingerprint LIMIT 3")
def frequent_shapes(t: Tables) -> DataFrame:
    return behaviour.top_shapes(_stats(t), "executions", 3).select("fingerprint", "executions")


@query("query_totals", f"WITH {_SQL_STATEMENTS} SELECT count(*) AS statements, count(DISTINCT fp) AS distinct_fingerprints FROM st")
def query_totals(t: Tables) -> DataFrame:
    counted = _statements(t).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("executions"))
    return behaviour.totals(counted)


@query(
    "endpoint_repetition",
    f"""WITH {_SQL_STATEMENTS}, per AS (SELECT route, request_id, fp, count(*) AS n, any_value(norm) AS sql FROM st WHERE request_id IS NOT NULL GROUP BY route, request_id, fp),
        w AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY route, request_id ORDER BY n DESC, fp) = 1)
        SELECT route, count(*) AS requests, round(avg(n), 6) AS mean_repeats, max(n) AS max_repeats, arg_min(sql, (-n, fp)) AS repeated_sql FROM w GROUP BY route""",
)
def endpoint_repetition(t: Tables) -> DataFrame:
    return behaviour.endpoint_repetition(_statements(t)).withColumn("mean_repeats", F.round("mean_repeats", 6))


@query(
    "route_counts",
    f"""WITH {_SQL_STATEMENTS} SELECT o.route, count(DISTINCT o.operation_id) AS operations, count(st.position) AS statements FROM ops o
        LEFT JOIN st ON st.operation_id = o.operation_id AND st.position > 0
        WHERE o.started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY o.route""",
)
def route_counts(t: Tables) -> DataFrame:
    later = _statements(t).where(F.col("position") > 0)
    return behaviour.route_counts(_operations(t), later, datetime(2024, 1, 5), datetime(2024, 1, 20), "shop")


@query(
    "unbounded_statements",
    f"""WITH {_SQL_STATEMENTS} SELECT CASE WHEN position = 0 THEN 'SQL_UNBOUNDED_SELECT' ELSE 'SQL_UNBOUNDED_MUTATION' END AS rule_id,
          CASE WHEN position = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence, count(*) AS statements FROM st
        WHERE position = 0 OR norm LIKE 'update%' GROUP BY ALL""",
)
def unbounded_statements(t: Tables) -> DataFrame:
    found = behaviour.unbounded_statements(_statements(t))
    return found.groupBy("rule_id", "confidence").agg(F.count(F.lit(1)).alias("statements"))


#: Statements by order: text with a key in it, the rule it trips, the confidence and its condition columns.
_SCOPED = [
    ("with recent as (select * from orders where o_orderkey < {k}) select * from recent", "SQL_UNBOUNDED_SELECT", "MEDIUM", ["o_orderkey"]),
    ("with old as (select o_orderkey from orders where o_orderkey > {k}) delete from orders where o_custkey = {k} returning o_orderkey, o_clerk", None, None, ["o_custkey"]),
    ("with old as (select {k}) delete from orders", "SQL_UNBOUNDED_MUTATION", "HIGH", []),
    ("select a from t where a = {k} union all select b from u", None, None, ["a"]),
    ("select distinct max(o_totalprice) from orders where o_custkey = {k}", None, None, ["o_custkey"]),
    ("select string_agg(o_clerk, ',' order by o_orderkey) as clerks from orders where o_shippriority = {k}", None, None, ["o_shippriority"]),
    ("select * from t where id in (select o.user_id from orders o where o.x = {k}) and b = 2", "SQL_UNBOUNDED_SELECT", "LOW", ["id", "user_id", "x", "b"]),
    ("select * from t where extract(year from ts) = {k} and d >= date '2024-01-01' limit 5", None, None, ["ts", "d"]),
    ("select a, sum(a) over w from t where cast(a as double precision) > {k} window w as (partition by c)", "SQL_UNBOUNDED_SELECT", "LOW", ["a"]),
    ("update t set a = {k} where exists (select 1 from u uu join v on v.id = uu.vid) and t.\"Key\" = {k}", None, None, ["id", "vid", "Key"]),
    ("select count(*)::int from t -- {k}", "SQL_UNBOUNDED_SELECT", "MEDIUM", []),
]


def _scoped_statements(t: Tables) -> DataFrame:
    """One statement per order, of a form that its key chooses."""
    form = F.col("o_orderkey") % len(_SCOPED)
    text = F.coalesce(*[F.when(form == i, F.replace(F.lit(q), F.lit("{k}"), F.col("o_orderkey").cast("string"))) for i, (q, *_) in enumerate(_SCOPED)])
    return t.orders.select("o_orderkey", form.alias("form"), text.alias("sql"))


def _sql_scoped(column: int) -> str:
    shown = lambda x: "NULL" if x is None else str(x) if isinstance(x, list) else f"'{x}'"
    return " ".join(f"WHEN {i} THEN {shown(row[column])}" for i, row in enumerate(_SCOPED))


@query(
    "unbounded_scopes",
    f"""SELECT form, rule_id, confidence, count(*) AS statements FROM (SELECT o_orderkey % {len(_SCOPED)} AS form, CASE o_orderkey % {len(_SCOPED)} {_sql_scoped(1)} END AS rule_id,
          CASE o_orderkey % {len(_SCOPED)} {_sql_scoped(2)} END AS confidence FROM orders) WHERE rule_id IS NOT NULL GROUP BY ALL""",
)
def unbounded_scopes(t: Tables) -> DataFrame:
    """Common table expressions, set operations, aggregates and subqueries: what the statement itself bounds."""
    rows = _scoped_statements(t).select("form", "o_orderkey", "sql")
    return behaviour.unbounded_statements(rows).groupBy("form", "rule_id", "confidence").agg(F.count(F.lit(1)).alias("statements"))


@query(
    "filter_scopes",
    f"SELECT o_orderkey, CASE o_orderkey % {len(_SCOPED)} {_sql_scoped(3)} END AS columns FROM orders",
)
def filter_scopes(t: Tables) -> DataFrame:
    """Condition columns without tables, aliases, types, keywords of functions or what follows the condition."""
    return _scoped_statements(t).select("o_orderkey", exprs.filter_columns("sql").alias("columns"))


@query(
    "sql_findings",
    f"""WITH {_SQL_STATEMENTS} SELECT rule_id, 'route:' || route AS file, confidence,
          substr(sha256(rule_id || chr(0) || 'route:' || route || chr(0) || norm), 1, 32) AS fingerprint FROM (
          SELECT DISTINCT CASE WHEN position = 0 THEN 'SQL_UNBOUNDED_SELECT' ELSE 'SQL_UNBOUNDED_MUTATION' END AS rule_id, route, norm,
            CASE WHEN position = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence FROM st WHERE position = 0 OR norm LIKE 'update%')""",
)
def sql_findings(t: Tables) -> DataFrame:
    statements = _statements(t).select(F.col("normalized_sql").alias("sql"), "route", F.lit(None).cast("string").alias("file"), F.lit(0).alias("line"))
    return behaviour.sql_findings(statements).select("rule_id", "file", "confidence", "fingerprint")


@query(
    "filter_columns",
    """SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN ['l_partkey', 'Ship', 'l_tax'] ELSE ['l_suppkey', 'l_partkey'] END AS columns FROM lineitem""",
)
def filter_columns(t: Tables) -> DataFrame:
    even = F.format_string('SELECT l_tax, x FROM lineitem WHERE lineitem.l_partkey = %d AND ("Ship" > \'a = b\' OR l_tax IN (1, 2)) AND l_partkey < 9 ORDER BY z LIMIT 5', "l_partkey")
    odd = F.format_string("select * from t where l_suppkey = $1 and lower(l_partkey) like '%%x%%' and not l_suppkey is null -- c %d", "l_partkey")
    sql = F.when(F.col("l_linenumber") % 2 == 0, even).otherwise(odd)
    return t.lineitem.select("l_orderkey", exprs.filter_columns(sql).alias("columns"))


@query(
    "route_pattern",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/api/' || event_type || '/:' WHEN 1 THEN '/api/u/:/x' ELSE '/' END AS pattern FROM events""",
)
def route_pattern(t: Tables) -> DataFrame:
    one = F.concat(F.lit("GET /api/"), F.col("event_type"), F.lit("/:id?n="), F.col("event_id"))
    raw = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, F.lit("/api/u/[id]/x//")).otherwise("/")
    return t.events.select("event_id", exprs.route_pattern(raw).alias("pattern"))


@query(
    "route_for_file",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/' || event_type || '/[id]' WHEN 1 THEN '/app/' || event_type WHEN 2 THEN NULL ELSE '/' END AS route FROM events""",
)
def route_for_file(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    file = (
        F.when(kind == 0, F.concat(F.lit("web/app/(shop)/@modal/"), F.col("event_type"), F.lit("/[id]/route.ts")))
        .when(kind == 1, F.concat(F.lit("app\\x\\src\\app\\app\\"), F.col("event_type"), F.lit("\\route.mjs")))
        .when(kind == 2, F.concat(F.lit("src/app/"), F.col("event_type"), F.lit("/page.tsx")))
        .otherwise("app/route.js")
    )
    return t.events.select("event_id", exprs.route_for_file(file).alias("route"))


# ---- files ---------------------------------------------------------------------------------------------


@query(
    "split_statements",
    """SELECT 'p' || p_partkey || '.sql' AS path, 2 AS line, 'SELECT * FROM part WHERE p_partkey = ' || p_partkey AS sql FROM part
       UNION ALL SELECT 'p' || p_partkey || '.sql', 3, 'UPDATE part SET p_name = ''it''''s; ' || p_name || ''' WHERE p_size = ' || p_size FROM part
       UNION ALL SELECT 'p' || p_partkey || '.sql', 5, 'DELETE FROM part' FROM part""",
)
def split_statements(t: Tables) -> DataFrame:
    text = F.format_string(
        "-- part; %1$d\nSELECT * FROM part WHERE p_partkey = %1$d;\nUPDATE part SET p_name = 'it''s; %2$s' WHERE p_size = %3$d; /* x;\n y */\n DELETE FROM part",
        "p_partkey", "p_name", "p_size",
    )
    corpus = t.part.select(F.format_string("p%d.sql", "p_partkey").alias("path"), text.alias("text"))
    return files.split_statements(files.own_files(corpus))


@query(
    "corpus_counts",
    """SELECT 'd' || doc_id AS path, len(string_split(text, chr(10))) - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS lines,
          len(regexp_extract_all(text, '[A-Z][a-z]+')) AS words FROM documents""",
)
def corpus_counts(t: Tables) -> DataFrame:
    corpus = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    return files.corpus_counts(corpus, {"words": "[A-Z][a-z]+"})


@query(
    "source_context",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM documents),
       f AS (SELECT doc_id, n FROM l WHERE contains(line, 'oredat')),
       c AS (SELECT f.doc_id, f.n AS f, l.n, l.line, max(l.n) OVER (PARTITION BY f.doc_id, f.n) AS hi FROM f JOIN l ON l.doc_id = f.doc_id AND l.n BETWEEN f.n - 10 AND f.n + 10
             WHERE NOT (l.n = l.total AND l.line = ''))
       SELECT doc_id || ':' || f AS finding_id, string_agg(CASE WHEN n = f THEN '>' ELSE ' ' END || ' ' || lpad(CAST(n AS VARCHAR), CAST(len(CAST(hi AS VARCHAR)) AS INTEGER), ' ') || ' | ' || line, chr(10) ORDER BY n) AS source_context
       FROM c GROUP BY doc_id, f""",
)
def source_context(t: Tables) -> DataFrame:
    """The lines around every line that holds a word, over whole texts."""
    corpus = t.documents.select(F.col("doc_id").cast("string").alias("path"), "text")
    lines = corpus.select("path", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.contains("x", F.lit("oredat")))
    flagged = lines.select(
        F.concat_ws(":", "path", F.col("i") + 1).alias("finding_id"), "path", (F.col("i") + 1).alias("line"),
        F.lit(None).cast("int").alias("end_line"),
    )
    return files.source_context(corpus, flagged)


@query("worksheet_roundtrip", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS letters, lang, md5(text) AS digest,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 <> 1 THEN lang END AS note FROM documents""")
def worksheet_roundtrip(t: Tables) -> DataFrame:
    """Whole texts, line breaks included, written as CSV and read back as strings."""
    path = fresh_path(t.spark, "worksheet")
    empty = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 != 1, F.col("lang"))
    files.write_csv(t.documents.select("doc_id", "text", "lang", empty.alias("note")), path, null="\\N")
    sheet = files.read_worksheet(t.spark, path, null="\\N")
    return sheet.select("doc_id", F.length("text").alias("letters"), "lang", "note", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "csv_lines",
    """SELECT event_id || ',"' || replace(props, '"', '""') || '",' || event_type AS value FROM events""",
)
def csv_lines(t: Tables) -> DataFrame:
    return files.csv_lines(t.events, ["event_id", "props", "event_type"])


@query(
    "csv_file",
    """SELECT 'event_id,props,event_type' AS value, 1 AS lines UNION ALL SELECT event_id || ',"' || replace(props, '"', '""') || '",' || event_type, 1 FROM events""",
)
def csv_file(t: Tables) -> DataFrame:
    """A CSV export: each file begins with the column names, and only fields that need quotes have them."""
    path = fresh_path(t.spark, "export")
    files.write_csv(t.events.select("event_id", "props", "event_type").coalesce(1), path, quote_all=False)
    return t.spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).cast("int").alias("lines"))


@query(
    "sql_files",
    """SELECT CAST(o_orderkey % 20 AS INTEGER) AS part, count(*) AS statements, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS changes FROM orders GROUP BY 1""",
)
def sql_files(t: Tables) -> DataFrame:
    """Statements of the SQL files below a folder, without those of skipped folders."""
    path = fresh_path(t.spark, "corpus")
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.format_string("UPDATE orders SET o_clerk = 'a;b' WHERE o_orderkey = %d;", key)).otherwise(
        F.format_string("SELECT * FROM orders -- all;\nWHERE o_orderkey = %d;", key)
    )
    lines = t.orders.select((key % 20).cast("int").alias("part"), text.alias("value"))
    for folder in ("app", "node_modules"):
        lines.write.partitionBy("part").text(f"{path}/{folder}")
    found = files.split_statements(files.sql_files(t.spark, path, "*.txt"))
    return found.groupBy(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("statements"), F.count_if(F.col("sql").startswith("UPDATE")).alias("changes")
    )


@query(
    "findings_json",
    _SQL_N1 + " SELECT count(*) AS findings, count(DISTINCT route || fp) AS fingerprints, 0 AS rejected, 0 AS changed FROM n1",
)
def findings_json(t: Tables) -> DataFrame:
    """Findings written as JSON and read back: nothing rejected, nothing changed."""
    statements = _stored_statements(t)
    found = behaviour.n_plus_one_findings(behaviour.n_plus_one(statements, _operations(t)), behaviour.shape_representative(statements))
    lines = files.findings_json(found)
    back, rejected = files.parse_findings(lines)
    lost = rejected.agg(F.count(F.lit(1))).scalar()
    same = found.select("fingerprint", "title", "body", "line").exceptAll(back.select("fingerprint", "title", "body", "line"))
    return back.agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("fingerprint").alias("fingerprints"),
        F.first(lost).cast("int").alias("rejected"), F.first(same.agg(F.count(F.lit(1))).scalar()).cast("int").alias("changed"),
    )


# ---- load runs -------------------------------------------------------------------------------------------


def _requests(t: Tables) -> DataFrame:
    return _numbered(t).select(
        F.col("d").alias("run_id"), F.col("event_type").alias("entry_id"), (F.col("d") <= 2).alias("warmup"),
        (F.col("user_id") % 2 == 0).alias("collector_enabled"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
    )


_SQL_REQUESTS = f"""r AS (SELECT d AS run_id, event_type AS entry_id, CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS state, value AS ms
    FROM {_SQL_NUMBERED} WHERE d > 2 AND event_type <> 'error')"""


@query(
    "latency_stats",
    f"""WITH {_SQL_REQUESTS} SELECT state, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS median_ms,
        round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM r GROUP BY state""",
)
def latency_stats(t: Tables) -> DataFrame:
    rows = loadruns.measured(_requests(t)).withColumn("state", F.when(F.col("collector_enabled"), "on").otherwise("off"))
    stats = loadruns.latency_stats(rows, ["state"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms", "p95_ms")})


@query(
    "latency_of_runs",
    """WITH r AS (SELECT CASE WHEN epoch(date_trunc('day', ts)) // 86400 % 2 = 0 THEN 'on' ELSE 'off' END AS state, value AS ms FROM events
         WHERE event_type <> 'error' AND date_trunc('day', ts) > (SELECT date_trunc('day', min(ts)) FROM events))
       SELECT state, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM r GROUP BY state""",
)
def latency_of_runs(t: Tables) -> DataFrame:
    """Requests joined with their runs, one a day: warm-up and condition are the run's."""
    day = F.unix_date(F.to_date("ts"))
    requests = t.events.select(day.alias("run_id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"))
    days = requests.select("run_id").distinct()
    runs = days.select("run_id", (F.col("run_id") == days.agg(F.min("run_id")).scalar()).alias("warmup"), (F.col("run_id") % 2 == 0).alias("collector_enabled"))
    rows = loadruns.measured(requests, runs).withColumn("state", F.when(F.col("collector_enabled"), "on").otherwise("off"))
    stats = loadruns.latency_stats(rows, ["state"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms", "p95_ms")})


@query(
    "load_overhead",
    f"""WITH {_SQL_REQUESTS}, s AS (SELECT quantile_cont(ms, 0.5) FILTER (WHERE state = 'on') AS a, quantile_cont(ms, 0.5) FILTER (WHERE state = 'off') AS b,
          quantile_cont(ms, 0.95) FILTER (WHERE state = 'on') AS c, quantile_cont(ms, 0.95) FILTER (WHERE state = 'off') AS d FROM r)
        SELECT round(a - b, 6) AS median_overhead_ms, round(a / b - 1, 6) AS median_overhead_ratio, round(c - d, 6) AS p95_overhead_ms FROM s""",
)
def load_overhead(t: Tables) -> DataFrame:
    row = loadruns.overhead(loadruns.measured(_requests(t)))
    return row.select(*[F.round(c, 6).alias(c) for c in ("median_overhead_ms", "median_overhead_ratio", "p95_overhead_ms")])


@query(
    "per_entry_delta",
    f"""WITH {_SQL_REQUESTS} SELECT entry_id, round(quantile_cont(ms, 0.5) FILTER (WHERE state = 'on'), 6) AS median_on_ms,
          round(quantile_cont(ms, 0.5) FILTER (WHERE state = 'off'), 6) AS median_off_ms,
          round(quantile_cont(ms, 0.5) FILTER (WHERE state = 'on') - quantile_cont(ms, 0.5) FILTER (WHERE state = 'off'), 6) AS median_delta_ms FROM r GROUP BY entry_id""",
)
def per_entry_delta(t: Tables) -> DataFrame:
    rows = loadruns.per_entry_delta(loadruns.measured(_requests(t)))
    return rows.withColumns({c: F.round(c, 6) for c in ("median_on_ms", "median_off_ms", "median_delta_ms")})


def _run_counts(t: Tables) -> DataFrame:
    return _numbered(t).groupBy(F.col("d").alias("run_id"), F.concat(F.lit("/r/"), F.col("user_id") % 10).alias("route")).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(F.col("event_type") != "error").alias("statements")
    )


_SQL_REPEAT = f"""c AS (SELECT d AS run, user_id % 10 AS k, count(*) AS o, count(*) FILTER (WHERE event_type <> 'error') AS s FROM {_SQL_NUMBERED} GROUP BY ALL),
    g AS (SELECT r.run, q.k, coalesce(s, 0) AS s FROM (SELECT DISTINCT run FROM c) r CROSS JOIN (SELECT DISTINCT k FROM c) q LEFT JOIN c ON c.run = r.run AND c.k = q.k),
    w AS (SELECT k, max(abs(s - m)) / any_value(m) AS d FROM (SELECT *, avg(s) OVER (PARTITION BY k) AS m FROM g) GROUP BY k),
    tot AS (SELECT run, sum(o) AS o, sum(s) AS s FROM c GROUP BY run), dv AS (SELECT count(*) AS runs, max(abs(o - mo)) / any_value(mo) AS od, max(abs(s - ms)) / any_value(ms) AS sd
      FROM (SELECT *, avg(o) OVER () AS mo, avg(s) OVER () AS ms FROM tot))"""


@query(
    "repeatability",
    f"""WITH {_SQL_REPEAT} SELECT runs, round(od, 9) AS operations_deviation, round(sd, 9) AS statements_deviation, (SELECT round(max(d), 9) FROM w) AS worst_route_deviation,
        runs >= 2 AND greatest(od, sd, (SELECT max(d) FROM w)) < 0.05 AS passes FROM dv""",
)
def repeatability(t: Tables) -> DataFrame:
    row = loadruns.repeatability(_run_counts(t))
    return row.withColumns({c: F.round(c, 9) for c in ("operations_deviation", "statements_deviation", "worst_route_deviation")})


@query("route_repeatability", f"WITH {_SQL_REPEAT} SELECT '/r/' || k AS route, (SELECT runs FROM dv) AS runs, round(d, 9) AS max_relative_deviation FROM w")
def route_repeatability(t: Tables) -> DataFrame:
    return loadruns.route_repeatability(_run_counts(t)).withColumn("max_relative_deviation", F.round("max_relative_deviation", 9))


def _load_runs(t: Tables) -> DataFrame:
    days = _numbered(t).select(F.col("d").alias("run_id")).distinct()
    return days.select("run_id", (F.col("run_id") <= 2).alias("warmup"), (F.col("run_id") % 2 == 0).alias("collector_enabled"))


@query(
    "cpu_cost",
    f"""WITH c AS (SELECT d AS run, event_type AS service, (max(event_id) - min(event_id)) * 1000 AS cpu, max(user_id) * 1048576 AS mem, max(event_id) * 1048576 AS peak FROM {_SQL_NUMBERED} GROUP BY ALL),
       q AS (SELECT d AS run, count(*) AS n FROM {_SQL_NUMBERED} WHERE event_type <> 'error' GROUP BY ALL)
       SELECT service, CASE WHEN run % 2 = 0 THEN 'on' ELSE 'off' END AS state, count(*) AS runs, round(avg(cpu / n / 1000), 6) AS cpu_ms_per_request,
         round(avg(mem) / 1048576, 6) AS memory_mib_end, round(max(peak) / 1048576, 6) AS memory_mib_peak FROM c JOIN q USING (run) WHERE run > 2 GROUP BY ALL""",
)
def cpu_cost(t: Tables) -> DataFrame:
    mib = 1048576
    base = _numbered(t).groupBy(F.col("d").alias("run_id"), F.col("event_type").alias("service"))
    ends = base.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.max("user_id").alias("u"))
    phase = lambda name, c: F.struct(
        F.lit(name).alias("phase"), (F.col(c) * 1000).alias("cpu_usage_usec"), (F.col("u") * mib).alias("memory_current_bytes"),
        (F.col(c) * mib).alias("memory_peak_bytes"),
    )
    counters = ends.select("run_id", "service", F.explode(F.array(phase("start", "a"), phase("end", "b"))).alias("p")).select("run_id", "service", "p.*")
    cost = loadruns.cpu_cost(counters, _requests(t).select("run_id", "status"), _load_runs(t))
    return cost.withColumns({c: F.round(c, 6) for c in ("cpu_ms_per_request", "memory_mib_end", "memory_mib_peak")})


@query(
    "resource_stats",
    f"""SELECT event_type AS service, CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS state, count(*) AS samples, round(avg(value), 6) AS cpu_percent_mean,
         round(avg(event_id) / 1048576, 6) AS memory_mib_mean, round(max(event_id) / 1048576, 6) AS memory_mib_max FROM {_SQL_NUMBERED} WHERE d > 2 GROUP BY ALL""",
)
def resource_stats(t: Tables) -> DataFrame:
    samples = _numbered(t).select(
        F.col("event_type").alias("service"), F.col("value").alias("cpu_percent"), F.col("event_id").alias("memory_bytes"),
        (F.col("d") <= 2).alias("warmup"), (F.col("user_id") % 2 == 0).alias("collector_enabled"),
    )
    stats = loadruns.resource_stats(samples)
    return stats.withColumns({c: F.round(c, 6) for c in ("cpu_percent_mean", "memory_mib_mean", "memory_mib_max")})


@query(
    "param_candidates",
    "SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) >= 3 ORDER BY o_orderkey LIMIT 100",
)
def param_candidates(t: Tables) -> DataFrame:
    return loadruns.candidates(t.orders, "o_orderkey", t.lineitem, "l_orderkey", at_least=3)


# ---- scan history ----------------------------------------------------------------------------------------


def _scans(t: Tables) -> DataFrame:
    days = _numbered(t).groupBy("d").agg(F.min("ts").alias("started_at"))
    return days.select(
        F.format_string("d%02d", "d").alias("scan_id"), F.concat(F.lit("app"), F.col("d") % 2).alias("app"), "started_at",
        F.when(F.col("d") % 10 == 0, "failed").otherwise("ok").alias("status"), F.lit("app").alias("kind"),
        F.when(F.col("d") % 3 == 0, F.concat(F.lit("u"), F.col("d") % 2)).alias("owner_id"),
        F.array(F.lit("SQL"), F.lit("RUNTIME"), F.lit("DATA_QUALITY")).alias("ran"),
    )


def _scan_findings(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    item = lambda source: F.struct(F.lit(source).alias("source"))
    return _numbered(t).select(
        F.format_string("d%02d", "d").alias("scan_id"),
        F.when(kind.isin("error", "purchase"), "HIGH").when(kind == "view", "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("confidence"), F.upper(kind).alias("rule_id"),
        F.concat(F.lit("route:/r/"), F.col("user_id") % 10).alias("file"), F.col("user_id").cast("int").alias("line"),
        F.concat(F.lit("Problem in "), kind).alias("title"), F.md5(F.concat_ws(":", "user_id", "event_type").cast("binary")).alias("fingerprint"),
        F.array_compact(F.array(item("RUNTIME"), F.when(kind == "view", item("SQL")), item("RUNTIME"))).alias("evidence"),
    )


_SQL_SCANS = f"""sc AS (SELECT printf('d%02d', d) AS scan_id, 'app' || (d % 2) AS app, min(ts) AS started_at,
    CASE WHEN d % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN d % 3 = 0 THEN 'u' || (d % 2) END AS owner_id FROM {_SQL_NUMBERED} GROUP BY d),
  f AS (SELECT printf('d%02d', d) AS scan_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'HIGH' WHEN event_type = 'view' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS confidence, upper(event_type) AS rule_id, 'route:/r/' || (user_id % 10) AS file, user_id AS line,
    'Problem in ' || event_type AS title, md5(user_id || ':' || event_type) AS fingerprint, event_type FROM {_SQL_NUMBERED})"""


@query(
    "finding_ids",
    f"""WITH {_SQL_SCANS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END,
          file, line, rule_id, fingerprint) AS VARCHAR) AS n FROM f)
        SELECT scan_id, 'F' || CASE WHEN len(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS finding_id, rule_id, file, line,
          CASE WHEN event_type = 'view' THEN ['RUNTIME', 'SQL'] ELSE ['RUNTIME'] END AS layers FROM n""",
)
def finding_ids(t: Tables) -> DataFrame:
    return scans.assign_finding_ids(_scan_findings(t)).select("scan_id", "finding_id", "rule_id", "file", "line", "layers")


#: After every seventh scan one more that found nothing.
_SQL_COUNTS = f"""WITH {_SQL_SCANS}, every_sc AS (SELECT scan_id, app, started_at FROM sc
      UNION ALL SELECT 'e' || substr(scan_id, 2), app, started_at + INTERVAL 1 HOUR FROM sc WHERE CAST(substr(scan_id, 2) AS INTEGER) % 7 = 0),
    k AS (SELECT s.scan_id, any_value(app) AS app, any_value(started_at) AS started_at, count(f.scan_id) FILTER (WHERE severity = 'HIGH') AS high, count(f.scan_id) FILTER (WHERE severity = 'MEDIUM') AS medium,
    count(f.scan_id) FILTER (WHERE severity = 'LOW') AS low, count(f.scan_id) AS total FROM every_sc s LEFT JOIN f USING (scan_id) GROUP BY s.scan_id)"""


def _counts(t: Tables, limit: int | None = None) -> DataFrame:
    found = _scans(t)
    number = F.substring_index("scan_id", "d", -1)
    empty = found.where(number.cast("int") % 7 == 0).withColumns(
        {"scan_id": F.concat(F.lit("e"), number), "started_at": F.col("started_at") + F.expr("INTERVAL 1 HOUR")}
    )
    return scans.scan_counts(found.unionByName(empty), _scan_findings(t), limit)


@query("scan_counts", _SQL_COUNTS + " SELECT scan_id, high, medium, low, total FROM k ORDER BY started_at DESC LIMIT 28")
def scan_counts(t: Tables) -> DataFrame:
    return _counts(t, 28).select("scan_id", "high", "medium", "low", "total")


@query("severity_trend", _SQL_COUNTS + " SELECT app, scan_id, total, total - lag(total) OVER (PARTITION BY app ORDER BY started_at) AS delta FROM k")
def severity_trend(t: Tables) -> DataFrame:
    return scans.severity_trend(_counts(t)).select("app", "scan_id", "total", "delta")


@query("latest_scan", f"WITH {_SQL_SCANS} SELECT app, arg_max(scan_id, started_at) AS scan_id FROM sc GROUP BY app")
def latest_scan(t: Tables) -> DataFrame:
    return scans.latest_scan(_scans(t)).select("app", "scan_id")


@query("latest_ok_scan", f"WITH {_SQL_SCANS} SELECT app, arg_max(scan_id, started_at) AS scan_id FROM sc WHERE status = 'ok' GROUP BY app")
def latest_ok_scan(t: Tables) -> DataFrame:
    return scans.latest_scan(_scans(t), only_ok=True).select("app", "scan_id")


@query("visible_scans", f"WITH {_SQL_SCANS} SELECT scan_id FROM sc WHERE owner_id = 'u1' OR owner_id IS NULL")
def visible_scans(t: Tables) -> DataFrame:
    return scans.visible(_scans(t), "u1").select("scan_id")


_SQL_DIFF = f"""WITH {_SQL_SCANS}, h AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY app ORDER BY started_at) AS prev FROM sc WHERE status = 'ok'),
    p AS (SELECT DISTINCT scan_id, fingerprint FROM f),
    added AS (SELECT h.scan_id, p.fingerprint FROM h JOIN p USING (scan_id) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p b WHERE b.scan_id = prev AND b.fingerprint = p.fingerprint)),
    resolved AS (SELECT h.scan_id, p.fingerprint FROM h JOIN p ON p.scan_id = h.prev WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.scan_id = h.scan_id AND b.fingerprint = p.fingerprint))"""


@query("findings_diff", _SQL_DIFF + " SELECT *, 'added' AS change FROM added UNION ALL SELECT *, 'resolved' FROM resolved")
def findings_diff(t: Tables) -> DataFrame:
    added, resolved = scans.diff_findings(_scans(t), _scan_findings(t))
    pick_columns = lambda df, name: df.select("scan_id", "fingerprint", F.lit(name).alias("change"))
    return pick_columns(added, "added").unionByName(pick_columns(resolved, "resolved"))


@query("new_findings", _SQL_DIFF + " SELECT rule_id, count(*) AS findings FROM f JOIN added USING (scan_id, fingerprint) GROUP BY rule_id")
def new_findings(t: Tables) -> DataFrame:
    found = _scan_findings(t)
    added, _ = scans.diff_findings(_scans(t), found)
    return scans.only_new(found, added).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query("findings_by_rule", f"WITH {_SQL_SCANS} SELECT rule_id, count(*) AS findings, any_value(severity) AS worst FROM f GROUP BY rule_id")
def findings_by_rule(t: Tables) -> DataFrame:
    return scans.by_rule(_scan_findings(t))


@query(
    "filter_findings",
    f"WITH {_SQL_SCANS} SELECT scan_id, fingerprint FROM f WHERE severity = 'MEDIUM' AND confidence = 'HIGH' AND contains(lower(title || ' ' || file || ' ' || rule_id), 'in view')",
)
def filter_findings(t: Tables) -> DataFrame:
    found = _scan_findings(t).withColumn("layers", F.transform("evidence", lambda e: e["source"]))
    return scans.filter_findings(found, severity="medium", confidence="high", rule="VIEW", layer="sql", text="In View").select("scan_id", "fingerprint")


@query(
    "layer_coverage",
    f"""WITH {_SQL_SCANS} SELECT scan_id, CASE WHEN max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) = 1 THEN ['RUNTIME', 'SQL'] ELSE ['RUNTIME'] END AS contributing,
        CASE WHEN max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) = 1 THEN ['DATA_QUALITY'] ELSE ['DATA_QUALITY', 'SQL'] END AS silent FROM f GROUP BY scan_id""",
)
def layer_coverage(t: Tables) -> DataFrame:
    found = _scan_findings(t).withColumn("layers", F.transform("evidence", lambda e: e["source"]))
    return scans.layer_coverage(_scans(t), found).drop("ran")


@query(
    "finding_totals",
    f"WITH {_SQL_SCANS} SELECT 'rule_id' AS kind, rule_id AS name, count(*) AS findings FROM f GROUP BY rule_id UNION ALL SELECT 'confidence', confidence, count(*) FROM f GROUP BY confidence",
)
def finding_totals(t: Tables) -> DataFrame:
    return scans.finding_totals(_scan_findings(t))


@query(
    "repository_totals",
    """SELECT count(*) FILTER (WHERE c_acctbal >= 0) AS ok, count(*) FILTER (WHERE c_acctbal < 0) AS failed, count(*) FILTER (WHERE n IS NULL) AS zero, sum(coalesce(n, 0))::BIGINT AS findings
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def repository_totals(t: Tables) -> DataFrame:
    repos = t.customer.select(F.col("c_custkey").alias("repo"), F.when(F.col("c_acctbal") >= 0, "ok").otherwise("failed").alias("status"))
    return scans.repository_totals(repos, t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("repo")))


# ---- selection and sampling --------------------------------------------------------------------------------


@query("hash_pick", f"SELECT {sql_pick('doc_id', ':x')} AS pick, count(*) AS rows FROM documents GROUP BY 1")
def hash_pick(t: Tables) -> DataFrame:
    return t.documents.groupBy(pick("doc_id", ":x").alias("pick")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "remove_and_duplicate",
    f"""WITH k AS (SELECT c_custkey, c_name FROM customer WHERE NOT ({sql_pick('c_custkey', ':erase')} < 30 AND c_acctbal < 5000))
        SELECT c_custkey, c_name FROM k UNION ALL SELECT c_custkey, c_name || '-2' FROM k WHERE {sql_pick('c_custkey', ':copy')} < 40""",
)
def remove_and_duplicate(t: Tables) -> DataFrame:
    kept = sampling.remove(t.customer, "c_custkey", ":erase", 30, F.col("c_acctbal") < 5000).select("c_custkey", "c_name")
    return sampling.duplicate(kept, "c_custkey", ":copy", 40, {"c_name": F.concat("c_name", F.lit("-2"))})


_SQL_DECIDED = """(SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'E1: language' WHEN source IN ('src1', 'src2') THEN 'E2: source' WHEN n_chars < 200 THEN 'I1: short' END AS reason FROM documents)"""


def _decided(t: Tables) -> DataFrame:
    return sampling.first_failing(
        t.documents,
        [("E1: language", ~F.col("lang").isin("en", "fr")), ("E2: source", F.col("source").isin("src1", "src2")), ("I1: short", F.col("n_chars") < 200)],
    )


@query("first_failing", f"SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'excluded' END AS decision FROM {_SQL_DECIDED}")
def first_failing(t: Tables) -> DataFrame:
    return _decided(t).select("doc_id", "reason", "decision")


@query("exclusion_tally", f"SELECT split_part(reason, ':', 1) AS test, count(*) AS excluded FROM {_SQL_DECIDED} WHERE reason IS NOT NULL GROUP BY 1")
def exclusion_tally(t: Tables) -> DataFrame:
    return sampling.exclusion_tally(_decided(t))


@query(
    "select_until",
    f"""SELECT doc_id, decision FROM (SELECT doc_id, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'excluded' END AS decision,
          sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY md5('7:' || doc_id)) - CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS before FROM {_SQL_DECIDED}) WHERE before < 25""",
)
def select_until(t: Tables) -> DataFrame:
    return sampling.select_until(_decided(t), "doc_id", F.col("decision") == "eligible", 25, seed=7).select("doc_id", "decision")


@query("study_set", f"SELECT doc_id FROM {_SQL_DECIDED} WHERE reason IS NULL ORDER BY md5('3:' || doc_id) LIMIT 30")
def study_set(t: Tables) -> DataFrame:
    return sampling.study_set(_decided(t).where(F.col("decision") == "eligible"), "doc_id", 30, seed=3).select("doc_id")


@query(
    "stratified_sample",
    """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
       WHERE rn <= ceil(round(0.2 * n, 9))""",
)
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.documents, ["lang"], "doc_id").select("lang", "doc_id")


@query(
    "models_named",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN ['view', 'u', 'Log'] ELSE [event_type, 'Log'] END AS models FROM events""",
)
def models_named(t: Tables) -> DataFrame:
    item = lambda data: F.struct(F.lit("SQL").alias("source"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("file"),
                                 F.lit(None).cast("int").alias("line"), data.alias("data"))
    first = F.to_json(F.struct(F.col("event_type").alias("model"), F.when(F.col("event_type") == "view", F.array(F.lit("view"), F.lit("u"))).alias("models")))
    rows = t.events.select("event_id", F.array(item(first), item(F.lit(None).cast("string")), item(F.lit('{"model": "Log"}'))).alias("evidence"))
    return rows.select("event_id", exprs.models_named("evidence").alias("models"))


@query("evidence_hash", "SELECT count(DISTINCT (user_id, event_type)) AS hashes, count(*) AS findings FROM events")
def evidence_hash(t: Tables) -> DataFrame:
    """The order of an object's keys does not change the hash."""
    ab = F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b")))
    ba = F.to_json(F.struct(F.col("event_type").alias("b"), F.col("user_id").alias("a")))
    item = F.struct(F.lit("SQL").alias("source"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("file"),
                    F.lit(None).cast("int").alias("line"), F.when(F.col("event_id") % 2 == 0, ab).otherwise(ba).alias("data"))
    hashed = t.events.select(exprs.evidence_hash(F.array(item)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return hashed.agg(F.count(F.lit(1)).alias("hashes"), F.sum("n").alias("findings"))


@query("sql_functions", f"SELECT {sql_pick('c_custkey', ':s')} AS p, count(*) AS n FROM customer GROUP BY 1")
def sql_functions(t: Tables) -> DataFrame:
    exprs.register(t.spark)
    return t.customer.groupBy(F.expr("pick(CAST(c_custkey AS STRING), ':s')").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_experiment",
    "SELECT event_type AS experiment, user_id % 10 AS r, count(*) AS n FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL",
)
def latest_experiment(t: Tables) -> DataFrame:
    """The raw rows of every event type, each an experiment; the newest is read back and only then counted."""
    path = fresh_path(t.spark, "results")
    for kind in [r[0] for r in t.events.where("event_type IS NOT NULL").select("event_type").distinct().orderBy("event_type").collect()]:
        files.append_results(t.events.where(F.col("event_type") == kind), path, kind)
    rows = files.latest_experiment(t.spark, path)
    return rows.groupBy("experiment", (F.col("user_id") % 10).alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_route",
    "SELECT p_partkey, '/p/' || replace(replace(p_name, '/', '%2F'), ' ', '+') || '/%23' || p_size AS url FROM part",
)
def url_route(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", exprs.url_route(F.concat(F.lit("/p/"), "p_name", F.lit("/#"), "p_size")).alias("url"))
