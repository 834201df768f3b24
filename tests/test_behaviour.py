from __future__ import annotations

import json
import random
from datetime import datetime

import pytest

from plumbline.functions import exprs, sqltext
from plumbline.operators import behaviour
from plumbline.sources import events as ev
from plumbline.sources import files
from pyspark.sql import functions as F


def evaluate(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", function("v").alias("o")).orderBy("i").collect()]


def test_list_length_does_not_change_the_shape(spark):
    listed = lambda n: 'SELECT "a" FROM "T" WHERE "id" IN (' + ",".join(f"${i}" for i in range(1, n + 1)) + ")"
    shapes = evaluate(spark, exprs.fingerprint, [listed(1), listed(5), listed(50)])
    assert len(set(shapes)) == 1 and len(shapes[0]) == 16
    assert len(set(evaluate(spark, exprs.naive_normalize, [listed(1), listed(5), listed(50)]))) == 3
    assert len(set(evaluate(spark, exprs.lexical_normalize, [listed(1), listed(5), listed(50)]))) == 1


def test_spelling_does_not_change_the_shape(spark):
    same = [
        "SELECT a FROM t WHERE x = 1 AND y = 'p--q'", "select  a\nfrom t -- it's\nwhere x=$1 and y = 'it''s';", "SELECT a FROM t /* ; */ WHERE x = -2.5 AND y = true",
    ]
    assert set(evaluate(spark, exprs.query_shape, same)) == {"select a from t where x=? and y=?"}
    values = ["INSERT INTO t (a, b) VALUES (1, 2)", "insert into t(a,b) values ($1,$2),($3,$4), (5, 6)"]
    assert len(set(evaluate(spark, exprs.query_shape, values))) == 1
    arrays = ["SELECT ARRAY[1, 2, 3]", "SELECT ARRAY[$1]"]
    assert len(set(evaluate(spark, exprs.query_shape, arrays))) == 1


def test_structure_changes_the_shape(spark):
    different = [
        'SELECT a FROM t WHERE x = 1', 'SELECT b FROM t WHERE x = 1', 'SELECT a FROM t WHERE x > 1', 'SELECT a FROM t WHERE x = 1 LIMIT 5',
        'SELECT a FROM t WHERE x = 1 ORDER BY a', 'SELECT "A" FROM t WHERE x = 1', 'SELECT a FROM t JOIN u ON t.i = u.i WHERE x = 1', 'SELECT a FROM t2 WHERE x = 1',
    ]
    assert len(set(evaluate(spark, exprs.query_shape, different))) == len(different)
    assert len(evaluate(spark, exprs.query_shape, ["not ( sql at '" + "x" * 50_000])[0]) > 0


def test_unbounded_rules(spark):
    cases = {
        "SELECT * FROM t": "SQL_UNBOUNDED_SELECT", "SELECT * FROM t WHERE a = 1": "SQL_UNBOUNDED_SELECT", "SELECT * FROM t LIMIT 5": None,
        "SELECT count(*) FROM t": None, "SELECT max(a), min(b) AS lo FROM t": None, "SELECT count(*) FROM t GROUP BY a": "SQL_UNBOUNDED_SELECT",
        "SELECT a, count(*) FROM t": "SQL_UNBOUNDED_SELECT", "SELECT 1": None, "UPDATE t SET a = 1": "SQL_UNBOUNDED_MUTATION", "DELETE FROM t WHERE a = 1": None,
        "DELETE FROM t": "SQL_UNBOUNDED_MUTATION", "SELECT * FROM t WHERE a IN (SELECT b FROM u LIMIT 3)": "SQL_UNBOUNDED_SELECT",
        "UPDATE t SET a = (SELECT b FROM u WHERE c = 1)": "SQL_UNBOUNDED_MUTATION", "CREATE TABLE t (a int)": None, "SELECT * FROM t FETCH FIRST 3 ROWS ONLY": None,
    }
    rows = spark.createDataFrame([(s,) for s in cases], "sql string")
    got = {r["sql"]: r["rule_id"] for r in behaviour.unbounded_statements(rows).collect()}
    assert got == {s: r for s, r in cases.items() if r}


def test_names_and_routes(spark):
    assert evaluate(spark, exprs.route_pattern, ["GET /api/o/:id?x=1", "/api/o/[id]/", "/", "POST /"]) == ["/api/o/:", "/api/o/:", "/", "/"]
    assert evaluate(spark, exprs.route_for_file, ["src/app/app/x/route.ts", "app/(g)/a/@m/[id]/route.js", "lib/route.ts", "app/a/page.tsx", "x/src/app/route.mts"]) == [
        "/app/x", "/a/[id]", None, None, "/"]
    assert evaluate(spark, exprs.normal_identifier, [' "Public"."x" ', 'public."User"', "T"]) == ['public"."x', "user", "t"]
    assert evaluate(spark, exprs.normal_path, ["././a\\b.ts", "a/./b"]) == ["a/b.ts", "a/./b"]
    assert evaluate(spark, exprs.slugify, [" Große Häuser & co. "]) == ["gro-e-h-user-co"]
    assert evaluate(spark, exprs.csv_field, ["a", 'a"b', "a,b", "a\nb", None]) == ["a", '"a""b"', '"a,b"', '"a\nb"', ""]


def operation(name, request, route, statements, app="shop", **changes):
    row = {
        "schemaVersion": 1, "app": app, "operationId": name, "requestId": request, "route": route, "model": "Item", "operation": "findMany",
        "startedAt": "2026-01-01T00:00:00Z", "durationMs": 1.0, "rowsReturned": 1, "error": False,
        "statements": [{"sql": s, "paramCount": 1, "kind": "query", "durationMs": 1.0, "rows": 1} for s in statements],
    }
    return {**row, **changes}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    def go(rows):
        path = tmp_path_factory.mktemp("events") / "e.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        return ev.read_events(spark, str(path))

    return go


def test_n_plus_one_cases(read):
    one, two = "SELECT * FROM i WHERE id = 1", "SELECT * FROM j WHERE id = 1"
    rows = [operation(f"a{i}", "r1", "/a", [one]) for i in range(20)] + [operation(f"b{i}", "r2", "/a", [one] * 2) for i in range(10)]
    rows += [operation("c", "r3", "/a", []), operation("d", "r4", "/b", [one, one]), operation("e", "r5", "/c", [one, two, one, two])]
    rows += [operation(f"f{i}", None, "/d", [one] * 9) for i in range(2)] + [operation(f"g{i}", f"q{i}", "/e", [one]) for i in range(10)]
    events, _ = read(rows)
    found = behaviour.n_plus_one(ev.explode_statements(events), ev.operations(events)).collect()
    assert len(found) == 1
    row = found[0]
    assert (row["route"], row["max_executions"], row["median_executions"], row["requests_affected"], row["requests_observed"], row["confidence"]) == (
        "/a", 20, 20.0, 2, 3, "HIGH")
    with pytest.raises(ValueError):
        behaviour.n_plus_one(ev.explode_statements(events), ev.operations(events), threshold=0)


def test_broken_events_are_quarantined(read):
    good = operation("ok", None, None, ["SELECT 1"])
    bad = [
        {**good, "schemaVersion": 2}, {**good, "operationId": ""}, {**good, "durationMs": -1}, {**good, "app": None}, {**good, "error": None},
        {**good, "statements": [{"sql": "x", "paramCount": -1, "kind": "query", "durationMs": 1.0, "rows": None}]},
        {**good, "statements": [{"sql": "x", "paramCount": 1, "kind": "other", "durationMs": 1.0, "rows": None}]},
    ]
    statement = good["statements"][0]
    bad += [
        {**good, "extra": 1}, {k: v for k, v in good.items() if k != "route"}, {**good, "rowsReturned": "many"}, {**good, "statements": None},
        {**good, "statements": [{**statement, "extra": 1}]}, {**good, "statements": [{**statement, "rows": "many"}]}, {**good, "statements": [None]}, 7,
    ]
    valid, quarantine = read([good, *bad])
    assert [r["operationId"] for r in valid.collect()] == ["ok"]
    reasons = {r["value"]: r["reason"] for r in quarantine.collect()}
    assert sorted(reasons) == sorted(json.dumps(b) for b in bad)
    assert [reasons[json.dumps(b)] for b in bad] == [
        "schemaVersion", "operationId", "durationMs", "app", "error", "statements", "statements", "keys", "keys", "types", "statements", "statements",
        "statements", "statements", "not a JSON object"]


def test_sql_files_and_statements(spark, tmp_path):
    for name, text in {"a.sql": "SELECT 1;\n-- no; \n\nSELECT ';' ;", "b/c.sql": "/* x;\n */ DELETE FROM t", "node_modules/d.sql": "SELECT 2", "e.txt": "SELECT 3"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    got = files.split_statements(files.sql_files(spark, str(tmp_path))).collect()
    assert sorted((r["path"], r["line"], r["sql"]) for r in got) == [("a.sql", 1, "SELECT 1"), ("a.sql", 4, "SELECT ';'"), ("b/c.sql", 2, "DELETE FROM t")]


def test_unknown_finding_keys_are_rejected(spark):
    good = {"schemaVersion": 1, "ruleId": "R", "severity": "LOW", "confidence": "LOW", "file": "f", "line": 1, "title": "t", "body": "b",
            "evidence": [{"source": "SQL", "description": "d", "data": {"b": 1, "a": [2]}}], "fingerprint": "x"}
    rows = [good, {**good, "extra": 1}, {**good, "schemaVersion": 2}, {k: v for k, v in good.items() if k != "title"}]
    rows += [{**good, "severity": "CRITICAL"}, {**good, "confidence": "XX"}, {**good, "line": "one"}, {**good, "title": None}, {**good, "evidence": [None]}]
    rows += [{**good, "evidence": [{**good["evidence"][0], **c}]} for c in ({"source": "NOPE"}, {"extra": 1}, {"line": "one"}, {"description": None})]
    found, rejected = files.parse_findings(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    assert [json.loads(r["evidence"][0]["data"]) for r in found.collect()] == [{"a": [2], "b": 1}] and rejected.count() == len(rows) - 1
    (line,) = [json.loads(r["value"]) for r in files.findings_json(found).collect()]
    assert line == good


def test_empty_fields_of_a_worksheet(spark, tmp_path):
    rows = [("a", ""), ("b", None), ("c", 'x "y",\nz')]
    for null, want in (("", ["", "", rows[2][1]]), ("<none>", ["", None, rows[2][1]])):
        path = str(tmp_path / f"sheet{len(null)}")
        files.write_csv(spark.createDataFrame(rows, "k string, v string"), path, null=null)
        sheet = files.read_worksheet(spark, path, null=null or None)
        assert [r["v"] for r in sorted(sheet.collect())] == want


def test_session_bounds_are_inclusive(spark):
    at = lambda m, s: datetime(2026, 1, 1, 10, m, s)
    ops = spark.createDataFrame([(1, at(0, 0)), (2, at(5, 30)), (3, at(5, 31)), (4, at(20, 0))], "id int, started_at timestamp_ntz")
    runs = spark.createDataFrame([("s", False, at(0, 0), at(5, 30)), ("s", True, at(20, 0), at(21, 0)), ("z", False, at(5, 31), at(6, 0))],
                                 "session_id string, warmup boolean, window_start timestamp_ntz, window_end timestamp_ntz")
    assert sorted(r["id"] for r in ev.in_session(ops, runs, "s").collect()) == [1, 2]


def test_context_is_numbered_and_marked(spark):
    text = "\n".join(f"l{i}" for i in range(1, 131)) + "\n"
    corpus = spark.createDataFrame([("f", text)], "path string, text string")
    flagged = spark.createDataFrame([("x", "f", 64, 65), ("y", "f", 130, None)], "finding_id string, path string, line int, end_line int")
    got = {r["finding_id"]: r["source_context"].split("\n") for r in files.source_context(corpus, flagged, context=2).collect()}
    assert got["x"] == ["  62 | l62", "  63 | l63", "> 64 | l64", "> 65 | l65", "  66 | l66", "  67 | l67"]
    assert got["y"] == ["  128 | l128", "  129 | l129", "> 130 | l130"]


def test_shapes_of_hard_texts(spark):
    shape = sqltext.shape
    assert shape("select * from t where id IN ($1::uuid, $2::uuid)") == shape("select * from t where id in ($1::uuid)") == "select * from t where id in(?)"
    assert shape("insert into t values (now(), 1), (now(), 2)") == shape("insert into t values (now(), 3)")
    assert shape("select 1e5, 0x1F, $$a -- b$$, E'it\\'s', $t$x$t$") == "select ?,?,?,?,?"
    assert shape("select a - 1 from t") == shape("select a-1 from t") == shape("select a -1 from t")
    assert shape("select -1") == shape("select 1")
    assert shape("select /* a /* nested */ b */ x") == "select x"
    assert shape('select * from "a--b" where z = 4 limit 1') == 'select * from "a--b" where z=? limit ?'
    assert "select" in shape("select * from t where a in (select b from u)")


def test_rules_at_any_depth():
    deep = "select " + "(" * 9 + "select 3 from q where a = 1 limit 3" + ")" * 9 + " as v from t"
    assert sqltext.unbounded(deep) == "SQL_UNBOUNDED_SELECT"
    assert sqltext.unbounded('select * from "a--b" where z = 4 limit 1') is None
    assert sqltext.unbounded("delete from t") == "SQL_UNBOUNDED_MUTATION"
    assert sqltext.unbounded("select count(*) as n, max(f(g(h(k(m(x)))))) from t") is None


def test_condition_columns_skip_types_and_constants():
    sql = "select * from t where x = 1e5 and t.id in ($1::uuid) and true and e = E'a' and a = '--x' and b = cast(c as text)"
    assert sqltext.conditions(sql) == ["x", "id", "e", "a", "b", "c"]


@pytest.mark.parametrize(
    ("sql", "rule", "columns"),
    [
        ("with x as (select 1) select * from t", "SQL_UNBOUNDED_SELECT", []),
        ("with recursive x(a, b) as (select 1 from u limit 2), y as materialized (select 1) select * from x limit 3", None, []),
        ("with x as (select * from t where z = 1) delete from t", "SQL_UNBOUNDED_MUTATION", ["z"]),
        ("with x as (select * from t where z = 1) select * from x where y = 2 limit 1", None, ["y"]),
        ("select a from t union all select b from u", None, []),
        ("select distinct max(a) from t", None, []),
        ("select string_agg(a, ',' order by b) x, count(*) as \"n\" from t where f > 1", None, ["f"]),
        ("select count(*) filter (where a) from t", "SQL_UNBOUNDED_SELECT", ["a"]),
        ("select max(a) over () from t", "SQL_UNBOUNDED_SELECT", []),
        ("select max(a) from t group by b", "SQL_UNBOUNDED_SELECT", []),
        ("select a from t where b = (select c from d limit 1)", "SQL_UNBOUNDED_SELECT", ["b", "c"]),
        ("select a is distinct from b", None, []),
        ("select 1 from t where a is not distinct from b limit 1", None, ["a", "b"]),
        ("select * from t where id in (select o.user_id from orders o where o.x = 1) and b = 2 limit 1", None, ["id", "user_id", "x", "b"]),
        ("select * from t where extract(year from ts) = 1 and year = 2 limit 1", None, ["ts", "year"]),
        ("select * from t where d > date '2024-01-01' and date = 1 limit 1", None, ["d", "date"]),
        ("delete from t where id = 1 returning id, x", None, ["id"]),
        ("select a from t where cast(a as double precision) > 1 and b::timestamp with time zone < c at time zone 'utc' limit 1", None, ["a", "b", "c"]),
        ("select a from t where a = 1 window w as (partition by b) limit 1", None, ["a"]),
        ("select a from t where timestamp with time zone '2024' < a and substring(n from 2 for 3) = 'x' and trim(both ' ' from q) = '' limit 1", None, ["a", "n", "q"]),
        ("select a from t where exists (select 1 from b bb join c on c.id = bb.cid left join d using (k) where bb.w = 1) or \"Ship\" ilike 'x' escape '\\' limit 1", None, ["id", "cid", "w", "Ship"]),
        ("select a from t where x = (select max(y) filter (where z > 1) over (order by r rows between 1 preceding and current row) as m from u uu) for update", "SQL_UNBOUNDED_SELECT", ["x", "y", "z", "r"]),
    ],
)
def test_scopes(sql, rule, columns):
    assert sqltext.unbounded(sql) == rule and sqltext.conditions(sql) == columns


def test_skeletons_keep_shapes_and_conditions(spark):
    """What Spark makes of a text before it is tokenised changes nothing that is read from the tokens."""
    rng = random.Random(5)
    pieces = [
        "select", "FROM", "where", "t1", "1abc", "x.y", "\"a 1\"", "\"q\"\"uote's\"", "'it''s'", "'--x'", "'/*'", "E'it\\'s'", "$$ a 'b' $$", "$t$ x $t$", "$1", "?", "5", "-7",
        "1e5", "0x1F", ".5", "2.", "in (1, 2)", "(", ")", ",", "=", "- 1", "a-1", "-- end 1\n", "/* c 2 */", "/* a /* b */ c */", "\n", "values (1, 'a'), (2, 'b')", "array[1,2]", "::int",
        "é", "'open", "\"open", "true", "and", "date '2024'", ";",
    ]
    texts = ["".join(rng.choice([" ", "", " "]) + rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "sql string")
    for r in rows.select("sql", exprs.query_shape("sql").alias("shape"), exprs.filter_columns("sql").alias("columns")).collect():
        assert r["shape"] == sqltext.shape(r["sql"]), r["sql"]
        assert r["columns"] == sqltext.conditions(r["sql"]), r["sql"]


def test_constants_are_replaced_over_plain_runs():
    texts = ["select a-5, -5, 1.-5, \"a (?, ?)\" -7 from t where x in (-1,\n2 , $3) and e'it\\'s' = .5 -- 1\n", "it's 5 o'clock/* a /* b */ 7 */ (1, ?)", "in(1 2)((3))é-4 ²-5"]
    assert [sqltext.placeholders(t, True) for t in texts] == [
        'select a-?, ?, ?-?, "a (?, ?)" ? from t where x in (?) and ? = ?', "it?clock (?)", "in(? ?)((?))é-? ²?"
    ]
    prose = "word " * 1000 + "5"
    assert len(list(sqltext._runs(prose))) == 2  # not a token for every word and space


def test_results_of_long_texts_are_not_kept():
    calls = []
    read = sqltext._remembering(lambda text: calls.append(text))
    for text in ("a", "a", "b" * 3000, "b" * 3000):
        read(text)
    assert [len(c) for c in calls] == [1, 3000, 3000]


def test_statements_over_pieces_of_a_text(spark, monkeypatch):
    text = "/* x; */ SELECT 'a;b'';c' -- no;\n, 1;\n\n UPDATE t SET a = 1 / 2 - 3;" + "DELETE FROM t; " * 30
    monkeypatch.setattr(files, "PIECE", 3)
    corpus = spark.createDataFrame([("p", text), ("q", "SELECT 1"), ("none", None), ("empty", "")], "path string, text string").coalesce(1)
    got = [tuple(r) for r in files.split_statements(corpus).collect()]
    assert got == [("p", 1, "SELECT 'a;b'';c' \n, 1"), ("p", 4, "UPDATE t SET a = 1 / 2 - 3")] + [("p", 4, "DELETE FROM t")] * 30 + [("q", 1, "SELECT 1")]


def test_unbounded_rules_take_one_pass(spark):
    found = behaviour.unbounded_statements(spark.createDataFrame([("delete from t",), ("select 1",)], "sql string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in found.collect()] == [("delete from t", "SQL_UNBOUNDED_MUTATION", "HIGH")]


def test_events_are_parsed_once(spark):
    for side in ev.parse_events(spark.createDataFrame([("{",)], "value string")):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3
