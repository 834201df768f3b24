"""Correlation, scoring and statistics queries on the driver tables.

Findings, ground truth, outcomes and labels are derived row by row from customers, parts, suppliers,
events and documents, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.exprs import pick
from ..operators import correlate as corr
from ..operators import scoring, stats
from ..session import cut, spread
from ..sources.tables import Tables
from .quality import sql_pick
from .registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _item(source: str, data) -> F.Column:
    return F.struct(
        F.lit(source).alias("source"), F.lit(f"{source} evidence").alias("description"), F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("line"), F.to_json(data).alias("data"),
    )


def _finding(df: DataFrame, rule, file, line, confidence, fingerprint, evidence) -> DataFrame:
    return df.select(
        F.lit(1).alias("schema_version"), rule.alias("rule_id"), F.lit("MEDIUM").alias("severity"), confidence.alias("confidence"),
        file.alias("file"), line.cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"), F.lit("title").alias("title"),
        F.lit("body").alias("body"), evidence.alias("evidence"), F.lit("fix").alias("suggested_fix"), fingerprint.alias("fingerprint"),
    )


# ---- correlation ------------------------------------------------------------------------------------


def _layer_findings(t: Tables) -> DataFrame:
    div = lambda c, n: F.floor(F.col(c) / n).cast("string")
    file = lambda c, n: F.concat(F.lit("src/app/r"), div(c, n), F.lit("/route.ts"))
    print_of = lambda tag, c: F.md5(F.concat(F.lit(tag), F.col(c)).cast("binary"))
    seg = lambda n: F.get(F.array(*[F.lit(s) for s in SEGMENTS]), n.cast("int"))

    level = F.when(F.col("c_acctbal") >= 6000, "HIGH").when(F.col("c_acctbal") >= 2000, "MEDIUM").otherwise("LOW")
    static = _finding(
        t.customer, F.lit(corr.N_PLUS_ONE), file("c_custkey", 60), F.col("c_custkey"), level, print_of("s", "c_custkey"),
        F.array(_item("STATIC_SOURCE", F.struct(F.col("c_mktsegment").alias("model")))),
    )
    model = seg(F.col("p_partkey") % 5)
    declared = F.struct(
        F.concat(F.lit("t"), div("p_partkey", 4)).alias("table"),
        F.array(F.concat(F.lit("c"), F.col("p_partkey") % 4), F.lit("z")).alias("columns"),
    )
    size = F.when(F.col("p_size") > 30, "HIGH").when(F.col("p_size") > 10, "MEDIUM").otherwise("LOW")
    index = _finding(
        t.part, F.lit(corr.MISSING_INDEX), file("p_partkey", 80), F.col("p_partkey"), size, print_of("m", "p_partkey"),
        F.array(_item("STATIC_SOURCE", F.struct(model.alias("model"))), _item("DECLARED_SCHEMA", declared)),
    )
    route = F.concat(F.lit("/r"), div("s_suppkey", 4))
    observed = F.struct(
        route.alias("route"), seg(F.col("s_nationkey") % 5).alias("model"), F.col("s_suppkey").alias("maxExecutionsPerRequest"),
        F.lit(1).alias("requestsAffected"), F.lit(2).alias("requestsObserved"),
    )
    runtime = _finding(
        t.supplier, F.lit(corr.RUNTIME_N_PLUS_ONE), F.concat(F.lit("route:"), route), F.lit(0),
        F.when(F.col("s_acctbal") > 5000, "HIGH").otherwise("MEDIUM"), print_of("r", "s_suppkey"),
        F.array(_item("RUNTIME", observed), _item("SQL", F.struct(F.lit("select * from t where id = ?").alias("normalizedSql")))),
    )
    orphaned = F.struct(
        F.concat(F.lit("t"), div("c_custkey", 4)).alias("table"), F.array(F.lit("fk")).alias("columns"),
        F.concat(F.lit("p"), F.col("c_custkey")).alias("referencedTable"),
    )
    orphans = _finding(
        t.customer.where(F.col("c_mktsegment") == "BUILDING"), F.lit(corr.ORPHANED_FOREIGN_KEY), F.lit("schema.json"), F.col("c_custkey"),
        F.when(F.col("c_acctbal") > 5000, "HIGH").otherwise("LOW"), print_of("o", "c_custkey"), F.array(_item("DATA_QUALITY", orphaned)),
    )
    return cut(static.unionByName(index).unionByName(runtime).unionByName(orphans))


def _layer_catalog(t: Tables) -> dict[str, DataFrame]:
    div = lambda c: F.concat(F.lit("t"), F.floor(F.col(c) / 4).cast("string"))
    tables = t.part.select(div("p_partkey").alias("table")).distinct().where(pick("table", ":tab") >= 20)
    keys = t.part.where(pick("p_partkey", ":ix") < 128).select(
        div("p_partkey").alias("table"), F.concat(F.lit("ix_"), "p_partkey").alias("name"),
        F.array(F.concat(F.lit("c"), F.col("p_partkey") % 4), F.lit("z")).alias("columns"),
        F.when(pick("p_partkey", ":partial") < 64, "p > 0").alias("predicate"), F.lit(False).alias("has_expression"),
        F.lit("index").alias("definition"),
    )
    foreign = t.customer.where(pick("c_custkey", ":fk") < 128).select(
        div("c_custkey").alias("table"), F.concat(F.lit("fk_"), "c_custkey").alias("name"), F.array(F.lit("fk")).alias("columns"),
        F.concat(F.lit("p"), "c_custkey").alias("referenced_table"), F.lit("CASCADE").alias("on_delete"),
    )
    return {"tables": tables, "keys": keys, "foreign_keys": foreign}


_SQL_CONFIDENCE = "CASE WHEN {x} >= ln(4) THEN 'HIGH' WHEN {x} >= 0 THEN 'MEDIUM' ELSE 'LOW' END"
_SQL_PRIOR = "CASE {c} WHEN 'HIGH' THEN 1.5 WHEN 'MEDIUM' THEN 0.5 ELSE -0.5 END"
_SQL_SEG = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST({n} AS INTEGER) + 1]"
_SQL_CORRELATE = f"""WITH tabs AS (SELECT DISTINCT 't' || (p_partkey // 4) AS tab FROM part WHERE {sql_pick("('t' || (p_partkey // 4))", ':tab')} >= 20),
    st AS (SELECT '/r' || (c_custkey // 60) AS route, c_mktsegment AS model, 'src/app/r' || (c_custkey // 60) || '/route.ts' AS file, c_custkey AS line, md5('s' || c_custkey) AS fp,
      CASE WHEN c_acctbal >= 6000 THEN 'HIGH' WHEN c_acctbal >= 2000 THEN 'MEDIUM' ELSE 'LOW' END AS conf FROM customer),
    mi0 AS (SELECT '/r' || (p_partkey // 80) AS route, {_SQL_SEG.format(n='(p_partkey % 5)')} AS model, 'src/app/r' || (p_partkey // 80) || '/route.ts' AS file, p_partkey AS line, md5('m' || p_partkey) AS fp,
      CASE WHEN p_size > 30 THEN 'HIGH' WHEN p_size > 10 THEN 'MEDIUM' ELSE 'LOW' END AS conf, 't' || (p_partkey // 4) IN (SELECT tab FROM tabs) AS known,
      {sql_pick('p_partkey', ':ix')} < 128 AND {sql_pick('p_partkey', ':partial')} >= 64 AS present FROM part),
    mi AS (SELECT *, {_SQL_PRIOR.format(c='conf')} + CASE WHEN present THEN -4 ELSE 1 END AS logit FROM mi0),
    rt AS (SELECT '/r' || (s_suppkey // 4) AS route, {_SQL_SEG.format(n='(s_nationkey % 5)')} AS model, 'route:/r' || (s_suppkey // 4) AS file, 0 AS line, md5('r' || s_suppkey) AS fp,
      CASE WHEN s_acctbal > 5000 THEN 'HIGH' ELSE 'MEDIUM' END AS conf FROM supplier),
    orp AS (SELECT c_custkey AS line, md5('o' || c_custkey) AS fp, CASE WHEN c_acctbal > 5000 THEN 'HIGH' ELSE 'LOW' END AS conf, 't' || (c_custkey // 4) AS tab,
      't' || (c_custkey // 4) IN (SELECT tab FROM tabs) AS known, {sql_pick('c_custkey', ':fk')} < 128 AS enforced FROM customer WHERE c_mktsegment = 'BUILDING'),
    os AS (SELECT *, {_SQL_PRIOR.format(c='conf')} + CASE WHEN enforced THEN -3 ELSE 1.5 END AS logit FROM orp),
    sites AS (SELECT route, model, max(s) AS s, max(r) AS r, max(e) AS e FROM (SELECT route, model, 1 AS s, 0 AS r, 0 AS e FROM st UNION ALL SELECT route, model, 0, 1, 0 FROM rt
      UNION ALL SELECT route, model, 0, 0, 1 FROM mi WHERE known AND logit < 0) GROUP BY ALL),
    mg AS (SELECT * FROM sites WHERE r = 1 AND (s = 1 OR e = 1)),
    n1 AS (SELECT m.route, m.model, m.s, coalesce((SELECT max({_SQL_PRIOR.format(c='conf')}) FROM st WHERE st.route = m.route AND st.model = m.model), 0)
        + (SELECT max(CASE conf WHEN 'HIGH' THEN 2.5 ELSE 1.5 END) FROM rt WHERE rt.route = m.route AND rt.model = m.model) AS logit,
      CASE WHEN m.s = 1 THEN (SELECT arg_min(struct_pack(file, line, fp), line) FROM st WHERE st.route = m.route AND st.model = m.model)
        ELSE (SELECT arg_min(struct_pack(file, line, fp), line) FROM mi WHERE known AND logit < 0 AND mi.route = m.route AND mi.model = m.model) END AS anchor FROM mg m)"""


@query(
    "correlate_findings",
    _SQL_CORRELATE + f""" SELECT CASE WHEN s = 1 THEN 'N_PLUS_ONE_IN_LOOP' ELSE 'RUNTIME_N_PLUS_ONE' END AS rule_id, anchor.file AS file, anchor.line AS line, {_SQL_CONFIDENCE.format(x='logit')} AS confidence,
          CASE WHEN s = 1 THEN anchor.fp ELSE substr(sha256('RUNTIME_N_PLUS_ONE' || chr(0) || anchor.fp || chr(0) || route || ':' || model), 1, 32) END AS fingerprint FROM n1
        UNION ALL SELECT 'MISSING_INDEX_ON_FILTERED_FIELD', file, line, {_SQL_CONFIDENCE.format(x='logit')}, fp FROM mi WHERE known AND logit >= 0
        UNION ALL SELECT 'MISSING_INDEX_ON_FILTERED_FIELD', file, line, conf, fp FROM mi WHERE NOT known
        UNION ALL SELECT 'ORPHANED_FOREIGN_KEY', 'schema.json', line, {_SQL_CONFIDENCE.format(x='logit')}, fp FROM os WHERE known
        UNION ALL SELECT 'ORPHANED_FOREIGN_KEY', 'schema.json', line, conf, fp FROM os WHERE NOT known
        UNION ALL SELECT 'N_PLUS_ONE_IN_LOOP', file, line, conf, fp FROM st WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.route = st.route AND mg.model = st.model)
        UNION ALL SELECT 'RUNTIME_N_PLUS_ONE', file, line, conf, fp FROM rt WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.route = rt.route AND mg.model = rt.model)""",
)
def correlate_findings(t: Tables) -> DataFrame:
    found, _ = corr.correlate(_layer_findings(t), _layer_catalog(t))
    return found.select("rule_id", "file", "line", "confidence", "fingerprint")


@query(
    "correlate_decisions",
    _SQL_CORRELATE + """ SELECT route || ':' || model AS site, CASE WHEN s = 1 THEN 'N_PLUS_ONE_IN_LOOP' ELSE 'RUNTIME_N_PLUS_ONE' END AS rule_id, CAST(logit AS DOUBLE) AS logit,
          round(1 / (1 + exp(-logit)), 6) AS posterior, true AS emitted, CASE WHEN s = 0 THEN 'MISSING_INDEX_ON_FILTERED_FIELD' END AS type_changed_from,
          (SELECT count(*) FROM st WHERE st.route = n1.route AND st.model = n1.model) + (SELECT count(*) FROM rt WHERE rt.route = n1.route AND rt.model = n1.model) AS consumed FROM n1
        UNION ALL SELECT route || ':' || model, 'MISSING_INDEX_ON_FILTERED_FIELD', CAST(logit AS DOUBLE), round(1 / (1 + exp(-logit)), 6), logit >= 0, NULL, 1 FROM mi WHERE known
        UNION ALL SELECT 'table:' || tab, 'ORPHANED_FOREIGN_KEY', CAST(logit AS DOUBLE), round(1 / (1 + exp(-logit)), 6), true, NULL, 1 FROM os WHERE known""",
)
def correlate_decisions(t: Tables) -> DataFrame:
    _, decisions = corr.correlate(_layer_findings(t), _layer_catalog(t))
    return decisions.select("site", "rule_id", "logit", "posterior", "emitted", "type_changed_from", F.size("consumed").cast("bigint").alias("consumed"))


@query(
    "log_odds",
    f"""SELECT p_size AS size, round(1 / (1 + exp(-(p_size - 25) / 10)), 6) AS posterior, {_SQL_CONFIDENCE.format(x='((p_size - 25) / 10)')} AS confidence, count(*) AS rows FROM part GROUP BY p_size""",
)
def log_odds(t: Tables) -> DataFrame:
    x = (F.col("p_size") - 25) / 10
    return t.part.groupBy(F.col("p_size").alias("size"), exprs.posterior(x).alias("posterior"), exprs.confidence_for(x).alias("confidence")).agg(
        F.count(F.lit(1)).alias("rows")
    )


# ---- scoring ------------------------------------------------------------------------------------------


def _truth(t: Tables) -> DataFrame:
    kind = F.col("c_mktsegment")
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    by = lambda **v: F.coalesce(*[F.when(kind == k, x) for k, x in v.items()])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = F.when(kind == "AUTOMOBILE", key % 50 * 10 + 1).when(kind == "BUILDING", key + 1)
    return t.customer.select(
        text("app", key % 2).alias("app"), text("e", key).alias("id"),
        by(MACHINERY=F.lit("null_spike"), BUILDING=F.lit("n_plus_one"), AUTOMOBILE=F.lit("missing_index"), FURNITURE=F.lit("duplicate_spike"),
           HOUSEHOLD=F.lit("orphaned_foreign_key")).alias("problem_type"),
        F.when(kind.isin("BUILDING", "AUTOMOBILE"), "performance").otherwise("data_quality").alias("category"),
        by(AUTOMOBILE=text("./src/f", F.col("c_nationkey") % 10, ".ts"), BUILDING=F.lit("src/none.ts")).alias("file"),
        line.cast("int").alias("line"), F.when(kind == "AUTOMOBILE", line + 5).cast("int").alias("end_line"),
        by(BUILDING=text("GET /api/u/:id/", F.col("c_nationkey") % 15), AUTOMOBILE=F.lit("GET /none")).alias("endpoint"),
        F.lit(None).cast("string").alias("anchor"),
        by(MACHINERY=text("t", F.col("c_nationkey") % 20), FURNITURE=text('"T', F.col("c_nationkey") % 20, '"'), HOUSEHOLD=text("o", nation)).alias("table"),
        by(MACHINERY=text("c", key % 3)).alias("column"),
        by(MACHINERY=F.lit("NULL_SPIKE"), BUILDING=F.lit("RUNTIME_N_PLUS_ONE"), AUTOMOBILE=F.lit("MISSING_INDEX_ON_FILTERED_FIELD"),
           FURNITURE=F.lit("DUPLICATE_SPIKE"), HOUSEHOLD=F.lit("ORPHANED_FOREIGN_KEY")).alias("expected_rule_id"),
        F.lit("injected").alias("description"),
    )


def _reported(t: Tables) -> DataFrame:
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rules = {"error": "NULL_SPIKE", "view": "RUNTIME_N_PLUS_ONE", "click": "MISSING_INDEX_ON_FILTERED_FIELD", "signup": "DUPLICATE_SPIKE", "purchase": "SQL_UNBOUNDED_MUTATION"}
    rule = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])[kind]
    data = F.struct(
        F.when(kind == "error", text("t", user % 20)).when(kind == "signup", text("public.t", user % 20)).alias("table"),
        F.when(kind == "error", text("C", event % 3)).when(kind == "signup", "x").alias("column"),
        F.when(kind == "view", text("/api/u/[id]/", user % 15)).alias("route"),
    )
    file = F.when(kind == "click", text("src/f", user % 10, ".ts")).otherwise(text("at:", user))
    return t.events.select(
        text("app", user % 2).alias("app"), F.lit(1).alias("schema_version"), rule.alias("rule_id"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("confidence"),
        file.alias("file"), F.when(kind == "click", event % 50 * 10 + 3).otherwise(0).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"),
        F.md5(event.cast("string").cast("binary")).alias("fingerprint"), F.array(_item("RUNTIME", data)).alias("evidence"),
    )


_SQL_SCORE = """WITH e AS (SELECT 'app' || (c_custkey % 2) AS app, 'e' || c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'null_spike' WHEN 'BUILDING' THEN 'n_plus_one' WHEN 'AUTOMOBILE' THEN 'missing_index'
      WHEN 'FURNITURE' THEN 'duplicate_spike' ELSE 'orphaned_foreign_key' END AS type,
      CASE c_mktsegment WHEN 'MACHINERY' THEN (c_nationkey % 20) || '.' || (c_custkey % 3) WHEN 'BUILDING' THEN '' || (c_nationkey % 15) WHEN 'AUTOMOBILE' THEN (c_nationkey % 10) || '@' || (c_custkey % 50)
      WHEN 'FURNITURE' THEN '' || (c_nationkey % 20) ELSE 'none' END AS k FROM customer),
    f AS (SELECT 'app' || (user_id % 2) AS app, CASE event_type WHEN 'error' THEN 'null_spike' WHEN 'view' THEN 'n_plus_one' WHEN 'click' THEN 'missing_index' WHEN 'signup' THEN 'duplicate_spike' END AS type,
      CASE event_type WHEN 'error' THEN (user_id % 20) || '.' || (event_id % 3) WHEN 'view' THEN '' || (user_id % 15) WHEN 'click' THEN (user_id % 10) || '@' || (event_id % 50)
      WHEN 'signup' THEN '' || (user_id % 20) ELSE 'x' END AS k, CASE WHEN value > 50 THEN 3 ELSE 1 END AS rank FROM events),
    ek AS (SELECT app, type, k, count(*) AS e FROM e GROUP BY ALL), fk AS (SELECT app, type, k, count(*) AS n FROM f GROUP BY ALL),
    b AS (SELECT coalesce(ek.app, fk.app) AS app, coalesce(ek.type, fk.type) AS type, coalesce(e, 0) AS e, coalesce(n, 0) AS n FROM ek FULL JOIN fk ON ek.app = fk.app AND ek.type = fk.type AND ek.k = fk.k),
    c AS (SELECT app, type, CASE WHEN type IN ('n_plus_one', 'missing_index') THEN 'performance' WHEN type IS NOT NULL THEN 'data_quality' END AS category, sum(least(e, n))::BIGINT AS tp,
      sum(CASE WHEN e = 0 THEN n ELSE 0 END)::BIGINT AS fp, sum(e - least(e, n))::BIGINT AS fn, sum(CASE WHEN e > 0 THEN n - least(e, n) ELSE 0 END)::BIGINT AS duplicates FROM b GROUP BY ALL)"""
_SQL_RATES = """, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
    CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END END AS f1"""



@query(
    "score_counts",
    _SQL_SCORE + f""", r AS (SELECT app, 'problem_type' AS level, category, type AS problem_type, tp, fp, fn, duplicates FROM c WHERE type IS NOT NULL
        UNION ALL SELECT app, 'category', category, NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(duplicates)::BIGINT FROM c WHERE type IS NOT NULL GROUP BY app, category
        UNION ALL SELECT app, 'total', NULL, NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(duplicates)::BIGINT FROM c GROUP BY app), q AS (SELECT * {_SQL_RATES} FROM r)
        SELECT * REPLACE (round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1) FROM q""",
)
def score_counts(t: Tables) -> DataFrame:
    rolled = scoring.counts_rollup(scoring.score(_reported(t), _truth(t)))
    return rolled.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("score_entries", _SQL_SCORE + " SELECT app, type AS problem_type, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn FROM c WHERE type IS NOT NULL GROUP BY ALL")
def score_entries(t: Tables) -> DataFrame:
    judged = scoring.score(_reported(t), _truth(t))["entries"]
    return judged.groupBy("app", "problem_type").agg(F.count_if(F.col("outcome") == "tp").alias("tp"), F.count_if(F.col("outcome") == "fn").alias("fn"))


@query("score_matches", _SQL_SCORE + " SELECT app, type AS problem_type, tp AS matches, tp AS entries, tp AS findings FROM c WHERE tp > 0")
def score_matches(t: Tables) -> DataFrame:
    """Matches pair distinct entries with distinct findings."""
    matches = scoring.score(_reported(t), _truth(t))["matches"]
    return matches.groupBy("app", "problem_type").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("entry_id").alias("entries"), F.countDistinct("fingerprint").alias("findings")
    )


@query(
    "candidate_edges",
    _SQL_SCORE + " SELECT f.app AS app, f.type AS problem_type, count(*) AS edges FROM f JOIN (SELECT DISTINCT app, type, k FROM e) d ON d.app = f.app AND d.type = f.type AND d.k = f.k GROUP BY ALL",
)
def candidate_edges(t: Tables) -> DataFrame:
    truth = _truth(t).withColumns({"line": F.when(F.col("problem_type") == "missing_index", F.col("line"))})
    truth = truth.withColumns({"file": F.when(F.col("line").isNotNull(), F.col("file"))})
    edges = scoring.candidate_edges(truth, _reported(t))
    return edges.groupBy("app", "problem_type").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "result_rows",
    _SQL_SCORE + """, u AS (SELECT app, type, count(*) + 400 AS units FROM e WHERE type <> 'orphaned_foreign_key' GROUP BY ALL)
      SELECT c.app, c.type AS problem_type, (SELECT count(*) FROM e WHERE e.app = c.app AND e.type = c.type) AS entries, tp, fp, fn, duplicates,
        CASE WHEN units IS NOT NULL THEN round(least(fp / 400, 1), 9) END AS fpr FROM c LEFT JOIN u ON u.app = c.app AND u.type = c.type WHERE c.type IS NOT NULL
      UNION ALL SELECT app, 'unmapped', 0, 0, fp, 0, 0, NULL FROM c WHERE type IS NULL""",
)
def result_rows(t: Tables) -> DataFrame:
    truth = _truth(t)
    universe = truth.where(F.col("problem_type") != "orphaned_foreign_key").groupBy("app", "problem_type").agg((F.count(F.lit(1)) + 400).alias("units"))
    rows = scoring.result_rows(scoring.score(_reported(t), truth), universe)
    return rows.select("app", "problem_type", "entries", "tp", "fp", "fn", "duplicates", F.round("fpr", 9).alias("fpr"))


def _flawed_truth(t: Tables) -> DataFrame:
    truth = _truth(t)
    flaw = lambda salt, n: pick("id", salt) < n
    return truth.withColumns({
        "category": F.when(flaw(":cat", 8), "performance").otherwise(F.col("category")),
        "endpoint": F.when(flaw(":end", 8), F.lit(None)).otherwise(F.col("endpoint")),
        "end_line": F.when(flaw(":line", 8), F.lit(0)).otherwise(F.col("end_line")),
    })


@query(
    "validate_manifest",
    f"""WITH e AS (SELECT 'app' || (c_custkey % 2) AS app, 'e' || c_custkey AS id, c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS perf, {sql_pick("('e' || c_custkey)", ':cat')} < 8 AS cat,
          {sql_pick("('e' || c_custkey)", ':end')} < 8 AS en, {sql_pick("('e' || c_custkey)", ':line')} < 8 AS ln FROM customer)
        SELECT app, id, 'wrong category for this problem' AS problem FROM e WHERE cat AND NOT perf
        UNION ALL SELECT app, id, 'slow code without file' FROM e WHERE cat AND NOT perf UNION ALL SELECT app, id, 'slow code without line' FROM e WHERE cat AND NOT perf
        UNION ALL SELECT app, id, 'slow code without endpoint' FROM e WHERE (cat AND NOT perf) OR (perf AND en)
        UNION ALL SELECT app, id, 'ends before it begins' FROM e WHERE ln""",
)
def validate_manifest(t: Tables) -> DataFrame:
    return scoring.validate_manifest(_flawed_truth(t))


@query(
    "universe_counts",
    """SELECT app, unnest(['n_plus_one', 'missing_index', 'excessive_relation_loading', 'repeated_identical_query', 'unpaginated_find_many']) AS problem_type, units
         FROM (SELECT 'app' || (c_custkey % 2) AS app, count(*) AS units FROM customer GROUP BY 1)
       UNION ALL SELECT 'app' || (o_custkey % 2), 'orphaned_foreign_key', count(*) FROM orders GROUP BY 1
       UNION ALL SELECT 'app' || (p_partkey % 2), 'index_not_declared', count(*) FROM part GROUP BY 1
       UNION ALL SELECT 'app' || (s_suppkey % 2), 'declared_index_not_applied', count(*) FROM supplier GROUP BY 1""",
)
def universe_counts(t: Tables) -> DataFrame:
    app = lambda df, c: df.select(F.concat(F.lit("app"), F.col(c) % 2).alias("app"))
    files = t.customer.select("c_custkey", F.concat(F.lit("src/app/r"), "c_custkey", F.lit("/route.ts")).alias("file"))
    handlers = files.where(exprs.route_for_file("file").isNotNull())
    return scoring.universe_counts(app(handlers, "c_custkey"), app(t.orders, "o_custkey"), app(t.part, "p_partkey"), app(t.supplier, "s_suppkey"))


_LAYERS = "['static_orm', 'sql', 'declared', 'actual', 'runtime', 'data']"


@query(
    "findings_by_configuration",
    f"""WITH f AS (SELECT {_LAYERS}[CAST(event_id % 6 AS INTEGER) + 1] AS layer, CASE WHEN user_id % 2 = 0 THEN 'captured' ELSE 'repository' END AS src FROM events),
        c AS (SELECT * FROM (VALUES ('A', ['sql']), ('B1', ['static_orm', 'sql']), ('B2', ['static_orm', 'sql', 'declared']), ('C1', ['static_orm', 'sql', 'declared', 'actual']),
          ('C2', ['static_orm', 'sql', 'declared', 'actual', 'runtime']), ('C3', {_LAYERS}), ('A-log', ['sql'])) v(config, layers))
        SELECT config, count(*) AS findings FROM f JOIN c ON list_contains(layers, layer) WHERE layer <> 'sql' OR src = CASE WHEN config = 'A-log' THEN 'captured' ELSE 'repository' END GROUP BY config""",
)
def findings_by_configuration(t: Tables) -> DataFrame:
    layers = F.array(*[F.lit(x) for x in ("static_orm", "sql", "declared", "actual", "runtime", "data")])
    found = t.events.select(
        F.get(layers, (F.col("event_id") % 6).cast("int")).alias("layer"), F.when(F.col("user_id") % 2 == 0, "captured").otherwise("repository").alias("sql_source")
    )
    return scoring.findings_by_configuration(found).groupBy("config").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "detection_latency",
    """SELECT 'app' || (user_id % 2) AS app, 'e' || user_id AS entry_id, coalesce(min(value) FILTER (WHERE event_type = 'view' AND value < 20), 500.0) AS latency_s FROM events GROUP BY ALL""",
)
def detection_latency(t: Tables) -> DataFrame:
    steps = t.events.select(
        F.concat(F.lit("app"), F.col("user_id") % 2).alias("app"), F.concat(F.lit("e"), "user_id").alias("entry_id"),
        ((F.col("event_type") == "view") & (F.col("value") < 20)).alias("found"), F.col("value").alias("elapsed_s"), F.lit(500.0).alias("wall_s"),
    )
    return scoring.detection_latency(steps)


# ---- outcomes of configurations -------------------------------------------------------------------------

_CONFIGS = {"A": 0, "A-log": 60, "B1": 70, "B2": 100, "C1": 130, "C2": 132, "C3": 190}
_TYPES = ["n_plus_one", "missing_index", "unpaginated_find_many", "null_spike", "duplicate_spike", "distribution_shift", "orphaned_foreign_key", "index_not_declared"]


def _outcomes(t: Tables) -> DataFrame:
    """Each part is a problem, judged by every configuration in three repetitions."""
    # Each part becomes 21 rows.
    base = spread(t.part.select("p_partkey", "p_size"), "p_partkey").select(
        F.concat(F.lit("app"), F.col("p_size") % 2).alias("app"), F.concat(F.lit("p"), "p_partkey").alias("entry_id"),
        F.get(F.array(*[F.lit(x) for x in _TYPES]), (F.col("p_partkey") % len(_TYPES)).cast("int")).alias("problem_type"), "p_partkey", "p_size",
    )
    configs = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(n).alias("limit")) for c, n in _CONFIGS.items()])
    rows = base.withColumn("c", F.explode(configs)).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(3))))
    hash_of = pick(F.concat_ws("-", "p_partkey", "repetition"), ":r")
    detected = (pick("p_partkey", ":d") < F.col("c.limit")) & ~((F.col("c.config") == "C2") & (hash_of < 20))
    return rows.select(
        F.col("c.config").alias("config"), "app", "repetition", "entry_id", "problem_type", detected.alias("detected"),
        F.when(detected, F.col("p_size") % 3 + 1 - F.when(F.col("c.config") == "B1", F.col("p_size") % 2).otherwise(0)).cast("int").alias("confidence"),
        F.when(detected, (F.col("p_size") + F.length("c.config")) / 10).alias("latency_s"),
    )


_SQL_CONFIGS = "(VALUES " + ", ".join(f"('{c}', {n})" for c, n in _CONFIGS.items()) + ") c(config, lim)"
_SQL_OUTCOMES = f"""oc AS (SELECT config, 'app' || (p_size % 2) AS app, r AS repetition, 'p' || p_partkey AS entry_id, {_TYPES}[CAST(p_partkey % {len(_TYPES)} AS INTEGER) + 1] AS problem_type, p_size,
    {sql_pick('p_partkey', ':d')} < lim AND NOT (config = 'C2' AND {sql_pick("(p_partkey || '-' || r)", ':r')} < 20) AS detected FROM part, {_SQL_CONFIGS}, range(1, 4) t(r)),
  oo AS (SELECT *, CASE WHEN detected THEN p_size % 3 + 1 - CASE WHEN config = 'B1' THEN p_size % 2 ELSE 0 END END AS confidence, CASE WHEN detected THEN (p_size + len(config)) / 10 END AS latency_s FROM oc),
  rn AS (SELECT config, app, repetition, count(*) FILTER (WHERE detected) AS tp, count(*) FILTER (WHERE NOT detected) AS fn, count(*) FILTER (WHERE p_size = 50) AS fp, count(*) * 10 AS negatives,
    sum(p_size) / 100 + any_value(repetition) AS wall_s, sum(CASE WHEN detected THEN p_size ELSE 0 END) / 100 AS cpu_s FROM oo GROUP BY ALL),
  cd AS (SELECT config, app, entry_id, any_value(problem_type) AS problem_type, 2 * count(*) FILTER (WHERE detected) > count(*) AS detected FROM oo GROUP BY ALL)"""


def _runs(t: Tables) -> DataFrame:
    sized = _outcomes(t).join(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("entry_id"), "p_size"), "entry_id")
    return sized.groupBy("config", "app", "repetition").agg(
        F.count_if("detected").alias("tp"), F.count_if(~F.col("detected")).alias("fn"), F.count_if(F.col("p_size") == 50).alias("fp"),
        (F.count(F.lit(1)) * 10).alias("negatives"), (F.sum("p_size") / 100).alias("w"),
        (F.sum(F.when(F.col("detected"), F.col("p_size")).otherwise(0)) / 100).alias("cpu_s"),
    ).withColumn("wall_s", F.col("w") + F.col("repetition")).drop("w")


@query("canonical_detection", f"WITH {_SQL_OUTCOMES} SELECT config, app, entry_id, problem_type, detected FROM cd")
def canonical_detection(t: Tables) -> DataFrame:
    return scoring.canonical_detection(_outcomes(t))


@query(
    "stability",
    f"""WITH {_SQL_OUTCOMES}, s AS (SELECT config, app, repetition, md5(coalesce(string_agg(entry_id, ',' ORDER BY entry_id) FILTER (WHERE detected), '')) AS h FROM oo GROUP BY ALL),
        p AS (SELECT config, app, count(DISTINCT h) AS n FROM s GROUP BY ALL) SELECT config, max(n) = 1 AS identical_detections, true AS identical_false_positives FROM p GROUP BY config""",
)
def stability(t: Tables) -> DataFrame:
    return scoring.stability(_outcomes(t), _runs(t))


@query(
    "run_metrics",
    f"""WITH {_SQL_OUTCOMES}, r AS (SELECT config, repetition, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(negatives)::BIGINT AS neg, sum(wall_s) AS wall, sum(cpu_s) AS cpu FROM rn GROUP BY ALL),
        l AS (SELECT config, repetition, avg(latency_s) AS lat FROM oo GROUP BY ALL), q AS (SELECT * {_SQL_RATES} FROM r)
        SELECT config, repetition, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(fp / neg, 9) AS false_positive_rate,
          round(lat, 6) AS detection_latency_s, round(wall, 4) AS wall_s, round(cpu, 4) AS cpu_s FROM q JOIN l USING (config, repetition)""",
)
def run_metrics(t: Tables) -> DataFrame:
    rows = scoring.run_metrics(_runs(t), _outcomes(t)).drop("negatives")
    digits = {"precision": 9, "recall": 9, "f1": 9, "false_positive_rate": 9, "detection_latency_s": 6, "wall_s": 4, "cpu_s": 4}
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _type_rows(t: Tables) -> DataFrame:
    return _outcomes(t).groupBy("config", "app", "repetition", "problem_type").agg(
        F.count_if("detected").alias("tp"), F.count_if(F.col("detected") & (F.col("confidence") == 1)).alias("fp"),
        F.count_if(~F.col("detected")).alias("fn"), F.count(F.lit(1)).alias("entries"),
    )


@query(
    "per_problem_type",
    f"""WITH {_SQL_OUTCOMES}, x AS (SELECT config, repetition, problem_type, count(*) FILTER (WHERE detected) AS tp, count(*) FILTER (WHERE detected AND confidence = 1) AS fp, count(*) FILTER (WHERE NOT detected) AS fn,
          count(*) AS entries, count(DISTINCT app) * 5000 AS units FROM oo GROUP BY ALL), y AS (SELECT *, greatest(units - entries, 0) AS neg FROM x)
        SELECT config, problem_type, max(entries) AS entries, round(avg(tp / nullif(tp + fn, 0)), 9) AS recall, round(avg(tp / nullif(tp + fp, 0)), 9) AS precision,
          round(avg(fp / nullif(neg, 0)), 9) AS false_positive_rate, round(avg(tp), 6) AS mean_tp FROM y GROUP BY ALL""",
)
def per_problem_type(t: Tables) -> DataFrame:
    rows = _type_rows(t)
    universe = rows.select("app", "problem_type").distinct().withColumn("units", F.lit(5000).cast("bigint"))
    table = scoring.per_problem_type(rows, universe)
    return table.select("config", "problem_type", "entries", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "false_positive_rate")], F.round("mean_tp", 6).alias("mean_tp"))


_SQL_BINOMIAL = """(CASE WHEN {a} + {b} = 0 OR {a} = {b} THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({a}, {b}) AS BIGINT) + 1),
    lambda i: exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b}) * ln(2))))) END)"""
_SQL_PAIRS = f"""{_SQL_OUTCOMES}, cmp AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{a}', '{b}', {str(p).lower()})" for i, a, b, p in stats.COMPARISONS)}) v(comparison, fc, sc, prim)),
  pr AS (SELECT comparison, prim, x.app, x.entry_id, x.problem_type, x.detected AS f, y.detected AS s FROM cmp JOIN cd x ON x.config = fc JOIN cd y ON y.config = sc AND y.app = x.app AND y.entry_id = x.entry_id)"""
_SQL_MCNEMAR = """count(*) FILTER (WHERE f AND s) AS "both", count(*) FILTER (WHERE f AND NOT s) AS only_first, count(*) FILTER (WHERE s AND NOT f) AS only_second, count(*) FILTER (WHERE NOT f AND NOT s) AS neither"""


@query(
    "mcnemar",
    f"""WITH {_SQL_PAIRS}, m AS (SELECT comparison, app, {_SQL_MCNEMAR} FROM pr GROUP BY ALL)
        SELECT comparison, app, "both", only_first, only_second, neither, round({_SQL_BINOMIAL.format(a='only_first', b='only_second')}, 9) AS p_value,
          round((only_second - only_first) / ("both" + only_first + only_second + neither), 9) AS risk_difference FROM m""",
)
def mcnemar(t: Tables) -> DataFrame:
    tested = stats.compare_by(scoring.canonical_detection(_outcomes(t)), "app")
    return tested.drop("discordant_odds_ratio").withColumns({c: F.round(c, 9) for c in ("p_value", "risk_difference")})


@query(
    "compare_by_type",
    f"""WITH {_SQL_PAIRS}, m AS (SELECT comparison, problem_type, {_SQL_MCNEMAR} FROM pr GROUP BY ALL)
        SELECT comparison, problem_type, only_first, only_second, round({_SQL_BINOMIAL.format(a='only_first', b='only_second')}, 9) AS p_value FROM m""",
)
def compare_by_type(t: Tables) -> DataFrame:
    tested = stats.compare_by(scoring.canonical_detection(_outcomes(t)), "problem_type")
    return tested.select("comparison", "problem_type", "only_first", "only_second", F.round("p_value", 9).alias("p_value"))


@query(
    "compare_configurations",
    f"""WITH {_SQL_PAIRS}, m AS (SELECT comparison, prim, {_SQL_MCNEMAR} FROM pr GROUP BY ALL), p AS (SELECT *, {_SQL_BINOMIAL.format(a='only_first', b='only_second')} AS p FROM m),
        k AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY prim) - row_number() OVER (PARTITION BY prim ORDER BY p) + 1) * p) AS st FROM p),
        h AS (SELECT *, max(st) OVER (PARTITION BY prim ORDER BY p ROWS UNBOUNDED PRECEDING) AS ph FROM k)
        SELECT comparison, "both", only_first, only_second, round(p, 9) AS p_value, CASE WHEN prim THEN round(ph, 9) END AS p_holm,
          CASE WHEN NOT prim THEN 'secondary: p is not corrected' WHEN ph >= 0.05 THEN 'open: the corrected p is 0.05 or more'
               WHEN only_second > only_first THEN 'supported: the second finds more' ELSE 'reversed: the second finds fewer' END AS verdict FROM h""",
)
def compare_configurations(t: Tables) -> DataFrame:
    table = stats.compare(scoring.canonical_detection(_outcomes(t)))
    return table.select("comparison", "both", "only_first", "only_second", F.round("p_value", 9).alias("p_value"), F.round("p_holm", 9).alias("p_holm"), "verdict")


def _sql_draws(name: str, cells: str, identity: list[str]) -> str:
    """The common tables that end in ``name``: the cells once per draw, with how often their rows are drawn (w)."""
    key = " || ':' || ".join(["'0'", "d", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in identity]])
    return f"""{name}_e AS (SELECT DISTINCT n::BIGINT AS n, greatest(0, floor(n - (12 * sqrt(n) + 30)))::BIGINT AS lo, ceil(n + (12 * sqrt(n) + 30))::BIGINT AS hi FROM {cells} WHERE n > 0),
      {name}_l AS (SELECT n, k, sum(CASE WHEN k = lo THEN 0::DOUBLE ELSE ln(n) - ln(k) END) OVER (PARTITION BY n ORDER BY k) AS l FROM (SELECT n, lo, unnest(range(lo, hi + 1)) AS k FROM {name}_e)),
      {name}_p AS (SELECT n, k, exp(l - max(l) OVER (PARTITION BY n)) AS p FROM {name}_l),
      {name}_t AS (SELECT n, min(k) AS lo, list(c ORDER BY k) AS cdf FROM (SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k) / sum(p) OVER (PARTITION BY n) AS c FROM {name}_p) GROUP BY n),
      {name}_u AS (SELECT x.*, d AS draw, CAST('0x' || substr(md5({key}), 1, 12) AS BIGINT) / 281474976710656 AS u FROM {cells} x, range(1, {stats.RESAMPLES + 1}) r(d)),
      {name} AS (SELECT x.*, CASE WHEN t.n IS NULL THEN 0 ELSE t.lo + len(list_filter(cdf, lambda c: c <= u)) END AS w FROM {name}_u x LEFT JOIN {name}_t t ON t.n = x.n)"""


def _sql_interval(draws: str, keys: str, value: str) -> str:
    at = lambda p: f"CASE WHEN 2 * count({value}) >= {stats.RESAMPLES} THEN round(quantile_disc({value}, {p}), 9) END"
    return f"SELECT {keys}, {at(0.025)} AS low, {at(0.975)} AS high FROM {draws} GROUP BY {keys}"


def _rounded(intervals: DataFrame) -> DataFrame:
    return intervals.withColumns({c: F.round(c, 9) for c in ("low", "high")})


_SQL_SHARE = "sum(w * tp) / nullif(sum(w * tp) + sum(w * fp), 0) AS v"


@query(
    "delta_bootstrap",
    f"""WITH {_SQL_OUTCOMES}, pc AS (SELECT f, s, count(*) AS n FROM (SELECT max(detected::INT) FILTER (WHERE config = 'B1') AS f, max(detected::INT) FILTER (WHERE config = 'C3') AS s FROM cd GROUP BY app, entry_id)
          WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY ALL), {_sql_draws('dp', 'pc', ['f', 's'])},
        r AS (SELECT draw, sum(w * f) / nullif(sum(w), 0) AS r1, sum(w * s) / nullif(sum(w), 0) AS r2 FROM dp GROUP BY draw),
        ap AS (SELECT CASE config WHEN 'B1' THEN 1 ELSE 2 END AS side, app, round_even(avg(tp), 0) AS tp, round_even(avg(fp), 0) AS fp FROM rn WHERE config IN ('B1', 'C3') GROUP BY config, app),
        fc AS (SELECT side, 'tp' AS kind, sum(tp)::BIGINT AS n FROM ap GROUP BY side UNION ALL SELECT side, 'fp', sum(fp)::BIGINT FROM ap GROUP BY side), {_sql_draws('df', 'fc', ['side', 'kind'])},
        pr AS (SELECT draw, sum(w) FILTER (WHERE side = 1 AND kind = 'tp') / nullif(sum(w) FILTER (WHERE side = 1), 0) AS p1, sum(w) FILTER (WHERE side = 2 AND kind = 'tp') / nullif(sum(w) FILTER (WHERE side = 2), 0) AS p2 FROM df GROUP BY draw),
        b AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1, CASE WHEN p2 + r2 = 0 THEN 0 ELSE 2 * p2 * r2 / (p2 + r2) END AS f2 FROM r LEFT JOIN pr USING (draw)),
        m AS (SELECT 'precision' AS metric, p2 - p1 AS v FROM b UNION ALL SELECT 'recall', r2 - r1 FROM b UNION ALL SELECT 'f1', f2 - f1 FROM b),
        i AS ({_sql_interval('m', 'metric', 'v')}) SELECT *, low IS NOT NULL AND (low > 0 OR high < 0) AS excludes_zero FROM i""",
)
def delta_bootstrap(t: Tables) -> DataFrame:
    return _rounded(stats.delta_bootstrap(scoring.canonical_detection(_outcomes(t)), _runs(t), "B1", "C3"))


@query(
    "problem_bootstrap",
    f"""WITH {_SQL_OUTCOMES}, pc AS (SELECT config, detected::INT AS tp, 1 - detected::INT AS fp, count(*) AS n FROM cd GROUP BY ALL), {_sql_draws('dp', 'pc', ['config', 'tp', 'fp'])},
        v AS (SELECT config, draw, {_SQL_SHARE} FROM dp GROUP BY ALL) {_sql_interval('v', 'config', 'v')}""",
)
def problem_bootstrap(t: Tables) -> DataFrame:
    return _rounded(stats.problem_bootstrap(scoring.canonical_detection(_outcomes(t))))


@query(
    "paired_timing",
    f"""WITH {_SQL_OUTCOMES}, p AS (SELECT x.app, x.repetition, x.cpu_s AS a, y.cpu_s AS b FROM rn x JOIN rn y ON x.app = y.app AND x.repetition = y.repetition WHERE x.config = 'B1' AND y.config = 'C1')
        SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS n_nonzero, round(median(b - a), 6) AS median_difference, round(avg(a), 6) AS first_mean, round(avg(b), 6) AS second_mean FROM p""",
)
def paired_timing(t: Tables) -> DataFrame:
    row = stats.timing_comparison(stats.paired_runs(_runs(t), "B1", "C1", "cpu_s"))
    return row.select("n", "n_nonzero", *[F.round(c, 6).alias(c) for c in ("median_difference", "first_mean", "second_mean")])


@query(
    "paired_latency",
    f"""WITH {_SQL_OUTCOMES}, sh AS (SELECT x.app, x.entry_id FROM cd x JOIN cd y ON x.app = y.app AND x.entry_id = y.entry_id WHERE x.config = 'B1' AND y.config = 'C3' AND x.detected AND y.detected),
        m AS (SELECT config, app, repetition, avg(latency_s) AS l FROM oo JOIN sh USING (app, entry_id) WHERE config IN ('B1', 'C3') GROUP BY ALL)
        SELECT x.app, x.repetition, round(x.l, 9) AS first, round(y.l, 9) AS second FROM m x JOIN m y ON x.app = y.app AND x.repetition = y.repetition WHERE x.config = 'B1' AND y.config = 'C3'""",
)
def paired_latency(t: Tables) -> DataFrame:
    outcomes = _outcomes(t)
    pairs = stats.paired_latency(outcomes, scoring.canonical_detection(outcomes), "B1", "C3")
    return pairs.select("app", "repetition", F.round("first", 9).alias("first"), F.round("second", 9).alias("second"))


def _sql_signed_rank(source: str, key: str) -> str:
    """W and the normal p-value of differences d per key."""
    return f"""z AS (SELECT {key}, d, abs(d) AS v FROM {source} WHERE d <> 0),
      rk AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY v) + (count(*) OVER (PARTITION BY {key}, v) - 1) / 2 AS r FROM z),
      tie AS (SELECT {key}, sum(t * t * t - t) AS ties FROM (SELECT {key}, v, count(*)::DOUBLE AS t FROM z GROUP BY ALL) GROUP BY {key}),
      wx AS (SELECT {key}, count(*) AS nz, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w FROM rk GROUP BY {key})"""


@query(
    "paired_confidence",
    f"""WITH {_SQL_OUTCOMES}, p AS (SELECT problem_type, b - a AS d FROM (SELECT app, entry_id, any_value(problem_type) AS problem_type, avg(confidence) FILTER (WHERE config = 'B1') AS a, avg(confidence) FILTER (WHERE config = 'C3') AS b FROM oo GROUP BY app, entry_id)
          WHERE a IS NOT NULL AND b IS NOT NULL), {_sql_signed_rank('p', 'problem_type')}
        SELECT problem_type, n, nz AS n_nonzero, CAST(w AS DOUBLE) AS statistic, md AS median_difference FROM wx JOIN (SELECT problem_type, count(*) AS n, median(d) AS md FROM p GROUP BY ALL) USING (problem_type)""",
)
def paired_confidence(t: Tables) -> DataFrame:
    outcomes = _outcomes(t)
    kinds = outcomes.select("app", "entry_id", "problem_type").distinct()
    pairs = stats.paired_confidence(outcomes, "B1", "C3").join(kinds, ["app", "entry_id"])
    return stats.wilcoxon(pairs, ["problem_type"], "first", "second").drop("p_value")


# ---- tests and intervals on the tables themselves ---------------------------------------------------------


@query(
    "wilcoxon",
    f"""WITH p AS (SELECT l_returnflag, l_tax - l_discount AS d FROM (SELECT l_returnflag, CAST(round(l_tax * 100) AS INTEGER) AS l_tax, CAST(round(l_discount * 100) AS INTEGER) AS l_discount FROM lineitem)),
        {_sql_signed_rank('p', 'l_returnflag')} SELECT l_returnflag, n, nz AS n_nonzero, CAST(w AS DOUBLE) AS statistic, CAST(md AS DOUBLE) AS median_difference,
          round((w - nz * (nz + 1) / 4) / sqrt((nz * (nz + 1.0) * (2 * nz + 1) - ties / 2) / 24), 6) AS z FROM wx JOIN tie USING (l_returnflag)
        JOIN (SELECT l_returnflag, count(*) AS n, median(d) AS md FROM p GROUP BY ALL) USING (l_returnflag)""",
)
def wilcoxon(t: Tables) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    pairs = t.lineitem.select("l_returnflag", cents("l_discount").alias("a"), cents("l_tax").alias("b"))
    tested = stats.wilcoxon(pairs, ["l_returnflag"], "a", "b")
    sizes = pairs.where("a <> b").groupBy("l_returnflag", F.abs(F.col("b") - F.col("a")).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = sizes.groupBy("l_returnflag").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n_nonzero").cast("double")
    z = (F.col("statistic") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    return tested.join(ties, "l_returnflag").select("l_returnflag", "n", "n_nonzero", "statistic", "median_difference", F.round(z, 6).alias("z"))


@query(
    "wilcoxon_pairs",
    f"""WITH o AS (SELECT c_nationkey, CAST(o_totalprice AS BIGINT) % 1000 AS v, o_orderkey % 2 AS side, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey),
        p AS (SELECT c_nationkey, b - a AS d FROM (SELECT c_nationkey, o_custkey, max(v) FILTER (WHERE side = 0) AS a, max(v) FILTER (WHERE side = 1) AS b FROM o GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL),
        {_sql_signed_rank('p', 'c_nationkey')} SELECT c_nationkey, nz AS n_nonzero, CAST(w AS DOUBLE) AS statistic FROM wx""",
)
def wilcoxon_pairs(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    value = F.round("o_totalprice").cast("bigint") % 1000
    side = lambda n: F.max(F.when(F.col("o_orderkey") % 2 == n, value))
    pairs = joined.groupBy("c_nationkey", "o_custkey").agg(side(0).alias("a"), side(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return stats.wilcoxon(pairs, ["c_nationkey"], "a", "b").select("c_nationkey", "n_nonzero", "statistic")


@query(
    "cliffs_delta",
    """WITH r AS (SELECT *, rank() OVER (PARTITION BY l_shipmode ORDER BY v) + (count(*) OVER (PARTITION BY l_shipmode, v) - 1) / 2 AS r FROM
          (SELECT l_linestatus AS l_shipmode, l_returnflag AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'N'))),
        s AS (SELECT l_shipmode, count(*) FILTER (WHERE g = 'A') AS n, count(*) FILTER (WHERE g = 'N') AS m, sum(r) FILTER (WHERE g = 'N') AS w FROM r GROUP BY ALL)
       SELECT l_shipmode AS l_linestatus, round((2 * w - m * (m + 1) - n::DOUBLE * m) / (n::DOUBLE * m), 9) AS cliffs_delta FROM s""",
)
def cliffs_delta(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_returnflag").isin("A", "N"))
    result = stats.cliffs_delta(rows, ["l_linestatus"], "l_returnflag", "l_extendedprice", "A", "N")
    return result.withColumn("cliffs_delta", F.round("cliffs_delta", 9))


@query(
    "mean_ci",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, count(DISTINCT value) AS n_distinct FROM events GROUP BY event_type""",
)
def mean_ci(t: Tables) -> DataFrame:
    """The interval's half width is checked in the tests; here its centre is."""
    rows = stats.mean_ci(t.events, ["event_type"], "value")
    return rows.select("event_type", "n", F.round((F.col("low") + F.col("high")) / 2, 6).alias("mean"), "n_distinct")


@query(
    "holm",
    """WITH b AS (SELECT l_suppkey, avg(l_discount) AS p FROM lineitem GROUP BY l_suppkey), k AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, l_suppkey) + 1) * p) AS s FROM b)
       SELECT l_suppkey, round(max(s) OVER (ORDER BY p, l_suppkey ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM k""",
)
def holm(t: Tables) -> DataFrame:
    tests = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("p"))
    return stats.holm(tests.withColumn("family", F.lit("all")), "p", ["family"]).select("l_suppkey", F.round("p_holm", 9).alias("p_holm"))


@query(
    "wilson",
    """WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS s FROM lineitem GROUP BY l_partkey), z AS (SELECT *, s / n AS p, 1.959963984540054 AS z FROM c),
       w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS h FROM z)
       SELECT l_partkey, round(greatest(m - h, 0), 9) AS low, round(least(m + h, 1), 9) AS high FROM w""",
)
def wilson(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("s"))
    low, high = exprs.wilson("s", "n")
    return counted.select("l_partkey", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(
    "kappa",
    """WITH c AS (SELECT lang, quality AS f, toxic AS s FROM labels JOIN documents USING (doc_id)), o AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE f = s) / count(*) AS po,
         (count(*) FILTER (WHERE f = 1) * count(*) FILTER (WHERE s = 1) + count(*) FILTER (WHERE f = 0) * count(*) FILTER (WHERE s = 0)) / (count(*) * count(*)) AS pe FROM c GROUP BY lang)
       SELECT lang, n, round(po, 9) AS percent_agreement, CASE WHEN pe <> 1 THEN round((po - pe) / (1 - pe), 9) END AS kappa FROM o""",
)
def kappa(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return stats.kappa(rows, "quality", "toxic", ["lang"]).withColumns({c: F.round(c, 9) for c in ("percent_agreement", "kappa")})


@query(
    "kappa_ci",
    f"""WITH c AS (SELECT lang, quality AS first, toxic AS second, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), {_sql_draws('d', 'c', ['lang', 'first', 'second'])},
        o AS (SELECT lang, draw, sum(w) FILTER (WHERE first = second) / nullif(sum(w), 0) AS po, (sum(w) FILTER (WHERE first = 1) * coalesce(sum(w) FILTER (WHERE second = 1), 0)
          + coalesce(sum(w) FILTER (WHERE first = 0), 0) * sum(w) FILTER (WHERE second = 0)) / nullif(sum(w) * sum(w), 0) AS pe FROM d GROUP BY ALL),
        v AS (SELECT lang, draw, CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END AS v FROM o) {_sql_interval('v', 'lang', 'v')}""",
)
def kappa_ci(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return _rounded(stats.kappa_ci(rows, "quality", "toxic", ["lang"]))


# ---- labelled findings ---------------------------------------------------------------------------------------


def _worksheet(t: Tables) -> DataFrame:
    """Documents as labelled findings: source = repository, language = rule."""
    label = lambda salt: (
        F.when(pick("doc_id", salt) < 20, "").when(pick("doc_id", salt) < 140, "TP").when(pick("doc_id", salt) < 230, "FP").otherwise("UNSURE")
    )
    cause = F.get(F.array(*[F.lit(c) for c in stats.FP_CAUSES]), pick("doc_id", ":cause") % 7)
    doubled = pick("doc_id", ":double") < 52
    second = F.when(doubled, label(":second")).otherwise("")
    return t.documents.select(
        F.col("doc_id").alias("finding_id"), F.col("source").alias("repo"), F.col("lang").alias("rule_id"),
        F.get(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), pick("doc_id", ":conf") % 3).alias("confidence"),
        label(":first").alias("label"), F.when(label(":first") == "FP", F.coalesce(cause, F.lit(""))).otherwise("").alias("fp_cause"),
        F.when(pick("doc_id", ":why") < 200, "because").otherwise("").alias("rationale"), F.when(doubled, "yes").otherwise("no").alias("double_label"),
        second.alias("label_2"), F.lit("").alias("fp_cause_2"), F.lit("").alias("rationale_2"),
    )


def _sql_label(salt: str) -> str:
    p = sql_pick("doc_id", salt)
    return f"CASE WHEN {p} < 20 THEN '' WHEN {p} < 140 THEN 'TP' WHEN {p} < 230 THEN 'FP' ELSE 'UNSURE' END"


_CAUSES = list(stats.FP_CAUSES)
_SQL_SHEET = f"""ws AS (SELECT doc_id AS finding_id, source AS repo, lang AS rule_id, ['HIGH', 'MEDIUM', 'LOW'][{sql_pick('doc_id', ':conf')} % 3 + 1] AS confidence, {_sql_label(':first')} AS label,
    CASE WHEN ({_sql_label(':first')}) = 'FP' THEN coalesce({_CAUSES}[{sql_pick('doc_id', ':cause')} % 7 + 1], '') ELSE '' END AS fp_cause, {sql_pick('doc_id', ':why')} < 200 AS why,
    {sql_pick('doc_id', ':double')} < 52 AS doubled, CASE WHEN {sql_pick('doc_id', ':double')} < 52 THEN {_sql_label(':second')} ELSE '' END AS label_2 FROM documents)"""
_SQL_TALLY = "count(*) FILTER (WHERE label = 'TP') AS tp, count(*) FILTER (WHERE label = 'FP') AS fp, count(*) FILTER (WHERE label = 'UNSURE') AS unsure"


@query(
    "precision_block",
    f"""WITH {_SQL_SHEET}, c AS (SELECT rule_id, count(*) AS findings, count(*) FILTER (WHERE label <> '') AS labelled, {_SQL_TALLY}, count(DISTINCT repo) FILTER (WHERE label <> '') AS repos FROM ws GROUP BY rule_id),
        z AS (SELECT *, tp / nullif(tp + fp, 0) AS p, nullif(tp + fp, 0) AS n, 1.959963984540054 AS z FROM c), w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS h FROM z)
        SELECT rule_id, findings, labelled, tp, fp, unsure, repos, round(p, 9) AS precision, round(greatest(m - h, 0), 9) AS wilson_low, round(least(m + h, 1), 9) AS wilson_high,
          round(tp / (tp + fp + unsure), 9) AS precision_if_unsure_fp, round((tp + unsure) / (tp + fp + unsure), 9) AS precision_if_unsure_tp FROM w""",
)
def precision_block(t: Tables) -> DataFrame:
    block = stats.precision_block(_worksheet(t), ["rule_id"])
    return block.withColumns({c: F.round(c, 9) for c in ("precision", "wilson_low", "wilson_high", "precision_if_unsure_fp", "precision_if_unsure_tp")})


@query("macro_precision", f"WITH {_SQL_SHEET} SELECT round(avg(p), 9) AS macro_average_precision FROM (SELECT rule_id, count(*) FILTER (WHERE label = 'TP') / nullif(count(*) FILTER (WHERE label IN ('TP', 'FP')), 0) AS p FROM ws GROUP BY rule_id)")
def macro_precision(t: Tables) -> DataFrame:
    row = stats.macro_precision(stats.precision_block(_worksheet(t), ["rule_id"]))
    return row.select(F.round("macro_average_precision", 9).alias("macro_average_precision"))


@query("precision_by_confidence", f"WITH {_SQL_SHEET}, c AS (SELECT rule_id, confidence, {_SQL_TALLY} FROM ws GROUP BY ALL) SELECT *, round(tp / (tp + fp), 9) AS precision FROM c WHERE tp + fp > 0")
def precision_by_confidence(t: Tables) -> DataFrame:
    rows = stats.precision_by_confidence(_worksheet(t)).drop("wilson_low", "wilson_high")
    return rows.withColumn("precision", F.round("precision", 9))


@query(
    "cluster_bootstrap",
    f"""WITH {_SQL_SHEET}, pr AS (SELECT rule_id, repo, count(*) FILTER (WHERE label = 'TP') AS tp, count(*) FILTER (WHERE label = 'FP') AS fp FROM ws GROUP BY ALL),
        c AS (SELECT rule_id, tp, fp, count(*) AS n FROM pr WHERE rule_id IN (SELECT rule_id FROM pr GROUP BY rule_id HAVING count(*) >= 2) GROUP BY rule_id, tp, fp), {_sql_draws('d', 'c', ['rule_id', 'tp', 'fp'])},
        v AS (SELECT rule_id, draw, {_SQL_SHARE} FROM d GROUP BY ALL) {_sql_interval('v', 'rule_id', 'v')}""",
)
def cluster_bootstrap(t: Tables) -> DataFrame:
    return _rounded(stats.cluster_bootstrap(_worksheet(t), ["rule_id"]))


@query("cause_breakdown", f"WITH {_SQL_SHEET} SELECT rule_id, {', '.join(f'''count(*) FILTER (WHERE fp_cause = '{c}') AS {c}''' for c in _CAUSES)} FROM ws WHERE label = 'FP' GROUP BY rule_id")
def cause_breakdown(t: Tables) -> DataFrame:
    return stats.cause_breakdown(_worksheet(t))


@query(
    "cause_shares",
    f"WITH {_SQL_SHEET}, f AS (SELECT * FROM ws WHERE label = 'FP') SELECT cause, (SELECT count(*) FROM f WHERE fp_cause = cause) AS count, round((SELECT count(*) FROM f WHERE fp_cause = cause) / (SELECT count(*) FROM f), 9) AS share FROM (SELECT unnest({_CAUSES}) AS cause)",
)
def cause_shares(t: Tables) -> DataFrame:
    return stats.cause_shares(_worksheet(t)).withColumn("share", F.round("share", 9))


@query(
    "share_of_subset",
    f"""WITH {_SQL_SHEET} SELECT rule_id, count(*) FILTER (WHERE label IN ('TP', 'FP')) AS denominator, count(*) FILTER (WHERE label = 'FP' AND fp_cause = 'index_outside_schema') AS numerator,
          round(count(*) FILTER (WHERE label = 'FP' AND fp_cause = 'index_outside_schema') / nullif(count(*) FILTER (WHERE label IN ('TP', 'FP')), 0), 9) AS share FROM ws GROUP BY rule_id""",
)
def share_of_subset(t: Tables) -> DataFrame:
    rows = stats.share_of(_worksheet(t), F.col("label").isin("TP", "FP"), F.col("fp_cause") == "index_outside_schema", ["rule_id"])
    return rows.select("rule_id", "denominator", "numerator", F.round("share", 9).alias("share"))


@query(
    "fisher",
    f"""WITH {_SQL_SHEET}, l AS (SELECT rule_id, count(*) FILTER (WHERE label = 'TP') AS a, count(*) FILTER (WHERE label = 'FP') AS b FROM ws WHERE confidence <> 'LOW' GROUP BY ALL),
        r AS (SELECT rule_id, count(*) FILTER (WHERE label = 'TP') AS c, count(*) FILTER (WHERE label = 'FP') AS d FROM ws WHERE confidence = 'LOW' GROUP BY ALL)
        SELECT rule_id, a, b, c, d, round(a / (a + b) - c / (c + d), 9) AS difference,
          round((SELECT sum(p) FILTER (WHERE p <= po * (1 + 1e-7)) FROM (SELECT i, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
              - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)) AS p,
            exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) AS po
            FROM (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i))), 8) AS fisher_p FROM l JOIN r USING (rule_id)""",
)
def fisher(t: Tables) -> DataFrame:
    sheet = _worksheet(t)
    counted = lambda rows: rows.groupBy("rule_id").agg(F.count_if(F.col("label") == "TP").alias("tp"), F.count_if(F.col("label") == "FP").alias("fp"))
    table = stats.two_proportions(counted(sheet.where(F.col("confidence") != "LOW")), counted(sheet.where(F.col("confidence") == "LOW")))
    return table.select("rule_id", "a", "b", "c", "d", F.round("difference", 9).alias("difference"), F.round("fisher_p", 8).alias("fisher_p"))


@query(
    "label_agreement",
    f"""WITH {_SQL_SHEET}, p AS (SELECT label AS f, label_2 AS s FROM ws WHERE doubled AND label <> '' AND label_2 <> ''), x AS (SELECT 'three_way' AS kind, * FROM p UNION ALL SELECT 'binary', * FROM p WHERE f <> 'UNSURE' AND s <> 'UNSURE'),
        e AS (SELECT kind, sum(a * b) AS e FROM (SELECT kind, l, count(*) FILTER (WHERE f = l) AS a, count(*) FILTER (WHERE s = l) AS b FROM x, (VALUES ('TP'), ('FP'), ('UNSURE')) v(l) GROUP BY ALL) GROUP BY kind),
        n AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE f = s) / count(*) AS po FROM x GROUP BY kind)
        SELECT kind, n, round(po, 9) AS percent_agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM n JOIN e USING (kind)""",
)
def label_agreement(t: Tables) -> DataFrame:
    """Agreement of the two labels, with UNSURE as a label of its own and without it."""
    rows = _worksheet(t).where("double_label = 'yes' AND label <> '' AND label_2 <> ''")
    sure = (F.col("label") != "UNSURE") & (F.col("label_2") != "UNSURE")
    kinds = F.explode(F.array_compact(F.array(F.lit("three_way"), F.when(sure, "binary"))))
    return stats.kappa(rows.withColumn("kind", kinds), "label", "label_2", ["kind"]).withColumns({c: F.round(c, 9) for c in ("percent_agreement", "kappa")})


@query("label_disagreements", f"WITH {_SQL_SHEET} SELECT finding_id, rule_id, label AS first, label_2 AS second FROM ws WHERE doubled AND label <> '' AND label_2 <> '' AND label <> label_2")
def label_disagreements(t: Tables) -> DataFrame:
    return stats.disagreements(_worksheet(t))


@query(
    "worksheet_violations",
    f"""WITH {_SQL_SHEET} SELECT finding_id, 'label is empty' AS problem FROM ws WHERE label = '' UNION ALL SELECT finding_id, 'fp_cause is empty or unknown' FROM ws WHERE label = 'FP' AND fp_cause = ''
        UNION ALL SELECT finding_id, 'rationale is empty' FROM ws WHERE label = 'UNSURE' AND NOT why UNION ALL SELECT finding_id, 'label_2 is empty' FROM ws WHERE doubled AND label_2 = ''
        UNION ALL SELECT finding_id, 'fp_cause_2 is empty or unknown' FROM ws WHERE label_2 = 'FP' UNION ALL SELECT finding_id, 'rationale_2 is empty' FROM ws WHERE label_2 = 'UNSURE'""",
)
def worksheet_violations(t: Tables) -> DataFrame:
    return stats.worksheet_violations(_worksheet(t))
