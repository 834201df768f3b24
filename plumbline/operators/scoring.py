"""Scores findings against a ground truth.

A finding can answer an entry of its problem type by code (same file, overlapping lines), by data
(same table and column) or by endpoint. Pairs are one-to-one and as many as possible.

What a finding can answer follows from its spot: problem type, lines and the data of its evidence. The search for
answers goes over distinct spots. Findings that can answer exactly the same entries are interchangeable, so they are counted
as one class with a capacity. The matching then works on classes and places, in counts and ranges: a place that one class alone
answers takes the smaller number, and only places linked by shared classes are searched, a connected component at a time.
"""

from __future__ import annotations


from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import f1, normal_identifier, normal_path, ratio, route_pattern
from ..functions.graphs import components
from ..functions.intervals import overlaps
from ..functions.ranking import positions
from ..session import cut, spread

#: Problem type -> category, in report order.
PROBLEM_CATEGORY = {
    "n_plus_one": "performance",
    "missing_index": "performance",
    "excessive_relation_loading": "performance",
    "repeated_identical_query": "performance",
    "unpaginated_find_many": "performance",
    "null_spike": "data_quality",
    "duplicate_spike": "data_quality",
    "distribution_shift": "data_quality",
    "orphaned_foreign_key": "data_quality",
    "index_not_declared": "schema_divergence",
    "declared_index_not_applied": "schema_divergence",
}

#: Rule -> problem type. Rules not listed are unmapped.
RULE_PROBLEM_TYPES = {
    "N_PLUS_ONE_IN_LOOP": "n_plus_one",
    "RUNTIME_N_PLUS_ONE": "n_plus_one",
    "MISSING_INDEX_ON_FILTERED_FIELD": "missing_index",
    "EXCESSIVE_RELATION_LOADING": "excessive_relation_loading",
    "REPEATED_IDENTICAL_QUERY": "repeated_identical_query",
    "MISSING_PAGINATION": "unpaginated_find_many",
    "SQL_UNBOUNDED_SELECT": "unpaginated_find_many",
    "NULL_SPIKE": "null_spike",
    "DUPLICATE_SPIKE": "duplicate_spike",
    "DISTRIBUTION_SHIFT": "distribution_shift",
    "ORPHANED_FOREIGN_KEY": "orphaned_foreign_key",
    "INDEX_NOT_DECLARED": "index_not_declared",
    "DECLARED_INDEX_NOT_APPLIED": "declared_index_not_applied",
}

#: Rank of a confidence.
CONFIDENCE_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}

#: The layers each configuration uses; A-log is a sensitivity arm.
CONFIGURATIONS = {
    "A": ("sql",),
    "B1": ("static_orm", "sql"),
    "B2": ("static_orm", "sql", "declared"),
    "C1": ("static_orm", "sql", "declared", "actual"),
    "C2": ("static_orm", "sql", "declared", "actual", "runtime"),
    "C3": ("static_orm", "sql", "declared", "actual", "runtime", "data"),
    "A-log": ("sql",),
}

#: Parts a class of findings is split into before its first few are chosen.
SALTS = 64


def _literal(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def problem_type_of(rule: Column | str) -> Column:
    return _literal(RULE_PROBLEM_TYPES, F.col(rule) if isinstance(rule, str) else rule)


def category_of(problem_type: Column | str) -> Column:
    return _literal(PROBLEM_CATEGORY, F.col(problem_type) if isinstance(problem_type, str) else problem_type)


def validate_manifest(entries: DataFrame) -> DataFrame:
    """(app, id, problem) for every rule an entry breaks."""
    c = F.col
    performance = c("category") == "performance"
    rules = {
        "wrong category for this problem": ~c("category").eqNullSafe(category_of("problem_type")),
        "unknown rule": problem_type_of("expected_rule_id").isNull(),
        "rule of another problem": problem_type_of("expected_rule_id") != c("problem_type"),
        "slow code without file": performance & c("file").isNull(),
        "slow code without line": performance & c("line").isNull(),
        "slow code without endpoint": performance & c("endpoint").isNull(),
        "data problem without table": ~performance & c("table").isNull(),
        "file or line alone": c("file").isNull() != c("line").isNull(),
        "line below 1": c("line") < 1,
        "ends before it begins": c("end_line").isNotNull() & (c("line").isNull() | (c("end_line") < c("line"))),
        "anchor without place": c("anchor").isNotNull() & c("line").isNull(),
        "column without table": c("column").isNotNull() & c("table").isNull(),
        "empty id or description": (F.length("id") == 0) | (F.length("description") == 0) | c("description").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(name)) for name, r in rules.items()]))
    repeated = entries.groupBy("app", "id").agg(F.count(F.lit(1)).alias("n")).where(c("n") > 1)
    return entries.select("app", "id", F.explode(broken).alias("problem")).unionByName(
        repeated.select("app", "id", F.lit("id given twice").alias("problem"))
    )


# ---- who can answer whom ---------------------------------------------------------------------------


_PLACE = ("app", "problem_type", "_file", "_line", "_end", "_table", "_column", "_route")


def _marked(*columns: str) -> Column:
    """A digest of some columns in which a NULL differs from every value."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 32)


def _located(entries: DataFrame) -> DataFrame:
    """Each entry with its place and what makes it up."""
    located = entries.select(
        "app", "problem_type", "id",
        F.when(F.col("line").isNotNull(), normal_path("file")).alias("_file"), F.col("line").alias("_line"),
        F.coalesce("end_line", "line").alias("_end"), normal_identifier("table").alias("_table"),
        normal_identifier("column").alias("_column"), route_pattern("endpoint").alias("_route"),
    )
    return located.withColumn("place", _marked(*_PLACE))


def _places(located: DataFrame) -> DataFrame:
    """Distinct places of the ground truth, each with its number of entries."""
    return located.groupBy(*_PLACE, "place").agg(F.count(F.lit(1)).alias("entries"))


_SPOT = ("app", "problem_type", "_path", "line", "_last", "_data")


def _contents(findings: DataFrame) -> DataFrame:
    """Distinct findings with the number of copies ``n`` and the ``spot`` they point at (NULL without a problem type).

    Rows are dealt by their digest before they are grouped: findings hardly ever repeat among the rows that one task reads.
    """
    kept = ["app", "rule_id", "confidence", "file", "line", "end_line", "fingerprint"]
    base = findings.select(*kept, F.transform("evidence", lambda e: e["data"]).alias("_data"), F.to_json("evidence").alias("_e"))
    base = base.withColumn("finding", _marked(*kept, "_e")).drop("_e")
    grouped = spread(base, "finding").groupBy("finding", *kept, "_data").agg(F.count(F.lit(1)).alias("n"))
    placed = grouped.withColumns(
        {"problem_type": problem_type_of("rule_id"), "_path": normal_path("file"), "_last": F.coalesce("end_line", "line")}
    )
    return placed.withColumn("spot", F.when(F.col("problem_type").isNotNull(), _marked(*_SPOT)))


def _spots(contents: DataFrame) -> DataFrame:
    """Distinct spots of the findings that have a problem type, each with its number of findings, copies included."""
    return contents.where(F.col("spot").isNotNull()).groupBy("spot", *_SPOT).agg(F.sum("n").alias("n"))


def candidate_edges(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """(app, problem_type, finding, place): every distinct finding with the places it can answer."""
    contents = cut(_contents(findings))  # feed the spots and the result
    targets = cut(_targets(_places(_located(entries))))
    aims = _aims(targets, cut(_spots(contents)))
    edges = aims.join(targets.select("target", "place"), "target").select("spot", "place").distinct()
    return contents.join(edges, "spot").select("app", "problem_type", "finding", "place")


_KEY = ("app", "problem_type")


def _targets(places: DataFrame) -> DataFrame:
    """A row per place and way to answer it: by code, by data or by endpoint.

    Places of one table and column, or of one route, share that target, so a finding that names it is one row however
    many places there are. Lines are a place's own target.
    """
    code = places.where(F.col("_line").isNotNull()).select(*_KEY, "place", F.col("place").alias("target"), "_file", "_line", "_end")
    data = places.where(F.col("_table").isNotNull()).select(*_KEY, "place", "_table", F.coalesce("_column", F.lit("*any*")).alias("_column"))
    data = data.withColumn("target", _marked(*_KEY, "_table", "_column"))
    endpoint = places.where(F.col("_route").isNotNull()).select(*_KEY, "place", "_route")
    endpoint = endpoint.withColumn("target", _marked(*_KEY, "_route"))
    return code.unionByName(data, allowMissingColumns=True).unionByName(endpoint, allowMissingColumns=True)


def _aims(targets: DataFrame, spots: DataFrame) -> DataFrame:
    """(app, problem_type, spot, target): the targets that the findings of each spot name."""
    out = [*_KEY, "spot", "target"]
    code = overlaps(
        spots.select(*_KEY, "spot", F.col("_path").alias("_file"), "line", F.col("_last").alias("last")),
        targets.where(F.col("_line").isNotNull()).select(*_KEY, "target", "_file", "_line", "_end"),
        [*_KEY, "_file"], ("line", "last"), ("_line", "_end"),
    ).select(*out)

    items = spots.select(*_KEY, "spot", F.explode("_data").alias("d"))
    table = normal_identifier(F.get_json_object("d", "$.table"))
    listed = F.from_json(F.get_json_object("d", "$.columns"), "array<string>")
    columns = F.concat(
        F.array(F.get_json_object("d", "$.column")), F.coalesce(listed, F.array().cast("array<string>")), F.array(F.lit("*any*"))
    )
    located = items.select(*_KEY, "spot", table.alias("_table"), F.explode(F.array_compact(columns)).alias("c"))
    located = located.where(F.col("_table").isNotNull()).select(
        *_KEY, "spot", "_table", F.when(F.col("c") == "*any*", F.col("c")).otherwise(normal_identifier("c")).alias("_column")
    )
    named = targets.where(F.col("_table").isNotNull()).select(*_KEY, "_table", "_column", "target").distinct()
    data = located.join(named, [*_KEY, "_table", "_column"]).select(*out)

    routes = items.select(*_KEY, "spot", route_pattern(F.get_json_object("d", "$.route")).alias("_route"))
    called = targets.where(F.col("_route").isNotNull()).select(*_KEY, "_route", "target").distinct()
    endpoint = routes.where(F.col("_route").isNotNull()).join(called, [*_KEY, "_route"]).select(*out)
    return code.unionByName(data).unionByName(endpoint).distinct()


# ---- matching ------------------------------------------------------------------------------------------


def _assign(group: pd.DataFrame) -> pd.DataFrame:
    """A largest one-to-one assignment in one connected component, entries in id order.

    The group has a row per (class, place it can answer) and a row per entry (its place; class NULL). Entries of one
    place are alike, so the search goes over places and classes: an entry that finds no way closes what it went through.
    A result row says which entries of a place, by position, go to which copies of a class. ``place`` stands for all
    places that the same classes answer.
    """
    edges = group[group["signature"].notna()]
    first = dict(zip(edges["signature"], edges["first"]))
    spare = dict(zip(edges["signature"], edges["capacity"].astype(int)))
    options: dict[str, list[str]] = {}
    for signature, place in zip(edges["signature"], edges["place"]):
        options.setdefault(place, []).append(signature)
    for listed in options.values():
        listed.sort(key=lambda s: (first[s], s))
    held: dict[str, dict[str, int]] = {s: {} for s in spare}
    closed: set[str] = set()
    full: set[str] = set()
    entries = group[group["signature"].isna()].sort_values("entry_id")
    for start in entries["place"]:
        if start in full:
            continue
        reached_by: dict[str, str] = {}
        came: dict[str, str | None] = {start: None}
        frontier, free = deque([start]), None
        while frontier and free is None:
            current = frontier.popleft()
            for signature in options[current]:
                if signature in reached_by or signature in closed:
                    continue
                reached_by[signature] = current
                if spare[signature] > 0:
                    free = signature
                    break
                for place in sorted(held[signature]):
                    if place not in came:
                        came[place] = signature
                        frontier.append(place)
        if free is None:
            closed.update(reached_by)
            full.add(start)
            continue
        spare[free] -= 1
        while free is not None:
            mover = reached_by[free]
            held[free][mover] = held[free].get(mover, 0) + 1
            left = came[mover]
            if left is not None:
                held[left][mover] -= 1
                if not held[left][mover]:
                    del held[left][mover]
            free = left
    rows, used, begun = [], dict.fromkeys(spare, 0), dict.fromkeys(options, 0)
    for place in sorted(options):
        for signature in options[place]:
            count = held[signature].get(place, 0)
            if count:
                rows.append((signature, place, begun[place], begun[place] + count, used[signature]))
                begun[place] += count
                used[signature] += count
    return pd.DataFrame(rows, columns=["signature", "place", "low", "high", "skip"])


_HOLDING = "signature string, place string, low long, high long, skip long"


def maximum_matching(classes: DataFrame, firsts: DataFrame, places: DataFrame, located: DataFrame) -> DataFrame:
    """(signature, place, low, high, skip): a place's entries low + 1 to high, by id, go to the class's copies from skip on.

    ``classes``: signature, capacity, places. ``firsts``: signature, first; read only if there is a search. A place that only its own class answers needs no search. The others
    form components over the classes that answer several places; each component is searched on its own, with a row per
    entry and per (class, place), however many findings there are.
    """
    own = classes.where(F.size("places") == 1).select("signature", "capacity", F.get("places", F.lit(0)).alias("place"))
    several = classes.where(F.size("places") > 1)
    whole = lambda rows: rows.select(
        "signature", "place", F.lit(0).cast("long").alias("low"), F.least("capacity", "entries").cast("long").alias("high"),
        F.lit(0).cast("long").alias("skip"),
    )
    if several.isEmpty():
        return whole(own.join(places.select("place", "entries"), "place"))
    roots = components(
        several.select(F.get("places", F.lit(0)).alias("a"), F.explode(F.slice("places", 2, F.size("places"))).alias("b"))
    ).select(F.col("node").alias("place"), "root")
    alone = own.join(roots, "place", "left_anti").join(places.select("place", "entries"), "place")
    settled = whole(alone)
    edges = several.select("signature", "capacity", F.explode("places").alias("place")).unionByName(own)
    edges = edges.join(roots, "place").join(firsts, "signature")
    members = located.select("place", F.col("id").alias("entry_id")).join(roots, "place")
    group = edges.withColumn("entry_id", F.lit(None).cast("string")).unionByName(members, allowMissingColumns=True)
    return settled.unionByName(group.groupBy("root").applyInPandas(_assign, _HOLDING))


def _first_of_class(found: DataFrame, taken: DataFrame) -> DataFrame:
    """(finding, matched): the first ``wanted`` copies of each class, in canonical order.

    Each class is split by hash; only rows that could be among its first few reach the final ranking.
    """
    order = ["_path", "line", "rule_id", "fingerprint", "finding"]
    rows = found.join(taken, "signature").withColumn("_salt", F.pmod(F.xxhash64("finding"), F.lit(SALTS)))
    for keys in (["signature", "_salt"], ["signature"]):
        ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("_ahead") < F.col("wanted"))
    matched = F.least(F.col("n"), F.col("wanted") - F.col("_ahead"))
    return rows.select("finding", "signature", F.col("_ahead").alias("position"), matched.alias("matched"))


def score(findings: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """``entries`` (id, outcome), ``findings`` (distinct findings with tp, fp, duplicate copies) and
    ``matches`` (entry_id with its finding). Both inputs carry ``app``."""
    located = cut(_located(spread(entries, "app", "id")))  # feeds the targets and the places of the matching
    contents = cut(_contents(findings))  # feed the spots, the choice within each class and the outcome
    targets, spots = cut(_targets(_places(located))), cut(_spots(contents))
    named = _aims(targets, spots).groupBy("spot").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    signed = cut(named.withColumn("signature", F.sha2(F.concat_ws(",", "targets"), 256)))
    found = contents.join(signed.select("spot", "signature"), "spot", "left")
    first = F.min(F.concat_ws("\0", "_path", F.lpad(F.col("line").cast("string"), 12, "0"), "rule_id", "fingerprint"))
    firsts = found.where(F.col("signature").isNotNull()).groupBy("signature").agg(first.alias("first"))
    classes = cut(spots.select("spot", "n").join(signed, "spot").groupBy("signature", "targets").agg(F.sum("n").alias("capacity")))
    # Places that the same classes answer are one place to the matching.
    answered = classes.select("signature", F.explode("targets").alias("target")).join(targets.select("target", "place"), "target")
    alike = answered.groupBy("place").agg(F.array_sort(F.collect_set("signature")).alias("classes"))
    alike = cut(alike.select("place", F.sha2(F.concat_ws(",", "classes"), 256).alias("group"), "classes"))
    located = located.select(*_KEY, "id", "place").join(alike.select("place", "group"), "place", "left")
    located = cut(located.select(*_KEY, "id", F.col("group").alias("place")))
    groups = located.where(F.col("place").isNotNull()).groupBy("place").agg(F.count(F.lit(1)).alias("entries"))
    reach = alike.select("group", F.explode("classes").alias("signature")).distinct().groupBy("signature").agg(F.array_sort(F.collect_list("group")).alias("places"))
    classes = classes.drop("targets").join(reach, "signature")
    holdings = cut(maximum_matching(classes, firsts, groups, located))
    taken = holdings.groupBy("signature").agg(F.sum(F.col("high") - F.col("low")).alias("wanted"))
    chosen = _first_of_class(
        found.where(F.col("signature").isNotNull()).select("finding", "signature", "n", "_path", "line", "rule_id", "fingerprint"), taken
    )
    outcome = found.join(chosen.select("finding", "matched"), "finding", "left").withColumn("tp", F.coalesce("matched", F.lit(0)))
    claimable = F.col("signature").isNotNull()
    rest = F.col("n") - F.col("tp")
    scored = outcome.select(
        "app", "problem_type", "rule_id", "file", "line", "fingerprint", "confidence", "finding", "tp",
        F.when(claimable, 0).otherwise(rest).alias("fp"), F.when(claimable, rest).otherwise(0).alias("duplicates"),
    )
    # The k-th matched copy of a class belongs to the place whose range of copies holds k, and there to one position.
    numbered = positions(located, ["place"], [F.col("id").asc()])
    copies = chosen.withColumn("_copy", F.explode(F.sequence(F.col("position"), F.col("position") + F.col("matched") - 1)))
    held = copies.join(holdings, "signature").where(
        (F.col("_copy") >= F.col("skip")) & (F.col("_copy") < F.col("skip") + F.col("high") - F.col("low"))
    ).select("finding", "place", (F.col("low") + F.col("_copy") - F.col("skip") + 1).alias("position"))
    matches = held.join(numbered.select("place", "position", F.col("id").alias("entry_id")), ["place", "position"]).select("finding", "entry_id")
    matches = matches.join(found.select("finding", "app", "problem_type", "rule_id", "file", "line", "fingerprint", "confidence"), "finding")
    reached = holdings.groupBy("place").agg(F.max("high").alias("_hits"))
    judged = numbered.join(reached, "place", "left").withColumn("_hit", F.coalesce(F.col("position") <= F.col("_hits"), F.lit(False)))
    return {
        "entries": judged.select("app", "problem_type", "id", F.when(F.col("_hit"), "tp").otherwise("fn").alias("outcome")),
        "findings": scored,
        "matches": matches.drop("finding"),
    }


# ---- counts ----------------------------------------------------------------------------------------------


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1, NULL where undefined."""
    rated = counts.withColumns(
        {"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))}
    )
    return rated.withColumn("f1", f1("precision", "recall"))


def counts_rollup(scored: dict[str, DataFrame]) -> DataFrame:
    """(app, level, category, problem_type, tp, fp, fn, duplicates, precision, recall, f1) per problem
    type, per category and in total. Unmapped findings count in the total only."""
    zero = F.lit(0).cast("bigint")
    from_entries = scored["entries"].groupBy("app", "problem_type").agg(
        F.count_if(F.col("outcome") == "tp").alias("tp"), zero.alias("fp"),
        F.count_if(F.col("outcome") == "fn").alias("fn"), zero.alias("duplicates"),
    )
    from_findings = scored["findings"].groupBy("app", "problem_type").agg(
        zero.alias("tp"), F.sum("fp").alias("fp"), zero.alias("fn"), F.sum("duplicates").alias("duplicates")
    )
    parts = from_entries.unionByName(from_findings).withColumn("category", category_of("problem_type"))
    parts = parts.withColumn("problem_type", F.coalesce("problem_type", F.lit("unmapped")))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "duplicates")]
    rolled = parts.groupingSets(
        [["app", "category", "problem_type"], ["app", "category"], ["app"]], "app", "category", "problem_type"
    ).agg(F.grouping("problem_type").alias("_t"), F.grouping("category").alias("_c"), *sums)
    level = F.when(F.col("_c") == 1, "total").when(F.col("_t") == 1, "category").otherwise("problem_type")
    rolled = rolled.withColumn("level", level).where((F.col("level") == "total") | F.col("category").isNotNull())
    rolled = rolled.where((F.col("tp") + F.col("fp") + F.col("fn") + F.col("duplicates") > 0) | (F.col("level") == "total"))
    return with_rates(rolled).select(
        "app", "level", "category", "problem_type", "tp", "fp", "fn", "duplicates", "precision", "recall", "f1"
    )


def result_rows(scored: dict[str, DataFrame], universe: DataFrame, first_detection: DataFrame | None = None) -> DataFrame:
    """One row per problem type with rates, false-positive rate, mean confidence and latency, plus an
    ``unmapped`` row where there are unmapped false positives.

    ``universe``: app, problem_type, units. ``first_detection``: app, entry_id, latency_s.
    """
    # Both are read twice, by the counts and by the sizes or the unmapped row.
    judged = cut(scored["entries"].select("app", "problem_type", "outcome"))
    summed = scored["findings"].groupBy("app", "problem_type").agg(F.sum("fp").alias("fp"), F.sum("duplicates").alias("duplicates"))
    scored = scored | {"entries": judged, "findings": cut(summed)}
    counts = counts_rollup(scored).where(F.col("level") == "problem_type").drop("level", "category")
    sizes = scored["entries"].groupBy("app", "problem_type").agg(F.count(F.lit(1)).alias("entries"))
    found = scored["matches"].withColumn("rank", _literal(CONFIDENCE_RANK, F.col("confidence")))
    if first_detection is not None:
        found = found.join(first_detection, ["app", "entry_id"], "left")
    else:
        found = found.withColumn("latency_s", F.lit(None).cast("double"))
    quality = found.groupBy("app", "problem_type").agg(
        F.avg("rank").alias("mean_tp_confidence"), F.avg("latency_s").alias("detection_latency_s")
    )
    key = ["app", "problem_type"]
    joined = counts.join(sizes, key, "left").join(universe, key, "left").join(quality, key, "left").fillna(0, ["entries", "units"])
    negatives = F.greatest(F.col("units") - F.col("entries"), F.lit(0))
    rows = joined.withColumn("fpr", F.least(ratio("fp", negatives), F.when(negatives > 0, F.lit(1.0)))).drop("units")
    unmapped = scored["findings"].where(F.col("problem_type").isNull()).groupBy("app").agg(F.sum("fp").alias("fp")).where(F.col("fp") > 0)
    empty = {c: F.lit(None).cast("double") for c in ("precision", "recall", "f1", "mean_tp_confidence", "detection_latency_s", "fpr")}
    zeros = {c: F.lit(0).cast("bigint") for c in ("tp", "fn", "duplicates", "entries")}
    extra = unmapped.withColumns({"problem_type": F.lit("unmapped"), **zeros, **empty})
    return rows.unionByName(extra)


# ---- configurations and repetitions ---------------------------------------------------------------------


def configurations(spark) -> DataFrame:
    rows = [(c, layer, c == "A-log", "captured" if c == "A-log" else "repository") for c, ls in CONFIGURATIONS.items() for layer in ls]
    return spark.createDataFrame(rows, "config string, layer string, sensitivity boolean, sql_source string")


def findings_by_configuration(findings: DataFrame) -> DataFrame:
    """Findings (with ``layer``) once per configuration that uses their layer.

    Findings of the SQL layer carry ``sql_source``: captured statements reach the sensitivity arm only.
    """
    configs = F.broadcast(configurations(findings.sparkSession).withColumnRenamed("sql_source", "_source"))
    joined = findings.join(configs, "layer")
    return joined.where((F.col("layer") != "sql") | (F.col("sql_source") == F.col("_source"))).drop("_source")


def detection_latency(detections: DataFrame) -> DataFrame:
    """(app, entry_id, latency_s): the earliest layer that found an entry, else the run's wall time."""
    return detections.groupBy("app", "entry_id").agg(
        F.coalesce(F.min(F.when(F.col("found"), F.col("elapsed_s"))), F.max("wall_s")).alias("latency_s")
    )


def canonical_detection(outcomes: DataFrame) -> DataFrame:
    """Whether a configuration detects a problem: in more than half of the repetitions.

    All outcomes of a problem are dealt to one partition before they are grouped. Hardly any group repeats among the rows
    that one task reads, so grouping there first would only keep them all.
    """
    dealt = spread(outcomes.select("config", "app", "entry_id", "problem_type", "detected"), "app", "entry_id")
    return dealt.groupBy("config", "app", "entry_id").agg(
        F.any_value("problem_type").alias("problem_type"),
        (F.count_if("detected") * 2 > F.count(F.lit(1))).alias("detected"),
    )


def stability(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per configuration: did every repetition detect the same problems, with as many false positives?

    A detected set is compared by the number and the order-free hash sum of its members.
    """
    member = F.xxhash64("entry_id").cast("decimal(38,0)")
    sets = outcomes.where("detected").groupBy("config", "app", "repetition").agg(
        F.count(F.lit(1)).alias("n"), F.sum(member).alias("h")
    )
    key = ["config", "app", "repetition"]
    per_run = runs.select(*key, "fp").join(sets, key, "left").fillna(0, ["n"])
    per_app = per_run.groupBy("config", "app").agg(
        F.countDistinct(F.struct("n", F.coalesce("h", F.lit(0).cast("decimal(38,0)")))).alias("sets"), F.countDistinct("fp").alias("fps")
    )
    return per_app.groupBy("config").agg(
        (F.max("sets") == 1).alias("identical_detections"), (F.max("fps") == 1).alias("identical_false_positives")
    )


def run_metrics(runs: DataFrame, outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, false-positive rate, latency and cost of each repetition, pooled over apps (``by``
    may add ``app``)."""
    key = ["config", *(by or []), "repetition"]
    latency = outcomes.where(F.col("latency_s").isNotNull()).groupBy(*key).agg(F.avg("latency_s").alias("detection_latency_s"))
    pooled = runs.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "negatives")], *[F.sum(c).alias(c) for c in ("wall_s", "cpu_s")]
    )
    rated = with_rates(pooled).withColumn("false_positive_rate", ratio("fp", "negatives"))
    return rated.join(latency, key, "left")


def per_problem_type(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Recall, precision and false-positive rate per repetition, then their means.

    ``rows``: config, app, repetition, problem_type, entries, tp, fp, fn.
    """
    joined = rows.join(universe, ["app", "problem_type"], "left").fillna(0, ["units"])
    cells = joined.groupBy("config", "problem_type", "repetition").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "entries")],
        F.sum(F.greatest(F.col("units") - F.col("entries"), F.lit(0))).alias("negatives"),
    )
    return cells.groupBy("config", "problem_type").agg(
        F.max("entries").alias("entries"),
        F.avg(ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"),
        F.avg(ratio("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        F.avg(ratio("fp", "negatives")).alias("false_positive_rate"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("tp", "fp", "fn")],
    )


def universe_counts(handlers: DataFrame, relations: DataFrame, actual_keys: DataFrame, declared_keys: DataFrame) -> DataFrame:
    """(app, problem_type, units): how many places each problem could occur in.

    Each input has a row per place: route handlers, declared relations, actual and declared indexes.
    """
    performance = [p for p, c in PROBLEM_CATEGORY.items() if c == "performance"]
    counted = lambda df, types: df.groupBy("app").agg(F.count(F.lit(1)).alias("units")).withColumn(
        "problem_type", F.explode(F.array(*[F.lit(x) for x in types]))
    ).select("app", "problem_type", "units")
    parts = [(handlers, performance), (relations, ["orphaned_foreign_key"]), (actual_keys, ["index_not_declared"]), (declared_keys, ["declared_index_not_applied"])]
    result = counted(*parts[0])
    for part in parts[1:]:
        result = result.unionByName(counted(*part))
    return result
