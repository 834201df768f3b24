"""Scan history: counts, what is new, what went away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import positions

#: Sort rank of a severity.
SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def severity_rank(severity: Column | str) -> Column:
    column = F.col(severity) if isinstance(severity, str) else severity
    return F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[column]


def assign_finding_ids(findings: DataFrame) -> DataFrame:
    """Ids F001... within each scan by severity, file, line and rule; and the layers behind each.

    Ranked across ranges of the order, so one scan may hold any share of the findings.
    """
    order = [severity_rank("severity").asc(), F.asc("file"), F.asc("line"), F.asc("rule_id"), F.asc("fingerprint")]
    ranked = positions(findings, ["scan_id"], order, "_p")
    layers = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["source"])))
    return ranked.withColumn("finding_id", F.format_string("F%03d", "_p")).withColumn("layers", layers).drop("_p")


def scan_counts(scans: DataFrame, findings: DataFrame, limit: int | None = 50) -> DataFrame:
    """Findings per severity of each scan, scans without findings included, newest first."""
    counted = findings.groupBy("scan_id").agg(
        *[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("high", "medium", "low")],
        F.count(F.lit(1)).alias("total"),
    )
    joined = scans.join(counted, "scan_id", "left").fillna(0, ["high", "medium", "low", "total"])
    ordered = joined.orderBy(F.desc("started_at"))
    return ordered if limit is None else ordered.limit(limit)


def latest_scan(scans: DataFrame, only_ok: bool = False) -> DataFrame:
    """The newest scan of each app."""
    chosen = scans.where(F.col("status") == "ok") if only_ok else scans
    rest = [c for c in scans.columns if c != "app"]
    newest = chosen.groupBy("app").agg(F.max_by(F.struct(*rest), F.struct("started_at", "scan_id")).alias("s"))
    return newest.select("app", "s.*")


def visible(scans: DataFrame, viewer: str) -> DataFrame:
    """A viewer's own scans, and app scans nobody owns."""
    return scans.where((F.col("owner_id") == viewer) | (F.col("owner_id").isNull() & (F.col("kind") == "app")))


def with_previous(scans: DataFrame) -> DataFrame:
    """Successful scans with the one before them."""
    history = Window.partitionBy("app").orderBy("started_at", "scan_id")
    return scans.where(F.col("status") == "ok").withColumn("previous_id", F.lag("scan_id").over(history))


def diff_findings(scans: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, resolved) per scan against the previous successful scan; none for the first."""
    pairs = with_previous(scans).where(F.col("previous_id").isNotNull()).select("scan_id", "previous_id")
    prints = findings.select("scan_id", "fingerprint").distinct()
    now = pairs.join(prints, "scan_id")
    before = pairs.join(prints.withColumnRenamed("scan_id", "previous_id"), "previous_id").select(
        "scan_id", "previous_id", "fingerprint"
    )
    keys = ["scan_id", "fingerprint"]
    return now.join(before, keys, "left_anti"), before.join(now, keys, "left_anti")


def severity_trend(counts: DataFrame) -> DataFrame:
    """Counts in order of time with the change from the scan before."""
    history = Window.partitionBy("app").orderBy("started_at", "scan_id")
    return counts.withColumn("delta", F.col("total") - F.lag("total").over(history))


def by_rule(findings: DataFrame) -> DataFrame:
    """Findings per rule with the worst severity, most frequent first."""
    grouped = findings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.min_by("severity", severity_rank("severity")).alias("worst")
    )
    return grouped.orderBy(F.desc("findings"), "rule_id")


def filter_findings(
    findings: DataFrame, severity: str | None = None, confidence: str | None = None, rule: str | None = None,
    layer: str | None = None, text: str | None = None,
) -> DataFrame:
    if severity is not None:
        findings = findings.where(F.col("severity") == severity.upper())
    if confidence is not None:
        findings = findings.where(F.col("confidence") == confidence.upper())
    if rule is not None:
        findings = findings.where(F.col("rule_id") == rule)
    if layer is not None:
        findings = findings.where(F.array_contains("layers", layer.upper()))
    if text:
        haystack = F.lower(F.concat_ws(" ", "title", "file", "rule_id"))
        findings = findings.where(F.contains(haystack, F.lit(text.lower())))
    return findings


def only_new(findings: DataFrame, added: DataFrame) -> DataFrame:
    return findings.join(added.select("scan_id", "fingerprint"), ["scan_id", "fingerprint"], "left_semi")


def layer_coverage(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Layers a scan ran, layers that contributed to a finding, and those that stayed silent."""
    used = findings.select("scan_id", F.explode("layers").alias("layer")).groupBy("scan_id").agg(
        F.array_sort(F.collect_set("layer")).alias("_used")
    )
    joined = scans.select("scan_id", F.array_sort("ran").alias("ran")).join(used, "scan_id", "left")
    joined = joined.withColumn("_used", F.coalesce("_used", F.array().cast("array<string>")))
    return joined.select(
        "scan_id", "ran", F.array_intersect("ran", "_used").alias("contributing"), F.array_except("ran", "_used").alias("silent")
    )


def finding_totals(findings: DataFrame, keys: Sequence[str] = ("rule_id", "confidence")) -> DataFrame:
    """(kind, name, findings) for each key column, in one pass."""
    rows = findings.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in keys])).alias("r"))
    return rows.groupBy("r.kind", "r.name").agg(F.count(F.lit(1)).alias("findings"))


def repository_totals(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Repositories analysed, failed and without findings."""
    counted = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    joined = repos.join(counted, "repo", "left")
    return joined.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"),
        F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("zero"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
    )
