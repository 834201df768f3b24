"""Findings as JSON, CSV in and out, SQL files and their statements."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import csv_field

#: Folders whose files are not the project's own.
SKIPPED_DIRECTORIES = ("node_modules", ".git", "dist", "build", ".next", "generated")

#: Levels of severity and confidence, and where evidence comes from.
LEVELS = ("LOW", "MEDIUM", "HIGH")
EVIDENCE_SOURCES = ("STATIC_SOURCE", "DECLARED_SCHEMA", "ACTUAL_SCHEMA", "SQL", "RUNTIME", "DATA_QUALITY")
EVIDENCE_KEYS = ("source", "description", "file", "line", "data")

#: JSON names of a finding and of an evidence item.
FINDING_KEYS = {
    "schema_version": "schemaVersion", "rule_id": "ruleId", "severity": "severity", "confidence": "confidence",
    "file": "file", "line": "line", "end_line": "endLine", "title": "title", "body": "body", "evidence": "evidence",
    "suggested_fix": "suggestedFix", "fingerprint": "fingerprint",
}


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding (column ``value``); absent fields are left out."""
    item = lambda e: F.struct(
        e["source"].alias("source"), e["description"].alias("description"), e["file"].alias("file"),
        e["line"].alias("line"), F.try_parse_json(e["data"]).alias("data"),
    )
    fields = [
        (F.transform("evidence", item) if c == "evidence" else F.col(c)).alias(FINDING_KEYS[c]) for c in FINDING_KEYS
    ]
    return findings.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


_FINDING_JSON = (
    "schemaVersion int, ruleId string, severity string, confidence string, file string, line int, endLine int, "
    "title string, body string, evidence array<struct<source:string,description:string,file:string,line:int,"
    "data:variant>>, suggestedFix string, fingerprint string"
)


def parse_findings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, rejected) from JSON lines. Unknown or missing keys, also of evidence, wrong versions, values
    that are not of their type, unknown levels and unknown evidence sources are rejected."""
    known = list(FINDING_KEYS.values())
    required = [k for k in known if k not in ("endLine", "suggestedFix")]
    keys = F.json_object_keys("value")
    parsed = lines.withColumn("f", F.from_json("value", _FINDING_JSON)).withColumn("_keys", keys).withColumns({
        "_found": F.from_json("value", "map<string,string>"),
        "_items": F.from_json(F.get_json_object("value", "$.evidence"), "array<map<string,string>>"),
    })
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    item_ok = lambda e, found: (
        (F.size(F.array_except(F.map_keys(found), listed(EVIDENCE_KEYS))) == 0)
        & e["source"].isin(*EVIDENCE_SOURCES) & e["description"].isNotNull()
        & (e["line"].isNull() == found["line"].isNull())
    )
    typed = F.lit(True)
    for name in known:
        typed = typed & (F.col("_found")[name].isNull() == F.col(f"f.{name}").isNull())
    for name in required:
        typed = typed & F.col(f"f.{name}").isNotNull()
    good = (
        (F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in known]))) == 0)
        & (F.size(F.array_except(F.array(*[F.lit(k) for k in required]), F.col("_keys"))) == 0)
        & (F.col("f.schemaVersion") == 1) & typed
        & F.col("f.severity").isin(*LEVELS) & F.col("f.confidence").isin(*LEVELS)
        & F.forall(F.zip_with("f.evidence", "_items", lambda e, i: F.coalesce(item_ok(e, i), F.lit(False))), lambda ok: ok)
    )
    good = F.coalesce(good, F.lit(False))
    item = lambda e: F.struct(
        e["source"].alias("source"), e["description"].alias("description"), e["file"].alias("file"),
        e["line"].alias("line"), F.to_json(e["data"]).alias("data"),
    )
    findings = parsed.where(good).select(
        *[
            (F.transform("f.evidence", item) if c == "evidence" else F.col(f"f.{j}")).alias(c)
            for c, j in FINDING_KEYS.items()
        ]
    )
    return findings, parsed.where(~good).select("value")


def append_results(df: DataFrame, path: str, experiment: str) -> None:
    """Appends raw per-run rows under their experiment; nothing is aggregated or overwritten."""
    df.withColumn("experiment", F.lit(experiment)).write.mode("append").partitionBy("experiment").parquet(path)


def latest_experiment(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest experiment (experiments are named so that later ones sort last)."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("experiment") == rows.agg(F.max("experiment")).scalar())


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One CSV line per row (column ``value``), fields quoted only where needed."""
    return df.select(F.concat_ws(",", *[csv_field(c) for c in columns]).alias("value"))


def write_csv(df: DataFrame, path: str, null: str = "", quote_all: bool = True) -> None:
    """CSV files with a header; quotes are doubled and NULL is written as ``null``. Without ``quote_all`` only fields that need it are quoted."""
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue=null, quoteAll=quote_all)


def read_worksheet(spark: SparkSession, path: str, null: str | None = None) -> DataFrame:
    """A CSV worksheet with a header, every column a string, fields may span lines. An empty field is an
    empty text; only a field that equals ``null`` is NULL."""
    sheet = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').fillna("")
    if null is None:
        return sheet
    return sheet.select(*[F.nullif(F.col(f"`{c}`"), F.lit(null)).alias(c) for c in sheet.columns])


def own_files(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path has none of SKIPPED_DIRECTORIES among its parts."""
    skipped = F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES])
    return df.where(~F.arrays_overlap(F.split(path, "/"), skipped))


def sql_files(spark: SparkSession, root: str, pattern: str = "*.sql") -> DataFrame:
    """(path, text) of the SQL files below ``root``, path relative to it."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    prefix = f"^(?:file:)?/*{re.escape(root.strip('/'))}/"
    files = reader.text(root, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), prefix, "").alias("path"), F.col("value").alias("text")
    )
    return own_files(files)


# A comment, a quoted string (open-ended at the end of the text), a semicolon, or other text.
_TOKEN = re.compile(r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|'(?:[^']|'')*(?:'|\Z)|(?P<end>;)|[^;'/-]+|.", re.DOTALL)


#: Characters of a piece that a text is handed over in, and statements of a batch that goes back.
PIECE, STATEMENTS = 4096, 10_000


class _Splitter:
    """Cuts one text, given in parts, into its top-level statements with their starting lines; comments are dropped.

    What the end of a part may leave open, a comment, a string or half a sign, waits for the next part.
    """

    def __init__(self) -> None:
        self.line, self.start, self.parts, self.rest = 1, 0, [], ""

    def feed(self, text: str, final: bool) -> Iterator[tuple[int, str]]:
        text = self.rest + text
        self.rest = ""
        for token in _TOKEN.finditer(text):
            piece, kind = token.group(), token.lastgroup
            if token.end() == len(text) and not final and kind != "end" and piece[0] in "-/'":
                self.rest = piece
                return
            if kind == "end":
                if self.parts:
                    yield self.start, "".join(self.parts).strip()
                self.start, self.parts = 0, []
            elif kind != "comment":
                if self.parts:
                    self.parts.append(piece)
                elif bare := piece.lstrip():
                    self.start = self.line + piece[: len(piece) - len(bare)].count("\n")
                    self.parts.append(bare)
            self.line += piece.count("\n")
        if final and self.parts:
            yield self.start, "".join(self.parts).strip()


def split_statements(files: DataFrame) -> DataFrame:
    """(path, line, sql) for every statement of every file, split on top-level semicolons.

    A text reaches the worker in pieces, in order, and statements leave it in batches, so a worker holds one batch of
    pieces and the statement it is in, however long a file is or however many files a task has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, path, splitter = ["path", "line", "sql"], [], None, _Splitter()

        def filled() -> pa.RecordBatch:
            rows = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.string()))]
            found.clear()
            return pa.RecordBatch.from_arrays(rows, names)

        for batch in batches:
            places, last = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(places):
                if places[at] == 0:
                    path, splitter = batch.column(0)[at].as_py(), _Splitter()
                # The pieces of one text up to its last one or the end of the batch.
                end = at
                while end + 1 < len(places) and not last[end]:
                    end += 1
                text = "".join(batch.column(3).slice(at, end + 1 - at).to_pylist())
                for line, sql in splitter.feed(text, last[end]):
                    found.append((path, line, sql))
                    if len(found) == STATEMENTS:
                        yield filled()
                at = end + 1
        if found:
            yield filled()

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # Only a text's first piece carries its path.
    handed = files.select("path", pieces.alias("_pieces")).select("path", F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("_i", "_text"))
    handed = handed.select(F.when(F.col("_i") == 0, F.col("path")).alias("path"), "_i", (F.col("_i") == F.col("_n") - 1).alias("_last"), "_text")
    return handed.mapInArrow(run, "path string, line int, sql string")


def corpus_counts(files: DataFrame, patterns: dict[str, str], only_if: str | None = None) -> DataFrame:
    """Per file: physical lines and matches of each pattern (0 unless ``only_if`` matches too)."""
    lines = F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 1).otherwise(0)
    counts = []
    for name, pattern in patterns.items():
        found = F.regexp_count("text", F.lit(pattern))
        counts.append((F.when(F.col("text").rlike(only_if), found).otherwise(0) if only_if else found).alias(name))
    return files.select("path", lines.alias("lines"), *counts)


def source_context(files: DataFrame, findings: DataFrame, context: int = 10, bucket: int = 64) -> DataFrame:
    """(finding_id, source_context): the flagged lines with ``context`` lines either side, numbered,
    flagged ones marked '>'.

    Lines and findings meet on (path, block of ``bucket`` lines), so neither a long file nor a
    finding-heavy one is handled by one task.
    """
    split = files.select("path", F.posexplode(F.split("text", "\n")).alias("_i", "text"), F.size(F.split("text", "\n")).alias("_n"))
    lines = split.where(~((F.col("_i") == F.col("_n") - 1) & (F.col("text") == ""))).select(
        "path", (F.col("_i") + 1).alias("n"), "text", F.floor(F.col("_i") / bucket).alias("_block")
    )
    flagged = findings.select("finding_id", "path", "line", F.coalesce("end_line", "line").alias("last"))
    shown = flagged.withColumn("_from", F.greatest(F.col("line") - context, F.lit(1))).withColumn("_to", F.col("last") + context)
    shown = shown.withColumn(
        "_block", F.explode(F.sequence(F.floor((F.col("_from") - 1) / bucket), F.floor((F.col("_to") - 1) / bucket)))
    )
    joined = shown.join(lines, ["path", "_block"]).where((F.col("n") >= F.col("_from")) & (F.col("n") <= F.col("_to")))
    rows = joined.groupBy("finding_id", "line", "last").agg(
        F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"), F.length(F.max("n").cast("string")).alias("width")
    )
    mark = lambda r: F.when((r["n"] >= F.col("line")) & (r["n"] <= F.col("last")), ">").otherwise(" ")
    text = lambda r: F.concat(
        mark(r), F.lit(" "), F.lpad(r["n"].cast("string"), F.col("width"), F.lit(" ")), F.lit(" | "), r["text"]
    )
    return rows.select("finding_id", F.array_join(F.transform("rows", text), "\n").alias("source_context"))
