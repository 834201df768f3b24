"""Table scans, the catalog of what exists and the declared contract of what should."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import column
from ..schemas import CONTRACT

#: Fixed value: the migration tool's own table, never analysed.
BOOKKEEPING_TABLES = ("_prisma_migrations",)


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One user table, read-only."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table of an external database, read in parallel slices of ``partition_column``."""
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=dict(properties or {}),
    )


class Tables:
    """Lazily opened tables of one directory: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.directory, name)


def catalog_tables(
    tables: Mapping[str, DataFrame],
    keys: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What exists: one row per column, plus keys and foreign keys if the source records any."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, field.name, position, field.dataType.simpleString(), field.nullable)
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, 1)
    ]
    columns = spark.createDataFrame(
        rows, "table string, column string, position int, data_type string, nullable boolean"
    )
    if keys is None:
        keys = spark.createDataFrame(
            [], "table string, name string, kind string, columns array<string>, "
            "referenced_columns array<string>, predicate string, definition string, "
            "has_expression boolean"
        )
    if foreign_keys is None:
        foreign_keys = spark.createDataFrame(
            [], "table string, name string, columns array<string>, referenced_table string, "
            "referenced_columns array<string>, on_delete string"
        )
    return {"columns": columns, "keys": keys, "foreign_keys": foreign_keys}


def read_contract(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return contract_tables(spark.read.schema(CONTRACT).json(path))


def contract_tables(models: DataFrame) -> dict[str, DataFrame]:
    """Declared columns, keys and relations, with database names applied (dbName, else name)."""
    table = F.coalesce("dbName", "name")
    real = models.where(F.coalesce("blockType", F.lit("model")) == "model")
    tables = models.select(
        F.col("name").alias("model"), table.alias("table"),
        F.coalesce("blockType", F.lit("model")).alias("block_type"), "line", "enumValues",
    )
    fields = real.select(
        F.col("name").alias("model"), table.alias("table"), F.posexplode("fields").alias("p", "f")
    )
    columns = fields.select(
        "model", "table", F.col("f.name").alias("field"),
        F.coalesce("f.dbName", "f.name").alias("column"), "f.kind", "f.type",
        F.coalesce("f.optional", F.lit(False)).alias("optional"),
        F.coalesce("f.list", F.lit(False)).alias("list"),
        F.col("f.nativeType").alias("native_type"), F.col("f.nativeArgs").alias("native_args"),
        "f.line", (F.col("p") + 1).alias("position"),
    )
    names = F.map_from_arrays(
        F.col("fields.name"), F.transform("fields", lambda f: F.coalesce(f["dbName"], f["name"]))
    )
    named = real.select(
        F.col("name").alias("model"), table.alias("table"), names.alias("names"), "keys",
        "relations",
    )
    db = lambda listed, mapping: F.transform(listed, lambda n: F.coalesce(mapping[n], n))
    keys = named.select("model", "table", "names", F.explode("keys").alias("k")).select(
        "model", "table", "k.kind", db(F.col("k.columns"), F.col("names")).alias("columns"),
        "k.name", "k.line",
    )
    relations = named.select("model", "table", "names", F.explode("relations").alias("r"))
    parents = models.select(
        F.col("name").alias("_parent"), table.alias("referenced_table"),
        F.map_from_arrays(
            F.col("fields.name"),
            F.transform("fields", lambda f: F.coalesce(f["dbName"], f["name"])),
        ).alias("_parent_names"),
    )
    relations = relations.join(
        parents, F.col("r.referencedModel") == F.col("_parent"), "left"
    ).select(
        "model", "table", F.col("r.field").alias("relation"), F.col("r.name").alias("name"),
        F.col("r.foreignKeyOn").alias("foreign_key_on"),
        F.col("r.referencedModel").alias("referenced_model"), "referenced_table",
        db(F.col("r.fields"), F.col("names")).alias("columns"),
        db(F.col("r.references"), F.col("_parent_names")).alias("referenced_columns"),
        F.col("r.line").alias("line"),
    )
    return {"tables": tables, "columns": columns, "keys": keys, "relations": relations}


# ---- what a declared column becomes in the database --------------------------------------------

#: Declared scalar type -> database type.
SCALAR_TYPES = {
    "String": "text",
    "Boolean": "boolean",
    "Int": "integer",
    "BigInt": "bigint",
    "Float": "double precision",
    "Decimal": "numeric(65,30)",
    "DateTime": "timestamp(3) without time zone",
    "Json": "jsonb",
    "Bytes": "bytea",
}

#: Native type attribute -> database type; {} is where "(p[,s])" goes.
NATIVE_TYPES = {
    "Text": "text",
    "Uuid": "uuid",
    "Boolean": "boolean",
    "Integer": "integer",
    "SmallInt": "smallint",
    "BigInt": "bigint",
    "Oid": "oid",
    "Real": "real",
    "DoublePrecision": "double precision",
    "Money": "money",
    "Date": "date",
    "Json": "json",
    "JsonB": "jsonb",
    "ByteA": "bytea",
    "Xml": "xml",
    "Inet": "inet",
    "Citext": "citext",
    "VarChar": "character varying{}",
    "Char": "character{}",
    "Bit": "bit{}",
    "VarBit": "bit varying{}",
    "Decimal": "numeric{}",
    "Timestamp": "timestamp{} without time zone",
    "Timestamptz": "timestamp{} with time zone",
    "Time": "time{} without time zone",
    "Timetz": "time{} with time zone",
}

#: How the engine stores each database type (arguments removed). Decimals wider than 38 digits
#: do not fit and are narrowed; `spark_type` is NULL for types kept as text.
SPARK_TYPES = {
    "boolean": "boolean",
    "smallint": "smallint",
    "integer": "int",
    "bigint": "bigint",
    "oid": "bigint",
    "real": "float",
    "double precision": "double",
    "money": "decimal(19,2)",
    "date": "date",
    "bytea": "binary",
    "timestamp without time zone": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "text": "string",
    "character varying": "string",
    "character": "string",
    "uuid": "string",
    "jsonb": "string",
    "json": "string",
    "xml": "string",
    "inet": "string",
    "citext": "string",
    "bit": "string",
    "bit varying": "string",
    "time without time zone": "string",
    "time with time zone": "string",
}


def _lookup(table: Mapping[str, str], key) -> F.Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def expected_type(columns: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """Adds ``expected_type`` (NULL if not derivable) and ``expected_nullable``.

    ``enums`` maps an enum name to its database name.
    """
    if enums is not None:
        names = enums.select(F.col("model").alias("type"), F.col("table").alias("_enum"))
        columns = columns.join(names, "type", "left")
    else:
        columns = columns.withColumn("_enum", F.lit(None).cast("string"))
    arguments = F.when(
        F.size("native_args") > 0,
        F.concat(F.lit("("), F.array_join(F.col("native_args").cast("array<string>"), ","), F.lit(")")),
    ).otherwise("")
    native = F.replace(_lookup(NATIVE_TYPES, F.col("native_type")), F.lit("{}"), arguments)
    base = (
        F.when(F.col("native_type").isNotNull(), native)
        .when(F.col("kind") == "enum", F.coalesce("_enum", "type"))
        .when(F.col("kind") == "scalar", _lookup(SCALAR_TYPES, F.col("type")))
    )
    return columns.withColumn(
        "expected_type", F.when(F.col("list"), F.concat(base, F.lit("[]"))).otherwise(base)
    ).withColumn("expected_nullable", F.col("optional") | F.col("list")).drop("_enum")


def spark_type(database_type) -> F.Column:
    """The engine's type for a database type, and whether a decimal had to be narrowed."""
    text = column(database_type)
    element = F.regexp_replace(text, r"\[\]$", "")
    bare = F.regexp_replace(element, r"\([^)]*\)", "")
    digits = F.regexp_extract(element, r"^numeric\((\d+)", 1)
    scale = F.regexp_extract(element, r"^numeric\(\d+,(\d+)\)", 1)
    wide = F.expr("1=1") & (digits != "") & (digits.cast("int") > 38)
    decimal = (
        F.when(wide | (digits == ""), F.lit("decimal(38,18)"))
        .otherwise(F.concat(F.lit("decimal("), digits, F.lit(","), F.when(scale == "", "0").otherwise(scale), F.lit(")")))
    )
    mapped = F.when(bare == "numeric", decimal).otherwise(_lookup(SPARK_TYPES, bare))
    return F.when(text.endswith("[]"), F.concat(F.lit("array<"), mapped, F.lit(">"))).otherwise(mapped)


def narrowed(database_type) -> F.Column:
    """Whether a declared decimal has more digits than the engine can hold."""
    digits = F.regexp_extract(column(database_type), r"^numeric\((\d+)", 1)
    return (digits != "") & (digits.cast("int") > 38)
