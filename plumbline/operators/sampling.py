"""Deterministic corruption, removal, selection and sampling of rows.

Rows are chosen by a hash of their id, never at random, so a repeated or retried job chooses the
same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import column, pick
from ..functions.ranking import first_by_hash, hash_order, positions


def corrupt(
    df: DataFrame, name: str, row_id: str, salt: str, threshold: int, value: Column,
    where: Column | None = None,
) -> DataFrame:
    """Replaces ``name`` by ``value`` on rows with pick < threshold (and ``where``)."""
    chosen = pick(row_id, salt) < threshold
    if where is not None:
        chosen = chosen & where
    return df.withColumn(name, F.when(chosen, value).otherwise(F.col(name)))


def corrupt_groups(
    df: DataFrame, name: str, row_id: str, order: Sequence[str], salt: str, threshold: int,
    where: Column, size: int = 3, value=None,
) -> DataFrame:
    """Gives runs of ``size`` consecutive chosen rows one common value, taken from the run's first
    id (``value`` maps that id to the value)."""
    needed = dict.fromkeys([row_id, *order])
    recent = positions(df.where(where).select(*needed), [], [F.col(c).asc() for c in order], "_p")
    grouped = recent.select(row_id, F.floor((F.col("_p") - 1) / size).alias("_group"))
    heads = grouped.groupBy("_group").agg(F.min(row_id).alias("_head"))
    heads = heads.where(pick("_head", salt) < threshold)
    marked = grouped.join(heads, "_group").select(row_id, "_head")
    made = (value or (lambda c: c))(F.col("_head"))
    joined = df.join(marked, row_id, "left")
    changed = F.when(F.col("_head").isNotNull(), made.cast(df.schema[name].dataType))
    return joined.withColumn(name, changed.otherwise(F.col(name))).select(*df.columns)


def remove(df: DataFrame, row_id: str, salt: str, threshold: int, where: Column | None = None) -> DataFrame:
    """Deletes rows with pick < threshold (and ``where``)."""
    gone = pick(row_id, salt) < threshold
    return df.where(~F.coalesce(gone if where is None else gone & where, F.lit(False)))


def duplicate(df: DataFrame, row_id: str, salt: str, threshold: int, changes: Mapping[str, Column]) -> DataFrame:
    """Appends copies of rows with pick < threshold, with the given columns changed."""
    copies = df.where(pick(row_id, salt) < threshold)
    return df.unionByName(copies.withColumns(dict(changes)))


def first_failing(df: DataFrame, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds ``decision`` and ``reason``: the first test a row fails, in the order given."""
    reasons = [F.when(failing, F.lit(name)) for name, failing in tests]
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return df.withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason").isNull(), "eligible").otherwise("excluded")
    )


def exclusion_tally(decided: DataFrame) -> DataFrame:
    """Excluded rows by the code of their first failing test (the part before ':')."""
    code = F.split_part("reason", F.lit(":"), F.lit(1))
    return decided.where(F.col("decision") == "excluded").groupBy(code.alias("test")).agg(
        F.count(F.lit(1)).alias("excluded")
    )


def select_until(df: DataFrame, row_id: str, eligible: Column, target: int, seed: int = 0) -> DataFrame:
    """Rows in seeded order until ``target`` eligible rows have been seen; the rest is not kept."""
    ordered = df.withColumn("_order", hash_order(F.lit(str(seed)), column(row_id).cast("string")))
    weight = F.when(eligible, 1).otherwise(0)
    return first_by_hash(ordered, [], "_order", F.lit(target), weight, until_reached=True).drop("_order")


def study_set(df: DataFrame, row_id: str, size: int, seed: int = 0) -> DataFrame:
    """A seeded sample of exactly ``size`` rows (all rows if there are fewer)."""
    ordered = df.withColumn("_order", hash_order(F.lit(str(seed)), column(row_id).cast("string")))
    return first_by_hash(ordered, [], "_order", F.lit(size)).drop("_order")


def stratified_sample(
    df: DataFrame, strata: Sequence[str], row_id: str, fraction: float = 0.2, seed: int = 0
) -> DataFrame:
    """ceil(fraction * n) rows of every stratum, in seeded order."""
    ordered = df.withColumn("_order", hash_order(F.lit(str(seed)), column(row_id).cast("string")))
    # Rounding first keeps 0.2 * 5 from becoming 1.0000000000000002 and two rows.
    share = F.ceil(F.round(F.lit(fraction) * F.col("_n"), 9))
    return first_by_hash(ordered, strata, "_order", share).drop("_order")
