"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graphs import components  # noqa: F401 (used by the operators)
from ..session import cut
from .arrays import give_back


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): the columns the text operators read; others, whatever their names, are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a NULL id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hash_sample(rows: DataFrame, size: int, spare: float = 1.0) -> DataFrame:
    """About ``size`` of the rows by a hash of doc_id, all of them if there are fewer; no row passes through one task.

    The threshold follows from the counted rows, so the choice depends on the ids and their number alone.
    """
    count = rows.count()
    if count <= size * spare:
        return rows
    threshold = int(size / count * (1 << 62))
    return rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(size), "doc_id"), 2) < threshold)


#: Rows of one long that a semi join may broadcast (8 MB); the number is counted before.
BROADCAST_ROWS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among the distinct ``ids`` (one column ``key``).

    The ids are written once and counted: up to BROADCAST_ROWS they are broadcast, which spares a shuffle of the rows;
    beyond that both sides are shuffled.
    """
    ids = cut(ids)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")


def packed(spark: SparkSession, value) -> Broadcast:
    """A bounded driver-side value for the tasks; they need no installed package to read it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(value: Broadcast):
    return pickle.loads(value.value)


def release(spark: SparkSession) -> None:
    """Lets go of what finished jobs left: Spark drops broadcasts and shuffles when the driver collects its garbage.

    An operator of many jobs calls this between its turns, so that neither the driver nor the executors carry all of them.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()
