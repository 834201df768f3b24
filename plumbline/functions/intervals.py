"""Overlap joins of whole-number intervals over blocks of doubling length.

Two intervals overlap if the start of one lies in the other. An interval is the sum of at most two blocks per power of
two, and a point lies in one block of each power, so "point in interval" is an equality of (level, block): an interval of
a million lines is forty rows at most, and each pair meets once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DOWN = lambda value, level: F.call_function("shiftright", value, level)


def cover(start: Column, end: Column, levels: int) -> Column:
    """The blocks (level, block) that make up [start, end], for intervals of fewer than 2 ** ``levels`` places."""
    first, last = start.cast("long"), end.cast("long") + 1

    def at(level: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = _DOWN(first + one - 1, level), _DOWN(last, level)
        block = lambda wanted, number: F.when(wanted & (low < high), F.struct(level.alias("level"), number.alias("block")))
        return F.array_compact(F.array(block(low % 2 != 0, low), block(high % 2 != 0, high - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at))


def around(point: Column, levels: int) -> Column:
    """The blocks (level, block) of every level that hold a point."""
    place = point.cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)), lambda level: F.struct(level.alias("level"), _DOWN(place, level).alias("block"))
    )


def levels_for(*lengths: DataFrame) -> int:
    """Levels that cover the longest of some intervals; each DataFrame has one column of their numbers of places."""
    every = reduce(DataFrame.unionAll, lengths)
    return max(1, int(every.agg(F.max(every.columns[0])).first()[0] or 1).bit_length())


def overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ends: tuple[str, str], right_ends: tuple[str, str]
) -> DataFrame:
    """All columns of the pairs of rows with equal ``keys`` whose closed intervals overlap.

    Other columns must differ in name between the two sides. Intervals that end before they start meet nothing.
    """
    (a, b), (c, d) = left_ends, right_ends
    left, right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    size = lambda df, start, end: df.select((F.col(end).cast("long") - F.col(start) + 1).alias("n"))
    levels = levels_for(size(left, a, b), size(right, c, d))
    dealt = lambda df, blocks: df.withColumn("_x", F.explode(blocks)).withColumns({"_level": F.col("_x.level"), "_block": F.col("_x.block")}).drop("_x")
    on = [*keys, "_level", "_block"]
    # The right side starts within the left one, or the left one starts later than the right one and within it.
    starts = dealt(left, cover(F.col(a), F.col(b), levels)).join(dealt(right, around(F.col(c), levels)), on)
    inside = dealt(left, around(F.col(a), levels)).join(dealt(right, cover(F.col(c) + 1, F.col(d), levels)), on)
    return starts.unionByName(inside).drop("_level", "_block")
