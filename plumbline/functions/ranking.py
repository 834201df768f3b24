"""Exact order statistics that never put a whole group into one task.

A window over ``PARTITION BY key`` hands one task every row of the key, and the exact
``percentile`` aggregate keeps every distinct value of it in memory. Both fail when one key holds
a third of the table, so the helpers here split a group by value, by range or by hash first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Relative rank error of the sketch that splits running totals is 1 / ACCURACY.
ACCURACY = 10_000
#: Rows among which a wanted rank is looked up; more are first narrowed by counts of PARTS value ranges.
BRACKET, PARTS = 100_000, 4096
#: Value ranges a group is split into for running totals: STEP blocks of STEP ranges.
STEP = 16
RANGES = STEP * STEP


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def _narrowed(base: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each of the brackets ``wide`` cut down to the value range that holds its rank.

    Ranges follow the logarithm where all values have one sign and differ much. What counts is that equal values fall
    into one range and larger ones into no lower range; the new ends are values that occur, and the counts are exact.
    """
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    joined = base.alias("b").join(wide.alias("s"), _same(keys, "b", "s")).select("s.*", "b._v").where((v >= low) & (v <= high))
    near, far = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    steep = (F.signum(low) == F.signum(high)) & (near * 1000 < far)
    grown = F.log(F.abs(v) / near) / F.log(far / near)
    share = F.when(steep, F.when(low > 0, grown).otherwise(1 - grown)).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
    inner = F.floor(share * (PARTS - 2)) + 1
    # The ends have ranges of their own, so every step leaves values out.
    part = F.when(v == low, 0).when(v == high, PARTS - 1).otherwise(F.least(F.greatest(inner, F.lit(1)), F.lit(PARTS - 2)))
    names = [*keys, "_name", "_rank"]
    counted = joined.groupBy(*names, "_below", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    ahead = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_inside").over(ahead), F.lit(0)))
    rank = F.col("_rank")
    return placed.where((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_inside"))).drop("_part")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles (rank ``(n-1)*p``) per key, one column per name.

    The value at a rank lies in a bracket that starts as the whole group. As long as a bracket holds more than BRACKET
    rows of different values, they are counted by value range and the bracket shrinks to the range of the rank; then
    its rows are ranked. Every step counts rows, so the result is exact for any size and any distribution.
    """
    keys = list(keys) or ["_all"]
    base = df.where(F.col(value).isNotNull())
    if keys == ["_all"]:
        base = base.withColumn("_all", F.lit(0))
    base = base.select(*keys, F.col(value).cast("double").alias("_v"))

    position = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    asked = F.array(*[
        F.struct(F.lit(name).alias("name"), end(position(p)).alias("rank"))
        for name, p in probabilities.items() for end in (F.floor, F.ceil)
    ])
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    sizes = cut(sizes)
    columns = [*keys, "_name", "_rank", "_below", "_inside", "_low", "_high"]
    state = sizes.withColumn("_x", F.explode(F.array_distinct(asked))).select(
        *keys, F.col("_x.name").alias("_name"), F.col("_x.rank").alias("_rank"), F.lit(0).cast("long").alias("_below"),
        F.col("_n").alias("_inside"), "_low", "_high",
    )
    wide = (F.col("_inside") > BRACKET) & (F.col("_low") < F.col("_high"))
    while not state.where(wide).isEmpty():
        state = cut(state.where(~wide).select(*columns).unionByName(_narrowed(base, state.where(wide), keys).select(*columns)))

    inside = base.alias("b").join(state.where("_low < _high").alias("s"), _same(keys, "b", "s")).select("s.*", "b._v")
    counted = inside.where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    counted = counted.groupBy(*keys, "_name", "_rank", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*keys, "_name", "_rank").orderBy("_v")
    ranked = counted.withColumn("_seen", F.col("_below") + F.sum("_c").over(running)).where(F.col("_seen") > F.col("_rank"))
    found = ranked.groupBy(*keys, "_name", "_rank").agg(F.min("_v").alias("_v"))
    found = found.unionByName(state.where("_low = _high").select(*keys, "_name", "_rank", F.col("_low").alias("_v")))
    ends = found.groupBy(*keys, "_name").agg(
        F.min(F.struct("_rank", "_v"))["_v"].alias("_lo"), F.max(F.struct("_rank", "_v"))["_v"].alias("_hi"), F.min("_rank").alias("_first")
    )
    joined = ends.alias("e").join(sizes.alias("n"), _same(keys, "e", "n")).select("e.*", "n._n")
    between = lambda p: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (position(p) - F.col("_first"))
    result = joined.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, between(p))).alias(name) for name, p in probabilities.items()
    ])
    return result.drop("_all") if keys == ["_all"] else result


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str]
) -> DataFrame:
    """Adds ``<weight>_before``: the weight of the key's rows with a smaller ``order`` value.

    ``df`` holds one row per (keys, numeric order value). Each key is cut into RANGES value ranges;
    totals of whole ranges are added up first, then each range is ranked on its own.
    """
    keys = list(keys)
    probabilities = [i / RANGES for i in range(1, RANGES)]
    bounds = cut(
        df.groupBy(*keys).agg(
            F.percentile_approx(F.col(order).cast("double"), probabilities, ACCURACY).alias("_b")
        )
    )
    if keys:
        tagged = df.alias("d").join(bounds.alias("s"), _same(keys, "d", "s")).select("d.*", "_b")
    else:
        tagged = df.withColumn("_b", bounds.select("_b").scalar())
    # Find the block by its last bound first, then the range within it.
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x < F.col(order).cast("double")))
    ends = F.transform(F.sequence(F.lit(STEP - 1), F.lit(RANGES - 2), F.lit(STEP)), lambda i: F.get("_b", i))
    tagged = tagged.withColumn("_block", below(ends) * STEP)
    inner = F.slice("_b", F.col("_block") + 1, STEP - 1)
    tagged = tagged.withColumn("_range", F.col("_block") + below(inner)).drop("_b", "_block")
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, "_range").agg(*[F.sum(w).alias(w) for w in weights])
    totals = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(w).over(ahead), F.lit(0)).alias(f"_{w}") for w in weights]
    )
    joined = tagged.alias("d").join(totals.alias("t"), _same([*keys, "_range"], "d", "t")).select(
        "d.*", *[F.col(f"t._{w}").alias(f"_{w}") for w in weights]
    )
    within = (
        Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    for w in weights:
        joined = joined.withColumn(
            f"{w}_before", F.col(f"_{w}") + F.coalesce(F.sum(w).over(within), F.lit(0))
        )
    return joined.drop("_range", *[f"_{w}" for w in weights])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position", part: bool = False
) -> DataFrame:
    """1-based position of each row within its key, by ``order`` (which must break all ties).

    With ``part`` the column ``_part`` tells the range a row lies in; ranges follow the order within a key.

    The rows are range-partitioned by key and order, so a large key spans many partitions, and
    written once; a row's position is its rank in its partition plus the sizes of the ranges before.
    """
    keys = list(keys)
    ordered = [*[F.col(k).asc() for k in keys], *order]
    ranged = cut(
        df.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id())
    )
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = ranged.withColumn("_rank", F.row_number().over(within))
    joined = ranked.alias("d").join(sizes.alias("s"), _same([*keys, "_part"], "d", "s"))
    return joined.select(
        *[F.col(f"d.{c}") for c in df.columns], (F.col("_rank") + F.col("_ahead")).alias(name), *([F.col("d._part")] if part else [])
    )


def running_max(placed: DataFrame, keys: Sequence[str], value: str, order: str = "position") -> DataFrame:
    """Adds ``<value>_max``: the largest ``value`` of the key's rows up to this one.

    ``placed`` comes from ``positions`` with its ranges: each range is gone through on its own, and the largest values
    of the ranges before, one row each, are carried over.
    """
    keys = list(keys)
    largest = placed.groupBy(*keys, "_part").agg(F.max(value).alias("_largest"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = largest.withColumn("_carried", F.max("_largest").over(ahead)).drop("_largest")
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.max(value).over(within))
    joined = own.alias("d").join(carried.alias("s"), _same([*keys, "_part"], "d", "s")).select("d.*", "_carried")
    return joined.withColumn(f"{value}_max", F.greatest("_own", "_carried")).drop("_own", "_carried")


#: Hash buckets a group is split into when it is ranked in hash order.
HASH_BUCKETS = 4096


def hash_order(*parts: Column | str) -> Column:
    """A seeded, reproducible shuffle key: the md5 hex of the parts."""
    return F.md5(F.concat_ws(":", *parts))


def first_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    limit: Column,
    weight: Column | None = None,
    until_reached: bool = False,
) -> DataFrame:
    """Rows of each key whose running weight, in ``digest`` order, stays within ``limit``.

    With ``until_reached`` rows are kept until the weight reaches the limit, and none after. The
    limit may use ``_n``, the key's total weight. Buckets of the digest's first three hex digits
    are totalled first; then a row's own bucket, a 4096th of the group, is ranked.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    tagged = tagged.withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long"))
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_total"))
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(ahead), F.lit(0)))
    totals = totals.withColumn("_n", F.sum("_total").over(whole)).withColumn("_limit", limit)
    joined = tagged.alias("d").join(totals.alias("t"), _same([*keys, "_bucket"], "d", "t"))
    joined = joined.select("d.*", "_ahead", "_limit").where(F.col("_ahead") <= F.col("_limit"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(digest).rowsBetween(
        Window.unboundedPreceding, 0
    )
    seen = joined.withColumn("_seen", F.col("_ahead") + F.sum("_w").over(within))
    if until_reached:
        seen = seen.where(F.col("_seen") - F.col("_w") < F.col("_limit"))
    else:
        seen = seen.where(F.col("_seen") <= F.col("_limit"))
    return seen.drop("_bucket", "_w", "_ahead", "_seen", "_limit")
