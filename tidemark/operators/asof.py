"""Joins that Spark has no operator for: as-of and band joins, by keys that it can shuffle on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.recursive import stored


#: Rows of a side up to which a key is one task's.
SMALL = 1_000_000


def join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with `value` of the last row of right with the same key and no later time; ties take the greatest value, null keys none.

    Rows are ranged by key and time, so a key of any size is dealt to as many tasks as it fills. Within a range the
    last value is a window; a key that goes on in the next range takes its last value along, one row for each range.
    Up to SMALL rows a side, where one task can hold the largest key, a window for each key is enough.
    """
    side, own, part, carried, going = _unused([*left.columns, *right.columns], "__side", "__value", "__part", "__carried", "__going")
    both = left.withColumn(side, F.lit(1)).withColumn(own, F.lit(None).cast(right.schema[value].dataType))
    other = right.filter(F.col(key).isNotNull()).select(key, time, F.lit(0).alias(side), F.col(value).alias(own))
    order = [F.col(time).asc_nulls_first(), F.col(side).asc(), F.col(own).asc_nulls_last()]
    stacked = both.unionByName(other, allowMissingColumns=True)
    if all(df.limit(SMALL + 1).count() <= SMALL for df in (right, left)):
        whole = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = stacked.withColumn(carried, F.last(own, ignorenulls=True).over(whole)).filter(F.col(side) == 1)
        return out.select(*left.columns, F.col(carried).alias(value))
    stacked = stacked.repartitionByRange(F.col(key).asc_nulls_first(), *order)
    rows = stored(stacked.withColumn(part, F.spark_partition_id()), "asof")
    within = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(F.when(F.col(own).isNotNull(), F.col(own)), F.when(F.col(own).isNotNull(), F.struct(time, own)))
    spans = rows.filter(F.col(key).isNotNull()).groupBy(key, part).agg(last.alias(own))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(carried, F.last(own, ignorenulls=True).over(before)).filter(F.col(carried).isNotNull()).select(part, F.col(key).alias(own), carried)
    out = rows.withColumn(own, F.last(own, ignorenulls=True).over(within)).filter(F.col(side) == 1)
    spans = F.broadcast(spans.withColumnRenamed(part, side))  # one key at most goes on from a range to the next: a row for each range
    met = out.drop(side).join(spans.withColumnRenamed(own, going), (F.col(part) == F.col(side)) & (F.col(key) == F.col(going)), "left")
    return met.select(*left.columns, F.coalesce(own, carried).alias(value))


def _unused(taken: list[str], *names: str) -> list[str]:
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name in known:
            name += "_"
        out.append(name)
    return out


def band(left: DataFrame, right: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Pairs with |a - b| <= width: rows meet in buckets of that width, each right row in three of them; at width 0 by value."""
    if width < 0:
        return left.join(right, F.lit(False)).select(*left.columns, *right.columns)
    if not width:
        return left.join(right, F.col(a) == F.col(b)).select(*left.columns, *right.columns)
    own = left.withColumn("__bucket", F.floor(F.col(a) / width))
    near = right.withColumn("__bucket", F.explode(F.array(*(F.floor(F.col(b) / width) + k for k in (-1, 0, 1)))))
    return own.join(near, "__bucket").filter(F.abs(F.col(a) - F.col(b)) <= width).select(*left.columns, *right.columns)
