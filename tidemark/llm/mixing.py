"""Mixing sources to target weights, by DataFrame functions alone.

Sources in order of code points, a null source last, weigh WEIGHTS in turn. They share `share` of all
words; no target exceeds MOST times its source, and what is over goes to the others by weight until
none is above. With r = cap / weight that is closed: with the sources in order of r, a source is at its
cap where caps so far + r * weights from it on <= total, and the others get the same amount a weight.
A document comes out floor(rate) times, and once more if a uniform number hashed from its id and the
seed is below the fraction; rate = target / source size <= MOST, so no document exceeds MOST times its size.

Cases: null text has no words and takes nothing; a null source is a source of its own; rows with equal
ids draw the same number; sources without a word have target 0; sources of equal ratio go by their place; very long
texts are counted whole; an empty table gives an empty result; other columns, whatever their names (those used
inside too), are carried by `mixed` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import unused, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Above so many sources (at most about 20 MB) their targets are joined by a shuffle, not broadcast, and summed in ranges.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII spaces."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In [0, 1), from the first 52 bits of the md5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str, few: bool) -> DataFrame:
    """df with, for each of sums, the sum over the rows up to and with this one in `order`, which must be total.

    A few rows (BROADCAST_SOURCES at most) are one window. Others are ranged by order and summed within ranges;
    only one row for each range meets in one task.
    """
    if few:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(c).over(whole) for k, c in sums.items()})
    ranged = written(df.withColumns(sums).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    ends = ranged.groupBy("_part").agg(*(F.sum(k).alias(f"_{k}") for k in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({k: F.sum(k).over(within) for k in sums}).join(F.broadcast(ends), "_part")  # a row for each partition
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_part", *(f"_{k}" for k in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows of source and size."""
    by = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    order = [F.col("source").isNull(), F.col("source")]
    by = running(by, order, {"place": F.lit(1).cast("long")}, "sources", few)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap").cast("double") / F.col("weight")
    by = running(by.withColumn("ratio", ratio), [F.col("ratio"), F.col("place")], {"caps": F.col("cap"), "weights": F.col("weight")}, "sources", few)
    whole = by.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("all_weights"))
    by = by.crossJoin(F.broadcast(whole))  # one row
    left = F.col("all_weights") - F.col("weights") + F.col("weight")
    total = F.col("all") * F.lit(float(share))
    by = by.withColumn("capped", F.col("caps") - F.col("cap") + F.col("ratio") * left <= total)
    rest = by.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("capped_words"), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)).alias("open_weights"))
    by = by.crossJoin(F.broadcast(rest))  # one row
    own = (total - F.col("capped_words")) / F.nullif(F.col("open_weights"), F.lit(0)) * F.col("weight")
    return by.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(own).alias("target"))


def with_copies(docs: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of docs with four columns more: size, source size, target and copies, by the names given, which docs must not have."""
    size, source_size, target, copies = names
    own, of_source = unused(docs, "__source", "__of")
    docs = docs.withColumns({own: F.col(f"`{source_col}`"), size: words(F.col(f"`{text_col}`"))})
    sizes = docs.select(F.col(own).alias("source"), F.col(size).alias("size"))
    of = written(targets(sizes), "targets").select(F.col("source").alias(of_source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    few = of.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = docs.join(F.broadcast(of) if few else of, F.col(own).eqNullSafe(F.col(of_source))).drop(own, of_source)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn(copies, (whole + F.when(uniform(F.col(f"`{id_col}`"), seed) < rate - whole, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    out = with_copies(own, ["size", "source_size", "target", "copies"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    names = unused(docs, "__size", "__source_size", "__target", "__copies")
    out = with_copies(docs, names, id_col, text_col, source_col)
    copies = F.col(names[3])
    return out.filter(copies > 0).withColumn(names[0], F.explode(F.sequence(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from {docs}),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight, row_number() over (order by source is null, source) as place from s),
r as (select *, 2 * source_size as cap, (2 * source_size)::double / weight as ratio from w),
c as (select *, sum(cap) over o as caps, sum(weight) over o as weights, sum(source_size) over () as whole, sum(weight) over () as all_weights from r window o as (order by ratio, place)),
k as (select *, (caps - cap)::double + ratio * (all_weights - weights + weight)::double <= whole::double * 1.5::double as capped from c),
t as (select source, source_size, case when capped then cap::double else (whole::double * 1.5::double - coalesce(sum(cap) filter (where capped) over (), 0)::double) / nullif(coalesce(sum(weight) filter (where not capped) over (), 0), 0)::double * weight::double end as target from k),
m as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0::double end as rate, ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from m
"""
