"""Connected components of an edge table by stars contracted in tasks and stepping pointers, every round a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Edges a task contracts at a time before the first round.
CHUNK = 400_000
#: Rows (two numbers each) of a table that may be broadcast.
MOST_BROADCAST = 500_000
SALTS = 32


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For vertices 0 to n - 1 and edges a-b: each one's smallest reachable vertex."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components: every vertex but the smallest of each with that one."""
    known, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(known), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(root != np.arange(len(known)))
    return known[own], known[root[own]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        v, p = stars(a, b)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(p, pa.int64())], ["v", "p"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield out()
    if held:
        yield out()


def spread_join(rows: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with a written table of one row for each key, of which any may hold a large part of rows.

    A small table is broadcast, once counted; beyond MOST_BROADCAST rows it is repeated for SALTS salts, so that
    one key's rows meet it in as many tasks.
    """
    if small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(small), on, how)
    salt, (left,) = "salt", [c for c in rows.columns if c != on][:1] or [on]
    while salt in {*rows.columns, *small.columns}:
        salt += "_"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(left), F.lit(SALTS)).cast("int"))
    return dealt.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """v, root: every vertex of edges (long columns a, b without nulls) with the smallest it can reach.

    Edges lead from a vertex to a smaller one. Each round, a vertex keeps its least parent, the other parents are
    tied to that one, and a parent that has a parent of its own is passed over; rounds end when neither is left.
    Rows are grouped by the child alone, of which a round has no more than contracted chunks, never by the parent,
    which may be that of a third of all vertices.
    """
    now = edges.select("a", "b")
    while True:
        now = now.toDF("v", "p").mapInArrow(_contracted, "v long, p long")
        least = written(now.groupBy("v").agg(F.min("p").alias("p"), F.collect_set("p").alias("all")), "least")
        over = least.filter(F.size("all") > 1)
        one = least.select("v", "p")
        movers = written(one.join(one.select(F.col("p").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("p"), F.col("p").alias("up")), "movers")
        if movers.isEmpty() and over.isEmpty():
            return one.withColumnRenamed("p", "root").unionByName(one.select(F.col("p").alias("v"), F.col("p").alias("root")).distinct())
        stepped = spread_join(one, movers, "p", "left").select("v", F.coalesce("up", "p").alias("p"))
        tied = over.select(F.explode("all").alias("v"), "p").filter("v <> p")
        now = written(stepped.unionByName(tied), "steps")
