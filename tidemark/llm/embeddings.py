"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Unit vectors are projected on fixed random directions. A pair collides in a projection if its values
differ by at most the window, centred on the query of the two. For a pair at the threshold the chance of
that is known, so the count that such a pair reaches but for one in 1 / MISSED is too: pairs with that count
or more are verified by cosine in double precision. Window, count and number of projections are chosen for
the cosine asked for, so that few other pairs reach the count.

The rows are sorted by a first projection, whose window is wider (all but 1 in 1,000,000 pairs at the
threshold fall into it), and cut into tiles of about TILE classes; a tile's queries meet the tiles that
their window reaches, each pair of tiles in one task. There every other projection of a tile is sorted. What
lies in a query's window is a run of that order, and as a set of rows the difference of two prefixes of it, kept as
bits for every STEP-th place (windows are rounded outwards to those). The sets of all projections are added up
by carry-save adders, 64 pairs a word, so counting takes a few bit operations for each pair and projection.
A tile is split evenly where many values are equal. Vectors equal in all components are one class
throughout. Work grows with the pairs inside the first window, a constant share of all pairs where
vectors have no direction in common.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths don't link; repeated rows are links of each other; ties do not
arise; a null id is never the smallest; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_batches, prepare, written
from tidemark.llm.components import components, roots

COSINE = 0.95
#: Numbers of projections to choose from, and the share of unrelated pairs that may reach the count.
PROJECTIONS = (16, 24, 32, 40, 48, 56)
CHANCE = 1e-3
#: Half-width of the first window, in standard deviations of a projection's difference for a pair at the threshold.
FIRST = 4.9
MISSED = 1e-6
TILE = 4_096
QUERIES = 128
STEP = 16


def directions(dim: int, seed: int = 3) -> np.ndarray:
    """(dim, 1 + PROJECTIONS[-1]) unit columns; the first sorts."""
    x = np.random.default_rng((seed, dim)).standard_normal((dim, 1 + PROJECTIONS[-1]))
    return x / np.linalg.norm(x, axis=0)


def spread(dim: int, cosine: float = COSINE) -> float:
    """Standard deviation of a projection's difference for unit vectors at the threshold."""
    return math.sqrt(2 * (1 - cosine) / dim)


def least_count(projections: int, window: float, missed: float = MISSED) -> int:
    """Collisions in windows of so many deviations that a pair at the threshold reaches but for a share of `missed`."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > missed:
            return k
    return projections


@lru_cache(64)
def calibrated(cosine: float = COSINE, missed: float = MISSED) -> tuple[int, float, int]:
    """(projections, half-width in deviations, least count): the fewest projections with which CHANCE of unrelated pairs or less reach the count, or the best of the most."""
    best = None
    for n in PROJECTIONS:
        for window in (k / 20 for k in range(30, 100)):
            least, q = least_count(n, window, missed), math.erf(window * math.sqrt((1 - cosine) / 2))
            chance = sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(least, n + 1))
            if best is None or (n, chance) < (best[1], best[0]) or n > best[1] and chance < best[0]:
                best = (chance, n, window, least)
        if best[0] <= CHANCE:
            break
    return best[1:]


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Windows:
    """The sorted projections of a tile, and for queries the rows inside their windows as bits."""

    def __init__(self, values: np.ndarray):
        n, k = values.shape
        self.bytes, marks = -(-n // 64) * 8, -(-n // STEP)
        self.sorted, self.prefix = [], []
        for column in values.T:
            order = np.argsort(column, kind="stable")
            self.sorted.append(column[order])
            order = np.concatenate([order, np.full(marks * STEP - n, -1)]).reshape(marks, STEP)
            bits, row = np.zeros((marks + 1, self.bytes), np.uint8), np.arange(1, marks + 1)
            for i in order.T:  # a row of bits has one of these at a time
                real = i >= 0
                bits[row[real], i[real] >> 3] |= (1 << (i[real] & 7)).astype(np.uint8)
            self.prefix.append(np.bitwise_xor.accumulate(bits.view(np.uint64), axis=0))

    def edges(self, queries: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(projections, queries): the marks before and after each query's window, centred on it."""
        low = [np.searchsorted(s, q - half, "left") // STEP for s, q in zip(self.sorted, queries.T, strict=True)]
        high = [-(-np.searchsorted(s, q + half, "right") // STEP) for s, q in zip(self.sorted, queries.T, strict=True)]
        return np.array(low), np.array(high)

    def reached(self, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
        """(queries, words) bits: the rows that are in `least` windows or more of a query."""

        def window(k: int) -> np.ndarray:
            out = self.prefix[k][high[k]]
            out ^= self.prefix[k][low[k]]
            return out

        def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Sum and carry of three bits."""
            u = a ^ b
            carry = a & b
            carry |= u & c
            u ^= c
            return u, carry

        shape = (low.shape[1], self.bytes // 8)
        start = 64 - least  # so that the count overflows six bits when it is reached
        planes = [np.full(shape, (1 << 64) - 1 if start >> k & 1 else 0, np.uint64) for k in range(6)]
        over = np.zeros(shape, np.uint64)
        for k in range(0, len(low), 8):  # numbers of projections are multiples of 8
            w = [window(k + j) for j in range(8)]
            ones, a = added(planes[0], w[0], w[1])
            ones, b = added(ones, w[2], w[3])
            twos, c = added(planes[1], a, b)
            ones, a = added(ones, w[4], w[5])
            planes[0], b = added(ones, w[6], w[7])
            planes[1], d = added(twos, a, b)
            planes[2], carry = added(planes[2], c, d)
            for j in range(3, 6):
                planes[j], carry = planes[j] ^ carry, planes[j] & carry
            over |= carry
        return over


def _vectors(table: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """vec_id, key and dim and vec (null for what links with nothing), first."""
    dtype = np.float32 if kind == "array<float>" else np.float64

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, dims, vec, first = [], [], [], []
            for x in batch.column(1):
                own = x.values.to_numpy(zero_copy_only=False) if x.is_valid and x.values.null_count == 0 else np.empty(0)
                own = np.ascontiguousarray(own, dtype) + dtype(0)  # one zero, without a sign
                if len(own) and np.isfinite(own).all() and own.any():
                    raw = own.tobytes()
                    key.append(int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64)))
                    dims.append(len(own))
                    vec.append(raw)
                    first.append(float(unit(own[None])[0] @ along(len(own))))
                else:
                    for out in (key, dims, vec, first):
                        out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array(dims, pa.int32()), pa.array(vec, pa.binary()), pa.array(first, pa.float64())], ["vec_id", "key", "dim", "vec", "first"])

    known: dict[int, np.ndarray] = {}

    def along(dim: int) -> np.ndarray:
        if dim not in known:
            known[dim] = directions(dim)[:, 0]
        return known[dim]

    out = "array<float>" if dtype is np.float32 else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(out).alias("vec"))
    return rows.mapInArrow(parsed, "vec_id long, key long, dim int, vec binary, first double")


def tiles(classes: DataFrame, n: int, window: float, tile: int = TILE) -> tuple[list[float], list[tuple[int, int, int, int]]]:
    """Inner bounds of the tiles by `first`; for each tile its first part, how many parts, the first part that reaches it and the last it reaches."""
    parts = -(-n // tile)
    bounds: list[float] = []
    if parts > 1:
        marks = [k / parts for k in range(1, parts)]
        bounds = sorted(set(classes.agg(F.percentile_approx("first", marks, 20 * parts).alias("m")).first()["m"]))
    at = F.lit(0)
    if bounds:
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("first")))
    seen = sorted((r["t"], r["n"], r["a"], r["b"]) for r in classes.groupBy(at.alias("t")).agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("first").alias("b")).collect())  # a row for each tile
    own, begin = {}, 0
    for t, count, a, b in seen:
        own[t] = (begin, -(-count // tile), a, b)
        begin += own[t][1]
    out = []
    for t in range(len(bounds) + 1):
        if t not in own:
            out.append((0, 1, 0, 0))
            continue
        start, k, a, b = own[t]
        out.append((start, k, min(s for s, _, _, y in own.values() if a - y <= window and s <= start), max(s + m - 1 for s, m, x, _ in own.values() if x - b <= window)))
    return bounds, out


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (unit, dim, right, key, weight, vec) in order of unit to (a, b, links): a's other vectors, and edges that tie."""
    projections, window, least = calibrated(cosine)

    def counted(rows: list[tuple]) -> pa.RecordBatch | None:
        side = np.array([r[2] for r in rows])
        order = np.argsort(side, kind="stable")
        rows, side = [rows[i] for i in order], side[order]
        dim, n = rows[0][1], len(rows)
        dtype = np.float32 if len(rows[0][5]) == 4 * dim else np.float64
        x = unit(np.frombuffer(b"".join(r[5] for r in rows), dtype).reshape(n, dim))
        key, weight = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
        values = x @ directions(dim)[:, 1 : 1 + projections]
        cut = int((side == 0).sum())
        left, right = ((0, cut), (cut, n)) if cut < n else ((0, n), (0, n))
        windows = Windows(values[right[0] : right[1]])
        low, high = windows.edges(values[left[0] : left[1]], window * spread(dim, cosine) + 1e-12)
        pairs = []
        for a in range(left[0], left[1], QUERIES):
            some = slice(a - left[0], min(left[1], a + QUERIES) - left[0])
            bits = windows.reached(low[:, some], high[:, some], least)
            has = np.flatnonzero(bits.any(axis=1))
            i, j = np.nonzero(np.unpackbits(bits[has].view(np.uint8), axis=1, bitorder="little"))
            i, j = has[i] + a, j + right[0]
            if left == right:
                later = j > i
                i, j = i[later], j[later]
            good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            pairs.append((i[good], j[good]))
        i, j = (np.concatenate([p[k] for p in pairs]) for k in range(2))
        if not len(i):
            return None
        links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
        root = roots(n, i, j)
        tied, has = np.flatnonzero(root != np.arange(n)), np.flatnonzero(links)
        a, b = np.concatenate([key[has], key[tied]]), np.concatenate([np.zeros(len(has), np.int64), key[root[tied]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(has)), pa.array(np.concatenate([links[has].astype(np.int64), np.zeros(len(tied), np.int64)]))], ["a", "b", "links"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                if (out := counted(held)) is not None:
                    yield out
                held = []
            held.append(row)
    if held and (out := counted(held)) is not None:
        yield out


def near_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    prepare(table.sparkSession)
    kind = dict(table.dtypes)[vector_col]
    rows = written(_vectors(table, id_col, vector_col, kind), "vectors")
    classes = written(rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"), F.any_value("first").alias("first")), "classes")
    met = None
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):  # a row for each length
        own = classes.filter(F.col("dim") == dim)
        bounds, parts = tiles(own, n, FIRST * spread(dim, cosine), tile)
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("first"))) if bounds else F.lit(0)
        shape = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), at + 1)
        own = own.withColumn("shape", shape).withColumn("part", F.col("shape")[0] + F.pmod(F.xxhash64("key"), F.col("shape")[1]).cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.col("shape")[2], F.col("shape")[3])))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        own = own.select(F.xxhash64(F.lit(dim), low, high).alias("unit"), "dim", (F.col("part") > F.col("other")).cast("int").alias("right"), "key", "weight", "vec")
        met = own if met is None else met.unionByName(own)
    if met is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(met.repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(lambda batches: _links(batches, cosine), "a long, b long, links long"), "links")
    degree = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    root = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("v", "key")
    flat = classes.select("key", "rep", "weight").join(root, "key", "left").join(degree, "key", "left")
    flat = written(flat.select("key", "rep", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
    least = flat.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(flat.join(least, "root").select("key", "n_links", "component_id"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
