"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens, small buckets compared, runs repeated.

A text's set holds the hashes of its runs of SHINGLE words (lower case, cut at white space; a shorter text
with a word is one run). Equal sets form one class, whatever their number. Each class is embedded into
COORDINATES minhashes, whose agreement estimates the Jaccard similarity. Each run begins a path at a
sampled coordinate: a class goes into the bucket of the coordinate's value. A bucket of more than SMALL
classes is split again on a coordinate chosen by its own path, LEVELS times at most. One that keeps ALIKE of
the classes it was split from holds classes that are much alike, so it is not split further and counts as one;
so does what is left after the last level. In small buckets all pairs are compared by their embeddings, and those that agree in
LEAST_ALIKE of the coordinates or more become candidates (at the threshold that keeps all but 1 in 10,000).
Runs repeat until a pair at the threshold meets with probability RECALL, even if all its buckets split to the end.

Candidates only tie classes into groups. Within a group the whole sets are compared exactly: groups of up
to BLOCK classes in one task, larger ones (and those of long texts) as blocks against blocks, so no task holds more
than two blocks.
Only verified pairs count as links and tie components.

Cases: null, empty and blank texts have empty sets and link with nothing; repeated rows and equal texts are
links of each other; ties do not arise (class_id is the smallest doc_id, null where a component has none; null ids
link as others do); very long texts are hashed whole;
an empty table gives an empty result; other columns, whatever their names (those used inside too), are carried by `one_of_each`.
Sets are told apart by 64-bit hashes: two of N unequal sets fall together with a chance below N * N / 2 ** 65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import over_batches, prepare, texts, unused, written
from tidemark.llm.components import components, roots, spread_join

SHINGLE = 5
THRESHOLD = (4, 5)
COORDINATES = 64
LEAST_ALIKE = 38
LEVELS = 3
ALIKE = (7, 10)
RECALL = 0.999
SMALL = 256
BLOCK = 128
#: Hashes of a block's sets together, about (8 bytes each): of long texts a block holds fewer.
BLOCK_HASHES = 1 << 20
#: Sets that a task compares, about, while there are shuffle partitions enough.
TASK_SETS = 512
#: Rows of a table that may be broadcast: paths, or members of groups (16 bytes each).
MOST_BROADCAST = 500_000

_R = np.random.default_rng(20)
_BYTE = _R.integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_ODD = _R.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of SHINGLE words."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    n = max(1, len(begin) - SHINGLE + 1)
    a, b = begin[:n], end[-n:]
    return np.unique(_mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))


def embedded(own: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minhashes of a set that is not empty."""
    out = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for a in range(0, len(own), 2_048):
        np.minimum(out, (own[a : a + 2_048, None] * _ODD).min(axis=0), out=out)
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float = RECALL) -> int:
    """Runs until a pair at the threshold meets with this probability even if all its buckets are split to the end."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (THRESHOLD[0] / THRESHOLD[1]) ** LEVELS))


def _first_coordinates() -> np.ndarray:
    return np.random.default_rng(7).permutation(COORDINATES)[: runs_for()]


def paths_of(minhashes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return _mixed(minhashes[chosen].astype(np.uint64) | np.arange(1, len(chosen) + 1, dtype=np.uint64) << np.uint64(32)).view(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (null for an empty set), size, alike (the minhashes' low bytes), paths."""

    def made():
        chosen = _first_coordinates()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, size, alike, paths = [], [], [], []
            for text in texts(batch):
                own = shingles(text)
                size.append(len(own))
                if len(own):
                    m = embedded(own)
                    key.append(key_of(own))
                    alike.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                    paths.append(paths_of(m, chosen).tolist())
                else:
                    key.append(None)
                    alike.append(None)
                    paths.append(None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(alike, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "key", "size", "alike", "paths"])

        return f

    return docs.mapInArrow(over_batches(made), "doc_id long, key long, size long, alike binary, paths array<long>")


def key_of(own: np.ndarray) -> int:
    """One number for a sorted set."""
    _, down = _power(len(own) + 1)
    with np.errstate(over="ignore"):
        return int(_mixed(np.array([(_mixed(own) * down[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0].view(np.int64))


def _compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, alike) in order of path to edges between keys: a star for each tied group of a bucket."""

    def edges(path: np.ndarray, key: np.ndarray, alike: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.flatnonzero(np.diff(path)) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(path)]])
        size, a, b = end - begin, [], []
        two = begin[size == 2]
        good = two[(alike[two] == alike[two + 1]).sum(axis=1) >= LEAST_ALIKE]
        a.append(key[good])
        b.append(key[good + 1])
        for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            own = alike[s:e]
            x, y = np.nonzero(np.stack([(own == row).sum(axis=1) for row in own]) >= LEAST_ALIKE)
            root = roots(e - s, x, y)
            tied = np.flatnonzero(root != np.arange(e - s))
            a.append(key[s:e][tied])
            b.append(key[s:e][root[tied]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, COORDINATES), np.uint8))
    for batch in batches:
        alike = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        path, key, alike = (np.concatenate(x) for x in zip(held, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), alike), strict=True))
        last = int(np.searchsorted(path, path[-1])) if len(path) else 0  # the last bucket may go on
        if last and (out := edges(path[:last], key[:last], alike[:last])):
            yield out
        held = (path[last:], key[last:], alike[last:])
    if len(held[0]) and (out := edges(*held)):
        yield out


def _small_enough(df: DataFrame) -> bool:
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def candidates(classes: DataFrame) -> DataFrame:
    """Edges a, b that tie keys (and what is left of buckets after the last level) into groups."""
    rows = classes.select(F.explode("paths").alias("path"), "key", "alike", F.lit(0).cast("long").alias("from"))
    out = None
    for level in range(LEVELS):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.any_value("from").alias("from")).filter(F.col("n") > SMALL)
        alike = (F.col("from") > 0) & (F.col("n") * ALIKE[1] >= F.col("from") * ALIKE[0])
        large = written(sizes.select("path", "n", (alike | F.lit(level + 1 == LEVELS)).alias("whole")), "paths")
        some = large.limit(1).count() > 0
        one = F.broadcast(large) if _small_enough(large) else large
        small = rows.join(one, "path", "left_anti") if some else rows
        tied = small.select("path", "key", "alike").repartition("path").sortWithinPartitions("path").mapInArrow(_compare_buckets, "a long, b long")
        out = tied if out is None else out.unionByName(tied)
        if not some:
            break
        left = written(rows.drop("from").join(one, "path"), "left")  # of large buckets only; each level reads the one before once
        out = out.unionByName(left.filter("whole").select(F.col("key").alias("a"), F.col("path").alias("b")))
        place = F.pmod(F.xxhash64("path"), F.lit(COORDINATES)).cast("int")
        child = F.xxhash64("path", place, F.substring("alike", place + 1, F.lit(1)))
        rows = left.filter("not whole").select(child.alias("path"), "key", "alike", F.col("n").alias("from"))
    return out


def _links(own: list[np.ndarray], side: np.ndarray, cross: bool) -> np.ndarray:
    """(n, n) boolean: which sets reach the threshold; of two sides only pairs across."""
    n, size = len(own), np.array([len(x) for x in own])
    flat, owner = np.concatenate(own), np.repeat(np.arange(n), size)
    known, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place, keep = np.cumsum(shared) - 1, shared[at]
    column, row = place[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    width = max(256, (1 << 22) // max(1, n))
    for a in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [a, a + width])
        m = np.zeros((n, width), np.float32)
        m[row[low:high], column[low:high] - a] = 1
        common += m @ m.T
    num, den = THRESHOLD
    good = den * common >= num * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(good, False)
    return good & (side[:, None] != side[None, :]) if cross else good


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, cross, side, key, weight, own) in order of unit to (a, b, links): a's other documents, and edges that tie."""

    def verified(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        key, weight = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        good = _links([np.frombuffer(r[5], np.uint64) for r in rows], np.array([r[2] for r in rows]), rows[0][1])
        links = good.astype(np.int64) @ weight
        x, y = np.nonzero(good)
        root = roots(len(rows), x, y)
        tied = np.flatnonzero(root != np.arange(len(rows)))
        has = np.flatnonzero(links)
        a, b = np.concatenate([key[has], key[tied]]), np.concatenate([np.zeros(len(has), np.int64), key[root[tied]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(has)), pa.array(np.concatenate([links[has], np.zeros(len(tied), np.int64)]))], ["a", "b", "links"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                if (out := verified(held)) is not None:
                    yield out
                held = []
            if not held or held[-1][3] != row[3]:  # repeated rows bring their class again
                held.append(row)
    if held and (out := verified(held)) is not None:
        yield out


def _keyed_sets():
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t) for t in texts(batch, 0)]
        return pa.RecordBatch.from_arrays([pa.array([key_of(x) if len(x) else None for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["key", "own"])

    return f


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id and key of every row; key, rep, weight, n_links, class_id, root of every non-empty set)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(_sets(docs), "sets")
    classes = written(sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.any_value("size").alias("size"), F.any_value("alike").alias("alike"), F.any_value("paths").alias("paths")), "classes")
    tied = written(candidates(classes), "tied")  # so that no task runs two Python steps at once
    group = components(tied).withColumnRenamed("v", "key").withColumnRenamed("root", "group")
    group = written(classes.select("key", "rep", "weight", "size").join(group, "key"), "groups")  # without the nodes of paths
    sizes = written(group.groupBy("group").agg(F.count("*").alias("count"), F.sum("size").alias("hashes")).filter("count > 1"), "sizes")
    few = _small_enough(group)
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.least(F.ceil(F.col("hashes") / BLOCK_HASHES), F.col("count"))).cast("int")
    member = spread_join(group.drop("size"), sizes, "group").withColumn("blocks", blocks).drop("count", "hashes")
    member = written(member, "members")
    found = docs.join(F.broadcast(member) if few else member, docs["doc_id"] == member["rep"])

    def own_sets():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [shingles(t) for t in texts(batch)]
            right = pa.array([len(x) > 0 and key_of(x) == k for x, k in zip(own, batch.column(2).to_pylist(), strict=True)])  # another row may have the same id
            rows = pa.RecordBatch.from_arrays([batch.column(i) for i in range(2, 6)] + [pa.array([x.tobytes() for x in own], pa.binary())], ["key", "weight", "group", "blocks", "own"])
            return rows.filter(right)

        return f

    own = found.select("doc_id", "text", "key", "weight", "group", "blocks").mapInArrow(over_batches(own_sets), "key long, weight long, group long, blocks int, own binary")
    nameless = member.filter("rep is null").drop("rep")  # classes without an id: met by key, one text of each
    if nameless.limit(1).count():
        sets_of = docs.filter("doc_id is null").select("text").mapInArrow(over_batches(_keyed_sets), "key long, own binary").filter("key is not null").dropDuplicates(["key"])
        own = own.unionByName(sets_of.join(F.broadcast(nameless) if few else nameless, "key"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    own = own.withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    # a large group's units are numbered, so that they are dealt evenly and not by chance
    total = member.agg(F.sum("blocks")).first()[0] or 0
    tasks = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SETS)))
    task = F.pmod(F.pmod(F.xxhash64("group"), F.lit(tasks)) + low * F.col("blocks") + high, F.lit(tasks)).cast("int")
    rows = own.select(task.alias("task"), F.xxhash64("group", low, high).alias("unit"), (low != high).alias("cross"), "side", "key", "weight", "own")
    rows = rows.repartitionById(tasks, "task").drop("task").sortWithinPartitions("unit", "key")
    checked = written(rows.mapInArrow(_verify, "a long, b long, links long"), "links")
    degree = checked.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    root = components(checked.filter("b is not null").select("a", "b")).withColumnRenamed("v", "key")
    flat = classes.select("key", "rep", "weight").join(root, "key", "left").join(degree, "key", "left")
    flat = written(flat.select("key", "rep", "weight", "root", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
    alone = flat.filter("root is null").select("key", "rep", "weight", "n_links", F.col("rep").alias("class_id"), F.col("key").alias("root"))
    tied = flat.filter("root is not null")
    least = written(tied.groupBy("root").agg(F.min("rep").alias("class_id")), "least")
    tied = spread_join(tied, least, "root").select("key", "rep", "weight", "n_links", "class_id", "root")
    return sets.select("doc_id", "key"), alone.unionByName(tied)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the component), n_links (other rows at the threshold or above) of every row."""
    rows, classes = classes_of(docs, id_col, text_col)
    out = rows.join(classes.select("key", "class_id", "n_links"), "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows that link, directly or not, the one of smallest id (null last; of several the least by all columns); rows that link with none stay."""
    rows, classes = classes_of(docs, id_col, text_col)
    own = written(rows.join(classes.select("key", "class_id"), "key", "left").select("doc_id", "class_id"), "classes")
    key = F.col(id_col).cast("long")
    id_ = unused(docs, "__id")[0]
    many = own.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias(id_))
    many = written(many, "repeated")
    gone = own.filter("doc_id <> class_id").select(F.col("doc_id").alias(id_))
    out = docs.join(F.broadcast(gone) if _small_enough(gone) else gone, key == F.col(id_), "left_anti")
    if not many.limit(1).count():
        return out
    # an id of several rows, or none, says nothing about a row: those are decided by their sets
    few = F.broadcast(many) if _small_enough(many) else many
    alone = out.filter(key.isNotNull()).join(few, key == F.col(id_), "left_anti")
    some = docs.join(few, key == F.col(id_), "left_semi").unionByName(docs.filter(key.isNull()))
    names = [f"`{c}`" for c in docs.columns]
    some = some.select(F.struct(*names).alias("__row"), key.alias("__id"), F.col(text_col).cast("string").alias("__text"))
    some = written(some.mapInArrow(over_batches(_with_key), T.StructType([*some.schema.fields[:2], T.StructField("__key", T.LongType())])), "some")
    one = some.filter("__key is not null").groupBy("__id", "__key").agg(F.min("__row").alias("__row"))
    one = one.join(classes.select(F.col("key").alias("__key"), "class_id", "root"), "__key").filter(F.col("__id").eqNullSafe(F.col("class_id")))
    one = one.groupBy("root").agg(F.min("__row").alias("__row")).select("__row").unionByName(some.filter("__key is null").select("__row"))
    return alone.unionByName(one.select(*(F.col("__row")[c].alias(c) for c in docs.columns)))


def _with_key():
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t) for t in texts(batch, 2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([key_of(x) if len(x) else None for x in own], pa.int64())], ["__row", "__id", "__key"])

    return f


#: Words are cut where str.split() cuts.
ORACLE = r"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') as w from {docs}),
s as (select distinct r, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as g from d where len(w) > 0),
n as (select r, count(*) as n from s group by r),
c as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by a.r, b.r),
p as (select a, b from c join n x on x.r = a join n y on y.r = b where 5 * c >= 4 * (x.n + y.n - c)),
e as (select a, b from p union all select b, a from p),
reached(a, b) as (select a, b from e union select reached.a, e.b from reached join e on reached.b = e.a),
m as (select a, min(o.doc_id) as least from reached join d o on o.r = reached.b group by a),
k as (select a, count(*) as n from e group by a)
select d.doc_id, case when m.least is null then d.doc_id when d.doc_id is null then m.least else least(d.doc_id, m.least) end as class_id, coalesce(k.n, 0) as n_links from d left join m on m.a = d.r left join k on k.a = d.r
"""
