"""Line dedup: a sharded minimal perfect hash over the distinct line hashes indexes fingerprints and counts; documents probe it.

Rows are numbered, and 2 ** CHUNK_BITS of them are a chunk. Lines are hashed to 128 bits; a chunk hands on each of its
distinct hashes once, with the number of its rows that hold it, to the shard of the hash, and keeps where
they stand. A shard is one task's work: it builds the minimal perfect hash of its distinct hashes (levels of bits
in which a key that has a place of its own settles), with a 64-bit fingerprint and a count at each key's index,
and answers the chunks there: a hash is frequent where the fingerprint at its index agrees and the count is high
enough. The answers meet what the chunks kept, which gives the lines that each row loses; rows that lose none
are copied. Texts pass Python once, to be hashed. The way is the same at every size; what rows lose is broadcast
up to MOST_BROADCAST lines, once counted, and hashed to the rows' partitions beyond.

A line found in a third of all documents makes one row for each chunk in its shard, so 2 ** CHUNK_BITS times fewer
than documents. A task holds one shard's rows, about SHARD_ROWS, or COUNTED lines of a chunk.

Cases: null or empty text is one empty line, which is never dropped; a line twice in a document counts
once; repeated rows count as documents of their own; ties do not arise; very long texts are split and joined
whole; an empty table gives an empty result; other columns, whatever their names (those used inside too), are
carried by `probe` and `without_repeated_lines`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, unused, written

MIN_DOCS = 10
#: Rows of a chunk: 2 ** CHUNK_BITS.
CHUNK_BITS = 13
#: Rows (chunk and hash) of a shard, about.
SHARD_ROWS = 200_000
#: Lines that a task counts before it hands them on.
COUNTED = 200_000
#: Lost lines (4 bytes each, and about 40 for a row that has some), up to which they are broadcast.
MOST_BROADCAST = 500_000
_STRIP = b" \t\n\x0b\x0c\r"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys(text: str) -> list[bytes]:
    """Each line's key: stripped of ASCII spaces, A-Z in lower case, as UTF-8."""
    return [line.strip(_STRIP).lower() for line in text.encode().split(b"\n")]


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (np.uint64(level + 1) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level a key with a place of its own settles."""

    #: Bits of a block whose rank is stored.
    BLOCK = 512

    def __init__(self, keys: np.ndarray):
        self.levels, self.widths, self.ranks, self.size = [], [], [], 0
        left = keys
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
            width = 2 * len(left)
            at = (_spread(left, len(self.levels)) % np.uint64(width)).astype(np.int64)
            taken = np.bincount(at, minlength=width)
            bits = np.zeros(-(-width // self.BLOCK) * self.BLOCK, np.uint8)
            bits[:width] = taken == 1
            each = bits.reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64)
            self.levels.append(np.packbits(bits))
            self.widths.append(width)
            self.ranks.append(np.cumsum(each) - each + self.size)
            self.size += int(each.sum())
            left = left[taken[at] > 1]

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys that are not in the set, any index for the others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (packed, width, ranks) in enumerate(zip(self.levels, self.widths, self.ranks, strict=True)):
            at = (_spread(keys[left], level) % np.uint64(width)).astype(np.int64)
            hit = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[left[hit]] = ranks[at[hit] // self.BLOCK] + self._before(packed, at[hit])
            left = left[~hit]
        return out

    def _before(self, packed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of each one's block in front of it."""
        step, out = self.BLOCK // 8, np.empty(len(at), np.int64)
        for a in range(0, len(at), 65_536):
            some = at[a : a + 65_536]
            block = _ONES[packed.reshape(-1, step)[some // self.BLOCK]].cumsum(axis=1, dtype=np.int64)
            byte = (some % self.BLOCK) >> 3
            row = np.arange(len(some))
            inside = _ONES[packed[some >> 3] >> (8 - (some & 7)).astype(np.uint8)]
            out[a : a + 65_536] = np.where(byte > 0, block[row, byte - 1], 0) + np.where(some & 7 > 0, inside, 0)
        return out


_ONES = np.array([k.bit_count() for k in range(256)], np.uint8)


class Shard:
    """A perfect hash of distinct (place, print) keys, with the fingerprint and the count of the key at each index."""

    def __init__(self, place: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        mixed = place ^ _spread(prints, 99)
        self.hash = PerfectHash(mixed)
        at = self.hash.index(mixed)
        self.prints, self.counts = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
        self.prints[at], self.counts[at] = prints, np.minimum(counts, 2**32 - 1)

    def count(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each line, 0 where it is not in the shard."""
        if not self.hash.size:
            return np.zeros(len(place), np.uint32)
        at = self.hash.index(place ^ _spread(prints, 99))
        return np.where((at >= 0) & (self.prints[at] == prints), self.counts[at], 0)


def _count_chunks(bits: int):
    """Rows (number, text) to (chunk, place, print, n, at): a chunk's distinct non-empty keys, how many of its rows hold each, and where: the row in the chunk and the line."""

    def counted(chunk: int, digests: list[bytes], rows: list[int], lines: list[int]) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.int64)
        order = np.lexsort((both[:, 1], both[:, 0]))  # stable: a key's places stay in order
        both, at = both[order], ((np.array(rows, np.int64) << 32) | np.array(lines, np.int64))[order]
        other = np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])
        first = np.flatnonzero(other)
        n = np.add.reduceat((other | np.concatenate([[True], at[1:] >> 32 != at[:-1] >> 32])).astype(np.int64), first)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), chunk)), pa.array(both[first, 0]), pa.array(both[first, 1]), pa.array(n), places], ["chunk", "place", "print", "n", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, rows, lines = None, [], [], []
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digests and (number >> bits != now or len(digests) >= COUNTED):
                    yield counted(now, digests, rows, lines)
                    digests, rows, lines = [], [], []
                now = number >> bits
                if text:
                    own = [(k, xxhash.xxh3_128_digest(key)) for k, key in enumerate(keys(text)) if key]
                    digests += [d for _, d in own]
                    lines += [k for k, _ in own]
                    rows += [number & (1 << bits) - 1] * len(own)
        if digests:
            yield counted(now, digests, rows, lines)

    return run


def _answers(min_docs: int):
    """Rows (shard, chunk, place, print, n) in order of shard to the (chunk, place, print) of frequent lines."""

    def answered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        chunk, n = rows.column("chunk").to_numpy(), rows.column("n").to_numpy()
        place, prints = (rows.column(c).to_numpy().view(np.uint64) for c in ("place", "print"))
        order = np.lexsort((prints, place))
        p, q = place[order], prints[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
        index = Shard(p[first], q[first], np.add.reduceat(n[order], first))
        often = index.count(place, prints) >= min_docs
        return pa.RecordBatch.from_arrays([pa.array(chunk[often]), pa.array(place[often].view(np.int64)), pa.array(prints[often].view(np.int64))], ["chunk", "place", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and shard[a] != now:
                        yield answered(held)
                        held = []
                    now = shard[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield answered(held)

    return run


def lost(numbered: DataFrame, min_docs: int = MIN_DOCS, bits: int = CHUNK_BITS) -> DataFrame:
    """number and lines (from 0, in any order) of every row that loses some, from rows of number and text."""
    seen = written(numbered.mapInArrow(_count_chunks(bits), "chunk long, place long, print long, n long, at array<long>"), "line_hashes")
    shards = max(1, math.ceil(seen.count() / SHARD_ROWS))
    dealt = seen.select(F.pmod("place", F.lit(shards)).alias("shard"), "chunk", "place", "print", "n")
    often = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answers(min_docs), "chunk long, place long, print long")
    places = seen.join(written(often, "frequent"), ["chunk", "place", "print"], "left_semi").select("chunk", F.explode("at").alias("at"))
    number = F.shiftleft("chunk", bits) + F.shiftright("at", 32)
    return places.groupBy(number.alias("number")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("lines"))


def probe(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, list[str]]:
    """The rows of docs, with three columns more, and the names of these: the text without repeated lines, its number of lines before, and of those dropped."""
    prepare(docs.sparkSession)
    number, lines, *names = unused(docs, "__number", "__lines", "__kept", "__n_lines", "__n_dropped")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    gone = written(lost(rows.select(F.col(number).alias("number"), text.alias("text")), min_docs, CHUNK_BITS), "lost").toDF(number, lines)
    few = (gone.agg(F.sum(F.size(lines))).first()[0] or 0) <= MOST_BROADCAST
    out = rows.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), number, "left")
    without = lambda each: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col(lines)), lambda k: F.element_at(each, k + 1)), "\n")
    kept = F.when(F.col(lines).isNull(), text).otherwise(F.element_at(F.transform(F.array(F.split(text, "\n", -1)), without), 1))  # split once
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), kept.alias(names[0]), n_lines.cast("long").alias(names[1]), n_dropped.cast("long").alias(names[2])), names


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of every row."""
    out, (kept, n_lines, n_dropped) = probe(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "text", min_docs)
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.col(kept).alias("kept"))


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs with text that has lost its repeated lines, and n_chars to match where docs has that column."""
    out, (kept, *_) = probe(docs, text_col, min_docs)
    return out.select(*(F.col(kept).alias(c) if c == text_col else F.length(kept).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from {docs}),
l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from (
select r, doc_id, count(*) as n_lines, count(f.key) as n_dropped, string_agg(line, chr(10) order by i) filter (where f.key is null) as kept from k left join f using (key) group by r, doc_id)
"""
