"""Byte-level BPE over a rank file: overlapping chunks are pre-tokenised in parallel, stitched, then encoded.

A text of up to `chunk_chars` code points is one chunk. A longer one is cut into chunks that
overlap, the chunks are dealt to all tasks and pre-tokenised there, and each text's chunks are
stitched where both neighbours have a pre-token boundary at the same place: from a common
boundary on, both read the same characters and so agree. Where they have none, the text is read on from
the last certain boundary until it meets one of a chunk, so a text is read twice at most. The stitched pieces
are dealt out again in blocks of about `chunk_chars` code points, encoded there, and a text's ids are joined;
decoding concatenates the tokens' raw bytes.

Cases: null and empty texts have no tokens; repeated rows give repeated rows; very long texts and very long
unbroken runs take time in proportion to their length (a pre-token, however long, is encoded as one); ties between
pairs of one rank go to the leftmost; an empty table gives an empty result; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_batches, prepare, texts

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: The last pre-tokens of a cut chunk may have looked past its end; so many are not trusted.
MARGIN = 3
#: Bytes of a piece up to which all pairs are searched.
SHORT = 64
#: Pieces whose encoding a worker remembers, in each of two generations.
REMEMBERED = 200_000

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


class Encoder:
    """Ranks by token bytes, and the pattern that cuts pre-tokens."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {}
        for line in rank_file.split(b"\n"):
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.none = max(self.ranks.values(), default=0) + 1
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= SHORT:
            return self.merge_short(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # by a part's first byte

        def pair(i: int) -> tuple[int, int, int] | None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                return r, i, end[j]
            return None

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue  # one of its parts has grown or gone
            alive[j] = False
            end[i] = e
            if e < n:
                before[e] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_short(self, piece: bytes) -> list[int]:
        """merge() for pieces of which a list of all pairs' ranks is quick to search."""
        get, none = self.ranks.get, self.none
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def packed(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        if (out := self.memo.get(piece)) is None:
            if (out := self.older.get(piece)) is None:
                ids = self.merge(piece.encode())
                out = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.memo) >= REMEMBERED:  # what was used since the last time stays
                self.older, self.memo = self.memo, {}
            if len(piece) <= 64:
                self.memo[piece] = out
        return out

    def encode(self, pieces: list[str]) -> bytes:
        memo, packed = self.memo, self.packed
        return b"".join([memo.get(p) or packed(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def starts(self, text: str, at: int = 0) -> list[int]:
        """Where the pre-tokens of text begin, in places of the whole text if text begins at `at` there."""
        return [at + m.start() for m in self.pattern.finditer(text)]


def cut(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, str]]:
    """Chunks (place, text) that cover text; each but the first begins `overlap` before the end of the one before."""
    step, last = chunk - overlap, max(len(text) - overlap, 1)
    return [(s, text[s : s + chunk]) for s in range(0, last, step)]


def stitch(encoder: Encoder, chunks: list[tuple[int, str]], starts: list[list[int]]) -> tuple[str, list[int]]:
    """The whole text, and where its pre-tokens begin, from chunks in order and the places where each chunk's own begin."""
    ends = [at + len(part) for at, part in chunks]
    text = "".join([chunks[0][1], *(part[end - at :] for end, (at, part) in zip(ends, chunks[1:], strict=False))])
    true, k = list(starts[0]), 1
    while k < len(chunks):
        at, own = chunks[k][0], starts[k]
        del true[max(1, len(true) - MARGIN) :]
        places = {p: i for i, p in enumerate(own)}
        j = len(true) - 1
        while j > 0 and true[j] >= at and true[j] not in places:
            j -= 1
        if true[j] in places:  # from a common boundary on, this chunk's are right
            true[j:] = own[places[true[j]] :]
            k += 1
            continue
        last, trusted = len(chunks) - 1, places if k == len(chunks) - 1 else dict.fromkeys(own[:-MARGIN])
        for m in encoder.pattern.finditer(text, true.pop()):  # none: read on from the last boundary that is certain
            here = m.start()
            while k < last and here >= ends[k]:
                k += 1
                places = {p: i for i, p in enumerate(starts[k])}
                trusted = places if k == last else dict.fromkeys(starts[k][:-MARGIN])
            if here in trusted:
                true += starts[k][places[here] :]
                break
            true.append(here)
        else:
            break
        k += 1
    return text, true


def blocks(text: str, starts: list[int], size: int) -> list[tuple[str, list[int]]]:
    """The text from pre-token to pre-token in blocks of at least `size` code points (the last may be shorter), and the pieces' lengths."""
    out, first, edges = [], 0, [*starts, len(text)]
    for k in range(1, len(edges)):
        if edges[k] - edges[first] >= size or k == len(edges) - 1:
            out.append((text[edges[first] : edges[k]], [b - a for a, b in zip(edges[first:k], edges[first + 1 : k + 1], strict=True)]))
            first = k
    return out


_made: dict[object, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder for each rank file and worker."""
    key = (hash(shared.value), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(shared.value, pattern)
    return _made[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and decoded (raw bytes) for every row of docs.

    The rank file is read on the driver and broadcast; its size is a constant of the tokenizer.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    spark = docs.sparkSession
    prepare(spark)
    with open(rank_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    keys = ["doc_id", "text_hash"]

    def whole():
        own = _encoder(shared, pattern)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [own.encode(own.pattern.findall(t)) for t in texts(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

        return f

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cuts = cut(text, chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cuts), pa.int64()), pa.array([h] * len(cuts), pa.int64()), pa.array([a for a, _ in cuts], pa.int64()), pa.array([t for _, t in cuts], pa.string())], ["doc_id", "text_hash", "at", "chunk"])

    def pre_tokenised():
        own = _encoder(shared, pattern)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            starts = [np.array(own.starts(t, a), "<i8").tobytes() for a, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.binary())], ["doc_id", "text_hash", "at", "chunk", "starts"])

        return f

    def stitched(key: tuple, rows: pa.Table) -> pa.Table:
        own, places = _encoder(shared, pattern), rows.column("at").to_pylist()
        copies = places.count(0)  # rows alike meet in one group
        chunk, starts = rows.column("chunk"), rows.column("starts")
        order = sorted({at: i for i, at in enumerate(places)}.items())
        text, true = stitch(own, [(at, chunk[i].as_py()) for at, i in order], [np.frombuffer(starts[i].as_py(), "<i8").tolist() for _, i in order])
        cuts = blocks(text, true, chunk_chars)
        n = len(cuts)
        return pa.table({
            "doc_id": pa.array([key[0].as_py()] * n, pa.int64()), "text_hash": pa.array([key[1].as_py()] * n, pa.int64()), "copies": pa.array([copies] * n, pa.int64()), "at": pa.array(range(n), pa.int64()),
            "block": pa.array([t for t, _ in cuts], pa.string()), "sizes": pa.array([np.array(x, "<u4").tobytes() for _, x in cuts], pa.binary()),
        })

    def encoded():
        own = _encoder(shared, pattern)

        def ids_of(block: str, sizes: bytes) -> bytes:
            ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
            return own.encode([block[a:b] for a, b in zip([0, *ends], ends, strict=False)])

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [ids_of(t, x) for t, x in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["doc_id", "text_hash", "copies", "at", "ids"])

        return f

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        own, at, parts = _encoder(shared, pattern), rows.column("at").to_numpy(), rows.column("ids")
        ids, copies = b"".join([parts[int(i)].as_py() for i in np.argsort(at)]), rows.column("copies")[0].as_py()
        return pa.table({"doc_id": pa.array([key[0].as_py()] * copies, pa.int64()), "n_tokens": pa.array([len(ids) // 4] * copies, pa.int64()), "ids": pa.array([ids] * copies, pa.binary()), "decoded": pa.array([own.decode(ids)] * copies, pa.binary())})

    short = docs.filter(~long).mapInArrow(over_batches(whole), SCHEMA)
    cuts = docs.filter(long).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(split, "doc_id long, text_hash long, at long, chunk string")
    marked = cuts.repartition(F.col("doc_id"), F.col("at")).mapInArrow(over_batches(pre_tokenised), "doc_id long, text_hash long, at long, chunk string, starts binary")
    pieces = marked.groupBy(*keys).applyInArrow(stitched, "doc_id long, text_hash long, copies long, at long, block string, sizes binary")
    own = pieces.repartition(F.col("text_hash"), F.col("at")).mapInArrow(over_batches(encoded), "doc_id long, text_hash long, copies long, at long, ids binary")
    return short.unionByName(own.groupBy(*keys).applyInArrow(joined, SCHEMA))


def digests(encoded: DataFrame) -> DataFrame:
    """The query's columns from the operator's real output."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
