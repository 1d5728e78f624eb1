"""Media columns: bytes as 8-bit WAV samples, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload is the text's UTF-8 with zero bytes up to a positive multiple of 64, stored as mono
8-bit samples by the wave module and read back from the stored bytes. Fingerprints are read off
the samples: frames of 512 with a step of 256 under a Hann window; in each of three bands a frame's
strongest bin is a peak where it tops the band in the frames before and after; a peak is paired with
the peaks of its band in the next FAN frames. A pair is code = bin | bin | distance and time = frame
of its first peak, kept as two arrays of equal length in order of time.

Cases: null texts count as empty (64 zero bytes, no peaks); equal texts give equal values; of equal bins the lowest is the
peak, of equal frames the later; very long texts are stored whole and transformed in blocks of frames; repeated rows give
repeated rows; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_batches, prepare, texts

UNIT = 64
RATE = 8_000
FRAME, STEP = 512, 256
BANDS = ((2, 32), (32, 96), (96, 257))
FAN = 4
#: Frames transformed at a time, so that a very long text needs little memory.
BLOCK = 2_048

SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, codes array<int>, times array<int>"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and times of the peak pairs."""
    signal = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(signal) - FRAME) // STEP) + 1)
    hann = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)
    strength, where = np.empty((n, len(BANDS)), np.float32), np.empty((n, len(BANDS)), np.int32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = signal[a * STEP : (b - 1) * STEP + FRAME].astype(np.float32)
        part -= 128
        part = np.pad(part, (0, (b - 1 - a) * STEP + FRAME - len(part)))
        level = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::STEP] * hann))
        for k, (low, high) in enumerate(BANDS):
            where[a:b, k] = level[:, low:high].argmax(axis=1) + low
            strength[a:b, k] = level[:, low:high].max(axis=1)
    around = np.pad(strength, ((1, 1), (0, 0)))
    peak = (strength > 0) & (strength >= around[:-2]) & (strength > around[2:])
    found = []
    for k in range(len(BANDS)):
        for gap in range(1, min(FAN, n - 1) + 1):
            t = np.flatnonzero(peak[:-gap, k] & peak[gap:, k])
            found.append((t, where[t, k] << 13 | where[t + gap, k] << 4 | gap))
    times = np.concatenate([t for t, _ in found] or [np.empty(0, np.int64)])
    codes = np.concatenate([c for _, c in found] or [np.empty(0, np.int32)])
    order = np.lexsort((codes, times))
    return codes[order].astype(np.int32), times[order].astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the stored media, the payload read back from it, codes and times."""
    prepare(docs.sparkSession)

    def made():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, media, back, codes, times = [], [], [], [], []
            for text in texts(batch):
                size, payload = payload_of(text)
                media.append(to_wav(payload))
                back.append(from_wav(media[-1]))
                sizes.append(size)
                c, t = fingerprint(back[-1])
                codes.append(c)
                times.append(t)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), _lists(codes), _lists(times)], ["doc_id", "n_bytes", "media", "payload", "codes", "times"])

        return f

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(over_batches(made), SCHEMA)


def digests(stored: DataFrame) -> DataFrame:
    """The query's columns from the operator's real output."""
    pairs = F.concat_ws(",", F.col("codes").cast("array<string>"))
    times = F.concat_ws(",", F.col("times").cast("array<string>"))
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), F.sha2(F.concat_ws("|", pairs, times), 256)).alias("feature"),
    )
