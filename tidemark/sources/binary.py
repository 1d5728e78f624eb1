"""COPY in binary format: a folder of files, each with its own header and trailer, written and read by tasks."""

from __future__ import annotations

import datetime
import decimal
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"PGCOPY\n\xff\r\n\0"
_DAY = datetime.date(2000, 1, 1)
_TIME = datetime.datetime(2000, 1, 1)
_UTC = _TIME.replace(tzinfo=datetime.UTC)


def _micros(d: datetime.timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _numeric(x: decimal.Decimal) -> bytes:
    """Base-10,000 digits, the weight of the first, the sign and the number of decimals shown."""
    sign, digits, exponent = x.as_tuple()
    scale = max(0, -exponent)
    whole = int("".join(map(str, digits)) or "0") * 10 ** max(0, exponent)
    whole *= 10 ** (-scale % 4)
    groups = []
    while whole:
        whole, g = divmod(whole, 10_000)
        groups.insert(0, g)
    weight = len(groups) - 1 - -(-scale // 4)
    while groups and not groups[-1]:
        groups.pop()
    return struct.pack(f"!hhHh{len(groups)}h", len(groups), weight if groups else 0, 0x4000 * sign, scale, *groups)


def _from_numeric(raw: bytes) -> decimal.Decimal:
    n, weight, sign, scale = struct.unpack_from("!hhHh", raw)
    out = decimal.Decimal(0)
    with decimal.localcontext(prec=60):
        for k, g in enumerate(struct.unpack_from(f"!{n}h", raw, 8)):
            out += decimal.Decimal(g).scaleb(4 * (weight - k))
        return (-out if sign else out).quantize(decimal.Decimal(1).scaleb(-scale))


def _codec(kind: T.DataType) -> tuple[Callable[[object], bytes], Callable[[bytes], object]]:
    plain = {T.ShortType: "!h", T.IntegerType: "!i", T.LongType: "!q", T.FloatType: "!f", T.DoubleType: "!d"}
    if type(kind) in plain:
        form = struct.Struct(plain[type(kind)])
        return form.pack, lambda raw: form.unpack(raw)[0]
    if isinstance(kind, T.BooleanType):
        return lambda x: b"\1" if x else b"\0", lambda raw: raw == b"\1"
    if isinstance(kind, T.DecimalType):
        return _numeric, _from_numeric
    if isinstance(kind, T.DateType):
        return lambda x: struct.pack("!i", (x - _DAY).days), lambda raw: _DAY + datetime.timedelta(days=struct.unpack("!i", raw)[0])
    if isinstance(kind, T.TimestampNTZType):
        return lambda x: struct.pack("!q", _micros(x - _TIME)), lambda raw: _TIME + datetime.timedelta(microseconds=struct.unpack("!q", raw)[0])
    if isinstance(kind, T.TimestampType):
        return lambda x: struct.pack("!q", _micros(x - _UTC)), lambda raw: _UTC + datetime.timedelta(microseconds=struct.unpack("!q", raw)[0])
    if isinstance(kind, T.BinaryType):
        return bytes, bytes
    if isinstance(kind, T.StringType):
        return lambda x: x.encode(), lambda raw: raw.decode()
    raise ValueError(f"COPY in binary format does not take {kind.simpleString()}; cast it to text")


def encoded(rows: Iterator[tuple], kinds: list[T.DataType]) -> Iterator[bytes]:
    """A file's bytes, in pieces."""
    yield SIGNATURE + struct.pack("!ii", 0, 0)
    to = [_codec(k)[0] for k in kinds]
    count = struct.pack("!h", len(kinds))
    for row in rows:
        out = [count]
        for f, x in zip(to, row, strict=True):
            raw = None if x is None else f(x)
            out.append(struct.pack("!i", -1) if raw is None else struct.pack("!i", len(raw)) + raw)
        yield b"".join(out)
    yield struct.pack("!h", -1)


def decoded(raw: bytes, kinds: list[T.DataType]) -> Iterator[tuple]:
    if raw[:11] != SIGNATURE:
        raise ValueError("not a file of COPY in binary format")
    of = [_codec(k)[1] for k in kinds]
    at = 19 + struct.unpack_from("!i", raw, 15)[0]
    while (n := struct.unpack_from("!h", raw, at)[0]) != -1:
        if n != len(kinds):
            raise ValueError(f"a row has {n} fields, {len(kinds)} are expected")
        at, row = at + 2, []
        for f in of:
            size = struct.unpack_from("!i", raw, at)[0]
            at += 4
            row.append(None if size < 0 else f(raw[at : at + size]))
            at += max(size, 0)
        yield tuple(row)


def copy_to(df: DataFrame, path: str) -> None:
    """A file for each partition. A task writes under a name of its attempt and renames at the end, so a repeated task replaces its file."""
    kinds = [f.dataType for f in df.schema]
    for k in kinds:
        _codec(k)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        store.create_dir(folder, recursive=True)
        name, n = f"{folder}/part-{context.partitionId():05d}.bin", 0
        own = f"{folder}/_{context.taskAttemptId()}.tmp"

        def rows():
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        with store.open_output_stream(own) as out:
            for piece in encoded(rows(), kinds):
                out.write(piece)
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.mapInArrow(write, "n long").agg(F.sum("n")).first()


def copy_from(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    schema = T.StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in columns.items()))
    kinds = [f.dataType for f in schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for raw in batch.column(0):
                held = []
                for row in decoded(raw.as_py(), kinds):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*").load(path).select("content").mapInArrow(read, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
