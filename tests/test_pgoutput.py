"""Replication messages, written by hand, into a table."""

import struct

import pytest

from tidemark.streaming import cdc, pgoutput


def text(s):
    return s.encode() + b"\0"


def row(*values):
    return struct.pack(">h", len(values)) + b"".join(b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v)) + v.encode() for v in values)


BEGIN = lambda lsn: b"B" + struct.pack(">qqi", lsn, 0, 1)
COMMIT = b"C" + struct.pack(">bqqq", 0, 0, 0, 0)
RELATION = b"R" + struct.pack(">i", 7) + text("public") + text("t") + b"d" + struct.pack(">h", 2) + b"\1" + text("k") + struct.pack(">ii", 23, -1) + b"\0" + text("v") + struct.pack(">ii", 25, -1)
INSERT = lambda *v: b"I" + struct.pack(">i", 7) + b"N" + row(*v)
UPDATE = lambda *v, old=None: b"U" + struct.pack(">i", 7) + (b"K" + row(*old) if old else b"") + b"N" + row(*v)
DELETE = lambda *v: b"D" + struct.pack(">i", 7) + b"K" + row(*v)
TRUNCATE = b"T" + struct.pack(">ib", 1, 0) + struct.pack(">i", 7)


def test_decodes_all_messages():
    stream = [BEGIN(5), b"O" + struct.pack(">q", 1) + text("up"), b"Y" + struct.pack(">i", 99) + text("public") + text("mood"), RELATION, INSERT("1", "a"), UPDATE("1", None), UPDATE("2", "b", old=("1", None)), DELETE("2", None), b"M" + b"\0" * 10, TRUNCATE, COMMIT]
    d = pgoutput.Decoder()
    got = list(d.changes(stream))
    assert [(c.op, c.lsn, c.values, c.key) for c in got] == [("insert", 5, {"k": "1", "v": "a"}, {"k": "1"}), ("update", 5, {"k": "1", "v": None}, {"k": "1"}), ("update", 5, {"k": "2", "v": "b"}, {"k": "1"}), ("delete", 5, {}, {"k": "2"}), ("truncate", 5, {}, {})]
    assert d.relations[7].keys == ["k"] and d.origin == "up" and d.types == {99: "mood"}


def test_nothing_before_commit():
    assert list(pgoutput.Decoder().changes([BEGIN(1), RELATION, INSERT("1", "a")])) == []


def test_unsent_values_are_refused():
    changes = list(pgoutput.Decoder().changes([BEGIN(1), RELATION, UPDATE("1", ...), COMMIT]))
    with pytest.raises(ValueError, match="REPLICA IDENTITY"):
        pgoutput.change_rows(changes, "t", ["k", "v"])


def test_stream_into_a_table(spark):
    replica = cdc.Replica(spark.createDataFrame([("1", "old"), ("5", "stays")], "k string, v string"), ["k"])
    d = pgoutput.Decoder()
    for batch, stream in enumerate([[BEGIN(1), RELATION, UPDATE("1", "new"), INSERT("2", "b"), COMMIT], [BEGIN(2), UPDATE("3", "moved", old=("2", None)), DELETE("1", None), COMMIT]]):
        rows = pgoutput.change_rows(d.changes(stream), "t", ["k", "v"])
        replica.apply(spark.createDataFrame(rows, replica.change_schema()), batch)
    assert sorted(map(tuple, replica.table().collect())) == [("3", "moved"), ("5", "stays")]
