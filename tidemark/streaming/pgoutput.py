"""PostgreSQL's logical replication messages (pgoutput, protocol 1) as change rows.

A replication stream is ordered and describes its relations before it changes them, so one reader decodes it and
writes change rows; those are applied by `cdc.Replica`, batch by batch. The message layouts are those of the public
protocol documentation.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass
class Relation:
    schema: str
    name: str
    columns: list[str]
    keys: list[str]


@dataclass
class Change:
    """op is insert, update, delete or truncate; values are text or None; unchanged names columns whose stored value wasn't sent."""

    op: str
    lsn: int
    relation: str
    values: dict[str, str | None] = field(default_factory=dict)
    key: dict[str, str | None] = field(default_factory=dict)
    unchanged: list[str] = field(default_factory=list)


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def number(self, form: str) -> int:
        out = struct.unpack_from(">" + form, self.raw, self.at)[0]
        self.at += struct.calcsize(form)
        return out

    def text(self) -> str:
        end = self.raw.index(0, self.at)
        out = self.raw[self.at : end].decode()
        self.at = end + 1
        return out

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]


class Decoder:
    """Keeps the relations that the stream has described and the transaction that it is in."""

    def __init__(self):
        self.relations: dict[int, Relation] = {}
        self.lsn = 0
        self.origin: str | None = None
        self.types: dict[int, str] = {}

    def changes(self, messages: Iterable[bytes]) -> Iterator[Change]:
        """Changes in order, a transaction at a time: nothing of one comes before its commit."""
        held: list[Change] = []
        for raw in messages:
            kind, r = chr(raw[0]), Reader(raw[1:])
            if kind == "B":
                self.lsn = r.number("q")  # of the commit
                held = []
            elif kind == "C":
                yield from held
                held = []
            elif kind == "R":
                self.relation(r)
            elif kind == "O":
                r.number("q")
                self.origin = r.text()
            elif kind == "Y":
                oid = r.number("i")
                r.text()
                self.types[oid] = r.text()
            elif kind == "M":
                continue  # a message of an application
            elif kind == "T":
                n, _ = r.number("i"), r.number("b")
                held += [Change("truncate", self.lsn, self.relations[r.number("i")].name) for _ in range(n)]
            elif kind in "IUD":
                held.append(self.row(kind, r))
            else:
                raise ValueError(f"unknown message {kind!r}")

    def relation(self, r: Reader) -> None:
        oid, schema, name = r.number("i"), r.text(), r.text()
        r.number("b")  # replica identity
        columns, keys = [], []
        for _ in range(r.number("h")):
            flag, column = r.number("b"), r.text()
            r.number("i")
            r.number("i")
            columns.append(column)
            if flag & 1:
                keys.append(column)
        self.relations[oid] = Relation(schema, name, columns, keys)

    def row(self, kind: str, r: Reader) -> Change:
        own = self.relations[r.number("i")]
        out = Change({"I": "insert", "U": "update", "D": "delete"}[kind], self.lsn, own.name)
        while r.at < len(r.raw):
            part = chr(r.number("b"))
            values, unchanged = self.tuple(r, own)
            if part == "N":
                out.values, out.unchanged = values, unchanged
            else:  # K: the old key, O: the old row
                out.key = {k: values.get(k) for k in own.keys or own.columns}
        if not out.key:
            out.key = {k: out.values.get(k) for k in own.keys}
        return out

    @staticmethod
    def tuple(r: Reader, own: Relation) -> tuple[dict[str, str | None], list[str]]:
        values, unchanged = {}, []
        for k in range(r.number("h")):
            kind = chr(r.number("b"))
            if kind == "u":
                unchanged.append(own.columns[k])
            elif kind == "n":
                values[own.columns[k]] = None
            else:
                values[own.columns[k]] = r.bytes(r.number("i")).decode()
        return values, unchanged


def change_rows(changes: Iterable[Change], relation: str, columns: list[str]) -> list[tuple]:
    """(op, lsn, *columns) of one relation, as `cdc.Replica` takes them; an update that moves a key is a delete and an insert. Sequence numbers keep the order within a transaction."""
    out = []
    for i, c in enumerate(x for x in changes if x.relation == relation):
        if c.unchanged:
            raise ValueError(f"{relation}: values of {', '.join(c.unchanged)} were not sent; set REPLICA IDENTITY FULL")
        lsn = (c.lsn << 20) + 2 * i
        if c.op == "update" and any(c.key.get(k) != c.values.get(k) for k in c.key):
            out.append(("delete", lsn, *(c.key.get(x) for x in columns)))
            out.append(("insert", lsn + 1, *(c.values.get(x) for x in columns)))
        else:
            values = c.key if c.op == "delete" else c.values
            out.append((c.op, lsn, *(values.get(x) for x in columns)))
    return out
