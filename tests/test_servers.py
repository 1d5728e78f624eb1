"""The wire protocol by a client written by hand, and the tools by messages."""

import json
import socket
import struct
import threading

import pytest

from tidemark.engine import Engine
from tidemark.servers import pgwire, tools


class Client:
    def __init__(self, port):
        self.s = socket.create_connection(("127.0.0.1", port), timeout=120)
        self.f = self.s.makefile("rb")
        self.s.sendall(struct.pack("!ii", 8, 80877103))
        assert self.f.read(1) == b"N"
        body = struct.pack("!i", 196608) + b"user\0me\0database\0db\0\0"
        self.s.sendall(struct.pack("!i", len(body) + 4) + body)
        self.until_ready()

    def put(self, kind, body=b""):
        self.s.sendall(kind + struct.pack("!i", len(body) + 4) + body)

    def get(self):
        kind = self.f.read(1)
        return kind, self.f.read(struct.unpack("!i", self.f.read(4))[0] - 4)

    def until_ready(self):
        out = []
        while True:
            out.append(self.get())
            if out[-1][0] == b"Z":
                return out

    def query(self, sql):
        self.put(b"Q", sql.encode() + b"\0")
        return self.until_ready()


def names(raw):
    n, at, out = struct.unpack_from("!h", raw)[0], 2, []
    for _ in range(n):
        end = raw.index(b"\0", at)
        out.append((raw[at:end].decode(), struct.unpack_from("!i", raw, end + 7)[0]))
        at = end + 19
    return out


def row(raw):
    at, out = 2, []
    for _ in range(struct.unpack_from("!h", raw)[0]):
        n = struct.unpack_from("!i", raw, at)[0]
        at += 4
        out.append(None if n < 0 else raw[at : at + n])
        at += max(n, 0)
    return out


@pytest.fixture(scope="module")
def server(spark, sf):
    with pgwire.Server(Engine(spark).load(sf, ["nation", "region"]), 0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield s
        s.shutdown()


@pytest.fixture
def client(server):
    return Client(server.server_address[1])


def test_simple_queries(client):
    got = client.query("select 1 as a, 'x' as b, null as c, true as d, 1.5::float8 as e, array['a b', null] as f, date '2020-01-02' as g; select count(*) as n from nation")
    assert [k for k, _ in got] == [b"T", b"D", b"C", b"T", b"D", b"C", b"Z"]
    assert [n for n, _ in names(got[0][1])] == list("abcdefg") and [o for _, o in names(got[0][1])][:2] == [23, 25]
    assert row(got[1][1]) == [b"1", b"x", None, b"t", b"1.5", b'{"a b",NULL}', b"2020-01-02"]
    assert row(got[4][1]) == [b"25"] and got[5][1] == b"SELECT 1\0" and got[6][1] == b"I"
    assert [k for k, _ in client.query("")] == [b"I", b"Z"]


def test_errors_leave_the_connection_usable(client):
    got = client.query("select nope from nation")
    assert got[0][0] == b"E" and b"42703" in got[0][1] and got[-1][0] == b"Z"
    assert client.query("select 1 as a")[1][0] == b"D"


def test_transactions_and_changes(client, server):
    assert client.query("create table w (k int primary key, v text)")[0][1] == b"CREATE TABLE\0"
    assert client.query("insert into w values (1, 'a'), (2, 'b')")[0][1] == b"INSERT 0 2\0"
    assert client.query("begin; delete from w")[-1][1] == b"T"
    client.query("rollback")
    assert row(client.query("select count(*) as n from w")[1][1]) == [b"2"]
    assert b"23505" in client.query("insert into w values (1, 'c')")[0][1]
    other = Client(server.server_address[1])
    assert row(other.query("select v from w where k = 2")[1][1]) == [b"b"]


def test_extended_queries(client):
    sql = b"select n_nationkey, n_name from nation where n_regionkey = $1 and n_nationkey > $2 order by 1"
    client.put(b"P", b"s\0" + sql + b"\0" + struct.pack("!hii", 2, 23, 23))
    client.put(b"D", b"Ss\0")
    client.put(b"B", b"p\0s\0" + struct.pack("!hhh", 2, 0, 1) + struct.pack("!hi", 2, 1) + b"1" + struct.pack("!ii", 4, 1) + struct.pack("!hhh", 2, 1, 0))
    client.put(b"D", b"Pp\0")
    client.put(b"E", b"p\0" + struct.pack("!i", 2))
    client.put(b"E", b"p\0" + struct.pack("!i", 0))
    client.put(b"C", b"Ss\0")
    client.put(b"S")
    got = client.until_ready()
    kinds = b"".join(k for k, _ in got)
    assert kinds[:5] == b"1tT2T" and kinds[5:8] == b"DDs" and kinds.endswith(b"C3Z"), kinds
    first = row(got[5][1])
    assert struct.unpack("!i" if len(first[0]) == 4 else "!q", first[0])[0] == 6 and first[1] == b"NATION_6"
    client.put(b"E", b"gone\0" + struct.pack("!i", 0))
    client.put(b"P", b"\0select 1\0" + struct.pack("!h", 0))
    client.put(b"S")
    assert [k for k, _ in client.until_ready()] == [b"E", b"Z"]


def test_copy_from_and_to_the_client(client):
    client.query("create table cc (k int, v text)")
    client.put(b"Q", b"copy cc from stdin\0")
    assert client.get()[0] == b"G"
    client.put(b"d", b"1\tone\n2\t\\N\n")
    client.put(b"d", b"3\tthree\n")
    client.put(b"c")
    assert client.until_ready()[0][1] == b"COPY 3\0"
    got = client.query("copy (select k, v from cc order by k) to stdout with (format csv, header)")
    assert b"".join(x for k, x in got if k == b"d") == b"k,v\n1,one\n2,\n3,three\n" and got[-2][1] == b"COPY 3\0"


def test_tools(spark, sf):
    e = Engine(spark).load(sf, ["region", "embeddings"])

    def ask(method, **params):
        return json.loads(tools.answer(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))

    def use(tool, /, **arguments):
        got = ask("tools/call", name=tool, arguments=arguments)["result"]
        return json.loads(got["content"][0]["text"]), got["isError"]

    assert ask("initialize")["result"]["serverInfo"]["name"] == "tidemark"
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(tools.TOOLS)
    assert use("query", sql="select count(*) as n from region") == ({"columns": ["n"], "rows": [[5]], "more": False}, False)
    assert use("query", sql="select nope")[1]
    assert use("load_url", name="n", url=f"{sf}/nation.parquet") == ({"ok": True}, False)
    assert [r[1] for r in use("list_tables")[0]["rows"]] == ["embeddings", "n", "region"]
    assert [r[0] for r in use("describe_table", name="region")[0]["rows"]] == ["r_regionkey", "r_name"]
    vector = [float(x) for x in e.query("select embedding from embeddings where vec_id = 3").first()[0]]
    assert len(use("similarity_search", table="embeddings", column="embedding", vector=vector, k=2)[0]["rows"]) == 2
    assert tools.answer(e, '{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert "error" in ask("nope") and "error" in json.loads(tools.answer(e, "{"))
    assert use("reset")[0] == {"ok": True} and use("list_tables")[0]["rows"] == []
