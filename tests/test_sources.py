"""Files, Iceberg metadata, foreign tables and streams."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.engine import Engine
from tidemark.operators import asof, dml, recursive
from tidemark.sources import foreign, iceberg, readers
from tidemark.streaming import cdc

# A minimal Avro writer, enough for manifests.


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def encoded(schema, value):
    if isinstance(schema, list):
        return zigzag(0) if value is None else zigzag(1) + encoded(schema[1], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return encoded(kind, value)
    if kind == "record":
        return b"".join(encoded(f["type"], value[f["name"]]) for f in schema["fields"])
    if kind in ("int", "long"):
        return zigzag(value)
    raw = value.encode()
    return zigzag(len(raw)) + raw


def avro(path, schema, rows):
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"}
    head = b"Obj\1" + zigzag(len(meta)) + b"".join(zigzag(len(k)) + k.encode() + zigzag(len(v)) + v for k, v in meta.items()) + zigzag(0) + b"m" * 16
    body = b"".join(encoded(schema, r) for r in rows)
    with open(path, "wb") as f:
        f.write(head + zigzag(len(rows)) + zigzag(len(body)) + body + b"m" * 16)


MANIFEST = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "file_path", "type": "string"}, {"name": "partition", "type": {"type": "record", "name": "p", "fields": [{"name": "day", "type": ["null", "string"]}]}}, {"name": "record_count", "type": "long"}]}}]}
LIST = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}


def with_ids(table, ids):
    return table.cast(pa.schema([f.with_metadata({"PARQUET:field_id": str(i)}) for f, i in zip(table.schema, ids, strict=True)]))


@pytest.fixture
def evolved(tmp_path):
    """Two files: the older one has value as a long and a column that was dropped; the newer one the renamed, widened column and a new one."""
    os.makedirs(tmp_path / "metadata")
    os.makedirs(tmp_path / "data")
    at = f"file://{tmp_path}"
    pq.write_table(with_ids(pa.table({"id": [1, 2], "value": [10, 20], "legacy": ["a", "b"], "day": ["d1", "d1"]}), (1, 2, 3, 5)), tmp_path / "data/a.parquet")
    pq.write_table(with_ids(pa.table({"id": [3], "amount": [1.5], "updated_at": [99], "day": ["d2"]}), (1, 2, 4, 5)), tmp_path / "data/b.parquet")
    pq.write_table(with_ids(pa.table({"id": [9], "amount": [9.0], "updated_at": [9], "day": ["d9"]}), (1, 2, 4, 5)), tmp_path / "data/gone.parquet")
    files = [("a", "d1", 2, 1), ("b", "d2", 1, 1), ("gone", "d9", 1, 2)]
    avro(tmp_path / "metadata/m.avro", MANIFEST, [{"status": s, "data_file": {"file_path": f"{at}/data/{n}.parquet", "partition": {"day": d}, "record_count": c}} for n, d, c, s in files])
    avro(tmp_path / "metadata/l.avro", LIST, [{"manifest_path": f"{at}/metadata/m.avro", "content": 0}])
    field = lambda i, n, t: {"id": i, "name": n, "type": t, "required": False}
    meta = {
        "format-version": 2, "table-uuid": "u-1", "location": at, "current-schema-id": 1, "default-spec-id": 0, "current-snapshot-id": 7,
        "schemas": [{"schema-id": 0, "fields": [field(1, "id", "long"), field(2, "value", "long"), field(3, "legacy", "string"), field(5, "day", "string")]}, {"schema-id": 1, "fields": [field(1, "id", "long"), field(2, "amount", "double"), field(4, "updated_at", "long"), field(5, "day", "string")]}],
        "partition-specs": [{"spec-id": 0, "fields": [{"source-id": 5, "field-id": 1000, "name": "day", "transform": "identity"}]}],
        "snapshots": [{"snapshot-id": 7, "manifest-list": f"{at}/metadata/l.avro"}],
    }
    (tmp_path / "metadata/v1.metadata.json").write_text(json.dumps(meta | {"current-snapshot-id": -1}))
    (tmp_path / "metadata/v2.metadata.json").write_text(json.dumps(meta))
    return at


def test_iceberg_scan_follows_field_ids(spark, evolved):
    rows = sorted(map(tuple, iceberg.scan(spark, evolved).collect()))
    assert rows == [(1, 10.0, None, "d1"), (2, 20.0, None, "d1"), (3, 1.5, 99, "d2")]
    assert Engine(spark).query(f"select sum(amount) as s from iceberg_scan('{evolved}') as t").first().s == 31.5


def test_iceberg_prunes_partitions(spark, evolved):
    meta = iceberg.table_metadata(spark, evolved)
    schema, _, spec = iceberg._current(meta)
    files = iceberg.data_files(spark, evolved, meta)
    assert [f["file_path"].rsplit("/", 1)[1] for f in files] == ["a.parquet", "b.parquet"]
    assert len(iceberg.pruned(files, spec, schema, {"day": lambda d: d > "d1"})) == 1
    assert [r.id for r in iceberg.scan(spark, evolved, {"day": lambda d: d == "d2"}).collect()] == [3]


def many_files(tmp_path, entry_schema_ids):
    """100 files: of every four, one without the renamed and widened column's new name and type, and one without a new column."""
    os.makedirs(tmp_path / "metadata")
    os.makedirs(tmp_path / "data")
    at, files, rows = f"file://{tmp_path}", [], []
    for k in range(100):
        day = f"d{k % 5}"
        if k % 4 == 0:
            t = with_ids(pa.table({"id": pa.array([k], pa.int64()), "value": pa.array([k], pa.int32()), "legacy": ["x"], "day": [day]}), (1, 2, 3, 5))
            rows.append((k, k, None, day))
        else:
            t = with_ids(pa.table({"id": pa.array([k], pa.int64()), "amount": pa.array([k * 10**10], pa.int64()), "updated_at": pa.array([k], pa.int64()), "day": [day]}), (1, 2, 4, 5))
            rows.append((k, k * 10**10, k, day))
        pq.write_table(t, tmp_path / f"data/{k}.parquet")
        files.append((k, day))
    manifest = json.loads(json.dumps(MANIFEST))
    if entry_schema_ids:
        manifest["fields"].insert(1, {"name": "snapshot_id", "type": "long"})
    avro(tmp_path / "metadata/m.avro", manifest, [{"status": 1, "snapshot_id": 6 if k % 4 == 0 else 7, "data_file": {"file_path": f"{at}/data/{k}.parquet", "partition": {"day": d}, "record_count": 1}} for k, d in files])
    avro(tmp_path / "metadata/l.avro", LIST, [{"manifest_path": f"{at}/metadata/m.avro", "content": 0}])
    field = lambda i, n, t: {"id": i, "name": n, "type": t, "required": False}
    schemas = [{"schema-id": 0, "fields": [field(1, "id", "long"), field(2, "value", "int"), field(3, "legacy", "string"), field(5, "day", "string")]}, {"schema-id": 1, "fields": [field(1, "id", "long"), field(2, "amount", "long"), field(4, "updated_at", "long"), field(5, "day", "string")]}]
    own = [{"schema-id": 0}, {"schema-id": 1}] if entry_schema_ids else [{}, {}]
    meta = {"format-version": 2, "table-uuid": "u", "location": at, "current-schema-id": 1, "default-spec-id": 0, "current-snapshot-id": 7, "schemas": schemas, "partition-specs": [{"spec-id": 0, "fields": [{"source-id": 5, "field-id": 1000, "name": "day", "transform": "identity"}]}], "snapshots": [{"snapshot-id": 6} | own[0], {"snapshot-id": 7, "manifest-list": f"{at}/metadata/l.avro"} | own[1]]}
    (tmp_path / "metadata/v1.metadata.json").write_text(json.dumps(meta))
    return at, rows


@pytest.mark.parametrize("named", [True, False])
def test_iceberg_of_many_evolved_files(spark, tmp_path, named):
    at, rows = many_files(tmp_path, named)
    assert sorted(map(tuple, iceberg.scan(spark, at).collect())) == sorted(rows)
    df = Engine(spark).query(f"select id, amount from iceberg_scan('{at}') as t where day = 'd3' and id > 10")
    assert sorted(map(tuple, df.collect())) == sorted((i, a) for i, a, _, d in rows if d == "d3" and i > 10)
    opened = {f.rsplit("/", 1)[1] for f in df.inputFiles()}
    read = df._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert {f"{i}.parquet" for i, _, _, d in rows if d == "d3"} <= opened and read.count("Relation") == 2


def test_iceberg_metadata(spark, evolved):
    row = iceberg.metadata(spark, evolved).first()
    assert (row.table_uuid, row.format_version, row.data_files, row.records, row.partition_spec) == ("u-1", 2, 2, 3, "day")


def test_iceberg_without_metadata_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        iceberg.scan(spark, f"file://{tmp_path}")


def test_json_table_paths(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"data": {"rows": [{"a": 1}, {"a": 2, "b": [1, 2]}]}}))
    rows = readers.json_table(spark, f"file://{tmp_path}/x.json", "data", "rows").collect()
    assert [(r.a, r.b) for r in rows] == [(1, None), (2, [1, 2])]
    assert readers.json_table(spark, "[1, 2]").collect()[0].value == 1


def test_copy_text_format(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\tx y\n2\t\\N\n")
    e = Engine(spark)
    e.sql("create table t (k int, s text)")
    assert e.sql(f"copy t from 'file://{tmp_path}/t.txt'").tag == "COPY 2"
    assert sorted(e.sql("select k, s from t").rows()) == [(1, "x y"), (2, None)]


def test_foreign_wrapper(spark):
    source = foreign.wrapper("letters", "c string", lambda o: list("ab"), lambda o, part: iter([(part,), (part * 2,)]))
    foreign.register(spark, source)
    assert sorted(r.c for r in spark.read.format("letters").load().collect()) == ["a", "aa", "b", "bb"]


def test_cdc_stream(spark, tmp_path):
    start = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    replica = cdc.Replica(start, ["k"])
    os.makedirs(tmp_path / "in")
    changes = [[("update", 1, 1, "A"), ("insert", 2, 3, "c")], [("delete", 3, 2, None), ("update", 4, 3, "C")], [("truncate", 5, None, None), ("insert", 6, 7, "z")]]
    for i, batch in enumerate(changes):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"op": o, "lsn": n, "k": k, "v": v}) for o, n, k, v in batch[:2]))
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))
    q = replica.follow(f"file://{tmp_path}/in", f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert sorted(map(tuple, replica.table().collect())) == [(7, "z")]
    assert replica.last_batch == 2


def test_cdc_repeated_batch_is_skipped(spark):
    replica = cdc.Replica(spark.createDataFrame([(1, 1)], "k long, v long"), ["k"])
    change = spark.createDataFrame([("update", 1, 1, 5)], replica.change_schema())
    replica.apply(change, 0)
    files = replica.files
    replica.apply(change, 0)
    assert replica.files == files and replica.table().first().v == 5


def test_cdc_goes_on_after_a_restart_and_rewrites_reached_files_only(spark, tmp_path):
    home = f"file://{tmp_path}/home"
    start = spark.range(100).selectExpr("id as k", "id * 2 as v").repartitionByRange(4, "k")
    replica = cdc.Replica(start, ["k"], home)
    before = set(replica.files)
    replica.apply(spark.createDataFrame([("update", 1, 3, 0), ("delete", 2, 4, None), ("insert", 3, 1000, 1)], replica.change_schema()), 0)
    assert len(before & set(replica.files)) == 3
    again = cdc.Replica(start, ["k"], home)  # as a new driver would
    assert again.last_batch == 0 and again.files == replica.files
    again.apply(spark.createDataFrame([("delete", 1, 5, None)], replica.change_schema()), 0)
    again.apply(spark.createDataFrame([("truncate", 4, None, None), ("insert", 5, 7, 7)], replica.change_schema()), 1)
    assert sorted(map(tuple, replica.table().collect())) == sorted([(k, 0 if k == 3 else 2 * k) for k in range(100) if k != 4] + [(1000, 1)])
    assert sorted(map(tuple, cdc.Replica(start, ["k"], home).table().collect())) == [(7, 7)]


def test_event_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(1).write.parquet(f"file://{tmp_path}/ev")
    stream = cdc.event_windows(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/ev"), "1 day")
    stream.writeStream.format("memory").queryName("ev_out").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("ev_out").collect())) == sorted(map(tuple, cdc.event_windows(events, "1 day").collect()))


@pytest.mark.parametrize("small", [asof.SMALL, 100])
def test_asof_join_deals_a_hot_key(spark, small, monkeypatch):
    import bisect
    import random

    monkeypatch.setattr(asof, "SMALL", small)

    r = random.Random(2)
    left = [(i, None if r.random() < 0.05 else 1 if r.random() < 0.7 else r.randint(2, 9), r.randint(0, 3_000)) for i in range(2_000)]
    right = [(None if r.random() < 0.05 else 1 if r.random() < 0.7 else r.randint(2, 9), r.randint(0, 3_000), v) for v in range(1_500)]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    by = {}
    for k, t, v in right:
        by.setdefault(k, []).append((t, v))
    for rows in by.values():
        rows.sort()

    def last(k, t):
        at = bisect.bisect_right(by.get(k, []), (t, 10**9))
        return by[k][at - 1][1] if k is not None and at else None

    got = asof.join(a, b, "k", "t", "v")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, k, t, last(k, t)) for i, k, t in left), key=repr)


def test_band_join_matches_plain(spark):
    import random

    r = random.Random(1)
    a = [(i, r.uniform(-50, 50)) for i in range(200)]
    b = [(i, r.uniform(-50, 50)) for i in range(200)]
    got = asof.band(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), "x", "y", 1.5)
    assert sorted((q.i, q.j) for q in got.collect()) == sorted((i, j) for i, x in a for j, y in b if abs(x - y) <= 1.5)


def test_fixpoint_stops_and_caps(spark):
    base = spark.createDataFrame([(1,)], "n int")
    step = lambda rows: rows.selectExpr("n * 2 % 11 as n")
    assert sorted(r.n for r in recursive.fixpoint(base, step).collect()) == list(range(1, 11))
    with pytest.raises(RecursionError):
        recursive.fixpoint(base, lambda rows: rows.selectExpr("n + 1 as n"), most=3)


def test_merge_plan_needs_no_cartesian(spark):
    t = spark.createDataFrame([(1, 1)], "k int, v int")
    plan = dml.merge(t, "t", t, "s", "t.k = s.k", [dml.Clause("matched", "update", sets={"v": "s.v + 1"})])._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_sessions_of_a_stream_are_grouped_after_the_shuffle(spark, tmp_path):
    rows = spark.sql("select id % 7 as user_id, timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 20 * (id div 7) * (id div 70)) as ts from range(210)")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = cdc.sessions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "2 hours")
    out = stream.writeStream.format("memory").queryName("grouped_sessions").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    plan = out._jsq.explainInternal(False)
    below = plan[plan.rindex("Exchange hashpartitioning(user_id") :]
    assert "Aggregate" not in below and plan.count("Exchange") == 1
    closed = {tuple(r) for r in spark.table("grouped_sessions").collect()}
    assert closed and closed <= {tuple(r) for r in cdc.sessions(rows, "2 hours").collect()}
