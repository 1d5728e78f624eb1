"""Iceberg tables without a catalogue: metadata JSON and Avro manifests read on the driver, data files by Spark.

Only metadata is touched on the driver: its size follows the number of data files, not of rows. Data files are
read by Spark, which matches their columns by field id file by file, and are renamed and widened to the current
schema. Where a field's type has changed, files are first grouped by the schema that they were written with: the
one their snapshot names, else the one in their footers. Identity partition columns become literals, so that
Catalyst drops the files of other values from the plan whatever the query's filters look like.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string", "uuid": "string", "binary": "binary"}


def spark_kind(kind) -> str:
    if isinstance(kind, str):
        if kind.startswith("decimal"):
            return kind
        return "binary" if kind.startswith("fixed") else "string" if kind == "time" else _KINDS[kind]
    if kind["type"] == "list":
        return f"array<{spark_kind(kind['element'])}>"
    if kind["type"] == "map":
        return f"map<{spark_kind(kind['key'])},{spark_kind(kind['value'])}>"
    return f"struct<{','.join(f'{f['name']}:{spark_kind(f['type'])}' for f in kind['fields'])}>"


# Avro container files, as far as manifests use them.


def _long(f: io.BytesIO) -> int:
    shift = out = 0
    while True:
        b = f.read(1)[0]
        out |= (b & 127) << shift
        if b < 128:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def _bytes(f: io.BytesIO) -> bytes:
    return f.read(_long(f))


def _blocks(f: io.BytesIO, read: Callable):
    while n := _long(f):
        if n < 0:
            n = -n
            _long(f)
        for _ in range(n):
            yield read()


def _value(f: io.BytesIO, schema, names: dict):
    if isinstance(schema, list):
        return _value(f, schema[_long(f)], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _value(f, kind, names)
    if kind in names and not isinstance(schema, dict):
        return _value(f, names[kind], names)
    if kind == "record":
        names[schema["name"]] = schema
        return {x["name"]: _value(f, x["type"], names) for x in schema["fields"]}
    if kind == "array":
        return list(_blocks(f, lambda: _value(f, schema["items"], names)))
    if kind == "map":
        return dict(_blocks(f, lambda: (_bytes(f).decode(), _value(f, schema["values"], names))))
    if kind == "fixed":
        return f.read(schema["size"])
    if kind == "enum":
        return schema["symbols"][_long(f)]
    if kind in ("int", "long"):
        return _long(f)
    if kind in ("bytes", "string"):
        raw = _bytes(f)
        return raw.decode() if kind == "string" else raw
    if kind == "boolean":
        return f.read(1) == b"\1"
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", f.read(4 if kind == "float" else 8))[0]
    return None


def avro_rows(raw: bytes) -> list[dict]:
    f = io.BytesIO(raw)
    if f.read(4) != b"Obj\1":
        raise ValueError("not an Avro container file")
    meta = dict(_blocks(f, lambda: (_bytes(f).decode(), _bytes(f))))
    schema, codec, mark, out = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null"), f.read(16), []
    while f.tell() < len(raw):
        n = _long(f)
        block = _bytes(f)
        block = io.BytesIO(zlib.decompress(block, -15) if codec == b"deflate" else block)
        out += [_value(block, schema, {}) for _ in range(n)]
        if f.read(16) != mark:
            raise ValueError("damaged Avro block")
    return out


# Tables.


def _read(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [x.getPath().toString() for x in found or []]


def table_metadata(spark: SparkSession, path: str) -> dict:
    """The newest metadata file of a table."""
    hint = _names(spark, f"{path}/metadata", "version-hint.text")
    files = _names(spark, f"{path}/metadata", "*.metadata.json")
    if not files:
        raise FileNotFoundError(f"no Iceberg metadata under {path}")
    if hint:
        v = _read(spark, hint[0]).decode().strip()
        files = [f for f in files if f.rsplit("/", 1)[1] in (f"v{v}.metadata.json", f"{v}.metadata.json")] or files
    number = lambda f: int("".join(c for c in f.rsplit("/", 1)[1].split("-")[0].split(".")[0] if c.isdigit()) or 0)
    return json.loads(_read(spark, max(files, key=lambda f: (number(f), f))))


def _current(meta: dict) -> tuple[dict, dict | None, list[dict]]:
    schema = next((s for s in meta.get("schemas", []) if s["schema-id"] == meta.get("current-schema-id")), meta.get("schema"))
    now = meta.get("current-snapshot-id")
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == now), None)
    spec = next((s["fields"] for s in meta.get("partition-specs", []) if s["spec-id"] == meta.get("default-spec-id")), meta.get("partition-spec", []))
    return schema, snapshot, spec


def data_files(spark: SparkSession, path: str, meta: dict) -> list[dict]:
    """Live data files of the current snapshot: path, partition values, record count, and the schema that their snapshot names."""
    _, snapshot, _ = _current(meta)
    if snapshot is None:
        return []
    here = lambda p: p if not meta.get("location") else p.replace(meta["location"].rstrip("/"), path.rstrip("/"), 1)
    manifests = avro_rows(_read(spark, here(snapshot["manifest-list"]))) if "manifest-list" in snapshot else [{"manifest_path": p} for p in snapshot["manifests"]]
    written = {s["snapshot-id"]: s["schema-id"] for s in meta.get("snapshots", []) if "schema-id" in s}
    out = []
    for m in manifests:
        if m.get("content", 0) == 1:
            raise ValueError("row-level delete files are not supported")
        for e in avro_rows(_read(spark, here(m["manifest_path"]))):
            if e["status"] != 2:
                added = e.get("snapshot_id") or m.get("added_snapshot_id")
                out.append(e["data_file"] | {"file_path": here(e["data_file"]["file_path"]), "schema_id": written.get(added)})
    return out


def pruned(files: list[dict], spec: list[dict], schema: dict, where: dict[str, Callable] | None) -> list[dict]:
    """Files whose identity partitions pass the tests by column."""
    if not where:
        return files
    names = {f["id"]: f["name"] for f in schema["fields"]}
    tests = [(p["name"], where[names[p["source-id"]]]) for p in spec if p["transform"] == "identity" and names.get(p["source-id"]) in where]
    return [f for f in files if all(f.get("partition", {}).get(n) is None or t(f["partition"][n]) for n, t in tests)]


#: Branches of a plan by partition value; values beyond are read together, without being dropped by the plan.
MOST_BRANCHES = 400


def _field_id(column) -> int | None:
    own = column.metadata.get("parquet.field.id", column.metadata.get("PARQUET:field_id"))
    return None if own is None else int(own)


def _by_schema(spark: SparkSession, meta: dict, fields: list[dict], files: list[dict]) -> dict[tuple, list[dict]]:
    """Files by the columns that they are read with: (field id or null, name, type) of each."""
    schemas = {s["schema-id"]: s["fields"] for s in meta.get("schemas", []) if "schema-id" in s}
    ever: dict[int, set[str]] = {}
    for own in [*schemas.values(), fields]:
        for f in own:
            ever.setdefault(f["id"], set()).add(spark_kind(f["type"]))
    settled = all(len(ever[f["id"]]) == 1 for f in fields)
    groups: dict[tuple, list[dict]] = {}
    todo: dict[int | None, list[dict]] = {}
    for f in files:
        todo.setdefault(None if settled else f["schema_id"] if f["schema_id"] in schemas else -1, []).append(f)
    by_footer = []
    for schema_id, some in todo.items():
        first = spark.read.parquet(some[0]["file_path"]).schema
        if schema_id == -1 or any(_field_id(c) is None for c in first):
            by_footer += some
            continue
        of = fields if schema_id is None else schemas[schema_id]
        groups.setdefault(tuple((f["id"], f["name"], spark_kind(f["type"])) for f in of), []).extend(some)
    with ThreadPoolExecutor(16) as pool:  # one small read for each file
        for f, own in zip(by_footer, pool.map(lambda f: spark.read.parquet(f["file_path"]).schema, by_footer), strict=True):
            groups.setdefault(tuple((_field_id(c), c.name, c.dataType.simpleString()) for c in own), []).append(f)
    return groups


def scan(spark: SparkSession, path: str, where: dict[str, Callable] | None = None) -> DataFrame:
    """The current rows of a table; `where` tests identity partition values so that other files aren't opened."""
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    meta = table_metadata(spark, path)
    schema, _, spec = _current(meta)
    fields = schema["fields"]
    files = pruned(data_files(spark, path, meta), spec, schema, where)
    ddl = ", ".join(f"`{f['name']}` {spark_kind(f['type'])}" for f in fields)
    if not files:
        return spark.createDataFrame([], ddl)
    out = None
    for columns, some in _by_schema(spark, meta, fields, files).items():
        for literals, paths in _branches(spec, fields, some).items():
            part = _read_files(spark, meta, fields, columns, paths, dict(literals))
            out = part if out is None else out.unionByName(part)
    return out


def _branches(spec: list[dict], fields: list[dict], files: list[dict]) -> dict[tuple, list[str]]:
    """Paths by the values, as SQL, of identity partition columns."""
    plain = {f["id"]: f for f in fields if f["type"] in ("string", "int", "long", "boolean", "date")}
    own = [(p["name"], plain[p["source-id"]]) for p in spec if p["transform"] == "identity" and p["source-id"] in plain]
    out: dict[tuple, list[str]] = {}
    for f in files:
        values = tuple((field["name"], _sql(f["partition"][n], field["type"])) for n, field in own if n in f.get("partition", {}))
        out.setdefault(values if values in out or len(out) < MOST_BRANCHES else (), []).append(f["file_path"])
    return out


def _sql(value, kind: str) -> str:
    if value is None:
        return f"cast(null as {spark_kind(kind)})"
    if kind == "string":
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"date_add(date '1970-01-01', {value})" if kind == "date" else f"cast({str(value).lower()} as {spark_kind(kind)})"


def _read_files(spark: SparkSession, meta: dict, fields: list[dict], columns: tuple, paths: list[str], literals: dict[str, str]) -> DataFrame:
    ids = any(i is not None for i, _, _ in columns)
    read = T.StructType([T.StructField(name, T.StructType.fromDDL(f"`c` {kind}")[0].dataType, True, {"parquet.field.id": i} if i is not None else {}) for i, name, kind in columns])
    df = spark.read.schema(read).parquet(*paths)
    if ids:
        by_id = {i: name for i, name, _ in columns if i is not None}
        names = [by_id.get(f["id"]) for f in fields]
    else:
        names = [_old_name(meta, f, {name for _, name, _ in columns}) for f in fields]
    value = lambda f, n: F.expr(literals[f["name"]]) if f["name"] in literals else F.col(f"`{n}`") if n else F.lit(None)
    return df.select(*(value(f, n).cast(spark_kind(f["type"])).alias(f["name"]) for f, n in zip(fields, names, strict=True)))


def _old_name(meta: dict, field: dict, columns: set[str]) -> str | None:
    """The name in files without ids of a field's column: one that it had in any schema."""
    names = [f["name"] for s in [*meta.get("schemas", []), meta.get("schema") or {"fields": []}] for f in s["fields"] if f["id"] == field["id"]]
    return next((n for n in [field["name"], *names] if n in columns), None)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row on a table: root, uuid, version, schema and snapshot ids, partition columns, counts."""
    meta = table_metadata(spark, path)
    schema, snapshot, spec = _current(meta)
    files = data_files(spark, path, meta)
    row = (path, meta.get("table-uuid"), meta["format-version"], schema.get("schema-id"), snapshot and snapshot["snapshot-id"], ",".join(p["name"] for p in spec), len(files), sum(f["record_count"] for f in files), len(meta.get("snapshots", [])))
    return spark.createDataFrame([row], "table_root string, table_uuid string, format_version int, current_schema_id int, current_snapshot_id bigint, partition_spec string, data_files bigint, records bigint, snapshots bigint")
