"""Recursion with UNION, CYCLE and SEARCH: rounds on the driver until a round adds nothing.

Rounds of few rows stay on the driver as literals, so a deep chain costs one small job a level. Larger ones are
written tables; those of earlier rounds are merged in sizes of MERGED, so a row is rewritten a logarithmic number of
times and a plan reads a logarithmic number of tables. There is no limit on rounds unless one is asked for.
"""

from __future__ import annotations

import datetime
import decimal
import itertools
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a round, and of all rounds, that stay on the driver.
LOCAL, LOCAL_IN_ALL = 1_000, 100_000
#: Tables of about one size that are merged into one.
MERGED = 8
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.BooleanType, T.DateType)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and all tasks run in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and its path."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def plain(path: str) -> str:
    """A file's name as Spark's listings and its metadata column both can be compared: local paths with three slashes."""
    return re.sub(r"^file:/+", "file:///", path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """The rows of all rounds so far as written tables, few at any time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.runs = spark, []  # (how often merged, table, path)

    def add(self, df: DataFrame) -> DataFrame:
        table, at = stored_at(df, "round")
        if not table.isEmpty():
            self.runs.append((0, table, at))
            while len(self.runs) >= MERGED and len({n for n, *_ in self.runs[-MERGED:]}) == 1:
                last = self.runs[-MERGED:]
                one, path = stored_at(_union([t for _, t, _ in last]).coalesce(last[0][1].rdd.getNumPartitions() or 1), "rounds")
                self.runs[-MERGED:] = [(last[0][0] + 1, one, path)]
                for _, t, p in last:
                    if t is not table:  # the last round is still read
                        remove(self.spark, p)
        return table

    def all(self) -> DataFrame:
        return _union([t for _, t, _ in self.runs])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (datetime.date, decimal.Decimal)):
        return f"'{value}'"
    return str(value)


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows of plain types as literals of a plan."""
    columns = ", ".join(f"cast(`c{k}` as {f.dataType.simpleString()}) as `{f.name}`" for k, f in enumerate(schema))
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(f"select {columns} from values {values} as v({', '.join(f'c{k}' for k in range(len(schema)))})")


def _counted(most: int | None):
    return range(1, most + 1) if most else itertools.count(1)


def fixpoint(base: DataFrame, step, most: int | None = None) -> DataFrame:
    """Distinct rows of base and of step(rows that the last round added), until there are none. Fails after `most` rounds, if given."""
    spark, schema = base.sparkSession, base.schema
    cast = lambda df: df.toDF(*base.columns).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
    new, local, seen = base.distinct(), all(isinstance(f.dataType, _PLAIN) for f in schema), {}
    rounds, out = _counted(most), None
    if local:
        for _ in rounds:
            rows = [tuple(r) for r in new.limit(LOCAL + 1).collect()]
            if len(rows) > LOCAL or len(seen) > LOCAL_IN_ALL:
                break
            rows = [r for r in dict.fromkeys(rows) if r not in seen]
            if not rows:
                return stored(_local_table(spark, seen, schema), "rounds")
            seen |= dict.fromkeys(rows)
            new = cast(step(_local(spark, rows, schema)))
        else:
            raise RecursionError(f"no end after {most} rounds")
    out = Rounds(spark)
    if seen:
        out.add(_local_table(spark, seen, schema))
    for _ in rounds:
        found = new.distinct()
        if out.runs:
            same = [F.col(f"f.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in base.columns]
            found = found.alias("f").join(out.all().alias("o"), same, "left_anti")
        added = out.add(found)
        if added.isEmpty():
            return out.all() if out.runs else added
        new = cast(step(added))
    raise RecursionError(f"no end after {most} rounds")


def _local_table(spark: SparkSession, seen: dict, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(list(seen), schema)


def _every(base: DataFrame, step, most: int | None) -> DataFrame:
    """All rows of base and of step(rows of the last round, its number), until a round has none."""
    out = Rounds(base.sparkSession)
    new = out.add(base)
    for level in _counted(most):
        if new.isEmpty():
            return out.all() if out.runs else new
        new = out.add(step(new, level))
    raise RecursionError(f"no end after {most} rounds")


def with_cycle(base: DataFrame, step, keys: list[str], mark: str, path: str, most: int | None = None) -> DataFrame:
    """UNION ALL recursion with the path of keys and whether a row's keys are on it already; marked rows go no further."""
    key = F.struct(*(F.col(f"`{k}`").cast("string").alias(k) for k in keys))
    columns = base.columns

    def further(new: DataFrame, _: int) -> DataFrame:
        found = step(new.filter(~F.col(mark)), [mark, path]).toDF(*columns, "__path")
        return found.withColumn(mark, F.array_contains("__path", key)).withColumn(path, F.concat("__path", F.array(key))).select(*columns, mark, path)

    return _every(base.withColumn(mark, F.lit(False)).withColumn(path, F.array(key)), further, most)


def with_search(base: DataFrame, step, keys: list[str], sequence: str, depth: bool, most: int | None = None) -> DataFrame:
    """UNION ALL recursion with a column to order by: the path of keys for depth first, level and keys for breadth first."""
    key = F.struct(*(F.col(f"`{k}`") for k in keys))
    columns = base.columns
    mark = lambda level: F.array(key) if depth else F.struct(F.lit(level).alias("depth"), *(F.col(f"`{k}`") for k in keys))

    def further(new: DataFrame, level: int) -> DataFrame:
        found = step(new, [sequence]).toDF(*columns, "__above")
        return found.withColumn(sequence, F.concat("__above", F.array(key)) if depth else mark(level)).select(*columns, sequence)

    return _every(base.withColumn(sequence, mark(0)), further, most)
