"""What the corpus operators share: the shared folder, written tables, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: Rows of an Arrow batch: whole documents travel in them, so fewer than Spark's default.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Executors get the package, and Arrow batches are kept small, as a batch holds whole texts: the session's maxRecordsPerBatch is lowered to BATCH_ROWS and stays so."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and all tasks run in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _tables.append(at)
    return spark.read.schema(df.schema).parquet(at)


def marked() -> int:
    """How many tables operators have written so far, for `release`."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written since a mark, but the last `keep`; results that still read them must be stored before."""
    end = len(_tables) - keep
    for path in _tables[since:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if since < end:
        del _tables[since:end]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def over_batches(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]):
    """A function for mapInArrow that sets itself up once a task and maps batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            if batch.num_rows:
                f = f or make()
                yield f(batch)

    return run
