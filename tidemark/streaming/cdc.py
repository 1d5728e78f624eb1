"""Change-data capture by Structured Streaming: files of change rows into a table, batch by batch.

Changes carry op (insert, update, delete, truncate), a sequence (lsn) and the columns of the table. Each batch
is one plan: the last change of each key wins, and the files that hold a changed key are rewritten. The list of
files and the batch's number are one small file in the replica's home, replaced by a rename, so a restarted driver
goes on where it was, and a batch that comes again is not applied twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import dml
from tidemark.operators.recursive import plain, shared_dir


class Replica:
    """A table that follows a stream of changes; with a home that has a state, it goes on from there and `initial` is not read."""

    def __init__(self, initial: DataFrame, keys: list[str], home: str | None = None):
        self.spark, self.keys, self.schema = initial.sparkSession, keys, initial.schema
        self.home = (home or f"{shared_dir(self.spark)}/replica-{uuid.uuid4().hex}").rstrip("/")
        if (state := self._read_state()) is not None:
            self.files, self.last_batch = state["files"], state["batch"]
        else:
            self.files, self.last_batch = self._stored(initial), -1
            self._write_state()

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_state(self) -> dict | None:
        at, files = self._path("state.json")
        return json.loads(bytes(self.spark.read.format("binaryFile").load(str(at)).first()["content"])) if files.exists(at) else None

    def _write_state(self) -> None:
        text = json.dumps({"batch": self.last_batch, "files": self.files})
        (new, files), (at, _) = self._path(f"state-{uuid.uuid4().hex}"), self._path("state.json")
        out = files.create(new)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(new, at, options)

    def _stored(self, df: DataFrame) -> list[str]:
        at = f"{self.home}/part-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return [plain(f) for f in self.spark.read.schema(self.schema).parquet(at).inputFiles()]

    def _of(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        return self._of(self.files)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """The next version after a batch; a batch that was applied is skipped."""
        if batch <= self.last_batch:
            return
        keep: list[str] = []
        if self.files and changes.filter("op = 'truncate'").isEmpty():
            same = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in self.keys]
            rows = self.table().withColumn("__file", F.col("_metadata.file_path")).alias("t")
            hit = {plain(r[0]) for r in rows.join(changes.select(*self.keys).alias("c"), same, "left_semi").select("__file").distinct().collect()}  # a row for each file
            keep = [f for f in self.files if f not in hit] if hit <= set(self.files) else []
        reached = self._of([f for f in self.files if f not in set(keep)])
        self.files = [*keep, *self._stored(dml.apply_changes(reached, changes, self.keys, ["lsn"]))]
        self.last_batch = batch
        self._write_state()

    def change_schema(self) -> T.StructType:
        return T.StructType([T.StructField("op", T.StringType()), T.StructField("lsn", T.LongType()), *(T.StructField(f.name, f.dataType) for f in self.schema)])

    def follow(self, folder: str, checkpoint: str | None = None, files_a_batch: int = 1):
        """Applies the JSON change files of a folder as they come; ends when there are no more."""
        stream = self.spark.readStream.schema(self.change_schema()).option("maxFilesPerTrigger", files_a_batch).json(folder)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint or f"{self.home}/offsets").trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window and key; on a stream, rows later than the watermark are left out."""
    at = F.col(time).cast("timestamp")
    rows = events.withColumn(time, at)
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: rows closer than the gap belong together.

    A stream's rows are dealt by key first: nearly every row is a session of its own until it meets the others of its
    key, so grouping a file's rows before the shuffle holds them all and saves none.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late).repartition(key) if events.isStreaming else rows
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def tail_messages(spark: SparkSession, folder: str, schema: str, sink, checkpoint: str):
    """A folder of JSON messages as an ingestion stream: `sink(df, batch)` gets each batch once."""
    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
