"""Foreign tables: a Python data source whose partitions are read by executors, with filters pushed where it can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.n, self.parts = int(options.get("rows", "100")), int(options.get("partitions", "4"))

    def partitions(self) -> list[Span]:
        step = -(-self.n // self.parts)
        return [Span(a, min(self.n, a + step)) for a in range(0, self.n, step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for i in range(partition.low, partition.high):
            yield i, f"row-{i}"


class SeriesSource(DataSource):
    """A sample wrapper: numbered rows, as many as the option `rows` says."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_series"

    def schema(self) -> str:
        return "id bigint, label string"

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)


def wrapper(name: str, schema: str, spans: Callable[[dict], list], read: Callable[[dict, object], Iterator[tuple]]) -> type[DataSource]:
    """A data source class from two functions: the partitions of a table, and the rows of one."""

    class Part(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [Part(v) for v in spans(self.options)]

        def read(self, partition):
            yield from read(self.options, partition.value)

    source = type(name, (DataSource,), {"name": classmethod(lambda cls: name), "schema": lambda self: schema, "reader": lambda self, schema: Reader(self.options)})
    return source


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    for s in (SeriesSource, *sources):
        spark.dataSource.register(s)
