"""Files as DataFrames: Parquet, CSV, JSON and COPY's formats."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import binary


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    """A file, or all files of a folder and the folders in it."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def csv_scan(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def json_table(spark: SparkSession, location: str, *path: str) -> DataFrame:
    """Rows of a JSON document at a URL or in a file; path walks to the array or object that holds them."""
    if location.startswith(("http://", "https://")):
        with urllib.request.urlopen(location) as r:  # one small document, read on the driver
            text = r.read().decode()
    elif location.lstrip()[:1] in "[{":
        text = location
    else:
        text = spark.read.text(location, wholetext=True).first()[0]
    value = json.loads(text)
    for step in path:
        value = value[int(step)] if isinstance(value, list) else value[step]
    rows = value if isinstance(value, list) else [value]
    rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "line string")
    return lines.select(F.from_json("line", _schema(spark, rows)).alias("r")).select("r.*")


def _schema(spark: SparkSession, rows: list[dict]) -> str:
    """The schema that holds all rows: columns in order of first sight, numbers widened."""
    merged: dict[str, list] = {}
    for r in rows:
        for k, v in r.items():
            merged.setdefault(k, []).append(v)
    fields = []
    for k, values in merged.items():
        sample = next((v for v in values if v is not None), None)
        if any(isinstance(v, float) for v in values):
            kind = "double"
        elif isinstance(sample, bool):
            kind = "boolean"
        elif isinstance(sample, int):
            kind = "bigint"
        elif isinstance(sample, (dict, list)):
            kind = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(sample)))).first()[0].lower()
        else:
            kind = "string"
        fields.append(f"`{k}` {kind}")
    return ", ".join(fields)


def copy_from(spark: SparkSession, path: str, columns: dict[str, str], options: dict[str, str]) -> DataFrame:
    """COPY FROM a file in text, csv or binary format."""
    if options.get("format", "text") == "binary":
        return binary.copy_from(spark, path, columns)
    csv = options.get("format", "text") == "csv"
    reader = spark.read.schema(", ".join(f"`{c}` {k}" for c, k in columns.items())).option("mode", "FAILFAST")
    reader = reader.option("sep", options.get("delimiter", "," if csv else "\t")).option("header", options.get("header", "false"))
    reader = reader.option("nullValue", options.get("null", "" if csv else "\\N")).option("emptyValue", "")
    if csv:
        reader = reader.option("quote", options.get("quote", '"')).option("escape", options.get("escape", '"'))
    return reader.csv(path)


def copy_to(df: DataFrame, path: str, options: dict[str, str]) -> None:
    """COPY TO a folder of files in text, csv or binary format."""
    if options.get("format", "text") == "binary":
        return binary.copy_to(df, path)
    csv = options.get("format", "text") == "csv"
    writer = df.write.mode("overwrite").option("sep", options.get("delimiter", "," if csv else "\t")).option("header", options.get("header", "false"))
    writer = writer.option("nullValue", options.get("null", "" if csv else "\\N")).option("emptyValue", '""' if csv else "")
    writer.option("quote", options.get("quote", '"')).option("escape", options.get("escape", '"')).csv(path)
