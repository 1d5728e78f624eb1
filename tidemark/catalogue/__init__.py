"""Every registered query of the engine and the DuckDB SQL that it is checked against.

An entry is PostgreSQL text that the engine runs, and the oracle's text where DuckDB says it otherwise.
Queries that change tables or need the DataFrame interface are functions in `tidemark.catalogue.programs`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalogue import functions, programs, relational, surfaces, tpch
from tidemark.engine import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def texts() -> dict[str, tuple[str, str]]:
    out = {}
    for module in (tpch, relational, functions):
        for name, entry in module.QUERIES.items():
            out[name] = (entry, entry) if isinstance(entry, str) else entry
    return out


def used(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return Engine(spark).load(sf_dir, used(sql)).query(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def one(sql: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(spark, sf_dir, sql)

    return {name: one(sql) for name, (sql, _) in texts().items()} | programs.queries() | surfaces.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in texts().items()} | programs.oracle_sql() | surfaces.oracle_sql()
