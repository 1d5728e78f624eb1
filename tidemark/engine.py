"""The engine: PostgreSQL-flavoured SQL over Spark, with versioned tables.

Queries become one Spark plan. A table is a list of Parquet parts in the shared folder: INSERT adds a part,
UPDATE, DELETE and MERGE write the next version. A transaction keeps the map from names to versions and puts
it back on ROLLBACK; nothing is copied.
"""

from __future__ import annotations

import copy
import json
import math
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import python, scalar
from tidemark.operators import dml, recursive
from tidemark.plans import lexer
from tidemark.plans.translate import Expr, Translator, kind_of, literal, quoted
from tidemark.session import ship


#: Rows of the smaller side up to which a range join compares all pairs, and buckets that an interval of it covers at most.
NESTED_LOOP_ROWS, MOST_BUCKETS = 1_000, 1_000
#: Of a range join: pairs that a task compares, points that share an interval's copy at least, and tasks at most (above, each compares more).
PAIRS_A_TASK, POINTS_A_SHARE, MOST_TASKS = 4_000_000, 1_000, 20_000

#: PostgreSQL's reserved words.
RESERVED = set("all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create current_catalog current_date current_role current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign from grant group having in initially intersect into lateral leading limit localtime localtimestamp not null offset on only or order placing primary references returning select session_user some symmetric system_user table then to trailing true union unique user using variadic when where window with".split())


class SqlError(ValueError):
    """A statement that breaks a rule of the database: a constraint, a missing or doubled name."""


@dataclass
class Result:
    tag: str
    df: DataFrame | None = None

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []


@dataclass
class Column:
    name: str
    kind: str
    default: str | None = None
    not_null: bool = False
    sequence: str | None = None


@dataclass
class Table:
    columns: list[Column]
    parts: list[str] = field(default_factory=list)
    source: DataFrame | None = None
    keys: list[tuple[str, list[str], bool]] = field(default_factory=list)  # name, columns, primary
    checks: list[tuple[str, str]] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str], str]] = field(default_factory=list)
    policies: list[tuple[str, str, str | None, str | None]] = field(default_factory=list)  # name, command, using, check
    secured: bool = False
    triggers: list = field(default_factory=list)
    statement: str | None = None  # of a materialised view
    parents: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, prefix: str = ""):
        self.spark, self.prefix = spark, prefix or f"e{uuid.uuid4().hex[:8]}"
        ship(spark)
        python.register(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.limit_recursion(0)
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.sequences: dict[str, dict] = {}
        self.types: dict[str, dict] = {}
        self.functions: dict[str, dict] = {}
        self.schemas: set[str] = {"public"}
        self.settings: dict[str, str] = {"search_path": "public", "timezone": "UTC"}
        self.prepared: dict[str, str] = {}
        self.extensions: set[str] = set()
        self.saves: list[tuple[str | None, dict]] = []
        self.sources: dict[str, object] = {}
        self.log: list[str] = []
        self.last_sequence: str | None = None
        self.role = "postgres"
        self.roles: dict[str, bool] = {"postgres": True}  # whether a superuser
        self.written: set[str] = set()  # folders of this engine's tables, of old versions too
        self.grants: set[tuple[str, str, str]] = set()  # role, table, privilege
        self.members: set[tuple[str, str]] = set()  # role, member
        self.explaining = False

    def limit_recursion(self, levels: int) -> None:
        """`SET recursion_limit = n`: recursion that goes deeper fails; 0, the default, is no limit."""
        for name in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
            self.spark.conf.set(name, str(levels) if levels and "Level" in name else "-1")

    # Data.

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame as a table of the engine; it is read where it lies."""
        self.tables[name] = Table([Column(f.name, f.dataType.simpleString()) for f in df.schema], source=df)

    def load(self, folder: str, names: list[str]) -> Engine:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def rows(self, name: str) -> DataFrame:
        table = self.tables[self.local(name)]
        schema = T.StructType.fromDDL(", ".join(f"{quoted(c.name)} {c.kind}" for c in table.columns)) if table.columns else T.StructType([])
        if table.source is not None and not table.parts:
            return table.source
        if not table.parts:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).parquet(*table.parts)
        return table.source.unionByName(stored) if table.source is not None else stored

    def local(self, name: str) -> str:
        name = name.removeprefix("public.")
        if name in self.tables or name in self.views:
            return name
        raise SqlError(f'relation "{name}" does not exist')

    # What the translator asks.

    def relation(self, name: str) -> str:
        if df := self.system_relation(name):
            view = f"{self.prefix}_{name.replace('.', '_')}"
            df.createOrReplaceTempView(view)
            return view
        name = self.local(name)
        if name in self.views:
            return f"({self.translate(self.views[name])})"
        view = f"{self.prefix}_{re.sub(r'[^a-z0-9_]', '_', name)}"
        df, table = self.rows(name), self.tables[name]
        if table.secured and self.role != "postgres":
            passing = [u for _, command, u, _ in table.policies if command in ("all", "select") and u]
            df = df.filter(" or ".join(f"({u})" for u in passing) if passing else "false")
        df.createOrReplaceTempView(view)
        return view

    def columns(self, name: str) -> dict[str, str]:
        bare = name.removeprefix("public.")
        if bare in self.tables:
            return {c.name: kind_of(c.kind) for c in self.tables[bare].columns}
        return self.describe(f"SELECT * FROM {self.relation(name)}")

    def describe(self, sql: str) -> dict[str, str]:
        return {f.name: kind_of(f.dataType.simpleString()) for f in self.spark.sql(sql).schema}

    def table_function(self, name: str, args: list[str]) -> str | None:
        from tidemark.sources import iceberg, readers

        plain = [a.strip("'") for a in args]
        if name in ("parquet_scan", "read_parquet"):
            df = readers.parquet_scan(self.spark, plain[0])
        elif name == "iceberg_scan":
            df = iceberg.scan(self.spark, plain[0])
        elif name == "iceberg_metadata":
            df = iceberg.metadata(self.spark, plain[0])
        elif name == "json_table":
            df = readers.json_table(self.spark, *plain)
        elif name == "csv_scan":
            df = readers.csv_scan(self.spark, plain[0])
        elif name == "pg_get_keywords":
            words = ", ".join(f"'{w}'" for w in sorted(RESERVED))
            return f"(SELECT word, if(array_contains(r, word), 'R', 'U') AS catcode, true AS barelabel, if(array_contains(r, word), 'reserved', 'unreserved') AS catdesc, 'can be bare label' AS baredesc FROM (SELECT explode(array_union(r, (SELECT collect_set(lower(keyword)) FROM sql_keywords()))) AS word, r FROM (SELECT array({words}) AS r)))"
        elif name == "pg_input_error_info":
            kind = scalar.spark_type(plain[1])
            return f"(SELECT if(try_cast({args[0]} AS {kind}) IS NULL, concat('invalid input syntax for type {plain[1]}: \"', {args[0]}, '\"'), NULL) AS message, cast(NULL AS string) AS detail, cast(NULL AS string) AS hint, if(try_cast({args[0]} AS {kind}) IS NULL, '22P02', NULL) AS sql_error_code)"
        elif name in self.functions and self.functions[name].get("rows"):
            from tidemark.plans import procedural

            own = self.functions[name]
            given = self.spark.sql(f"SELECT {', '.join(args) or '1'}").first()
            df = procedural.run_rows(self, own["body"], dict(zip([a for a, _ in own["args"]], given, strict=False)), own["rows"])
        elif name in self.functions and self.functions[name].get("table"):
            return f"{self.prefix}_{name}({', '.join(args)})"
        else:
            return None
        view = f"{self.prefix}_f{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(view)
        return view

    def scalar_function(self, name: str, args: list[str]) -> Expr | None:
        if name in self.functions and self.functions[name].get("rows"):
            raise SqlError(f"{name} returns rows: call it in FROM")
        if name in self.functions and "body" in self.functions[name]:
            from tidemark.plans import procedural

            own = self.functions[name]
            try:
                given = self.spark.sql(f"SELECT {', '.join(args) or '1'}")
            except AnalysisException:  # columns
                at = f"{self.prefix}_{name}_rows"
                self.spark.udf.register(at, F.udf(procedural.over_rows(own["body"], [a for a, _ in own["args"]], kind_of(own["spark"])), own["spark"], useArrow=True))
                return Expr(f"{at}({', '.join(args)})", own["kind"], name)
            values = dict(zip([a for a, _ in own["args"]], given.first(), strict=False))
            return Expr(_constant(procedural.run_block(self, own["body"], values)), own["kind"], name)
        if name in self.functions:
            return Expr(f"{self.prefix}_{name}({', '.join(args)})", self.functions[name]["kind"], name)
        plain = [a.strip("'") for a in args]
        if name == "nextval":
            return Expr(f"{self.sequences[plain[0]]['next'] if self.explaining and plain[0] in self.sequences else self.nextval(plain[0])}L", "bigint", name)
        if name == "currval":
            if self.sequences[plain[0]]["current"] is None:
                raise SqlError(f'currval of sequence "{plain[0]}" is not yet defined in this session')
            return Expr(f"{self.sequences[plain[0]]['current']}L", "bigint", name)
        if name == "lastval":
            return Expr(f"{self.sequences[self.last_sequence]['current']}L", "bigint", name)
        if name == "setval":
            s, called = self.sequences[plain[0]], len(args) < 3 or args[2].lower() == "true"
            s["next"] = int(plain[1]) + (s["increment"] if called else 0)
            s["current"] = int(plain[1]) if called else s["current"]
            return Expr(f"{plain[1]}L", "bigint", name)
        if name == "pg_get_viewdef":
            view = re.sub(r"^cast\((.*) as string\)$", r"\1", plain[0]).strip("'")
            if view not in self.views:
                raise SqlError(f'relation "{view}" does not exist')
            return Expr(literal(self.views[view]), "text", name)
        if name in ("has_table_privilege", "has_column_privilege", "has_schema_privilege") and all(a.startswith("'") for a in args):
            role = plain[0] if len(args) > (3 if name == "has_column_privilege" else 2) else self.role
            where, rights = plain[-3 if name == "has_column_privilege" else -2], plain[-1]
            if role not in self.roles:
                raise SqlError(f'role "{role}" does not exist')
            if name == "has_schema_privilege":
                if where not in (*self.schemas, "pg_catalog", "information_schema"):
                    raise SqlError(f'schema "{where}" does not exist')
                return Expr(str(self.may(role, f"schema {where}", rights) or where == "public" and rights.lower() == "usage").lower(), "bool", name)
            if self.system_relation(where) is not None:
                return Expr(str(rights.lower() == "select" or self.may(role, where, rights)).lower(), "bool", name)
            where = self.local(where)
            if name == "has_column_privilege" and plain[-2] not in self.columns(where):
                raise SqlError(f'column "{plain[-2]}" of relation "{where}" does not exist')
            return Expr(str(self.may(role, where, rights)).lower(), "bool", name)
        if name in ("pg_relation_size", "pg_total_relation_size") and args and args[0].startswith("'"):
            return Expr(f"{self.stored_bytes(self.local(plain[0]))}L", "bigint", name)
        if name == "pg_sleep":
            time.sleep(float(plain[0]))
            return Expr("cast(null as string)", "text", name)
        if name == "current_setting":
            return Expr(literal(self.settings.get(plain[0], "")), "text", name)
        if name == "set_config":
            self.settings[plain[0]] = plain[1]
            return Expr(literal(plain[1]), "text", name)
        return None

    def nextval(self, name: str, n: int = 1) -> int:
        """Takes n numbers of a sequence; gives the first."""
        if name not in self.sequences:
            raise SqlError(f'relation "{name}" does not exist')
        s = self.sequences[name]
        first = s["next"]
        last = first + (n - 1) * s["increment"]
        if s["max"] is not None and last > s["max"] or s["min"] is not None and last < s["min"]:
            if not s["cycle"]:
                raise SqlError(f'nextval: reached {"maximum" if s["increment"] > 0 else "minimum"} value of sequence "{name}"')
            first = last = s["min"] if s["increment"] > 0 else s["max"]
        s["next"], s["current"] = last + s["increment"], last
        self.last_sequence = name
        return first

    def stored_bytes(self, name: str) -> int:
        """Bytes of a table's files."""
        table = self.tables.get(name)
        paths = [] if table is None else [*table.parts, *(table.source.inputFiles() if table.source is not None else [])]
        out = 0
        for p in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            out += at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        return out

    def named_type(self, name: str) -> str | None:
        """Spark's type for a composite type's or a table's row."""
        if name in self.types and self.types[name]["base"].startswith("struct<"):
            return self.types[name]["base"]
        if name in self.tables:
            return f"struct<{','.join(f'{quoted(c.name)}:{c.kind}' for c in self.tables[name].columns)}>"
        return None

    def band_width(self, points: str, intervals: str, begin: str, end: str) -> float | None:
        """Width of the buckets of a range join: the mean interval, or more where one would cover over MOST_BUCKETS; None if a side is small enough to be compared row by row (`SET nested_loop_rows = n`)."""
        few = int(self.settings.get("nested_loop_rows", NESTED_LOOP_ROWS))
        for side in (intervals, points):
            if self.spark.sql(f"SELECT 1 FROM {side} LIMIT {few + 1}").count() <= few:
                return None
        mean, most = self.spark.sql(f"SELECT avg(n), max(n) FROM (SELECT cast({end} AS double) - ({begin}) AS n FROM {intervals}) WHERE n >= 0").first()
        if mean is None or not most < float("inf"):
            return None
        return max(mean, most / MOST_BUCKETS) or 1.0

    def band_tasks(self, points: str, intervals: str, band: str, bands: str) -> tuple[int, int]:
        """Into how many tasks, and shares of a bucket's points, a range join is dealt so that a task compares about PAIRS_A_TASK pairs; (1, 1) if one task does.

        The pairs, mostly rows of the result, grow with the product of both sides; small inputs would leave them to one task.
        """
        met = f"FROM (SELECT {band} AS b, count(*) AS n FROM {points} GROUP BY 1) AS p JOIN (SELECT b, count(*) AS m FROM (SELECT {bands} AS b FROM {intervals}) GROUP BY 1) AS i USING (b)"
        pairs, most, held = self.spark.sql(f"SELECT sum(cast(n AS double) * m), max(cast(n AS double) * m), max(n) {met}").first()
        tasks = math.ceil((pairs or 0) / PAIRS_A_TASK)
        if tasks <= 1:
            return 1, 1
        return min(tasks, MOST_TASKS), max(1, min(math.ceil(most / PAIRS_A_TASK), math.ceil(held / POINTS_A_SHARE)))

    def fields(self, struct: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(f"`x` {struct}")[0].dataType]

    def numbered(self, sql: str, columns: dict[str, str]) -> str:
        """A view of a query's rows in which each column holds a number of its sequence for every row."""
        df = self.spark.sql(sql)
        if self.explaining:
            df = df.withColumns({c: F.lit(0).cast("long") for c in columns})
        else:
            df = _indexed(df, "__nextval")
            n = df.count()
            for c, sequence in columns.items():
                first = self.nextval(sequence, n) if n else 0
                df = df.withColumn(c, F.col("__nextval") * self.sequences[sequence]["increment"] + first)
            df = df.drop("__nextval")
        view = f"{self.prefix}_n{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(view)
        return view

    def recursive(self, name: str, columns: list[str], base: str, step: str, cycle: dict | None, earlier: str = "") -> str:
        spark = self.spark

        def run(rows: DataFrame, extra: list[str] = ()):
            rows.createOrReplaceTempView(name)
            if extra:
                path = extra[-1]
                return spark.sql(earlier + re.sub(r"^SELECT (.*?) FROM ", lambda m: f"SELECT {m[1]}, {quoted(name)}.{quoted(path)} FROM ", step, count=1, flags=re.S))
            return spark.sql(earlier + step)

        first, most = spark.sql(base).toDF(*columns), int(self.settings.get("recursion_limit", 0)) or None
        if cycle and "cycle" in cycle:
            out = recursive.with_cycle(first, run, cycle["cycle"], cycle["mark"], cycle["path"], most)
        elif cycle:
            out = recursive.with_search(first, run, cycle["by"], cycle["sequence"], cycle["search"] == "depth", most)
        else:
            out = recursive.fixpoint(first, run, most)
        spark.catalog.dropTempView(name)
        view = f"{self.prefix}_r{uuid.uuid4().hex[:8]}"
        out.createOrReplaceTempView(view)
        return view

    def translate(self, sql: str, params: list[str] | None = None) -> str:
        return Translator(sql, self, params).statement()

    # Statements.

    def query(self, sql: str, *params) -> DataFrame:
        return self.spark.sql(self.translate(sql, [_constant(p) for p in params]))

    def sql(self, script: str, *params) -> Result:
        """Runs a script; the result of its last statement."""
        out = Result("")
        for one in lexer.statements(script):
            out = self.execute(one, [_constant(p) for p in params])
        return out

    def execute(self, sql: str, params: list[str] | None = None) -> Result:
        t = Translator(sql, self, params)
        w = t.word()
        if w in ("select", "with", "values", "table") or t.op() == "(":
            return Result("SELECT", self.spark.sql(t.statement()))
        name = f"do_{w}"
        if w in ("create", "drop", "alter"):
            t.i += 1
            _ = t.take("or", "replace")
            while t.word() in ("temporary", "temp", "unlogged", "unique", "recursive", "constraint"):
                t.i += 1
            kind = t.word()
            t.i += 1
            if kind == "materialized":
                t.i += 1
                kind = "matview"
            if kind == "foreign":
                t.i += 1
                kind = "foreign" if w == "create" else "table"
            name = f"do_{w}_{kind}"
        else:
            t.i += 1
        handler = getattr(self, name, None)
        if handler is None:
            raise SqlError(f"statement is not supported: {sql[:80]}")
        out = handler(t)
        if w not in ("explain", "show", "copy"):
            self.log.append(sql)
        return out

    # DDL.

    def if_exists(self, t: Translator) -> bool:
        return t.take("if", "exists")

    def name(self, t: Translator) -> str:
        path = t.qualified()
        return ".".join(path).removeprefix("public.")

    def do_create_table(self, t: Translator) -> Result:
        maybe = t.take("if", "not", "exists")
        name = self.name(t)
        if name in self.tables or name in self.views:
            if maybe:
                return Result("CREATE TABLE")
            raise SqlError(f'relation "{name}" already exists')
        if t.take("as") or t.word(0) == "as":
            df = self.spark.sql(t.query()[0])
            self.tables[name] = Table([Column(f.name, f.dataType.simpleString()) for f in df.schema])
            n = self.append(name, df)
            return Result(f"SELECT {n}")
        t.need("(")
        table = Table([])
        for _ in t.listed(lambda: self.table_part(t, name, table)):
            pass
        t.need(")")
        if t.take("inherits"):
            t.need("(")
            table.parents = [t.identifier()]
            table.columns = copy.deepcopy(self.tables[table.parents[0]].columns) + table.columns
            t.need(")")
        if t.take("as"):
            df = self.spark.sql(t.query()[0])
            table.columns = [Column(c.name, f.dataType.simpleString()) for c, f in zip(table.columns, df.schema, strict=True)]
            self.tables[name] = table
            self.append(name, df.toDF(*[c.name for c in table.columns]))
            return Result("CREATE TABLE")
        self.tables[name] = table
        return Result("CREATE TABLE")

    def table_part(self, t: Translator, name: str, table: Table) -> None:
        label = None
        if t.take("constraint"):
            label = t.identifier()
        if t.take("primary", "key"):
            columns = self.column_list(t)
            table.keys.append((label or f"{name}_pkey", columns, True))
            for c in table.columns:
                c.not_null |= c.name in columns
        elif t.take("unique"):
            columns = self.column_list(t)
            table.keys.append((label or f"{name}_{'_'.join(columns)}_key", columns, False))
        elif t.take("check"):
            t.need("(")
            table.checks.append((label or f"{name}_check", t.expr().sql))
            t.need(")")
        elif t.take("foreign", "key"):
            columns = self.column_list(t)
            t.need("references")
            table.foreign.append(self.references(t, columns))
        else:
            self.column(t, name, table)

    def column_list(self, t: Translator) -> list[str]:
        t.need("(")
        out = t.listed(t.identifier)
        t.need(")")
        return out

    def references(self, t: Translator, columns: list[str]) -> tuple:
        other = self.name(t)
        theirs = self.column_list(t) if t.op() == "(" else next(k for _, k, p in self.tables[other].keys if p)
        action = "restrict"
        while t.take("on"):
            event = t.next().text.lower()
            what = t.next().text.lower()
            if what in ("set", "no"):
                what += " " + t.next().text.lower()
            if event == "delete":
                action = what
        return columns, other, theirs, action

    def column(self, t: Translator, name: str, table: Table) -> None:
        c = Column(t.identifier(), "")
        raw = t.word()
        kind = t.type_name()
        custom = self.types.get(t.raw_type)
        c.kind = custom["base"] if custom else kind
        if custom and custom.get("check"):
            table.checks.append((f"{t.raw_type}_check", re.sub(r"\bvalue\b", quoted(c.name), custom["check"])))
        if custom and custom.get("labels"):
            table.checks.append((f"{t.raw_type}_enum", f"{quoted(c.name)} IN ({', '.join(map(literal, custom['labels']))})"))
        if raw in ("serial", "bigserial"):
            c.sequence, c.not_null = f"{name}_{c.name}_seq", True
            self.sequences.setdefault(c.sequence, _sequence())
        while t.op() not in (",", ")") and t.now.kind != "end":
            label = t.identifier() if t.take("constraint") else None
            if t.take("not", "null"):
                c.not_null = True
            elif t.take("null"):
                pass
            elif t.take("default"):
                c.default = t.operators().sql if t.word() != "nextval" else self.default_sequence(t, c)
            elif t.take("primary", "key"):
                c.not_null = True
                table.keys.append((label or f"{name}_pkey", [c.name], True))
            elif t.take("unique"):
                table.keys.append((label or f"{name}_{c.name}_key", [c.name], False))
            elif t.take("check"):
                t.need("(")
                t.scopes.append({name: {x.name: kind_of(x.kind) for x in [*table.columns, c]}})
                table.checks.append((label or f"{name}_{c.name}_check", t.expr().sql))
                t.scopes.pop()
                t.need(")")
            elif t.take("references"):
                table.foreign.append(self.references(t, [c.name]))
            elif t.take("generated"):
                while not t.take("identity"):
                    t.i += 1
                c.sequence = f"{name}_{c.name}_seq"
                self.sequences.setdefault(c.sequence, _sequence())
            else:
                t.i += 1
        table.columns.append(c)

    def default_sequence(self, t: Translator, c: Column) -> None:
        t.i += 2
        c.sequence = t.next().text
        if t.take_op("::"):
            t.identifier()
        t.need(")")

    def do_create_view(self, t: Translator) -> Result:
        name = self.name(t)
        columns = self.column_list(t) if t.op() == "(" else []
        if name in self.tables:
            raise SqlError(f'relation "{name}" already exists')
        t.need("as")
        text = t.sql[t.now.at :].rstrip("; ")
        if columns:
            text = f"SELECT * FROM ({text}) AS v({', '.join(columns)})"
        self.translate(text)
        self.views[name] = text
        return Result("CREATE VIEW")

    def do_create_matview(self, t: Translator) -> Result:
        maybe = t.take("if", "not", "exists")
        name = self.name(t)
        if maybe and name in self.tables:
            return Result("CREATE MATERIALIZED VIEW")
        t.need("as")
        text = re.sub(r"\s+with\s+(no\s+)?data\s*$", "", t.sql[t.now.at :].rstrip("; "), flags=re.I)
        empty = re.search(r"\swith\s+no\s+data\s*;?\s*$", t.sql, re.I)
        df = self.query(text)
        self.tables[name] = Table([Column(f.name, f.dataType.simpleString()) for f in df.schema], statement=text)
        if not empty:
            self.append(name, df)
        return Result("CREATE MATERIALIZED VIEW")

    def do_refresh(self, t: Translator) -> Result:
        t.need("materialized")
        t.need("view")
        t.take("concurrently")
        name = self.name(t)
        self.replace(name, self.query(self.tables[name].statement))
        return Result("REFRESH MATERIALIZED VIEW")

    def do_create_sequence(self, t: Translator) -> Result:
        maybe = t.take("if", "not", "exists")
        name = self.name(t)
        if name in self.sequences:
            if maybe:
                return Result("CREATE SEQUENCE")
            raise SqlError(f'relation "{name}" already exists')
        self.sequences[name] = _sequence()
        self.sequence_options(t, name)
        return Result("CREATE SEQUENCE")

    def sequence_options(self, t: Translator, name: str) -> None:
        s, started = self.sequences[name], False
        number = lambda: int(("-" if t.take_op("-") else "") + t.next().text)
        while t.now.kind != "end" and t.op() != ";":
            w = t.next().text.lower()
            if w in ("increment", "start", "restart", "minvalue", "maxvalue", "cache"):
                _ = t.take("by") or t.take("with")
                n = number() if t.now.kind == "number" or t.op() == "-" else s["start"]
                if w == "increment":
                    s["increment"] = n
                    if n < 0 and not started:
                        s["next"] = s["start"] = s["max"] = -1
                elif w in ("start", "restart"):
                    s["next"], started = n, True
                    if w == "start":
                        s["start"] = n
                elif w in ("minvalue", "maxvalue"):
                    s[w[:3]] = n
                    if w == "minvalue" and not started and s["increment"] > 0:
                        s["next"] = s["start"] = n
            elif w == "no":
                w = t.next().text.lower()
                if w == "cycle":
                    s["cycle"] = False
            elif w == "cycle":
                s["cycle"] = True

    def do_alter_sequence(self, t: Translator) -> Result:
        self.if_exists(t)
        self.sequence_options(t, self.name(t))
        return Result("ALTER SEQUENCE")

    def do_create_schema(self, t: Translator) -> Result:
        t.take("if", "not", "exists")
        self.schemas.add(t.identifier())
        return Result("CREATE SCHEMA")

    def do_create_index(self, t: Translator) -> Result:
        """There are no indexes; a unique one is a constraint from now on."""
        unique = " unique " in f" {t.sql.lower()} "
        t.take("concurrently")
        t.take("if", "not", "exists")
        label = t.identifier() if t.word() != "on" else None
        t.need("on")
        name = self.name(t)
        if t.take("using"):
            t.identifier()
        columns = self.column_list(t)
        if unique:
            self.tables[name].keys.append((label or f"{name}_idx", columns, False))
            try:
                self.check_keys(name, self.rows(name))
            except SqlError:
                self.tables[name].keys.pop()
                raise
        return Result("CREATE INDEX")

    def do_create_type(self, t: Translator) -> Result:
        name = self.name(t)
        t.need("as")
        if t.take("enum"):
            t.need("(")
            self.types[name] = {"base": "string", "labels": [x.sql.strip("'") for x in t.listed(t.expr)]}
        elif t.take("range"):
            t.need("(")
            while not t.take("subtype"):
                t.i += 1
            t.need("=")
            sub = t.type_name()
            self.types[name] = {"base": f"struct<lower:{sub},upper:{sub},lower_inc:boolean,upper_inc:boolean>"}
        else:
            t.need("(")
            fields = t.listed(lambda: (t.identifier(), t.type_name()))
            self.types[name] = {"base": f"struct<{','.join(f'{n}:{k}' for n, k in fields)}>"}
        return Result("CREATE TYPE")

    def do_create_domain(self, t: Translator) -> Result:
        name = self.name(t)
        t.take("as")
        base, check = t.type_name(), None
        while t.now.kind != "end" and t.op() != ";":
            if t.take("check"):
                t.need("(")
                check = t.expr().sql
                t.need(")")
            elif t.take("not", "null"):
                check = f"({check} AND value IS NOT NULL)" if check else "value IS NOT NULL"
            else:
                t.i += 1
        self.types[name] = {"base": base, "check": check}
        return Result("CREATE DOMAIN")

    def do_create_extension(self, t: Translator) -> Result:
        t.take("if", "not", "exists")
        self.extensions.add(t.identifier())
        return Result("CREATE EXTENSION")

    def do_create_function(self, t: Translator) -> Result:
        """A function in SQL becomes Spark's own, with its arguments bound by name, so Catalyst inlines it."""
        name = self.name(t)
        t.need("(")
        args = t.listed(lambda: self.function_argument(t))
        t.need(")")
        kind, columns, body, language, rows = "string", None, "", "sql", None
        while t.now.kind != "end" and t.op() != ";":
            if t.take("returns", "table"):
                t.need("(")
                columns = t.listed(lambda: (t.identifier(), t.type_name()))
                t.need(")")
            elif t.take("returns"):
                several = t.take("setof")
                kind = t.type_name()
                rows = [(name, kind)] if several else None
                if several and kind.startswith("struct<"):
                    rows = self.fields(kind)
            elif t.take("language"):
                language = t.next().text.lower()
            elif t.take("as"):
                body = t.next().text
            elif t.take("return"):
                body = "SELECT " + t.sql[t.now.at :].rstrip("; ")
                t.i = len(t.tokens) - 1
            else:
                t.i += 1
        if language == "plpgsql":
            from tidemark.plans import procedural

            return procedural.create_function(self, name, args, kind, body, columns or rows)
        if language != "sql":
            raise SqlError(f'language "{language}" does not exist')
        inner = Translator(body.strip().rstrip(";"), self, [quoted(a) for a, _ in args])
        inner.variables = {a: Expr(quoted(a), kind_of(k), a) for a, k in args}
        sql = inner.statement()
        head = f"CREATE OR REPLACE TEMPORARY FUNCTION {self.prefix}_{name}({', '.join(f'{quoted(a)} {k}' for a, k in args)})"
        returns = f"TABLE({', '.join(f'{quoted(c)} {k}' for c, k in columns)})" if columns else kind
        self.spark.sql(f"{head} RETURNS {returns} RETURN {sql if columns else '(' + sql + ')'}")
        self.functions[name] = {"kind": kind_of(kind), "table": bool(columns), "args": args}
        return Result("CREATE FUNCTION")

    def function_argument(self, t: Translator) -> tuple[str, str]:
        _ = t.take("in") or t.take("inout") or t.take("variadic")
        back = t.i
        name = t.identifier()
        if t.op() in (",", ")", "["):
            t.i = back
            return f"arg{back}", t.type_name()
        kind = t.type_name()
        if t.take("default") or t.take_op("="):
            t.expr()
        return name, kind

    def do_do(self, t: Translator) -> Result:
        from tidemark.plans import procedural

        procedural.run_block(self, next(x.text for x in t.tokens if x.kind == "string"))
        return Result("DO")

    def do_create_trigger(self, t: Translator) -> Result:
        from tidemark.plans import triggers

        label = t.identifier()
        is_before = t.next().text.lower() == "before"
        events = {t.next().text.lower()}
        while t.take("or"):
            events.add(t.next().text.lower())
        t.need("on")
        name = self.name(t)
        while not t.take("execute"):
            t.i += 1
        t.i += 1
        f = t.identifier()
        if "body" not in self.functions.get(f, {}):
            raise SqlError(f"function {f}() does not exist or has no body of PL/pgSQL")
        made = triggers.made(label, is_before, events, f, self.functions[f]["body"])
        table = self.tables[name] = copy.copy(self.tables[name])
        table.triggers = [*table.triggers, made]
        return Result("CREATE TRIGGER")

    def do_drop_trigger(self, t: Translator) -> Result:
        self.if_exists(t)
        label = t.identifier()
        t.need("on")
        name = self.name(t)
        table = self.tables[name] = copy.copy(self.tables[name])
        table.triggers = [x for x in table.triggers if x.name != label]
        return Result("DROP TRIGGER")

    def fire(self, table: Table, event: str, rows: DataFrame, is_before: bool) -> DataFrame:
        """What the table's triggers make of changed rows."""
        from tidemark.plans import triggers

        for x in table.triggers:
            if x.before == is_before and event in x.events:
                if is_before:
                    rows = triggers.before(self, x, rows, event)
                else:
                    triggers.after(self, x, rows, event)
        return rows

    def do_create_server(self, t: Translator) -> Result:
        name = t.identifier()
        while not t.take("wrapper"):
            t.i += 1
        self.sources[name] = (t.identifier(), self.options(t))
        return Result("CREATE SERVER")

    def do_drop_server(self, t: Translator) -> Result:
        return self.dropped(t, "server", self.sources)

    def do_create_foreign(self, t: Translator) -> Result:
        """A foreign table reads through Spark's data source of its server's wrapper, or of any format that Spark knows."""
        name, table = self.name(t), Table([])
        t.need("(")
        t.listed(lambda: self.table_part(t, name, table))
        t.need(")")
        t.need("server")
        wrapper, options = self.sources[t.identifier()]
        df = self.spark.read.format(wrapper).options(**options, **self.options(t)).load()
        table.source = df.select(*(F.col(f"`{c.name}`").cast(c.kind).alias(c.name) for c in table.columns))
        self.tables[name] = table
        return Result("CREATE FOREIGN TABLE")

    def options(self, t: Translator) -> dict[str, str]:
        if not t.take("options"):
            return {}
        t.need("(")
        out = dict(t.listed(lambda: (t.identifier(), t.next().text)))
        t.need(")")
        return out

    def do_create_cast(self, t: Translator) -> Result:
        return Result("CREATE CAST")

    def do_create_policy(self, t: Translator) -> Result:
        label = t.identifier()
        t.need("on")
        name, command, using, check = self.name(t), "all", None, None
        t.scopes.append({name: self.columns(name)})
        while t.now.kind != "end" and t.op() != ";":
            if t.take("for"):
                command = t.next().text.lower()
            elif t.take("using"):
                using = t.expr().sql
            elif t.take("with", "check"):
                check = t.expr().sql
            else:
                t.i += 1
        self.tables[name].policies.append((label, command, using, check))
        return Result("CREATE POLICY")

    def do_create_role(self, t: Translator) -> Result:
        name = t.identifier()
        if name in self.roles:
            raise SqlError(f'role "{name}" already exists')
        self.roles[name] = "superuser" in t.sql[t.now.at :].lower().split()
        return Result("CREATE ROLE")

    do_create_user = do_create_role

    def do_drop_role(self, t: Translator) -> Result:
        maybe = self.if_exists(t)
        name = t.identifier()
        if self.roles.pop(name, None) is None and not maybe:
            raise SqlError(f'role "{name}" does not exist')
        self.grants = {g for g in self.grants if g[0] != name}
        self.members = {m for m in self.members if name not in m}
        return Result("DROP ROLE")

    do_drop_user = do_drop_role

    def granted(self, t: Translator, end: str) -> tuple[set, set]:
        """What a GRANT or REVOKE names: (role, table, privilege) and (role, member)."""
        words = []
        while t.word() not in ("on", end):
            if t.op() == "(":  # columns: the privilege is taken for the table
                t.i += 1
                while not t.take_op(")"):
                    t.i += 1
            else:
                words.append(t.next().text.lower())
        words = [w for w in words if w not in (",", "privileges")]
        names = []
        if t.take("on"):
            schema = bool(t.take("schema"))
            t.take("table")
            names = [f"schema {x}" if schema else x for x in t.listed(lambda: self.name(t))]
            for x in names:
                if not schema and x not in self.tables and x not in self.views:
                    raise SqlError(f'relation "{x}" does not exist')
        t.need(end)
        to = t.listed(t.identifier)
        if unknown := [r for r in to if r not in self.roles and r != "public"]:
            raise SqlError(f'role "{unknown[0]}" does not exist')
        if names:
            every = ("select", "insert", "update", "delete", "truncate", "references", "trigger", "usage", "create")
            return {(r, x, w) for r in to for x in names for w in (every if words == ["all"] else words)}, set()
        return set(), {(w, r) for r in to for w in words}

    def do_grant(self, t: Translator) -> Result:
        rights, members = self.granted(t, "to")
        self.grants |= rights
        self.members |= members
        return Result("GRANT")

    def do_revoke(self, t: Translator) -> Result:
        rights, members = self.granted(t, "from")
        self.grants -= rights
        self.members -= members
        return Result("REVOKE")

    def may(self, role: str, name: str, rights: str) -> bool:
        """Whether a role holds one of the privileges, itself, as a member of another or as one of all."""
        own, todo = {role, "public"}, [role]
        while todo:
            r = todo.pop()
            new = {g for g, m in self.members if m == r} - own
            own |= new
            todo += new
        if any(self.roles.get(r) for r in own):
            return True
        return any((r, name, w.strip().split(" ")[0]) in self.grants for r in own for w in rights.lower().split(","))

    do_listen = lambda self, t: Result("LISTEN")
    do_notify = lambda self, t: Result("NOTIFY")
    do_unlisten = lambda self, t: Result("UNLISTEN")
    do_analyze = lambda self, t: Result("ANALYZE")
    def do_vacuum(self, t: Translator) -> Result:
        """Deletes the files of versions that no table and no savepoint holds; DataFrames made of those versions can't be read after it."""
        if self.saves:
            raise SqlError("VACUUM cannot run inside a transaction block")
        live = {recursive.plain(p) for table in self.tables.values() for p in table.parts}
        for folder in sorted(self.written):
            at = recursive.plain(folder)
            if at in live:
                continue
            files = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            store = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
            kept = False
            for x in store.listStatus(files) if store.exists(files) else []:
                name = recursive.plain(x.getPath().toString())
                if name in live or x.getPath().toUri().getPath() in {p.removeprefix("file://") for p in live}:
                    kept = True
                else:
                    store.delete(x.getPath(), True)
            if not kept:
                store.delete(files, True)
                self.written.discard(folder)
        return Result("VACUUM")

    do_discard = lambda self, t: Result("DISCARD")

    def dropped(self, t: Translator, kind: str, where: dict | set) -> Result:
        maybe = self.if_exists(t)
        while True:
            name = self.name(t)
            if name not in where and not maybe:
                raise SqlError(f'{kind} "{name}" does not exist')
            if kind == "table" and not t.sql.lower().rstrip("; ").endswith("cascade"):
                needs = [n for n, o in self.tables.items() if n != name and any(f[1] == name for f in o.foreign)] + [v for v, text in self.views.items() if re.search(rf"\b{re.escape(name)}\b", text)]
                if needs:
                    raise SqlError(f"cannot drop table {name} because other objects depend on it: {', '.join(needs)}")
            elif kind == "table":
                for v in [v for v, text in self.views.items() if re.search(rf"\b{re.escape(name)}\b", text)]:
                    del self.views[v]
            if isinstance(where, set):
                where.discard(name)
            else:
                where.pop(name, None)
            if t.take_op("("):
                t.i = len(t.tokens) - 1
            if not t.take_op(","):
                return Result(f"DROP {kind.upper()}")

    def do_drop_table(self, t: Translator) -> Result:
        return self.dropped(t, "table", self.tables)

    def do_drop_view(self, t: Translator) -> Result:
        return self.dropped(t, "view", self.views)

    def do_drop_matview(self, t: Translator) -> Result:
        return self.dropped(t, "materialized view", self.tables)

    def do_drop_sequence(self, t: Translator) -> Result:
        return self.dropped(t, "sequence", self.sequences)

    def do_drop_schema(self, t: Translator) -> Result:
        return self.dropped(t, "schema", self.schemas)

    def do_drop_type(self, t: Translator) -> Result:
        return self.dropped(t, "type", self.types)

    do_drop_domain = do_drop_type

    def do_drop_function(self, t: Translator) -> Result:
        return self.dropped(t, "function", self.functions)

    def do_drop_extension(self, t: Translator) -> Result:
        return self.dropped(t, "extension", self.extensions)

    def do_drop_index(self, t: Translator) -> Result:
        self.if_exists(t)
        name = self.name(t)
        for table in self.tables.values():
            table.keys = [k for k in table.keys if k[0] != name]
        return Result("DROP INDEX")

    def do_alter_view(self, t: Translator) -> Result:
        self.if_exists(t)
        name = self.name(t)
        t.need("rename")
        t.need("to")
        self.views[t.identifier()] = self.views.pop(name)
        return Result("ALTER VIEW")

    def do_alter_table(self, t: Translator) -> Result:
        self.if_exists(t)
        t.take("only")
        name = self.name(t)
        table = self.tables[name] = copy.deepcopy(self.tables[name]) if self.tables[name].source is None else copy.copy(self.tables[name])
        while True:
            self.alteration(t, name, table)
            if not t.take_op(","):
                return Result("ALTER TABLE")

    def alteration(self, t: Translator, name: str, table: Table) -> None:
        old = self.rows(name)
        find = lambda c: next(x for x in table.columns if x.name == c)
        if t.take("add"):
            if t.word() in ("constraint", "primary", "unique", "check", "foreign"):
                t.scopes.append({name: self.columns(name)})
                self.table_part(t, name, table)
                self.check(name, old)
                return
            t.take("column")
            t.take("if", "not", "exists")
            n = len(table.columns)
            self.column(t, name, table)
            c = table.columns[n]
            self.replace(name, old.withColumn(c.name, F.expr(c.default or "null").cast(c.kind)))
        elif t.take("drop"):
            if t.take("constraint"):
                label = t.identifier()
                table.keys = [k for k in table.keys if k[0] != label]
                table.checks = [k for k in table.checks if k[0] != label]
                return
            t.take("column")
            self.if_exists(t)
            c = t.identifier()
            _ = t.take("cascade") or t.take("restrict")
            table.columns = [x for x in table.columns if x.name != c]
            table.keys = [k for k in table.keys if c not in k[1]]
            self.replace(name, old.drop(c))
        elif t.take("rename"):
            if t.take("to"):
                self.tables[t.identifier()] = self.tables.pop(name)
                return
            t.take("column")
            a = t.identifier()
            t.need("to")
            b = t.identifier()
            find(a).name = b
            table.keys = [(k, [b if x == a else x for x in cols], p) for k, cols, p in table.keys]
            self.replace(name, old.withColumnRenamed(a, b))
        elif t.take("alter"):
            t.take("column")
            c = find(t.identifier())
            if t.take("set", "default"):
                c.default = t.expr().sql
            elif t.take("drop", "default"):
                c.default = None
            elif t.take("set", "not", "null"):
                c.not_null = True
                self.check(name, old)
            elif t.take("drop", "not", "null"):
                c.not_null = False
            else:
                t.take("set", "data")
                t.need("type")
                c.kind = t.type_name()
                t.scopes.append({name: {f.name: kind_of(f.dataType.simpleString()) for f in old.schema}})
                value = F.expr(t.expr().sql) if t.take("using") else F.col(c.name)
                self.replace(name, old.withColumn(c.name, value.cast(c.kind)))
        elif t.take("enable") or t.take("force"):
            table.secured = True
            t.i = len(t.tokens) - 1
        elif t.take("disable"):
            table.secured = False
            t.i = len(t.tokens) - 1
        else:
            t.i = len(t.tokens) - 1

    # Versions and constraints.

    def append(self, name: str, df: DataFrame) -> int:
        table = self.tables[name]
        df = df.select(*(F.col(f"`{c.name}`").cast(c.kind).alias(c.name) for c in table.columns))
        at = f"{recursive.shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(at)
        new = copy.copy(table)
        new.parts = [*table.parts, at]
        self.tables[name] = new
        self.written.add(at)
        return self.spark.read.parquet(at).count()

    def replace(self, name: str, df: DataFrame, keep: list[str] = ()) -> None:
        """The next version of a table: files that are kept, and df."""
        table = self.tables[name]
        df = df.select(*(F.col(f"`{c.name}`").cast(c.kind).alias(c.name) for c in table.columns))
        at = f"{recursive.shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(at)
        self.adopt(name, [*keep, at])

    def adopt(self, name: str, parts: list[str]) -> None:
        """The next version of a table, of files that are there; columns that aren't the table's are not read."""
        new = copy.copy(self.tables[name])
        new.parts, new.source = list(parts), None
        self.tables[name] = new
        self.written |= {p for p in parts if p.rsplit("/", 1)[-1].startswith(("table-", "next-"))}

    def of_files(self, name: str, files: list[str]) -> DataFrame:
        kinds = T.StructType.fromDDL(", ".join(f"{quoted(c.name)} {c.kind}" for c in self.tables[name].columns))
        return self.spark.read.schema(kinds).parquet(*files) if files else self.spark.createDataFrame([], kinds)

    def reached(self, name: str, hits) -> tuple[DataFrame, list[str]]:
        """(rows of the files that hold a hit, the other files): hits makes of a table's rows those that a statement may change.

        What statements rewrite is counted in files, whose names the driver holds; a table that isn't stored here is one piece.
        """
        table = self.tables[name]
        if table.source is not None or not table.parts or table.columns and any(c.name == "_metadata" for c in table.columns):
            return self.rows(name), []
        rows = self.rows(name)
        every = [recursive.plain(f) for f in rows.inputFiles()]
        if len(every) < 2:
            return rows, []
        found = {recursive.plain(r[0]) for r in hits(rows.withColumn("__file", F.col("_metadata.file_path"))).select("__file").distinct().collect()}  # a row for each file
        if not found <= set(every):
            return rows, []
        return self.of_files(name, [f for f in every if f in found]), [f for f in every if f not in found]

    def check_keys(self, name: str, rows: DataFrame) -> None:
        for label, columns, _ in self.tables[name].keys:
            some = rows.filter(" and ".join(f"{quoted(c)} is not null" for c in columns)).groupBy(*columns).count().filter("count > 1")
            if not some.isEmpty():
                raise SqlError(f'duplicate key value violates unique constraint "{label}"')

    def check(self, name: str, rows: DataFrame) -> None:
        """Fails if rows, as a next version of the table, break a constraint: one aggregate for row rules, one plan for each key."""
        self.check_rules(name, rows, rows)
        self.check_keys(name, rows)

    def check_new(self, name: str, new: DataFrame) -> None:
        """The same for rows that are added: only they are read for row rules, and old rows only by their keys."""
        old = self.rows(name)
        self.check_rules(name, new, old.unionByName(new))
        self.check_keys(name, new)
        for label, columns, _ in self.tables[name].keys:
            if not new.join(old.select(*columns), columns, "left_semi").isEmpty():
                raise SqlError(f'duplicate key value violates unique constraint "{label}"')

    def check_changed(self, name: str, changed: DataFrame, whole: DataFrame, columns: set[str]) -> None:
        """The same for an update of some columns: keys are read only if one of their columns was set."""
        self.check_rules(name, changed, whole)
        if any(columns & set(k) for _, k, _ in self.tables[name].keys):
            self.check_keys(name, whole)

    def check_rules(self, name: str, rows: DataFrame, whole: DataFrame) -> None:
        """NOT NULL, CHECK and foreign keys of rows; `whole` is the table as it will be, for keys into itself."""
        table = self.tables[name]
        rules = [(f'null value in column "{c.name}" violates not-null constraint', f"{quoted(c.name)} is null") for c in table.columns if c.not_null]
        rules += [(f'new row violates check constraint "{label}"', f"not ({sql})") for label, sql in table.checks]
        if rules:
            broken = rows.agg(*(F.count_if(F.coalesce(F.expr(bad), F.lit(False))).alias(f"r{k}") for k, (_, bad) in enumerate(rules))).first()
            for k, (what, _) in enumerate(rules):
                if broken[k]:
                    raise SqlError(what)
        for columns, other, theirs, _ in table.foreign:
            parent = whole if other == name else self.rows(other)
            on = [F.col(f"c.`{a}`") == F.col(f"p.`{b}`") for a, b in zip(columns, theirs, strict=True)]
            lost = rows.filter(" and ".join(f"{quoted(c)} is not null" for c in columns)).alias("c").join(parent.alias("p"), on, "left_anti")
            if not lost.isEmpty():
                raise SqlError(f'insert or update on table "{name}" violates foreign key constraint')

    def follow_deletes(self, name: str, gone: DataFrame) -> None:
        """Foreign keys of other tables on deleted rows: cascade, set null or refuse."""
        for other, table in list(self.tables.items()):
            for columns, parent, theirs, action in table.foreign:
                if parent != name:
                    continue
                rows = self.rows(other)
                on = [F.col(f"c.`{a}`") == F.col(f"p.`{b}`") for a, b in zip(columns, theirs, strict=True)]
                hit = rows.alias("c").join(gone.alias("p"), on, "left_semi")
                if hit.isEmpty():
                    continue
                if action == "cascade":
                    hit = recursive.stored(hit, "gone")
                    self.replace(other, rows.alias("c").join(gone.alias("p"), on, "left_anti"))
                    self.follow_deletes(other, hit)
                elif action == "set null":
                    keyed = gone.select(*(F.col(b).alias(f"__{a}") for a, b in zip(columns, theirs, strict=True))).distinct().withColumn("__hit", F.lit(True))
                    met = rows.join(keyed, [F.col(a) == F.col(f"__{a}") for a in columns], "left")
                    self.replace(other, met.select(*(F.when(F.col("__hit"), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns)))
                else:
                    raise SqlError(f'update or delete on table "{name}" violates foreign key constraint on table "{other}"')

    # DML.

    def returning(self, t: Translator, rows: DataFrame, name: str, alias: str, tag: str, n: int) -> Result:
        if not t.take("returning"):
            return Result(f"{tag} {n}")
        text = t.sql[t.now.at :].rstrip("; ")
        view = f"{self.prefix}_ret{uuid.uuid4().hex[:8]}"
        recursive.stored(rows, "returning").createOrReplaceTempView(view)
        self.tables[view] = Table([Column(f.name, f.dataType.simpleString()) for f in rows.schema], source=self.spark.table(view))
        try:
            return Result(f"{tag} {n}", self.query(f"SELECT {text} FROM {view} AS {alias}"))
        finally:
            del self.tables[view]

    def writable(self, name: str) -> str:
        name = self.local(name)
        if name in self.views:
            m = re.fullmatch(r"\s*select\s+\*\s+from\s+(\w+)\s*", self.views[name], re.I)
            if not m:
                raise SqlError(f'cannot change view "{name}"')
            return m[1]
        return name

    def do_insert(self, t: Translator) -> Result:
        t.need("into")
        name = self.writable(self.name(t))
        table = self.tables[name]
        alias = t.identifier() if t.take("as") else name
        columns = self.column_list(t) if t.op() == "(" and t.word(1) not in ("select", "with", "values") else [c.name for c in table.columns]
        if t.take("overriding"):
            t.i += 2
        if t.take("default", "values"):
            df = self.spark.range(1).select()
            columns = []
        elif t.word() == "values":
            df = self.insert_values(t, table, columns)
            columns = df.columns
        else:
            df = self.spark.sql(t.query()[0])
            columns = columns[: len(df.columns)]
            df = df.toDF(*columns)
        if unknown := set(columns) - {c.name for c in table.columns}:
            raise SqlError(f'column "{unknown.pop()}" of relation "{name}" does not exist')
        conflict = None
        if t.take("on", "conflict"):
            conflict = self.conflict(t, table, alias)
        df = self.filled(table, df, name)
        df = recursive.stored(self.fire(table, "insert", df, True), "new")
        for _, command, using, check in table.policies if table.secured and self.role != "postgres" else ():
            if command in ("all", "insert") and not df.filter(f"not coalesce({check or using}, false)").isEmpty():
                raise SqlError(f'new row violates row-level security policy for table "{name}"')
        if conflict is None:
            self.check_new(name, df)
            n = self.append(name, df)
            self.fire(table, "insert", df, False)
            return self.returning(t, df, name, alias, "INSERT 0", n)
        keys, sets, where = conflict
        if not keys:
            keys = table.keys[0][1]
        new = recursive.stored(dml.insert_on_conflict(self.rows(name), df, keys, sets, where, alias), "next")
        self.check(name, new)
        changed = new.filter("__changed").drop("__changed")
        self.replace(name, new.drop("__changed"))
        return self.returning(t, changed, name, alias, "INSERT 0", changed.count())

    def insert_values(self, t: Translator, table: Table, columns: list[str]) -> DataFrame:
        t.i += 1
        kinds, rows = {c.name: c for c in table.columns}, []
        while True:
            t.need("(")
            row = t.listed(lambda: None if t.take("default") else t.expr())
            t.need(")")
            rows.append(row)
            if not t.take_op(","):
                break
        columns = columns[: max(map(len, rows))]

        def value(c: str, e: Expr | None) -> str:
            kind = kinds[c].kind if c in kinds else "string"
            if e is None:
                return f"{self.nextval(kinds[c].sequence)}L" if kinds[c].sequence else f"cast({kinds[c].default or 'null'} as {kind})"
            if kind.startswith("array<") and e.sql.startswith("'"):
                return f"cast({t.vector(e) if e.sql.startswith(chr(39) + '[') else t.array(e)} as {kind})"
            return f"cast({e.sql} as {kind})"

        lines = [f"SELECT {', '.join(f'{value(c, e)} AS {quoted(c)}' for c, e in zip(columns, r, strict=True))}" for r in rows]
        return self.spark.sql(" UNION ALL ".join(lines))

    def filled(self, table: Table, df: DataFrame, name: str) -> DataFrame:
        """Columns that an INSERT leaves out get their defaults; sequences hand out a block of numbers."""
        out = df
        for c in table.columns:
            if c.name in df.columns:
                continue
            if c.sequence:
                n = df.count()
                first, step = self.nextval(c.sequence, max(1, n)), self.sequences[c.sequence]["increment"]
                if n <= 1:
                    out = out.withColumn(c.name, F.lit(first))
                else:
                    out = _indexed(out, c.name).withColumn(c.name, F.lit(first) + F.col(c.name) * step)
            else:
                out = out.withColumn(c.name, F.expr(c.default or "null"))
        return out.select(*(F.col(f"`{c.name}`").cast(c.kind).alias(c.name) for c in table.columns))

    def conflict(self, t: Translator, table: Table, alias: str) -> tuple[list[str], dict | None, str | None]:
        keys: list[str] = []
        if t.op() == "(":
            keys = self.column_list(t)
            if not any(set(k) == set(keys) for _, k, _ in table.keys):
                raise SqlError("there is no unique or exclusion constraint matching the ON CONFLICT specification")
        elif t.take("on", "constraint"):
            label = t.identifier()
            keys = next(k for n, k, _ in table.keys if n == label)
        t.need("do")
        if t.take("nothing"):
            return keys, None, None
        t.need("update")
        t.need("set")
        own = {c.name: kind_of(c.kind) for c in table.columns}
        t.scopes.append({"excluded": own, alias: own})
        sets = self.assignments(t, alias)
        where = self.owned(t.expr().sql, alias, own) if t.take("where") else None
        t.scopes.pop()
        return keys, {c: self.owned(v, alias, own) for c, v in sets.items()}, where

    @staticmethod
    def owned(sql: str, alias: str, columns: dict) -> str:
        """Bare columns of an ON CONFLICT expression belong to the table."""
        return re.sub(r"(?<![\w.`'])([a-z_]\w*)(?![\w.(`'])", lambda m: f"{alias}.{m[1]}" if m[1] in columns else m[0], sql)

    def assignments(self, t: Translator, alias: str) -> dict[str, str]:
        out: dict[str, str] = {}
        while True:
            if t.op() == "(":
                names = self.column_list(t)
                t.need("=")
                if t.op() == "(" and t.word(1) in ("select", "with"):
                    t.i += 1
                    sql, inner = t.query()
                    t.need(")")
                    one = [f"__c{k}" for k in range(len(inner))]
                    out |= {n: f"(SELECT {c} FROM ({sql}) AS __one({', '.join(one)}))" for n, c in zip(names, one, strict=True)}
                else:
                    t.take("row")
                    t.need("(")
                    out |= dict(zip(names, [e.sql for e in t.listed(t.expr)], strict=True))
                    t.need(")")
            else:
                c = t.qualified()[-1]
                if t.op() == "[":
                    key = t.subscript(Expr(quoted(c), "json"))
                    path = re.findall(r"\[\"?(\w+)\"?\]", key.sql)
                    t.need("=")
                    out[c] = f"pg_jsonb_set({quoted(c)}, array({', '.join(map(literal, path))}), {t.expr().sql}, true)"
                else:
                    t.need("=")
                    out[c] = "__default" if t.take("default") else t.expr().sql
            if not t.take_op(","):
                return out

    def other_rows(self, t: Translator, scope: dict) -> tuple[DataFrame | None, str]:
        """The relations of FROM or USING as one DataFrame: under its alias if it is one, else a structure for each, which reads like an alias."""
        inner: dict = {}
        source = t.from_clause(inner)
        scope.update(inner)
        if len(inner) == 1:
            alias = next(iter(inner))
            return self.spark.sql(f"SELECT {quoted(alias)}.* FROM {source}"), alias
        return self.spark.sql(f"SELECT {', '.join(f'struct({quoted(a)}.*) AS {quoted(a)}' for a in inner)} FROM {source}"), "__source"

    def do_update(self, t: Translator) -> Result:
        t.take("only")
        name = self.writable(self.name(t))
        table, rows = self.tables[name], self.rows(name)
        alias = t.identifier() if t.take("as") or t.word() != "set" else name
        t.need("set")
        scope = {alias: self.columns(name)}
        t.scopes.append(scope)
        start = t.i
        sets = self.assignments(t, alias) if not self.has_from(t) else None
        source, source_alias = None, "s"
        if sets is None:
            while t.word() != "from":
                t.i += 1
            t.i += 1
            source, source_alias = self.other_rows(t, scope)
            after, t.i = t.i, start
            sets = self.assignments(t, alias)
            t.i = after
        where = t.expr().sql if t.take("where") else None
        defaults = {c.name: c.default or "null" for c in table.columns}
        sets = {c: defaults[c] if v == "__default" else v for c, v in sets.items()}
        if unknown := set(sets) - set(defaults):
            raise SqlError(f'column "{unknown.pop()}" of relation "{name}" does not exist')
        keep = []
        if source is None and any("SELECT" in v for v in [*sets.values(), where or ""]):
            new = self.update_by_sql(rows, alias, sets, where)
        else:
            where = self.secured(name, "update", where)
            if where and not any(x.before for x in table.triggers):
                rows, keep = self.reached(name, lambda r: dml.hits(r, alias, where, source, source_alias))
            new = dml.update(rows, alias, sets, where, source, source_alias)
        if any(x.before and "update" in x.events for x in table.triggers):
            hit = self.fire(table, "update", new.filter("__changed").drop("__changed"), True).withColumn("__changed", F.lit(True))
            new = new.filter("not __changed").unionByName(hit)
        new, at = recursive.stored_at(new, "next")
        changed = new.filter("__changed").drop("__changed")
        whole = new.drop("__changed")
        self.check_changed(name, changed, whole.unionByName(self.of_files(name, keep)) if keep else whole, set(sets) if not table.triggers else set(defaults))
        self.adopt(name, [*keep, at])
        self.fire(table, "update", changed, False)
        return self.returning(t, changed, name, alias, "UPDATE", changed.count())

    def update_by_sql(self, rows: DataFrame, alias: str, sets: dict[str, str], where: str | None) -> DataFrame:
        """An UPDATE whose expressions hold subqueries, which Spark plans in SQL only."""
        view = f"{self.prefix}_u{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(view)
        columns = ", ".join(f"CASE WHEN __changed THEN cast({sets[c]} AS {rows.schema[c].dataType.simpleString()}) ELSE {alias}.{quoted(c)} END AS {quoted(c)}" if c in sets else f"{alias}.{quoted(c)}" for c in rows.columns)
        return self.spark.sql(f"SELECT {columns}, __changed FROM (SELECT {alias}.*, coalesce({where or 'true'}, false) AS __changed FROM {view} AS {alias}) AS {alias}")

    def secured(self, name: str, command: str, where: str | None) -> str | None:
        table = self.tables[name]
        if not table.secured or self.role == "postgres":
            return where
        passing = [f"({u})" for _, c, u, _ in table.policies if c in ("all", command) and u]
        rule = " or ".join(passing) or "false"
        return f"({where}) and ({rule})" if where else rule

    @staticmethod
    def has_from(t: Translator) -> bool:
        depth, k = 0, t.i
        while t.tokens[k].kind != "end":
            x = t.tokens[k]
            depth += (x.kind == "op") * ((x.text in "([") - (x.text in ")]"))
            if not depth and x.kind == "word" and x.text.lower() in ("where", "returning"):
                return False
            if not depth and x.kind == "word" and x.text.lower() == "from" and t.tokens[k - 1].text.lower() != "distinct":
                return True
            k += 1
        return False

    def do_delete(self, t: Translator) -> Result:
        t.need("from")
        t.take("only")
        name = self.writable(self.name(t))
        rows = self.rows(name)
        alias = t.identifier() if t.take("as") or t.word() not in ("using", "where", "returning", "") else name
        scope = {alias: self.columns(name)}
        t.scopes.append(scope)
        source, source_alias = self.other_rows(t, scope) if t.take("using") else (None, "s")
        where = t.expr().sql if t.take("where") else None
        if source is None and where and "SELECT" in where:
            marked = self.update_by_sql(rows, alias, {}, where)
            stay, gone = marked.filter("not __changed").drop("__changed"), marked.filter("__changed").drop("__changed")
            keep = []
        else:
            where, keep = self.secured(name, "delete", where), []
            if where:
                rows, keep = self.reached(name, lambda r: dml.hits(r, alias, where, source, source_alias))
            stay, gone = dml.delete(rows, alias, where, source, source_alias)
        gone = recursive.stored(gone, "gone")
        n = gone.count()
        if n:
            saved = dict(self.tables)
            self.replace(name, stay, keep)
            try:
                self.follow_deletes(name, gone)
            except SqlError:
                self.tables = saved
                raise
            self.fire(saved[name], "delete", gone, False)
        return self.returning(t, gone, name, alias, "DELETE", n)

    def do_truncate(self, t: Translator) -> Result:
        t.take("table")
        t.take("only")
        while True:
            name = self.name(t)
            new = copy.copy(self.tables[self.local(name)])
            new.parts, new.source = [], None
            self.tables[name] = new
            if not t.take_op(","):
                break
        if t.take("restart", "identity"):
            for c in new.columns:
                if c.sequence:
                    self.sequences[c.sequence]["next"] = self.sequences[c.sequence]["start"]
        return Result("TRUNCATE TABLE")

    def do_merge(self, t: Translator) -> Result:
        t.need("into")
        t.take("only")
        name = self.writable(self.name(t))
        rows, table = self.rows(name), self.tables[name]
        alias = t.identifier() if t.take("as") or t.word() != "using" else name
        t.need("using")
        scope = {alias: self.columns(name)}
        source, source_alias = self.other_rows(t, scope)
        t.scopes.append(scope)
        t.need("on")
        on = t.expr().sql
        clauses = []
        names = [c.name for c in table.columns]
        while t.take("when"):
            if t.take("not", "matched"):
                kind = "extra" if t.take("by", "source") else "missing"
                t.take("by", "target")
            else:
                t.need("matched")
                kind = "matched"
            c = dml.Clause(kind, "nothing")
            if t.take("and"):
                c.condition = t.expr().sql
            t.need("then")
            if t.take("update"):
                t.need("set")
                c.action, c.sets = "update", self.assignments(t, alias)
            elif t.take("delete"):
                c.action = "delete"
            elif t.take("insert"):
                c.action = "insert"
                columns = self.column_list(t) if t.op() == "(" else names
                c.sets = {x.name: x.default for x in table.columns if x.default}
                if not t.take("default", "values"):
                    t.need("values")
                    t.need("(")
                    values = t.listed(lambda: "__default" if t.take("default") else t.expr().sql)
                    t.need(")")
                    c.sets |= {k: v for k, v in zip(columns, values, strict=True) if v != "__default"}
            else:
                t.need("do")
                t.need("nothing")
            clauses.append(c)
        keep = []
        if not any(c.kind == "extra" for c in clauses):  # rows that meet no source row stay as they are
            rows, keep = self.reached(name, lambda r: dml.hits(r, alias, on, source, source_alias))
        new, at = recursive.stored_at(dml.merge(rows, alias, source, source_alias, on, clauses), "next")
        stay = new.filter("__action is null or __action <> 'delete'").drop("__action")
        changed = new.filter("__action is not null")
        self.check_rules(name, changed.filter("__action <> 'delete'").drop("__action"), stay.unionByName(self.of_files(name, keep)) if keep else stay)
        self.check_keys(name, stay.unionByName(self.of_files(name, keep)) if keep else stay)
        if any(c.action == "delete" for c in clauses):
            self.replace(name, stay, keep)
        else:
            self.adopt(name, [*keep, at])
        return self.returning(t, changed.withColumnRenamed("__action", "merge_action"), name, alias, "MERGE", changed.count())

    # Sessions.

    def state(self) -> dict:
        return {"tables": dict(self.tables), "views": dict(self.views), "sequences": copy.deepcopy(self.sequences), "types": dict(self.types), "functions": dict(self.functions)}

    def restore(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, copy.deepcopy(v) if k == "sequences" else dict(v))

    def do_begin(self, t: Translator) -> Result:
        if not self.saves:
            self.saves.append((None, self.state()))
        return Result("BEGIN")

    do_start = do_begin

    def do_commit(self, t: Translator) -> Result:
        self.saves.clear()
        return Result("COMMIT")

    do_end = do_commit

    def do_rollback(self, t: Translator) -> Result:
        _ = t.take("transaction") or t.take("work")
        if t.take("to"):
            t.take("savepoint")
            label = t.identifier()
            k = max(i for i, (n, _) in enumerate(self.saves) if n == label)
            self.restore(self.saves[k][1])
            del self.saves[k + 1 :]
        elif self.saves:
            self.restore(self.saves[0][1])
            self.saves.clear()
        return Result("ROLLBACK")

    def do_savepoint(self, t: Translator) -> Result:
        if not self.saves:
            raise SqlError("SAVEPOINT can only be used in transaction blocks")
        self.saves.append((t.identifier(), self.state()))
        return Result("SAVEPOINT")

    def do_release(self, t: Translator) -> Result:
        t.take("savepoint")
        label = t.identifier()
        k = max(i for i, (n, _) in enumerate(self.saves) if n == label)
        del self.saves[k:]
        return Result("RELEASE")

    def do_set(self, t: Translator) -> Result:
        _ = t.take("session") or t.take("local")
        if t.take("role") or t.take("authorization"):
            self.role = "postgres" if t.word() == "none" else t.next().text
            return Result("SET")
        name = ".".join(t.qualified())
        _ = t.take("to") or t.take_op("=") or t.take("zone")
        self.settings[name.lower()] = t.sql[t.now.at :].strip("; '")
        if name.lower() == "recursion_limit":
            self.limit_recursion(int(self.settings[name.lower()]))
        return Result("SET")

    def do_reset(self, t: Translator) -> Result:
        if t.take("role"):
            self.role = "postgres"
        elif not t.take("all"):
            self.settings.pop(t.identifier(), None)
        return Result("RESET")

    def do_show(self, t: Translator) -> Result:
        name = t.identifier()
        if name == "all":
            return Result("SHOW", self.spark.createDataFrame(sorted(self.settings.items()), "name string, setting string"))
        return Result("SHOW", self.spark.createDataFrame([(self.settings.get(name, ""),)], f"{quoted(name)} string"))

    def do_explain(self, t: Translator) -> Result:
        if t.take_op("("):
            while not t.take_op(")"):
                t.i += 1
        options, k = t.sql[: t.now.at].lower(), t.i
        while t.word() in ("analyze", "verbose"):
            t.i += 1
        analyze = "analyze" in options or "analyze" in t.sql[t.tokens[k].at : t.now.at].lower()
        self.explaining = not analyze
        try:
            df = self.query(t.sql[t.now.at :])
        finally:
            self.explaining = False
        took = ""
        if analyze:  # the query is run, its rows are not kept
            began, seen = time.time(), Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            took = f"\nActual rows: {seen.get['rows']}\nExecution time: {(time.time() - began) * 1000:.1f} ms"
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") + took
        return Result("EXPLAIN", self.spark.createDataFrame([(x,) for x in text.split("\n")], "`QUERY PLAN` string"))

    def do_prepare(self, t: Translator) -> Result:
        name = t.identifier()
        if t.op() == "(":
            while not t.take_op(")"):
                t.i += 1
        t.need("as")
        self.prepared[name] = t.sql[t.now.at :].rstrip("; ")
        return Result("PREPARE")

    def do_execute(self, t: Translator) -> Result:
        name, args = t.identifier(), []
        if t.take_op("("):
            args = [e.sql for e in t.listed(t.expr)]
        return self.execute(self.prepared[name], args)

    def do_deallocate(self, t: Translator) -> Result:
        self.prepared.pop(t.identifier(), None)
        return Result("DEALLOCATE")

    def do_copy(self, t: Translator) -> Result:
        from tidemark.sources import readers

        if t.take_op("("):
            df = self.spark.sql(t.query()[0])
            t.need(")")
            name, columns = None, df.columns
        else:
            name = self.name(t)
            columns = self.column_list(t) if t.op() == "(" else [c.name for c in self.tables[self.local(name)].columns]
            df = self.rows(name).select(*columns)
        to = t.take("to")
        if not to:
            t.need("from")
        path, options = t.next().text, {}
        _ = t.take("with")
        if t.take_op("("):
            for k, v in t.listed(lambda: (t.identifier(), t.next().text if t.op() not in (",", ")") else "true")):
                options[k] = v
        elif t.take("csv"):
            options["format"] = "csv"
            if t.take("header"):
                options["header"] = "true"
        if to:
            readers.copy_to(df, path, options)
            return Result("COPY", None)
        table = self.tables[self.local(name)]
        kinds = {c.name: c.kind for c in table.columns}
        new = readers.copy_from(self.spark, path, {c: kinds[c] for c in columns}, options)
        new = recursive.stored(self.filled(table, new, name), "copied")
        self.check_new(name, new)
        return Result(f"COPY {self.append(name, new)}")

    # Other surfaces.

    def json(self, sql: str) -> str:
        """Columns and rows of a query as JSON text."""
        try:
            r = self.sql(sql)
            rows = [json.loads(x) for x in r.df.toJSON().collect()] if r.df is not None else []
            return json.dumps({"ok": True, "tag": r.tag, "columns": r.df.columns if r.df is not None else [], "rows": rows})
        except Exception as e:  # noqa: BLE001  the caller gets every failure as text
            return json.dumps({"ok": False, "error": str(e)})

    def arrow(self, sql: str):
        """A query's result as an Arrow table."""
        return self.sql(sql).df.toArrow()

    def export_state(self) -> str:
        return json.dumps(self.log)

    def import_state(self, text: str) -> None:
        for sql in json.loads(text):
            self.execute(sql)

    def similarity_search(self, table: str, column: str, vector: list[float], k: int, metric: str = "<->") -> DataFrame:
        return self.query(f"SELECT *, {quoted(column)} {metric} '[{', '.join(map(str, vector))}]' AS distance FROM {table} ORDER BY distance LIMIT {k}")

    def list_tables(self) -> DataFrame:
        return self.query("select table_schema, table_name, table_type from information_schema.tables order by 1, 2")

    def describe_table(self, name: str) -> DataFrame:
        return self.query("select column_name, data_type, is_nullable, column_default from information_schema.columns where table_name = $1 order by ordinal_position", name)

    def load_url(self, name: str, location: str, *path: str) -> None:
        """A JSON, CSV or Parquet file as a table."""
        from tidemark.sources import readers

        kind = location.split("?")[0].rsplit(".", 1)[-1].lower()
        read = {"csv": readers.csv_scan, "parquet": readers.parquet_scan}.get(kind)
        self.register(name, read(self.spark, location) if read else readers.json_table(self.spark, location, *path))

    def load_iceberg(self, name: str, location: str) -> None:
        from tidemark.sources import iceberg

        self.register(name, iceberg.scan(self.spark, location))

    def reset(self) -> None:
        """Forgets all objects of this engine."""
        self.__init__(self.spark)

    def system_relation(self, name: str) -> DataFrame | None:
        from tidemark import system

        return system.relation(self, name)


def _constant(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else literal(str(value))


def _sequence() -> dict:
    return {"next": 1, "start": 1, "increment": 1, "min": 1, "max": None, "cycle": False, "current": None}


def _indexed(df: DataFrame, name: str) -> DataFrame:
    """Numbers from 0 in partition order; only one count for each partition meets in one task."""
    from pyspark.sql import Window

    own = recursive.stored(df.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    ends = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    ends = ends.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = own.withColumn("__part", part).join(F.broadcast(ends), "__part")  # a row for each partition
    return out.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__n", "__before")
