"""Row triggers as plans: a PL/pgSQL body over NEW and OLD becomes columns of the changed rows, or statements over all of them.

BEFORE bodies that assign to NEW's columns, branch, raise, and return NEW or NULL become expressions; others without
queries (variables, loops) run row by row on the executors. AFTER bodies that branch and hold INSERT .. VALUES run once
over all changed rows as INSERT .. SELECT; others run on the driver, a row after another, for MOST_ROWS changed rows of a
statement at most (`SET row_trigger_limit = n`). BEFORE bodies with queries are refused when the trigger is made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.procedural import Block, changed_record, is_pure, run_block
from tidemark.plans.translate import Translator, kind_of


MOST_ROWS = 10_000


@dataclass
class Trigger:
    name: str
    before: bool
    events: set[str]
    function: str
    row_wise: bool = False  # a body that is no plan


def made(name: str, before: bool, events: set[str], function: str, body: str) -> Trigger:
    try:
        found = steps(body)
        if before or all(s.kind in ("insert", "keep") and (s.kind != "insert" or _INSERT.fullmatch(s.text.strip())) for s in found):
            return Trigger(name, before, events, function)
    except SyntaxError:
        if before and not is_pure(body):
            raise
    return Trigger(name, before, events, function, True)


@dataclass
class Step:
    kind: str  # set, keep, drop, raise, insert
    column: str = ""
    text: str = ""
    condition: str = "true"


def steps(body: str) -> list[Step]:
    """A body's actions with the condition under which each runs."""
    b = Block(None, body.strip())
    if b.take("declare"):
        raise SyntaxError("variables in trigger bodies are not supported")
    b.need("begin")
    out: list[Step] = []

    def block(condition: str, *ends: str) -> None:
        while b.word() not in ends and b.tokens[b.i].kind != "end":
            if b.take("if"):
                passed = condition
                while True:
                    test = b.until("then")
                    b.need("then")
                    block(f"({passed}) and ({test})", "elsif", "elseif", "else", "end")
                    passed = f"({passed}) and not coalesce(({test}), false)"
                    if b.take("elsif") or b.take("elseif"):
                        continue
                    if b.take("else"):
                        block(passed, "end")
                    b.need("end", "if", ";")
                    break
            elif b.word() == "new" and b.word(1) == "." and b.word(3) in (":=", "="):
                column = b.word(2)
                b.i += 4
                out.append(Step("set", column, b.until(";"), condition))
                b.need(";")
            elif b.take("return"):
                what = b.until(";").lower()
                b.need(";")
                out.append(Step("drop" if what == "null" else "keep", condition=condition))
            elif b.take("raise"):
                b.take("exception")
                out.append(Step("raise", text=b.until(";"), condition=condition))
                b.need(";")
            elif b.word() == "insert":
                out.append(Step("insert", text=b.until(";"), condition=condition))
                b.need(";")
            else:
                raise SyntaxError(f"not supported in a trigger body: {b.until(';')[:60]}")

    block("true", "end")
    return out


_INSERT = re.compile(r"(insert\s+into\s+[\w.]+\s*(?:\([^)]*\))?)\s*values\s*\((.*)\)", re.I | re.S)


def _before_rows(body: str, rows: DataFrame, event: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in batch.to_pylist():
                out = changed_record(body, None if event == "delete" else row, row if event != "insert" else None, event)
                if out is not None:
                    kept.append(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in kept], f.type) for f in batch.schema], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def _after_rows(engine, body: str, rows: DataFrame, event: str) -> None:
    most = int(engine.settings.get("row_trigger_limit", MOST_ROWS))
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"an AFTER trigger that is no INSERT .. VALUES runs for {most} rows of a statement at most: SET row_trigger_limit")
    for r in rows.toLocalIterator():
        row = r.asDict()
        run_block(engine, body, {"new": None if event == "delete" else row, "old": row if event != "insert" else None, "tg_op": event.upper()})


def _expression(engine, sql: str, columns: dict[str, str], event: str) -> str:
    """An expression over new.x and old.x as one over columns `new.x` and `old.x` of the joined rows."""
    sql = re.sub(r"\btg_op\b", f"'{event.upper()}'", sql, flags=re.I)
    t = Translator(sql, engine)
    t.scopes = [{"new": columns, "old": columns}]
    return t.expr().sql


def before(engine, trigger: Trigger, rows: DataFrame, event: str) -> DataFrame:
    """Rows as a BEFORE trigger leaves them. OLD is not kept for updates here: its columns read as NEW's before the body ran."""
    if trigger.row_wise:
        return _before_rows(engine.functions[trigger.function]["body"], rows, event)
    kinds = {f.name: kind_of(f.dataType.simpleString()) for f in rows.schema}
    out, names, done = rows, rows.columns, "false"
    for c in names:
        out = out.withColumn(f"__old_{c}", F.col(f"`{c}`"))

    def bound(sql: str) -> str:
        sql = _expression(engine, sql, kinds, event)
        return re.sub(r"\bold\.(\w+)", r"__old_\1", re.sub(r"\bnew\.(\w+)", r"\1", sql))

    for s in steps(engine.functions[trigger.function]["body"]):
        test = f"(not ({done}) and coalesce({bound(s.condition)}, false))"
        if s.kind == "set":
            out = out.withColumn(s.column, F.expr(f"case when {test} then cast({bound(s.text)} as {rows.schema[s.column].dataType.simpleString()}) else `{s.column}` end"))
        elif s.kind == "raise":
            message = re.match(r"'((?:[^']|'')*)'", s.text)
            out = out.withColumn(names[0], F.expr(f"case when {test} then cast(raise_error('{(message[1] if message else s.text)}') as {rows.schema[names[0]].dataType.simpleString()}) else `{names[0]}` end"))
        elif s.kind == "drop":
            out = out.filter(f"not {test}")
        if s.kind in ("drop", "keep"):
            out = out.withColumn("__done", F.expr(f"({done}) or {test}"))
            done = "__done"
    return out.select(*names)


def after(engine, trigger: Trigger, rows: DataFrame, event: str) -> None:
    """Runs an AFTER trigger's statements over all changed rows at once."""
    if trigger.row_wise:
        _after_rows(engine, engine.functions[trigger.function]["body"], rows, event)
        return
    view = f"{engine.prefix}_changed"
    engine.register(view, rows)
    try:
        for s in steps(engine.functions[trigger.function]["body"]):
            condition = re.sub(r"\btg_op\b", f"'{event.upper()}'", s.condition, flags=re.I)
            if not re.search(r"\b(new|old)\.", condition, re.I) and not engine.query(f"select {condition}").first()[0]:
                continue  # not for this event
            if s.kind == "insert":
                m = _INSERT.fullmatch(s.text.strip())
                alias = "old" if event == "delete" else "new"
                values = re.sub(r"\btg_op\b", f"'{event.upper()}'", m[2], flags=re.I)
                engine.execute(f"{m[1]} select {values} from {view} as {alias} where {condition}")
    finally:
        del engine.tables[view]
