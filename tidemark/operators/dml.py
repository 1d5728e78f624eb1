"""Row changes as plans: every function takes a table's rows and gives its next version.

A changed row is computed, never edited: UPDATE is a projection, DELETE an anti join or a filter, MERGE and
ON CONFLICT one join with a chain of conditions. Rows are told apart by a number that Spark gives while it
reads the stored version, so nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.recursive import stored


@dataclass
class Clause:
    """One WHEN of a MERGE: kind is matched, missing (not matched by target) or extra (not matched by source)."""

    kind: str
    action: str  # update, insert, delete, nothing
    condition: str | None = None
    sets: dict[str, str] = field(default_factory=dict)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def hits(table: DataFrame, alias: str, where: str | None, source: DataFrame | None = None, source_alias: str = "s") -> DataFrame:
    """The rows that a condition, with or without a source, reaches."""
    if source is None:
        return table.alias(alias).filter(where or "true")
    return table.alias(alias).join(source.alias(source_alias), F.expr(where or "true"), "left_semi")


def update(table: DataFrame, alias: str, sets: dict[str, str], where: str | None, source: DataFrame | None = None, source_alias: str = "s") -> DataFrame:
    """Rows of the next version with __changed: true for those that the update reached. With a source, a row changes by one of the source rows that it meets."""
    if source is None:
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        out = table.alias(alias).withColumn("__changed", hit)
        return out.select(*(F.when(F.col("__changed"), F.expr(sets[c]).cast(table.schema[c].dataType)).otherwise(F.col(f"{alias}.`{c}`")).alias(c) if c in sets else F.col(f"{alias}.`{c}`").alias(c) for c in table.columns), "__changed")
    numbered = _numbered(table, "__rid")
    own = source.withColumn("__met", F.lit(True))
    joined = numbered.alias(alias).join(own.alias(source_alias), F.expr(where or "true"), "left")
    new = [F.when(F.col("__met"), F.expr(sets[c]).cast(table.schema[c].dataType)).otherwise(F.col(f"{alias}.`{c}`")).alias(c) if c in sets else F.col(f"{alias}.`{c}`").alias(c) for c in table.columns]
    return joined.select(F.col("__rid"), *new, F.coalesce("__met", F.lit(False)).alias("__changed")).dropDuplicates(["__rid"]).drop("__rid")


def delete(table: DataFrame, alias: str, where: str | None, source: DataFrame | None = None, source_alias: str = "s") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go)."""
    if source is None:
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        marked = table.alias(alias).withColumn("__gone", hit)
        return marked.filter("not __gone").drop("__gone"), marked.filter("__gone").drop("__gone")
    left, right, on = table.alias(alias), source.alias(source_alias), F.expr(where or "true")
    return left.join(right, on, "left_anti"), left.join(right, on, "left_semi")


def insert_on_conflict(table: DataFrame, new: DataFrame, keys: list[str], sets: dict[str, str] | None, where: str | None = None, alias: str = "t") -> DataFrame:
    """Next version with __changed. New rows that meet an old one by keys are dropped, or update it (sets over alias and excluded)."""
    first = new.dropDuplicates(keys)
    null_key = " or ".join(f"`{k}` is null" for k in keys)
    free = new.filter(null_key)  # null keys conflict with nothing
    first = first.filter(f"not ({null_key})")
    on = [F.col(f"{alias}.`{k}`") == F.col(f"excluded.`{k}`") for k in keys]
    both = table.withColumn("__old", F.lit(True)).alias(alias).join(first.withColumn("__new", F.lit(True)).alias("excluded"), on, "full_outer")
    clash = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    hit = clash & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)) & F.lit(bool(sets))
    columns = []
    for c in table.columns:
        old, fresh = F.col(f"{alias}.`{c}`"), F.col(f"excluded.`{c}`")
        changed = F.expr(sets[c]).cast(table.schema[c].dataType) if sets and c in sets else old
        columns.append(F.when(hit, changed).when(F.col("__old").isNotNull(), old).otherwise(fresh).alias(c))
    out = both.select(*columns, (hit | F.col("__old").isNull()).alias("__changed"))
    return out.unionByName(free.select(*table.columns, F.lit(True).alias("__changed")))


def merge(table: DataFrame, alias: str, source: DataFrame, source_alias: str, on: str, clauses: list[Clause]) -> DataFrame:
    """Next version with __action (update, insert, delete or null); deleted rows are still in it. Fails if a row would change twice."""
    left, right = _numbered(table, "__rid"), _numbered(source, "__sid")
    how = "full_outer" if any(c.kind == "missing" and c.action == "insert" for c in clauses) else "left"
    both = left.alias(alias).join(right.alias(source_alias), F.expr(on), how)
    state = F.when(F.col("__rid").isNull(), "missing").when(F.col("__sid").isNull(), "extra").otherwise("matched")
    both = both.withColumn("__state", state)
    place: Column = F.lit(None).cast("int")
    for k, c in reversed([*enumerate(clauses)]):
        hit = (F.col("__state") == c.kind) & (F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True))
        place = F.when(hit, F.lit(k)).otherwise(place)
    both = both.withColumn("__place", place)
    columns = []
    for c in table.columns:
        value = F.col(f"{alias}.`{c}`")
        for k, clause in enumerate(clauses):
            if clause.action == "insert":
                value = F.when(F.col("__place") == k, F.expr(clause.sets.get(c, "null")).cast(table.schema[c].dataType)).otherwise(value)
            elif clause.action == "update" and c in clause.sets:
                value = F.when(F.col("__place") == k, F.expr(clause.sets[c]).cast(table.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    action = F.element_at(F.array(*(F.lit(c.action if c.action != "nothing" else None) for c in clauses)), F.col("__place") + 1)
    out = both.select(*columns, "__rid", F.when(F.col("__place").isNotNull(), action).alias("__action"), "__state")
    out = stored(out.filter("__state <> 'missing' or __action = 'insert'"), "merged")  # the join is read twice
    new = out.filter("__state <> 'matched'").drop("__rid", "__state")
    old = out.filter("__state = 'matched'").groupBy("__rid").agg(
        F.count_if(F.col("__action").isin("update", "delete")).alias("__n"),
        F.max_by(F.struct(*table.columns, "__action"), F.when(F.col("__action").isNotNull(), 1).otherwise(0)).alias("r"),
    )
    twice = F.when(F.col("__n") > 1, F.raise_error(F.lit("MERGE command cannot affect row a second time"))).otherwise(F.col("r.__action"))
    return old.select(*(F.col(f"r.`{c}`").alias(c) for c in table.columns), twice.alias("__action")).unionByName(new)


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """The table after change rows (insert, update, delete, truncate) in `order`: the last change of each key wins."""
    cut = changes.filter(F.col(op) == "truncate").agg(F.max(F.struct(*order)).alias("__cut"))
    last = changes.filter(F.col(op) != "truncate").crossJoin(F.broadcast(cut))  # one row
    last = last.filter("__cut is null or struct(" + ", ".join(f"`{c}`" for c in order) + ") > __cut")
    latest = last.groupBy(*keys).agg(F.max_by(F.struct(op, *(c for c in table.columns)), F.struct(*order)).alias("r"))
    kept = table.crossJoin(F.broadcast(cut)).filter("__cut is null").drop("__cut")
    same = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]
    old = kept.alias("t").join(latest.select(*keys).alias("c"), same, "left_anti")
    return old.unionByName(latest.filter(F.col(f"r.`{op}`") != "delete").select(*(F.col(f"r.`{c}`").alias(c) for c in table.columns)))
