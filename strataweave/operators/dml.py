"""Inserts, updates, deletes and merges as functions that return the new table, and constraint checks.

Tables are immutable: every statement is a DataFrame of the table afterwards,
to be written or to replace a view. Checks return the rows that break a rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The table with ``rows`` added. Columns that ``rows`` lacks take their default, or null."""
    given = {c: F.col(f"`{c}`") for c in rows.columns}
    unknown = set(rows.columns) - set(table.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    defaults = defaults or {}
    cast = [given.get(f.name, F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionByName(rows.select(*cast))


def insert_values(spark: SparkSession, table: DataFrame, records: Sequence[Mapping[str, object]], batch_size: int = 5000) -> DataFrame:
    """The table with literal records added, sent to Spark in batches."""
    out = table
    for i in range(0, len(records), batch_size):
        part = [tuple(r.get(c) for c in table.columns) for r in records[i : i + batch_size]]
        out = out.unionByName(spark.createDataFrame(part, table.schema))
    return out


def with_identity(table: DataFrame, rows: DataFrame, column: str, order: Sequence[str], increment: int = 1, seed: int = 1) -> DataFrame:
    """``rows`` with ``column`` numbered on from the table's last value, in the given order; from ``seed`` in an empty table.

    New rows are numbered by prefix sums over range partitions, not in one task.
    Columns of ``rows`` may have any names.
    """
    from strataweave.operators.aggregates import _running_counts

    last = table.agg((F.max if increment > 0 else F.min)(F.col(f"`{column}`"))).first()[0]
    before = seed - increment if last is None else last
    kept = [F.col(f"`{c}`") for c in rows.columns if c != column]
    keyed = rows.select(F.struct(*kept).alias("row"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("v"))
    placed, _ = _running_counts(keyed.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.lit(0)))
    number = F.lit(before) + (F.col("upto") - F.col("n") + nth) * increment
    return keyed.join(placed, keyed["v"].eqNullSafe(placed["v"])).drop(placed["v"]).select("row.*", number.cast("long").alias(column))


def update(table: DataFrame, assign: Mapping[str, Column | object], where: Column | None = None) -> DataFrame:
    """The table with columns set where the condition holds; where it is null or false nothing changes.

    All new values are computed from the row before the update.
    """
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in assign.items()}
    return table.select(*(F.when(hit, new[f.name]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in table.schema))


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """The table without the rows for which the condition is true; all rows without a condition."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def delete_first(table: DataFrame, order: Sequence[Column], n: int, key: Sequence[str], where: Column | None = None) -> DataFrame:
    """DELETE ... ORDER BY ... LIMIT n: ``key`` identifies rows, ``order`` must be total."""
    chosen = (table if where is None else table.where(where)).orderBy(*order).limit(n).select(*key)
    return table.join(chosen, list(key), "left_anti").select(*table.columns)


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def replace_into(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert of whole rows: old rows with a key of ``rows`` go, all of ``rows`` come. Null keys replace nothing."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def merge(table: DataFrame, source: DataFrame, key: Sequence[str], matched: Mapping[str, Column] | None = None, matched_delete: Column | None = None, insert_new: bool = True) -> DataFrame:
    """MERGE: update or delete matched rows, insert the others.

    ``matched`` maps columns to expressions over ``t.<column>`` and ``s.<column>``.
    Keys must be unique in ``source``. One full outer join.
    """
    t, s = table.withColumn("in_t", F.lit(True)).alias("t"), source.withColumn("in_s", F.lit(True)).alias("s")
    cond = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    both = t.join(s, on, "full" if insert_new else "left")
    hit = F.col("t.in_t").isNotNull() & F.col("s.in_s").isNotNull()
    if matched_delete is not None:
        both = both.where(~(hit & F.coalesce(matched_delete, F.lit(False))))
    matched = matched or {}
    out = []
    for f in table.schema:
        old, new = F.col(f"t.{f.name}"), F.col(f"s.{f.name}") if f.name in source.columns else F.lit(None).cast(f.dataType)
        value = F.when(hit, matched[f.name]).otherwise(F.when(F.col("t.in_t").isNull(), new).otherwise(old)) if f.name in matched else F.when(F.col("t.in_t").isNull(), new).otherwise(old)
        out.append(value.cast(f.dataType).alias(f.name))
    return both.select(*out)


@dataclass(frozen=True)
class When:
    """A clause of MERGE: ``kind`` is matched, not_matched or not_matched_by_source; ``action`` update, insert, delete or nothing.

    Conditions and values are expressions over the aliases of both tables.
    """

    kind: str
    action: str
    condition: Column | None = None
    values: Mapping[str, Column] = field(default_factory=dict)


def merge_into(table: DataFrame, source: DataFrame, on: Column, clauses: Sequence[When], alias: str = "t", source_alias: str = "s") -> DataFrame:
    """MERGE with conditions: the table's columns, and ``change_`` (null, update, insert or delete) and ``old_`` (the row before).

    Of the clauses of its kind the first whose condition is true applies to a row;
    without one, rows of the table stay and rows of the source are left out. Deleted
    rows are among the result, marked. Columns without a value are null in inserted
    rows. Each row of the table may match one row of the source; see :func:`merge_conflicts`.
    """
    t = table.withColumn("in_table_", F.lit(True)).alias(alias)
    s = source.withColumn("in_source_", F.lit(True)).alias(source_alias)
    both = t.join(s, on, "full" if any(c.action == "insert" for c in clauses) else "left")
    in_t, in_s = F.col(f"{alias}.in_table_").isNotNull(), F.col(f"{source_alias}.in_source_").isNotNull()
    kinds = {"matched": in_t & in_s, "not_matched": ~in_t & in_s, "not_matched_by_source": in_t & ~in_s}
    which = F.lit(-1)
    for i, c in reversed(list(enumerate(clauses))):
        hit = kinds[c.kind] & (F.lit(True) if c.condition is None else F.coalesce(c.condition, F.lit(False)))
        which = F.when(hit, i).otherwise(which)
    change = F.lit(None).cast("string")
    for i, c in enumerate(clauses):
        if c.action != "nothing":
            change = F.when(F.col("which_") == i, c.action).otherwise(change)
    out = []
    for f in table.schema:
        value = F.col(f"{alias}.`{f.name}`")
        for i, c in enumerate(clauses):
            if f.name in c.values:
                value = F.when(F.col("which_") == i, c.values[f.name]).otherwise(value)
        out.append(value.cast(f.dataType).alias(f.name))
    old = F.when(in_t, F.struct(*(F.col(f"{alias}.`{c}`") for c in table.columns)))
    return both.withColumn("which_", which).where(in_t | F.coalesce(change == "insert", F.lit(False))).select(*out, change.alias("change_"), old.alias("old_"))


def merge_conflicts(table: DataFrame, source: DataFrame, on: Column, alias: str = "t", source_alias: str = "s") -> DataFrame:
    """Rows of the table that match more than one row of the source, by all their columns."""
    row = F.to_json(F.struct(*(F.col(f"{alias}.`{c}`") for c in table.columns)), {"ignoreNullFields": "false"})
    numbered = table.withColumn("row_", F.monotonically_increasing_id()).alias(alias)
    return numbered.join(source.alias(source_alias), on).groupBy(F.col(f"{alias}.row_"), row.alias("row")).count().where("count > 1")


def key_violations(table: DataFrame, key: Sequence[str], primary: bool = True) -> DataFrame:
    """``key..., n``: keys that occur more than once; for a primary key also keys with a null, for UNIQUE these are allowed."""
    n = table.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    return n.where(null | (F.col("n") > 1)) if primary else n.where(~null & (F.col("n") > 1))


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    known = parent.select(F.col(key).alias("known_")).distinct()
    return child.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("known_"), "left_anti")


def restricted(parent: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """Parent rows that may not be deleted or re-keyed because a child refers to them."""
    used = child.select(F.col(column).alias("used_")).distinct()
    return parent.join(used, F.col(key) == F.col("used_"), "left_semi")


def check_violations(table: DataFrame, rules: Mapping[str, Column], name: str = "broken") -> DataFrame:
    """Rows that break a rule, with the names of the broken rules in column ``name``. A rule that is null is kept, as in SQL."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())))
    return table.withColumn(name, broken).where(F.size(name) > 0)
