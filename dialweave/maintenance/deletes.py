"""Deleting rows together with what refers to them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.operators.joins import having, lacking
from dialweave.operators.sketches import is_small, narrowed, parted, together
from dialweave.session import freeze
from dialweave.sources.schema import TABLES, Table, conform
from dialweave.sources.tables import Tables


class Deleted(NamedTuple):
    tables: Tables
    missing: DataFrame
    removed: dict[str, DataFrame]
    deleted: DataFrame


def _rules(table: Table, overrides: dict[tuple[str, str], str]) -> list[tuple[str, str, str]]:
    return [
        (r.column, r.parent, overrides.get((table.name, r.column), r.on_delete)) for r in table.references
    ]


def _forget(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Empty a reference to removed rows."""
    gone = gone.select(F.col(gone.columns[0]).alias("__gone"))
    joined = rows.join(gone, F.col(column) == F.col("__gone"), "left")
    return joined.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


def _disjoint(rows: DataFrame, cascades: list[tuple[str, DataFrame]]) -> list[DataFrame]:
    """Removed rows by cause, each row under its first cause only."""
    parts = []
    for column, gone in cascades:
        parts.append(having(rows, column, gone, gone.columns[0], unique=True))
        rows = lacking(rows, column, gone, gone.columns[0], unique=True)
    return parts


def delete(
    tables: Tables,
    name: str,
    keys: DataFrame,
    fk_rules: dict[tuple[str, str], str] | None = None,
    small: bool | None = None,
) -> Deleted:
    """Remove rows by key; references follow their rule, transitively.

    ``keys`` has the table's key, or several of its columns that must all match.
    ``fk_rules`` overrides a rule: ``{(table, column): "CASCADE" | "SET NULL"}``.
    Returns the affected tables exchanged, the keys that matched nothing, the keys
    removed per table, and the deleted rows of the table itself.

    Tables are visited parents first, so a table's removed keys are known before its
    children are looked at. Removed keys are unique; the children, which may repeat
    one key any number of times, stay on the splittable side of every join. With few keys
    (``small``, by default a count decides) rows that none can name are not shuffled.
    """
    small = is_small(keys, small)
    overrides = fk_rules or {}
    target = TABLES[name]
    base = conform(tables[name], target)
    on = keys.columns
    wanted = keys.dropDuplicates()
    deleted = narrowed(base, on[0], wanted, on[0], small).join(wanted, on, "left_semi")
    # keys that sketches are made of are read several times for each child, so they are written once
    settled = freeze if small else lambda keys: keys
    removed = {name: settled(deleted.select(target.key))}
    known = narrowed(base.select(*on), on[0], wanted, on[0], small).distinct()
    missing = wanted.join(known, on, "left_anti")
    met, rest = parted(base, [(target.key, removed[name], target.key)], small)
    result = {name: together(lacking(met, target.key, removed[name], target.key, unique=True), rest)}

    for table in TABLES.values():  # registered parents first
        if table.name == name:
            continue
        hit = [(c, p, rule) for c, p, rule in _rules(table, overrides) if p in removed]
        if not hit:
            continue
        whole = conform(tables[table.name], table)
        rows, rest = parted(whole, [(c, removed[p], removed[p].columns[0]) for c, p, _ in hit], small)
        cascades = [(c, removed[p]) for c, p, rule in hit if rule == "CASCADE"]
        kept = reduce(
            lambda left, step: lacking(left, step[0], step[1], step[1].columns[0], unique=True), cascades, rows
        )
        for column, parent, rule in hit:
            if rule == "SET NULL":
                kept = _forget(kept, column, removed[parent])
        result[table.name] = together(kept, rest)
        if cascades:
            narrow = rows.select(table.key, *[c for c, _ in cascades])
            parts = [p.select(table.key) for p in _disjoint(narrow, cascades)]
            removed[table.name] = settled(reduce(DataFrame.unionByName, parts))
    return Deleted(tables.replaced(**result), missing, removed, deleted)
