"""Adding rows: defaults, validation, references, uniqueness, keys, stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialweave.functions import falsy_default, falsy_null, pinned, run_time
from dialweave.maintenance.changes import (
    Change,
    accept_first,
    last_key,
    number_rows,
    positioned,
    split_accepted,
    stamp_entry,
    unique_value,
    with_reason,
)
from dialweave.maintenance.quality import failures, rules_for
from dialweave.operators.joins import attach, having, lacking
from dialweave.operators.sketches import is_small, narrowed
from dialweave.sources.schema import TABLES, Table, conform, evolve, redact
from dialweave.sources.tables import Tables

# Kinds of rows that arrive under another name than their table.
KINDS = {"registrations": "employees"}

# Value combinations that may occur once.
PAIRS = {"empteamdtl": (("teamno_fk", "empno_fk"),)}


def _unique_keys(table: Table) -> list[tuple[str, ...]]:
    return [(c,) for c in table.unique] + list(PAIRS.get(table.name, ()))


def _defaults(kind: str, table: Table, run_ts) -> dict[str, Column]:
    values = {c: F.lit(v) for c, v in table.defaults.items()}
    if table.name == "employees":
        values["joindate"] = run_time(run_ts)
    if kind == "registrations":
        values["username"] = falsy_null("emailidoffical")
    return values


def _with_defaults(batch: DataFrame, kind: str, table: Table, run_ts) -> DataFrame:
    """Empty text counts as absent; absent values get the column's default."""
    kinds = {f.name: f.dataType for f in table.struct.fields}
    text = [c for c, t in kinds.items() if isinstance(t, T.StringType) and c in batch.columns]
    batch = batch.withColumns({c: falsy_null(c) for c in text})
    filled = {}
    for column, value in _defaults(kind, table, run_ts).items():
        is_text = isinstance(kinds[column], T.StringType)
        default = falsy_default(column, value) if is_text else F.coalesce(F.col(column), value)
        filled[column] = default.cast(kinds[column])
    return batch.withColumns(filled)


def _reject_if(rows: DataFrame, broken: Column, reason: str) -> DataFrame:
    return rows.withColumn(
        "reasons", F.when(broken, F.array_append("reasons", F.lit(reason))).otherwise(F.col("reasons"))
    )


def _check_references(rows: DataFrame, table: Table, tables: Tables, small: bool) -> DataFrame:
    for ref in table.references:
        parent = TABLES[ref.parent]
        known = narrowed(tables[ref.parent], parent.key, rows, ref.column, small)
        rows = attach(rows, known, ref.column, parent.key, {"__parent": parent.key})
        missing = F.col(ref.column).isNotNull() & F.col("__parent").isNull()
        rows = _reject_if(rows, missing, f"{ref.column} not found").drop("__parent")
    return rows


def _check_existing(rows: DataFrame, base: DataFrame, keys: dict[str, tuple], small: bool) -> DataFrame:
    for name, columns in keys.items():
        held = base.select(unique_value(columns, dict(base.dtypes)).alias("__held"))
        held = narrowed(held.where(F.col("__held").isNotNull()), "__held", rows, name, small).distinct()
        rows = attach(rows, held, name, "__held", {"__taken": "__held"})
        rows = _reject_if(rows, F.col("__taken").isNotNull(), f"{'+'.join(columns)} exists").drop("__taken")
    return rows


def ingest(
    tables: Tables,
    kind: str,
    batch: DataFrame,
    run_ts=None,
    user: int | None = None,
    order_by: list[str] | None = None,
    small: bool | None = None,
) -> Change:
    """Add a batch to a table.

    ``kind`` is a table name or ``registrations`` (employees whose user name defaults
    to their email). Rows are taken in ``order_by`` order (default: the batch's own
    columns), which decides key order and who wins a duplicate inside the batch.
    Rejected rows keep their values and list the ``reasons``. ``small`` tells whether the
    batch is to be sketched, so that tables it names few rows of are not shuffled; by
    default a count decides.
    """
    table = TABLES[KINDS.get(kind, kind)]
    run_ts = pinned(run_ts)
    small = is_small(batch, small)
    base = conform(tables[table.name], table)
    given = list(batch.columns)
    order_by = order_by or [c for c in given if c not in (*table.hidden, "password")]
    extra = [c for c in order_by if c not in table.columns]
    inputs = T.StructType([f for f in table.struct.fields if f.name != table.key])
    rows = _with_defaults(evolve(batch, inputs), kind, table, run_ts)
    rows = rows.withColumn("reasons", failures(rules_for(kind, given)) if rules_for(kind, given) else _no_reason())
    rows = redact(rows, table).drop("password")

    keys = {f"__u{i}": columns for i, columns in enumerate(_unique_keys(table))}
    rows = rows.withColumns({n: unique_value(c, dict(rows.dtypes)) for n, c in keys.items()})
    rows = _check_references(rows, table, tables, small)
    rows = _check_existing(rows, base, keys, small)
    rows = positioned(rows, order_by)

    valid = rows.where(F.size("reasons") == 0)
    refused = rows.where(F.size("reasons") > 0)
    if keys:
        valid, late = split_accepted(valid, accept_first(valid, list(keys)))
        refused = refused.unionByName(with_reason(late.drop("reasons"), "duplicate in batch"))

    numbered = number_rows(valid, table.key, last_key(base, table.key))
    delta = conform(stamp_entry(numbered, table, run_ts, user), table)
    shown = [c for c in given if c in refused.columns]
    rejects = refused.select(*shown, *[c for c in extra if c not in shown], "reasons")
    return Change(base.unionByName(delta), rejects, delta)


def _no_reason() -> Column:
    return F.array().cast("array<string>")


def insert_ignore(
    tables: Tables,
    name: str,
    batch: DataFrame,
    business_key: list[str],
    order_by: list[str],
    run_ts=None,
    user: int | None = None,
    small: bool | None = None,
) -> Change:
    """Add the rows whose business key is new; leave existing rows as they are.

    Of several new rows with one key the first in ``order_by`` order is kept. Text
    keys ignore case; a key with a NULL part is never a duplicate. New rows get the
    table's defaults, keys in ``order_by`` order and entry stamps; columns that the
    table lacks order the batch at most.
    """
    table = TABLES[name]
    run_ts = pinned(run_ts)
    base = conform(tables[name], table)
    inputs = T.StructType([f for f in table.struct.fields if f.name != table.key])
    filled = _with_defaults(evolve(batch, inputs), name, table, run_ts)
    rows = redact(filled, table).drop("password")
    rows = rows.withColumn("__key", unique_value(tuple(business_key), dict(rows.dtypes)))
    held = base.select(unique_value(tuple(business_key), dict(base.dtypes)).alias("__key"))
    held = narrowed(held, "__key", rows, "__key", is_small(batch, small))
    fresh = lacking(rows, "__key", held, "__key")
    known = having(rows, "__key", held, "__key")
    given = [c for c in rows.columns if c != "__key"]
    order = F.struct(*order_by, F.xxhash64(*given).alias("tie"))
    grouped = fresh.where(F.col("__key").isNotNull()).groupBy("__key")
    first = grouped.agg(F.min_by(F.struct(*given), order).alias("row"), F.count("*").alias("__n"))
    kept = first.select("row.*").unionByName(fresh.where(F.col("__key").isNull()).drop("__key"))
    numbered = number_rows(positioned(kept, order_by), table.key, last_key(base, table.key), complete=True)
    delta = conform(stamp_entry(numbered, table, run_ts, user), table)
    ignored = known.groupBy("__key").agg(F.count("*").alias("ignored")).unionByName(
        first.where(F.col("__n") > 1).select("__key", (F.col("__n") - 1).alias("ignored"))
    )
    return Change(base.unionByName(delta), ignored.withColumnRenamed("__key", "key"), delta)
