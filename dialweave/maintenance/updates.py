"""Changing rows: partial updates and status flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialweave.functions import ci_key, falsy_null, pinned
from dialweave.maintenance.changes import (
    POSITION,
    Change,
    accept_first,
    split_accepted,
    update_stamps,
    with_reason,
)
from dialweave.maintenance.quality import ROLES, email_ok
from dialweave.operators.filters import lookup
from dialweave.operators.joins import attach, having, lacking
from dialweave.operators.sketches import SMALL, is_small, narrowed, parted, together
from dialweave.session import freeze
from dialweave.sources.schema import TABLES, Table, conform
from dialweave.sources.tables import Tables

# Rules on new values, beyond their type.
UPDATE_RULES = {"users": {"email": email_ok, "role": lambda value: F.coalesce(value.isin(ROLES), F.lit(False))}}

# Tables whose update request may be empty: it then only stamps the row.
MAY_BE_EMPTY = {"custassignment"}


def _set(column: str) -> Column:
    return F.map_contains_key("changes", F.lit(column))


def _value(column: str) -> Column:
    return F.col("changes")[column]


def _reasons(table: Table) -> Column:
    """Problems a change has by itself: nothing to set, or text that does not convert."""
    checks = [] if table.name in MAY_BE_EMPTY else [F.when(F.size("changes") == 0, F.lit("no valid fields"))]
    for column, kind in table.columns.items():
        if column in table.updatable and kind != "string":
            target = table.struct[column].dataType
            broken = _value(column).isNotNull() & _value(column).try_cast(target).isNull()
            checks.append(F.when(broken, F.lit(f"invalid {column}")))
    for column, rule in UPDATE_RULES.get(table.name, {}).items():
        checks.append(F.when(_set(column) & ~rule(_value(column)), F.lit(f"invalid {column}")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def _missing_references(rows: DataFrame, table: Table, tables: Tables, small: bool) -> DataFrame:
    for ref in table.references:
        if ref.column not in table.updatable:
            continue
        parent = TABLES[ref.parent]
        rows = rows.withColumn("__fk", _value(ref.column).try_cast("long"))
        known = narrowed(tables[ref.parent], parent.key, rows, "__fk", small)
        rows = attach(rows, known, "__fk", parent.key, {"__found": parent.key})
        broken = F.col("__fk").isNotNull() & F.col("__found").isNull()
        reason = F.array_append("reasons", F.lit(f"{ref.column} not found"))
        rows = rows.withColumn("reasons", F.when(broken, reason).otherwise(F.col("reasons")))
        rows = rows.drop("__fk", "__found")
    return rows


def _claim(column: str) -> Column:
    """A unique value a change asks for; emptying the column asks for none."""
    return ci_key(falsy_null(_value(column)))


def _taken(rows: DataFrame, base: DataFrame, table: Table, small: bool) -> DataFrame:
    """Mark changes asking for a value that another row holds."""
    for column in table.unique:
        held = base.select(ci_key(column).alias("__held"), F.col(table.key).alias("__holder"))
        claims = rows.select(POSITION, "pk", _claim(column).alias("__claim")).where(F.col("__claim").isNotNull())
        held = narrowed(held, "__held", claims, "__claim", small)
        clash = claims.join(held, (F.col("__claim") == F.col("__held")) & (F.col("pk") != F.col("__holder")))
        clash = clash.select(F.col(POSITION).alias("__clash")).distinct()
        rows = attach(rows, clash, POSITION, "__clash", {"__hit": "__clash"})
        reason = F.array_append("reasons", F.lit(f"{column} in use"))
        rows = rows.withColumn(
            "reasons", F.when(F.col("__hit").isNotNull(), reason).otherwise(F.col("reasons"))
        ).drop("__hit")
    return rows


def _fold(changes: DataFrame, table: Table) -> DataFrame:
    """All changes of a row as one: per column, the value set last, wrapped so that
    "set to NULL" differs from "not set".

    A maximum per column needs no window, and partial aggregation folds the changes of
    a hot row before they are shuffled.
    """
    # where positions were fixed they also settle changes of one row with the same seq
    order = F.col(POSITION if POSITION in changes.columns else "seq")
    latest = [
        F.max_by(F.struct(_value(c).alias("value")), F.when(_set(c), order)).alias(f"__{c}")
        for c in table.updatable
    ]
    return changes.groupBy("pk").agg(*latest, F.max_by("updated_by", order).alias("__by"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Changes written out in the order of the feed, each with a position of its own.

    ``seq`` orders the changes of one row; changes of different rows may share it, so
    the key and the content of the change break ties.
    """
    content = F.xxhash64(F.array_sort(F.map_entries("requested")), "updated_by")
    return freeze(rows.orderBy("seq", "pk", content).withColumn(POSITION, F.monotonically_increasing_id()))


def _new_value(column: str, table: Table) -> Column:
    change = F.col(f"__{column}")
    value = falsy_null(change["value"]) if column == "social_ids" else change["value"]
    return F.when(change.isNotNull(), value.cast(table.struct[column].dataType)).otherwise(F.col(column))


def partial_update(
    tables: Tables, name: str, changes: DataFrame, run_ts=None, small: bool | None = None
) -> Change:
    """Apply a feed of (pk, changes map<string,string>, updated_by, seq).

    Only updatable columns count. A column missing from the map keeps its value; one
    mapped to NULL is emptied. Changes of one row are applied in ``seq`` order; ``seq``
    need not be unique across rows, and between rows the smaller key comes first. A
    change is rejected as a whole if its row does not exist, it sets nothing, a value
    does not convert, a reference has no target, or a unique value is held by another
    row of the table or claimed by an earlier change of another row. ``small`` as in
    ``ingest``: rows that no change can name are then passed on without a shuffle.
    """
    table = TABLES[name]
    run_ts = pinned(run_ts)
    small = is_small(changes, small)
    base = conform(tables[name], table)
    named = narrowed(base.select(table.key), table.key, changes, "pk", small)
    allowed = F.map_filter("changes", lambda key, _: key.isin(list(table.updatable)))
    rows = changes.select("pk", "seq", "updated_by", F.col("changes").alias("requested"), allowed.alias("changes"))
    unknown = with_reason(lacking(rows, "pk", named, table.key, unique=True), "not found")
    rows = rows.withColumn("reasons", _reasons(table))
    rows = _missing_references(rows, table, tables, small)

    contested = []
    if table.unique:
        # only a change that finds its row may claim a value
        rows = _in_order(having(rows, "pk", named, table.key, unique=True))
        rows = _taken(rows, base, table, small)
        good = rows.where(F.size("reasons") == 0)
        claims = {f"__u{i}": _claim(c) for i, c in enumerate(table.unique)}
        good, late = split_accepted(good, accept_first(good.withColumns(claims), list(claims), owner="pk"))
        contested = [with_reason(late.drop("reasons"), "claimed by an earlier change")]
    else:
        good = rows.where(F.size("reasons") == 0)

    folded = _fold(good, table)
    stamps = update_stamps(table, run_ts, F.col("__by"))
    values = {c: _new_value(c, table) for c in table.updatable}
    values.update({c: F.when(F.col("pk").isNotNull(), v).otherwise(F.col(c)) for c, v in stamps.items()})
    met, rest = parted(base, [(table.key, changes, "pk")], small)
    merged = met.join(folded, F.col(table.key) == F.col("pk"), "left").withColumns(values)

    shown = ["pk", "seq", "updated_by", F.col("requested").alias("changes"), "reasons"]
    broken = having(rows.where(F.size("reasons") > 0), "pk", named, table.key, unique=True)
    rejects = unknown.select(*shown).unionByName(broken.select(*shown))
    for frame in contested:
        rejects = rejects.unionByName(frame.select(*shown))
    delta = merged.where(F.col("pk").isNotNull()).select(*base.columns)
    return Change(together(merged.select(*base.columns), rest), rejects, delta)


# The status column of each table that has one.
STATUS_COLUMNS = {"users": "status", "employees": "empstatus", "projects": "projectstatus"}


def set_status(
    tables: Tables, name: str, ids, status: str = "inactive", run_ts=None, user: int | None = None
) -> Change:
    """Flip the status of the given rows (soft delete); rejects are the unknown ids."""
    table = TABLES[name]
    run_ts = pinned(run_ts)
    base = conform(tables[name], table)
    found, missing = lookup(base.select(table.key), table.key, ids)
    hits = found.select(F.col(table.key).alias("__hit"))
    values = {STATUS_COLUMNS[name]: F.lit(status)}
    values.update(update_stamps(table, run_ts, None if user is None else F.lit(user).cast("long")))
    hit = F.col("__hit").isNotNull()
    small = is_small(hits) if isinstance(ids, DataFrame) else len(ids) <= SMALL
    met, rest = parted(base, [(table.key, hits, "__hit")], small)
    marked = met.join(hits, F.col(table.key) == F.col("__hit"), "left")
    marked = marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
    delta = marked.where(hit).select(*base.columns)
    return Change(together(marked.select(*base.columns), rest), with_reason(missing, "not found"), delta)

