"""What the jobs share: results, row positions, new keys, stamps, first-come rules."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialweave.functions import ci_key, run_time
from dialweave.operators.joins import having, lacking
from dialweave.session import freeze
from dialweave.sources.schema import Table

POSITION = "__pos"


class Change(NamedTuple):
    new: DataFrame
    rejects: DataFrame
    delta: DataFrame


def positioned(df: DataFrame, order_by: list[str]) -> DataFrame:
    """``df`` in a fixed order, written out, each row with its position.

    The sort is a range shuffle, so the position encodes (partition, row in it) and
    no single task ever sees all rows. Freezing keeps positions the same for every
    later use, also after an executor is lost.
    """
    tie = F.xxhash64(*df.columns)
    return freeze(df.orderBy(*order_by, tie).withColumn(POSITION, F.monotonically_increasing_id()))


def number_rows(rows: DataFrame, name: str, start: Column | int, complete: bool = False) -> DataFrame:
    """Consecutive keys after ``start`` in position order.

    One small frame (a row per partition of the sort) turns row counts into offsets.
    ``complete`` says that no row was filtered out since ``positioned``: then the
    position itself holds the rank, and the rows are not shuffled again.
    """
    rows = rows.withColumn("__part", F.shiftright(POSITION, 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    if complete:
        rank = F.col(POSITION).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    else:
        rank = F.row_number().over(Window.partitionBy("__part").orderBy(POSITION))
    # at most one offset per partition of the sort, so the broadcast is bounded
    numbered = rows.withColumn("__rank", rank).join(F.broadcast(offsets), "__part")
    start = start if isinstance(start, Column) else F.lit(start)
    key = start + F.col("__offset") + F.col("__rank")
    return numbered.withColumn(name, key.cast("long")).drop("__part", "__rank", "__offset")


def last_key(base: DataFrame, key: str) -> Column:
    """The highest key in use (0 in an empty table), as a scalar subquery."""
    return base.agg(F.coalesce(F.max(key), F.lit(0))).scalar()


def unique_value(columns: tuple[str, ...], dtypes: dict[str, str]) -> Column:
    """The value that must be unique; NULL (never a duplicate) if any part is NULL."""
    parts = [ci_key(c) if dtypes[c] == "string" else F.col(c) for c in columns]
    if len(parts) == 1:
        return parts[0]
    complete = reduce(and_, [p.isNotNull() for p in parts])
    return F.when(complete, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def _heads(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_h")).agg(
        F.min(POSITION).alias(f"{key}_first")
    )


def accept_first(rows: DataFrame, keys: list[str], owner: str | None = None) -> DataFrame:
    """Positions accepted when rows claim their key values one after the other.

    A row is turned down if an *accepted* earlier row (of another ``owner``) holds
    one of its values. With one key that is the first row of each group. With
    several, a turned-down row frees its other values for later rows, so rounds are
    run: winners are found, rows they exclude leave, and the rest go on. In the first
    round the rows win that are first in all their groups, and a batch in which turned-
    down rows free nothing takes that round alone. What is left hangs together in
    chains; ``_settled`` decides a chain of any length in one round.
    """
    narrow = [POSITION, *keys, *([owner] if owner else [])]
    pending = rows.select(*narrow)
    if len(keys) == 1 and owner is None:
        heads = _heads(pending, keys[0]).select(f"{keys[0]}_first")
        alone = pending.where(F.col(keys[0]).isNull()).select(POSITION)
        return alone.unionByName(heads.withColumnRenamed(f"{keys[0]}_first", POSITION))
    rounds = []
    while True:
        winners = freeze(_settled(pending, keys, owner) if rounds else _first_in_all(pending, keys)).select(*narrow)
        rounds.append(winners.select(POSITION))
        left = lacking(pending, POSITION, winners, POSITION, unique=True)
        for key in keys:
            if owner is None:
                left = lacking(left, key, winners, key)
            else:
                held = winners.where(F.col(key).isNotNull()).select(
                    F.col(key).alias("__value"), F.col(owner).alias("__holder")
                )
                taken = (F.col(key) == F.col("__value")) & (F.col(owner) != F.col("__holder"))
                left = left.join(held.distinct(), taken, "left_anti")
        pending = freeze(left)
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def _first_in_all(pending: DataFrame, keys: list[str]) -> DataFrame:
    marked = pending
    for key in keys:
        marked = marked.join(_heads(pending, key), F.col(key) == F.col(f"{key}_h"), "left")
    first = [F.col(k).isNull() | (F.col(f"{k}_first") == F.col(POSITION)) for k in keys]
    return marked.where(reduce(and_, first))


def _blockers(pending: DataFrame, key: str, owner: str | None) -> DataFrame:
    """Per value of a key: the first row, the second, and the first one of another owner."""
    held = pending.where(F.col(key).isNotNull())
    who = F.col(owner) if owner else F.lit(None).cast("long")
    heads = held.groupBy(F.col(key).alias("__h")).agg(F.min(F.struct(F.col(POSITION).alias("at"), who.alias("who"))).alias("__first"))
    after = held.join(heads, F.col(key) == F.col("__h")).where(F.col(POSITION) > F.col("__first.at"))
    other = F.min(F.when(~who.eqNullSafe(F.col("__first.who")), F.col(POSITION))) if owner else F.lit(None).cast("long")
    seconds = after.groupBy(F.col(key).alias("__g")).agg(F.min(POSITION).alias("__second"), other.alias("__other"))
    names = {"__first": f"{key}_first", "__second": f"{key}_second", "__other": f"{key}_other"}
    both = heads.join(seconds, F.col("__h") == F.col("__g"), "left")
    return both.select(F.col("__h").alias(f"{key}_h"), *[F.col(c).alias(n) for c, n in names.items()])


def _settled(pending: DataFrame, keys: list[str], owner: str | None) -> DataFrame:
    """Rows whose acceptance follows from the rows before them.

    A row without a conflicting earlier row is accepted. A row with exactly one is
    accepted if and only if that one is not, so such rows form trees; pointers up the
    trees are doubled until they reach a root, and the parity of the way decides. Rows
    with more conflicts, and what hangs on them, wait for a later round.
    """
    marked, free, parents, waits = pending, [], [], []
    for key in keys:
        marked = marked.join(_blockers(pending, key, owner), F.col(key) == F.col(f"{key}_h"), "left")
        at, first = F.col(POSITION), F.col(f"{key}_first.at")
        same = F.col(owner).eqNullSafe(F.col(f"{key}_first.who")) if owner else F.lit(False)
        clear = F.col(key).isNull() | (first == at)
        if owner:
            clear = clear | (same & (F.col(f"{key}_other").isNull() | (F.col(f"{key}_other") > at)))
        single = ~clear & ~same & (F.col(f"{key}_second") == at)
        free.append(clear)
        parents.append(F.when(single, first))
        waits.append(~clear & ~single)
    parent = F.greatest(*parents) if len(parents) > 1 else parents[0]
    alike = F.coalesce(F.least(*parents) == parent, F.lit(True)) if len(parents) > 1 else F.lit(True)
    root = reduce(and_, free)
    waiting = reduce(or_, waits) | ~alike
    tree = marked.select(
        *pending.columns,
        F.when(root | waiting, F.col(POSITION)).otherwise(parent).alias("__up"),
        (~root & ~waiting).cast("int").alias("__odd"),
        root.alias("__known"),
    )
    pointers = freeze(tree)
    while True:
        ahead = pointers.select(
            F.col(POSITION).alias("__at"), F.col("__up").alias("__further"), F.col("__odd").alias("__step"), F.col("__known").alias("__sure")
        )
        # at a root or a waiting row the way ends: it points at itself, over no step
        moved = pointers.join(ahead, F.col("__up") == F.col("__at"), "left")
        pointers = freeze(
            moved.select(
                *pending.columns,
                F.col("__further").alias("__up"),
                F.when(F.col("__at") == F.col(POSITION), F.col("__odd")).otherwise((F.col("__odd") + F.col("__step")) % 2).alias("__odd"),
                F.col("__sure").alias("__known"),
                ((F.col("__further") != F.col("__up"))).alias("__moved"),
            )
        )
        if pointers.where("__moved").isEmpty():
            return pointers.where(F.col("__known") & (F.col("__odd") == 0))


def split_accepted(rows: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        having(rows, POSITION, accepted, POSITION, unique=True),
        lacking(rows, POSITION, accepted, POSITION, unique=True),
    )


def stamp_entry(df: DataFrame, table: Table, run_ts, user) -> DataFrame:
    """Who created the rows, and when."""
    stamps = {
        "au_entryempnoby": user if isinstance(user, Column) else F.lit(user).cast("long"),
        "au_entryat": run_time(run_ts),
        "created_at": run_time(run_ts),
        "updated_at": run_time(run_ts),
    }
    return df.withColumns({c: v for c, v in stamps.items() if c in table.columns})


def update_stamps(table: Table, run_ts, user: Column | None) -> dict[str, Column]:
    """Who changed the rows, and when."""
    stamps = {"au_updateat": run_time(run_ts), "updated_at": run_time(run_ts)}
    if user is not None:
        stamps["au_updateempnoby"] = user
    return {c: v for c, v in stamps.items() if c in table.columns}


def with_reason(df: DataFrame, reason: str) -> DataFrame:
    return df.withColumn("reasons", F.array(F.lit(reason)))
