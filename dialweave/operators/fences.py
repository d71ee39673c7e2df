"""Pages at any depth.

A page number says how many rows to skip, and a top-k has to find all of them. A fence
table notes, for every so many rows of one order, the sort values of the row that stands
there and how many stand before it. A page then reads the rows between two fences. The
fences belong to one state of the table, as a snapshot has; write them with it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialweave.operators.ordering import Order, check_page, order_columns, strictly_after
from dialweave.session import freeze

#: Rows between two fences.
EVERY = 100_000
#: Ranges the order is cut into to be sorted; their offsets are the only thing broadcast.
RANGES = 2000

_SHIFT = 33  # a row's number in its partition is in the bits below


def fences(df: DataFrame, order: list[Order], pk: str, every: int = EVERY, ranges: int = RANGES) -> DataFrame:
    """(before, k0, k1, ...): the sort values and key at every fence, and the rows before it.

    Only sort values and keys move. Runs a job; ``df.count() / every + ranges`` rows at most.
    """
    keys = [*order, Order(pk)]
    names = [f"k{i}" for i in range(len(keys))]
    narrow = df.select(*[k.value.alias(n) for n, k in zip(names, keys, strict=True)])
    sort = [Order(n, k.descending, k.nulls_last).to_column() for n, k in zip(names, keys, strict=True)]
    ordered = narrow.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort)
    numbered = ordered.withColumn("__id", F.monotonically_increasing_id())
    part, at = F.shiftright("__id", _SHIFT), F.col("__id").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    numbered = numbered.select(part.alias("__part"), at.alias("__at"), *names)
    block = F.floor(F.col("__at") / every).alias("__block")
    found = freeze(
        numbered.groupBy("__part", block).agg(
            F.count("*").alias("__n"), F.min(F.struct("__at", *names)).alias("__first")
        )
    )
    size = found.groupBy("__part").agg(F.sum("__n").alias("__rows"))
    earlier = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = size.select(F.col("__part").alias("__p"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    placed = found.join(F.broadcast(offsets), F.col("__part") == F.col("__p"), "inner")
    before = (F.col("__before") + F.col("__first.__at")).alias("before")
    return placed.select(before, *[F.col(f"__first.{n}").alias(n) for n in names])


def _typed(value, kind: T.DataType) -> Column | None:
    """A sort value as a literal of its own type, so that comparing casts no column."""
    if value is None:
        return None
    return F.lit(str(value) if isinstance(value, date) else value).cast(kind)


def _leading(order: Order, value: Column | None, low: bool, nulls: bool) -> Column:
    """A plain bound on the first sort key, which reaches the scan.

    Statistics of row groups are compared for numbers, dates and text. For times the bound
    only filters rows, before any of them are sorted.

    ``nulls``: the range may reach the rows without a value.
    """
    if value is None:
        return F.lit(True) if low != order.null_at_end else order.value.isNull()
    bound = order.value >= value if low != order.descending else order.value <= value
    return bound | order.value.isNull() if nulls else bound


def fenced_page(df: DataFrame, order: list[Order], pk: str, fence: DataFrame, page: int, limit: int) -> DataFrame:
    """The rows ``paginate`` gives for a page, read between the fences around it."""
    check_page(page, limit)
    keys, skip = [*order, Order(pk)], (page - 1) * limit
    names = [f"k{i}" for i in range(len(keys))]
    types = [fence.schema[n].dataType for n in names]
    below = fence.where(F.col("before") <= skip).orderBy(F.desc("before")).limit(1).collect()
    above = fence.where(F.col("before") >= skip + limit).orderBy("before").limit(1).collect()

    def values(row):
        return tuple(_typed(row[n], kind) for n, kind in zip(names, types, strict=True))

    low = values(below[0]) if below else None
    high = values(above[0]) if above else None
    outer = high if keys[0].null_at_end else low
    nulls = outer is None or outer[0] is None
    rows, start = df, 0
    if low:
        start, same = below[0]["before"], F.col(pk).eqNullSafe(low[-1])
        rows = rows.where(_leading(keys[0], low[0], True, nulls)).where(strictly_after(keys, low) | same)
    if high:
        same = F.col(pk).eqNullSafe(high[-1])
        rows = rows.where(_leading(keys[0], high[0], False, nulls)).where(~(strictly_after(keys, high) | same))
    return rows.orderBy(*order_columns(order, pk)).offset(skip - start).limit(limit)
