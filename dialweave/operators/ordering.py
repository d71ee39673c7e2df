"""Sorting, top-k and paging. Every order ends in the primary key, so pages are stable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialweave.functions import ci, ci_equal, page_count

# A page up to this many rows may be broadcast: its size is bounded by the request.
HINTED_PAGE = 10_000


@dataclass(frozen=True)
class Order:
    """One sort key. NULL sorts below every value unless ``nulls_last`` is set."""

    column: Column | str
    descending: bool = False
    nulls_last: bool = False

    @property
    def value(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    @property
    def null_at_end(self) -> bool:
        return self.descending or self.nulls_last

    def to_column(self) -> Column:
        if self.descending:
            return self.value.desc_nulls_last()
        return self.value.asc_nulls_last() if self.nulls_last else self.value.asc_nulls_first()

    def same_as(self, value) -> Column:
        return self.value.eqNullSafe(F.lit(value))

    def beyond(self, value) -> Column:
        """Rows that sort strictly after ``value`` on this key."""
        if value is None:
            return F.lit(False) if self.null_at_end else self.value.isNotNull()
        further = self.value < F.lit(value) if self.descending else self.value > F.lit(value)
        further = F.coalesce(further, F.lit(False))
        return further | self.value.isNull() if self.null_at_end else further


def newest(column: str) -> Order:
    return Order(column, descending=True)


def by_name(column: str) -> Order:
    return Order(ci(column))


def order_columns(order: list[Order], pk: str | list[str]) -> list[Column]:
    keys = [pk] if isinstance(pk, str) else pk
    return [o.to_column() for o in order] + [F.col(k).asc() for k in keys]


def sort_rows(df: DataFrame, order: list[Order], pk: str | list[str]) -> DataFrame:
    return df.orderBy(*order_columns(order, pk))


# Work priorities, most urgent first.
PRIORITIES = ["High", "Medium", "Low"]


def priority_order(column: str, ranks: list[str] = PRIORITIES) -> Order:
    """Listed values in the given order; anything else has no rank and sorts first."""
    return Order(F.coalesce(*[F.when(ci_equal(column, r), i) for i, r in enumerate(ranks, start=1)]))


def priority_sort(
    df: DataFrame, column: str, ranks: list[str], then: list[Order], pk: str, nulls_last: bool = False
) -> DataFrame:
    rank = Order(priority_order(column, ranks).column, nulls_last=nulls_last)
    return sort_rows(df, [rank, *then], pk)


def check_page(page: int, limit: int) -> None:
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")


def strictly_after(order: list[Order], values: tuple) -> Column:
    """Rows that sort after the given sort values."""
    steps = []
    for i, (key, value) in enumerate(zip(order, values, strict=True)):
        same = [o.same_as(v) for o, v in zip(order[:i], values[:i], strict=True)]
        steps.append(reduce(and_, [*same, key.beyond(value)]))
    return reduce(or_, steps)


def paginate(
    df: DataFrame, order: list[Order], pk: str, page: int = 1, limit: int = 10, after: tuple | None = None
) -> DataFrame:
    """One page, planned as a distributed top-k.

    A page number costs page x limit rows. ``after`` (the sort values and key of the
    last row seen) continues from there instead, at the cost of ``limit`` rows
    however deep the page is.
    """
    check_page(page, limit)
    if after is not None:
        rows = df.where(strictly_after([*order, Order(pk)], after))
        return rows.orderBy(*order_columns(order, pk)).limit(limit)
    rows = df.orderBy(*order_columns(order, pk))
    if page > 1:
        rows = rows.offset((page - 1) * limit)
    return rows.limit(limit)


def fetch_page(df: DataFrame, page: DataFrame, pk: str, limit: int) -> DataFrame:
    """Full rows for a page found on narrow rows, with the other columns the page brings.

    Joins that decide which rows belong to a page then shuffle only keys and sort
    columns; the wide table is read once more and filtered in place.
    """
    extra = [c for c in page.columns if c not in df.columns]
    side = page.select(F.col(pk).alias("__page"), *extra)
    side = F.broadcast(side) if limit <= HINTED_PAGE else side
    return df.join(side, F.col(pk) == F.col("__page"), "inner").drop("__page")


def page_info(df: DataFrame, page: int = 1, limit: int = 10) -> DataFrame:
    """Row total and page count of a listing."""
    check_page(page, limit)
    total = df.agg(F.count("*").alias("total"))
    return total.select(
        "total",
        page_count("total", limit).alias("total_pages"),
        F.lit(page).cast("long").alias("current_page"),
        F.lit(limit).cast("long").alias("limit"),
    )
