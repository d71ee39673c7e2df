"""Counts.

Children are always aggregated on their own key before any join, so map-side
partial aggregation shrinks a hot key before it is shuffled, and no parent row
is multiplied only to be counted again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialweave.functions import ci


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in columns})


def conditional_counts(
    df: DataFrame,
    keys: list[Column | str],
    counts: dict[str, Column | None],
    distinct: dict[str, tuple[Column | None, str]] | None = None,
) -> DataFrame:
    """Per key: rows meeting each predicate (None counts all rows), and distinct values.

    One distinct column keeps the plan free of Expand; its first shuffle is on
    (key, value), so even a hot key is spread out.
    """
    measures = [
        (F.count("*") if p is None else F.count(F.when(p, 1))).alias(name) for name, p in counts.items()
    ]
    for name, (predicate, column) in (distinct or {}).items():
        value = F.col(column) if predicate is None else F.when(predicate, F.col(column))
        measures.append(F.count_distinct(value).alias(name))
    return df.groupBy(*keys).agg(*measures)


def count_children(
    parent: DataFrame, child: DataFrame, pk: str, fk: str, name: str, where: Column | None = None
) -> DataFrame:
    """Parent rows with the number of their children, zero included."""
    child = child if where is None else child.where(where)
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__fk")).agg(F.count("*").alias(name))
    joined = parent.join(counts, F.col(pk) == F.col("__fk"), "left").drop("__fk")
    return zero_fill(joined, [name])


def grouped_count(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Rows per text value, ignoring case; NULL is a group of its own.

    Exact spellings are counted first, with a hash aggregate. Only those few rows
    are folded by case, showing the first spelling in sort order.
    """
    alias = alias or column
    spelled = df.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__n"))
    folded = spelled.groupBy(ci("__value").alias("__folded")).agg(
        F.min("__value").alias(alias), F.sum("__n").alias("count")
    )
    return folded.drop("__folded")


def tall_counts(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each frame, computed in a single job."""
    rows = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        for name, df in metrics.items()
    ]
    tall = reduce(DataFrame.unionByName, rows)
    return tall.agg(*[F.sum(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in metrics])
