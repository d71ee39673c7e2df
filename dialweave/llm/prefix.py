"""Running sums over a total order, without a task that sees more than a range of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialweave.session import freeze


def sums_before(df: DataFrame, amount: str, order: list[str], group: str | None = None) -> DataFrame:
    """`df` with `before`: the sum of `amount` over the rows ahead in `order` (within `group`).

    Rows are dealt out by ranges of the order, so that a large group spreads over
    many ranges; ranges are summed, their sums accumulated (a row for each range
    and group), and rows accumulated within their range. `order` must be total up
    to rows that may change places. `df` is narrow: it is written out once.
    """
    keys = [group] if group else []
    ranged = freeze(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts, [*keys, "_range"])
        .withColumn("before", F.col("_start") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop("_range", "_start")
    )
