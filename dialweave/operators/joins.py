"""Join shapes.

No join here carries a broadcast hint: Catalyst and AQE broadcast a side only
when its measured size is under the threshold, and otherwise shuffle. What the
helpers add is the shape that keeps a hot key harmless:

* the side that may repeat a key is the left side of left, semi and anti joins,
  where AQE can cut a hot partition into pieces;
* a right side that may repeat a key is reduced to its distinct keys first, and
  partial aggregation does that before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "__match"


def attach(
    rows: DataFrame, dimension: DataFrame, fk: str, pk: str, columns: dict[str, str], how: str = "left"
) -> DataFrame:
    """Bring ``{new name: dimension column}`` from a table that is unique on ``pk``."""
    side = dimension.select(F.col(pk).alias(_KEY), *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.join(side, F.col(fk) == F.col(_KEY), how).drop(_KEY)


def _keys(other: DataFrame, column: str, unique: bool) -> DataFrame:
    keys = other.select(F.col(column).alias(_KEY))
    return keys if unique else keys.where(F.col(_KEY).isNotNull()).distinct()


def having(
    rows: DataFrame, column: str, other: DataFrame, other_column: str, unique: bool = False
) -> DataFrame:
    """Rows whose ``column`` occurs in ``other`` (semi join)."""
    return rows.join(_keys(other, other_column, unique), F.col(column) == F.col(_KEY), "left_semi")


def lacking(
    rows: DataFrame, column: str, other: DataFrame, other_column: str, unique: bool = False
) -> DataFrame:
    """Rows whose ``column`` is NULL or does not occur in ``other`` (anti join)."""
    return rows.join(_keys(other, other_column, unique), F.col(column) == F.col(_KEY), "left_anti")


def fan_out(parent: DataFrame, pk: str, child: DataFrame, fk: str, columns: dict[str, str]) -> DataFrame:
    """LEFT JOIN from a unique parent to a child that may repeat a key any number of times.

    A left join cannot split a hot key on its right side. So matched rows come from
    an inner join with the child on the splittable side, and the parents without a
    child are added with NULLs.
    """
    facts = child.select(F.col(fk).alias(_KEY), *[F.col(c).alias(n) for n, c in columns.items()])
    matched = facts.join(parent, F.col(_KEY) == F.col(pk), "inner").drop(_KEY)
    alone = lacking(parent, pk, child, fk)
    return matched.unionByName(alone, allowMissingColumns=True).select(*parent.columns, *columns)
