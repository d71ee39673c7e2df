"""Projections that change the shape of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialweave.functions import falsy_default
from dialweave.operators.ordering import Order, order_columns
from dialweave.session import freeze

# Children in one nested row; longer lists continue in the next part.
PIECE = 10_000


def display_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Text to show where a column is NULL or empty."""
    return df.withColumns({c: falsy_default(c, d) for c, d in defaults.items()})


def preview(df: DataFrame, columns: list[str], pk: str, n: int = 5) -> DataFrame:
    """The first rows of a table by key."""
    return df.select(*columns).orderBy(pk).limit(n)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def _ranked(child: DataFrame, fk: str, child_pk: str, order: list[Order]) -> DataFrame:
    """Children with their place among the children of one parent, from 0.

    A range sort over (parent, order) spreads a large group over tasks, and is written
    out so that places stay the same. A row for each parent and task of the sort holds
    how many children came before; no window runs over a group of children.
    """
    spread = child.where(F.col(fk).isNotNull()).orderBy(F.col(fk), *order_columns(order, child_pk))
    placed = freeze(spread.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__task", F.shiftright("__at", 33))
    runs = placed.groupBy(F.col(fk).alias("__fk"), F.col("__task").alias("__run")).agg(
        F.min("__at").alias("__first"), F.count("*").alias("__n")
    )
    earlier = Window.partitionBy("__fk").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    met = placed.join(runs, (F.col(fk) == F.col("__fk")) & (F.col("__task") == F.col("__run")))
    rank = F.col("__at") - F.col("__first") + F.col("__before")
    return met.withColumn("__rank", rank).drop("__at", "__task", "__fk", "__run", "__first", "__before")


def nest(
    parent: DataFrame,
    child: DataFrame,
    pk: str,
    fk: str,
    child_pk: str,
    name: str,
    order: list[Order],
    piece: int = PIECE,
) -> DataFrame:
    """Parent rows with their children as ordered arrays; no children, one empty array.

    The row contract is (parent, ``part``): part 0 holds the first ``piece`` children,
    part 1 the next ones, and so on without gaps. No array grows beyond ``piece`` and no
    task holds a whole hot group; the parts of a parent in order are its children.
    """
    fields = [c for c in child.columns if c != fk]
    part = F.floor(F.col("__rank") / piece).cast("long")
    items = F.sort_array(F.collect_list(F.struct("__rank", *fields)))
    bare = F.transform(items, lambda item: F.struct(*[item[f].alias(f) for f in fields]))
    arrays = (
        _ranked(child, fk, child_pk, order)
        .groupBy(F.col(fk).alias("__parent"), part.alias("part"))
        .agg(bare.alias(name))
    )
    joined = parent.join(arrays, F.col(pk) == F.col("__parent"), "left").drop("__parent")
    empty = F.array().cast(arrays.schema[name].dataType)
    return joined.withColumns({name: F.coalesce(name, empty), "part": F.coalesce("part", F.lit(0).cast("long"))})


def unnest(df: DataFrame, name: str) -> DataFrame:
    """The flat form of ``nest``: one row per child."""
    others = [c for c in df.columns if c not in (name, "part")]
    return df.select(*others, F.explode(name).alias(name)).select(*others, f"{name}.*")
