"""Loaders: parquet folders, a relational database, or the star-schema mapping."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from dialweave.sources import star
from dialweave.sources.schema import TABLES, Table, conform, redact


class Tables(dict[str, DataFrame]):
    """Tables by name, each opened when first used."""

    def __init__(self, open_table: Callable[[str], DataFrame] | None = None, **tables: DataFrame):
        super().__init__(tables)
        self._open = open_table

    def __missing__(self, name: str) -> DataFrame:
        if self._open is None or name not in TABLES:
            raise KeyError(name)
        self[name] = self._open(name)
        return self[name]

    def replaced(self, **tables: DataFrame) -> Tables:
        """The same tables with some of them exchanged."""
        result = Tables(self._open, **self)
        result.update(tables)
        return result


def read_parquet(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """One table with its declared schema: no inference, no footer scan.

    A table stored in day folders also shows the day, so ``time_range`` can prune
    folders.
    """
    return redact(spark.read.schema(table.struct).parquet(f"{path}/{table.name}"), table)


def jdbc_options(url: str, table: Table, bounds: tuple[int, int], partitions: int = 64) -> dict[str, str]:
    """Reader options for a range-partitioned parallel read on the primary key."""
    lower, upper = bounds
    return {
        "url": url,
        "dbtable": table.name,
        "partitionColumn": table.key,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def key_bounds(
    spark: SparkSession, url: str, table: Table, properties: Mapping[str, str] | None = None
) -> tuple[int, int]:
    """Lowest and highest key, asked of the database itself."""
    query = f"select min({table.key}) as low, max({table.key}) as high from {table.name}"
    options = {"url": url, "query": query, **(properties or {})}
    low, high = spark.read.format("jdbc").options(**options).load().first()
    return low or 0, high or 0


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: Table,
    bounds: tuple[int, int],
    partitions: int = 64,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    options = {**jdbc_options(url, table, bounds, partitions), **(properties or {})}
    return conform(spark.read.format("jdbc").options(**options).load(), table)


def load_tables(
    spark: SparkSession,
    path: str,
    source: str = "parquet",
    bounds: Mapping[str, tuple[int, int]] | None = None,
    partitions: int = 64,
    properties: Mapping[str, str] | None = None,
) -> Tables:
    """All tables by name. ``path`` is a folder, or the database URL for ``jdbc``.

    ``jdbc`` reads each table in key ranges; give the key range in ``bounds`` to
    spare asking for it.
    """
    if source == "parquet":
        return Tables(lambda name: read_parquet(spark, path, TABLES[name]))
    if source == "jdbc":

        def open_table(name: str) -> DataFrame:
            known = (bounds or {}).get(name) or key_bounds(spark, path, TABLES[name], properties)
            return read_jdbc(spark, path, TABLES[name], known, partitions, properties)

        return Tables(open_table)
    if source == "star":
        return Tables(lambda name: conform(star.view(spark, path, name), TABLES[name]))
    raise ValueError(f"unknown source {source!r}")
