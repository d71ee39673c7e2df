"""Writing tables: appends, and whole snapshots that become visible at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialweave.sources.schema import TABLES, Table
from dialweave.sources.tables import Tables, read_parquet


def _with_day(df: DataFrame, table: Table) -> DataFrame:
    day, moment = table.day_partition
    return df.withColumn(day, F.to_date(moment))


def write_table(df: DataFrame, path: str, table: Table, mode: str = "append") -> None:
    """Write one table; event tables go into one folder per day, clustered ones in ranges.

    Ranges are cut by the clustered columns and the key, so a value that a third of the
    rows share fills many of them, and the statistics of a row group let a reader skip it.

    The rebalance lets AQE cut a busy day into several files and gather quiet
    ones, by measured size. Within a file rows are sorted by agent, so row-group
    statistics let a reader skip other agents.
    """
    target = f"{path}/{table.name}"
    if table.clustered:
        order = [*table.clustered, table.key]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if not table.day_partition:
        df.write.mode(mode).parquet(target)
        return
    day = table.day_partition[0]
    rows = _with_day(df, table).hint("rebalance", day)
    agents = [c for c in ("empno_fk",) if c in df.columns]
    rows.sortWithinPartitions(day, *agents).write.mode(mode).partitionBy(day).parquet(target)


def append(df: DataFrame, path: str, name: str) -> None:
    write_table(df, path, TABLES[name], "append")


_MANIFEST = "version long, name string, written long"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, int]:
    """The folder version of each table in a snapshot (the newest by default); empty before the first."""
    if not _announced(spark, root):
        return {}
    lines = spark.read.schema(_MANIFEST).parquet(f"{root}/published")
    newest = lines.agg(F.max("version")).first()[0] if version is None else version
    return {r["name"]: r["written"] for r in lines.where(F.col("version") == newest).collect()}


def _announced(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def publish(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write the tables given under a new version folder, then announce the version.

    Tables that are not given are carried over from the snapshot before: the manifest
    names the folder of each table, so an unchanged table is neither read nor written.
    Readers only see announced versions, whose manifest is one file, so a job that dies
    half way leaves the previous snapshot in force and can simply be run again. A version
    that was announced already, or that older ones follow, is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    last = latest_version(spark, root) if _announced(spark, root) else None
    if last is not None and version <= last:
        raise ValueError(f"version {version} is announced, or older than {last}")
    folders = {} if last is None else manifest(spark, root, last)
    for name, df in tables.items():
        write_table(df, f"{root}/version={version}", TABLES[name], "overwrite")
        folders[name] = version
    lines = spark.createDataFrame([(version, name, written) for name, written in folders.items()], _MANIFEST)
    lines.coalesce(1).write.mode("append").parquet(f"{root}/published")


def latest_version(spark: SparkSession, root: str) -> int:
    published = spark.read.schema(_MANIFEST).parquet(f"{root}/published")
    return published.agg(F.max("version")).first()[0]


def load_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """The tables of a snapshot, the newest by default; those never published are absent."""
    folders = manifest(spark, root, version)
    return Tables(**{name: read_parquet(spark, f"{root}/version={v}", TABLES[name]) for name, v in folders.items()})
