"""Row filters. Parameters that are None or empty add no condition."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialweave.functions import ci, ci_equal, contains_text
from dialweave.operators.joins import having, lacking
from dialweave.sources.schema import TABLES

INLINE_KEYS = 1000


def _absent(value) -> bool:
    return value is None or value == ""


def _equal(df: DataFrame, column: str, value, fold: bool, collation: str | None = None) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return ci_equal(column, str(value), collation) if fold else F.col(column) == F.lit(str(value))
    if isinstance(value, str):  # a request parameter: text that should be a number or a time
        return F.col(column) == F.lit(value).try_cast(kind)
    return F.col(column) == F.lit(value)


def where_equal(
    df: DataFrame, values: dict[str, object], ci: bool = True, collation: str | None = None
) -> DataFrame:
    """AND of ``column = value`` over the values supplied; text ignores case."""
    for column, value in values.items():
        if not _absent(value):
            df = df.where(_equal(df, column, value, ci, collation))
    return df


def text_search(df: DataFrame, columns: list[str], term: str | None, literal: bool = False) -> DataFrame:
    """Rows where any of the columns contains the term, ignoring case. NULL never matches."""
    if _absent(term):
        return df
    return df.where(reduce(or_, [contains_text(c, term, literal) for c in columns]))


def _partition_day(column: str) -> str | None:
    days = [t.day_partition for t in TABLES.values() if t.day_partition]
    return next((day for day, moment in days if moment == column), None)


def time_range(
    df: DataFrame, column: str, start=None, end=None, end_of_day: bool = False
) -> DataFrame:
    """Closed range, each bound optional; a bare date means its midnight.

    ``end_of_day`` extends the end to the whole day. Plain comparisons reach the
    parquet reader; on a day-partitioned table the same bounds also prune folders.
    """
    kind = df.schema[column].dataType
    day = _partition_day(column)
    day = day if day in df.columns else None
    if not _absent(start):
        low = F.lit(str(start)).cast(kind)
        df = df.where(F.col(column) >= low)
        if day:
            df = df.where(F.col(day) >= F.to_date(low))
    if not _absent(end):
        high = F.lit(str(end)).cast(kind)
        if end_of_day:
            df = df.where(F.col(column) < F.date_add(F.to_date(high), 1).cast(kind))
        else:
            df = df.where(F.col(column) <= high)
        if day:
            df = df.where(F.col(day) <= F.to_date(high))
    return df


_GIVEN = "__given"


def _as_frame(df: DataFrame, column: str, keys) -> DataFrame:
    """The keys as the table has them; text that stands for numbers also as it was given."""
    kind = df.schema[column].dataType
    if isinstance(keys, DataFrame):
        name = column if column in keys.columns else keys.columns[0]
        frame = keys.select(F.col(name).alias(column))
    else:
        text = any(isinstance(k, str) for k in keys)
        field = T.StructField(column, T.StringType() if text else kind)
        rows = [(str(k) if text and k is not None else k,) for k in keys]
        frame = df.sparkSession.createDataFrame(rows, T.StructType([field]))
    if isinstance(frame.schema[column].dataType, T.StringType) and not isinstance(kind, T.StringType):
        return frame.select(F.trim(column).try_cast(kind).alias(column), F.col(column).alias(_GIVEN))
    return frame


def _typed(keys: list, kind: T.DataType) -> list:
    """Values of an IN list: of text, what is a whole number."""
    if not isinstance(kind, T.IntegralType):
        return keys
    text = [k.strip() if isinstance(k, str) else k for k in keys]
    return [k if not isinstance(k, str) else int(k) for k in text if not isinstance(k, str) or re.fullmatch(r"[+-]?[0-9]{1,18}", k)]


def lookup(df: DataFrame, pk: str, keys) -> tuple[DataFrame, DataFrame]:
    """Rows for a batch of keys, and the keys that have none.

    A short list becomes an IN filter that reaches the scan; a longer list or a
    DataFrame becomes a semi join. Keys may be text, as a request has them: those that
    are no key at all have no row, and missing ones are named as they were given.
    """
    wanted = _as_frame(df, pk, keys)
    if not isinstance(keys, DataFrame) and len(keys) <= INLINE_KEYS:
        found = df.where(F.col(pk).isin(_typed(list(keys), df.schema[pk].dataType)))
    else:
        found = having(df, pk, wanted, pk)
    missing = lacking(wanted.distinct(), pk, found, pk)
    return found, missing.select(F.col(_GIVEN).alias(pk)) if _GIVEN in wanted.columns else missing


def owned_by(df: DataFrame, owner: str, who) -> DataFrame:
    """Rows that belong to one owner."""
    return df.where(_equal(df, owner, who, False))


def match_either(df: DataFrame, columns: tuple[str, str], values) -> DataFrame:
    """Rows where either identifier equals the value, or any value of a batch.

    The batch form runs two disjoint equi-joins, since an OR in a join condition
    would compare every row with every value.
    """
    first, second = columns
    if not isinstance(values, DataFrame):
        return df.where(ci_equal(first, values) | ci_equal(second, values))
    wanted = values.select(ci(values.columns[0]).alias("value")).distinct()
    keyed = df.withColumns({"__a": ci(first), "__b": ci(second)})
    by_first = having(keyed, "__a", wanted, "value", unique=True)
    by_second = having(lacking(keyed, "__a", wanted, "value", unique=True), "__b", wanted, "value", unique=True)
    return by_first.unionByName(by_second).drop("__a", "__b")


def not_in(
    df: DataFrame, column: str, other: DataFrame, other_column: str, null_safe: bool = False
) -> DataFrame:
    """``column NOT IN (SELECT other_column FROM other)``.

    SQL's rule: one NULL in the list empties the result, and a NULL on the left
    passes only when the list is empty. Spelled out as an anti join plus two scalar
    checks, because Spark runs the literal form by broadcasting the whole list
    whatever its size. ``null_safe`` drops the rule and keeps the anti join.
    """
    kept = lacking(df, column, other, other_column)
    if null_safe:
        return kept
    has_null = other.where(F.col(other_column).isNull()).exists()
    return kept.where(~has_null & (F.col(column).isNotNull() | ~other.exists()))
