"""A small batch against a large table.

A join on equal keys shuffles both sides, the table whole, even if the batch names a
hundred of its rows. So a sketch of the batch's keys meets the table first: a bit for
each key's hash, kept in at most WORDS words of 64 bits, with the range of the keys. The
sketch is broadcast, and its size is bounded by construction, whatever the batch holds.
Rows it rules out never leave their scan; the exact join decides about the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a sketch: what may be broadcast, at most.
WORDS = 1 << 17
#: A batch of at most so many rows is sketched without being asked to.
SMALL = 10_000

_WORD, _BITS, _RANGED = "__word", "__bits", (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_small(batch: DataFrame, small: bool | None = None) -> bool:
    """Whether to sketch: as told, or by a count that stops at SMALL rows."""
    return batch.limit(SMALL + 1).count() <= SMALL if small is None else small


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(64 * WORDS))


def key_sketch(batch: DataFrame, key: Column) -> DataFrame:
    """A row for each word with a bit set; NULL keys set none."""
    places = batch.where(key.isNotNull()).select(_place(key).alias("__place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__place") % 64).cast("int"))
    return places.groupBy((F.col("__place") / 64).cast("long").alias(_WORD)).agg(F.bit_or(bit).alias(_BITS))


def _meet(rows: DataFrame, key: Column, sketch: DataFrame, how: str) -> DataFrame:
    word = (_place(key) / 64).cast("long")
    held = (word == F.col(_WORD)) & (F.getbit(F.col(_BITS), _place(key) % 64) == 1) & key.isNotNull()
    return rows.join(F.broadcast(sketch), held, how)


def _wanted(rows: DataFrame, column: str, batch: DataFrame, wanted: str) -> Column:
    """The batch's key as the table has it: only equal types hash alike."""
    return F.col(wanted).cast(rows.schema[column].dataType)


def narrowed(rows: DataFrame, column: str, batch: DataFrame, wanted: str, small: bool = True) -> DataFrame:
    """Rows of a table whose ``column`` may be among the batch's ``wanted``: those and a few others.

    Numbers and times are also held to the batch's range, which the scan can check
    against its statistics.
    """
    if not small:
        return rows
    key = _wanted(rows, column, batch, wanted)
    if isinstance(rows.schema[column].dataType, _RANGED):
        low, high = (batch.agg(f(key)).scalar() for f in (F.min, F.max))
        rows = rows.where((F.col(column) >= low) & (F.col(column) <= high))
    return _meet(rows, F.col(column), key_sketch(batch, key), "left_semi")


def parted(rows: DataFrame, keys: list[tuple[str, DataFrame, str]], small: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(rows that a key may match, the others) for several (column, batch, wanted).

    The second part, the bulk of a large table, can be passed on as it is, without a shuffle.
    """
    if not small:
        return rows, None
    met, rest = [], rows
    for column, batch, wanted in keys:
        sketch = key_sketch(batch, _wanted(rows, column, batch, wanted))
        met.append(_meet(rest, F.col(column), sketch, "left_semi"))
        rest = _meet(rest, F.col(column), sketch, "left_anti")
    return reduce(DataFrame.unionByName, met), rest


def together(changed: DataFrame, rest: DataFrame | None) -> DataFrame:
    return changed if rest is None else changed.unionByName(rest)
