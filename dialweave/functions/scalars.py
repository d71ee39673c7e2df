"""Scalar expressions. All of them stay inside Catalyst; there is no Python UDF."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ci(column: Column | str, collation: str | None = None) -> Column:
    """Case-folded form of a text column.

    The source database compares text case-insensitively, so equality, IN and
    grouping on role, status and priority columns all go through this. It also ignores
    accents and trailing blanks; name a collation such as ``UNICODE_CI_AI_RTRIM`` to
    have that too.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.upper(column) if collation is None else F.collate(column, collation)


def ci_equal(column: Column | str, value: str, collation: str | None = None) -> Column:
    return ci(column, collation) == (F.upper(F.lit(value)) if collation is None else F.lit(value))


def ci_in(column: Column | str, values: list[str]) -> Column:
    return ci(column).isin([v.upper() for v in values])


def ci_key(column: Column | str) -> Column:
    """Key under which a text value counts as a duplicate (NULL never does)."""
    return ci(column)


def contains_text(column: Column | str, term: str, literal: bool = False) -> Column:
    """Case-insensitive substring test.

    ``%`` and ``_`` in the term act as wildcards unless ``literal`` is set.
    """
    lowered = F.lower(F.col(column) if isinstance(column, str) else column)
    if literal:
        return lowered.contains(term.lower())
    return lowered.like(f"%{term.lower()}%")


def falsy_null(column: Column | str) -> Column:
    """NULL for an empty string, the value otherwise."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(column, F.lit(""))


def falsy_default(column: Column | str, default) -> Column:
    """The default for NULL and for the empty string."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(falsy_null(column), default)


def day_of(column: Column | str) -> Column:
    return F.to_date(column)


def pinned(run_ts: datetime | str | None = None) -> str:
    """The job's clock as a fixed instant (UTC now by default).

    A job pins it once, so its new table and its written rows carry one time even
    though they are computed by separate actions.
    """
    return str(run_ts if run_ts is not None else datetime.now(UTC).replace(tzinfo=None))


def run_time(run_ts: datetime | str | Column | None = None) -> Column:
    if isinstance(run_ts, Column):
        return run_ts.cast("timestamp_ntz")
    return F.lit(pinned(run_ts)).cast("timestamp_ntz")


def parse_long(column: Column | str) -> Column:
    """Integer parse of user-supplied text; NULL where it is not a number."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("long")


def page_count(total: Column | str, limit: int) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    return F.ceil(total / F.lit(limit)).cast("long")


def encode_json(column: Column | str) -> Column:
    return F.to_json(column)


def decode_json(column: Column | str, schema: str = "map<string,string>") -> Column:
    return F.from_json(column, schema)
