"""Demo calls of any size, spread round-robin over people and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Demo call statuses.
STATUSES = ["completed", "pending", "in_progress", "failed"]


def _turn(values: list, position: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (position % len(values)).cast("int") + 1)


def generate_calls(
    spark: SparkSession,
    n: int,
    customers: list[tuple[str, str, str]],
    agents: list[int],
    projects: list[int],
    notes: list[str],
    seed: int = 0,
) -> DataFrame:
    """``n`` calls; only completed ones have a duration (60 to 659 seconds).

    ``customers`` holds (name, phone, email); the notes take turns like everything else. The duration is a hash of seed and
    row number, so a rerun of any task gives the same rows.
    """
    i = F.col("id")
    names, phones, emails = (list(part) for part in zip(*customers, strict=True))
    status = _turn(STATUSES, i)
    seconds = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(600)).cast("int") + 60
    return spark.range(n).select(
        "id",
        _turn(agents, i).cast("long").alias("employee_id"),
        _turn(projects, i).cast("long").alias("project_id"),
        _turn(names, i).alias("customer_name"),
        _turn(phones, i).alias("customer_phone"),
        _turn(emails, i).alias("customer_email"),
        status.alias("status"),
        _turn(notes, i).alias("notes"),
        F.when(status == "completed", seconds).alias("call_duration"),
    )
