"""Live daily activity: the daily report over a stream of history rows.

Counts of a day add up, so each micro-batch writes the counts of its own rows and
readers sum them. There is no state and no watermark: every day is there as soon as
its rows are, and a row that comes late, by however much, amends its day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialweave.plans.performance import daily_counts
from dialweave.streaming.spans import Span, Spans

RESULT = "date date, total_interactions long, sales_generated long"


def _spans(spark: SparkSession, root: str) -> Spans:
    return Spans(spark, root, {"days": RESULT})


def _summed(days: DataFrame) -> DataFrame:
    return days.groupBy("date").agg(
        F.sum("total_interactions").alias("total_interactions"), F.sum("sales_generated").alias("sales_generated")
    )


def start_activity(history: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Write counts per day to ``root``; by default process what is there and stop.

    A repeated batch overwrites its own counts, so each row counts once.
    """
    spans = _spans(history.sparkSession, root)

    def add(rows: DataFrame, batch: int) -> None:
        if not spans.holds(batch):
            span = Span(batch, batch, ("days",))
            spans.write("days", daily_counts(rows), span)
            spans.announce(span)

    return (
        history.writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_activity(spark: SparkSession, root: str) -> DataFrame:
    """The counts of all announced batches, by day."""
    return _summed(_spans(spark, root).read("days"))


def fold_activity(spark: SparkSession, root: str, keep: int = 0) -> str | None:
    """Sum the counts of earlier batches into one span: a row for each day."""
    span = _spans(spark, root).fold({"days": _summed}, keep)
    return span and span.folder


def prune_activity(spark: SparkSession, root: str) -> list[str]:
    return _spans(spark, root).prune()
