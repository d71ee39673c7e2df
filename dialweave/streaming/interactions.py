"""The interaction feed as a stream.

Each micro-batch writes only what it adds: its history rows, and one folded change
per assignment it touched. The assignment table itself is not rewritten; readers
merge the changes, and a fold turns those of many batches into those of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialweave.functions import pinned, run_time
from dialweave.maintenance.interactions import (
    REPORTED,
    fold_events,
    history_rows,
    merge_folded,
    split_by_owner,
)
from dialweave.operators.joins import lacking
from dialweave.operators.sketches import narrowed
from dialweave.session import freeze
from dialweave.sources.schema import TABLES, conform
from dialweave.sources.tables import Tables
from dialweave.streaming.spans import Span, Spans, numbered

FEED_SCHEMA = (
    "event_id long, assignno_pk long, empno long, interaction_type string, calleddatetime timestamp_ntz, "
    "callstatus string, callstatus_text string, followupdate timestamp_ntz, count_call int, "
    "count_message int, call_duration int"
)

# A micro-batch up to this many events names few enough assignments to broadcast.
BROADCAST_EVENTS = 100_000

_HISTORY = TABLES["call_history"]
_ASSIGNMENTS = TABLES["custassignment"]


def interaction_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of parquet files with feed rows, as a stream."""
    reader = spark.readStream.schema(FEED_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _without_repeats(feed: DataFrame, remember: str) -> DataFrame:
    """Drop events delivered twice within ``remember``.

    The watermark runs on arrival time, so no event is ever late and none is lost.
    """
    arrived = feed.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", remember)
    return arrived.dropDuplicatesWithinWatermark(["event_id"]).drop("__arrived")


def _history_schema() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _HISTORY.struct) + ", batch long"


def _changes_schema() -> str:
    kinds = ", ".join(f"{c} {_ASSIGNMENTS.struct[c].dataType.simpleString()}" for c in REPORTED)
    return f"assignno_pk long, empno long, {kinds}, applied_at timestamp_ntz, batch long"


#: What every batch writes: log rows, folded changes, the ids of its events, and the last log key in use.
PARTS = ("history", "changes", "seen", "progress")


def _spans(spark: SparkSession, root: str) -> Spans:
    kinds = {"history": _history_schema(), "changes": _changes_schema(), "seen": "event_id long", "progress": "last_key long"}
    return Spans(spark, root, kinds)


def _by_id(ids: DataFrame) -> DataFrame:
    """Ids in files of narrow ranges, so that their statistics rule most of them out."""
    return ids.repartitionByRange("event_id").sortWithinPartitions("event_id")


def _unseen(events: DataFrame, seen: DataFrame, count: int) -> DataFrame:
    """Events that no earlier batch has applied, however long ago.

    The ids of all earlier batches are held to the range of this batch's, which most of
    their files lie outside of, and to its sketch, before they meet.
    """
    earlier = narrowed(seen, "event_id", events, "event_id", count <= BROADCAST_EVENTS)
    return lacking(events, "event_id", earlier, "event_id")


def _last_key(spans: Spans, tables: Tables) -> int:
    """The highest history key in use: the base's for the first batch, then the latest span's."""
    live = spans.live()
    if live:
        return spans.read("progress", live[-1:]).agg(F.max("last_key")).first()[0]
    return tables["call_history"].agg(F.coalesce(F.max("history_pk"), F.lit(0))).first()[0]


def _named(assignments: DataFrame, events: DataFrame, count: int) -> DataFrame:
    """The assignments a micro-batch names.

    A batch of checked size is broadcast, which spares shuffling the whole table; a
    larger one is left to an ordinary join.
    """
    names = events.select(F.col("assignno_pk").alias("__named")).distinct()
    names = F.broadcast(names) if count <= BROADCAST_EVENTS else names
    return assignments.join(names, F.col("assignno_pk") == F.col("__named"), "left_semi")


def start_interactions(
    feed: DataFrame, tables: Callable[[], Tables], root: str, run_ts=None, remember: str = "1 day", **trigger
) -> StreamingQuery:
    """Apply a feed; by default process what is there and stop.

    ``tables`` opens the base tables, once per micro-batch. A repeated batch overwrites
    its own folders and numbers its rows from the same start, and an announced one is
    left alone, so a restart neither loses nor repeats an event. An event delivered again
    is applied once: within ``remember`` the stream's state knows it, later the ids that
    every batch leaves. The work of a batch grows with the batch: the base history is
    read once for its highest key, and assignments are only filtered.
    """
    spark = feed.sparkSession
    spans = _spans(spark, root)

    def apply(events: DataFrame, batch: int) -> None:
        if spans.holds(batch):
            return
        events = freeze(events)  # read by several jobs below, computed once
        count = events.count()
        if count == 0:
            return
        events = freeze(_unseen(events, spans.read("seen"), count))
        moment, opened, span = pinned(run_ts), tables(), Span(batch, batch, PARTS)
        assignments = _named(conform(opened["custassignment"], _ASSIGNMENTS), events, count)
        accepted = freeze(split_by_owner(events, assignments)[0])
        start = _last_key(spans, opened)
        spans.write("history", numbered(history_rows(accepted, start, moment), batch), span)
        folded = fold_events(accepted, ["event_id"]).withColumn("applied_at", run_time(moment))
        spans.write("changes", numbered(folded, batch), span)
        spans.write("seen", _by_id(events.select("event_id").where("event_id IS NOT NULL")), span)
        reached = spark.range(1, numPartitions=1).select(F.lit(start + accepted.count()).alias("last_key"))
        spans.write("progress", reached, span)
        spans.announce(span)

    return (
        _without_repeats(feed, remember)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_history(spark: SparkSession, root: str) -> DataFrame:
    """History rows logged by the stream, with their batch."""
    return _spans(spark, root).read("history")


def _changes(spans: Spans) -> DataFrame:
    return fold_events(spans.read("changes"), ["batch"])


def current_assignments(tables: Tables, root: str) -> DataFrame:
    """The assignment table with everything the stream has reported."""
    base = conform(tables["custassignment"], _ASSIGNMENTS)
    return merge_folded(base, _changes(_spans(base.sparkSession, root)))


def _refolded(changes: DataFrame) -> DataFrame:
    """Changes of several batches as one for each assignment and agent, which takes the last one's place."""
    last = changes.groupBy("assignno_pk", "empno").agg(F.max("batch").alias("batch"))
    return fold_events(changes, ["batch"]).join(last, ["assignno_pk", "empno"])


def fold_interactions(spark: SparkSession, root: str, keep: int = 0) -> str | None:
    """Rewrite what earlier batches left as one span, all but the ``keep`` newest spans.

    Readers see the batches or the span, never both. The table of assignments and the
    log are the same before and after, and so after any number of folds.
    """
    how = {
        "history": lambda rows: rows.hint("rebalance"),
        "changes": _refolded,
        "seen": _by_id,
        "progress": lambda rows: rows.agg(F.max("last_key").alias("last_key")),
    }
    span = _spans(spark, root).fold(how, keep)
    return span and span.folder


def prune_interactions(spark: SparkSession, root: str) -> list[str]:
    """Delete what folds have replaced, when no reader is at it any more."""
    return _spans(spark, root).prune()
