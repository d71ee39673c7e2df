"""A stream cut into many micro-batches must end where one batch job ends."""

from __future__ import annotations

import random

import pytest
from conftest import at, values
from pyspark.sql import functions as F
from test_jobs import EVENT, NOW, assignments, events

from dialweave import maintenance as jobs
from dialweave import plans, streaming
from dialweave.streaming import FEED_SCHEMA
from dialweave.streaming.spans import Spans


def write_files(spark, rows, schema, folder, files):
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def feed():
    return list(events(random.Random(8), 60))


def test_feed_equals_batch(spark, make_tables, feed, tmp_path):
    t = make_tables(custassignment=assignments(), call_history=[{"history_pk": 7}])
    write_files(spark, feed, EVENT, tmp_path / "in", 3)
    repeated = feed[5:25]
    write_files(spark, repeated, EVENT, tmp_path / "in", 1)
    root = str(tmp_path / "out")
    stream = streaming.interaction_stream(spark, str(tmp_path / "in"), max_files=1)
    streaming.start_interactions(stream, lambda: t, root, NOW).awaitTermination()

    batch = jobs.apply_interactions(t, spark.createDataFrame(feed, EVENT), NOW)
    columns = [c for c in batch.delta.columns if c != "history_pk"]
    logged = streaming.stored_history(spark, root)
    assert sorted(values(logged, *columns), key=str) == sorted(values(batch.delta, *columns), key=str)
    keys = sorted(r[0] for r in values(logged, "history_pk"))
    assert keys == list(range(8, 8 + len(keys)))
    assert logged.select("batch").distinct().count() > 1
    state = streaming.current_assignments(t, root)
    assert sorted(state.collect(), key=str) == sorted(batch.assignments.collect(), key=str)


def test_feed_goes_on_after_a_stop(spark, make_tables, feed, tmp_path):
    t = make_tables(custassignment=assignments())
    root = str(tmp_path / "out")

    def run():
        stream = streaming.interaction_stream(spark, str(tmp_path / "in"))
        streaming.start_interactions(stream, lambda: t, root, NOW).awaitTermination()

    write_files(spark, feed[:30], EVENT, tmp_path / "in", 1)
    run()
    write_files(spark, feed[30:], EVENT, tmp_path / "in", 1)
    run()
    run()  # nothing new
    batch = jobs.apply_interactions(t, spark.createDataFrame(feed, EVENT), NOW)
    assert streaming.stored_history(spark, root).count() == batch.delta.count()
    state = streaming.current_assignments(t, root)
    assert sorted(state.collect(), key=str) == sorted(batch.assignments.collect(), key=str)


def test_feed_schema_matches_the_job():
    assert [part.split()[0] for part in FEED_SCHEMA.split(", ")] == [part.split()[0] for part in EVENT.split(", ")]


@pytest.fixture
def days(spark, frame, tmp_path):
    rows = [{"history_pk": i, "interaction_datetime": at(f"2024-01-{1 + i // 10:02d} {i % 24:02d}:30:00"),
             "callstatus": "sales generated" if i % 4 == 0 else None} for i in range(100)]
    history = frame("call_history", rows)
    for low in range(0, 100, 25):
        part = history.where(f"history_pk >= {low} and history_pk < {low + 25}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return history


def run_days(spark, history, tmp_path):
    reader = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1)
    streaming.start_activity(reader.parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()


def test_all_days_equal_the_report_and_late_rows_amend_them(spark, make_tables, days, frame, tmp_path):
    root = str(tmp_path / "out")
    run_days(spark, days, tmp_path)
    report = lambda history: sorted(values(plans.daily_activity(make_tables().replaced(call_history=history))))
    assert sorted(values(streaming.stored_activity(spark, root))) == report(days)
    late = frame("call_history", [{"history_pk": 500, "interaction_datetime": at("2024-01-02 10:00:00"), "callstatus": "Sales Generated"}])
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run_days(spark, days, tmp_path)
    whole = report(days.unionByName(late))
    assert whole != report(days) and sorted(values(streaming.stored_activity(spark, root))) == whole
    for kept in (2, 0):
        assert streaming.fold_activity(spark, root, keep=kept)
        assert sorted(values(streaming.stored_activity(spark, root))) == whole
    assert streaming.fold_activity(spark, root) is None
    assert streaming.prune_activity(spark, root)
    assert sorted(values(streaming.stored_activity(spark, root))) == whole


def test_readers_see_whole_batches_and_repeats_count_once(spark, days, tmp_path, monkeypatch):
    """A batch that dies before its announcement is invisible, and counts once when it is run again."""
    root = str(tmp_path / "out")
    announce, tried = Spans.announce, []

    def dies(self, span):
        tried.append(span)
        if len(tried) == 3:
            raise RuntimeError("lost")
        announce(self, span)

    monkeypatch.setattr(Spans, "announce", dies)
    with pytest.raises(Exception, match="lost"):
        run_days(spark, days, tmp_path)
    assert streaming.stored_activity(spark, root).agg(F.sum("total_interactions")).first()[0] == 50
    run_days(spark, days, tmp_path)
    assert streaming.stored_activity(spark, root).agg(F.sum("total_interactions")).first()[0] == 100


def test_two_folds_give_the_same_table(spark, make_tables, feed, tmp_path):
    t = make_tables(custassignment=assignments(), call_history=[{"history_pk": 7}])
    root = str(tmp_path / "out")
    run = lambda: streaming.start_interactions(
        streaming.interaction_stream(spark, str(tmp_path / "in"), max_files=1), lambda: t, root, NOW).awaitTermination()
    write_files(spark, feed[:40], EVENT, tmp_path / "in", 4)
    run()
    state = lambda: sorted(streaming.current_assignments(t, root).collect(), key=str)
    log = lambda: sorted(streaming.stored_history(spark, root).collect(), key=str)
    before, logged = state(), log()
    reading = streaming.stored_history(spark, root)
    assert streaming.fold_interactions(spark, root, keep=1)
    assert (state(), log()) == (before, logged)
    assert streaming.fold_interactions(spark, root)
    assert (state(), log()) == (before, logged)
    # a reader that began before the folds goes on with its batches
    assert sorted(reading.collect(), key=str) == logged
    assert len(streaming.prune_interactions(spark, root)) > 2
    assert (state(), log()) == (before, logged)
    # keys go on after a fold, and the state equals that of one batch
    write_files(spark, feed[40:], EVENT, tmp_path / "in", 2)
    run()
    batch = jobs.apply_interactions(t, spark.createDataFrame(feed, EVENT), NOW)
    assert state() == sorted(batch.assignments.collect(), key=str)
    keys = sorted(r["history_pk"] for r in log())
    assert keys == list(range(8, 8 + len(keys))) and len(keys) == batch.delta.count()


def test_an_event_delivered_again_after_days_is_logged_once(spark, make_tables, feed, tmp_path):
    """The stream remembers nothing here; the ids that batches leave do, before and after a fold."""
    t = make_tables(custassignment=assignments())
    root = str(tmp_path / "out")

    def run():
        stream = streaming.interaction_stream(spark, str(tmp_path / "in"))
        streaming.start_interactions(stream, lambda: t, root, NOW, remember="0 seconds").awaitTermination()

    write_files(spark, feed[:30], EVENT, tmp_path / "in", 1)
    run()
    logged = streaming.stored_history(spark, root).count()
    write_files(spark, feed[10:25], EVENT, tmp_path / "in", 1)
    run()
    assert streaming.stored_history(spark, root).count() == logged > 0
    streaming.fold_interactions(spark, root)
    write_files(spark, feed[:30] + feed[30:], EVENT, tmp_path / "in", 1)
    run()
    batch = jobs.apply_interactions(t, spark.createDataFrame(feed, EVENT), NOW)
    assert streaming.stored_history(spark, root).count() == batch.delta.count()
