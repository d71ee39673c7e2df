"""Clustered tables hold the same rows, and reading one agent's skips row groups."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from dialweave import operators as ops
from dialweave import plans
from dialweave.sources import append, load_tables


def rows_read(df) -> int:
    """Rows the parquet reader hands on: those of the row groups it did not skip."""
    df.write.format("noop").mode("overwrite").save()
    done = df.select("*")
    done.collect()
    leaves = done._jdf.queryExecution().executedPlan().collectLeaves()
    plan = leaves.apply(0)
    if "QueryStage" in plan.getClass().getSimpleName():
        plan = plan.plan().collectLeaves().apply(0)
    return plan.metrics().apply("numOutputRows").value()


@pytest.fixture
def assignments(frame):
    return frame("custassignment", [
        {"assignno_pk": i, "custno_fk": i, "empno_fk": None if i % 50 == 0 else 7 if i % 3 == 0 else i * 7919 % 97,
         "calltargetdate": None if i % 41 == 0 else at("2024-01-01") + timedelta(hours=i * 31 % 4000),
         "assigndate": at("2024-01-01")} for i in range(6000)])


def test_written_rows_are_the_same_and_reads_skip(spark, assignments, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "300")
    append(assignments, str(tmp_path), "custassignment")
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    stored = load_tables(spark, str(tmp_path))["custassignment"]
    assert "__curve" not in stored.columns
    assert sorted(map(tuple, stored.select("assignno_pk", "empno_fk").collect())) == sorted(
        map(tuple, assignments.select("assignno_pk", "empno_fk").collect()))
    by_agent = ops.owned_by(stored, "empno_fk", 40)
    assert by_agent.count() == ops.owned_by(assignments, "empno_fk", 40).count() > 0
    assert rows_read(by_agent.select("assignno_pk")) <= 600
    assert "EqualTo(empno_fk,40)" in by_agent._jdf.queryExecution().executedPlan().toString()


def test_a_hot_agent_fills_many_ranges(spark, assignments, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    append(assignments, str(tmp_path), "custassignment")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = load_tables(spark, str(tmp_path))["custassignment"].where("empno_fk = 7")
    assert stored.select(F.input_file_name()).distinct().count() > 1


def test_empty_and_unbound_tables(spark, frame, make_tables, tmp_path):
    append(frame("custassignment", []), str(tmp_path / "empty"), "custassignment")
    assert load_tables(spark, str(tmp_path / "empty"))["custassignment"].count() == 0
    append(frame("custassignment", [{"assignno_pk": i} for i in range(4)]), str(tmp_path / "nulls"), "custassignment")
    assert load_tables(spark, str(tmp_path / "nulls"))["custassignment"].count() == 4


def test_a_worklist_from_a_clustered_table(spark, make_tables, assignments, tmp_path):
    t = make_tables(customer=[{"custno_pk": i, "custname": f"c{i}", "projectno_fk": 1} for i in range(6000)],
                    projects=[{"projectno_pk": 1, "projectname": "p"}]).replaced(custassignment=assignments)
    append(assignments, str(tmp_path), "custassignment")
    stored = t.replaced(custassignment=load_tables(spark, str(tmp_path))["custassignment"])
    for page in (1, 3):
        want = plans.agent_worklist(t, 40, start="2024-01-10", page=page).collect()
        got = plans.agent_worklist(stored, 40, start="2024-01-10", page=page).collect()
        assert [r["assignno_pk"] for r in got] == [r["assignno_pk"] for r in want] and want
