"""Plans that must hold at any size: no broadcast by guess, hot keys spread, filters pushed down."""

from __future__ import annotations

import re

import pytest
from conftest import at
from pyspark.sql import functions as F

import __spark_entry__ as contract
from dialweave import operators as ops
from dialweave import plans
from dialweave.sources import load_tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def at_scale(spark):
    """Settings under which small test tables are planned as large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


# the library's own; the corpus queries have other rules and tests
OWN = {**contract.REPORT_QUERIES, **contract.JOB_QUERIES}
BATCH = [n for n in OWN if not n.startswith(("stream", "snapshot", "append"))]


_PLANS: dict[str, str] = {}


@pytest.fixture
def plans_at_scale(spark, at_scale):
    if not _PLANS:
        _PLANS.update({name: plan_of(contract.queries()[name](spark, SF)) for name in BATCH})
    return _PLANS


def test_no_pairwise_joins_and_no_expand(plans_at_scale):
    for name, plan in plans_at_scale.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Expand", "Python"):
            assert bad not in plan, (name, bad)


def test_only_bounded_sides_are_broadcast(plans_at_scale):
    """With the size threshold off, what is still broadcast was hinted: pages, key offsets, and sketches of at most WORDS words."""
    allowed = {"assignments_listing", "assignments_listing_agent", "agent_worklist", "agent_worklist_filtered",
               "ingest_employees", "ingest_team_members", "insert_ignore", "interaction_history", "bulk_assign"}
    joins = {name: [x for x in plan.splitlines() if "BroadcastHashJoin" in x] for name, plan in plans_at_scale.items()}
    seen = {name for name, lines in joins.items() if any("__word#" not in x for x in lines)}
    assert seen <= allowed


@pytest.mark.parametrize("name", [n for n in BATCH if n.endswith("_listing") and n != "calls_listing"])
def test_listings_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan_of(contract.queries()[name](spark, SF))


def test_a_page_is_cut_before_names_are_joined(spark):
    for name in ("recent_calls", "customers_listing", "projects_listing", "teams_listing"):
        plan = plan_of(contract.queries()[name](spark, SF))
        assert plan.index("Join") < plan.index("TakeOrderedAndProject"), name


def test_reports_read_only_their_columns_and_push_dates(spark):
    t = load_tables(spark, SF, source="star")
    plan = plan_of(plans.daily_activity(t, "2024-01-05", "2024-01-25"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "LessThanOrEqual(ts,2024-01-25T00:00)" in plan
    plan = plan_of(plans.agent_performance(t, "2024-01-05"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "value:double" not in plan
    plan = plan_of(plans.project_performance(t))
    assert "props" not in plan and re.search(r"hashpartitioning\(custno_fk", plan)


def test_key_filters_reach_the_scan(spark, frame, tmp_path):
    frame("custassignment", [{"assignno_pk": i, "empno_fk": i % 5} for i in range(50)]).write.parquet(
        f"{tmp_path}/custassignment")
    t = load_tables(spark, str(tmp_path))
    assert "EqualTo(empno_fk,3)" in plan_of(ops.owned_by(t["custassignment"], "empno_fk", "3"))
    found, _ = ops.lookup(t["custassignment"], "assignno_pk", [1, 2])
    assert "In(assignno_pk, [1,2])" in plan_of(found)


def skewed(spark, n=30000):
    """A third of all rows share one key."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    return spark.range(n, numPartitions=8).select(hot.cast("long").alias("fk"), F.col("id").alias("v"),
                                                  F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def skewed_joins(df) -> int:
    df.write.format("noop").mode("overwrite").save()
    done = df.select("*")
    done.collect()
    return plan_of(done).count("skew=true")


def test_a_hot_key_is_split_in_every_join_shape(spark, at_scale):
    facts = skewed(spark)
    dim = spark.range(5000).select(F.col("id").alias("pk"), F.col("id").cast("string").alias("name"))
    assert skewed_joins(ops.attach(facts, dim, "fk", "pk", {"n": "name"})) > 0
    assert skewed_joins(ops.attach(facts, dim, "fk", "pk", {"n": "name"}, how="inner")) > 0
    assert skewed_joins(ops.having(facts, "fk", dim, "pk", unique=True)) > 0
    assert skewed_joins(ops.lacking(facts, "fk", dim, "pk", unique=True)) > 0
    assert skewed_joins(ops.fan_out(dim, "pk", facts, "fk", {"v": "v", "pad": "pad"})) > 0


def test_a_hot_key_is_reduced_before_the_shuffle(spark, at_scale):
    facts = skewed(spark)
    counts = ops.conditional_counts(facts, ["fk"], {"n": None})
    counts.collect()
    assert dict(counts.where("fk = 7").collect()) == {7: facts.where("fk = 7").count()}
    plan = plan_of(counts)
    assert plan.index("Exchange") < plan.rindex("HashAggregate")  # a partial aggregate below it


def test_distinct_customers_shuffle_on_the_pair_first(spark, at_scale):
    plan = plan_of(plans.agent_performance(load_tables(spark, SF, source="star")))
    assert "hashpartitioning(empno_fk" in plan and re.search(r"hashpartitioning\(empno_fk#\d+L, custno_fk#\d+L", plan)


def test_deep_pages_leave_memory(spark, frame):
    rows = frame("customer", [{"custno_pk": i, "au_entryat": at("2024-01-01")} for i in range(30)])
    deep = ops.paginate(rows, [ops.newest("au_entryat")], "custno_pk", page=200_000, limit=10)
    assert "TakeOrderedAndProject" not in plan_of(deep)
    assert deep.collect() == []
