from __future__ import annotations

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from dialweave import plans
from dialweave.session import shared_dir
from dialweave.sources import (
    TABLES,
    append,
    conform,
    evolve,
    jdbc_options,
    latest_version,
    load_snapshot,
    load_tables,
    manifest,
    publish,
)


@pytest.fixture
def history(frame):
    return frame("call_history", [
        {"history_pk": i, "empno_fk": i % 3, "custno_fk": i, "callstatus": "Sales Generated" if i % 2 else None,
         "interaction_datetime": at(f"2024-01-{1 + i % 9:02d} 10:00:00")} for i in range(90)])


def test_passwords_never_load(spark, tmp_path):
    raw = spark.createDataFrame([(1, "n", "hash")], "empno_pk long, name string, entrypass string")
    raw.write.parquet(f"{tmp_path}/employees")
    spark.createDataFrame([(1, "hash")], "id long, password_hash string").write.parquet(f"{tmp_path}/users")
    t = load_tables(spark, str(tmp_path))
    assert "entrypass" not in t["employees"].columns and "password_hash" not in t["users"].columns
    assert values(t["employees"], "empno_pk", "name", "username") == [(1, "n", None)]
    assert "entrypass" not in conform(raw, TABLES["employees"]).columns


def test_evolve_adds_only_what_is_missing(spark):
    users = TABLES["users"]
    df = spark.createDataFrame([(1, "gone")], "id long, status string")
    full = evolve(df, users.struct, users.defaults)
    row = full.first()
    assert (row["status"], row["role"], row["capacity"], row["restricted_data_privilege"]) == ("gone", "AGENT", 0, False)
    assert evolve(full, users.struct, users.defaults) is full
    assert dict(full.dtypes)["capacity"] == "int"


def test_every_table_declares_its_parts():
    for table in TABLES.values():
        names = set(table.columns)
        assert table.key in names
        assert names >= set(table.defaults) | set(table.unique) | set(table.updatable) | set(table.search)
        assert not names & set(table.hidden)
        for ref in table.references:
            assert ref.column in names and ref.parent in TABLES and ref.on_delete in ("CASCADE", "SET NULL")


def test_parents_are_registered_before_children():
    order = list(TABLES)
    for table in TABLES.values():
        assert all(order.index(r.parent) < order.index(table.name) for r in table.references)


def test_jdbc_reads_are_split_by_key():
    options = jdbc_options("jdbc:mysql://host/db", TABLES["customer"], (1, 900), 12)
    assert options["dbtable"] == "customer" and options["partitionColumn"] == "custno_pk"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("1", "900", "12")


def test_unknown_source_and_table(spark):
    with pytest.raises(ValueError):
        load_tables(spark, "/nowhere", source="csv")
    with pytest.raises(KeyError):
        load_tables(spark, "/nowhere")["nothing"]


def test_history_is_stored_by_day_and_pruned(spark, history, tmp_path):
    append(history, str(tmp_path), "call_history")
    append(history.withColumn("history_pk", F.col("history_pk") + 90), str(tmp_path), "call_history")
    t = load_tables(spark, str(tmp_path))
    assert t["call_history"].count() == 180
    days = plans.daily_activity(t, "2024-01-03", "2024-01-05 23:00:00")
    assert [(str(r[0]), r[1]) for r in values(days)] == [("2024-01-05", 20), ("2024-01-04", 20), ("2024-01-03", 20)]
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "interaction_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(interaction_datetime" in plan.split("PushedFilters: [")[1]


def test_history_without_day_folders_reads_the_same(spark, history, tmp_path):
    history.write.parquet(f"{tmp_path}/flat/call_history")
    append(history, f"{tmp_path}/days", "call_history")
    for folder in ("flat", "days"):
        t = load_tables(spark, f"{tmp_path}/{folder}")
        assert t["call_history"].count() == 90
        assert plans.daily_activity(t, "2024-01-03", "2024-01-05").count() == 2
        full = t.replaced(custassignment=conform(spark.range(0).select(F.col("id").alias("assignno_pk")), TABLES["custassignment"]),
                          employees=conform(spark.range(0).select(F.col("id").alias("empno_pk")), TABLES["employees"]))
        assert "interaction_day" not in plans.assignment_history(full).columns


def test_published_versions(spark, history, tmp_path):
    root = str(tmp_path)
    publish({"call_history": history}, root, 1)
    publish({"call_history": history.where("history_pk < 10")}, root, 2)
    assert latest_version(spark, root) == 2
    assert load_snapshot(spark, root)["call_history"].count() == 10
    # a version that was written but never announced stays invisible
    append(history, f"{root}/version=3", "call_history")
    assert load_snapshot(spark, root)["call_history"].count() == 10


def test_star_mapping_loses_no_row(spark):
    sf = "/root/testdata/sf0.001"
    t = load_tables(spark, sf, source="star")
    sources = {"projects": "nation", "empteam": "region", "employees": "supplier", "empteamdtl": "supplier",
               "customer": "customer", "custassignment": "orders", "call_history": "events", "calls": "orders",
               "users": "supplier"}
    for name, source in sources.items():
        assert t[name].count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
        assert t[name].schema.names == list(TABLES[name].columns)


def test_shared_dir_is_the_clusters_own(spark):
    folder = shared_dir(spark)
    assert folder and spark.sparkContext.getCheckpointDir()


def test_a_version_carries_unchanged_tables_and_is_announced_once(spark, frame, tmp_path):
    root = str(tmp_path / "snapshots")
    history = frame("call_history", [{"history_pk": i, "interaction_datetime": at("2024-01-01")} for i in range(5)])
    projects = frame("projects", [{"projectno_pk": 1, "projectname": "a"}])
    assert manifest(spark, root) == {}
    publish({"call_history": history, "projects": projects}, root, 1)
    publish({"projects": projects.limit(0)}, root, 2)
    assert manifest(spark, root) == {"call_history": 1, "projects": 2}
    now, before = load_snapshot(spark, root), load_snapshot(spark, root, 1)
    assert (now["call_history"].count(), now["projects"].count(), before["projects"].count()) == (5, 0, 1)
    assert not (tmp_path / "snapshots" / "version=2" / "call_history").exists()
    for taken in (1, 2):
        with pytest.raises(ValueError, match="announced"):
            publish({"projects": projects}, root, taken)
    with pytest.raises(KeyError):
        now["customer"]


def test_ids_given_as_text(spark, make_tables):
    t = make_tables(employees=[{"empno_pk": i, "name": f"n{i}"} for i in range(4)])
    for ids in (["1", " 3 ", "77", "x1", ""], spark.createDataFrame([("1",), (" 3 ",), ("77",), ("x1",), ("",)], "id string")):
        found, missing = plans.details(t, "employees", ids)
        assert sorted(r["empno_pk"] for r in found.collect()) == [1, 3]
        assert sorted(r[0] for r in missing.collect()) == ["", "77", "x1"]
    found, missing = plans.details(t, "employees", [2, 9])
    assert [r["empno_pk"] for r in found.collect()] == [2] and [r[0] for r in missing.collect()] == [9]
