"""Small batches against large tables, and long chains of claims."""

from __future__ import annotations

import random
import re

import pytest
from conftest import at
from pyspark.sql import functions as F

from dialweave import maintenance as jobs
from dialweave import operators as ops
from dialweave.maintenance import changes
from dialweave.maintenance.changes import POSITION, accept_first
from dialweave.operators import sketches
from dialweave.sources import TABLES, load_tables


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A table of 200,000 customers and its companions, as files."""
    root = str(tmp_path_factory.mktemp("large"))
    for name in TABLES:
        base = spark.createDataFrame([], TABLES[name].struct)
        n = {"customer": 200_000, "custassignment": 100_000, "employees": 50_000, "projects": 30_000}.get(name, 0)
        ids = spark.range(n, numPartitions=4)
        made = {f.name: F.lit(None).cast(f.dataType) for f in base.schema}
        made[TABLES[name].key] = F.col("id").cast(base.schema[TABLES[name].key].dataType)
        if name == "custassignment":
            made["empno_fk"] = (F.col("id") % 50_000).cast("long")
            made["custno_fk"] = F.col("id").cast("long")
        if name == "employees":
            made["emailidoffical"] = F.concat(F.lit("e"), F.col("id"), F.lit("@mail.example"))
            made["username"] = F.concat(F.lit("user"), F.col("id"))
        ids.select(*[c.alias(n) for n, c in made.items()]).write.parquet(f"{root}/{name}")
    return load_tables(spark, root)


def lines(df) -> list[tuple[int, str]]:
    """(depth, node) of the plan, without the subqueries."""
    text = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    out = []
    for line in text.splitlines():
        if m := re.match(r"^([\s:|]*)(?:[+:]- )?(?:\*\(\d+\) )?(.*)$", line):
            out.append((len(m[1]) + (3 if re.match(r"^[\s:|]*[+:]- ", line) else 0), m[2]))
    return out


def exchanged_whole(df, table: str) -> list[str]:
    """Scans of a table that reach a shuffle without having met a sketch or been aggregated."""
    stack, bad = [], []
    for depth, node in lines(df):
        stack = [x for x in stack if x[0] < depth]
        if "FileScan" in node and f"/{table}]" in node:
            for _, above in reversed(stack):
                if re.match("BroadcastHashJoin", above) or re.match("HashAggregate", above):
                    break
                if re.match("Exchange", above):
                    bad.append(node)
                    break
        stack.append((depth, node))
    return bad


@pytest.fixture
def no_small_tables(spark):
    """Tables are planned as if none could be broadcast by its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hundred_rows_leave_nothing_to_shuffle(spark, large, no_small_tables):
    batch = spark.range(100).select((F.col("id") * 1999 + 7).alias("k"))
    kept = sketches.narrowed(large["customer"], "custno_pk", batch, "k")
    assert 100 <= kept.count() <= 110
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(custno_pk" not in plan
    met, rest = sketches.parted(large["customer"], [("custno_pk", batch, "k")])
    assert met.count() + rest.count() == 200_000 and met.count() <= 110


def test_small_batches_do_not_exchange_the_base(spark, large, no_small_tables):
    picked = spark.range(100).select((F.col("id") * 499 + 3).alias("k"))
    updates = picked.select(
        F.col("k").alias("pk"), F.create_map(F.lit("address"), F.lit("new")).alias("changes"), F.lit(1).cast("long").alias("updated_by"), F.col("k").alias("seq"))
    done = jobs.partial_update(large, "employees", updates)
    assert exchanged_whole(done.delta, "employees") == [] == exchanged_whole(done.new, "employees")
    assert exchanged_whole(done.rejects, "employees") == []
    assert done.delta.count() == 100 and done.new.count() == 50_000
    ordinary = jobs.partial_update(large, "employees", updates, small=False)
    assert exchanged_whole(ordinary.new, "employees") != []

    events = picked.select(
        F.col("k").alias("event_id"), F.col("k").alias("assignno_pk"), (F.col("k") % 50_000).alias("empno"), F.lit("call").alias("interaction_type"),
        F.lit(at("2024-01-01")).cast("timestamp_ntz").alias("calleddatetime"), F.lit("Done").alias("callstatus"), F.lit(None).cast("string").alias("callstatus_text"),
        F.lit(None).cast("timestamp_ntz").alias("followupdate"), F.lit(1).alias("count_call"), F.lit(None).cast("int").alias("count_message"), F.lit(5).alias("call_duration"))
    applied = jobs.apply_interactions(large, events)
    assert exchanged_whole(applied.assignments, "custassignment") == [] == exchanged_whole(applied.rejects, "custassignment")
    assert applied.assignments.where("callstatus = 'Done'").count() == 100

    assigned = picked.select(
        F.col("k").alias("custno"), F.col("k").alias("empno"), F.lit(None).cast("timestamp_ntz").alias("calltargetdate"), F.lit("High").alias("callpriority"), F.lit(1).cast("long").alias("assigned_by"))
    bulk = jobs.bulk_assign(large, assigned)
    assert exchanged_whole(bulk.rejects, "customer") == [] == exchanged_whole(bulk.rejects, "employees")
    assert bulk.delta.count() == 100

    gone = jobs.delete(large, "customer", picked.select(F.col("k").alias("custno_pk")))
    assert exchanged_whole(gone.tables["customer"], "customer") == [] == exchanged_whole(gone.tables["custassignment"], "custassignment")
    assert gone.tables["customer"].count() == 199_900

    fresh = picked.select(F.concat(F.lit("E"), F.col("k"), F.lit("@MAIL.example")).alias("emailidoffical"), F.concat(F.lit("n"), F.col("k")).alias("username"), F.lit("x").alias("name"))
    added = jobs.ingest(large, "employees", fresh)
    assert added.rejects.count() == 100 and added.delta.count() == 0


def test_what_a_sketch_drops_is_never_wanted(spark, monkeypatch):
    monkeypatch.setattr(sketches, "WORDS", 2)
    rows = spark.range(500).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("T"), F.col("id")).alias("t")).union(spark.sql("SELECT cast(null as int), cast(null as string)"))
    batch = spark.createDataFrame([(3, "T3"), (77, "T77"), (None, None), (900, "T900")], "k long, t string")
    for column in ("k", "t"):
        kept = {r[0] for r in sketches.narrowed(rows, column, batch, column).select("k").collect()}
        assert {3, 77} <= kept and None not in kept and len(kept) < 500
        met, rest = sketches.parted(rows, [(column, batch, column)])
        assert sorted((r[0] is None, r[0]) for r in met.unionByName(rest).select("k").collect()) == sorted((r[0] is None, r[0]) for r in rows.select("k").collect())
    empty = batch.limit(0)
    assert sketches.narrowed(rows, "k", empty, "k").count() == 0
    assert sketches.is_small(batch) and not sketches.is_small(batch, False)


def one_by_one(rows: list[tuple], owners: bool) -> set[int]:
    held: dict[tuple, set] = {}
    kept = set()
    for position, *values in sorted(rows):
        *values, owner = values if owners else [*values, position]
        claims = [(i, v) for i, v in enumerate(values) if v is not None]
        if all(not (held.get(c, set()) - {owner}) for c in claims):
            kept.add(position)
            for c in claims:
                held.setdefault(c, set()).add(owner)
    return kept


@pytest.mark.parametrize("owners", [False, True])
def test_claims_equal_a_one_by_one_model(spark, owners):
    draw = random.Random(4 + owners)
    for size, values in ((40, 12), (120, 70), (150, 15)):
        pick = lambda: draw.choice([None, *range(values)])  # noqa: B023, E731
        rows = [(i, pick(), pick(), pick(), draw.randrange(6)) for i in range(size)]
        df = spark.createDataFrame(rows, f"{POSITION} long, a int, b int, c int, o int")
        got = {r[0] for r in accept_first(df, ["a", "b", "c"], "o" if owners else None).collect()}
        assert got == one_by_one(rows if owners else [r[:4] for r in rows], owners)


def test_a_chain_of_ten_thousand_rows_settles_in_few_rounds(spark, monkeypatch):
    """Each row shares one value with the row before it and another with the one after."""
    rounds = []
    before = changes._settled
    monkeypatch.setattr(changes, "_settled", lambda *a: rounds.append(0) or before(*a))
    frozen = []
    freeze = changes.freeze
    monkeypatch.setattr(changes, "freeze", lambda df: frozen.append(0) or freeze(df))
    n = 10_000
    df = spark.range(n).select(F.col("id").alias(POSITION), ((F.col("id") + 1) / 2).cast("long").alias("a"), (F.col("id") / 2).cast("long").alias("b"))
    got = {r[0] for r in accept_first(df, ["a", "b"]).collect()}
    assert got == one_by_one([(i, (i + 1) // 2, i // 2) for i in range(n)], False) == set(range(0, n, 2))
    assert len(rounds) <= 2 and len(frozen) <= 20
