"""Maintenance jobs against row-by-row models of what the requests would have done."""

from __future__ import annotations

import random

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from dialweave import maintenance as jobs
from dialweave.maintenance.changes import POSITION, number_rows, positioned
from dialweave.sources import SET_NULL_RULES, TABLES

NOW = "2024-06-01 09:00:00"


# --- keys and first-come rules ------------------------------------------------------


def test_keys_are_dense_and_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = positioned(df, ["v"])
    dense = values(number_rows(rows, "k", 100, complete=True).orderBy("v"), "v", "k")
    assert dense == [(v, 101 + v) for v in range(1000)]
    some = number_rows(rows.where("v % 3 = 0"), "k", 0)
    assert values(some.orderBy("v"), "v", "k") == [(v, 1 + i) for i, v in enumerate(range(0, 1000, 3))]


def model_first(rows, owner):
    taken, accepted = [{}, {}], []
    for pos, a, b, who in rows:
        clash = any(
            v is not None and v in taken[i] and (not owner or taken[i][v] != who) for i, v in enumerate((a, b))
        )
        if not clash:
            accepted.append(pos)
            for i, v in enumerate((a, b)):
                if v is not None:
                    taken[i].setdefault(v, who)
    return accepted


@pytest.mark.parametrize("seed,owner", [(1, False), (2, False), (3, True), (4, True)])
def test_first_come_equals_one_by_one(spark, seed, owner):
    rng = random.Random(seed)
    hot = [None, "x"] + [f"v{i}" for i in range(12)]
    rows = [(i, rng.choice(hot), rng.choice(hot), rng.randrange(6)) for i in range(60)]
    df = spark.createDataFrame(rows, f"{POSITION} long, a string, b string, who long")
    got = jobs.accept_first(df, ["a", "b"], owner="who" if owner else None)
    assert sorted(r[0] for r in values(got)) == model_first(rows, owner)


def test_first_come_on_a_chain(spark):
    # each row shares one value with the next: every second row is accepted
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(9)]
    df = spark.createDataFrame(rows, f"{POSITION} long, a string, b string")
    assert sorted(values(jobs.accept_first(df, ["a", "b"]))) == [(i,) for i in range(0, 9, 2)]


# --- ingest ---------------------------------------------------------------------------


@pytest.fixture
def staff(make_tables):
    return make_tables(
        projects=[{"projectno_pk": 1, "projectname": "p"}],
        empteam=[{"teamno_pk": 1, "teamname": "t"}],
        employees=[{"empno_pk": 10, "name": "Old", "emailidoffical": "old@x.org", "username": "old"}],
        empteamdtl=[{"teamdtlno_pk": 5, "teamno_fk": 1, "empno_fk": 10}],
    )


STAFF = "seq int, name string, emailidoffical string, username string, entrypass string, assigned_project_id long, role string"


def test_ingest_employees(staff, spark):
    batch = spark.createDataFrame(
        [
            (1, "Ann", "ann@x.org", "ann", "secret1", 1, ""),
            (2, "", "no-mail", None, "short", None, None),
            (3, "Bob", "OLD@x.org", "bob", "secret1", None, None),
            (4, "Cid", "cid@x.org", "ANN", "secret1", None, None),
            (5, "Dee", "dee@x.org", "dee", "secret1", 9, None),
            (6, "Eve", "eve@x.org", "eve", "secret1", None, "Manager"),
        ],
        STAFF,
    )
    change = jobs.ingest(staff, "employees", batch, NOW, user=3, order_by=["seq"])
    rows = change.delta.orderBy("empno_pk").collect()
    assert [(r["empno_pk"], r["name"], r["role"]) for r in rows] == [(11, "Ann", "AGENT"), (12, "Eve", "Manager")]
    first = rows[0]
    assert (first["capacity"], first["empstatus"], first["restricteddataprivilege"]) == (0, "Active", "N")
    assert first["joindate"] == first["au_entryat"] == at(NOW) and first["au_entryempnoby"] == 3
    assert {r["seq"]: r["reasons"] for r in change.rejects.collect()} == {
        2: ["name", "emailidoffical", "username", "entrypass"],
        3: ["emailidoffical exists"],
        4: ["duplicate in batch"],
        5: ["assigned_project_id not found"],
    }
    assert "entrypass" not in change.rejects.columns + change.delta.columns
    assert change.new.count() == 3
    keys = change.new.select(F.lower("emailidoffical").alias("e"))
    assert keys.distinct().count() == keys.count()


def test_registration_uses_the_email_as_user_name(staff, spark):
    batch = spark.createDataFrame(
        [("Ann", "ann@x.org", "secret1", "agent"), ("Bob", "bob@x.org", "secret1", "boss")],
        "name string, emailidoffical string, entrypass string, role string",
    )
    change = jobs.ingest(staff, "registrations", batch, NOW)
    assert values(change.delta, "username", "role") == [("ann@x.org", "agent")]
    assert values(change.rejects, "name", "reasons") == [("Bob", ["role"])]


def test_ingest_team_members(staff, spark):
    rows = [(1, 10), (1, 11), (2, 10), (None, 10)]
    batch = spark.createDataFrame(rows, "teamno_fk long, empno_fk long")
    change = jobs.ingest(staff, "empteamdtl", batch, NOW)
    assert change.delta.count() == 0
    assert {(r[0], r[1]): r[2] for r in values(change.rejects)} == {
        (1, 10): ["teamno_fk+empno_fk exists"],
        (1, 11): ["empno_fk not found"],
        (2, 10): ["teamno_fk not found"],
        (None, 10): ["teamno_fk"],
    }


@pytest.mark.parametrize("kind,row,default", [
    ("projects", {"projectname": "n"}, ("projectstatus", "OPEN")),
    ("customer", {"custname": "n"}, ("custtype", "Undefined")),
    ("empteam", {"teamname": "n"}, ("teamremarks", None)),
    ("users", {"name": "n", "email": "a@b.org"}, ("status", "active")),
])
def test_ingest_defaults_and_first_key(make_tables, spark, kind, row, default):
    batch = spark.createDataFrame([tuple(row.values())], list(row))
    change = jobs.ingest(make_tables(), kind, batch, NOW)
    (only,) = change.delta.collect()
    assert only[TABLES[kind].key] == 1 and only[default[0]] == default[1]
    assert change.rejects.count() == 0


def test_insert_ignore_twice_is_once(make_tables, spark):
    t = make_tables(employees=[{"empno_pk": 1, "emailidoffical": "a@x"}])
    batch = spark.createDataFrame(
        [(1, "A@x"), (2, "b@x"), (3, "B@X"), (4, None), (5, None)], "seq int, emailidoffical string"
    )
    once = jobs.insert_ignore(t, "employees", batch, ["emailidoffical"], ["seq"], NOW, user=3)
    assert once.new.columns == t["employees"].columns
    added = values(once.delta.orderBy("empno_pk"), "empno_pk", "emailidoffical", "au_entryempnoby")
    assert added == [(2, "b@x", 3), (3, None, 3), (4, None, 3)]
    defaults = TABLES["employees"].defaults
    assert all(r[c] == v for r in once.delta.collect() for c, v in defaults.items())
    assert sorted(values(once.rejects)) == [("A@X", 1), ("B@X", 1)]
    named = batch.where("emailidoffical is not null")
    first = jobs.insert_ignore(t, "employees", named, ["emailidoffical"], ["seq"], NOW).new
    again = jobs.insert_ignore(t.replaced(employees=first), "employees", named, ["emailidoffical"], ["seq"], NOW)
    assert again.delta.count() == 0 and again.new.count() == first.count()


# --- updates --------------------------------------------------------------------------

FEED = "pk long, changes map<string,string>, updated_by long, seq long"


def test_empty_feed_changes_nothing(frame, make_tables, spark):
    t = make_tables(custassignment=[{"assignno_pk": i, "callstatus": "x"} for i in range(5)])
    change = jobs.partial_update(t, "custassignment", spark.createDataFrame([], FEED), NOW)
    assert sorted(change.new.collect()) == sorted(t["custassignment"].collect())
    assert change.delta.count() == change.rejects.count() == 0


def test_partial_update_equals_one_by_one(make_tables, spark):
    rng = random.Random(11)
    columns = ["callstatus", "callpriority", "count_call", "unknown"]
    base = [{"assignno_pk": i, "callstatus": "s", "callpriority": "Low", "count_call": 0} for i in range(6)]
    feed = []
    for seq in range(80):
        chosen = rng.sample(columns, rng.randrange(1, 4))
        changes = {c: rng.choice([None, "1", "2"]) if c == "count_call" else rng.choice([None, "", "v", "w"]) for c in chosen}
        feed.append((rng.choice([0, 0, 0, 1, 2, 3, 99]), changes, seq, seq))
    want = {r["assignno_pk"]: dict(r, by=None) for r in base}
    for pk, changes, by, _ in feed:
        if pk in want:
            want[pk].update({c: (int(v) if v and c == "count_call" else v) for c, v in changes.items() if c != "unknown"})
            want[pk]["by"] = by
    t = make_tables(custassignment=base)
    shuffled = spark.createDataFrame(rng.sample(feed, len(feed)), FEED).repartition(5)
    change = jobs.partial_update(t, "custassignment", shuffled, NOW)
    got = {r["assignno_pk"]: r for r in change.new.collect()}
    for pk, row in want.items():
        r = got[pk]
        assert (r["callstatus"], r["callpriority"], r["count_call"], r["au_updateempnoby"]) == (
            row["callstatus"], row["callpriority"], row["count_call"], row["by"])
        assert r["au_updateat"] == (at(NOW) if row["by"] is not None else None)
    assert all(r["reasons"] == ["not found"] and r["pk"] == 99 for r in change.rejects.collect())
    touched = {pk for pk, row in want.items() if row["by"] is not None}
    assert {r["assignno_pk"] for r in change.delta.collect()} == touched


def test_partial_update_reasons(make_tables, spark):
    t = make_tables(
        projects=[{"projectno_pk": 1, "projectname": "p", "projectstatus": "OPEN"}],
        employees=[
            {"empno_pk": 1, "username": "a", "emailidoffical": "a@x", "capacity": 1},
            {"empno_pk": 2, "username": "b", "emailidoffical": "b@x"},
        ],
    )
    feed = spark.createDataFrame(
        [
            (1, {"username": "B"}, 9, 1),
            (1, {"username": "A", "capacity": "x"}, 9, 2),
            (1, {"assigned_project_id": "7"}, 9, 3),
            (1, {"nothing": "1"}, 9, 4),
            (2, {"username": "new"}, 9, 5),
            (1, {"username": "NEW"}, 9, 6),
            (2, {"emailidoffical": None, "assigned_project_id": "1"}, 9, 7),
            (3, {"username": "new"}, 9, 0),
            (2, {"username": "newer"}, 9, 8),
        ],
        FEED,
    )
    change = jobs.partial_update(t, "employees", feed, NOW)
    assert {r["seq"]: r["reasons"] for r in change.rejects.collect()} == {
        0: ["not found"],
        1: ["username in use"],
        2: ["invalid capacity"],
        3: ["assigned_project_id not found"],
        4: ["no valid fields"],
        6: ["claimed by an earlier change"],
    }
    rows = sorted(values(change.new, "empno_pk", "username", "emailidoffical", "assigned_project_id"))
    assert rows == [(1, "a", "a@x", None), (2, "newer", None, 1)]


def test_update_claims_with_colliding_seq_equal_one_by_one(make_tables, spark):
    import random

    draw = random.Random(7)
    for _ in range(4):
        held = {pk: f"u{pk}" for pk in range(1, 9)}
        t = make_tables(employees=[{"empno_pk": pk, "username": name} for pk, name in held.items()])
        feed = [(pk, {"username": f"n{draw.randrange(4)}"}, 1, draw.randrange(2)) for pk in draw.sample(range(1, 9), 8)]
        change = jobs.partial_update(t, "employees", spark.createDataFrame(feed, FEED), NOW)
        taken, refused = {}, set()
        for pk, wanted, _, seq in sorted(feed, key=lambda r: (r[3], r[0])):
            if taken.setdefault(wanted["username"], pk) != pk:
                refused.add((pk, seq))
        assert {(r["pk"], r["seq"]) for r in change.rejects.collect()} == refused
        names = [r["username"] for r in change.new.collect()]
        assert len(names) == len(set(names))


def test_user_update_rules(make_tables, spark):
    t = make_tables(users=[{"id": 1, "email": "a@b.org", "role": "AGENT", "social_ids": "{}"}])
    feed = spark.createDataFrame(
        [
            (1, {"email": "nope"}, 9, 1),
            (1, {"role": "agent"}, 9, 2),
            (1, {"email": None}, 9, 3),
            (1, {"role": "MANAGER", "social_ids": ""}, 9, 4),
        ],
        FEED,
    )
    change = jobs.partial_update(t, "users", feed, NOW)
    assert {r["seq"]: r["reasons"] for r in change.rejects.collect()} == {
        1: ["invalid email"], 2: ["invalid role"], 3: ["invalid email"]}
    assert values(change.new, "email", "role", "social_ids", "updated_at") == [("a@b.org", "MANAGER", None, at(NOW))]


def test_set_status(make_tables):
    t = make_tables(users=[{"id": i, "status": "active"} for i in (1, 2)])
    change = jobs.set_status(t, "users", [2, 8], run_ts=NOW)
    assert sorted(values(change.new, "id", "status", "updated_at")) == [(1, "active", None), (2, "inactive", at(NOW))]
    assert values(change.rejects, "id") == [(8,)]


# --- interactions -----------------------------------------------------------------------

EVENT = (
    "event_id long, assignno_pk long, empno long, interaction_type string, calleddatetime timestamp_ntz, "
    "callstatus string, callstatus_text string, followupdate timestamp_ntz, count_call int, count_message int, "
    "call_duration int"
)


def events(rng, n, hot=0):
    for i in range(n):
        pick = hot if rng.random() < 0.4 else rng.randrange(8)
        yield (i, pick, rng.choice([1, 1, 1, 2]), rng.choice([None, "", "sms"]),
               rng.choice([None, at(f"2024-01-{1 + rng.randrange(28):02d}")]), rng.choice([None, "", "s", "t"]),
               rng.choice([None, "text"]), None, rng.choice([None, 3, 4]), rng.choice([None, 1]), rng.choice([None, 60]))


def assignments():
    return [{"assignno_pk": i, "empno_fk": None if i == 6 else 1, "custno_fk": 100 + i, "callstatus": "Pending",
             "count_call": 0, "count_message": 0} for i in range(7)]


def model_apply(rows, feed):
    state = {r["assignno_pk"]: dict(r) for r in rows}
    log, refused = [], []
    for e in feed:
        row = state.get(e[1])
        if row is None or row["empno_fk"] != e[2]:
            refused.append(e[0])
            continue
        for name, value in zip(("calleddatetime", "callstatus", "callstatus_text", "followupdate", "count_call", "count_message"), e[4:10], strict=True):
            if value is not None:
                row[name] = value
        row["by"] = e[2]
        log.append((e[1], row["custno_fk"], e[2], e[3] or "call", e[4] or at(NOW), e[5], e[10]))
    return state, log, refused


def test_interactions_equal_one_by_one(make_tables, spark):
    rng = random.Random(5)
    feed = list(events(rng, 120))
    state, log, refused = model_apply(assignments(), feed)
    t = make_tables(custassignment=assignments(), call_history=[{"history_pk": 40}])
    df = spark.createDataFrame(rng.sample(feed, len(feed)), EVENT).repartition(6)
    applied = jobs.apply_interactions(t, df, NOW)
    for r in applied.assignments.collect():
        want = state[r["assignno_pk"]]
        for c in ("calleddatetime", "callstatus", "callstatus_text", "count_call", "count_message"):
            assert r[c] == want.get(c), (r["assignno_pk"], c)
        assert (r["au_updateempnoby"], r["au_updateat"]) == ((1, at(NOW)) if "by" in want else (None, None))
    logged = values(applied.delta.orderBy("history_pk"), "assignno_fk", "custno_fk", "empno_fk", "interaction_type",
                    "interaction_datetime", "callstatus", "call_duration")
    assert logged == log
    assert [r[0] for r in values(applied.delta.orderBy("history_pk"), "history_pk")] == [41 + i for i in range(len(log))]
    assert sorted(r[0] for r in values(applied.rejects, "event_id")) == refused
    assert applied.history.count() == 1 + len(log)


def test_folding_by_call_time(make_tables, spark):
    t = make_tables(custassignment=[{"assignno_pk": 1, "empno_fk": 1, "callstatus": "Pending"}])
    feed = [(1, 1, 1, None, at("2024-03-01"), "late", None, None, None, None, None),
            (2, 1, 1, None, at("2024-01-01"), "early", None, None, None, None, None)]
    df = spark.createDataFrame(feed, EVENT)
    assert values(jobs.apply_interactions(t, df, NOW).assignments, "callstatus") == [("early",)]
    by_time = jobs.apply_interactions(t, df, NOW, ["calleddatetime", "event_id"])
    assert values(by_time.assignments, "callstatus") == [("late",)]


def test_bulk_assign(make_tables, spark):
    t = make_tables(
        customer=[{"custno_pk": 1, "custmobilenumber": "111"}, {"custno_pk": 2, "custmobilenumber": ""}],
        employees=[{"empno_pk": 5}],
        custassignment=[{"assignno_pk": 8}],
    )
    batch = spark.createDataFrame(
        [(1, 5, None, "High", 3), (2, 5, at("2024-07-01"), "", 3), (9, 5, None, None, 3), (1, 6, None, None, 3)],
        "custno long, empno long, calltargetdate timestamp_ntz, callpriority string, assigned_by long",
    )
    change = jobs.bulk_assign(t, batch, NOW)
    got = values(change.delta.orderBy("assignno_pk"), "assignno_pk", "custno_fk", "custmobilenumber", "callpriority",
                 "callstatus", "calltargetdate", "assigndate", "au_entryempnoby", "count_call")
    assert got == [(9, 1, "111", "High", "Pending", None, at(NOW), 3, 0),
                   (10, 2, None, "Low", "Pending", at("2024-07-01"), at(NOW), 3, 0)]
    assert sorted((r["custno"], r["empno"], r["reasons"]) for r in change.rejects.collect()) == [
        (1, 6, ["employee not found"]), (9, 5, ["customer not found"])]


# --- deletes and integrity ------------------------------------------------------------------


@pytest.fixture
def linked(make_tables):
    return make_tables(
        empteam=[{"teamno_pk": 1}],
        projects=[{"projectno_pk": 1, "projectdefault_teamno_fk": 1}],
        employees=[{"empno_pk": 1, "assigned_project_id": 1}, {"empno_pk": 2}],
        empteamdtl=[{"teamdtlno_pk": 1, "teamno_fk": 1, "empno_fk": 1}],
        customer=[{"custno_pk": i, "projectno_fk": 1} for i in (1, 2, 3)],
        custassignment=[{"assignno_pk": i, "custno_fk": c, "empno_fk": e} for i, c, e in
                        [(1, 1, 1), (2, 2, 1), (3, 2, 2), (4, None, None)]],
        call_history=[{"history_pk": i, "assignno_fk": a, "custno_fk": c, "empno_fk": e} for i, a, c, e in
                      [(1, 1, 1, 1), (2, 2, 1, 2), (3, None, 2, 2), (4, 3, 3, 2), (5, None, None, None)]],
        calls=[{"id": 1, "employee_id": 1, "project_id": 1}],
    )


def keys(tables, name):
    return sorted(r[0] for r in values(tables[name], TABLES[name].key))


def test_delete_cascades_through_assignments(linked, spark):
    gone = jobs.delete(linked, "customer", spark.createDataFrame([(1,), (9,)], "custno_pk long"))
    assert keys(gone.tables, "customer") == [2, 3]
    assert keys(gone.tables, "custassignment") == [2, 3, 4]
    assert keys(gone.tables, "call_history") == [3, 4, 5]
    assert values(gone.missing) == [(9,)]
    assert values(gone.deleted, "custno_pk", "projectno_fk") == [(1, 1)]
    assert sorted(values(gone.removed["call_history"])) == [(1,), (2,)]
    assert jobs.orphans(gone.tables).count() == 0


def test_delete_employee_under_both_rules(linked, spark):
    who = spark.createDataFrame([(1,)], "empno_pk long")
    hard = jobs.delete(linked, "employees", who).tables
    assert keys(hard, "custassignment") == [3, 4] and keys(hard, "call_history") == [3, 4, 5]
    assert keys(hard, "empteamdtl") == [] and values(hard["calls"], "employee_id") == [(None,)]
    soft = jobs.delete(linked, "employees", who, SET_NULL_RULES).tables
    assert keys(soft, "custassignment") == [1, 2, 3, 4] and keys(soft, "call_history") == [1, 2, 3, 4, 5]
    assert sorted(values(soft["custassignment"], "assignno_pk", "empno_fk"), key=str) == [
        (1, None), (2, None), (3, 2), (4, None)]
    assert jobs.orphans(hard).count() == jobs.orphans(soft).count() == 0


def test_delete_project_and_team_set_null(linked, spark):
    gone = jobs.delete(linked, "projects", spark.createDataFrame([(1,)], "projectno_pk long")).tables
    assert set(values(gone["customer"], "projectno_fk")) == {(None,)}
    assert values(gone["calls"], "project_id") == [(None,)] and keys(gone, "call_history") == [1, 2, 3, 4, 5]
    team = jobs.delete(linked, "empteam", spark.createDataFrame([(1,)], "teamno_pk long")).tables
    assert keys(team, "empteamdtl") == [] and values(team["projects"], "projectdefault_teamno_fk") == [(None,)]


def test_delete_member_needs_both_ids(linked, spark):
    pairs = spark.createDataFrame([(2, 1), (1, 1)], "teamno_fk long, teamdtlno_pk long")
    gone = jobs.delete(linked, "empteamdtl", pairs)
    assert keys(gone.tables, "empteamdtl") == [] and values(gone.missing) == [(2, 1)]


def test_orphans_are_counted_per_key(make_tables):
    t = make_tables(customer=[{"custno_pk": 1}], custassignment=[
        {"assignno_pk": 1, "custno_fk": 1}, {"assignno_pk": 2, "custno_fk": 7}, {"assignno_pk": 3, "custno_fk": 7},
        {"assignno_pk": 4, "empno_fk": 8}])
    assert sorted(values(jobs.orphans(t))) == [
        ("custassignment", "custno_fk", 7, 2), ("custassignment", "empno_fk", 8, 1)]


def test_validation_splits_all_rows(spark):
    mails = ["a@b.org", "a.b@c.d.org", "a@b", "a b@c.org", "@c.org", "a@c..org", "", None]
    df = spark.createDataFrame([(m,) for m in mails], "email string")
    good, bad = jobs.validate(df, {"email": jobs.email_ok("email")})
    assert [r[0] for r in values(good)] == mails[:2]
    assert good.count() + bad.count() == len(mails)
    none, empty = jobs.validate(df, {})
    assert none.count() == len(mails) and empty.count() == 0
