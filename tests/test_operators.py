from __future__ import annotations

import itertools
import random

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from dialweave import operators as ops
from dialweave.functions import decode_json, encode_json, parse_long


def test_where_equal_skips_absent_values(frame):
    rows = frame("customer", [{"custno_pk": 1, "custtype": "VIP", "projectno_fk": 0},
                              {"custno_pk": 2, "custtype": "vip", "projectno_fk": 2},
                              {"custno_pk": 3, "custtype": None, "projectno_fk": None}])

    def found(ci=True, **equal):
        return sorted(r[0] for r in values(ops.where_equal(rows, equal, ci), "custno_pk"))

    assert found() == found(custtype=None, projectno_fk="") == [1, 2, 3]
    assert found(custtype="Vip") == [1, 2]
    assert found(ci=False, custtype="vip") == [2]
    assert found(projectno_fk="2") == found(projectno_fk=2) == [2]
    assert found(projectno_fk=0) == [1]
    assert found(projectno_fk="x") == []


def test_lookup_reports_missing_keys(frame, spark):
    rows = frame("customer", [{"custno_pk": i} for i in (1, 2, 3)])
    for keys in ([1, 3, 9, 9], spark.createDataFrame([(1,), (3,), (9,), (9,)], "custno_pk long")):
        found, missing = ops.lookup(rows, "custno_pk", keys)
        assert sorted(values(found, "custno_pk")) == [(1,), (3,)]
        assert values(missing) == [(9,)]


def test_lookup_of_many_keys_uses_a_join(frame):
    rows = frame("customer", [{"custno_pk": i} for i in range(5)])
    found, missing = ops.lookup(rows, "custno_pk", list(range(2, 1500)))
    assert sorted(values(found, "custno_pk")) == [(2,), (3,), (4,)]
    assert missing.count() == 1495


def test_match_either(frame, spark):
    rows = frame("employees", [{"empno_pk": 1, "emailidoffical": "a@x", "username": "A"},
                               {"empno_pk": 2, "emailidoffical": "B@x", "username": None},
                               {"empno_pk": 3, "emailidoffical": None, "username": "c"}])
    columns = ("emailidoffical", "username")
    assert values(ops.match_either(rows, columns, "b@X"), "empno_pk") == [(2,)]
    batch = spark.createDataFrame([("a@x",), ("a",), ("C",), (None,)], "value string")
    got = ops.match_either(rows, columns, batch)
    assert sorted(values(got, "empno_pk")) == [(1,), (3,)]
    assert got.columns == rows.columns


def test_fan_out_equals_left_join(spark):
    rng = random.Random(1)
    parents = [(i,) for i in range(40)] + [(None,)]
    children = [(rng.choice([7] * 20 + list(range(60)) + [None]), i) for i in range(300)]
    parent = spark.createDataFrame(parents, "pk long")
    child = spark.createDataFrame(children, "fk long, v long")
    got = values(ops.fan_out(parent, "pk", child, "fk", {"w": "v"}))
    want = []
    for (pk,) in parents:
        hits = [v for fk, v in children if fk is not None and fk == pk]
        want += [(pk, v) for v in hits] or [(pk, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_semi_and_anti_with_repeated_right_keys(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1,)] * 50 + [(None,)], "j long")
    assert values(ops.having(left, "k", right, "j")) == [(1,), (1,)]
    assert sorted(values(ops.lacking(left, "k", right, "j")), key=str) == [(2,), (None,)]


def test_count_children_keeps_zero_and_ignores_orphans(frame):
    parent = frame("projects", [{"projectno_pk": i} for i in (1, 2)])
    child = frame("calls", [{"id": 1, "project_id": 1, "status": "pending"}, {"id": 2, "project_id": 1},
                            {"id": 3, "project_id": 9}, {"id": 4}])
    got = ops.count_children(parent, child, "projectno_pk", "project_id", "n")
    assert sorted(values(got, "projectno_pk", "n")) == [(1, 2), (2, 0)]
    some = ops.count_children(parent, child, "projectno_pk", "project_id", "n", F.col("status") == "pending")
    assert sorted(values(some, "projectno_pk", "n")) == [(1, 1), (2, 0)]


def test_conditional_and_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", None, "x")], "k string, v int, s string")
    got = ops.conditional_counts(df, ["k"], {"n": None, "nx": F.col("s") == "x"},
                                 {"dv": (None, "v"), "dx": (F.col("s") == "x", "v")})
    assert sorted(values(got, "k", "n", "nx", "dv", "dx")) == [("a", 3, 2, 2, 2), ("b", 1, 1, 0, 0)]


def test_tall_counts_is_one_row(spark):
    frames = {"a": spark.range(3), "b": spark.range(0)}
    assert values(ops.tall_counts(frames), "a", "b") == [(3, 0)]


def test_page_info(spark):
    assert values(ops.page_info(spark.range(21), 2, 10)) == [(21, 3, 2, 10)]
    assert values(ops.page_info(spark.range(0), 1, 10)) == [(0, 0, 1, 10)]


def test_keyset_pages_equal_offset_pages(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, 1.0, 2.0])) for i in range(40)]
    df = spark.createDataFrame(rows, "pk long, a int, b double")
    for desc_a, desc_b, last in itertools.product([False, True], [False, True], [False, True]):
        order = [ops.Order("a", desc_a, last and not desc_a), ops.Order("b", desc_b)]
        whole = values(ops.sort_rows(df, order, "pk"))
        walked, after = [], None
        while page := values(ops.paginate(df, order, "pk", limit=7, after=after)):
            walked += page
            after = (page[-1][1], page[-1][2], page[-1][0])
        assert walked == whole


def test_nest_orders_and_keeps_empty_parents(frame):
    teams = frame("empteam", [{"teamno_pk": i, "teamname": f"t{i}"} for i in (1, 2, 3)])
    members = frame("empteamdtl", [{"teamdtlno_pk": i, "teamno_fk": 1 if i < 25 else 2, "empno_fk": i,
                                    "au_entryat": at(f"2024-01-{1 + i % 9:02d}")} for i in range(30)])
    order = [ops.newest("au_entryat")]
    args = (teams, members, "teamno_pk", "teamno_fk", "teamdtlno_pk", "members", order)
    whole = {r["teamno_pk"]: [m["teamdtlno_pk"] for m in r["members"]] for r in ops.nest(*args).collect()}
    want = sorted(range(25), key=lambda i: (-(i % 9), i))
    assert whole == {1: want, 2: sorted(range(25, 30), key=lambda i: (-(i % 9), i)), 3: []}

    cut = ops.nest(*args, piece=4).orderBy("teamno_pk", "part").collect()
    assert max(len(r["members"]) for r in cut) <= 4
    joined = {}
    for r in cut:
        joined.setdefault(r["teamno_pk"], []).extend(m["teamdtlno_pk"] for m in r["members"])
    assert joined == whole
    # parts are numbered without gaps, whatever the size of the group
    assert [(r["teamno_pk"], r["part"]) for r in cut] == [(1, i) for i in range(7)] + [(2, 0), (2, 1), (3, 0)]
    assert ops.unnest(ops.nest(*args), "members").count() == 30


def test_rename_and_json(spark):
    df = spark.createDataFrame([("7", "x")], "a string, b string")
    assert ops.rename(df, {"a": "c"}).columns == ["c", "b"]
    assert values(df.select(parse_long("a"), parse_long("b"))) == [(7, None)]
    encoded = df.select(encode_json(F.struct("a", "b")).alias("j"))
    assert values(encoded) == [('{"a":"7","b":"x"}',)]
    assert values(encoded.select(decode_json("j")["b"])) == [("x",)]


def test_owner_scope(frame):
    rows = frame("custassignment", [{"assignno_pk": 1, "empno_fk": 7}, {"assignno_pk": 2, "empno_fk": None}])
    assert values(ops.owned_by(rows, "empno_fk", "7"), "assignno_pk") == [(1,)]


def test_unknown_modes_are_refused(make_tables):
    from dialweave import plans

    t = make_tables()
    with pytest.raises(ValueError):
        plans.project_staff(t, 1, mode="other")
    with pytest.raises(ValueError):
        plans.assignments_matching(t, total_mode="other")
