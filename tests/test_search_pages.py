"""Search through an index, pages between fences and merged sketches give what a whole scan gives."""

from __future__ import annotations

import random

import pytest
from conftest import at, values

from dialweave import operators as ops
from dialweave import plans
from dialweave.operators import postings
from dialweave.sources import load_tables

TERMS = ["ann", "ANN", "an", "a%n", "anna_b", "na b", "%", "_", "", None, "100%", "50\\%", "élé", "ÉLÉ", "zzz", "c0"]


def people():
    names = ["Anna Berg", "anna berg", "Ann", "An", "", None, "Hannah 100%", "ÉLÉONORE", "éléphant", "banana boat", "50% off",
             "annaXb", "Anna Berg", "x" * 50 + "ann" + "y" * 50, "日本語テキスト"]
    return [{"custno_pk": i, "custname": n, "custcode": None if i % 3 else f"C{i:03}", "custtype": "A"} for i, n in enumerate(names)]


@pytest.fixture
def searched(spark, make_tables, tmp_path):
    t = make_tables(customer=people())
    plans.write_search_index(t, "customer", str(tmp_path / "index"))
    return t, ops.read_postings(spark, str(tmp_path / "index"))


@pytest.mark.parametrize("way", ["keys", "sketch", "scan", "common"])
def test_search_by_index_equals_the_scan(searched, way, monkeypatch):
    t, index = searched
    if way == "common":
        monkeypatch.setattr(postings, "WORTH", 1)
        monkeypatch.setattr(postings, "COMBINED", 1)
    elif way != "keys":
        monkeypatch.setattr(postings, "INLINE_KEYS", 0)
        monkeypatch.setattr(postings, "is_small", lambda batch: way == "sketch")
    for term in TERMS + ["x" * 50 + "ann" + "y" * 50, "本語テ", "anna berg"]:
        for literal in (False, True):
            scan = values(plans.customers_matching(t, term, literal=literal), "custno_pk")
            found = values(plans.customers_matching(t, term, literal=literal, index=index), "custno_pk")
            assert sorted(found) == sorted(scan), (term, literal)


def test_letters_of_a_term():
    assert postings.term_letters("AnNa") == ["ann", "nna"]
    assert postings.term_letters("an%na_x") == [] and postings.term_letters("an%n", literal=True) == ["an%", "n%n"]
    assert postings.term_letters("abc\\_d") == [] and len(postings.term_letters("".join(map(chr, range(100, 300))))) == 60


def test_the_rarest_letters_are_combined(searched):
    _, index = searched
    first, least = postings.rarest(index, ["custname"], ["ann", "han", "zzz"])
    assert first == ["zzz", "han", "ann"] and least == 0
    assert postings.rarest(index, ["custname"], ["ann"])[1] == 7  # Anna (twice), anna, Ann, Hannah, annaXb, x..ann..y


def test_an_index_grows_with_its_table_and_stale_postings_do_no_harm(spark, searched, make_tables, tmp_path):
    t, index = searched
    renamed = {"custno_pk": 0, "custname": "Zora Quist"}
    more = make_tables(customer=[renamed, {"custno_pk": 90, "custname": "Quist & Sons"}])
    plans.write_search_index(more, "customer", str(tmp_path / "index"))
    index = ops.read_postings(spark, str(tmp_path / "index"))
    now = make_tables(customer=[renamed, *people()[1:], {"custno_pk": 90, "custname": "Quist & Sons"}])
    assert sorted(values(plans.customers_matching(now, "quist", index=index), "custno_pk")) == [(0,), (90,)]
    assert (0,) not in values(plans.customers_matching(now, "berg", index=index), "custno_pk")


def test_few_candidates_reach_the_scan_as_keys(spark, make_tables, tmp_path):
    make_tables(customer=people())["customer"].write.parquet(f"{tmp_path}/customer")
    t = load_tables(spark, str(tmp_path))
    plans.write_search_index(t, "customer", f"{tmp_path}/index")
    index = ops.read_postings(spark, f"{tmp_path}/index")
    plan = plans.customers_matching(t, "hannah", index=index)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(custno_pk,6)" in plan or "In(custno_pk, [6])" in plan
    lookup = postings.candidates(index, ["custname"], ["ann"])._jdf.queryExecution().executedPlan().toString()
    assert "letters" in lookup.split("PushedFilters: [")[1].split("]")[0]


def test_empty_index(spark, make_tables, tmp_path):
    t = make_tables(customer=[])
    plans.write_search_index(t, "customer", str(tmp_path / "index"))
    index = ops.read_postings(spark, str(tmp_path / "index"))
    assert values(plans.customers_matching(t, "anna", index=index)) == []


def dated(n):
    rng = random.Random(7)
    times = [None, at("2024-01-01"), at("2024-01-02"), at("2024-02-01 10:30:00.123456"), at("2023-05-05")]
    return [{"custno_pk": i, "custname": rng.choice(["b", "A", None, "c"]), "au_entryat": rng.choice(times)} for i in range(n)]


ORDERS = {
    "newest": lambda: [ops.newest("au_entryat")],
    "oldest": lambda: [ops.Order("au_entryat")],
    "nulls last": lambda: [ops.Order("au_entryat", nulls_last=True), ops.by_name("custname")],
    "name": lambda: [ops.by_name("custname"), ops.newest("au_entryat")],
    "key": lambda: [],
}


@pytest.mark.parametrize("named", ORDERS)
def test_every_page_between_fences_is_the_page(spark, frame, named):
    rows, order = frame("customer", dated(61)), ORDERS[named]()
    fence = ops.fences(rows, order, "custno_pk", every=7, ranges=3)
    fence = spark.createDataFrame(fence.collect(), fence.schema)
    assert sorted(r["before"] for r in fence.collect())[0] == 0
    everyone = values(ops.sort_rows(rows, order, "custno_pk"), "custno_pk")
    for limit in (9, 20):
        for page in range(1, 61 // limit + 3):
            got = values(ops.fenced_page(rows, order, "custno_pk", fence, page, limit), "custno_pk")
            assert got == everyone[(page - 1) * limit : page * limit], (page, limit)


def test_a_fenced_page_reads_one_range(spark, make_tables, tmp_path):
    people = [{"custno_pk": i, "au_entryat": at(f"2024-01-{1 + i // 40:02}")} for i in range(1000)]
    made = make_tables(customer=people)
    for name in ("customer", "projects"):
        made[name].write.parquet(f"{tmp_path}/{name}")
    t = load_tables(spark, str(tmp_path))
    fence = plans.customer_fences(t, every=50, ranges=4)
    assert fence.count() <= 1000 // 50 + 4
    page = plans.customers_listing(t, page=80, fence=fence)
    assert values(page, "custno_pk") == values(plans.customers_listing(t, page=80), "custno_pk")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    pushed = page.select("custno_pk")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = pushed.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "LessThanOrEqual(au_entryat" in pushed and "GreaterThanOrEqual(au_entryat" in pushed
    with pytest.raises(ValueError, match="without filters"):
        plans.customers_listing(t, search="a", page=2, fence=fence)


def test_fences_of_an_empty_table(frame):
    rows = frame("customer", [])
    fence = ops.fences(rows, [ops.newest("au_entryat")], "custno_pk")
    assert fence.count() == 0
    assert values(ops.fenced_page(rows, [ops.newest("au_entryat")], "custno_pk", fence, 3, 10)) == []


def test_agents_by_days(spark, make_tables):
    employees = [{"empno_pk": i, "name": f"n{i}", "role": "Agent", "empstatus": "Active"} for i in range(3)]
    kinds = ["call", "sms", "whatsapp", None]
    history = [{"history_pk": i, "empno_fk": None if i % 11 == 0 else i % 2, "custno_fk": None if i % 13 == 0 else i % 3000,
                "interaction_type": kinds[i % 4], "callstatus": "Sales Generated" if i % 5 == 0 else None,
                "interaction_datetime": None if i % 97 == 0 else at(f"2024-01-{1 + i % 9:02} 12:00:00")} for i in range(6000)]
    t = make_tables(employees=employees, call_history=history)
    early, late = t.replaced(call_history=t["call_history"].where("history_pk < 4000")), t.replaced(
        call_history=t["call_history"].where("history_pk >= 4000"))
    days = plans.agent_days(early).unionByName(plans.agent_days(late))  # late rows amend their days
    for span in [("2024-01-03", "2024-01-05"), ("2024-01-07", None), (None, None)]:
        got = {r["empno_pk"]: r for r in plans.agent_performance_by_days(t, days, *span).collect()}
        true = {r["empno_pk"]: r for r in plans.agent_performance(t, *span, end_of_day=True).collect()}
        assert got.keys() == true.keys() == {0, 1, 2}
        for who, row in true.items():
            for column, value in row.asDict().items():
                if column == "unique_customers_contacted":
                    assert abs(got[who][column] - value) <= max(1, 0.05 * value), (who, value, got[who][column])
                else:
                    assert got[who][column] == value, (who, column)


def test_a_table_of_one_file_is_cut_into_letters_by_many_tasks(spark, frame):
    rows = frame("customer", people()).coalesce(1)
    found = postings.postings(rows, "custno_pk", ["custname", "custcode"])
    assert found.rdd.getNumPartitions() == 4 and rows.rdd.getNumPartitions() == 1
    expected = {(c, t[i : i + 3], p["custno_pk"]) for p in people() for c in ("custname", "custcode")
                for t in [(p[c] or "").lower()] for i in range(len(t) - 2)}
    assert sorted(values(found, "field", "letters", "key")) == sorted(expected)
