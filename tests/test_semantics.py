"""One test per rule that changes answers."""

from __future__ import annotations

import pytest
from conftest import at, values

from dialweave import operators as ops
from dialweave import plans
from dialweave.functions import falsy_default


def test_text_comparison_ignores_case(make_tables):
    t = make_tables(
        employees=[
            {"empno_pk": 1, "name": "a", "role": "AGENT", "empstatus": "active"},
            {"empno_pk": 2, "name": "b", "role": "Trainee", "empstatus": "Active"},
            {"empno_pk": 3, "name": "c", "role": "ADMIN", "empstatus": "Active"},
            {"empno_pk": 4, "name": "d", "role": "agent", "empstatus": "Inactive"},
        ]
    )
    assert [r[0] for r in values(plans.agent_performance(t), "empno_pk")] == [1, 2]
    roles = dict(values(plans.employees_by_role(t), "role", "count"))
    assert roles == {"AGENT": 1, "Trainee": 1, "ADMIN": 1}


def test_grouping_ignores_case_and_keeps_null(make_tables):
    statuses = ["Pending", "PENDING", "pending", None, None, "Done"]
    t = make_tables(custassignment=[{"assignno_pk": i, "callstatus": s} for i, s in enumerate(statuses)])
    assert sorted(values(plans.call_status_distribution(t)), key=str) == sorted(
        [("PENDING", 3), ("Done", 1), (None, 2)], key=str
    )


def test_accents_and_trailing_blanks_on_request(frame):
    names = ["Jose", "JOSÉ  ", "josef"]
    rows = frame("customer", [{"custno_pk": i, "custtype": n} for i, n in enumerate(names)])
    assert values(ops.where_equal(rows, {"custtype": "jose"}), "custno_pk") == [(0,)]
    loose = ops.where_equal(rows, {"custtype": "jose"}, collation="UNICODE_CI_AI_RTRIM")
    assert values(loose, "custno_pk") == [(0,), (1,)]


def test_null_order_and_nulls_last(frame):
    rows = frame("custassignment", [{"assignno_pk": i, "calltargetdate": d} for i, d in
                                    enumerate([at("2024-01-02"), None, at("2024-01-01")])])
    first = ops.sort_rows(rows, [ops.Order("calltargetdate")], "assignno_pk")
    assert values(first, "assignno_pk") == [(1,), (2,), (0,)]
    last = ops.sort_rows(rows, [ops.Order("calltargetdate", nulls_last=True)], "assignno_pk")
    assert values(last, "assignno_pk") == [(2,), (0,), (1,)]
    down = ops.sort_rows(rows, [ops.newest("calltargetdate")], "assignno_pk")
    assert values(down, "assignno_pk") == [(0,), (2,), (1,)]


def test_unknown_priority_sorts_first(frame):
    ranks = ["Low", "high", None, "Medium", "Odd"]
    rows = frame("custassignment", [{"assignno_pk": i, "callpriority": p} for i, p in enumerate(ranks)])
    done = ops.priority_sort(rows, "callpriority", ["High", "Medium", "Low"], [], "assignno_pk")
    assert [r[0] for r in values(done, "assignno_pk")] == [2, 4, 1, 3, 0]
    moved = ops.priority_sort(rows, "callpriority", ["High", "Medium", "Low"], [], "assignno_pk", nulls_last=True)
    assert [r[0] for r in values(moved, "assignno_pk")] == [1, 3, 0, 2, 4]


def test_not_in_follows_sql_on_nulls(frame):
    staff = frame("employees", [{"empno_pk": i} for i in (1, 2, 3)])
    unnumbered = frame("employees", [{"empno_pk": None}, {"empno_pk": 9}])
    members = frame("empteamdtl", [{"empno_fk": 2}])
    trap = frame("empteamdtl", [{"empno_fk": 2}, {"empno_fk": None}])
    nobody = frame("empteamdtl", [])

    def left(df, other, **kw):
        return sorted(values(ops.not_in(df, "empno_pk", other, "empno_fk", **kw), "empno_pk"), key=str)

    assert left(staff, members) == [(1,), (3,)]
    assert left(staff, trap) == []
    assert left(staff, trap, null_safe=True) == [(1,), (3,)]
    assert left(staff, nobody) == [(1,), (2,), (3,)]
    assert left(unnumbered, members) == [(9,)]
    assert left(unnumbered, nobody) == [(9,), (None,)]


@pytest.fixture
def activity(make_tables):
    return make_tables(
        employees=[
            {"empno_pk": 1, "name": "a", "role": "Agent", "empstatus": "Active"},
            {"empno_pk": 2, "name": "b", "role": "Agent", "empstatus": "Active"},
        ],
        call_history=[
            {"history_pk": 1, "empno_fk": 1, "custno_fk": 5, "interaction_type": "call",
             "interaction_datetime": at("2024-01-01 10:00:00"), "callstatus": "Sales Generated"},
            {"history_pk": 2, "empno_fk": 1, "custno_fk": 5, "interaction_type": "sms",
             "interaction_datetime": at("2024-01-02 00:00:00")},
            {"history_pk": 3, "empno_fk": 1, "custno_fk": None, "interaction_type": "whatsapp",
             "interaction_datetime": at("2024-01-02 00:00:01")},
        ],
    )


def test_date_range_keeps_agents_without_activity(activity):
    rows = values(plans.agent_performance(activity, "2030-01-01"), "empno_pk", "total_interactions")
    assert rows == [(1, 0), (2, 0)]


def test_end_date_means_its_midnight(activity):
    def total(**kw):
        return values(plans.agent_performance(activity, "2024-01-02", "2024-01-02", **kw))[0][3]

    assert total() == 1
    assert total(end_of_day=True) == 2


def test_agent_counts(activity):
    row = values(plans.agent_performance(activity))[0]
    assert row == (1, "a", None, 3, 1, 1, 1, 1, 1)


def test_search_wildcards_and_literal(frame):
    names = ["100% sure", "1000 sure", "a_b", "axb", None]
    rows = frame("customer", [{"custno_pk": i, "custname": n} for i, n in enumerate(names)])

    def found(term, **kw):
        return [r[0] for r in values(ops.text_search(rows, ["custname"], term, **kw).orderBy("custno_pk"), "custno_pk")]

    assert found("0% S") == [0, 1]
    assert found("0% S", literal=True) == [0]
    assert found("A_B") == [2, 3]
    assert found("A_B", literal=True) == [2]
    assert found("") == found(None) == [0, 1, 2, 3, 4]


def test_defaults_replace_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",), (" ",)], "v string")
    assert values(df.select(falsy_default("v", "d"))) == [("d",), ("d",), ("x",), (" ",)]
    shown = ops.display_defaults(df, {"v": "N/A"})
    assert values(shown) == [("N/A",), ("N/A",), ("x",), (" ",)]


def test_days_are_active_days(make_tables):
    days = [f"2024-{m:02d}-01 12:00:00" for m in range(1, 13)]
    t = make_tables(call_history=[{"history_pk": i, "interaction_datetime": at(d)} for i, d in enumerate(days)])
    got = [str(r[0]) for r in values(plans.daily_activity(t, days=3))]
    assert got == ["2024-12-01", "2024-11-01", "2024-10-01"]


def test_ties_break_on_the_key_and_pages_do_not_overlap(frame):
    rows = frame("customer", [{"custno_pk": i, "au_entryat": at("2024-01-01")} for i in range(25)])
    order = [ops.newest("au_entryat")]
    pages = [values(ops.paginate(rows, order, "custno_pk", page, 10), "custno_pk") for page in (1, 2, 3, 4)]
    assert [r[0] for p in pages for r in p] == list(range(25))
    assert pages[3] == []


@pytest.mark.parametrize("page,limit", [(0, 10), (-1, 10), (1, 0)])
def test_page_bounds(frame, page, limit):
    rows = frame("customer", [])
    with pytest.raises(ValueError):
        ops.paginate(rows, [], "custno_pk", page, limit)
    with pytest.raises(ValueError):
        ops.page_info(rows, page, limit)
