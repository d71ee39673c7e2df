"""Reports on small hand-checked tables."""

from __future__ import annotations

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from dialweave import operators as ops
from dialweave import plans
from dialweave.sources import TABLES, conform, generate_calls

# The demo data set, ids from 0 in order of insertion.
PEOPLE = [
    ("রহিম আহমেদ", "+880 1712-345678", "rahim@example.com"),
    ("করিম খান", "+880 1812-345678", "karim@example.com"),
    ("ফাতিমা বেগম", "+880 1912-345678", "fatima@example.com"),
    ("আলী হোসেন", "+880 1612-345678", "ali@example.com"),
    ("নাজমা আক্তার", "+880 1512-345678", "nazma@example.com"),
]


@pytest.fixture
def demo(spark, make_tables):
    t = make_tables(
        projects=[{"projectno_pk": i, "projectname": f"p{i}", "projectstatus": "OPEN"} for i in range(3)],
        employees=[
            {"empno_pk": i, "name": f"e{i}", "empstatus": "Active", "role": "AGENT", "assigned_project_id": i % 3}
            for i in range(4)
        ],
    )
    calls = generate_calls(spark, 20, PEOPLE, [0, 1, 2, 3], [0, 1, 2], [f"note {i}" for i in range(5)], seed=5)
    return t.replaced(calls=conform(calls, TABLES["calls"]))


def test_generated_calls(demo):
    calls = demo["calls"]
    assert sorted(values(calls.groupBy("status").count(), "count")) == [(5,)] * 4
    assert sorted(values(calls.groupBy("employee_id").count(), "count")) == [(5,)] * 4
    timed = calls.where(F.col("call_duration").isNotNull())
    assert sorted(r[0] for r in values(timed, "id")) == [0, 4, 8, 12, 16]
    assert all(60 <= r[0] <= 659 for r in values(timed, "call_duration"))
    sixth = calls.where("id = 6").first()
    assert (sixth["customer_name"], sixth["status"], sixth["project_id"]) == (PEOPLE[1][0], "in_progress", 0)


def test_project_overview_of_the_demo(demo):
    rows = sorted(values(plans.project_overview(demo), "projectno_pk", "employee_count", "call_count"))
    assert rows == [(0, 2, 7), (1, 1, 7), (2, 1, 6)]


def test_project_stats_of_the_demo(demo, spark):
    rows = values(plans.project_stats(demo))
    assert [(r[0], r[1], r[4]) for r in rows] == [(0, 7, 4), (1, 7, 4), (2, 6, 4)]
    assert sum(r[3] for r in rows) == 5 and sum(r[2] for r in rows) == 5
    assert values(plans.project_stats(demo, ids=[2, 99])) == [rows[2], (99, 0, 0, 0, 0)]
    keys = spark.createDataFrame([(2,), (99,)], "projectno_pk long")
    assert values(plans.project_stats(demo, ids=keys)) == [rows[2], (99, 0, 0, 0, 0)]


def test_calls_listing_filters(demo):
    assert plans.calls_listing(demo).count() == 20
    assert plans.calls_listing(demo, status="COMPLETED").count() == 5
    by_agent = plans.calls_listing(demo, agent_id="1")
    assert by_agent.count() == plans.calls_listing(demo, employee_id=1).count() == 5
    assert {r[0] for r in values(by_agent, "agent_name")} == {"e1"}


@pytest.fixture
def office(make_tables):
    return make_tables(
        empteam=[{"teamno_pk": 1, "teamcode": "T1", "teamname": "North", "au_entryat": at("2024-01-01")},
                 {"teamno_pk": 2, "teamcode": "T2", "teamname": "South", "au_entryat": at("2024-01-02")}],
        projects=[{"projectno_pk": 1, "projectname": "Alpha", "projectcode": "A", "projectstatus": "OPEN",
                   "projectdefault_teamno_fk": 1},
                  {"projectno_pk": 2, "projectname": "Beta", "projectcode": "B", "projectstatus": "CLOSED"}],
        employees=[{"empno_pk": 1, "name": "Ann", "empstatus": "Active", "assigned_project_id": 1},
                   {"empno_pk": 2, "name": "bob", "empstatus": "Active"},
                   {"empno_pk": 3, "name": "Cid", "empstatus": "Inactive", "assigned_project_id": 1},
                   {"empno_pk": 4, "name": "Dee", "empstatus": "Active", "assigned_project_id": 2}],
        empteamdtl=[{"teamdtlno_pk": 1, "teamno_fk": 1, "empno_fk": 1, "au_entryat": at("2024-01-01")},
                    {"teamdtlno_pk": 2, "teamno_fk": 1, "empno_fk": 2, "au_entryat": at("2024-01-05")},
                    {"teamdtlno_pk": 3, "teamno_fk": 1, "empno_fk": 77},
                    {"teamdtlno_pk": 4, "teamno_fk": 1, "empno_fk": None}],
        customer=[{"custno_pk": 1, "custname": "Zoe", "custmobilenumber": "111", "projectno_fk": 1},
                  {"custno_pk": 2, "custname": "", "projectno_fk": 1},
                  {"custno_pk": 3, "custname": "Yan", "projectno_fk": None}],
        custassignment=[
            {"assignno_pk": 1, "custno_fk": 1, "empno_fk": 1, "assigndate": at("2024-01-01"), "callstatus": "Pending"},
            {"assignno_pk": 2, "custno_fk": 1, "empno_fk": 2, "assigndate": at("2024-01-03"), "callstatus": "pending"},
            {"assignno_pk": 3, "custno_fk": 3, "empno_fk": None, "assigndate": at("2024-01-02"), "callstatus": "Done"},
            {"assignno_pk": 4, "custno_fk": 99, "empno_fk": 1, "assigndate": at("2024-01-02"), "callstatus": "Done"},
        ],
        call_history=[
            {"history_pk": 1, "assignno_fk": 1, "custno_fk": 1, "empno_fk": 1, "callstatus": "",
             "interaction_datetime": at("2024-01-01 08:00:00")},
            {"history_pk": 2, "assignno_fk": 1, "custno_fk": 2, "empno_fk": 99, "callstatus": "Done",
             "interaction_datetime": at("2024-01-02 08:00:00")},
            {"history_pk": 3, "assignno_fk": 50, "custno_fk": None, "empno_fk": 2,
             "interaction_datetime": at("2024-01-02 08:00:00")},
        ],
        users=[{"id": 1, "name": "Uma", "email": "u@x", "role": "ADMIN", "status": "active"}],
    )


def test_dashboard_kpis(office):
    assert values(plans.dashboard_kpis(office)) == [(3, 3, 1, 3, 2)]


def test_recent_calls_show_defaults(office):
    assert values(plans.recent_calls(office, 2)) == [
        (2, "Unknown", "N/A", "Done", "Unassigned", "Alpha", at("2024-01-02 08:00:00")),
        (3, "Unknown", "N/A", "pending", "bob", "N/A", at("2024-01-02 08:00:00")),
    ]


def test_project_staff_by_team_or_direct(office):
    assert values(plans.project_staff(office, 1), "empno_pk") == [(1,), (2,)]
    assert values(plans.project_staff(office, 1, "team_only"), "empno_pk") == [(1,), (2,)]
    assert values(plans.project_staff(office, 2), "empno_pk") == [(4,)]
    assert values(plans.project_staff(office, 2, "team_only"), "empno_pk") == []
    assert plans.project_staff(office).count() == 3


def test_project_customers(office):
    rows = values(plans.project_customers(office, 1), "custno_pk", "is_assigned", "assigned_to_name")
    assert rows == [(2, False, None), (1, True, "Ann"), (1, True, "bob")]
    latest = values(plans.project_customers(office, 1, latest_only=True), "custno_pk", "assignno_pk")
    assert latest == [(2, None), (1, 2)]
    assert values(plans.unassigned_customers(office, 1), "custno_pk") == [(2,)]


def test_assignment_totals(office):
    listed = plans.assignments_listing(office)
    assert values(listed, "assignno_pk") == [(2,), (1,)]
    assert values(ops.page_info(plans.assignments_matching(office)), "total") == [(2,)]
    assert values(ops.page_info(plans.assignments_matching(office, total_mode="base")), "total") == [(4,)]


def test_worklist_search(office):
    assert values(plans.agent_worklist(office, 1), "assignno_pk") == [(1,)]
    assert values(plans.agent_worklist(office, 1, search="ZO", project="1"), "assignno_pk") == [(1,)]
    assert values(plans.agent_worklist(office, 1, search="nope")) == []


def test_assignment_history_needs_the_assignment(office):
    assert values(plans.assignment_history(office, [1, 50]), "history_pk", "employee_name") == [(2, None), (1, "Ann")]
    assert plans.assignment_history(office).count() == 2


def test_team_members(office):
    team = {r["teamno_pk"]: [m["employee_name"] for m in r["members"]] for r in plans.team_with_members(office).collect()}
    assert team == {1: ["bob", "Ann"], 2: []}
    assert values(plans.team_members_flat(office, [1]), "teamdtlno_pk") == [(2,), (1,)]


def test_available_employees(office):
    assert values(plans.available_employees(office, 1)) == []
    assert values(plans.available_employees(office, 1, null_safe=True), "empno_pk") == [(4,)]
    assert values(plans.available_employees(office, 2), "name") == [("Ann",), ("bob",), ("Dee",)]


def test_listings_and_details(office):
    assert values(plans.teams_listing(office), "teamno_pk", "member_count") == [(2, 0), (1, 4)]
    assert values(plans.projects_listing(office, team=1), "projectno_pk", "team_name") == [(1, "North")]
    assert values(plans.project_detail(office, [2, 9]), "projectno_pk", "team_name", "call_count") == [(2, None, 0)]
    assert values(plans.customers_listing(office, search="11"), "custno_pk", "project_name") == [(1, "Alpha")]
    assert values(plans.customer_detail(office, [3]), "custno_pk", "project_name") == [(3, None)]
    assert values(plans.employees_listing(office, limit=2), "empno_pk") == [(4,), (3,)]
    assert values(plans.employees_listing(office, limit=2, after=(3,)), "empno_pk") == [(2,), (1,)]
    assert "entrypass" not in plans.employee_detail(office, [1]).columns
    assert values(plans.users_listing(office, search="UM"), "id") == [(1,)]
    assert values(plans.user_detail(office, [1]), "name") == [("Uma",)]
    assert values(plans.active_agents(office), "empno_pk", "project_name") == [(1, "Alpha"), (2, None), (4, "Beta")]


def test_team_lead_where_the_table_has_one(office):
    teams = office["empteam"].withColumns({"teamlead_empno_fk": F.lit(2).cast("long"), "teamtype": F.lit("Sales")})
    t = office.replaced(empteam=teams)
    assert values(plans.teams_listing(t, teamtype="sales"), "teamlead_name") == [("bob",), ("bob",)]
    assert values(plans.teams_listing(t, teamtype="other")) == []


def test_assignment_check(office):
    assert values(plans.assignment_check(office), "assignno_pk", "employee_name") == [(1, "Ann"), (2, "bob")]
    assert values(plans.employee_assignments(office, 2), "assignno_pk", "projectname") == [(2, "Alpha")]
