"""Dashboard numbers and the unpaged dashboard lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.functions import ci_equal
from dialweave.operators import (
    attach,
    count_children,
    display_defaults,
    grouped_count,
    newest,
    paginate,
    sort_rows,
    tall_counts,
    where_equal,
)
from dialweave.sources.tables import Tables

# What the dashboard shows where a name or status is missing.
SHOWN_WHEN_MISSING = {
    "customer_name": "Unknown",
    "customer_phone": "N/A",
    "status": "pending",
    "agent_name": "Unassigned",
    "project_name": "N/A",
}


def dashboard_kpis(tables: Tables) -> DataFrame:
    """One row of counts. Agents are, by definition here, all active employees."""
    counts = tall_counts(
        {
            "total_employees": tables["employees"].where(ci_equal("empstatus", "Active")),
            "total_projects": tables["projects"].where(ci_equal("projectstatus", "OPEN")),
            "total_calls": tables["call_history"],
            "pending_calls": tables["custassignment"].where(ci_equal("callstatus", "Pending")),
        }
    )
    return counts.select(
        "total_employees",
        F.col("total_employees").alias("total_agents"),
        "total_projects",
        "total_calls",
        "pending_calls",
    )


def recent_calls(tables: Tables, n: int = 10) -> DataFrame:
    """The newest interactions with names. The top-k runs first, so only n rows are joined."""
    order = [newest("created_at")]
    history = tables["call_history"].select(
        F.col("history_pk").alias("id"),
        F.col("callstatus").alias("status"),
        F.col("interaction_datetime").alias("created_at"),
        "custno_fk",
        "empno_fk",
    )
    page = paginate(history, order, "id", limit=n)
    people = {"customer_name": "custname", "customer_phone": "custmobilenumber", "projectno_fk": "projectno_fk"}
    page = attach(page, tables["customer"], "custno_fk", "custno_pk", people)
    page = attach(page, tables["employees"], "empno_fk", "empno_pk", {"agent_name": "name"})
    page = attach(page, tables["projects"], "projectno_fk", "projectno_pk", {"project_name": "projectname"})
    shown = display_defaults(page, SHOWN_WHEN_MISSING).select(
        "id", "customer_name", "customer_phone", "status", "agent_name", "project_name", "created_at"
    )
    return sort_rows(shown, order, "id")


def call_status_distribution(tables: Tables) -> DataFrame:
    return grouped_count(tables["custassignment"], "callstatus", "status")


def employees_by_role(tables: Tables) -> DataFrame:
    return grouped_count(tables["employees"].where(ci_equal("empstatus", "Active")), "role")


def active_agents(tables: Tables) -> DataFrame:
    staff = tables["employees"].where(ci_equal("empstatus", "Active"))
    staff = attach(
        staff, tables["projects"], "assigned_project_id", "projectno_pk", {"project_name": "projectname"}
    )
    return sort_rows(staff, [newest("au_entryat")], "empno_pk")


def project_overview(tables: Tables) -> DataFrame:
    """Projects with the number of their employees and calls.

    Both keys are unique in their tables, so plain counts per project equal the
    distinct counts over the joined rows.
    """
    rows = count_children(
        tables["projects"], tables["employees"], "projectno_pk", "assigned_project_id", "employee_count"
    )
    rows = count_children(rows, tables["calls"], "projectno_pk", "project_id", "call_count")
    return sort_rows(rows, [newest("au_entryat")], "projectno_pk")


def calls_listing(
    tables: Tables, status: str | None = None, employee_id=None, project_id=None, agent_id=None
) -> DataFrame:
    """All calls with names; ``agent_id`` is an alias of ``employee_id``."""
    wanted = {"status": status, "employee_id": employee_id or agent_id, "project_id": project_id}
    rows = where_equal(tables["calls"], wanted)
    rows = attach(
        rows, tables["employees"], "employee_id", "empno_pk", {"employee_name": "name", "agent_name": "name"}
    )
    rows = attach(rows, tables["projects"], "project_id", "projectno_pk", {"project_name": "projectname"})
    return sort_rows(rows, [newest("created_at")], "id")

