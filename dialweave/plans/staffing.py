"""Who works in which team and on which project, and who is free.

A project or team is an optional argument: without it the same plan answers for
all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.functions import ci_equal
from dialweave.operators import (
    attach,
    by_name,
    fan_out,
    lacking,
    lookup,
    nest,
    newest,
    not_in,
    paginate,
    sort_rows,
    text_search,
    where_equal,
)
from dialweave.sources.tables import Tables

_MEMBER_NAMES = {
    "employee_name": "name",
    "employee_email": "emailidoffical",
    "employee_role": "role",
    "employee_code": "empcode",
}


def _teams(tables: Tables, ids) -> DataFrame:
    return tables["empteam"] if ids is None else lookup(tables["empteam"], "teamno_pk", ids)[0]


def _members(tables: Tables) -> DataFrame:
    members = tables["empteamdtl"].where(F.col("teamno_fk").isNotNull())
    return attach(members, tables["employees"], "empno_fk", "empno_pk", _MEMBER_NAMES, how="inner")


def team_with_members(tables: Tables, ids=None, **options) -> DataFrame:
    """Teams with a ``members`` array, newest member first."""
    return nest(
        _teams(tables, ids),
        _members(tables),
        "teamno_pk",
        "teamno_fk",
        "teamdtlno_pk",
        "members",
        [newest("au_entryat")],
        **options,
    )


def team_members_flat(tables: Tables, ids=None) -> DataFrame:
    """One row per team member, for teams of any size."""
    teams = _teams(tables, ids).select("teamno_pk", "teamcode", "teamname")
    rows = _members(tables).join(teams, F.col("teamno_fk") == F.col("teamno_pk"), "inner").drop("teamno_fk")
    return sort_rows(rows, [newest("au_entryat")], ["teamno_pk", "teamdtlno_pk"])


def available_employees(
    tables: Tables, team, search: str | None = None, n: int = 50, null_safe: bool = False
) -> DataFrame:
    """Active employees outside a team, by name.

    With the default rule a team holding a member without an employee number has
    no available employees at all (SQL's NOT IN); ``null_safe`` ignores such rows.
    """
    members = where_equal(tables["empteamdtl"], {"teamno_fk": team})
    staff = tables["employees"].where(ci_equal("empstatus", "Active"))
    staff = text_search(staff, ["name", "emailidoffical", "empcode"], search)
    staff = staff.select("empno_pk", "empcode", "name", "emailidoffical", "role", "empstatus")
    free = not_in(staff, "empno_pk", members, "empno_fk", null_safe)
    return paginate(free, [by_name("name")], "empno_pk", limit=n)


def project_staff(tables: Tables, project=None, mode: str = "team_or_direct") -> DataFrame:
    """Active employees of each project, by its default team or by direct assignment.

    The two memberships are separate equi-joins, united and de-duplicated as key
    pairs. ``mode="team_only"`` leaves direct assignment out.
    """
    projects = where_equal(tables["projects"], {"projectno_pk": project})
    defaults = projects.select("projectno_pk", "projectdefault_teamno_fk")
    by_team = (
        tables["empteamdtl"]
        .where(F.col("empno_fk").isNotNull())
        .join(defaults, F.col("teamno_fk") == F.col("projectdefault_teamno_fk"), "inner")
        .select("projectno_pk", "empno_fk")
    )
    if mode == "team_only":
        pairs = by_team
    elif mode == "team_or_direct":
        direct = tables["employees"].select(
            F.col("assigned_project_id").alias("projectno_pk"), F.col("empno_pk").alias("empno_fk")
        )
        direct = where_equal(direct.where(F.col("projectno_pk").isNotNull()), {"projectno_pk": project})
        pairs = by_team.unionByName(direct)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    staff = (
        tables["employees"]
        .where(ci_equal("empstatus", "Active"))
        .select("empno_pk", "empcode", "name", "emailidoffical", "role")
    )
    rows = pairs.dropDuplicates().join(staff, F.col("empno_fk") == F.col("empno_pk"), "inner").drop("empno_fk")
    return sort_rows(rows, [by_name("name")], ["projectno_pk", "empno_pk"])


def _customers(tables: Tables, project) -> DataFrame:
    customers = tables["customer"].where(F.col("projectno_fk").isNotNull())
    return where_equal(customers, {"projectno_fk": project}).select(
        "projectno_fk",
        "custno_pk",
        "custcode",
        "custname",
        "custmobilenumber",
        F.col("custemailid").alias("custemail"),
    )


def project_customers(tables: Tables, project=None, latest_only: bool = False) -> DataFrame:
    """Customers of a project with their assignments: one row per assignment.

    ``latest_only`` keeps each customer's newest assignment.
    """
    assignments = tables["custassignment"].where(F.col("custno_fk").isNotNull())
    assignments = assignments.select("assignno_pk", "custno_fk", "empno_fk", "assigndate")
    if latest_only:
        newest_one = F.max(F.struct("assigndate", "assignno_pk", "empno_fk"))
        assignments = assignments.groupBy("custno_fk").agg(newest_one.alias("last")).select("custno_fk", "last.*")
    rows = fan_out(
        _customers(tables, project),
        "custno_pk",
        assignments,
        "custno_fk",
        {"assignno_pk": "assignno_pk", "assigned_to_empno": "empno_fk"},
    )
    rows = attach(rows, tables["employees"], "assigned_to_empno", "empno_pk", {"assigned_to_name": "name"})
    rows = rows.withColumn("is_assigned", F.col("assignno_pk").isNotNull())
    return sort_rows(rows, [by_name("custname")], ["custno_pk", "assignno_pk"])


def unassigned_customers(tables: Tables, project=None) -> DataFrame:
    rows = lacking(_customers(tables, project), "custno_pk", tables["custassignment"], "custno_fk")
    return sort_rows(rows, [by_name("custname")], "custno_pk")

