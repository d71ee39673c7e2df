"""Registered report queries and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialweave import operators as ops
from dialweave import plans
from dialweave.functions import decode_json
from dialweave.sources import load_tables

REPORT_QUERIES: dict = {}
REPORT_SQL: dict[str, str] = {}

START, END = "2024-01-05", "2024-01-25"

ASSIGNMENT = (
    "assignno_pk assigndate calltargetdate custno_fk custmobilenumber empno_fk callpriority callstatus "
    "count_call count_message"
).split()
HISTORY = (
    "history_pk assignno_fk custno_fk empno_fk interaction_type interaction_datetime callstatus call_duration"
).split()
EMPLOYEE = "empno_pk empcode name role empstatus emailidoffical username assigned_project_id au_entryat".split()
CUSTOMER = "custno_pk custcode custname custmobilenumber custemailid custtype projectno_fk au_entryat".split()
PROJECT = "projectno_pk projectcode projectname projectstatus projectdefault_teamno_fk au_entryat".split()
USER = "id name email role status social_ids created_at".split()


def tables(spark, sf):
    return load_tables(spark, sf, source="star")


def report(sql: str, columns: list[str] | None = None, name: str | None = None):
    """Register a function of the tables together with its SQL."""

    def register(build):
        key = name or build.__name__

        def query(spark, sf):
            rows = build(tables(spark, sf))
            return rows.select(*columns) if columns else rows

        query.__name__ = key
        REPORT_QUERIES[key] = query
        REPORT_SQL[key] = sql
        return query

    return register


# --- dashboard -----------------------------------------------------------------


@report("""
SELECT (SELECT count(*) FROM v_employees WHERE upper(empstatus) = 'ACTIVE') AS total_employees,
       (SELECT count(*) FROM v_employees WHERE upper(empstatus) = 'ACTIVE') AS total_agents,
       (SELECT count(*) FROM v_projects WHERE upper(projectstatus) = 'OPEN') AS total_projects,
       (SELECT count(*) FROM v_call_history) AS total_calls,
       (SELECT count(*) FROM v_custassignment WHERE upper(callstatus) = 'PENDING') AS pending_calls
""")
def dashboard_kpis(t):
    return plans.dashboard_kpis(t)


@report("""
SELECT h.history_pk AS id,
       coalesce(nullif(c.custname, ''), 'Unknown') AS customer_name,
       coalesce(nullif(c.custmobilenumber, ''), 'N/A') AS customer_phone,
       coalesce(nullif(h.callstatus, ''), 'pending') AS status,
       coalesce(nullif(e.name, ''), 'Unassigned') AS agent_name,
       coalesce(nullif(p.projectname, ''), 'N/A') AS project_name,
       h.interaction_datetime AS created_at
FROM v_call_history h
LEFT JOIN v_customer c ON h.custno_fk = c.custno_pk
LEFT JOIN v_employees e ON h.empno_fk = e.empno_pk
LEFT JOIN v_projects p ON c.projectno_fk = p.projectno_pk
ORDER BY h.interaction_datetime DESC NULLS LAST, h.history_pk
LIMIT 10
""")
def recent_calls(t):
    return plans.recent_calls(t)


@report("""
SELECT min(callstatus) AS status, count(*) AS count FROM v_custassignment GROUP BY upper(callstatus)
""")
def call_status_distribution(t):
    return plans.call_status_distribution(t)


@report("""
SELECT min(role) AS role, count(*) AS count FROM v_employees
WHERE upper(empstatus) = 'ACTIVE' GROUP BY upper(role)
""")
def employees_by_role(t):
    return plans.employees_by_role(t)


@report(
    f"""
SELECT {", ".join("e." + c for c in EMPLOYEE)}, p.projectname AS project_name
FROM v_employees e LEFT JOIN v_projects p ON e.assigned_project_id = p.projectno_pk
WHERE upper(e.empstatus) = 'ACTIVE'
""",
    [*EMPLOYEE, "project_name"],
)
def active_agents(t):
    return plans.active_agents(t)


@report(
    f"""
SELECT {", ".join("p." + c for c in PROJECT)},
       count(DISTINCT e.empno_pk) AS employee_count, count(DISTINCT c.id) AS call_count
FROM v_projects p
LEFT JOIN v_employees e ON p.projectno_pk = e.assigned_project_id
LEFT JOIN v_calls c ON p.projectno_pk = c.project_id
GROUP BY ALL
""",
    [*PROJECT, "employee_count", "call_count"],
)
def project_overview(t):
    return plans.project_overview(t)


_CALLS = "id employee_id project_id status created_at employee_name agent_name project_name".split()
_CALLS_SQL = """
SELECT c.id, c.employee_id, c.project_id, c.status, c.created_at,
       e.name AS employee_name, e.name AS agent_name, p.projectname AS project_name
FROM v_calls c
LEFT JOIN v_employees e ON c.employee_id = e.empno_pk
LEFT JOIN v_projects p ON c.project_id = p.projectno_pk
"""


@report(_CALLS_SQL, _CALLS)
def calls_listing(t):
    return plans.calls_listing(t)


@report(_CALLS_SQL + "WHERE upper(c.status) = 'PENDING' AND c.project_id = 3", _CALLS)
def calls_listing_filtered(t):
    return plans.calls_listing(t, status="Pending", project_id=3)


# --- performance ---------------------------------------------------------------

_AGENTS = """
SELECT e.empno_pk, e.name AS agent_name, e.empcode,
       count(h.history_pk) AS total_interactions,
       count(CASE WHEN h.interaction_type = 'call' THEN 1 END) AS total_calls,
       count(CASE WHEN h.interaction_type = 'sms' THEN 1 END) AS total_sms,
       count(CASE WHEN h.interaction_type = 'whatsapp' THEN 1 END) AS total_whatsapp,
       count(CASE WHEN h.callstatus = 'Sales Generated' THEN 1 END) AS sales_generated,
       count(DISTINCT h.custno_fk) AS unique_customers_contacted
FROM v_employees e
LEFT JOIN v_call_history h ON e.empno_pk = h.empno_fk {dates}
WHERE upper(e.role) IN ('AGENT', 'TRAINEE') AND upper(e.empstatus) = 'ACTIVE'
GROUP BY ALL
"""
_PROJECTS = """
SELECT p.projectno_pk, p.projectname, p.projectcode,
       count(h.history_pk) AS total_interactions,
       count(CASE WHEN h.callstatus = 'Sales Generated' THEN 1 END) AS sales_generated
FROM v_projects p
LEFT JOIN v_customer c ON p.projectno_pk = c.projectno_fk
LEFT JOIN v_call_history h ON c.custno_pk = h.custno_fk {dates}
GROUP BY ALL
"""
_DAYS = """
SELECT CAST(h.interaction_datetime AS DATE) AS date, count(h.history_pk) AS total_interactions,
       count(CASE WHEN h.callstatus = 'Sales Generated' THEN 1 END) AS sales_generated
FROM v_call_history h WHERE true {dates}
GROUP BY 1 ORDER BY date DESC LIMIT 30
"""
_RANGE = f"AND h.interaction_datetime >= '{START}' AND h.interaction_datetime <= '{END}'"
_WHOLE_DAYS = (
    f"AND h.interaction_datetime >= '{START}' AND h.interaction_datetime < DATE '{END}' + INTERVAL 1 DAY"
)


@report(_AGENTS.format(dates=""))
def agent_performance(t):
    return plans.agent_performance(t)


@report(_AGENTS.format(dates=_RANGE))
def agent_performance_range(t):
    return plans.agent_performance(t, START, END)


@report(_AGENTS.format(dates=_WHOLE_DAYS))
def agent_performance_whole_days(t):
    return plans.agent_performance(t, START, END, end_of_day=True)


@report(_PROJECTS.format(dates=""))
def project_performance(t):
    return plans.project_performance(t)


@report(_PROJECTS.format(dates=_RANGE))
def project_performance_range(t):
    return plans.project_performance(t, START, END)


@report(_DAYS.format(dates=""))
def daily_activity(t):
    return plans.daily_activity(t)


@report(_DAYS.format(dates=_RANGE))
def daily_activity_range(t):
    return plans.daily_activity(t, START, END)


@report(_DAYS.format(dates=_WHOLE_DAYS))
def daily_activity_whole_days(t):
    return plans.daily_activity(t, START, END, end_of_day=True)


@report("""
SELECT p.projectno_pk,
       count(DISTINCT c.id) AS total_calls,
       count(DISTINCT CASE WHEN c.status = 'pending' THEN c.id END) AS pending_calls,
       count(DISTINCT CASE WHEN c.status = 'completed' THEN c.id END) AS completed_calls,
       count(DISTINCT c.employee_id) AS unique_employees
FROM v_projects p LEFT JOIN v_calls c ON p.projectno_pk = c.project_id
GROUP BY p.projectno_pk
""")
def project_stats(t):
    return plans.project_stats(t)


# --- listings ------------------------------------------------------------------

_PROJECT_LISTING = f"""
SELECT {", ".join("p." + c for c in PROJECT)}, t.teamname AS team_name, t.teamcode AS team_code,
       count(DISTINCT c.id) AS call_count
FROM v_projects p
LEFT JOIN v_empteam t ON p.projectdefault_teamno_fk = t.teamno_pk
LEFT JOIN v_calls c ON p.projectno_pk = c.project_id
{{where}}
GROUP BY ALL ORDER BY p.au_entryat DESC NULLS LAST, p.projectno_pk {{page}}
"""
_PROJECT_COLUMNS = [*PROJECT, "team_name", "team_code", "call_count"]


@report(
    _PROJECT_LISTING.format(
        where="WHERE lower(p.projectname) LIKE '%1%' OR lower(p.projectcode) LIKE '%1%'", page="LIMIT 10"
    ),
    _PROJECT_COLUMNS,
)
def projects_listing(t):
    return plans.projects_listing(t, search="1")


@report(
    _PROJECT_LISTING.format(
        where="WHERE upper(p.projectstatus) = 'OPEN' AND p.projectdefault_teamno_fk = 2", page="LIMIT 2 OFFSET 2"
    ),
    _PROJECT_COLUMNS,
)
def projects_listing_filtered(t):
    return plans.projects_listing(t, status="open", team="2", page=2, limit=2)


@report(_PROJECT_LISTING.format(where="", page=""), _PROJECT_COLUMNS)
def project_detail(t):
    return plans.project_detail(t, t["projects"].select("projectno_pk"))


@report(
    """
SELECT t.teamno_pk, t.teamcode, t.teamname, t.au_entryat, count(DISTINCT d.teamdtlno_pk) AS member_count
FROM v_empteam t LEFT JOIN v_empteamdtl d ON t.teamno_pk = d.teamno_fk
GROUP BY ALL ORDER BY t.au_entryat DESC, t.teamno_pk LIMIT 10
""",
    ["teamno_pk", "teamcode", "teamname", "au_entryat", "member_count"],
)
def teams_listing(t):
    return plans.teams_listing(t)


_CUSTOMER_SQL = f"""
SELECT {", ".join("c." + x for x in CUSTOMER)}, p.projectname AS project_name, p.projectcode AS project_code
FROM v_customer c LEFT JOIN v_projects p ON c.projectno_fk = p.projectno_pk
"""
_CUSTOMER_COLUMNS = [*CUSTOMER, "project_name", "project_code"]


@report(
    _CUSTOMER_SQL
    + """
WHERE lower(c.custname) LIKE '%00000001%' OR lower(c.custcode) LIKE '%00000001%'
   OR lower(c.custmobilenumber) LIKE '%00000001%' OR lower(c.custemailid) LIKE '%00000001%'
ORDER BY c.au_entryat DESC NULLS LAST, c.custno_pk LIMIT 10
""",
    _CUSTOMER_COLUMNS,
)
def customers_listing(t):
    return plans.customers_listing(t, search="00000001")


@report(
    _CUSTOMER_SQL
    + """
WHERE c.projectno_fk = 7 AND upper(c.custtype) = 'BUILDING'
ORDER BY c.au_entryat DESC NULLS LAST, c.custno_pk LIMIT 5 OFFSET 5
""",
    _CUSTOMER_COLUMNS,
)
def customers_listing_filtered(t):
    return plans.customers_listing(t, project=7, custtype="Building", page=2, limit=5)


@report(
    _CUSTOMER_SQL
    + """
WHERE c.au_entryat < TIMESTAMP '2023-12-01' OR (c.au_entryat = TIMESTAMP '2023-12-01' AND c.custno_pk > 334)
ORDER BY c.au_entryat DESC NULLS LAST, c.custno_pk LIMIT 10
""",
    _CUSTOMER_COLUMNS,
)
def customers_listing_keyset(t):
    return plans.customers_listing(t, after=("2023-12-01", 334))


@report(_CUSTOMER_SQL, _CUSTOMER_COLUMNS)
def customer_detail(t):
    return plans.customer_detail(t, t["customer"].select("custno_pk"))


_EMPLOYEE_SQL = f"SELECT {', '.join(EMPLOYEE)} FROM v_employees "


@report(
    _EMPLOYEE_SQL
    + """
WHERE lower(name) LIKE '%00000001%' OR lower(emailidoffical) LIKE '%00000001%'
   OR lower(username) LIKE '%00000001%' OR lower(empcode) LIKE '%00000001%'
ORDER BY empno_pk DESC LIMIT 10
""",
    EMPLOYEE,
)
def employees_listing(t):
    return plans.employees_listing(t, search="00000001")


@report(
    _EMPLOYEE_SQL
    + "WHERE upper(role) = 'AGENT' AND upper(empstatus) = 'ACTIVE' ORDER BY empno_pk DESC LIMIT 7 OFFSET 14",
    EMPLOYEE,
)
def employees_listing_filtered(t):
    return plans.employees_listing(t, role="agent", status="active", page=3, limit=7)


@report(_EMPLOYEE_SQL, EMPLOYEE)
def employee_detail(t):
    return plans.employee_detail(t, t["employees"].select("empno_pk"))


_USER_SQL = f"SELECT {', '.join(USER)} FROM v_users "


@report(
    _USER_SQL
    + """
WHERE lower(name) LIKE '%00000001%' OR lower(email) LIKE '%00000001%'
ORDER BY created_at DESC NULLS LAST, id LIMIT 10
""",
    USER,
)
def users_listing(t):
    return plans.users_listing(t, search="00000001")


@report(
    "SELECT id, name, email, role, status, json_extract_string(social_ids, '$.handle') AS handle, created_at "
    "FROM v_users",
)
def user_detail(t):
    rows = plans.user_detail(t, t["users"].select("id"))
    handle = decode_json("social_ids")["handle"].alias("handle")
    return rows.select("id", "name", "email", "role", "status", handle, "created_at")


def _info(counted: str, limit: int, page: int = 1) -> str:
    return f"""
SELECT count(*) AS total, CAST(ceil(count(*) / {limit}) AS BIGINT) AS total_pages,
       CAST({page} AS BIGINT) AS current_page, CAST({limit} AS BIGINT) AS "limit"
FROM {counted}
"""


@report(_info("v_customer WHERE projectno_fk = 7", 10))
def page_info_customers(t):
    return ops.page_info(plans.customers_matching(t, project=7))


_LISTED = """v_custassignment a JOIN v_customer c ON a.custno_fk = c.custno_pk
JOIN v_employees e ON a.empno_fk = e.empno_pk"""


@report(_info(f"{_LISTED} WHERE upper(a.callstatus) = 'PENDING'", 20, 2))
def page_info_assignments(t):
    return ops.page_info(plans.assignments_matching(t, status="Pending"), 2, 20)


@report(_info("v_custassignment WHERE upper(callstatus) = 'PENDING'", 20, 2))
def page_info_assignments_base(t):
    return ops.page_info(plans.assignments_matching(t, status="Pending", total_mode="base"), 2, 20)


# --- worklists -----------------------------------------------------------------

_LISTING_SQL = f"""
SELECT {", ".join("a." + c for c in ASSIGNMENT)}, c.custname, c.custcode, c.custemailid AS custemail,
       e.name AS employee_name, e.empcode AS employee_code, p.projectname, p.projectcode
FROM {_LISTED} LEFT JOIN v_projects p ON c.projectno_fk = p.projectno_pk
"""
_LISTING_COLUMNS = [
    *ASSIGNMENT,
    *"custname custcode custemail employee_name employee_code projectname projectcode".split(),
]


@report(
    _LISTING_SQL
    + "WHERE upper(a.callstatus) = 'PENDING' ORDER BY a.assigndate DESC NULLS LAST, a.assignno_pk LIMIT 20 OFFSET 20",
    _LISTING_COLUMNS,
)
def assignments_listing(t):
    return plans.assignments_listing(t, status="Pending", page=2, limit=20)


@report(
    _LISTING_SQL
    + """WHERE a.empno_fk = 12 AND upper(a.callpriority) = 'HIGH'
ORDER BY a.assigndate DESC NULLS LAST, a.assignno_pk LIMIT 10""",
    _LISTING_COLUMNS,
)
def assignments_listing_agent(t):
    return plans.assignments_listing(t, empno=12, priority="high")


_WORK_SQL = f"""
SELECT {", ".join("a." + c for c in ASSIGNMENT)}, c.custname, c.custcode, c.custemailid AS custemail,
       p.projectname, p.projectcode
FROM v_custassignment a JOIN v_customer c ON a.custno_fk = c.custno_pk
LEFT JOIN v_projects p ON c.projectno_fk = p.projectno_pk
WHERE a.empno_fk = 7 {{more}}
ORDER BY CASE upper(a.callpriority) WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 END NULLS FIRST,
         a.calltargetdate {{nulls}}, a.assigndate DESC NULLS LAST, a.assignno_pk
{{page}}
"""
_WORK_COLUMNS = [*ASSIGNMENT, *"custname custcode custemail projectname projectcode".split()]


@report(_WORK_SQL.format(more="", nulls="NULLS FIRST", page="LIMIT 20 OFFSET 20"), _WORK_COLUMNS)
def agent_worklist(t):
    return plans.agent_worklist(t, agent=7, page=2, limit=20)


@report(
    _WORK_SQL.format(
        more="""AND (lower(c.custname) LIKE '%1%' OR lower(c.custmobilenumber) LIKE '%1%')
  AND upper(a.callstatus) = 'PENDING'
  AND a.calltargetdate >= '1994-01-01' AND a.calltargetdate <= '1998-01-01'""",
        nulls="NULLS LAST",
        page="LIMIT 10",
    ),
    _WORK_COLUMNS,
)
def agent_worklist_filtered(t):
    return plans.agent_worklist(
        t, agent="7", search="1", status="pending", start="1994-01-01", end="1998-01-01", nulls_last=True
    )


_HISTORY_SQL = f"""
SELECT {", ".join("h." + c for c in HISTORY)}, e.name AS employee_name, e.empcode AS employee_code
FROM v_call_history h
JOIN v_custassignment a ON h.assignno_fk = a.assignno_pk
LEFT JOIN v_employees e ON h.empno_fk = e.empno_pk
"""
_HISTORY_COLUMNS = [*HISTORY, "employee_name", "employee_code"]


@report(_HISTORY_SQL, _HISTORY_COLUMNS)
def assignment_history(t):
    return plans.assignment_history(t)


@report(_HISTORY_SQL + "WHERE h.assignno_fk IN (16, 20, 24)", _HISTORY_COLUMNS)
def assignment_history_by_id(t):
    return plans.assignment_history(t, ids=[16, 20, 24])


@report("""
SELECT a.assignno_pk, a.empno_fk, a.custno_fk, a.callstatus, a.callpriority,
       e.name AS employee_name, c.custname AS customer_name
FROM v_custassignment a
JOIN v_employees e ON a.empno_fk = e.empno_pk JOIN v_customer c ON a.custno_fk = c.custno_pk
""")
def assignment_check(t):
    return plans.assignment_check(t, n=None)


@report("""
SELECT a.assignno_pk, a.empno_fk, a.custno_fk, a.callstatus, a.callpriority,
       e.name AS employee_name, c.custname AS customer_name
FROM v_custassignment a
JOIN v_employees e ON a.empno_fk = e.empno_pk JOIN v_customer c ON a.custno_fk = c.custno_pk
ORDER BY a.assignno_pk LIMIT 10
""")
def assignment_preview(t):
    return plans.assignment_check(t)


@report(
    f"""
SELECT {", ".join("a." + c for c in ASSIGNMENT)}, c.custname, p.projectname
FROM v_custassignment a JOIN v_customer c ON a.custno_fk = c.custno_pk
LEFT JOIN v_projects p ON c.projectno_fk = p.projectno_pk WHERE a.empno_fk = 1
""",
    [*ASSIGNMENT, "custname", "projectname"],
)
def employee_assignments(t):
    return plans.employee_assignments(t, 1)


@report("SELECT empno_pk, empcode, name, role, empstatus FROM v_employees ORDER BY empno_pk LIMIT 5")
def employees_preview(t):
    return ops.preview(t["employees"], ["empno_pk", "empcode", "name", "role", "empstatus"], "empno_pk")


@report(
    "SELECT custno_pk, custcode, custname, custmobilenumber, projectno_fk FROM v_customer ORDER BY custno_pk LIMIT 5"
)
def customers_preview(t):
    columns = ["custno_pk", "custcode", "custname", "custmobilenumber", "projectno_fk"]
    return ops.preview(t["customer"], columns, "custno_pk")


# --- staffing ------------------------------------------------------------------

_MEMBERS_SQL = """
SELECT t.teamno_pk, t.teamcode, t.teamname, d.teamdtlno_pk, d.empno_fk, d.au_entryat,
       e.name AS employee_name, e.emailidoffical AS employee_email, e.role AS employee_role,
       e.empcode AS employee_code
FROM v_empteam t
JOIN v_empteamdtl d ON d.teamno_fk = t.teamno_pk
JOIN v_employees e ON d.empno_fk = e.empno_pk
"""
_MEMBERS = (
    "teamno_pk teamcode teamname teamdtlno_pk empno_fk au_entryat employee_name employee_email "
    "employee_role employee_code"
).split()


@report(_MEMBERS_SQL, _MEMBERS)
def team_members_flat(t):
    return plans.team_members_flat(t)


@report(
    """
SELECT t.teamno_pk, t.teamname, count(e.empno_pk) AS members,
       first(d.teamdtlno_pk ORDER BY d.au_entryat DESC NULLS LAST, d.teamdtlno_pk)
         FILTER (WHERE e.empno_pk IS NOT NULL) AS newest_member,
       first(d.teamdtlno_pk ORDER BY d.au_entryat NULLS FIRST, d.teamdtlno_pk DESC)
         FILTER (WHERE e.empno_pk IS NOT NULL) AS oldest_member
FROM v_empteam t
LEFT JOIN v_empteamdtl d ON d.teamno_fk = t.teamno_pk
LEFT JOIN v_employees e ON d.empno_fk = e.empno_pk
GROUP BY ALL
"""
)
def team_with_members(t):
    # a team is its parts, in order: the first begins with the newest member, the last ends with the oldest
    parts = plans.team_with_members(t).select(
        "teamno_pk",
        "teamname",
        "part",
        F.size("members").cast("long").alias("size"),
        F.try_element_at("members", F.lit(1))["teamdtlno_pk"].alias("newest"),
        F.try_element_at("members", F.lit(-1))["teamdtlno_pk"].alias("oldest"),
    )
    return parts.groupBy("teamno_pk", "teamname").agg(
        F.sum("size").alias("members"),
        F.min_by("newest", "part").alias("newest_member"),
        F.max_by("oldest", "part").alias("oldest_member"),
    )


_FREE_SQL = """
SELECT e.empno_pk, e.empcode, e.name, e.emailidoffical, e.role, e.empstatus
FROM v_employees e
WHERE upper(e.empstatus) = 'ACTIVE'
  AND e.empno_pk NOT IN (SELECT empno_fk FROM v_empteamdtl WHERE teamno_fk = {team} {nulls}) {search}
ORDER BY upper(e.name), e.empno_pk LIMIT 50
"""


@report(_FREE_SQL.format(team=0, nulls="", search=""))
def available_employees(t):
    return plans.available_employees(t, 0)


@report(f"SELECT count(*) AS available FROM ({_FREE_SQL.format(team=4, nulls='', search='')})")
def available_employees_null_trap(t):
    return plans.available_employees(t, 4).agg(F.count("*").alias("available"))


@report(
    _FREE_SQL.format(
        team=4,
        nulls="AND empno_fk IS NOT NULL",
        search="""AND (lower(e.name) LIKE '%3%' OR lower(e.emailidoffical) LIKE '%3%'
  OR lower(e.empcode) LIKE '%3%')""",
    )
)
def available_employees_null_safe(t):
    return plans.available_employees(t, 4, search="3", null_safe=True)


_STAFF_SQL = """
SELECT DISTINCT p.projectno_pk, e.empno_pk, e.empcode, e.name, e.emailidoffical, e.role
FROM v_projects p
JOIN v_employees e ON upper(e.empstatus) = 'ACTIVE' AND ({direct}
  e.empno_pk IN (SELECT d.empno_fk FROM v_empteamdtl d WHERE d.teamno_fk = p.projectdefault_teamno_fk))
"""


@report(_STAFF_SQL.format(direct="e.assigned_project_id = p.projectno_pk OR"))
def project_staff(t):
    return plans.project_staff(t)


@report(_STAFF_SQL.format(direct="") + "WHERE p.projectno_pk = 3")
def project_staff_team_only(t):
    return plans.project_staff(t, project=3, mode="team_only")


_CLIENT_SQL = """
SELECT c.projectno_fk, c.custno_pk, c.custcode, c.custname, c.custmobilenumber, c.custemailid AS custemail,
       a.assignno_pk, a.assignno_pk IS NOT NULL AS is_assigned,
       a.empno_fk AS assigned_to_empno, e.name AS assigned_to_name
FROM v_customer c
LEFT JOIN {assignments} a ON c.custno_pk = a.custno_fk
LEFT JOIN v_employees e ON a.empno_fk = e.empno_pk
WHERE c.projectno_fk IS NOT NULL
"""


@report(_CLIENT_SQL.format(assignments="v_custassignment"))
def project_customers(t):
    return plans.project_customers(t)


@report(
    _CLIENT_SQL.format(
        assignments="""(SELECT * FROM v_custassignment WHERE custno_fk IS NOT NULL QUALIFY
  row_number() OVER (PARTITION BY custno_fk ORDER BY assigndate DESC, assignno_pk DESC) = 1)"""
    )
    + "AND c.projectno_fk = 3"
)
def project_customers_latest(t):
    return plans.project_customers(t, project=3, latest_only=True)


@report("""
SELECT c.projectno_fk, c.custno_pk, c.custcode, c.custname, c.custmobilenumber, c.custemailid AS custemail
FROM v_customer c
WHERE c.projectno_fk IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v_custassignment a WHERE a.custno_fk = c.custno_pk)
""")
def unassigned_customers(t):
    return plans.unassigned_customers(t)


# --- batch lookups ---------------------------------------------------------------


@report("""
SELECT DISTINCT h.assignno_fk AS assignno_pk FROM v_call_history h
WHERE h.assignno_fk NOT IN (SELECT assignno_pk FROM v_custassignment)
""")
def lookup_missing(t):
    keys = t["call_history"].select(F.col("assignno_fk").alias("assignno_pk"))
    return ops.lookup(t["custassignment"], "assignno_pk", keys)[1]


@report(
    f"""
SELECT {", ".join("e." + c for c in EMPLOYEE)} FROM v_employees e
WHERE EXISTS (SELECT 1 FROM v_customer c
              WHERE c.custcode IS NOT NULL AND (upper(e.empcode) = upper(replace(c.custcode, 'C', 'E'))
                 OR upper(e.emailidoffical) = upper(replace(c.custemailid, 'customer', 'SUPPLIER'))))
""",
    EMPLOYEE,
)
def match_either(t):
    codes = t["customer"].select(F.replace("custcode", F.lit("C"), F.lit("E")).alias("value"))
    mails = t["customer"].select(F.replace("custemailid", F.lit("customer"), F.lit("SUPPLIER")).alias("value"))
    return ops.match_either(t["employees"], ("empcode", "emailidoffical"), codes.unionByName(mails))


# Requested are, as text, the customers of all assignments as if they were employees; some are spelled as no key is.
@report("""
WITH asked AS (
  SELECT DISTINCT concat(CASE WHEN callstatus = 'Sales Generated' THEN 'no. ' ELSE '' END, CAST(custno_fk AS VARCHAR)) AS id
  FROM v_custassignment WHERE custno_fk IS NOT NULL)
SELECT asked.id, e.name, e.empno_pk IS NOT NULL AS found
FROM asked LEFT JOIN v_employees e ON CAST(e.empno_pk AS VARCHAR) = asked.id
""")
def details_found_and_missing(t):
    spelled = F.when(F.col("callstatus") == "Sales Generated", "no. ").otherwise("")
    asked = t["custassignment"].where("custno_fk IS NOT NULL").select(F.concat(spelled, F.col("custno_fk").cast("string")).alias("id"))
    found, missing = plans.details(t, "employees", asked.distinct())
    return found.select(F.col("empno_pk").cast("string").alias("id"), "name", F.lit(True).alias("found")).unionByName(
        missing.select(F.col("empno_pk").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("found"))
    )
