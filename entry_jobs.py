"""Registered maintenance, sink and streaming queries, and the SQL each must equal.

Every change batch is derived from the given tables.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from dialweave import maintenance as jobs
from dialweave import operators as ops
from dialweave import plans, streaming
from dialweave.session import shared_dir
from dialweave.sources import SET_NULL_RULES, TABLES, append, load_snapshot, load_tables, publish, star
from entry_reports import CUSTOMER, REPORT_SQL

JOB_QUERIES: dict = {}
JOB_SQL: dict[str, str] = {}

RUN_TS = "2024-02-01 00:00:00"


def tables(spark, sf):
    return load_tables(spark, sf, source="star")


def job(sql: str | None):
    """Register a function of (spark, sf_dir) together with its SQL."""

    def register(query):
        JOB_QUERIES[query.__name__] = query
        if sql is not None:
            JOB_SQL[query.__name__] = sql
        return query

    return register


def text_of(reasons: str = "reasons"):
    return F.array_join(reasons, "; ").alias("reasons")


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- ingest ----------------------------------------------------------------------
# The batch turns every customer into a new employee. Furniture customers bring an
# existing supplier's email, machinery customers none, two neighbours share a user
# name (in different case), and some projects do not exist.


def _recruits(t):
    kind = F.col("custtype")
    return t["customer"].select(
        "custno_pk",
        F.col("custname").alias("name"),
        F.when(kind == "FURNITURE", F.replace("custemailid", F.lit("customer"), F.lit("SUPPLIER")))
        .when(kind != "MACHINERY", F.col("custemailid"))
        .alias("emailidoffical"),
        F.concat(
            F.when(F.col("custno_pk") % 2 == 0, "user").otherwise("USER"),
            F.floor(F.col("custno_pk") / 2).cast("string"),
        ).alias("username"),
        F.when(kind == "BUILDING", "").otherwise("TRAINEE").alias("role"),
        (F.col("projectno_fk") + 5).alias("assigned_project_id"),
    )


_RECRUITS = """
recruit AS (
  SELECT custno_pk, custname AS name,
         CASE WHEN custtype = 'FURNITURE' THEN replace(custemailid, 'customer', 'SUPPLIER')
              WHEN custtype <> 'MACHINERY' THEN custemailid END AS emailidoffical,
         concat(CASE WHEN custno_pk % 2 = 0 THEN 'user' ELSE 'USER' END, custno_pk // 2) AS username,
         CASE WHEN custtype = 'BUILDING' THEN 'AGENT' ELSE 'TRAINEE' END AS role,
         projectno_fk + 5 AS assigned_project_id
  FROM v_customer),
judged AS (
  SELECT r.*, concat_ws('; ',
         CASE WHEN emailidoffical IS NULL THEN 'emailidoffical' END,
         CASE WHEN assigned_project_id NOT IN (SELECT projectno_pk FROM v_projects)
              THEN 'assigned_project_id not found' END,
         CASE WHEN upper(emailidoffical) IN (SELECT upper(emailidoffical) FROM v_employees)
              THEN 'emailidoffical exists' END) AS reasons
  FROM recruit r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY reasons = '', upper(username) ORDER BY custno_pk) AS place FROM judged)
"""


@job(
    f"""WITH {_RECRUITS}
SELECT (SELECT max(empno_pk) FROM v_employees) + row_number() OVER (ORDER BY custno_pk) AS empno_pk,
       name, emailidoffical, username, role, 0 AS capacity, 'Active' AS empstatus,
       'N' AS restricteddataprivilege, assigned_project_id,
       TIMESTAMP '{RUN_TS}' AS joindate, TIMESTAMP '{RUN_TS}' AS au_entryat, CAST(1 AS BIGINT) AS au_entryempnoby
FROM ranked WHERE reasons = '' AND place = 1
"""
)
def ingest_employees(spark, sf):
    t = tables(spark, sf)
    change = jobs.ingest(t, "employees", _recruits(t), RUN_TS, user=1, order_by=["custno_pk"])
    return change.delta.select(
        "empno_pk",
        "name",
        "emailidoffical",
        "username",
        "role",
        "capacity",
        "empstatus",
        "restricteddataprivilege",
        "assigned_project_id",
        "joindate",
        "au_entryat",
        "au_entryempnoby",
    )


@job(
    f"""WITH {_RECRUITS}
SELECT custno_pk, username, CASE WHEN reasons = '' THEN 'duplicate in batch' ELSE reasons END AS reasons
FROM ranked WHERE reasons <> '' OR place > 1
"""
)
def ingest_employees_rejects(spark, sf):
    t = tables(spark, sf)
    change = jobs.ingest(t, "employees", _recruits(t), RUN_TS, user=1, order_by=["custno_pk"])
    return change.rejects.select("custno_pk", "username", text_of())


# Every employee asks to join the team of the project they are assigned to.
@job("""WITH request AS (
  SELECT e.empno_pk AS empno_fk, p.projectdefault_teamno_fk AS teamno_fk
  FROM v_employees e LEFT JOIN v_projects p ON e.assigned_project_id = p.projectno_pk)
SELECT r.empno_fk, r.teamno_fk,
       CASE WHEN r.teamno_fk IS NULL THEN 'teamno_fk'
            WHEN EXISTS (SELECT 1 FROM v_empteamdtl d WHERE d.teamno_fk = r.teamno_fk AND d.empno_fk = r.empno_fk)
            THEN 'teamno_fk+empno_fk exists' ELSE 'added' END AS outcome
FROM request r
""")
def ingest_team_members(spark, sf):
    t = tables(spark, sf)
    teams = t["projects"].select("projectno_pk", F.col("projectdefault_teamno_fk").alias("teamno_fk"))
    batch = (
        t["employees"]
        .join(teams, F.col("assigned_project_id") == F.col("projectno_pk"), "left")
        .select("teamno_fk", F.col("empno_pk").alias("empno_fk"))
    )
    change = jobs.ingest(t, "empteamdtl", batch, RUN_TS, user=1, order_by=["empno_fk"])
    added = change.delta.select("empno_fk", "teamno_fk", F.lit("added").alias("outcome"))
    refused = change.rejects.select("empno_fk", "teamno_fk", text_of().alias("outcome"))
    return added.unionByName(refused)


# Customers arrive as employees under their email; furniture ones exist already and
# neighbours repeat one another.
@job("""WITH batch AS (
  SELECT custno_pk, custname AS name,
         CASE WHEN custtype = 'FURNITURE' THEN replace(custemailid, 'customer', 'SUPPLIER')
              ELSE concat('pair', custno_pk // 2, '@example.com') END AS emailidoffical
  FROM v_customer)
, fresh AS (
SELECT custno_pk, name, emailidoffical FROM batch
WHERE upper(emailidoffical) NOT IN (SELECT upper(emailidoffical) FROM v_employees)
QUALIFY row_number() OVER (PARTITION BY upper(emailidoffical) ORDER BY custno_pk) = 1)
SELECT (SELECT max(empno_pk) FROM v_employees) + row_number() OVER (ORDER BY custno_pk) AS empno_pk,
       name, emailidoffical, 'AGENT' AS role, 'Active' AS empstatus
FROM fresh
""")
def insert_ignore(spark, sf):
    t = tables(spark, sf)
    pair = F.concat(F.lit("pair"), F.floor(F.col("custno_pk") / 2).cast("string"), F.lit("@example.com"))
    taken = F.replace("custemailid", F.lit("customer"), F.lit("SUPPLIER"))
    batch = t["customer"].select(
        "custno_pk",
        F.col("custname").alias("name"),
        F.when(F.col("custtype") == "FURNITURE", taken).otherwise(pair).alias("emailidoffical"),
    )
    change = jobs.insert_ignore(t, "employees", batch, ["emailidoffical"], ["custno_pk"], RUN_TS)
    return change.delta.select("empno_pk", "name", "emailidoffical", "role", "empstatus")


# --- updates ---------------------------------------------------------------------
# Every event is a change request on its assignment: views set nothing they may,
# errors set the follow-up date, the rest set the status (clicks: to NULL).


def _changes(spark, sf):
    feed = star.interaction_feed(star.read_source(spark, sf, "events"))
    status = F.create_map(F.lit("callstatus"), F.col("callstatus"))
    due = F.create_map(F.lit("followupdate"), F.date_format("calleddatetime", "yyyy-MM-dd HH:mm:ss"))
    junk = F.create_map(F.lit("assignno_pk"), F.lit("1"))
    kind = F.col("callstatus")  # errors are "No Answer", views are "Pending"
    return feed.select(
        F.col("assignno_pk").alias("pk"),
        F.col("event_id").alias("seq"),
        F.col("empno").alias("updated_by"),
        F.when(kind == "No Answer", due).when(kind == "Pending", junk).otherwise(status).alias("changes"),
    )


@job(f"""WITH change AS (
  SELECT f.*, e.event_type FROM v_feed f JOIN events e USING (event_id)),
folded AS (
  SELECT assignno_pk,
         first(callstatus ORDER BY event_id DESC)
           FILTER (WHERE event_type IN ('purchase', 'signup', 'click')) AS status,
         count(*) FILTER (WHERE event_type IN ('purchase', 'signup', 'click')) AS n_status,
         max(event_id) FILTER (WHERE event_type = 'error') AS last_error,
         first(empno ORDER BY event_id DESC) AS by
  FROM change GROUP BY assignno_pk)
SELECT a.assignno_pk,
       CASE WHEN f.n_status > 0 THEN f.status ELSE a.callstatus END AS callstatus,
       date_trunc('second', e.ts) AS followupdate,
       f.by AS au_updateempnoby,
       CASE WHEN f.assignno_pk IS NOT NULL THEN TIMESTAMP '{RUN_TS}' END AS au_updateat
FROM v_custassignment a
LEFT JOIN folded f ON a.assignno_pk = f.assignno_pk
LEFT JOIN events e ON e.event_id = f.last_error
""")
def partial_update(spark, sf):
    change = jobs.partial_update(tables(spark, sf), "custassignment", _changes(spark, sf), RUN_TS)
    return change.new.select("assignno_pk", "callstatus", "followupdate", "au_updateempnoby", "au_updateat")


# Every employee asks for a user name: agents for the one of the next employee, the
# others for one shared by all employees with the same project.
@job(f"""WITH request AS (
  SELECT empno_pk, CASE WHEN upper(role) = 'AGENT'
         THEN concat('supplier.', lpad(CAST(empno_pk + 1 AS VARCHAR), 9, '0'))
         ELSE concat('project', coalesce(CAST(assigned_project_id AS VARCHAR), '')) END AS wanted
  FROM v_employees),
judged AS (
  SELECT r.*, EXISTS (SELECT 1 FROM v_employees e
                      WHERE upper(e.username) = upper(r.wanted) AND e.empno_pk <> r.empno_pk) AS in_use
  FROM request r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY in_use, upper(wanted) ORDER BY empno_pk) AS place FROM judged)
SELECT e.empno_pk, CASE WHEN NOT r.in_use AND r.place = 1 THEN r.wanted ELSE e.username END AS username,
       CASE WHEN r.in_use THEN 'username in use' WHEN r.place > 1 THEN 'claimed by an earlier change' END AS refused
FROM v_employees e JOIN ranked r USING (empno_pk)
""")
def partial_update_unique(spark, sf):
    t = tables(spark, sf)
    following = F.concat(F.lit("supplier."), F.lpad((F.col("empno_pk") + 1).cast("string"), 9, "0"))
    shared = F.concat(F.lit("project"), F.coalesce(F.col("assigned_project_id").cast("string"), F.lit("")))
    wanted = F.when(F.upper("role") == "AGENT", following).otherwise(shared)
    feed = t["employees"].select(
        F.col("empno_pk").alias("pk"),
        F.create_map(F.lit("username"), wanted).alias("changes"),
        F.lit(1).cast("long").alias("updated_by"),
        F.col("empno_pk").alias("seq"),
    )
    change = jobs.partial_update(t, "employees", feed, RUN_TS)
    refused = change.rejects.select("pk", text_of().alias("refused"))
    return change.new.join(refused, F.col("empno_pk") == F.col("pk"), "left").select("empno_pk", "username", "refused")


@job("""
SELECT f.assignno_pk AS pk, f.event_id AS seq, 'not found' AS reasons FROM v_feed f
WHERE f.assignno_pk NOT IN (SELECT assignno_pk FROM v_custassignment)
""")
def partial_update_rejects(spark, sf):
    change = jobs.partial_update(tables(spark, sf), "custassignment", _changes(spark, sf), RUN_TS)
    return change.rejects.select("pk", "seq", text_of())


@job(f"""
SELECT u.id, CASE WHEN upper(u.status) = 'INACTIVE' OR upper(u.role) = 'TRAINEE' THEN 'inactive' ELSE u.status END
         AS status,
       CASE WHEN upper(u.status) = 'INACTIVE' OR upper(u.role) = 'TRAINEE' THEN TIMESTAMP '{RUN_TS}' END AS updated_at
FROM v_users u
""")
def soft_delete(spark, sf):
    t = tables(spark, sf)
    leaving = (F.upper("status") == "INACTIVE") | (F.upper("role") == "TRAINEE")
    change = jobs.set_status(t, "users", t["users"].where(leaving).select("id"), "inactive", RUN_TS)
    return change.new.select("id", "status", "updated_at")


# --- interactions ------------------------------------------------------------------

_ACCEPTED = """
accepted AS (
  SELECT f.*, a.custno_fk FROM v_feed f
  JOIN v_custassignment a ON a.assignno_pk = f.assignno_pk AND a.empno_fk = f.empno)
"""
_APPLIED = f"""WITH {_ACCEPTED},
folded AS (
  SELECT assignno_pk,
         first(calleddatetime ORDER BY event_id DESC) AS calleddatetime,
         first(callstatus ORDER BY event_id DESC) FILTER (WHERE callstatus IS NOT NULL) AS callstatus,
         first(count_call ORDER BY event_id DESC) FILTER (WHERE count_call IS NOT NULL) AS count_call,
         max(empno) AS by
  FROM accepted GROUP BY assignno_pk)
SELECT a.assignno_pk, f.calleddatetime, coalesce(f.callstatus, a.callstatus) AS callstatus,
       coalesce(f.count_call, a.count_call) AS count_call, a.count_message,
       f.by AS au_updateempnoby,
       CASE WHEN f.assignno_pk IS NOT NULL THEN TIMESTAMP '{RUN_TS}' END AS au_updateat
FROM v_custassignment a LEFT JOIN folded f ON a.assignno_pk = f.assignno_pk
"""
_LOGGED = f"""WITH {_ACCEPTED}
SELECT (SELECT max(history_pk) FROM v_call_history) + row_number() OVER (ORDER BY event_id) AS history_pk,
       assignno_pk AS assignno_fk, custno_fk, empno AS empno_fk, interaction_type,
       calleddatetime AS interaction_datetime, callstatus, call_duration, empno AS au_entryempnoby,
       TIMESTAMP '{RUN_TS}' AS au_entryat
FROM accepted
"""
_ASSIGNED = "assignno_pk calleddatetime callstatus count_call count_message au_updateempnoby au_updateat".split()
_LOG = (
    "history_pk assignno_fk custno_fk empno_fk interaction_type interaction_datetime callstatus call_duration "
    "au_entryempnoby au_entryat"
).split()


def _feed(spark, sf):
    return star.interaction_feed(star.read_source(spark, sf, "events"))


@job(_APPLIED)
def interaction_apply(spark, sf):
    return jobs.apply_interactions(tables(spark, sf), _feed(spark, sf), RUN_TS).assignments.select(*_ASSIGNED)


@job(_LOGGED)
def interaction_history(spark, sf):
    return jobs.apply_interactions(tables(spark, sf), _feed(spark, sf), RUN_TS).delta.select(*_LOG)


@job("""
SELECT f.event_id, f.assignno_pk, f.empno FROM v_feed f
WHERE NOT EXISTS (SELECT 1 FROM v_custassignment a WHERE a.assignno_pk = f.assignno_pk AND a.empno_fk = f.empno)
""")
def interaction_rejects(spark, sf):
    applied = jobs.apply_interactions(tables(spark, sf), _feed(spark, sf), RUN_TS)
    return applied.rejects.select("event_id", "assignno_pk", "empno")


# Every customer without an assignment goes to an agent; household customers arrive
# under an unknown number.
_ASSIGN = """WITH free AS (
  SELECT CASE WHEN custtype = 'HOUSEHOLD' THEN -custno_pk ELSE custno_pk END AS custno, custno_pk % 120 AS empno,
         CASE WHEN custtype = 'BUILDING' THEN 'High' END AS priority
  FROM v_customer c
  WHERE NOT EXISTS (SELECT 1 FROM v_custassignment a WHERE a.custno_fk = c.custno_pk))
"""


def _free_customers(t):
    free = t["customer"].join(
        t["custassignment"].select(F.col("custno_fk").alias("custno_pk")).distinct(), "custno_pk", "left_anti"
    )
    unknown = F.col("custtype") == "HOUSEHOLD"
    return free.select(
        F.when(unknown, -F.col("custno_pk")).otherwise(F.col("custno_pk")).alias("custno"),
        (F.col("custno_pk") % 120).alias("empno"),
        F.lit(None).cast("timestamp_ntz").alias("calltargetdate"),
        F.when(F.col("custtype") == "BUILDING", "High").alias("callpriority"),
        F.lit(2).cast("long").alias("assigned_by"),
    )


@job(
    _ASSIGN
    + f"""
SELECT (SELECT max(assignno_pk) FROM v_custassignment) + row_number() OVER (ORDER BY f.custno) AS assignno_pk,
       f.custno AS custno_fk, f.empno AS empno_fk, c.custmobilenumber,
       coalesce(f.priority, 'Low') AS callpriority, 'Pending' AS callstatus,
       TIMESTAMP '{RUN_TS}' AS assigndate, CAST(2 AS BIGINT) AS au_entryempnoby
FROM free f JOIN v_customer c ON f.custno = c.custno_pk JOIN v_employees e ON f.empno = e.empno_pk
"""
)
def bulk_assign(spark, sf):
    t = tables(spark, sf)
    return jobs.bulk_assign(t, _free_customers(t), RUN_TS).delta.select(
        "assignno_pk",
        "custno_fk",
        "empno_fk",
        "custmobilenumber",
        "callpriority",
        "callstatus",
        "assigndate",
        "au_entryempnoby",
    )


@job(
    _ASSIGN
    + """
SELECT f.custno, f.empno, concat_ws('; ', CASE WHEN c.custno_pk IS NULL THEN 'customer not found' END,
       CASE WHEN e.empno_pk IS NULL THEN 'employee not found' END) AS reasons
FROM free f LEFT JOIN v_customer c ON f.custno = c.custno_pk LEFT JOIN v_employees e ON f.empno = e.empno_pk
WHERE c.custno_pk IS NULL OR e.empno_pk IS NULL
"""
)
def bulk_assign_rejects(spark, sf):
    t = tables(spark, sf)
    return jobs.bulk_assign(t, _free_customers(t), RUN_TS).rejects.select("custno", "empno", text_of())


# --- deletes and integrity -----------------------------------------------------------


def _left(deleted, names):
    parts = [
        deleted.tables[n].select(F.lit(n).alias("table"), F.col(TABLES[n].key).alias("key")) for n in names
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# All household customers go, with their assignments and the history of either.
@job("""WITH gone AS (SELECT custno_pk FROM v_customer WHERE custtype = 'HOUSEHOLD'),
gone_a AS (SELECT assignno_pk FROM v_custassignment WHERE custno_fk IN (SELECT custno_pk FROM gone))
SELECT 'customer' AS "table", custno_pk AS key FROM v_customer WHERE custno_pk NOT IN (SELECT custno_pk FROM gone)
UNION ALL
SELECT 'custassignment', assignno_pk FROM v_custassignment
WHERE assignno_pk NOT IN (SELECT assignno_pk FROM gone_a)
UNION ALL
SELECT 'call_history', history_pk FROM v_call_history
WHERE assignno_fk NOT IN (SELECT assignno_pk FROM gone_a) AND custno_fk NOT IN (SELECT custno_pk FROM gone)
""")
def delete_cascade(spark, sf):
    t = tables(spark, sf)
    keys = t["customer"].where(F.col("custtype") == "HOUSEHOLD").select("custno_pk")
    return _left(jobs.delete(t, "customer", keys), ["customer", "custassignment", "call_history"])


# All closed projects go; employees, customers and calls keep their rows.
@job("""WITH gone AS (SELECT projectno_pk FROM v_projects WHERE projectstatus = 'CLOSED')
SELECT 'customer' AS "table", custno_pk AS key,
       CASE WHEN projectno_fk NOT IN (SELECT projectno_pk FROM gone) THEN projectno_fk END AS project FROM v_customer
UNION ALL
SELECT 'employees', empno_pk,
       CASE WHEN assigned_project_id NOT IN (SELECT projectno_pk FROM gone) THEN assigned_project_id END
FROM v_employees
UNION ALL
SELECT 'calls', id, CASE WHEN project_id NOT IN (SELECT projectno_pk FROM gone) THEN project_id END FROM v_calls
""")
def delete_set_null(spark, sf):
    t = tables(spark, sf)
    keys = t["projects"].where(F.col("projectstatus") == "CLOSED").select("projectno_pk")
    left = jobs.delete(t, "projects", keys).tables

    def part(name, key, fk):
        return left[name].select(F.lit(name).alias("table"), F.col(key).alias("key"), F.col(fk).alias("project"))

    return (
        part("customer", "custno_pk", "projectno_fk")
        .unionByName(part("employees", "empno_pk", "assigned_project_id"))
        .unionByName(part("calls", "id", "project_id"))
    )


# All inactive employees go under the rules that keep assignments and history.
@job("""WITH gone AS (SELECT empno_pk FROM v_employees WHERE empstatus = 'Inactive')
SELECT 'custassignment' AS "table", assignno_pk AS key,
       CASE WHEN empno_fk NOT IN (SELECT empno_pk FROM gone) THEN empno_fk END AS empno_fk FROM v_custassignment
UNION ALL
SELECT 'call_history', history_pk,
       CASE WHEN empno_fk NOT IN (SELECT empno_pk FROM gone) THEN empno_fk END FROM v_call_history
UNION ALL
SELECT 'empteamdtl', teamdtlno_pk, empno_fk FROM v_empteamdtl
WHERE empno_fk IS NULL OR empno_fk NOT IN (SELECT empno_pk FROM gone)
""")
def delete_keep_history(spark, sf):
    t = tables(spark, sf)
    keys = t["employees"].where(F.col("empstatus") == "Inactive").select("empno_pk")
    left = jobs.delete(t, "employees", keys, SET_NULL_RULES).tables

    def part(name, key):
        return left[name].select(F.lit(name).alias("table"), F.col(key).alias("key"), "empno_fk")

    return (
        part("custassignment", "assignno_pk")
        .unionByName(part("call_history", "history_pk"))
        .unionByName(part("empteamdtl", "teamdtlno_pk"))
    )


def _orphan_sql(table: str, column: str, parent: str, key: str) -> str:
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", {column} AS key, count(*) AS n FROM v_{table}
WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM v_{parent}) GROUP BY {column}"""


@job(
    "\nUNION ALL\n".join(
        _orphan_sql(*ref)
        for ref in [
            ("projects", "projectdefault_teamno_fk", "empteam", "teamno_pk"),
            ("employees", "assigned_project_id", "projects", "projectno_pk"),
            ("empteamdtl", "teamno_fk", "empteam", "teamno_pk"),
            ("empteamdtl", "empno_fk", "employees", "empno_pk"),
            ("customer", "projectno_fk", "projects", "projectno_pk"),
            ("custassignment", "custno_fk", "customer", "custno_pk"),
            ("custassignment", "empno_fk", "employees", "empno_pk"),
            ("call_history", "assignno_fk", "custassignment", "assignno_pk"),
            ("call_history", "custno_fk", "customer", "custno_pk"),
            ("call_history", "empno_fk", "employees", "empno_pk"),
            ("calls", "employee_id", "employees", "empno_pk"),
            ("calls", "project_id", "projects", "projectno_pk"),
        ]
    )
)
def orphan_report(spark, sf):
    return jobs.orphans(tables(spark, sf))


@job(f"""WITH {_RECRUITS}
SELECT custno_pk, name, CASE WHEN emailidoffical IS NULL THEN 'emailidoffical' ELSE '' END AS reasons FROM recruit
""")
def validate_employees(spark, sf):
    batch = _recruits(tables(spark, sf))
    rules = jobs.quality.rules_for("employees", batch.columns)
    accepted, rejected = jobs.validate(batch, rules)
    return (
        accepted.select("custno_pk", "name", F.lit("").alias("reasons"))
        .unionByName(rejected.select("custno_pk", "name", text_of()))
    )


# --- sinks and streams -----------------------------------------------------------------

_DAYS = """
SELECT CAST(interaction_datetime AS DATE) AS date, count(*) AS total_interactions,
       count(CASE WHEN callstatus = 'Sales Generated' THEN 1 END) AS sales_generated
FROM v_call_history {where}
GROUP BY 1
"""


@job(_DAYS.format(where="WHERE interaction_datetime >= '2024-01-05' AND interaction_datetime <= '2024-01-25'"))
def snapshot_daily_activity(spark, sf):
    """Publish the tables, read the snapshot back, and report on pruned day folders."""
    root = new_folder(spark, "snapshot")
    t = tables(spark, sf)
    publish({"call_history": t["call_history"]}, root, version=1)
    return plans.daily_activity(load_snapshot(spark, root), "2024-01-05", "2024-01-25")


@job("""
SELECT p.projectno_pk, p.projectname, 'CLOSED' AS projectstatus, count(h.history_pk) AS calls
FROM v_projects p LEFT JOIN v_customer c ON c.projectno_fk = p.projectno_pk LEFT JOIN v_call_history h ON h.custno_fk = c.custno_pk
GROUP BY 1, 2
""")
def snapshot_carries_tables(spark, sf):
    """A second version changes the projects alone; the history and customers of the first are carried by reference."""
    root = new_folder(spark, "snapshot")
    t = tables(spark, sf)
    publish({n: t[n] for n in ("call_history", "customer", "projects")}, root, version=1)
    closed = jobs.set_status(load_snapshot(spark, root), "projects", t["projects"].select("projectno_pk"), "CLOSED", RUN_TS)
    publish({"projects": closed.new}, root, version=2)
    now = load_snapshot(spark, root)
    calls = now["call_history"].where("custno_fk IS NOT NULL").groupBy("custno_fk").agg(F.count("*").alias("n"))
    customers = now["customer"].select("custno_pk", "projectno_fk")
    per_project = calls.join(customers, F.col("custno_fk") == F.col("custno_pk")).groupBy("projectno_fk").agg(F.sum("n").alias("calls"))
    joined = now["projects"].join(per_project, F.col("projectno_fk") == F.col("projectno_pk"), "left")
    return joined.select("projectno_pk", "projectname", "projectstatus", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


@job(_DAYS.format(where=""))
def append_history(spark, sf):
    """The history appended in two parts, by kind of interaction, into one table of day folders."""
    root = new_folder(spark, "appended")
    history = tables(spark, sf)["call_history"]
    calls = F.coalesce(F.col("interaction_type") == "call", F.lit(False))
    append(history.where(calls), root, "call_history")
    append(history.where(~calls), root, "call_history")
    return plans.performance.daily_counts(load_tables(spark, root)["call_history"])


_LISTED = [*CUSTOMER, "project_name", "project_code"]


@job(REPORT_SQL["customers_listing"])
def customers_listing_indexed(spark, sf):
    """The search of customers_listing through an index of all customers."""
    t, path = tables(spark, sf), new_folder(spark, "postings")
    plans.write_search_index(t, "customer", path)
    return plans.customers_listing(t, search="00000001", index=ops.read_postings(spark, path)).select(*_LISTED)


@job(f"""
SELECT {", ".join("c." + x for x in CUSTOMER)}, p.projectname AS project_name, p.projectcode AS project_code
FROM v_customer c LEFT JOIN v_projects p ON c.projectno_fk = p.projectno_pk
ORDER BY c.au_entryat DESC NULLS LAST, c.custno_pk LIMIT 10 OFFSET 110
""")
def customers_listing_fenced(spark, sf):
    """Page 12 of all customers, read between the fences around it."""
    t = tables(spark, sf)
    fence = plans.customer_fences(t, every=50, ranges=8)
    return plans.customers_listing(t, page=12, fence=fence).select(*_LISTED)


@job(
    REPORT_SQL["agent_performance_whole_days"].replace("count(DISTINCT h.custno_fk) AS unique_customers_contacted", "true AS near")
)
def agent_performance_by_days(spark, sf):
    """Agents' work from a stored table of days; the customers reached are within a tenth, or one, of the true number."""
    t, path = tables(spark, sf), new_folder(spark, "agent-days")
    plans.agent_days(t).write.parquet(path)
    days = plans.agent_performance_by_days(t, spark.read.parquet(path), "2024-01-05", "2024-01-25")
    true = plans.agent_performance(t, "2024-01-05", "2024-01-25", end_of_day=True)
    true = true.select(F.col("empno_pk").alias("who"), F.col("unique_customers_contacted").alias("reached"))
    off = F.abs(F.col("unique_customers_contacted") - F.col("reached"))
    rows = days.join(true, F.col("empno_pk") == F.col("who"), "left")
    near = (off <= F.greatest(F.lit(1), F.col("reached") / 10)).alias("near")
    return rows.select(*[c for c in days.columns if c != "unique_customers_contacted"], near)


def event_stream(spark, sf):
    """The folder as a stream that picks up the event files."""
    reader = spark.readStream.schema(star.SOURCE_SCHEMAS["events"])
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf)


# Every day is there, the open ones too: readers sum what each micro-batch has counted.
@job(_DAYS.format(where=""))
def stream_daily_activity(spark, sf):
    events = event_stream(spark, sf)
    root = new_folder(spark, "activity")
    streaming.start_activity(star.call_history(events), root).awaitTermination()
    return streaming.stored_activity(spark, root)


def _run_feed(spark, sf):
    events = event_stream(spark, sf)
    root = new_folder(spark, "feed")
    feed = star.interaction_feed(events)
    streaming.start_interactions(feed, lambda: tables(spark, sf), root, RUN_TS).awaitTermination()
    return root


@job(_LOGGED)
def stream_interaction_history(spark, sf):
    return streaming.stored_history(spark, _run_feed(spark, sf)).select(*_LOG)


@job(_APPLIED)
def stream_interaction_state(spark, sf):
    root = _run_feed(spark, sf)
    return streaming.current_assignments(tables(spark, sf), root).select(*_ASSIGNED)


@job(_LOGGED)
def stream_interaction_folded(spark, sf):
    """The log after its batches were folded into one span and the batches deleted."""
    root = _run_feed(spark, sf)
    streaming.fold_interactions(spark, root)
    streaming.prune_interactions(spark, root)
    return streaming.stored_history(spark, root).select(*_LOG)
