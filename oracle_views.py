"""SQL text of the logical tables over the star schema, for the DuckDB check.

Written independently of ``dialweave.sources.star``; ``FIXTURES.md`` is the
common specification.
"""

from __future__ import annotations

VIEWS = {
    "v_projects": """
SELECT CAST(n_nationkey AS BIGINT) AS projectno_pk,
       concat('P', n_nationkey) AS projectcode,
       n_name AS projectname,
       CASE WHEN n_nationkey % 5 = 4 THEN 'CLOSED' ELSE 'OPEN' END AS projectstatus,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS projectdefault_teamno_fk,
       TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS au_entryat
FROM nation""",
    "v_empteam": """
SELECT CAST(r_regionkey AS BIGINT) AS teamno_pk,
       concat('T', r_regionkey) AS teamcode,
       r_name AS teamname,
       TIMESTAMP '2023-01-01' + to_days(r_regionkey) AS au_entryat
FROM region""",
    "v_employees": """
SELECT s_suppkey AS empno_pk,
       concat('E', s_suppkey) AS empcode,
       s_name AS name,
       CASE s_suppkey % 8 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MANAGER' WHEN 2 THEN 'TRAINEE'
            WHEN 3 THEN 'Agent' ELSE 'AGENT' END AS role,
       CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS empstatus,
       concat(lower(replace(s_name, '#', '.')), '@example.com') AS emailidoffical,
       lower(replace(s_name, '#', '.')) AS username,
       CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS assigned_project_id,
       TIMESTAMP '2023-06-01' + to_days(CAST(s_suppkey % 90 AS INTEGER)) AS au_entryat
FROM supplier""",
    "v_empteamdtl": """
SELECT s_suppkey AS teamdtlno_pk,
       CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS teamno_fk,
       CASE WHEN s_suppkey IN (14, 64) THEN NULL ELSE s_suppkey END AS empno_fk,
       TIMESTAMP '2023-07-01' + to_days(CAST(s_suppkey % 60 AS INTEGER)) AS au_entryat
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_customer": """
SELECT c_custkey AS custno_pk,
       concat('C', c_custkey) AS custcode,
       c_name AS custname,
       concat('+880 17', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS custmobilenumber,
       concat(lower(replace(c_name, '#', '.')), '@example.com') AS custemailid,
       c_mktsegment AS custtype,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS projectno_fk,
       TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS au_entryat
FROM customer""",
    "v_custassignment": """
SELECT o_orderkey AS assignno_pk,
       o_orderdate AS assigndate,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 7 DAY END AS calltargetdate,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS custno_fk,
       CASE WHEN o_custkey % 7 = 0 THEN NULL
            ELSE concat('+880 17', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) END AS custmobilenumber,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 100 END AS empno_fk,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS callpriority,
       CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Completed'
            WHEN 'P' THEN 'Sales Generated' END AS callstatus,
       0 AS count_call,
       0 AS count_message,
       o_orderdate AS au_entryat
FROM orders""",
    "v_call_history": """
SELECT event_id AS history_pk,
       (event_id - event_id % 4) * 2 AS assignno_fk,
       user_id AS custno_fk,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS empno_fk,
       CASE event_id % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'sms' ELSE 'whatsapp' END AS interaction_type,
       ts AS interaction_datetime,
       CASE event_type WHEN 'purchase' THEN 'Sales Generated' WHEN 'error' THEN 'No Answer'
            WHEN 'signup' THEN 'Follow Up' WHEN 'view' THEN 'Pending' END AS callstatus,
       CAST(floor(value) AS INTEGER) AS call_duration,
       ts AS au_entryat
FROM events""",
    "v_calls": """
SELECT o_orderkey AS id,
       o_orderkey % 100 AS employee_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 23 END AS project_id,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' END AS status,
       o_orderdate AS created_at
FROM orders""",
    "v_users": """
SELECT empno_pk AS id, name, emailidoffical AS email, role, empstatus AS status,
       concat('{"handle":"', username, '"}') AS social_ids, au_entryat AS created_at
FROM v_employees""",
    "v_feed": """
SELECT event_id,
       (event_id - event_id % 4) * 2 AS assignno_pk,
       CASE WHEN event_type = 'error' THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)
            ELSE ((event_id - event_id % 4) * 2) % 100 END AS empno,
       CASE event_id % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'sms' ELSE 'whatsapp' END AS interaction_type,
       ts AS calleddatetime,
       CASE event_type WHEN 'purchase' THEN 'Sales Generated' WHEN 'error' THEN 'No Answer'
            WHEN 'signup' THEN 'Follow Up' WHEN 'view' THEN 'Pending' END AS callstatus,
       CASE WHEN event_type <> 'view' THEN CAST(event_id % 4 AS INTEGER) + 1 END AS count_call,
       CAST(floor(value) AS INTEGER) AS call_duration
FROM events""",
}

_NEEDS = {"v_users": ["v_employees"]}


def with_views(body: str) -> str:
    """``body`` with the views it names in front of it."""
    used = [v for v in VIEWS if v in body]
    used += [n for v in used for n in _NEEDS.get(v, []) if n not in used]
    ordered = [v for v in VIEWS if v in used]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
