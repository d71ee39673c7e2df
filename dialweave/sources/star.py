"""The contact-centre tables as views over a TPC-H-like star schema.

Every row of every source table appears in its view; a NULL reference marks
what is unassigned. ``FIXTURES.md`` describes the mapping column by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared, so opening a table reads no footers and runs no job.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def _day(base: str, offset: str) -> str:
    return f"cast(date_add(date'{base}', cast({offset} as int)) as timestamp_ntz)"


def _phone(key: str) -> str:
    return f"concat('+880 17', lpad(cast({key} as string), 8, '0'))"


def _handle(name: str) -> str:
    return f"lower(replace({name}, '#', '.'))"


def projects(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "cast(n_nationkey as bigint) as projectno_pk",
        "concat('P', n_nationkey) as projectcode",
        "n_name as projectname",
        "if(n_nationkey % 5 = 4, 'CLOSED', 'OPEN') as projectstatus",
        "cast(if(n_nationkey % 6 = 5, null, n_regionkey) as bigint) as projectdefault_teamno_fk",
        f"{_day('2024-01-01', 'n_nationkey')} as au_entryat",
    )


def empteam(region: DataFrame) -> DataFrame:
    return region.selectExpr(
        "cast(r_regionkey as bigint) as teamno_pk",
        "concat('T', r_regionkey) as teamcode",
        "r_name as teamname",
        f"{_day('2023-01-01', 'r_regionkey')} as au_entryat",
    )


def employees(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey as empno_pk",
        "concat('E', s_suppkey) as empcode",
        "s_name as name",
        """case s_suppkey % 8 when 0 then 'ADMIN' when 1 then 'MANAGER' when 2 then 'TRAINEE'
           when 3 then 'Agent' else 'AGENT' end as role""",
        "if(s_acctbal < 0, 'Inactive', 'Active') as empstatus",
        f"concat({_handle('s_name')}, '@example.com') as emailidoffical",
        f"{_handle('s_name')} as username",
        "cast(if(s_suppkey % 9 = 0, null, s_nationkey) as bigint) as assigned_project_id",
        f"{_day('2023-06-01', 's_suppkey % 90')} as au_entryat",
    )


def empteamdtl(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    home = nation.withColumnRenamed("n_nationkey", "s_nationkey")
    return supplier.join(home, "s_nationkey").selectExpr(
        "s_suppkey as teamdtlno_pk",
        "cast(if(s_suppkey % 4 = 3, null, n_regionkey) as bigint) as teamno_fk",
        "if(s_suppkey in (14, 64), null, s_suppkey) as empno_fk",
        f"{_day('2023-07-01', 's_suppkey % 60')} as au_entryat",
    )


def customer(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey as custno_pk",
        "concat('C', c_custkey) as custcode",
        "c_name as custname",
        f"{_phone('c_custkey')} as custmobilenumber",
        f"concat({_handle('c_name')}, '@example.com') as custemailid",
        "c_mktsegment as custtype",
        "cast(if(c_custkey % 11 = 0, null, c_nationkey) as bigint) as projectno_fk",
        f"{_day('2023-01-01', 'c_custkey % 365')} as au_entryat",
    )


def custassignment(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey as assignno_pk",
        "o_orderdate as assigndate",
        "if(o_orderkey % 5 = 0, null, o_orderdate + interval '7' day) as calltargetdate",
        "if(o_custkey % 7 = 0, null, o_custkey) as custno_fk",
        f"if(o_custkey % 7 = 0, null, {_phone('o_custkey')}) as custmobilenumber",
        "if(o_orderkey % 13 = 0, null, o_orderkey % 100) as empno_fk",
        """case o_orderpriority when '1-URGENT' then 'High' when '2-HIGH' then 'High'
           when '3-MEDIUM' then 'Medium' when '5-LOW' then 'Low' end as callpriority""",
        """case o_orderstatus when 'O' then 'Pending' when 'F' then 'Completed'
           when 'P' then 'Sales Generated' end as callstatus""",
        "0 as count_call",
        "0 as count_message",
        "o_orderdate as au_entryat",
    )


# Four events in a row belong to one assignment; a quarter of these keys dangle.
_ASSIGNMENT = "(event_id - event_id % 4) * 2"
# The payload is one flat number, {"k": 69}; a pattern reads it far faster than a JSON parser.
_AGENT = "try_cast(regexp_extract(props, '\"k\" *: *(-?[0-9]+)', 1) as bigint)"
_KIND = "case event_id % 3 when 0 then 'call' when 1 then 'sms' else 'whatsapp' end"
_STATUS = (
    "case event_type when 'purchase' then 'Sales Generated' when 'error' then 'No Answer' "
    "when 'signup' then 'Follow Up' when 'view' then 'Pending' end"
)
_SECONDS = "cast(floor(value) as int)"


def call_history(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as history_pk",
        f"{_ASSIGNMENT} as assignno_fk",
        "user_id as custno_fk",
        f"{_AGENT} as empno_fk",
        f"{_KIND} as interaction_type",
        "ts as interaction_datetime",
        f"{_STATUS} as callstatus",
        f"{_SECONDS} as call_duration",
        "ts as au_entryat",
    )


def interaction_feed(events: DataFrame) -> DataFrame:
    """The events as interactions reported by agents.

    Most come from the agent who owns the assignment; ``error`` events carry the
    agent named in the payload, who usually does not own it.
    """
    return events.selectExpr(
        "event_id",
        f"{_ASSIGNMENT} as assignno_pk",
        f"if(event_type = 'error', {_AGENT}, {_ASSIGNMENT} % 100) as empno",
        f"{_KIND} as interaction_type",
        "ts as calleddatetime",
        f"{_STATUS} as callstatus",
        "cast(null as string) as callstatus_text",
        "cast(null as timestamp_ntz) as followupdate",
        "if(event_type <> 'view', cast(event_id % 4 as int) + 1, null) as count_call",
        "cast(null as int) as count_message",
        f"{_SECONDS} as call_duration",
    )


def calls(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey as id",
        "o_orderkey % 100 as employee_id",
        "if(o_orderkey % 17 = 0, null, o_custkey % 23) as project_id",
        """case o_orderstatus when 'O' then 'pending' when 'F' then 'completed'
           when 'P' then 'in_progress' end as status""",
        "o_orderdate as created_at",
    )


def users(supplier: DataFrame) -> DataFrame:
    return employees(supplier).selectExpr(
        "empno_pk as id",
        "name",
        "emailidoffical as email",
        "role",
        "empstatus as status",
        "to_json(named_struct('handle', username)) as social_ids",
        "au_entryat as created_at",
    )


# view: (function, source tables)
VIEWS = {
    "projects": (projects, ["nation"]),
    "empteam": (empteam, ["region"]),
    "employees": (employees, ["supplier"]),
    "empteamdtl": (empteamdtl, ["supplier", "nation"]),
    "customer": (customer, ["customer"]),
    "custassignment": (custassignment, ["orders"]),
    "call_history": (call_history, ["events"]),
    "calls": (calls, ["orders"]),
    "users": (users, ["supplier"]),
}


def read_source(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def view(spark: SparkSession, path: str, name: str) -> DataFrame:
    build, sources = VIEWS[name]
    return build(*[read_source(spark, path, s) for s in sources])
