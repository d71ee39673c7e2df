"""Assignment listings, agents' worklists and interaction history.

Inner joins decide which assignments a listing shows, so they run on narrow rows
(keys and sort columns); full rows are fetched for the page only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.operators import (
    Order,
    attach,
    fetch_page,
    having,
    lookup,
    newest,
    owned_by,
    paginate,
    priority_order,
    sort_rows,
    text_search,
    time_range,
    where_equal,
)
from dialweave.sources.schema import TABLES
from dialweave.sources.tables import Tables

_KEY = "assignno_pk"
_LISTING_ORDER = [newest("assigndate")]
_PROJECT = {"projectname": "projectname", "projectcode": "projectcode"}


_CUSTOMER = {"custname": "custname", "custcode": "custcode", "custemail": "custemailid", "__project": "projectno_fk"}


def _listed(tables: Tables, empno, status, priority, total_mode: str, customer: dict[str, str]) -> DataFrame:
    """Narrow rows of a listing; the customer's columns come with the join that admits a row."""
    equal = {"empno_fk": empno, "callstatus": status, "callpriority": priority}
    rows = where_equal(tables["custassignment"], equal).select(_KEY, "assigndate", "custno_fk", "empno_fk")
    if total_mode == "base":
        return rows
    if total_mode != "joined":
        raise ValueError(f"unknown total_mode {total_mode!r}")
    rows = having(rows, "empno_fk", tables["employees"], "empno_pk", unique=True)
    return attach(rows, tables["customer"], "custno_fk", "custno_pk", customer, how="inner")


def assignments_matching(
    tables: Tables, empno=None, status=None, priority=None, total_mode: str = "joined"
) -> DataFrame:
    """The assignments a listing draws from, for ``page_info``.

    ``joined`` counts what is listed: rows whose customer and employee exist.
    ``base`` counts every assignment that meets the filters.
    """
    return _listed(tables, empno, status, priority, total_mode, {})


def assignments_listing(
    tables: Tables, empno=None, status=None, priority=None, page: int = 1, limit: int = 10, after=None
) -> DataFrame:
    found = _listed(tables, empno, status, priority, "joined", _CUSTOMER)
    found = paginate(found, _LISTING_ORDER, _KEY, page, limit, after)
    rows = fetch_page(tables["custassignment"], found, _KEY, limit)
    agent = {"employee_name": "name", "employee_code": "empcode"}
    rows = attach(rows, tables["employees"], "empno_fk", "empno_pk", agent)
    rows = attach(rows, tables["projects"], "__project", "projectno_pk", _PROJECT).drop("__project")
    return sort_rows(rows, _LISTING_ORDER, _KEY)


def _worklist_order(nulls_last: bool) -> list[Order]:
    return [
        priority_order("callpriority"),
        Order("calltargetdate", nulls_last=nulls_last),
        newest("assigndate"),
    ]


def _worklist(tables: Tables, agent, search, status, priority, project, start, end, customer) -> DataFrame:
    mine = owned_by(tables["custassignment"], "empno_fk", agent)
    mine = where_equal(mine, {"callstatus": status, "callpriority": priority})
    mine = time_range(mine, "calltargetdate", start, end)
    mine = mine.select(_KEY, "custno_fk", "callpriority", "calltargetdate", "assigndate")
    customers = text_search(tables["customer"], ["custname", "custmobilenumber"], search)
    customers = where_equal(customers, {"projectno_fk": project})
    return attach(mine, customers, "custno_fk", "custno_pk", customer, how="inner")


def worklist_matching(
    tables: Tables, agent, search=None, status=None, priority=None, project=None, start=None, end=None
) -> DataFrame:
    """An agent's assignments that meet the filters, as narrow rows for ``page_info``."""
    return _worklist(tables, agent, search, status, priority, project, start, end, {})


def agent_worklist(
    tables: Tables,
    agent,
    search=None,
    status=None,
    priority=None,
    project=None,
    start=None,
    end=None,
    page: int = 1,
    limit: int = 10,
    nulls_last: bool = False,
    after=None,
) -> DataFrame:
    """One page of an agent's work: by priority, target date, then newest assignment.

    Rows without a known priority or without a target date come first, as NULLs
    sort; ``nulls_last`` moves missing target dates to the end.
    """
    order = _worklist_order(nulls_last)
    customer = {**_CUSTOMER, "custaddress": "custaddress", "custremarks": "custremarks"}
    found = _worklist(tables, agent, search, status, priority, project, start, end, customer)
    found = paginate(found, order, _KEY, page, limit, after)
    rows = fetch_page(owned_by(tables["custassignment"], "empno_fk", agent), found, _KEY, limit)
    rows = attach(rows, tables["projects"], "__project", "projectno_pk", _PROJECT).drop("__project")
    return sort_rows(rows, order, _KEY)


def assignment_history(tables: Tables, ids=None) -> DataFrame:
    """Interactions of the given assignments, newest first; those of all come unsorted."""
    history = tables["call_history"].where(F.col("assignno_fk").isNotNull())
    history = history.select(*TABLES["call_history"].columns)
    if ids is None:
        history = having(history, "assignno_fk", tables["custassignment"], _KEY, unique=True)
    else:
        known, _ = lookup(tables["custassignment"].select(_KEY), _KEY, ids)
        history = lookup(history, "assignno_fk", ids)[0]
        history = having(history, "assignno_fk", known, _KEY, unique=True)
    agent = {"employee_name": "name", "employee_code": "empcode"}
    rows = attach(history, tables["employees"], "empno_fk", "empno_pk", agent)
    return rows if ids is None else sort_rows(rows, [newest("interaction_datetime")], "history_pk")


def assignment_check(tables: Tables, n: int | None = 10) -> DataFrame:
    """Preview of assignments with employee and customer; ``n=None`` shows all."""
    rows = tables["custassignment"].select(_KEY, "empno_fk", "custno_fk", "callstatus", "callpriority")
    rows = attach(rows, tables["employees"], "empno_fk", "empno_pk", {"employee_name": "name"}, how="inner")
    rows = attach(rows, tables["customer"], "custno_fk", "custno_pk", {"customer_name": "custname"}, how="inner")
    return sort_rows(rows, [], _KEY) if n is None else paginate(rows, [], _KEY, limit=n)


def employee_assignments(tables: Tables, employee) -> DataFrame:
    """All assignments of one employee with customer and project name."""
    rows = owned_by(tables["custassignment"], "empno_fk", employee)
    who = {"custname": "custname", "__project": "projectno_fk"}
    rows = attach(rows, tables["customer"], "custno_fk", "custno_pk", who, how="inner")
    rows = attach(rows, tables["projects"], "__project", "projectno_pk", {"projectname": "projectname"})
    return sort_rows(rows.drop("__project"), [], _KEY)
