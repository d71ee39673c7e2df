"""Searchable, paged listings and their details by key.

``X_matching`` is the filtered set (feed it to ``page_info``); ``X_listing`` is
one page of it. Names from other tables are attached after the page is cut, since
those joins neither add nor drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dialweave.operators import (
    Order,
    attach,
    count_children,
    fenced_page,
    fences,
    indexed_search,
    lookup,
    newest,
    paginate,
    sort_rows,
    text_search,
    where_equal,
    write_postings,
)
from dialweave.operators.fences import EVERY, RANGES
from dialweave.sources.schema import TABLES
from dialweave.sources.tables import Tables


def _matching(tables: Tables, name: str, search, equal: dict[str, object], literal: bool, index=None) -> DataFrame:
    table = TABLES[name]
    if index is None:
        found = text_search(tables[name], list(table.search), search, literal)
    else:
        found = indexed_search(tables[name], table.key, list(table.search), search, index, literal)
    return where_equal(found, equal)


def write_search_index(tables: Tables, name: str, path: str, mode: str = "append") -> None:
    """Postings of a table's searched columns, for ``index`` of its listing."""
    write_postings(tables[name], TABLES[name].key, list(TABLES[name].search), path, mode)


# --- projects ---------------------------------------------------------------

_PROJECT_ORDER = [newest("au_entryat")]


def _project_columns(tables: Tables, rows: DataFrame) -> DataFrame:
    names = {"team_name": "teamname", "team_code": "teamcode"}
    rows = attach(rows, tables["empteam"], "projectdefault_teamno_fk", "teamno_pk", names)
    return count_children(rows, tables["calls"], "projectno_pk", "project_id", "call_count")


def projects_matching(tables: Tables, search=None, status=None, team=None, literal: bool = False) -> DataFrame:
    equal = {"projectstatus": status, "projectdefault_teamno_fk": team}
    return _matching(tables, "projects", search, equal, literal)


def projects_listing(
    tables: Tables, search=None, status=None, team=None, page: int = 1, limit: int = 10, after=None
) -> DataFrame:
    rows = projects_matching(tables, search, status, team)
    rows = paginate(rows, _PROJECT_ORDER, "projectno_pk", page, limit, after)
    return sort_rows(_project_columns(tables, rows), _PROJECT_ORDER, "projectno_pk")


def project_detail(tables: Tables, ids) -> DataFrame:
    found, _ = lookup(tables["projects"], "projectno_pk", ids)
    return _project_columns(tables, found)


# --- teams ------------------------------------------------------------------

_TEAM_ORDER = [newest("au_entryat")]


def teams_matching(tables: Tables, search=None, teamtype=None, literal: bool = False) -> DataFrame:
    """``teamtype`` and the team description apply where the table has them."""
    teams = tables["empteam"]
    extra = ["teamdescription"] if "teamdescription" in teams.columns else []
    found = text_search(teams, [*TABLES["empteam"].search, *extra], search, literal)
    return where_equal(found, {"teamtype": teamtype}) if "teamtype" in teams.columns else found


def teams_listing(
    tables: Tables, search=None, page: int = 1, limit: int = 10, after=None, teamtype=None
) -> DataFrame:
    """Teams with their member count, and their lead where the table names one."""
    rows = paginate(teams_matching(tables, search, teamtype), _TEAM_ORDER, "teamno_pk", page, limit, after)
    rows = count_children(rows, tables["empteamdtl"], "teamno_pk", "teamno_fk", "member_count")
    if "teamlead_empno_fk" in rows.columns:
        lead = {"teamlead_name": "name", "teamlead_email": "emailidoffical"}
        rows = attach(rows, tables["employees"], "teamlead_empno_fk", "empno_pk", lead)
    return sort_rows(rows, _TEAM_ORDER, "teamno_pk")


# --- customers --------------------------------------------------------------

_CUSTOMER_ORDER = [newest("au_entryat")]
_PROJECT_NAMES = {"project_name": "projectname", "project_code": "projectcode"}


def customers_matching(
    tables: Tables, search=None, project=None, custtype=None, literal: bool = False, index=None
) -> DataFrame:
    """``index`` is a postings table (see ``write_search_index``) that spares the search a scan."""
    return _matching(tables, "customer", search, {"projectno_fk": project, "custtype": custtype}, literal, index)


def customer_fences(tables: Tables, every: int = EVERY, ranges: int = RANGES) -> DataFrame:
    """Fences of the whole listing, for pages far behind the first."""
    return fences(tables["customer"], _CUSTOMER_ORDER, "custno_pk", every, ranges)


def customers_listing(
    tables: Tables,
    search=None,
    project=None,
    custtype=None,
    page: int = 1,
    limit: int = 10,
    after=None,
    literal: bool = False,
    index=None,
    fence=None,
) -> DataFrame:
    """``fence`` (see ``customer_fences``) counts the rows of the unfiltered listing."""
    if fence is not None and (search or project or custtype or after is not None):
        raise ValueError("fences belong to the listing without filters")
    rows = customers_matching(tables, search, project, custtype, literal, index)
    if fence is None:
        rows = paginate(rows, _CUSTOMER_ORDER, "custno_pk", page, limit, after)
    else:
        rows = fenced_page(rows, _CUSTOMER_ORDER, "custno_pk", fence, page, limit)
    rows = attach(rows, tables["projects"], "projectno_fk", "projectno_pk", _PROJECT_NAMES)
    return sort_rows(rows, _CUSTOMER_ORDER, "custno_pk")


def customer_detail(tables: Tables, ids) -> DataFrame:
    found, _ = lookup(tables["customer"], "custno_pk", ids)
    return attach(found, tables["projects"], "projectno_fk", "projectno_pk", _PROJECT_NAMES)


# --- employees and legacy users -----------------------------------------------


def employees_matching(tables: Tables, search=None, role=None, status=None, literal: bool = False) -> DataFrame:
    return _matching(tables, "employees", search, {"role": role, "empstatus": status}, literal)


def employees_listing(
    tables: Tables, search=None, role=None, status=None, page: int = 1, limit: int = 10, after=None
) -> DataFrame:
    rows = employees_matching(tables, search, role, status)
    if after is not None:
        after = (after[0], after[0]) if len(after) == 1 else after
    return paginate(rows, [Order("empno_pk", descending=True)], "empno_pk", page, limit, after)


def employee_detail(tables: Tables, ids) -> DataFrame:
    return lookup(tables["employees"], "empno_pk", ids)[0]


def users_matching(tables: Tables, search=None, role=None, status=None, literal: bool = False) -> DataFrame:
    return _matching(tables, "users", search, {"role": role, "status": status}, literal)


def users_listing(
    tables: Tables, search=None, role=None, status=None, page: int = 1, limit: int = 10, after=None
) -> DataFrame:
    rows = users_matching(tables, search, role, status)
    return paginate(rows, [newest("created_at")], "id", page, limit, after).select(*TABLES["users"].columns)


def user_detail(tables: Tables, ids) -> DataFrame:
    return lookup(tables["users"], "id", ids)[0].select(*TABLES["users"].columns)



# --- several at once ------------------------------------------------------------

_DETAILS = {
    "projects": ("projectno_pk", project_detail),
    "customer": ("custno_pk", customer_detail),
    "employees": ("empno_pk", employee_detail),
    "users": ("id", user_detail),
}


def details(tables: Tables, name: str, ids) -> tuple[DataFrame, DataFrame]:
    """The details of the rows asked for, and the ids that no row has, as they were given."""
    key, detail = _DETAILS[name]
    _, missing = lookup(tables[name].select(key), key, ids)
    return detail(tables, ids), missing
