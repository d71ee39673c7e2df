"""Performance reports over the interaction history.

The date bounds select history rows *before* they meet agents or projects, so an
agent or project without activity in the range is still listed, with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.functions import ci_equal, ci_in, day_of
from dialweave.operators import (
    conditional_counts,
    lookup,
    newest,
    sort_rows,
    time_range,
    zero_fill,
)
from dialweave.sources.tables import Tables

# Roles that count as agents, and the status of a sale.
AGENT_ROLES = ["Agent", "Trainee"]
SALE = "Sales Generated"

#: Sketches of customers have 2 ^ SKETCH_BITS registers.
SKETCH_BITS = 12


def _history(tables: Tables, start, end, end_of_day: bool) -> DataFrame:
    return time_range(tables["call_history"], "interaction_datetime", start, end, end_of_day)


def _agent_measures() -> dict:
    return {
        "total_interactions": None,
        "total_calls": ci_equal("interaction_type", "call"),
        "total_sms": ci_equal("interaction_type", "sms"),
        "total_whatsapp": ci_equal("interaction_type", "whatsapp"),
        "sales_generated": ci_equal("callstatus", SALE),
    }


def agent_performance(tables: Tables, start=None, end=None, end_of_day: bool = False) -> DataFrame:
    """Interactions per active agent or trainee, by kind, with sales and customers reached."""
    per_agent = conditional_counts(
        _history(tables, start, end, end_of_day).where(F.col("empno_fk").isNotNull()),
        ["empno_fk"],
        _agent_measures(),
        {"unique_customers_contacted": (None, "custno_fk")},
    )
    return _of_agents(tables, per_agent)


def agent_days(tables: Tables, start=None, end=None) -> DataFrame:
    """A row for each agent and day: counts, and a sketch of the customers reached.

    Counts add up and sketches merge, so a stored table of these answers any range of
    days without the history, and a day's late rows may be appended as rows of their own.
    """
    history = _history(tables, start, end, True).where(F.col("empno_fk").isNotNull())
    counts = [
        (F.count("*") if p is None else F.count(F.when(p, 1))).alias(name) for name, p in _agent_measures().items()
    ]
    sketch = F.hll_sketch_agg("custno_fk", F.lit(SKETCH_BITS)).alias("customers")
    return history.groupBy("empno_fk", day_of("interaction_datetime").alias("date")).agg(*counts, sketch)


def agent_performance_by_days(tables: Tables, days: DataFrame, start=None, end=None) -> DataFrame:
    """``agent_performance`` over whole days, from ``agent_days``.

    All is exact but the customers reached, an estimate with a standard error of about
    1.04 / sqrt(2 ^ SKETCH_BITS), 1.6%.
    """
    if start is not None:
        days = days.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(str(end)).cast("date"))
    counts = [F.sum(name).alias(name) for name in _agent_measures()]
    reached = F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers_contacted")
    return _of_agents(tables, days.groupBy("empno_fk").agg(*counts, reached))


def _of_agents(tables: Tables, per_agent: DataFrame) -> DataFrame:
    measures = [c for c in per_agent.columns if c != "empno_fk"]
    agents = (
        tables["employees"]
        .where(ci_in("role", AGENT_ROLES) & ci_equal("empstatus", "Active"))
        .select("empno_pk", F.col("name").alias("agent_name"), "empcode")
    )
    rows = agents.join(per_agent, F.col("empno_pk") == F.col("empno_fk"), "left").drop("empno_fk")
    return sort_rows(zero_fill(rows, measures), [newest("total_interactions")], "empno_pk")


def project_performance(tables: Tables, start=None, end=None, end_of_day: bool = False) -> DataFrame:
    """Interactions and sales per project, through the project's customers.

    History shrinks to one row per customer before it is joined; that aggregate is
    already partitioned on the join key, so only the customer keys move.
    """
    measures = {"total_interactions": None, "sales_generated": ci_equal("callstatus", SALE)}
    per_customer = conditional_counts(
        _history(tables, start, end, end_of_day).where(F.col("custno_fk").isNotNull()), ["custno_fk"], measures
    )
    customers = tables["customer"].where(F.col("projectno_fk").isNotNull()).select("custno_pk", "projectno_fk")
    per_project = (
        per_customer.join(customers, F.col("custno_fk") == F.col("custno_pk"), "inner")
        .groupBy("projectno_fk")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    projects = tables["projects"].select("projectno_pk", "projectname", "projectcode")
    rows = projects.join(per_project, F.col("projectno_pk") == F.col("projectno_fk"), "left")
    rows = zero_fill(rows.drop("projectno_fk"), list(measures))
    return sort_rows(rows, [newest("total_interactions")], "projectno_pk")


def daily_counts(history: DataFrame) -> DataFrame:
    return conditional_counts(
        history,
        [day_of("interaction_datetime").alias("date")],
        {"total_interactions": None, "sales_generated": ci_equal("callstatus", SALE)},
    )


def daily_activity(tables: Tables, start=None, end=None, days: int = 30, end_of_day: bool = False) -> DataFrame:
    """Interactions and sales of the latest days that had any activity."""
    return daily_counts(_history(tables, start, end, end_of_day)).orderBy(F.desc("date")).limit(days)


def project_stats(tables: Tables, ids=None) -> DataFrame:
    """Call counts per requested project; all zeros where there is none.

    Call ids are unique, so only the employees need a distinct count.
    """
    projects = tables["projects"].select("projectno_pk")
    if ids is not None:
        known, missing = lookup(projects, "projectno_pk", ids)
    calls = tables["calls"].where(F.col("project_id").isNotNull())
    if ids is not None and not isinstance(ids, DataFrame):
        calls = calls.where(F.col("project_id").isin(list(ids)))
    per_project = conditional_counts(
        calls,
        ["project_id"],
        {
            "total_calls": None,
            "pending_calls": ci_equal("status", "pending"),
            "completed_calls": ci_equal("status", "completed"),
        },
        {"unique_employees": (None, "employee_id")},
    )
    measures = [c for c in per_project.columns if c != "project_id"]
    wanted = projects if ids is None else known
    rows = wanted.join(per_project, F.col("projectno_pk") == F.col("project_id"), "left").drop("project_id")
    if ids is not None:
        rows = rows.unionByName(missing, allowMissingColumns=True)
    return sort_rows(zero_fill(rows, measures), [], "projectno_pk")
