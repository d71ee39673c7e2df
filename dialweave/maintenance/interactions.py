"""Assigning customers to agents, and applying what agents report back."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.functions import falsy_default, falsy_null, pinned, run_time
from dialweave.maintenance.changes import (
    Change,
    last_key,
    number_rows,
    positioned,
    stamp_entry,
    update_stamps,
    with_reason,
)
from dialweave.operators.joins import attach
from dialweave.operators.sketches import is_small, narrowed, parted, together
from dialweave.sources.schema import TABLES, conform
from dialweave.sources.tables import Tables

_ASSIGNMENTS = TABLES["custassignment"]
_HISTORY = TABLES["call_history"]

# Assignment columns an interaction may set; NULL in the event keeps the old value.
REPORTED = ["calleddatetime", "callstatus", "callstatus_text", "followupdate", "count_call", "count_message"]


class Applied:
    """Outcome of a feed: ``assignments``, ``rejects``, and the log.

    ``delta`` (the new history rows) and ``history`` (the whole log) number the rows on
    first use, which runs a job.
    """

    def __init__(self, assignments: DataFrame, rejects: DataFrame, accepted: DataFrame, logged: DataFrame, run_ts):
        self.assignments = assignments
        self.rejects = rejects
        self._accepted = accepted
        self._logged = logged
        self._run_ts = run_ts

    @cached_property
    def delta(self) -> DataFrame:
        return history_rows(self._accepted, last_key(self._logged, "history_pk"), self._run_ts)

    @cached_property
    def history(self) -> DataFrame:
        return self._logged.unionByName(self.delta)


def split_by_owner(events: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events from the assignment's own agent, with the customer; and all others."""
    owners = assignments.where(F.col("empno_fk").isNotNull()).select(
        F.col("assignno_pk").alias("__assignment"), F.col("empno_fk").alias("__owner"), "custno_fk"
    )
    own = (F.col("assignno_pk") == F.col("__assignment")) & (F.col("empno") == F.col("__owner"))
    accepted = events.join(owners, own, "inner").drop("__assignment", "__owner")
    return accepted, events.join(owners, own, "left_anti")


def fold_events(events: DataFrame, order_by: list[str]) -> DataFrame:
    """Per assignment, agent and column, the last value reported.

    NULLs are skipped, since only rows with a value take part in the maximum. Partial
    aggregation folds the events of a hot assignment before anything is shuffled.
    """
    place = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in REPORTED]
    applied = [F.max("applied_at").alias("applied_at")] if "applied_at" in events.columns else []
    return events.groupBy("assignno_pk", "empno").agg(*last, *applied)


def merge_folded(base: DataFrame, folded: DataFrame, run_ts=None, small: bool = False) -> DataFrame:
    """Assignments with the folded values of their own agent; the others stay as they are.

    Joining on assignment and agent is the ownership check. Changes are stamped with
    their own ``applied_at`` where they have one. With few changes (``small``) the
    assignments that none of them can name are passed on without a shuffle.
    """
    side = folded.select(*[F.col(c).alias(f"__{c}") for c in folded.columns])
    own = (F.col("assignno_pk") == F.col("__assignno_pk")) & (F.col("empno_fk") == F.col("__empno"))
    met, rest = parted(base, [("assignno_pk", folded, "assignno_pk")], small)
    joined = met.join(side, own, "left")
    touched = F.col("__assignno_pk").isNotNull()
    values = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in REPORTED}
    when = F.col("__applied_at") if "applied_at" in folded.columns else run_ts
    stamps = update_stamps(_ASSIGNMENTS, when, F.col("__empno"))
    values.update({c: F.when(touched, v).otherwise(F.col(c)) for c, v in stamps.items()})
    return together(joined.withColumns(values).select(*base.columns), rest)


def history_rows(accepted: DataFrame, start, run_ts) -> DataFrame:
    """One history row per accepted event, numbered in order of arrival."""
    logged = accepted.select(
        "event_id",
        F.col("assignno_pk").alias("assignno_fk"),
        "custno_fk",
        F.col("empno").alias("empno_fk"),
        falsy_default("interaction_type", _HISTORY.defaults["interaction_type"]).alias("interaction_type"),
        F.coalesce("calleddatetime", run_time(run_ts)).alias("interaction_datetime"),
        "callstatus",
        "callstatus_text",
        "followupdate",
        "call_duration",
    )
    numbered = number_rows(positioned(logged, ["event_id"]), "history_pk", start, complete=True)
    return conform(stamp_entry(numbered, _HISTORY, run_ts, F.col("empno_fk")), _HISTORY)


def apply_interactions(
    tables: Tables, events: DataFrame, run_ts=None, order_by: list[str] | None = None, small: bool | None = None
) -> Applied:
    """Apply reported interactions to assignments and log each one.

    An event counts only if its agent owns the assignment. Several events on one
    assignment are folded in ``order_by`` order; the default is the order of arrival
    (``event_id``). Pass ``["calleddatetime", "event_id"]`` to go by call time, with
    the run's time for events that have none. ``small`` as in ``ingest``.
    """
    order_by = order_by or ["event_id"]
    run_ts = pinned(run_ts)
    base = conform(tables["custassignment"], _ASSIGNMENTS)
    history = conform(tables["call_history"], _HISTORY)
    small = is_small(events, small)
    accepted, refused = split_by_owner(events, narrowed(base, "assignno_pk", events, "assignno_pk", small))

    timed = events
    if "calleddatetime" in order_by:
        timed = events.withColumn("__called", F.coalesce("calleddatetime", run_time(run_ts)))
        order_by = ["__called" if c == "calleddatetime" else c for c in order_by]
    assignments = merge_folded(base, fold_events(timed, order_by), run_ts, small)
    rejects = with_reason(refused, "assignment not owned by this agent")
    return Applied(assignments, rejects, accepted, history, run_ts)


def bulk_assign(tables: Tables, batch: DataFrame, run_ts=None, small: bool | None = None) -> Change:
    """Assign customers to agents: (custno, empno, calltargetdate, callpriority, assigned_by).

    The customer's mobile number is copied into the assignment. Rows naming an
    unknown customer or employee are rejected. ``small`` as in ``ingest``.
    """
    run_ts = pinned(run_ts)
    small = is_small(batch, small)
    base = conform(tables["custassignment"], _ASSIGNMENTS)
    phone = {"__customer": "custno_pk", "custmobilenumber": "custmobilenumber"}
    customers = narrowed(tables["customer"], "custno_pk", batch, "custno", small)
    employees = narrowed(tables["employees"], "empno_pk", batch, "empno", small)
    rows = attach(batch, customers, "custno", "custno_pk", phone)
    rows = attach(rows, employees, "empno", "empno_pk", {"__employee": "empno_pk"})
    reasons = F.array_compact(
        F.array(
            F.when(F.col("__customer").isNull(), F.lit("customer not found")),
            F.when(F.col("__employee").isNull(), F.lit("employee not found")),
        )
    )
    rows = rows.withColumn("reasons", reasons)
    good = rows.where(F.size("reasons") == 0).select(
        F.col("custno").alias("custno_fk"),
        F.col("empno").alias("empno_fk"),
        falsy_null("custmobilenumber").alias("custmobilenumber"),
        "calltargetdate",
        run_time(run_ts).alias("assigndate"),
        falsy_default("callpriority", _ASSIGNMENTS.defaults["callpriority"]).alias("callpriority"),
        F.lit(_ASSIGNMENTS.defaults["callstatus"]).alias("callstatus"),
        F.lit(0).alias("count_call"),
        F.lit(0).alias("count_message"),
        "assigned_by",
    )
    good = positioned(good, ["custno_fk", "empno_fk"])
    numbered = number_rows(good, "assignno_pk", last_key(base, "assignno_pk"), complete=True)
    delta = conform(stamp_entry(numbered, _ASSIGNMENTS, run_ts, F.col("assigned_by")), _ASSIGNMENTS)
    rejects = rows.where(F.size("reasons") > 0).select(*batch.columns, "reasons")
    return Change(base.unionByName(delta), rejects, delta)
