"""Validation rules and the referential-integrity report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialweave.functions import falsy_null
from dialweave.operators.joins import lacking
from dialweave.sources.schema import TABLES
from dialweave.sources.tables import Tables


def filled(column: str) -> Column:
    return falsy_null(column).isNotNull()


def email_ok(column: Column | str) -> Column:
    """Something@domain.tld without blanks; simpler than a full address grammar."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), F.lit(False))


def long_enough(column: str, n: int) -> Column:
    return F.coalesce(F.length(column) >= n, F.lit(False))


def one_of(column: str, values: list[str]) -> Column:
    """Optional column: NULL passes."""
    return F.col(column).isNull() | F.col(column).isin(values)


# Accepted roles, and the rules each kind of row must meet.
ROLES = ["ADMIN", "MANAGER", "AGENT", "TRAINEE"]
REGISTRATION_ROLES = ["admin", "agent", "manager", "ADMIN", "AGENT", "MANAGER", "TRAINEE"]

RULES = {
    "projects": {"projectname": lambda: filled("projectname")},
    "empteam": {"teamname": lambda: filled("teamname")},
    "empteamdtl": {
        "teamno_fk": lambda: F.col("teamno_fk").isNotNull(),
        "empno_fk": lambda: F.col("empno_fk").isNotNull(),
    },
    "employees": {
        "name": lambda: filled("name"),
        "emailidoffical": lambda: email_ok("emailidoffical"),
        "username": lambda: filled("username"),
        "entrypass": lambda: long_enough("entrypass", 6),
    },
    "registrations": {
        "name": lambda: filled("name"),
        "emailidoffical": lambda: email_ok("emailidoffical"),
        "entrypass": lambda: long_enough("entrypass", 6),
        "role": lambda: one_of("role", REGISTRATION_ROLES),
    },
    "users": {
        "name": lambda: filled("name"),
        "email": lambda: email_ok("email"),
        "password": lambda: long_enough("password", 6),
        "role": lambda: one_of("role", ROLES),
    },
}


def rules_for(kind: str, columns: list[str]) -> dict[str, Column]:
    """The rules of a kind of row. Credentials are checked only where a batch has them."""
    credentials = {"entrypass", "password"} - set(columns)
    return {name: rule() for name, rule in RULES.get(kind, {}).items() if name not in credentials}


def failures(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the array of ``reasons``."""
    if not rules:
        return df, df.where(F.lit(False)).withColumn("reasons", F.array().cast("array<string>"))
    checked = df.withColumn("reasons", failures(rules))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def orphans(tables: Tables, names: list[str] | None = None) -> DataFrame:
    """Per reference: key values without a parent, and the rows holding each.

    Child rows are counted per key first, so each reference is one narrow scan and
    a join of distinct keys.
    """
    found = []
    for table in TABLES.values():
        if names is not None and table.name not in names:
            continue
        for ref in table.references:
            parent = tables[ref.parent].select(F.col(TABLES[ref.parent].key).alias("parent_key"))
            held = tables[table.name].where(F.col(ref.column).isNotNull())
            counts = held.groupBy(F.col(ref.column).alias("key")).agg(F.count("*").alias("n"))
            missing = lacking(counts, "key", parent, "parent_key", unique=True)
            found.append(
                missing.select(F.lit(table.name).alias("table"), F.lit(ref.column).alias("column"), "key", "n")
            )
    return reduce(DataFrame.unionByName, found)
