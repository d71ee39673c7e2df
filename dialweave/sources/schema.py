"""Table registry: columns, types, defaults, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    on_delete: str  # "CASCADE" or "SET NULL"


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: dict[str, str]
    defaults: dict[str, object] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    references: tuple[ForeignKey, ...] = ()
    updatable: tuple[str, ...] = ()
    search: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    day_partition: tuple[str, str] | None = None
    clustered: tuple[str, ...] = ()

    @cached_property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[t]) for n, t in self.columns.items()])

    @property
    def audited(self) -> bool:
        return "au_updateat" in self.columns


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "time": T.TimestampNTZType(),
}


def _columns(text: str) -> dict[str, str]:
    return dict(part.split() for part in text.split(","))


# Table layouts, defaults, updatable and searched columns are the
# data contract of the system these tables come from.
_AUDIT = (
    "au_orgno long, au_entryempnoby long, au_entryat time, au_entrysession string, "
    "au_updateempnoby long, au_updateat time, au_udpatesession string"
)
_ENTRY_AUDIT = "au_orgno long, au_entryempnoby long, au_entryat time, au_entrysession string"

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "empteam",
            "teamno_pk",
            _columns(f"teamno_pk long, teamcode string, teamname string, teamremarks string, {_AUDIT}"),
            updatable=("teamcode", "teamname", "teamremarks", "au_orgno"),
            search=("teamname", "teamcode"),
        ),
        Table(
            "projects",
            "projectno_pk",
            _columns(
                "projectno_pk long, projectcode string, projectname string, projectdescription string, "
                f"projectstatus string, projectdefault_teamno_fk long, {_AUDIT}"
            ),
            defaults={"projectstatus": "OPEN"},
            references=(ForeignKey("projectdefault_teamno_fk", "empteam", "SET NULL"),),
            updatable=(
                "projectcode",
                "projectname",
                "projectdescription",
                "projectstatus",
                "projectdefault_teamno_fk",
                "au_orgno",
            ),
            search=("projectname", "projectcode"),
        ),
        Table(
            "employees",
            "empno_pk",
            _columns(
                "empno_pk long, empcode string, joindate time, name string, role string, capacity int, "
                "officialmobilenum string, personalmobilenum string, socialmediaidofficial string, "
                "emailidoffical string, address string, empremarks string, empstatus string, "
                "restricteddataprivilege string, app_userind string, username string, "
                f"assigned_project_id long, {_AUDIT}"
            ),
            defaults={
                "role": "AGENT",
                "capacity": 0,
                "empstatus": "Active",
                "restricteddataprivilege": "N",
            },
            unique=("emailidoffical", "username"),
            references=(ForeignKey("assigned_project_id", "projects", "SET NULL"),),
            updatable=(
                "empcode",
                "joindate",
                "name",
                "role",
                "capacity",
                "officialmobilenum",
                "personalmobilenum",
                "socialmediaidofficial",
                "emailidoffical",
                "address",
                "empremarks",
                "empstatus",
                "restricteddataprivilege",
                "app_userind",
                "username",
                "au_orgno",
                "assigned_project_id",
            ),
            search=("name", "emailidoffical", "username", "empcode"),
            hidden=("entrypass",),
        ),
        Table(
            "empteamdtl",
            "teamdtlno_pk",
            _columns(f"teamdtlno_pk long, teamno_fk long, empno_fk long, {_ENTRY_AUDIT}"),
            references=(
                ForeignKey("teamno_fk", "empteam", "CASCADE"),
                ForeignKey("empno_fk", "employees", "CASCADE"),
            ),
        ),
        Table(
            "customer",
            "custno_pk",
            _columns(
                "custno_pk long, custcode string, custname string, custmobilenumber string, "
                "custemailid string, custaddress string, custremarks string, custtype string, "
                f"projectno_fk long, {_AUDIT}"
            ),
            defaults={"custtype": "Undefined"},
            references=(ForeignKey("projectno_fk", "projects", "SET NULL"),),
            updatable=(
                "custcode",
                "projectno_fk",
                "custmobilenumber",
                "custemailid",
                "custname",
                "custaddress",
                "custremarks",
                "au_orgno",
            ),
            search=("custname", "custcode", "custmobilenumber", "custemailid"),
        ),
        Table(
            "custassignment",
            "assignno_pk",
            _columns(
                "assignno_pk long, assigndate time, calltargetdate time, custno_fk long, "
                "custmobilenumber string, empno_fk long, calleddatetime time, callpriority string, "
                "callstatus string, callstatus_text string, followupdate time, count_call int, "
                f"count_message int, {_AUDIT}"
            ),
            defaults={"callpriority": "Low", "callstatus": "Pending", "count_call": 0, "count_message": 0},
            references=(
                ForeignKey("custno_fk", "customer", "CASCADE"),
                ForeignKey("empno_fk", "employees", "CASCADE"),
            ),
            updatable=(
                "calltargetdate",
                "calleddatetime",
                "callpriority",
                "callstatus",
                "callstatus_text",
                "followupdate",
                "count_call",
                "count_message",
            ),
            clustered=("empno_fk", "calltargetdate"),  # an agent's worklist
        ),
        Table(
            "call_history",
            "history_pk",
            _columns(
                "history_pk long, assignno_fk long, custno_fk long, empno_fk long, "
                "interaction_type string, interaction_datetime time, callstatus string, "
                f"callstatus_text string, followupdate time, call_duration int, {_ENTRY_AUDIT}"
            ),
            defaults={"interaction_type": "call"},
            references=(
                ForeignKey("assignno_fk", "custassignment", "CASCADE"),
                ForeignKey("custno_fk", "customer", "CASCADE"),
                ForeignKey("empno_fk", "employees", "CASCADE"),
            ),
            day_partition=("interaction_day", "interaction_datetime"),
        ),
        Table(
            "calls",
            "id",
            _columns(
                "id long, employee_id long, project_id long, customer_name string, "
                "customer_phone string, customer_email string, status string, notes string, "
                "call_duration int, created_at time, updated_at time"
            ),
            defaults={"status": "pending"},
            references=(
                ForeignKey("employee_id", "employees", "SET NULL"),
                ForeignKey("project_id", "projects", "SET NULL"),
            ),
        ),
        Table(
            "users",
            "id",
            _columns(
                "id long, name string, email string, role string, capacity int, "
                "personal_numbers string, official_numbers string, social_ids string, address string, "
                "remarks string, status string, restricted_data_privilege boolean, "
                "created_at time, updated_at time"
            ),
            defaults={
                "role": "AGENT",
                "capacity": 0,
                "status": "active",
                "restricted_data_privilege": False,
            },
            unique=("email",),
            updatable=(
                "name",
                "email",
                "role",
                "capacity",
                "personal_numbers",
                "official_numbers",
                "social_ids",
                "address",
                "remarks",
                "status",
                "restricted_data_privilege",
            ),
            search=("name", "email"),
            hidden=("password_hash",),
        ),
    )
}

# The other delete rule found in circulation for the same references: keep the
# interaction rows and forget whom they pointed at.
SET_NULL_RULES = {
    ("custassignment", "empno_fk"): "SET NULL",
    ("call_history", "assignno_fk"): "SET NULL",
    ("call_history", "empno_fk"): "SET NULL",
}


def redact(df: DataFrame, table: Table) -> DataFrame:
    """Credential columns never enter the engine."""
    return df.drop(*table.hidden) if table.hidden else df


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns ``df`` lacks, with their defaults; columns it has stay as they are."""
    defaults = defaults or {}
    present = set(df.columns)
    missing = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in present
    }
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Exactly the registry's columns, in order and with the declared types."""
    return redact(df, table).to(table.struct)
