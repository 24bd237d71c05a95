"""Table schemas derived from the registry, their differences, and migrations between them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.extract import LOOKUP_SCHEMAS, column_fields
from .registry import Registry

FIXED = "id string not null, versionId string not null, content string not null, lastUpdated string not null, deleted int not null, _source string, _profile array<string>, ___tag array<string>, ___tagSort string, ___security array<string>, ___securitySort string"
HISTORY = "versionSeq bigint not null, id string not null, versionId string not null, content string not null, lastUpdated string not null, deleted int not null"
REFERENCES = "resourceId string not null, targetType string not null, targetId string not null, code string not null, referenceRaw string"


@dataclass(frozen=True)
class TableSet:
    resource_type: str
    main: T.StructType
    history: T.StructType
    references: T.StructType
    expressions: dict[str, str] = field(default_factory=dict)

    def ddl(self) -> dict[str, str]:
        tables = {self.resource_type: self.main, f"{self.resource_type}_History": self.history, f"{self.resource_type}_References": self.references}
        return {name: f"CREATE TABLE IF NOT EXISTS `{name}` ({ddl(s)}) USING parquet" for name, s in tables.items()}


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)


def table_set(resource_type: str, registry: Registry, abstract: frozenset[str] = frozenset({"Resource", "DomainResource"})) -> TableSet:
    if resource_type in abstract or resource_type not in registry.types():
        raise ValueError(f"{resource_type} has no tables")
    parse = T._parse_datatype_string
    fields = list(parse(FIXED).fields)
    if resource_type != "Binary":
        fields.append(T.StructField("compartments", T.ArrayType(T.StringType())))
    params = registry.params(resource_type)
    fields += [f for p in params for f in column_fields(p)]
    return TableSet(resource_type, T.StructType(fields), parse(HISTORY), parse(REFERENCES), {p.code: p.expression for p in params})


def lookup_tables() -> dict[str, T.StructType]:
    return {t: T.StructType([T.StructField(c, T.StringType()) for c in ("resourceId", "resourceType", *columns)]) for t, columns in LOOKUP_SCHEMAS.items()}


def schema_ddl(registry: Registry) -> dict[str, str]:
    """DDL of the whole schema by table: those of each type, then the lookup tables that all share."""
    out: dict[str, str] = {}
    for t in registry.types():
        out |= table_set(t, registry).ddl()
    return out | {name: f"CREATE TABLE IF NOT EXISTS `{name}` ({ddl(s)}) USING parquet" for name, s in lookup_tables().items()}


def snapshot(registry: Registry) -> dict:
    """The whole schema as plain data: what is kept beside the tables."""
    sets = [table_set(t, registry) for t in registry.types()]
    return {s.resource_type: {"columns": {f.name: f.dataType.simpleString() for f in s.main}, "expressions": dict(sorted(s.expressions.items()))} for s in sets}


def checksum(snap: dict) -> str:
    return hashlib.sha256(json.dumps(snap, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Delta:
    kind: str  # ADD_TABLE, DROP_TABLE, ADD_COLUMN, DROP_COLUMN, ALTER_COLUMN, REINDEX
    table: str
    column: str | None = None
    type: str | None = None
    before: str | None = None


def compare(old: dict, new: dict) -> list[Delta]:
    """What turns one snapshot into another. New and changed expressions both need a reindex."""
    out = [Delta("ADD_TABLE", t) for t in sorted(new.keys() - old.keys())] + [Delta("DROP_TABLE", t) for t in sorted(old.keys() - new.keys())]
    for t in sorted(old.keys() & new.keys()):
        a, b = old[t]["columns"], new[t]["columns"]
        out += [Delta("ADD_COLUMN", t, c, b[c]) for c in b if c not in a]
        out += [Delta("DROP_COLUMN", t, c, before=a[c]) for c in a if c not in b]
        out += [Delta("ALTER_COLUMN", t, c, b[c], a[c]) for c in b if c in a and a[c] != b[c]]
        x, y = old[t]["expressions"], new[t]["expressions"]
        if any(x.get(code) != e for code, e in y.items()):
            out.append(Delta("REINDEX", t))
    return out


def migrate(rows: DataFrame, deltas: list[Delta], table: str, *, back: bool = False) -> DataFrame:
    """A table with the deltas of its columns applied, or undone."""
    for d in deltas if not back else reversed(deltas):
        if d.table != table or d.column is None:
            continue
        adds = d.kind == ("DROP_COLUMN" if back else "ADD_COLUMN")
        if adds:
            rows = rows.withColumn(d.column, F.lit(None).cast(d.before if back else d.type))
        elif d.kind == "ALTER_COLUMN":
            rows = rows.withColumn(d.column, converted(F.col(d.column), d.type if back else d.before, d.before if back else d.type))
        elif d.kind in ("ADD_COLUMN", "DROP_COLUMN"):
            rows = rows.drop(d.column)
    return rows


@dataclass(frozen=True)
class Plan:
    """A migration from one snapshot to another: its deltas, and the tables to index anew afterwards."""

    deltas: list[Delta]
    reindex: list[str]

    def up(self, rows: DataFrame, table: str) -> DataFrame:
        return migrate(rows, self.deltas, table)

    def down(self, rows: DataFrame, table: str) -> DataFrame:
        return migrate(rows, self.deltas, table, back=True)


def plan(old: dict, new: dict) -> Plan:
    deltas = compare(old, new)
    return Plan(deltas, [d.table for d in deltas if d.kind == "REINDEX"])


def converted(c: Column, before: str, after: str) -> Column:
    """A cast that also turns a value into an array of it, and an array into its first value."""
    if after.startswith("array<") and not before.startswith("array<"):
        return F.when(c.isNotNull(), F.array(c.cast(after[6:-1])))
    return F.try_element_at(c, F.lit(1)).cast(after) if before.startswith("array<") and not after.startswith("array<") else c.cast(after)


@dataclass
class Version:
    number: int
    name: str
    checksum: str
    applied: bool = True
    deltas: list[dict] = field(default_factory=list)


class Packages:
    """The packages whose definitions made the schema: at each start a package is new, changed or consistent.

    With a state (something that loads and saves a JSON value) they, the schema versions and the reindex jobs outlive the driver: each change is
    saved at once, and a job that was running when a driver was lost is pending again.
    """

    def __init__(self, state=None) -> None:
        self.state = state
        kept = (state.load() if state else None) or {"rows": [], "versions": [], "jobs": []}
        self.rows: list[dict] = kept["rows"]
        self.versions = [Version(**v) for v in kept["versions"]]
        self.jobs: list[dict] = [j | {"status": "pending"} if j["status"] == "running" else j for j in kept["jobs"]]

    def _save(self) -> None:
        if self.state:
            self.state.save({"rows": self.rows, "versions": [asdict(v) for v in self.versions], "jobs": self.jobs})

    def active(self, name: str) -> dict | None:
        return next((r for r in self.rows if r["name"] == name and r["status"] == "active"), None)

    def status(self, name: str, snap: dict) -> str:
        row = self.active(name)
        return "new" if row is None else "consistent" if row["checksum"] == checksum(snap) else "upgrade"

    def initialize(self, name: str, version: str, snap: dict) -> tuple[str, list[Delta]]:
        """Registers a package; on change, its deltas, a schema version, and a reindex job for each table that needs it."""
        status, row = self.status(name, snap), self.active(name)
        if status == "consistent":
            return status, []
        deltas = compare(row["snapshot"] if row else {}, snap)
        if row:
            row["status"] = "superseded"
        self.rows.append({"name": name, "version": version, "checksum": checksum(snap), "snapshot": snap, "status": "active"})
        self.versions.append(Version(max((v.number for v in self.versions), default=0) + 1, f"{name}@{version}", checksum(snap), True, [asdict(d) for d in deltas]))
        for d in deltas:
            if d.kind == "REINDEX":
                self._schedule(d.table)
        self._save()  # the package and its jobs at once
        return status, deltas

    def _schedule(self, table: str) -> dict:
        job = {"id": len(self.jobs) + 1, "table": table, "status": "pending", "processed": 0}
        self.jobs.append(job)
        return job

    def schedule(self, table: str) -> dict:
        job = self._schedule(table)
        self._save()
        return job

    def run_jobs(self, reindex) -> None:
        """reindex(table) -> number of resources."""
        for job in self.jobs:
            if job["status"] != "pending":
                continue
            job["status"] = "running"
            self._save()
            try:
                job |= {"processed": reindex(job["table"]), "status": "completed"}
            except Exception as e:
                job |= {"status": "failed", "error": str(e)}
            self._save()

    def job_counts(self) -> dict[str, int]:
        return {s: sum(j["status"] == s for j in self.jobs) for s in ("pending", "running", "completed", "failed")}


class Migrations:
    """Numbered migrations, each (number, name, up, down); applied in order, undone in reverse.

    With a state (see Packages) each is noted as soon as it is done; one that raises is not.
    """

    def __init__(self, steps, state=None):
        self.steps, self.state = sorted(steps, key=lambda s: s[0]), state
        self.done = [tuple(d) for d in (state.load() if state else None) or []]

    def _save(self) -> None:
        if self.state:
            self.state.save(self.done)

    def up(self, state):
        for number, name, forward, _ in self.steps:
            if number not in [d[0] for d in self.done]:
                state = forward(state)
                self.done.append((number, name))
                self._save()
        return state

    def down(self, state, to: int = 0):
        by = {s[0]: s for s in self.steps}
        while self.done and self.done[-1][0] > to:
            state = by[self.done[-1][0]][3](state)
            self.done.pop()
            self._save()
        return state

    def status(self) -> dict:
        applied = [d[0] for d in self.done]
        return {"current": applied[-1] if applied else 0, "applied": applied, "pending": [s[0] for s in self.steps if s[0] not in applied]}


#: Types of the platform itself, with their search parameters: fixed values.
PLATFORM = {
    "User": [("user-email", "token", "User.contact.value"), ("display-name", "string", "User.displayName"), ("active", "token", "User.active")],
    "Bot": [("display-name", "string", "Bot.displayName"), ("identifier", "token", "Bot.identifier"), ("status", "token", "Bot.status")],
    "Project": [("display-name", "string", "Project.displayName"), ("identifier", "token", "Project.identifier"), ("active", "token", "Project.active")],
    "Agent": [("display-name", "string", "Agent.displayName"), ("status", "token", "Agent.status"), ("identifier", "token", "Agent.identifier")],
    "ClientApplication": [("display-name", "string", "ClientApplication.displayName"), ("identifier", "token", "ClientApplication.identifier"), ("status", "token", "ClientApplication.status")],
}


def load_platform(registry: Registry) -> Registry:
    for kind, params in PLATFORM.items():
        for code, type, expression in params:
            registry.define(code, type, [kind], expression)
    return registry
