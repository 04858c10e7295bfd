"""What is known of tables and allowed with them: keys, join rules, filter rules, policies, lineage and an audit log.

A World is plain data and goes to and from JSON. Checks run on the driver before a DataFrame is built; they read
schemas and rules only, never rows.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("proposed", "approved", "blocked", "deprecated")
KINDS = ("inner", "left", "right", "full")


class Rejected(ValueError):
    """A request that the rules don't allow; the message names the rule."""


@dataclass
class Table:
    name: str
    columns: dict[str, str]
    primary_key: list[str] = field(default_factory=list)
    event_time: str | None = None
    description: str = ""
    version: int = 1


@dataclass
class JoinRule:
    left: str
    right: str
    left_key: str
    right_key: str
    kind: str = "inner"
    state: str = "proposed"
    confidence: float = 1.0
    why: str = "given"


@dataclass
class FilterRule:
    """A condition that holds for a table unless the user names its column."""

    table: str
    column: str
    op: str
    value: object
    why: str = ""


@dataclass
class Policy:
    """What a role may see and do. None allows all."""

    role: str
    tables: list[str] | None = None
    hidden_columns: dict[str, list[str]] = field(default_factory=dict)
    verbs: list[str] = field(default_factory=lambda: ["select"])
    max_rows: int | None = 10_000
    allow_approximate: bool = True
    max_seconds: float | None = None
    max_bytes: int | None = None


OPS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "like": lambda c, v: c.like(v),
    "between": lambda c, v: c.between(*v),
    "is_null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
}


class World:
    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.joins: list[JoinRule] = []
        self.filters: list[FilterRule] = []
        self.policies: dict[str, Policy] = {}
        self.lineage: list[dict] = []
        self.audit: list[dict] = []

    # --- tables ---
    def register(self, name: str, df: DataFrame, primary_key: list[str] | None = None, event_time: str | None = None, description: str = "") -> Table:
        """A table by its schema; a changed schema makes a new version."""
        columns = {f.name: f.dataType.simpleString() for f in df.schema}
        old = self.tables.get(name)
        version = 1 if old is None else old.version + (old.columns != columns)
        self.tables[name] = Table(name, columns, primary_key or (old.primary_key if old else []), event_time or (old.event_time if old else None), description or (old.description if old else ""), version)
        return self.tables[name]

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise Rejected(f"no such table: {name}")
        return self.tables[name]

    # --- joins ---
    def add_join(self, rule: JoinRule) -> JoinRule:
        for name, key in ((rule.left, rule.left_key), (rule.right, rule.right_key)):
            if key not in self.table(name).columns:
                raise Rejected(f"{name} has no column {key}")
        if rule.state not in STATES or rule.kind not in KINDS:
            raise Rejected(f"no such state or kind: {rule.state}, {rule.kind}")
        self.joins.append(rule)
        return rule

    def set_state(self, left: str, right: str, state: str) -> int:
        if state not in STATES:
            raise Rejected(f"no such state: {state}")
        found = [r for r in self.joins if {r.left, r.right} == {left, right}]
        for r in found:
            r.state = state
        return len(found)

    def infer_joins(self, least: float = 0.5) -> list[JoinRule]:
        """Proposals: a column named after another table and its key 0.8, equal names of a key 0.6, equal names else 0.3."""
        out = []
        known = {(r.left, r.left_key, r.right, r.right_key) for r in self.joins}
        for a in self.tables.values():
            for b in self.tables.values():
                if a.name == b.name:
                    continue
                stems = {b.name, b.name.removesuffix("s"), b.name.removesuffix("es")}
                for c in a.columns:
                    target = b.primary_key[0] if b.primary_key else "id" if "id" in b.columns else None
                    if target and c.lower() in {f"{s}_id".lower() for s in stems} and c != target:
                        score, key, why = 0.8, target, f"{c} is named after {b.name}"
                    elif c in b.columns and b.primary_key == [c] and a.primary_key != [c]:
                        score, key, why = 0.8, c, f"{c} is the key of {b.name}"
                    elif c in b.columns and a.name < b.name:
                        score, key, why = 0.3, c, "the same name"
                    else:
                        continue
                    if score >= least and (a.name, c, b.name, key) not in known and a.columns[c] == b.columns[key]:
                        out.append(JoinRule(a.name, b.name, c, key, "inner", "proposed", score, why))
        self.joins += out
        return out

    def approved(self, left: str, right: str, left_key: str, right_key: str, kind: str) -> JoinRule:
        """The approved rule for a join, in either direction; otherwise the join is rejected."""
        turned = {"left": "right", "right": "left"}
        for r in self.joins:
            same = (r.left, r.right, r.left_key, r.right_key, r.kind) == (left, right, left_key, right_key, kind)
            other = (r.right, r.left, r.right_key, r.left_key, turned.get(r.kind, r.kind)) == (left, right, left_key, right_key, kind)
            if (same or other) and r.state == "approved":
                return r
        raise Rejected(f"no approved rule for {kind} join {left}.{left_key} = {right}.{right_key}")

    def join(self, frames: dict[str, DataFrame], left: str, right: str, left_key: str, right_key: str, kind: str = "inner") -> DataFrame:
        """A join that the rules allow: tables and keys are there, types agree, and a rule is approved."""
        if not left_key or not right_key:
            raise Rejected("a join without keys")
        for name, key in ((left, left_key), (right, right_key)):
            if key not in self.table(name).columns:
                raise Rejected(f"{name} has no column {key}")
        if (a := self.tables[left].columns[left_key]) != (b := self.tables[right].columns[right_key]) and not {a, b} <= {"int", "bigint", "smallint", "tinyint"}:
            raise Rejected(f"types differ: {a} and {b}")
        self.approved(left, right, left_key, right_key, kind)
        return frames[left].join(frames[right], frames[left][left_key] == frames[right][right_key], kind)

    def path(self, start: str, end: str) -> list[JoinRule]:
        """The shortest chain of approved rules between two tables; ties by the order of rules."""
        seen, queue = {start: []}, deque([start])
        while queue:
            at = queue.popleft()
            if at == end:
                return seen[at]
            for r in self.joins:
                if r.state == "approved" and at in (r.left, r.right):
                    to = r.right if at == r.left else r.left
                    if to not in seen:
                        seen[to] = [*seen[at], r]
                        queue.append(to)
        raise Rejected(f"no approved way from {start} to {end}")

    # --- filters and policies ---
    def business_filters(self, tables: list[str], named: set[str]) -> list[FilterRule]:
        return [r for r in self.filters if r.table in tables and r.column not in named and str(r.value) not in named]

    def policy(self, role: str) -> Policy:
        if role not in self.policies:
            raise Rejected(f"no policy for {role}")
        return self.policies[role]

    def visible(self, role: str, name: str, df: DataFrame) -> DataFrame:
        """A table as a role may see it."""
        policy = self.policy(role)
        if policy.tables is not None and name not in policy.tables:
            raise Rejected(f"{role} may not read {name}")
        return df.drop(*policy.hidden_columns.get(name, []))

    def allow(self, role: str, verb: str) -> None:
        if verb not in self.policy(role).verbs:
            raise Rejected(f"{role} may not {verb}")

    # --- notes ---
    def note(self, **what) -> None:
        self.audit.append({"at": datetime.now(timezone.utc).isoformat(), **what})

    def derived(self, table: str, sources: list[str], how: str) -> None:
        self.lineage.append({"table": table, "sources": sources, "how": how})

    def flush(self, store, audit: str = "audit_log", lineage: str = "lineage_log") -> int:
        """Appends the notes and lineage held here to two tables of a store and forgets them; how many there were. Each is
        a time, where it has one, and its JSON."""
        noted = 0
        for name, held in ((audit, self.audit), (lineage, self.lineage)):
            if held:
                store.create(name, "at string, what string", if_not_exists=True)
                noted += store.insert(name, [(x.get("at"), json.dumps(x, default=str)) for x in held])
                held.clear()
        return noted

    def pack(self, role: str | None = None, frames: dict[str, DataFrame] | None = None, samples: int = 0) -> dict:
        """All of it for a planner: tables, rules, ways between tables, and samples of rows."""
        names = [n for n in self.tables if role is None or self.policy(role).tables is None or n in self.policy(role).tables]
        hide = self.policy(role).hidden_columns if role else {}
        ways = {}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                try:
                    ways[f"{a}-{b}"] = [asdict(r) for r in self.path(a, b)]
                except Rejected:
                    continue
        out = {"tables": {n: asdict(self.tables[n]) | {"columns": {c: t for c, t in self.tables[n].columns.items() if c not in hide.get(n, [])}} for n in names}, "joins": [asdict(r) for r in self.joins if {r.left, r.right} <= set(names)], "filters": [asdict(r) for r in self.filters if r.table in names], "paths": ways}
        if frames and samples:
            out["samples"] = {n: [r.asDict() for r in frames[n].drop(*hide.get(n, [])).limit(samples).collect()] for n in names if n in frames}
        return out

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()], "joins": [asdict(r) for r in self.joins], "filters": [asdict(r) for r in self.filters], "policies": [asdict(p) for p in self.policies.values()], "lineage": self.lineage, "audit": self.audit})

    @classmethod
    def from_json(cls, text: str) -> World:
        raw, out = json.loads(text), cls()
        out.tables = {t["name"]: Table(**t) for t in raw["tables"]}
        out.joins, out.filters = [JoinRule(**r) for r in raw["joins"]], [FilterRule(**r) for r in raw["filters"]]
        out.policies = {p["role"]: Policy(**p) for p in raw["policies"]}
        out.lineage, out.audit = raw["lineage"], raw["audit"]
        return out


def condition(op: str, column, value):
    """A filter as an expression on a column; values are literals and never become SQL text."""
    if op not in OPS:
        raise Rejected(f"no such operator: {op}")
    return OPS[op](column, value) if value is None or op in ("in", "between", "like") else OPS[op](column, F.lit(value))
