"""From a structured intent to a DataFrame: ground names, find a join path, apply rules, check, and build."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.governance import JoinRule, Rejected, World, condition

METRICS = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "distinct_count": F.count_distinct}
LEAST_CONFIDENCE, DEFAULT_LIMIT = 0.7, 10_000


@dataclass
class Metric:
    op: str
    column: str | None = None
    name: str | None = None


@dataclass
class Filter:
    column: str
    op: str
    value: object = None


@dataclass
class Intent:
    """What is asked for. Columns are plain or table.column; time is (column, window name)."""

    metrics: list[Metric] = field(default_factory=list)
    grain: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    time: tuple[str, str] | None = None
    sort: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    ambiguities: list[str] = field(default_factory=list)
    confidence: float = 1.0


@dataclass
class Plan:
    root: str
    joins: list[JoinRule]
    filters: list[tuple[str, str, str, object]]
    grain: list[tuple[str, str]]
    metrics: list[tuple[str, str, str | None, str]]
    columns: list[tuple[str, str]]
    time: tuple[str, str, str] | None
    sort: list[tuple[str, bool]]
    limit: int
    rules: list[str]


def _ground(world: World, name: str, preferred: list[str], allowed: set[str]) -> tuple[str, str]:
    """(table, column) of a name. Of several tables the one already in use; else it is ambiguous."""
    if "." in name:
        table, column = name.split(".", 1)
        if table in allowed and column in world.table(table).columns:
            return table, column
        raise Rejected(f"no such column: {name}")
    found = [t for t in world.tables if t in allowed and name in world.tables[t].columns]
    if not found:
        raise Rejected(f"no such column: {name}")
    used = [t for t in found if t in preferred]
    if len(found) > 1 and len(used) != 1:
        raise Rejected(f"{name} is in {', '.join(found)}")
    return (used or found)[0], name


def _names(intent: Intent) -> list[str]:
    named = [*intent.grain, *intent.columns, *(f.column for f in intent.filters), *(m.column for m in intent.metrics if m.column)]
    return [*named, *([intent.time[0]] if intent.time else [])]


def scores(world: World, intent: Intent) -> dict[str, int]:
    """How many of the intent's names each table has; metrics count twice, as they tell where the facts are."""
    metric = {m.column for m in intent.metrics}
    return {t: sum((1 + (n in metric)) for n in _names(intent) if n.split(".")[-1] in table.columns and n.split(".")[0] in (t, n)) for t, table in world.tables.items()}


def compile_intent(world: World, intent: Intent, role: str | None = None) -> Plan:
    """A checked plan; Rejected, with the reason, for an intent that is unclear, unknown or not allowed."""
    if intent.ambiguities or intent.confidence < LEAST_CONFIDENCE:
        raise Rejected(f"unclear: {'; '.join(intent.ambiguities) or f'confidence {intent.confidence}'}")
    policy = world.policy(role) if role else None
    allowed = {t for t in world.tables if not policy or policy.tables is None or t in policy.tables}
    ranked = scores(world, intent)
    preferred: list[str] = []
    for t in sorted(allowed, key=lambda t: (-ranked[t], t)):
        if ranked[t] and not preferred:
            preferred.append(t)
    if not preferred:
        raise Rejected("no table has any of these names")
    # names that only one table has decide first; the others then go to a table in use
    names = _names(intent)
    for n in names:
        owners = [t for t in allowed if n.split(".")[-1] in world.tables[t].columns and n.split(".")[0] in (t, n)]
        if len(owners) == 1 and owners[0] not in preferred:
            preferred.append(owners[0])
    at = {n: _ground(world, n, [t for t in preferred if t == preferred[0] or n.split(".")[-1] not in world.tables[preferred[0]].columns], allowed) for n in names}
    if policy:
        for t, c in at.values():
            if c in policy.hidden_columns.get(t, []):
                raise Rejected(f"{role} may not read {t}.{c}")
    root = preferred[0]
    joins: list[JoinRule] = []
    for t in dict.fromkeys(t for t, _ in at.values()):
        joins += [r for r in world.path(root, t) if r not in joins]
    tables = list(dict.fromkeys([root, *(t for r in joins for t in (r.left, r.right))]))
    if any(t not in allowed for t in tables):
        raise Rejected("the way between the tables leads over one that is not allowed")
    metrics = []
    for m in intent.metrics:
        if m.op not in METRICS:
            raise Rejected(f"no such metric: {m.op}")
        table, column = at[m.column] if m.column else (root, None)
        if m.op in ("sum", "avg") and column and world.tables[table].columns[column] not in ("int", "bigint", "double", "float", "smallint", "tinyint") and not world.tables[table].columns[column].startswith("decimal"):
            raise Rejected(f"{m.op} of {column}, which is no number")
        metrics.append((m.op, table, column, m.name or f"{m.op}_{column or 'rows'}"))
    business = world.business_filters(tables, {f.column.split(".")[-1] for f in intent.filters} | {str(f.value) for f in intent.filters})
    filters = [(*at[f.column], f.op, f.value) for f in intent.filters] + [(r.table, r.column, r.op, r.value) for r in business]
    for _, _, op, value in filters:
        condition(op, F.lit(0), value)
    shown = {c for _, c in (at[g] for g in intent.grain)} | {m[3] for m in metrics} | {at[c][1] for c in intent.columns}
    for name, _ in intent.sort:
        if name.split(".")[-1] not in shown:
            raise Rejected(f"sorted by {name}, which isn't in the result")
    most = policy.max_rows if policy and policy.max_rows else DEFAULT_LIMIT
    columns = [at[c] for c in intent.columns]
    if intent.columns and intent.metrics and not set(intent.columns) <= set(intent.grain):
        raise Rejected("columns beside metrics have to be in the grain")
    return Plan(root, joins, filters, [at[g] for g in intent.grain], metrics, columns, (*at[intent.time[0]], intent.time[1]) if intent.time else None, [(n.split(".")[-1], up) for n, up in intent.sort], min(intent.limit or most, most), [f"{r.table}.{r.column} {r.op} {r.value}" for r in business])


def window(column: Column, name: str, as_of: str) -> Column:
    """Times in a window before a given day: last_N_days, last_month, this_month, last_year, this_year, today, yesterday."""
    day = F.lit(as_of).cast("date")
    after = F.date_add(day, 1)
    if m := re.fullmatch(r"last_(\d+)_days", name):
        return (column >= F.date_sub(day, int(m[1]) - 1)) & (column < after)
    month, year = F.trunc(day, "month"), F.trunc(day, "year")
    limits = {
        "today": (day, after),
        "yesterday": (F.date_sub(day, 1), day),
        "this_month": (month, F.add_months(month, 1)),
        "last_month": (F.add_months(month, -1), month),
        "this_year": (year, F.add_months(year, 12)),
        "last_year": (F.add_months(year, -12), year),
    }
    if name not in limits:
        raise Rejected(f"no such window: {name}")
    low, high = limits[name]
    return (column >= low) & (column < high)


def build(plan: Plan, frames: dict[str, DataFrame], as_of: str | None = None) -> DataFrame:
    """The DataFrame of a plan. Columns are addressed by table, so equal names in two tables don't clash."""
    named = {t: frames[t].select(*[F.col(c).alias(f"{t}.{c}") for c in frames[t].columns]) for t in {plan.root, *(x for r in plan.joins for x in (r.left, r.right))}}
    col = lambda t, c: F.col(f"`{t}.{c}`")
    # Conditions hold for a table's rows before they are joined, so a row of the other side stays without a partner.
    for t, c, op, value in plan.filters:
        named[t] = named[t].filter(condition(op, col(t, c), value))
    if plan.time:
        if as_of is None:
            raise Rejected("a time window needs the day that it counts from")
        t, c, name = plan.time
        named[t] = named[t].filter(window(col(t, c), name, as_of))
    df, there, left = named[plan.root], {plan.root}, list(plan.joins)
    while left:
        rule = next(r for r in left if r.left in there or r.right in there)
        left.remove(rule)
        new, kind = (rule.right, rule.kind) if rule.left in there else (rule.left, {"left": "right", "right": "left"}.get(rule.kind, rule.kind))
        on = col(rule.left, rule.left_key) == col(rule.right, rule.right_key)
        df = df.filter(on) if new in there else df.join(named[new], on, kind)
        there.add(new)
    keys = [col(t, c).alias(c) for t, c in plan.grain]
    if plan.metrics:
        df = df.groupBy(*keys).agg(*[METRICS[op](col(t, c) if c else F.lit(1)).alias(name) for op, t, c, name in plan.metrics])
    elif keys or plan.columns:
        df = df.select(*keys, *[col(t, c).alias(c) for t, c in plan.columns if (t, c) not in plan.grain])
        df = df.distinct() if plan.grain and not plan.columns else df
    if plan.sort:
        df = df.orderBy(*[F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in plan.sort])
    return df.limit(plan.limit)


def answer(world: World, frames: dict[str, DataFrame], intent: Intent, role: str | None = None, as_of: str | None = None) -> DataFrame:
    """Compiles and builds, and notes it in the audit log, refusals too."""
    try:
        plan = compile_intent(world, intent, role)
        df = build(plan, frames, as_of)
    except Rejected as why:
        world.note(role=role, refused=str(why))
        raise
    world.note(role=role, tables=[plan.root, *(t for r in plan.joins for t in (r.left, r.right))], rules=plan.rules, limit=plan.limit)
    return df
