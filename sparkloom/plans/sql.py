"""SQL text with limits: batches of statements, classes of queries, and requests with a mode and a form of result."""

from __future__ import annotations

import contextlib
import re
import threading
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.governance import Rejected, World
from sparkloom.sources.results import formatted


def statements(text: str) -> list[str]:
    """Statements between semicolons, where those in strings, quoted names and comments don't count."""
    out, at, i = [], 0, 0
    pattern = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.DOTALL)
    for m in pattern.finditer(text):
        if m[0] == ";":
            out.append(text[at : m.start()].strip())
            at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def query_class(text: str) -> str:
    """join, aggregate, window, metadata, write or scan, by the words of a statement."""
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text).lower()
    for name, words in (("metadata", r"^\s*(describe|desc|show)\b"), ("write", r"^\s*(insert|update|delete|create|drop)\b"), ("window", r"\bover\s*\("), ("join", r"\bjoin\b"), ("aggregate", r"\bgroup\s+by\b|\b(count|sum|avg|min|max)\s*\(")):
        if re.search(words, plain):
            return name
    return "scan"


@dataclass
class Request:
    """max_rows: more rows than these aren't brought to the caller; None brings all."""

    sql: str
    session: str = "default"
    mode: str = "exact"
    form: str = "full"
    rows: int = 1_000
    max_rows: int | None = 10_000
    max_seconds: float | None = None
    max_bytes: int | None = None
    fraction: float = 0.1


def run(spark: SparkSession, text: str) -> DataFrame:
    """Runs the statements of a text in order and returns the last one's result."""
    found = statements(text)
    if not found:
        raise ValueError("no statement")
    for s in found[:-1]:
        spark.sql(s).collect() if query_class(s) != "write" else spark.sql(s)
    return spark.sql(found[-1])


_views = threading.RLock()


@contextlib.contextmanager
def replaced(spark: SparkSession, frames: dict[str, DataFrame]) -> Iterator[None]:
    """While it lasts, names stand for other frames; what was analysed meanwhile keeps them. One at a time."""
    with _views:
        catalog = spark._jsparkSession.sessionState().catalog()
        before = {name: catalog.getRawTempView(name) for name in frames}
        try:
            for name, df in frames.items():
                df.createOrReplaceTempView(name)
            yield
        finally:
            for name, view in before.items():
                if view.isDefined():
                    catalog.createTempView(name, view.get(), True)
                else:
                    spark.catalog.dropTempView(name)


def _verbs(text: str) -> set[str]:
    """What statements do: their first words, where queries of all forms select."""
    verbs = {re.sub(r"--[^\n]*|/\*.*?\*/", " ", s, flags=re.DOTALL).split()[0].lower() for s in statements(text)}
    return {"select" if v in ("with", "from", "values", "table", "(") or v.startswith("(") else v for v in verbs}


def _allowed(spark: SparkSession, request: Request, world: World, role: str) -> tuple[Request, dict[str, DataFrame]]:
    """The request within the limits of a role, and the tables as the role may see them; or Rejected."""
    policy = world.policy(role)
    for verb in sorted(_verbs(request.sql)):
        world.allow(role, verb)
    if request.mode == "approx" and not policy.allow_approximate:
        raise Rejected(f"{role} may not read samples")
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", request.sql).lower()
    words = set(re.findall(r"\w+", plain))
    named = [n for n in world.tables if n.lower() in words]
    frames = {n: world.visible(role, n, spark.table(n)) for n in named}
    least = lambda *limits: min((x for x in limits if x is not None), default=None)
    limited = replace(request, max_rows=least(request.max_rows, policy.max_rows), max_seconds=least(request.max_seconds, policy.max_seconds), max_bytes=least(request.max_bytes, policy.max_bytes))
    return limited, frames


def scanned_bytes(df: DataFrame) -> int:
    """What the plan's tables hold, by the optimiser's figures."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def execute(spark: SparkSession, request: Request, view_samples: tuple[str, ...] = (), world: World | None = None, role: str | None = None):
    """A request's result in its form. approx: the views named are read as seeded samples of a fraction, for this
    request alone, and it is up to the reader to scale sums. max_seconds: the jobs of the request, of all its
    statements, are cancelled after that time. max_bytes: a plan over larger tables is rejected. With a world, a role's
    policy holds: its verbs and limits, its tables (any of the world's that the text names), and its columns."""
    if request.mode not in ("exact", "approx"):
        raise ValueError(f"no such mode: {request.mode}")
    frames: dict[str, DataFrame] = {}
    if world is not None:
        try:
            request, frames = _allowed(spark, request, world, role)
        except Rejected as why:
            world.note(role=role, sql=request.sql, refused=str(why))
            raise
    timer = None
    tag = f"request-{request.session}-{threading.get_ident()}"
    if request.max_seconds is not None:
        spark.sparkContext.addJobTag(tag)
        timer = threading.Timer(request.max_seconds, lambda: spark.sparkContext.cancelJobsWithTag(tag))
        timer.start()
    try:
        for name in view_samples if request.mode == "approx" else ():
            frames[name] = frames.get(name, spark.table(name)).sample(fraction=request.fraction, seed=11)
        with replaced(spark, frames):
            df = run(spark, request.sql)
        if request.max_bytes is not None and (held := scanned_bytes(df)) > request.max_bytes:
            raise Rejected(f"the plan scans {held} bytes, over the limit of {request.max_bytes}")
        df = df.limit(request.max_rows) if request.max_rows is not None else df
        found = formatted(df, request.form, request.rows)
        if world is not None:
            world.note(role=role, sql=request.sql, tables=sorted(frames))
        return found if isinstance(found, dict) else found.collect()
    finally:
        if timer:
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)
