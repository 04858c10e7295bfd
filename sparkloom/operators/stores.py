"""Queries over sources, stored tables, rules, requests and streams: each does its work and returns rows that SQL states."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table, views
from sparkloom.plans import sql
from sparkloom.plans.governance import OPS, JoinRule, Policy, Rejected, World, condition
from sparkloom.plans.intent import Filter, Intent, Metric, answer, compile_intent
from sparkloom.session import scratch_dir
from sparkloom.sources import connectors, files, ingest, results
from sparkloom.sources.store import TableStore
from sparkloom.streaming import events as streams

_RECORDS = [{"id": i, "name": f"n{i}", "items": [{"q": i * 10 + j} for j in range(i % 3)]} for i in range(7)]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def load_csv(spark, sf):
    path = scratch_dir(spark)
    files.write_csv(table(spark, sf, "nation"), path)
    return files.read_csv(spark, path, table(spark, sf, "nation").schema).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_regionkey, r_name FROM region")
def load_json(spark, sf):
    path = scratch_dir(spark)
    table(spark, sf, "region").write.json(path)
    return files.read_json(spark, path, "r_regionkey int, r_name string")


@query("SELECT k, v FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)")
def load_rows(spark, sf):
    return files.from_rows(spark, [(1, "a"), (2, None)], "k int, v string")


@query("SELECT id, name FROM (VALUES (1::BIGINT, 'x'), (2, NULL), (NULL, 'z')) t(id, name)")
def load_connector(spark, sf):
    """JSON objects pulled in batches; fields that a record lacks are null."""
    batches = connectors.JsonConnector('[{"id": 1, "name": "x"}, {"id": 2}, {"name": "z"}]', 3).batches()
    return connectors.payload_frame(spark, [p for b in batches for p in b.payloads]).select("id", "name")


@query("SELECT t_id, _pos, q FROM (VALUES (1::BIGINT, 0, 10::BIGINT), (2, 0, 20), (2, 1, 21), (4, 0, 40), (5, 0, 50), (5, 1, 51)) t(t_id, _pos, q)")
def ingest_run(spark, sf):
    """Fetched three records at a time, flattened and stored; here the child table."""
    loader = ingest.Ingestion(TableStore(spark, scratch_dir(spark)))
    loader.ingest(connectors.JsonConnector(_RECORDS, 3), "t")
    return loader.store.read("t__items").select("t_id", "_pos", "q")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def scan_partitions(spark, sf):
    """Written by partitions and codec; the filter reads the directories of its two values."""
    path = scratch_dir(spark)
    files.write_parquet(table(spark, sf, "customer"), path, partition_by=["c_mktsegment"], codec="zstd")
    return files.read_parquet(spark, path).filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def scan_sorted(spark, sf):
    """Written in the order of a key, so that a range of it reads the row groups that hold it."""
    path = scratch_dir(spark)
    files.write_parquet(table(spark, sf, "orders"), path, sort_by=["o_orderkey"])
    return files.read_parquet(spark, path, ["o_orderkey", "o_totalprice"]).filter(F.col("o_orderkey").between(100, 200))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def stream_arrow(spark, sf):
    """A result as Arrow batches, made a table again."""
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return spark.createDataFrame(pa.Table.from_batches(list(files.arrow_stream(df, 7))))


@query("SELECT r_regionkey, r_name FROM region")
def stream_json(spark, sf):
    """A result as chunks of JSON, made a table again."""
    texts = [(t,) for chunk in files.json_chunks(table(spark, sf, "region"), 2) for t in chunk]
    return spark.createDataFrame(texts, "v string").select(F.from_json("v", "r_regionkey int, r_name string").alias("r")).select("r.*")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS known FROM (SELECT 1 FROM orders LIMIT 5)")
def result_representative(spark, sf):
    """How many rows stand for a table, and whether all are its own."""
    orders = table(spark, sf, "orders")
    found = results.formatted(orders, "representative", 5, "o_totalprice")
    return found.agg(F.count("*").alias("rows")).select("rows", F.lit(found.join(orders, orders.columns, "left_anti").isEmpty()).alias("known"))


def _stored(spark, sf):
    store = TableStore(spark, scratch_dir(spark))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    store.create("nation", nations.schema)
    store.insert("nation", nations.filter("n_regionkey < 3"))
    return store, nations


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 99, 'ATLANTIS', NULL")
def store_insert(spark, sf):
    """Rows of a query, and given ones without a column."""
    store, nations = _stored(spark, sf)
    store.insert("nation", nations.filter("n_regionkey > 3"))
    store.insert("nation", spark.createDataFrame([(99, "ATLANTIS")], "n_nationkey int, n_name string"))
    return store.read("nation")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def store_update(spark, sf):
    store, _ = _stored(spark, sf)
    store.update("nation", {"n_name": F.concat(F.upper("n_name"), F.lit("!"))}, F.col("n_regionkey") == 1)
    return store.read("nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3 AND n_regionkey <> 2")
def store_delete(spark, sf):
    store, _ = _stored(spark, sf)
    store.delete("nation", F.col("n_regionkey") == 2)
    return store.read("nation")


@query("SELECT * FROM (VALUES ('k', 'bigint'), ('v', 'string')) t(name, type)")
def store_describe(spark, sf):
    """Created, dropped and created anew, the table has the columns of the last statement."""
    store = TableStore(spark, scratch_dir(spark))
    store.create("t", "old int")
    store.drop("t")
    store.create("t", "k long, v string")
    return spark.createDataFrame([(n, t) for n, t, _ in store.describe("t")], "name string, type string")


@query("SELECT 'committed' AS state, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'rolled back', count(*) FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'first version', 0")
def store_transaction(spark, sf):
    """What a table holds after a transaction that is forgotten, one that is kept, and at its first version."""
    store, _ = _stored(spark, sf)
    store.begin()
    store.delete("nation")
    store.rollback()
    back = store.read("nation").agg(F.lit("rolled back").alias("state"), F.count("*").alias("n"))
    store.begin()
    store.delete("nation", F.col("n_regionkey") == 2)
    store.commit()
    now = store.read("nation").agg(F.lit("committed").alias("state"), F.count("*").alias("n"))
    return now.unionAll(back).unionAll(store.read("nation", 0).agg(F.lit("first version").alias("state"), F.count("*").alias("n")))


def _world(spark, sf, *names):
    world, frames = World(), {n: table(spark, sf, n) for n in names}
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}
    for name, df in frames.items():
        world.register(name, df, [keys[name]])
    for left, right, a, b in (("orders", "customer", "o_custkey", "c_custkey"), ("customer", "nation", "c_nationkey", "n_nationkey"), ("nation", "region", "n_regionkey", "r_regionkey")):
        if left in frames and right in frames:
            world.add_join(JoinRule(left, right, a, b, state="approved"))
    return world, frames


@query("SELECT * FROM (VALUES ('orders', 'users', 'user_id', 'id', 0.8::DOUBLE), ('visits', 'users', 'user_id', 'id', 0.8)) t(\"left\", \"right\", left_key, right_key, confidence)")
def rules_inferred(spark, sf):
    """Joins proposed from names and types of columns."""
    world = World()
    for name, schema in (("users", "id long, name string"), ("orders", "order_no long, user_id long, total double"), ("visits", "visit_no long, user_id long"), ("texts", "user_id string")):
        world.register(name, spark.createDataFrame([], schema))
    rows = [(r.left, r.right, r.left_key, r.right_key, r.confidence) for r in world.infer_joins()]
    return spark.createDataFrame(rows, "left string, right string, left_key string, right_key string, confidence double")


@query("SELECT * FROM (VALUES (0, 'orders', 'customer'), (1, 'customer', 'nation'), (2, 'nation', 'region')) t(step, \"left\", \"right\")")
def rules_path(spark, sf):
    """The shortest chain of approved joins."""
    world, _ = _world(spark, sf, "orders", "customer", "nation", "region")
    return spark.createDataFrame([(i, r.left, r.right) for i, r in enumerate(world.path("orders", "region"))], "step int, left string, right string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50")
def policy_request(spark, sf):
    """SQL text under a policy: a hidden column isn't there, and no more rows come than the role may see."""
    views(spark, sf, "customer")
    world, _ = _world(spark, sf, "customer")
    world.policies["clerk"] = Policy("clerk", ["customer"], {"customer": ["c_acctbal", "c_nationkey"]}, max_rows=50)
    text = "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey"
    return spark.createDataFrame(sql.execute(spark, sql.Request(text), (), world, "clerk"), "c_custkey long, c_name string, c_mktsegment string").select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('customer-nation', 1), ('customer-region', 2), ('nation-region', 1)) t(way, joins)")
def rules_pack(spark, sf):
    """Of the pack for a planner the ways between the tables that a role may read."""
    world, frames = _world(spark, sf, "orders", "customer", "nation", "region")
    world.policies["clerk"] = Policy("clerk", ["customer", "nation", "region"])
    ways = world.pack("clerk", frames, 1)["paths"]
    return spark.createDataFrame([(w, len(j)) for w, j in ways.items()], "way string, joins int")


@query("SELECT * FROM (VALUES ('audit', 'clerk'), ('lineage', NULL)) t(log, role)")
def rules_logs(spark, sf):
    """Audit and lineage notes kept as tables."""
    world, store = World(), TableStore(spark, scratch_dir(spark))
    world.note(role="clerk", refused="no")
    world.derived("revenue", ["orders"], "sum")
    world.flush(store, "audit", "lineage")
    rows = [(log, json.loads(r["what"]).get("role")) for log in ("audit", "lineage") for r in store.read(log).collect()]
    return spark.createDataFrame(rows, "log string, role string")


_TESTS = {"eq": "O", "ne": "O", "gt": "F", "gte": "F", "lt": "O", "lte": "O", "in": ["F", "P"], "like": "%F%", "between": ("G", "P"), "is_null": None, "not_null": None}
_TEST_SQL = {"eq": "= 'O'", "ne": "<> 'O'", "gt": "> 'F'", "gte": ">= 'F'", "lt": "< 'O'", "lte": "<= 'O'", "in": "IN ('F', 'P')", "like": "LIKE '%F%'", "between": "BETWEEN 'G' AND 'P'", "is_null": "IS NULL", "not_null": "IS NOT NULL"}


@query(" UNION ALL ".join(f"SELECT '{op}' AS op, CAST(count(*) FILTER (WHERE o_orderstatus {test}) AS BIGINT) AS n FROM orders" for op, test in _TEST_SQL.items()))
def filter_ops(spark, sf):
    """Every operator of a structured filter, in one pass."""
    counts = [F.struct(F.lit(op).alias("op"), F.count_if(condition(op, F.col("o_orderstatus"), _TESTS[op])).alias("n")) for op in OPS]
    return table(spark, sf, "orders").agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS s, CAST(count(c_acctbal) AS BIGINT) AS n, round(avg(c_acctbal), 9) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS d FROM customer GROUP BY c_mktsegment")
def metric_ops(spark, sf):
    """Every metric of an intent."""
    world, frames = _world(spark, sf, "customer")
    metrics = [Metric(op, "c_acctbal", name) for op, name in (("sum", "s"), ("count", "n"), ("avg", "a"), ("min", "lo"), ("max", "hi"))] + [Metric("distinct_count", "c_nationkey", "d")]
    return answer(world, frames, Intent(metrics, ["c_mktsegment"])).withColumns({"s": F.round("s", 2), "a": F.round("a", 9)})


_WINDOWS = {"last_30_days": ("DATE '1996-05-17'", "DATE '1996-06-16'"), "last_month": ("DATE '1996-05-01'", "DATE '1996-06-01'"), "this_month": ("DATE '1996-06-01'", "DATE '1996-07-01'"), "last_year": ("DATE '1995-01-01'", "DATE '1996-01-01'"), "this_year": ("DATE '1996-01-01'", "DATE '1997-01-01'"), "today": ("DATE '1996-06-15'", "DATE '1996-06-16'")}


@query(" UNION ALL ".join(f"SELECT '{w}' AS w, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate >= {a} AND o_orderdate < {b}" for w, (a, b) in _WINDOWS.items()))
def time_windows(spark, sf):
    """Intents over time windows, as of 15 June 1996."""
    world, frames = _world(spark, sf, "orders")
    parts = [answer(world, frames, Intent([Metric("count", None, "n")], time=("o_orderdate", w)), as_of="1996-06-15").select(F.lit(w).alias("w"), "n") for w in _WINDOWS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@query("SELECT * FROM (VALUES ('an unclear intent', TRUE), ('an unknown column', TRUE), ('an unknown metric', TRUE), ('a sum of names', TRUE), ('a sort by what is not there', TRUE), ('a sound intent', FALSE)) t(intent, refused)")
def intents_checked(spark, sf):
    """Which intents are refused before anything is read."""
    world, _ = _world(spark, sf, "customer", "nation")
    count = [Metric("count", None, "n")]
    asked = {
        "an unclear intent": Intent(count, ["n_name"], confidence=0.2), "an unknown column": Intent(count, ["no_such"]), "an unknown metric": Intent([Metric("mode", "c_acctbal")], ["n_name"]),
        "a sum of names": Intent([Metric("sum", "c_name")], ["n_name"]), "a sort by what is not there": Intent(count, ["n_name"], sort=[("c_name", True)]), "a sound intent": Intent(count, ["n_name"], [Filter("c_acctbal", "gt", 0)], sort=[("n", False)]),
    }

    def refused(intent):
        try:
            return not compile_intent(world, intent)
        except Rejected:
            return True

    return spark.createDataFrame([(n, refused(i)) for n, i in asked.items()], "intent string, refused boolean")


@query("SELECT 'exact' AS mode, CAST(count(*) AS BIGINT) AS n, TRUE AS near FROM lineitem UNION ALL SELECT 'approx', count(*), TRUE FROM lineitem UNION ALL SELECT 'exact again', count(*), TRUE FROM lineitem")
def sql_requests(spark, sf):
    """A batch of statements in exact and approximate mode; near: the sample's count, scaled, is within a tenth of the rows."""
    views(spark, sf, "lineitem")
    text = "CREATE OR REPLACE TEMP VIEW counted AS SELECT count(*) AS n FROM lineitem; SELECT n FROM counted"
    exact, approx, again = (sql.execute(spark, sql.Request(text, mode=m), ("lineitem",))[0]["n"] for m in ("exact", "approx", "exact"))
    return spark.createDataFrame([("exact", exact, True), ("approx", exact, abs(approx * 10 - exact) <= exact / 10), ("exact again", again, True)], "mode string, n long, near boolean")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_checkpointed(spark, sf):
    """A stream read to its end and written, then asked again: the checkpoint lets no row come twice."""
    events, path = table(spark, sf, "events"), scratch_dir(spark)
    events.repartition(3).write.parquet(f"{path}/in")
    for _ in range(2):
        streams.run_once(streams.read_events(spark, f"{path}/in", events.schema).select("event_type"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_ingested(spark, sf):
    """A stream's batches handed to ingestion, of which the last is handed over twice."""
    events, path = table(spark, sf, "events"), scratch_dir(spark)
    loader = ingest.Ingestion(TableStore(spark, f"{path}/store"))
    handle, events = loader.each_batch("events", "event_id"), events.select("event_id", "event_type")
    halves = [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")]
    for number, half in ((0, halves[0]), (1, halves[1]), (1, halves[1])):
        handle(half, number)
    return loader.store.read("events").groupBy("event_type").agg(F.count("*").alias("n"))
