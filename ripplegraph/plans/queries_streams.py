"""Queries: streaming jobs run to completion over the driver tables (``availableNow``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators.linkpred import second_degree
from ripplegraph.plans import graph_view as g
from ripplegraph.plans.registry import query
from ripplegraph.session import scratch_path
from ripplegraph.streaming import jobs, late, state, store

_BETA = 0.1


#: Bytes of a row group of an arriving file: what a reading task takes at least.
ROW_GROUP = 4 << 20


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh output folder and its streaming checkpoint."""
    root = scratch_path(spark, name)
    return f"{root}/out", f"{root}/progress"


def _table_stream(spark: SparkSession, sf: str, name: str, part: Column) -> DataFrame:
    """A driver table as a stream of three micro-batches: ``part`` (0, 1, 2) says which rows arrive together.

    A batch is one file, of small row groups, so that more than one task reads it.
    """
    table = g.load(spark, sf, name)
    root = scratch_path(spark, f"arriving-{name}")
    for i in range(3):  # written one after the other: a file stream reads files by their time
        table.filter(part == i).coalesce(1).write.option("parquet.block.size", ROW_GROUP).parquet(f"{root}/{i}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")


def _events(spark: SparkSession, sf: str, turn: int = 0) -> DataFrame:
    """The events in three batches of ten days, in order, or with the last ``turn`` batches first."""
    part = (F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) + turn) % 3
    return _table_stream(spark, sf, "events", part).withColumn("ts", F.col("ts").cast("timestamp"))


def _append(df: DataFrame, spark: SparkSession, name: str, schema: str) -> DataFrame:
    """Run an append-mode stream into Parquet and read what it wrote."""
    out, progress = _place(spark, name)
    jobs.run_now(df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress))
    return spark.read.schema(schema).parquet(out)


def _at() -> Column:
    return F.lit("2024-01-01").cast("timestamp")


@query(
    "windowed_activity_stream", "T10 T2",
    """SELECT CAST(epoch_us(w) // 1000000 AS BIGINT) AS start, event_type, n, round(total, 4) AS total FROM (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
WHERE w + INTERVAL 1 HOUR <= (SELECT to_timestamp(0) AT TIME ZONE 'UTC' + to_microseconds(epoch_us(max(ts)) // 1000 * 1000) - INTERVAL 1 HOUR FROM events)""",
)
def windowed_activity_stream(spark: SparkSession, sf: str) -> DataFrame:
    x = jobs.windowed_activity(_events(spark, sf), "event_type").select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")
    return _append(x, spark, "windows", "start bigint, event_type string, n bigint, total double").withColumn("total", F.round("total", 4))


_HOURS = """SELECT CAST(epoch_us(w) // 1000000 AS BIGINT) AS start, event_type, n, round(total, 4) AS total FROM (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
WHERE w + INTERVAL 1 HOUR <= (SELECT to_timestamp(0) AT TIME ZONE 'UTC' + to_microseconds(epoch_us(max(ts)) // 1000 * 1000) - INTERVAL 1 HOUR FROM events)"""


@query("repaired_windows_stream", "T2 T10", _HOURS)
def repaired_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten days arrive first, so two of the three batches are late: repaired windows equal those of all rows."""
    out, progress = _place(spark, "late")
    shape = "window struct<start:timestamp,end:timestamp>, event_type string, n bigint, total double"
    written = _append(jobs.windowed_activity(_events(spark, sf, 1), "event_type"), spark, "late-windows", shape)
    rows = _events(spark, sf, 1).select("ts", "event_type", "value")
    jobs.run_now(late.keep_late(rows, out, progress, "event_type"))
    whole = late.repaired(written, late.repair(spark, out, "ts timestamp, event_type string, value double", "event_type"), "event_type")
    return whole.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "sliding_activity_stream", "T2 T10",
    """SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([b, b - 300, b - 600]) AS s FROM (SELECT event_type, epoch_us(ts) // 300000000 * 300 AS b FROM events))
WHERE s + 900 <= (SELECT (epoch_us(max(ts)) // 1000) / 1000.0 - 3600 FROM events) GROUP BY 1, 2""",
)
def sliding_activity_stream(spark: SparkSession, sf: str) -> DataFrame:
    x = jobs.windowed_activity(_events(spark, sf), "event_type", length="15 minutes", slide="5 minutes").select(F.unix_seconds("window.start").alias("start"), "event_type", "n")
    return _append(x, spark, "sliding", "start bigint, event_type string, n bigint")


@query(
    "session_stream", "T10",
    """SELECT user_id, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, sid
HAVING epoch_us(max(ts)) / 1000000.0 + 1800 <= (SELECT (epoch_us(max(ts)) // 1000) / 1000.0 - 3600 FROM events)""",
)
def session_stream(spark: SparkSession, sf: str) -> DataFrame:
    x = jobs.sessions(_events(spark, sf), "user_id").select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")
    return _append(x, spark, "sessions", "user_id bigint, start bigint, n bigint")


@query(
    "deduplicated_polls_stream", "T2 M9",
    "SELECT DISTINCT event_id, user_id FROM events",
)
def deduplicated_polls_stream(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    twice = ev.withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2))))
    x = jobs.dedupe_polls(twice, ["event_id"]).select("event_id", "user_id")
    return _append(x, spark, "polls", "event_id bigint, user_id bigint")


@query(
    "latest_points_stream", "T3 W1",
    """SELECT entity, metric, round(value, 4) AS value FROM (SELECT 'user:' || user_id AS entity, event_type AS metric, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn <= 5""",
)
def latest_points_stream(spark: SparkSession, sf: str) -> DataFrame:
    s = _events(spark, sf).select(g.key("user", "user_id").alias("entity"), F.col("event_type").alias("metric"), "value", "ts")
    changes = _append(state.latest_points(s, 5), spark, "latest", state.POINTS)
    return state.points_snapshot(changes, 5).select("entity", "metric", F.round("value", 4).alias("value"))


@query(
    "decayed_state_stream", "T4 I7",
    """WITH H AS (SELECT user_id, max(epoch_us(ts) // 3600000000) + 1 AS h FROM events GROUP BY 1)
SELECT 'user:' || e.user_id AS entity_id, round(sum(value * exp(-0.1 * (h - epoch_us(ts) / 3600000000.0))), 6) AS s, CAST(any_value(h) - 1 AS BIGINT) AS last_hour FROM events e JOIN H ON H.user_id = e.user_id GROUP BY 1""",
)
def decayed_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf).select(g.key("user", "user_id").alias("entity_id"), "ts", F.col("value").alias("mass"))
    changes = _append(state.decayed_state(ev, _BETA), spark, "decay", state.DECAYED)
    return state.decay_snapshot(changes, _BETA).withColumn("s", F.round("s", 6))


@query(
    "priority_routing_stream", "T5 K9 C14",
    """SELECT 'supp:' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 OR s_acctbal < 1000 THEN 'priority' ELSE 'batch' END AS queue,
  CASE WHEN s_acctbal < 0 THEN 'stressed' WHEN s_acctbal < 1000 THEN 'pre_tipping' ELSE 'normal' END AS regime FROM supplier""",
)
def priority_routing_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = _place(spark, "queues")
    bal = F.col("s_acctbal")
    s = _table_stream(spark, sf, "supplier", F.col("s_suppkey") % 3).select(
        g.key("supp", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 10 == 0, "FinancialInstitution").otherwise("Corporation").alias("type"),
        F.when(bal < 0, "stressed").when(bal < 1000, "pre_tipping").otherwise("normal").alias("regime"),
    )
    jobs.run_now(jobs.route_by_priority(s, out, progress))
    schema = "id string, type string, regime string, priority double, queue string"
    both = store.read_all(spark, f"{out}/priority", schema).unionByName(store.read_all(spark, f"{out}/batch", schema))
    return both.select("id", "queue", "regime")


@query(
    "tool_output_stream", "T1 S1 M1 M2",
    """SELECT type, name, CAST(count(*) AS BIGINT) AS call_count FROM (SELECT DISTINCT 'Company' AS type, c_name AS name, c_custkey % 3 AS batch FROM customer UNION ALL SELECT DISTINCT 'Industry', c_mktsegment, c_custkey % 3 FROM customer) GROUP BY 1, 2""",
)
def tool_output_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = _place(spark, "ingest")
    body = F.to_json(F.struct(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("sector")))
    calls = _table_stream(spark, sf, "customer", F.col("c_custkey") % 3).select(g.key("call", "c_custkey").alias("call_id"), F.lit("crm dump").alias("tool"), body.alias("result"))
    jobs.run_now(jobs.ingest_tool_outputs(calls, out, progress, _at()))
    return store.read_latest(spark, f"{out}/nodes", jobs.NODES).select("type", "name", "call_count")


@query(
    "result_import_stream", "T6 X9 M15",
    """SELECT DISTINCT 'cust:' || o_custkey AS from_id, 'causes' AS relation, 'prio:' || o_orderpriority AS to_id FROM orders UNION ALL SELECT DISTINCT 'cust:' || o_custkey, 'enables', 'status:' || o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'status:' || o_orderstatus, 'enables', 'prio:' || o_orderpriority FROM orders""",
)
def result_import_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = _place(spark, "results")
    c, s, p = g.key("cust", "o_custkey"), g.key("status", "o_orderstatus"), g.key("prio", "o_orderpriority")
    res = _table_stream(spark, sf, "orders", F.col("o_orderkey") % 3).select(g.key("sim", "o_orderkey").alias("sim_id"), c.alias("from_id"), p.alias("to_id"), F.array(c, s, p).alias("path"), F.lit(0.5).alias("weight"))
    jobs.run_now(jobs.import_results(res, out, progress, _at()))
    return store.read_latest(spark, f"{out}/edges", jobs.EDGES).select("from_id", "relation", "to_id")


@query(
    "recalibration_stream", "T7 A17",
    """WITH X AS (SELECT user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 480 HOUR), N AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM X)
SELECT 'user:' || user_id AS entity_id, count(*) AS n_events, round(1000000 * count(*) / greatest(1.0, any_value(n) * (any_value(n) - 1) / 2) / ln(count(*) + 2), 6) AS alpha_ppm FROM X, N GROUP BY 1""",
)
def recalibration_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = _place(spark, "alpha")
    jobs.run_now(jobs.recalibrate(_events(spark, sf), lambda: g.events(spark, sf), out, progress, 480))
    x = store.read_newest(spark, f"{out}/alpha", "entity_id string, n_events bigint, alpha double")
    return x.select("entity_id", "n_events", F.round(F.col("alpha") * 1000000, 6).alias("alpha_ppm"))


@query(
    "touched_enrichment_stream", "T8 I16",
    g.with_graph("""SELECT e AS from_id, 'related_to' AS relation, f AS to_id FROM (SELECT e, f FROM (SELECT DISTINCT e, f FROM (
    SELECT x.id AS e, y.value AS f, row_number() OVER (PARTITION BY x.id, x.value ORDER BY y.confidence DESC, y.value) AS rn FROM ADJ x JOIN ADJ y ON y.id = x.value AND y.value <> x.id WHERE x.id LIKE 'supp:%') WHERE rn <= 10)
  WHERE (SELECT count(*) FROM ADJ x JOIN ADJ y ON y.value = x.value WHERE x.id = e AND y.id = f) >= 2)""",
        """SR AS (SELECT * FROM R WHERE relation = 'located_in' OR (relation = 'purchases_from' AND call_count >= 3)),
ADJ AS (SELECT id, value, max(confidence) AS confidence FROM (SELECT from_id AS id, to_id AS value, confidence FROM SR UNION ALL SELECT to_id, from_id, confidence FROM SR) WHERE id <> value GROUP BY 1, 2)"""),
)
def touched_enrichment_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = _place(spark, "touched")
    rel = g.relationships(spark, sf, ["located_in", "purchases_from"]).filter("relation = 'located_in' or call_count >= 3")
    ids = _table_stream(spark, sf, "supplier", F.col("s_suppkey") % 3).select(g.key("supp", "s_suppkey").alias("id"))
    jobs.run_now(jobs.enrich_touched(ids, lambda seeds: second_degree(seeds, rel), out, progress))
    return jobs.inferred_edges(spark, out).select("from_id", "relation", "to_id")
