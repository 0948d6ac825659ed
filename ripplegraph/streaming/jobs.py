"""Structured Streaming jobs (T1, T2, T5-T8, T10, K9); keyed state with timers is in ``state``.

Merging jobs use ``foreachBatch`` over the batch operators, so stream and batch share one
definition.  State that a key accumulates is a mergeable aggregate (sums, maxima, top n): a
micro-batch is first reduced map-side and then meets the stored row of the key, so one hot key
costs one row per task instead of one Python state call per event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.window import Window

from ripplegraph.operators.extract import extract
from ripplegraph.operators.hawkes import HOUR_US, estimate_alpha, recent
from ripplegraph.operators.lookup import priority, simulation_worthy
from ripplegraph.operators.merge import build_edges, build_nodes, merge_edges, merge_nodes
from ripplegraph.operators.scenario import result_edges
from ripplegraph.streaming import store

NODES = (
    "id string, type string, name string, sources array<string>, properties map<string,string>, confidence double, call_count bigint, "
    "first_seen timestamp, last_seen timestamp"
)
EDGES = (
    "from_id string, relation string, to_id string, properties map<string,string>, confidence double, call_count bigint, "
    "first_seen timestamp, last_seen timestamp"
)
INFERRED = "from_id string, relation string, to_id string, confidence double, weight double, source string"
DECAY = "entity_id string, s double, last_hour bigint"
WATERMARK = "1 hour"
BUCKETS = 64
#: Keys of the state tables: what a micro-batch looks up and rewrites.
STATE_KEYS = {"nodes": ["id"], "edges": ["from_id", "relation", "to_id"], "decay": ["entity_id"]}


def run_now(writer: DataStreamWriter) -> None:
    """Process what is there and stop (``availableNow``)."""
    q: StreamingQuery = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def each_version(root: str, step: Callable[[DataFrame, int], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: write every table that ``step`` returns under ``root`` once per batch.

    Tables named in ``STATE_KEYS`` are state (touched buckets are rewritten); the others are append sinks.
    """

    def body(df: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        spark = df.sparkSession
        for name, table in step(df, version).items():
            if store.done(spark, f"{root}/{name}", version):
                continue
            if name in STATE_KEYS:
                store.write_state(table, f"{root}/{name}", version, STATE_KEYS[name], BUCKETS)
            else:
                store.write_version(table, f"{root}/{name}", version)

    return body


def touched_state(batch: DataFrame, root: str, name: str, version: int, schema: str) -> DataFrame:
    """Stored rows of the buckets that the keys of ``batch`` fall in; at most ``BUCKETS`` numbers are gathered."""
    keys = STATE_KEYS[name]
    hit = [r[0] for r in batch.select(store.bucket_of(keys, BUCKETS)).distinct().collect()]
    return store.read_before(batch.sparkSession, f"{root}/{name}", version, schema, hit)


def ingest_tool_outputs(calls: DataFrame, root: str, checkpoint: str, now: Column | None = None) -> DataStreamWriter:
    """Stream of calls(call_id, tool, result) -> merged node and edge snapshots under ``root``."""

    def step(df: DataFrame, version: int) -> dict[str, DataFrame]:
        at = F.current_timestamp() if now is None else now
        batch = extract(df)
        # arrival order inside a batch is not defined: order rows by content
        nodes = build_nodes(batch.entities.withColumn("seq", F.xxhash64("source", "type", "name", F.to_json("properties"))))
        edges = build_edges(batch.connections.withColumn("seq", F.xxhash64("source", "from_name", "to_name")))
        drop = ("merged", "touched")
        return {
            "nodes": merge_nodes(touched_state(nodes, root, "nodes", version, NODES), nodes, at).drop(*drop),
            "edges": merge_edges(touched_state(edges, root, "edges", version, EDGES), edges, at).drop(*drop),
        }

    return calls.writeStream.foreachBatch(each_version(root, step)).option("checkpointLocation", checkpoint)


def dedupe_polls(articles: DataFrame, keys: list[str], ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Overlapping polls deliver a record several times; keep its first arrival."""
    return articles.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def windowed_activity(
    events: DataFrame, key: str, ts: str = "ts", length: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Tumbling (no ``slide``) or sliding event-time windows; late rows beyond the watermark are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, watermark).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Session windows per key."""
    return events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def decay_hours(events: DataFrame, beta: float) -> DataFrame:
    """(entity_id, s, last_hour): events' mass decayed to the end of the entity's last hour.

    Exponents stay within one hour before the shuffle; hours are combined afterwards.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = F.floor(us / float(HOUR_US)).cast("long")
    left = (hour + 1).cast("double") - us / float(HOUR_US)
    per_hour = events.groupBy("entity_id", hour.alias("h")).agg(F.sum(F.col("mass") * F.exp(left * -float(beta))).alias("m"))
    last = F.max("h").over(Window.partitionBy("entity_id"))
    x = per_hour.withColumn("last_hour", last)
    return x.groupBy("entity_id", "last_hour").agg(F.sum(F.col("m") * F.exp((F.col("last_hour") - F.col("h")) * -float(beta))).alias("s")).select("entity_id", "s", "last_hour")


def merge_decay(a: DataFrame, b: DataFrame, beta: float) -> DataFrame:
    """Combine two decay states; the older one decays to the newer one's hour, so late events only
    add their decayed increment."""
    x = a.unionByName(b)
    top = x.groupBy("entity_id").agg(F.max("last_hour").alias("_h"))
    return x.join(top, "entity_id").groupBy("entity_id", "_h").agg(
        F.sum(F.col("s") * F.exp((F.col("_h") - F.col("last_hour")) * -float(beta))).alias("s")
    ).select("entity_id", "s", F.col("_h").alias("last_hour"))


def route_by_priority(entities: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """T5/K9: simulation-worthy entities go to the priority or the batch queue; read both with ``store.read_all``."""

    def step(df: DataFrame, version: int) -> dict[str, DataFrame]:
        jobs = priority(simulation_worthy(df))
        return {q: jobs.filter(F.col("queue") == q) for q in ("priority", "batch")}

    return entities.writeStream.foreachBatch(each_version(root, step)).option("checkpointLocation", checkpoint)


def import_results(results: DataFrame, root: str, checkpoint: str, now: Column) -> DataStreamWriter:
    """Stream of simulation results -> causal edges merged into the edge snapshot."""

    def step(df: DataFrame, version: int) -> dict[str, DataFrame]:
        e = result_edges(df).withColumn("properties", F.create_map(F.lit("sim_id"), "sim_id")).withColumn("seq", F.struct("sim_id", "confidence"))
        return {"edges": merge_edges(touched_state(e, root, "edges", version, EDGES), e, now).drop("merged", "touched")}

    return results.writeStream.foreachBatch(each_version(root, step)).option("checkpointLocation", checkpoint)


def recalibrate(events: DataFrame, history: Callable[[], DataFrame], root: str, checkpoint: str, window_hours: int = 720) -> DataStreamWriter:
    """On every trigger re-estimate the weights over the trailing window of the stored history."""

    def step(df: DataFrame, version: int) -> dict[str, DataFrame]:
        h = history()
        asof = h.agg(F.max("ts")).scalar()
        return {"alpha": estimate_alpha(recent(h, asof, window_hours))}

    return events.writeStream.foreachBatch(each_version(root, step)).option("checkpointLocation", checkpoint)


def enrich_touched(touched: DataFrame, enrich: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> DataStreamWriter:
    """Run an enrichment on the ids of each micro-batch; ``enrich`` maps seeds(id) to edges, read with ``inferred_edges``."""

    def step(df: DataFrame, version: int) -> dict[str, DataFrame]:
        return {"inferred": enrich(df.select("id").distinct())}

    return touched.writeStream.foreachBatch(each_version(root, step)).option("checkpointLocation", checkpoint)


def inferred_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of all enrichment batches; an edge that several batches found counts once, at its best confidence."""
    rows = store.read_all(spark, f"{root}/inferred", INFERRED)
    return rows.groupBy("from_id", "relation", "to_id").agg(F.max(F.struct("confidence", "weight", "source")).alias("b")).select("from_id", "relation", "to_id", "b.*")
