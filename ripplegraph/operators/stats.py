"""Graph statistics and plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.common import scalar, top_k
from ripplegraph.operators.timeline import HOUR, micros, running_sum

# Latency histogram bounds in milliseconds, regime explanations.
LATENCY_BOUNDS = (10, 50, 100, 250, 500, 1000, 2500, 5000)
REGIME_TEXT = {
    "normal": "Standard market conditions, no elevated stress",
    "stressed": "Elevated volatility, defensive sentiment detected",
    "pre_tipping": "Critical state, potential cascade imminent",
    "post_event": "Recovery phase following major event",
}


def graph_stats(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """A1: (metric, label, value) for node total, edge total, nodes per type and edges per relation."""
    def rows(df: DataFrame, metric: str, label: str) -> DataFrame:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(metric).alias("metric"), F.col(label).alias("label"), "value"
        )

    def total(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("label"), "value")

    return (
        total(ent, "nodes").unionByName(total(rel, "edges"))
        .unionByName(rows(ent, "nodes_by_type", "type")).unionByName(rows(rel, "edges_by_relation", "relation"))
    )


def degrees(rel: DataFrame) -> DataFrame:
    """A2: out, in and total degree in one pass: every edge is counted once on each side."""
    ends = rel.select(
        F.explode(
            F.array(
                F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("x")
    ).select("x.*")
    return ends.groupBy("id").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree")
    )


def density(ent: DataFrame, rel: DataFrame, low: float = 5.0, high: float = 10.0) -> DataFrame:
    """A2: edges per node against the target band."""
    n, m = ent.agg(F.count(F.lit(1)).alias("n")), rel.agg(F.count(F.lit(1)).alias("m"))
    x = n.withColumn("m", scalar(m)).withColumn("ratio", F.col("m") / F.col("n"))
    band = F.when(F.col("ratio") < low, "below").when(F.col("ratio") > high, "above").otherwise("within")
    return x.select(F.col("n").alias("nodes"), F.col("m").alias("edges"), "ratio", band.alias("band"))


def regime_now(ent: DataFrame) -> DataFrame:
    """Regime distribution with the dominant regime, its share and its meaning on every row."""
    dist = ent.filter(F.col("regime").isNotNull()).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    total = scalar(dist.agg(F.sum("n")))
    dominant = scalar(dist.agg(F.max_by("regime", F.struct("n", "regime"))))
    text = F.lit("Unknown regime state")
    for k, v in REGIME_TEXT.items():
        text = F.when(F.col("dominant") == k, F.lit(v)).otherwise(text)
    top = scalar(dist.agg(F.max("n")))
    return (
        dist.withColumn("dominant", dominant)
        .withColumn("confidence", F.round(top / total, 2))
        .withColumn("interpretation", text)
    )


def contagion_by_type(impacts: DataFrame) -> DataFrame:
    """A4: sum, count and mean of absolute residual impact per entity type."""
    x = F.abs("residual_impact")
    return impacts.groupBy("type").agg(
        F.sum(x).alias("total_impact"), F.count(F.lit(1)).alias("total_updates"), F.avg(x).alias("avg_residual_impact")
    )


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative latency buckets plus request and error counts per endpoint.

    Every bucket is a conditional count, so one partial aggregation per endpoint does it all.
    """
    aggs = [F.count_if(F.col("duration_ms") <= b).alias(f"b{b}") for b in LATENCY_BOUNDS]
    wide = log.groupBy("endpoint").agg(
        *aggs, F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors")
    )
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in LATENCY_BOUNDS]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("requests").alias("n")))
    return wide.select("endpoint", "requests", "errors", F.explode(F.array(*buckets)).alias("x")).select(
        "endpoint", F.col("x.le").alias("le"), F.col("x.n").alias("cumulative"), "requests", "errors"
    )


def metric_lines(ent: DataFrame, rel: DataFrame, log: DataFrame) -> DataFrame:
    """K8: metrics in text exposition format, one line per row."""
    totals = graph_stats(ent, rel).select(
        F.when(F.col("metric") == "nodes", F.format_string("graph_nodes_total %d", "value"))
        .when(F.col("metric") == "edges", F.format_string("graph_edges_total %d", "value"))
        .when(F.col("metric") == "nodes_by_type", F.format_string('graph_nodes{type="%s"} %d', "label", "value"))
        .otherwise(F.format_string('graph_edges{relation="%s"} %d', "label", "value")).alias("line")
    )
    hist = latency_histogram(log).select(
        F.format_string('http_request_duration_ms_bucket{endpoint="%s",le="%s"} %d', "endpoint", "le", "cumulative").alias("line")
    )
    return totals.unionByName(hist)


def sentiment_by_group(scored: DataFrame, group: str) -> DataFrame:
    """Mean sentiment parts per group, velocity = (compound + 1) / 2, reach = min(1, n / 100)."""
    x = scored.groupBy(group).agg(
        *[F.avg(c).alias(c) for c in ("compound", "positive", "negative", "neutral")], F.count(F.lit(1)).alias("n")
    )
    return x.withColumn("velocity", (F.col("compound") + 1) / 2).withColumn("reach", F.least(F.lit(1.0), F.col("n") / 100.0))


def source_run_stats(audit: DataFrame) -> DataFrame:
    """Entities, connections and errors per source, with the covered time span."""
    return audit.groupBy("source").agg(
        F.sum("entities").alias("entities"), F.sum("connections").alias("connections"), F.sum("errors").alias("errors"),
        F.min("ts").alias("first_run"), F.max("ts").alias("last_run"),
    )


def task_fitness(tasks: DataFrame, kill: float = 0.30, clone: float = 0.85) -> DataFrame:
    """Success fitness per agent min(1, .8 (done - errors) / done + .2), .5 without tasks, and its label."""
    x = tasks.groupBy("agent_id", "role").agg(
        F.count_if(F.col("outcome").isNotNull()).alias("done"), F.count_if(F.col("outcome") == "error").alias("errors")
    )
    rate = (F.col("done") - F.col("errors")) / F.nullif(F.col("done"), F.lit(0))
    fit = F.coalesce(F.least(F.lit(1.0), rate * 0.8 + 0.2), F.lit(0.5))
    label = F.when(F.col("fitness") < kill, "kill").when(F.col("fitness") >= clone, "clone").otherwise("keep")
    return x.withColumn("fitness", fit).withColumn("label", label)


def perception_fitness(edges: DataFrame, last: int = 100) -> DataFrame:
    """.7 * mean confidence of the agent's last edges + .3 * resolved share of all its edges."""
    recent = top_k(edges, ["agent_id"], [F.col("ts").desc(), F.col("edge_id")], last).groupBy("agent_id").agg(
        F.avg("confidence").alias("recent_confidence")
    )
    all_ = edges.groupBy("agent_id").agg(
        F.avg(F.col("resolved").cast("double")).alias("resolved_share"), F.count(F.lit(1)).alias("n_edges")
    )
    return recent.join(all_, "agent_id").withColumn(
        "fitness", F.col("recent_confidence") * 0.7 + F.col("resolved_share") * 0.3
    )


def corroboration(facts: DataFrame) -> DataFrame:
    """How often and by how many sources each (entity, fact) was stated.

    Duplicate (entity, fact, source) rows collapse before the second step, so the source list
    holds distinct sources only.
    """
    per_source = facts.groupBy("entity", "fact", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1")
    )
    return per_source.groupBy("entity", "fact").agg(
        F.sum("n").alias("corroborations"), F.count(F.lit(1)).alias("n_sources"),
        F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen"),
    )


def last_tasks(tasks: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` log rows per agent."""
    return top_k(tasks, ["agent_id"], [F.col("ts").desc(), F.col("task_id").desc()], n)


def running_cost(calls: DataFrame) -> DataFrame:
    """Running cost per session; a warning on the call that crosses a whole dollar.

    Money is summed in whole micro-dollars, so the crossing does not depend on summation order.
    """
    x = calls.withColumn("micro", F.round(F.col("cost") * 1e6).cast("long"))
    x = running_sum(x, ["session_id"], ["ts", "event_id"], "micro", micros("ts"), HOUR * 1_000_000)
    dollar = F.lit(1_000_000)
    return x.withColumn("total", F.col("run_total") / 1e6).withColumn(
        "warn", F.floor(F.col("run_total") / dollar) > F.floor(F.col("run_before") / dollar)
    ).drop("micro", "run_total", "run_before")
