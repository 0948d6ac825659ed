"""Queries: lookup, neighbourhoods, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import lookup, neighbors, stats
from ripplegraph.plans import graph_view as g
from ripplegraph.plans.registry import query


def _ids(ent: DataFrame, *types: str) -> DataFrame:
    return ent.filter(F.col("type").isin(*types)).select("id")


@query(
    "entity_search", "F1 F2 F3 O1 O2 O6",
    g.with_graph("""SELECT id, type, name, confidence FROM E WHERE contains(lower(name), 'brand#1') AND confidence >= 0.5
ORDER BY (lower(name) = 'brand#1') DESC, confidence DESC, id"""),
)
def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.query_entities(g.entities(spark, sf), "Brand#1", min_confidence=0.5)


@query(
    "typed_search", "F1 F3 O6",
    g.with_graph("""SELECT id, type, name, confidence FROM E WHERE type = 'Company' AND contains(lower(name), '00001')
ORDER BY (lower(name) = '00001') DESC, confidence DESC, id"""),
)
def typed_search(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.query_entities(g.entities(spark, sf), "00001", type_="Company")


@query(
    "name_contains_join", "J3 F1",
    g.with_graph("""SELECT s.seed, e.id FROM (SELECT DISTINCT p_name AS seed FROM part UNION SELECT p_brand FROM part) s
JOIN E e ON contains(lower(e.name), lower(s.seed))"""),
)
def name_contains_join(spark: SparkSession, sf: str) -> DataFrame:
    part = g.load(spark, sf, "part")
    seeds = part.select(F.col("p_name").alias("seed")).union(part.select("p_brand")).distinct()
    return lookup.match_names(seeds, g.entities(spark, sf))


@query(
    "resolve_names", "F1 F9 J4 W2",
    g.with_graph("""SELECT seed, id, name, type FROM (
  SELECT s.seed, e.*, row_number() OVER (PARTITION BY seed ORDER BY
    CASE type WHEN 'Industry' THEN 1 WHEN 'Company' THEN 2 ELSE 9 END,
    CAST(lower(name) = lower(seed) AS INT) DESC, confidence DESC, id) AS rn
  FROM (SELECT DISTINCT p_brand AS seed FROM part) s JOIN E e ON contains(lower(e.name), lower(s.seed))) WHERE rn = 1"""),
)
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    seeds = g.load(spark, sf, "part").select(F.col("p_brand").alias("seed")).distinct()
    hit = lookup.resolve_typed(seeds, g.entities(spark, sf), {"Industry": 1, "Company": 2})
    return hit.select("seed", "id", "name", "type")


@query(
    "entity_profile", "J4",
    g.with_graph("""SELECT s.seed, s.id AS entity, x.direction, x.relation, x.neighbour, n.name AS neighbour_name, n.type AS neighbour_type, round(x.confidence, 6) AS confidence FROM (
  SELECT * FROM (SELECT s.seed, e.*, row_number() OVER (PARTITION BY seed ORDER BY CASE type WHEN 'Nation' THEN 1 WHEN 'Company' THEN 2 ELSE 9 END, CAST(lower(name) = lower(seed) AS INT) DESC, confidence DESC, id) AS rn
    FROM (SELECT lower(n_name) AS seed FROM nation UNION SELECT p_brand FROM part) s JOIN E e ON contains(lower(e.name), lower(s.seed))) WHERE rn = 1) s
JOIN (SELECT from_id AS id, 'out' AS direction, relation, to_id AS neighbour, confidence FROM R UNION ALL SELECT to_id, 'in', relation, from_id, confidence FROM R) x ON x.id = s.id JOIN E n ON n.id = x.neighbour"""),
)
def entity_profile(spark: SparkSession, sf: str) -> DataFrame:
    seeds = g.load(spark, sf, "nation").select(F.lower("n_name").alias("seed")).union(g.load(spark, sf, "part").select("p_brand")).distinct()
    x = lookup.entity_profile(seeds, g.entities(spark, sf), g.relationships(spark, sf), {"Nation": 1, "Company": 2})
    return x.select("seed", "entity", "direction", "relation", "neighbour", "neighbour_name", "neighbour_type", F.round("confidence", 6).alias("confidence"))


@query(
    "entity_claims", "J16",
    f"WITH {g.CLAIM_SQL} SELECT DISTINCT upper(entity) AS seed, id, entity, relation, target, assertion, round(confidence, 6) AS confidence FROM CL",
)
def entity_claims(spark: SparkSession, sf: str) -> DataFrame:
    cl = g.claims(spark, sf)
    seeds = cl.select(F.upper("entity").alias("seed")).distinct()
    return lookup.entity_claims(seeds, cl).select("seed", "id", "entity", "relation", "target", "assertion", F.round("confidence", 6).alias("confidence"))


@query(
    "regime_distribution", "A3 F4",
    g.with_graph("""SELECT regime, n, dominant, round(top / CAST(total AS DOUBLE), 2) AS confidence,
  CASE dominant WHEN 'normal' THEN 'Standard market conditions, no elevated stress'
    WHEN 'stressed' THEN 'Elevated volatility, defensive sentiment detected'
    WHEN 'pre_tipping' THEN 'Critical state, potential cascade imminent'
    WHEN 'post_event' THEN 'Recovery phase following major event' ELSE 'Unknown regime state' END AS interpretation
FROM (SELECT regime, n, max(n) OVER () AS top, sum(n) OVER () AS total, first_value(regime) OVER (ORDER BY n DESC, regime DESC) AS dominant
  FROM (SELECT regime, count(*) AS n FROM E WHERE regime IS NOT NULL GROUP BY 1))"""),
)
def regime_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return stats.regime_now(g.entities(spark, sf))


@query(
    "graph_statistics", "A1 A24",
    g.with_graph("""SELECT 'nodes' AS metric, '' AS label, count(*) AS value FROM E UNION ALL SELECT 'edges', '', count(*) FROM R
UNION ALL SELECT 'nodes_by_type', type, count(*) FROM E GROUP BY type UNION ALL SELECT 'edges_by_relation', relation, count(*) FROM R GROUP BY relation"""),
)
def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.graph_stats(g.entities(spark, sf), g.relationships(spark, sf))


@query(
    "degree_table", "A2",
    g.with_graph("""SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM (
  SELECT from_id AS id, 1 AS o, 0 AS i FROM R UNION ALL SELECT to_id, 0, 1 FROM R) GROUP BY id"""),
)
def degree_table(spark: SparkSession, sf: str) -> DataFrame:
    return stats.degrees(g.relationships(spark, sf))


@query(
    "edge_density", "A2",
    g.with_graph("""SELECT n AS nodes, m AS edges, round(m / CAST(n AS DOUBLE), 6) AS ratio,
  CASE WHEN m / CAST(n AS DOUBLE) < 5 THEN 'below' WHEN m / CAST(n AS DOUBLE) > 10 THEN 'above' ELSE 'within' END AS band
FROM (SELECT (SELECT count(*) FROM E) AS n, (SELECT count(*) FROM R) AS m)"""),
)
def edge_density(spark: SparkSession, sf: str) -> DataFrame:
    return stats.density(g.entities(spark, sf), g.relationships(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(
    "outbound_neighbours", "J1 O1 W2",
    g.with_graph("""SELECT seed, relation, neighbour, neighbour_name, neighbour_type, round(confidence, 6) AS confidence FROM (
  SELECT r.from_id AS seed, relation, to_id AS neighbour, e.name AS neighbour_name, e.type AS neighbour_type, r.confidence,
    row_number() OVER (PARTITION BY r.from_id ORDER BY r.confidence DESC, to_id, relation) AS rn
  FROM R r JOIN E s ON s.id = r.from_id AND s.type = 'Company' JOIN E e ON e.id = r.to_id) WHERE rn <= 5"""),
)
def outbound_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    rel = g.relationships(spark, sf)
    return neighbors.neighbours(_ids(ent, "Company"), rel, ent, k=5).withColumn("confidence", F.round("confidence", 6))


@query(
    "inbound_neighbours", "J2 O1 W2",
    g.with_graph("""SELECT seed, relation, neighbour, neighbour_name, neighbour_type, round(confidence, 6) AS confidence FROM (
  SELECT r.to_id AS seed, relation, from_id AS neighbour, e.name AS neighbour_name, e.type AS neighbour_type, r.confidence,
    row_number() OVER (PARTITION BY r.to_id ORDER BY r.confidence DESC, from_id, relation) AS rn
  FROM R r JOIN E s ON s.id = r.to_id AND s.type IN ('Corporation', 'FinancialInstitution') JOIN E e ON e.id = r.from_id) WHERE rn <= 10"""),
)
def inbound_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    out = neighbors.neighbours(_ids(ent, "Corporation", "FinancialInstitution"), g.relationships(spark, sf), ent, direction="in", k=10)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "enrich_profile", "J4",
    g.with_graph("""SELECT r.from_id AS seed, relation, count(*) AS n, round(max(r.confidence), 6) AS best, round(sum(r.confidence), 6) AS total
FROM R r JOIN E s ON s.id = r.from_id JOIN E t ON t.id = r.to_id WHERE s.type IN ('Company', 'Corporation') GROUP BY 1, 2"""),
)
def enrich_profile(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    hop = neighbors.neighbours(_ids(ent, "Company", "Corporation"), g.relationships(spark, sf), ent)
    x = neighbors.group_by_relation(hop)
    return x.select("seed", "relation", "n", F.round("best", 6).alias("best"), F.round(F.col("mean") * F.col("n"), 6).alias("total"))


_TWO_HOP = """SELECT seed, via, target, round(c, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY c DESC, c2 DESC, target, via) AS rn FROM (
    SELECT a.src AS seed, a.dst AS via, b.dst AS target, least(a.c, b.c) AS c, b.c AS c2
    FROM {best} a JOIN {best} b ON b.src = a.dst JOIN E s ON s.id = a.src AND s.type = {type} WHERE b.dst <> a.src)) WHERE rn <= 10"""


@query(
    "two_hop_neighbours", "J5 W2 W3 O1",
    g.with_graph(
        _TWO_HOP.format(best="B", type="'Company'"),
        "B AS (SELECT from_id AS src, to_id AS dst, max(confidence) AS c FROM R WHERE confidence >= 0.5 GROUP BY 1, 2)",
    ),
)
def two_hop_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    out = neighbors.two_hop(_ids(ent, "Company"), g.relationships(spark, sf), k=10, min_confidence=0.5)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "two_hop_undirected", "J5 W2",
    g.with_graph(
        _TWO_HOP.format(best="B", type="'Nation'"),
        """B AS (SELECT src, dst, max(c) AS c FROM (SELECT from_id AS src, to_id AS dst, confidence AS c FROM R UNION ALL SELECT to_id, from_id, confidence FROM R) GROUP BY 1, 2)""",
    ),
)
def two_hop_undirected(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    out = neighbors.two_hop(_ids(ent, "Nation"), g.relationships(spark, sf), k=10, direction="both")
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "industry_location_companies", "J6",
    g.with_graph("""SELECT e.id, e.name, e.type, i.name AS industry, round(e.confidence, 6) AS confidence, round(r.confidence, 6) AS edge_confidence
FROM R r JOIN E i ON i.id = r.to_id AND i.type = 'Industry' AND contains(i.name, 'Brand#2') JOIN E e ON e.id = r.from_id
WHERE r.relation = 'operates_in' AND e.type IN ('Corporation', 'FinancialInstitution')
  AND EXISTS (SELECT 1 FROM R l JOIN E p ON p.id = l.to_id AND contains(lower(p.name), 'nation_1') WHERE l.relation = 'located_in' AND l.from_id = e.id)"""),
)
def industry_location_companies(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    out = neighbors.by_industry_and_location(
        g.relationships(spark, sf, ["operates_in", "located_in"]), ent, ["Corporation", "FinancialInstitution"],
        (F.col("type") == "Industry") & F.contains(F.col("name"), F.lit("Brand#2")),
        F.contains(F.lower("name"), F.lit("nation_1")),
    )
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("edge_confidence", F.round("edge_confidence", 6))


def _causal(side: str) -> str:
    a, b = ("to_id", "from_id") if side == "in" else ("from_id", "to_id")
    return g.with_graph(f"""SELECT seed, neighbour, mechanism, round(weight, 6) AS weight FROM (
  SELECT {a} AS seed, {b} AS neighbour, relation AS mechanism, coalesce(nullif(causal_weight, 0), r.confidence) AS weight,
    row_number() OVER (PARTITION BY {a} ORDER BY coalesce(nullif(causal_weight, 0), r.confidence) DESC, {b}, relation) AS rn
  FROM R r JOIN E s ON s.id = {a} AND s.regime IN ('stressed', 'pre_tipping')) WHERE rn <= 10""")


@query("causal_parents", "J7 W2", _causal("in"))
def causal_parents(spark: SparkSession, sf: str) -> DataFrame:
    seeds = g.entities(spark, sf).filter(F.col("regime").isin("stressed", "pre_tipping")).select("id")
    return neighbors.causal_neighbours(seeds, g.relationships(spark, sf), "in", 10).withColumn("weight", F.round("weight", 6))


@query("causal_children", "J7 W2", _causal("out"))
def causal_children(spark: SparkSession, sf: str) -> DataFrame:
    seeds = g.entities(spark, sf).filter(F.col("regime").isin("stressed", "pre_tipping")).select("id")
    return neighbors.causal_neighbours(seeds, g.relationships(spark, sf), "out", 10).withColumn("weight", F.round("weight", 6))


@query(
    "types_subgraph", "F8 K5",
    g.with_graph("""SELECT relation, s.type AS from_type, t.type AS to_type, count(*) AS n FROM R r JOIN E s ON s.id = r.from_id JOIN E t ON t.id = r.to_id
WHERE s.type IN ('Company', 'Corporation', 'Nation') AND t.type IN ('Company', 'Corporation', 'Nation') GROUP BY 1, 2, 3"""),
)
def types_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    rel = neighbors.relations_among(g.relationships(spark, sf), ent, ["Company", "Corporation", "Nation"])
    f = ent.select(F.col("id").alias("from_id"), F.col("type").alias("from_type"))
    t = ent.select(F.col("id").alias("to_id"), F.col("type").alias("to_type"))
    return rel.join(f, "from_id").join(t, "to_id").groupBy("relation", "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stressed_subgraph_edges", "J18",
    g.with_graph("""SELECT relation, count(*) AS n FROM R WHERE from_id IN (SELECT id FROM E WHERE regime = 'stressed')
OR to_id IN (SELECT id FROM E WHERE regime = 'stressed') GROUP BY 1"""),
)
def stressed_subgraph_edges(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf).filter("regime = 'stressed'")
    return neighbors.sub_graph_relations(g.relationships(spark, sf), ent).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "claims_by_entity", "J16 M8",
    f"""WITH {g.CLAIM_SQL} SELECT lower(entity) AS entity, count(*) AS n_claims, round(max(confidence), 6) AS best,
  round(avg(confidence), 6) AS mean, sum(length(assertion)) AS chars FROM CL GROUP BY 1""",
)
def claims_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return g.claims(spark, sf).groupBy(F.lower("entity").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_claims"), F.round(F.max("confidence"), 6).alias("best"),
        F.round(F.avg("confidence"), 6).alias("mean"), F.sum(F.length("assertion")).alias("chars"),
    )


@query(
    "latency_histogram", "A13 K8",
    """WITH L AS (SELECT event_type AS endpoint, value * 10.0 AS ms, event_type = 'error' AS err FROM events),
T AS (SELECT endpoint, count(*) AS requests, count(*) FILTER (WHERE err) AS errors FROM L GROUP BY 1),
B AS (SELECT * FROM (VALUES ('10', 10.0), ('50', 50.0), ('100', 100.0), ('250', 250.0), ('500', 500.0), ('1000', 1000.0), ('2500', 2500.0), ('5000', 5000.0), ('+Inf', 1e300)) v(le, ub))
SELECT L.endpoint, le, count(*) FILTER (WHERE ms <= ub) AS cumulative, any_value(requests) AS requests, any_value(errors) AS errors
FROM L CROSS JOIN B JOIN T ON T.endpoint = L.endpoint GROUP BY L.endpoint, le""",
)
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.latency_histogram(g.request_log(spark, sf))


@query(
    "session_cost_warnings", "W4",
    """SELECT session_id, event_id, round(total, 4) AS total FROM (
  SELECT user_id AS session_id, event_id, sum(CAST(round(value * 10000) AS BIGINT)) OVER w / 1000000.0 AS total,
    floor(sum(CAST(round(value * 10000) AS BIGINT)) OVER w / 1000000.0) > floor((sum(CAST(round(value * 10000) AS BIGINT)) OVER w - CAST(round(value * 10000) AS BIGINT)) / 1000000.0) AS warn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE warn""",
)
def session_cost_warnings(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.running_cost(g.tool_calls(spark, sf)).filter("warn")
    return x.select("session_id", "event_id", F.round("total", 4).alias("total"))


@query(
    "simulation_priority", "C14 F7 K9 T5",
    g.with_graph("""SELECT type, coalesce(regime, 'none') AS regime, priority, CASE WHEN priority >= 0.8 THEN 'priority' ELSE 'batch' END AS queue, count(*) AS n FROM (
  SELECT type, regime, round(least(1.0, 0.5 + CASE WHEN type IN ('FinancialInstitution', 'MarketCrash') THEN 0.3 ELSE 0 END
    + CASE WHEN coalesce(regime, 'normal') <> 'normal' THEN 0.2 ELSE 0 END + CASE WHEN regime IN ('stressed', 'pre_tipping') THEN 0.3 ELSE 0 END), 1) AS priority
  FROM E WHERE type IN ('Corporation', 'FinancialInstitution', 'Nation', 'MarketCrash', 'Asset', 'FinancialInstrument')) GROUP BY 1, 2, 3, 4"""),
)
def simulation_priority(spark: SparkSession, sf: str) -> DataFrame:
    x = lookup.priority(lookup.simulation_worthy(g.entities(spark, sf)))
    return x.groupBy("type", F.coalesce("regime", F.lit("none")).alias("regime"), "priority", "queue").agg(F.count(F.lit(1)).alias("n"))


@query(
    "detection_pull", "N14 W7",
    g.with_graph("""SELECT id, type, round(confidence, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, id) AS rn FROM E) WHERE rn <= 40 ORDER BY confidence DESC, id LIMIT 400"""),
)
def detection_pull(spark: SparkSession, sf: str) -> DataFrame:
    from ripplegraph.operators.common import top_k

    order = [F.col("confidence").desc(), F.col("id")]
    return top_k(g.entities(spark, sf), ["type"], order, 40).orderBy(*order).limit(400).select(
        "id", "type", F.round("confidence", 6).alias("confidence")
    )
