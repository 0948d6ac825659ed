"""Queries: link prediction, rules, paths, propagation, event intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import hawkes, linkpred, paths, rules, stats
from ripplegraph.plans import graph_view as g
from ripplegraph.plans.registry import query

# Undirected distinct adjacency and degrees of a directed edge list, as SQL.
_DEG = "DEG AS (SELECT id, count(*) AS d FROM (SELECT from_id AS id FROM P UNION ALL SELECT to_id FROM P) GROUP BY 1)"
_PAIRS = "P AS (SELECT DISTINCT from_id, to_id FROM R)"


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "adamic_adar_industries", "I12 A16 J8 W2",
    g.with_graph("""SELECT source, target, floor(s * 1000 + 0.5) / 1000 AS score, n AS common_neighbours, round(least(0.95, 0.5 + s * 0.1), 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(s, 9) DESC, target) AS rn FROM (
    SELECT a.from_id AS source, b.to_id AS target, sum(1 / ln(d)) AS s, count(*) AS n
    FROM P a JOIN E c ON c.id = a.from_id AND c.type = 'Company' JOIN P b ON b.from_id = a.to_id JOIN E t ON t.id = b.to_id AND t.type = 'Industry'
      JOIN DEG ON DEG.id = a.to_id AND d > 1
    WHERE NOT EXISTS (SELECT 1 FROM P k WHERE k.from_id = a.from_id AND k.to_id = b.to_id) AND a.from_id <> b.to_id
    GROUP BY 1, 2) WHERE s >= 0.1) WHERE rn <= 5""", _PAIRS, _DEG),
)
def adamic_adar_industries(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    seeds = ent.filter("type = 'Company'").select("id")
    return _r6(linkpred.adamic_adar(seeds, g.relationships(spark, sf), ent, k=5, target_type="Industry"), "confidence")


def _supplier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier paired with the next supplier of its nation."""
    from pyspark.sql import Window

    s = g.load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nxt = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    x = s.withColumn("n", nxt).filter("n is not null")
    return x.select(g.key("supp", "s_suppkey").alias("a"), g.key("supp", "n").alias("b"))


_SUPP_PAIRS = """SP AS (SELECT 'supp:' || s_suppkey AS a, 'supp:' || n AS b FROM (
  SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE n IS NOT NULL)"""


@query(
    "jaccard_suppliers", "I13 U5",
    g.with_graph("""SELECT a, b, inter, round(inter / CAST(da + db - inter AS DOUBLE), 6) AS score FROM (
  SELECT a, b, (SELECT count(*) FROM P x JOIN P y ON y.to_id = x.to_id WHERE x.from_id = a AND y.from_id = b) AS inter,
    (SELECT count(*) FROM P x WHERE x.from_id = a) AS da, (SELECT count(*) FROM P x WHERE x.from_id = b) AS db FROM SP)""", _PAIRS, _SUPP_PAIRS),
)
def jaccard_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(linkpred.jaccard(_supplier_pairs(spark, sf), g.relationships(spark, sf)), "score")


@query(
    "jaccard_path_mode", "I13",
    g.with_graph("""SELECT a, b, inter, round(inter / CAST(da + db - inter AS DOUBLE), 6) AS score FROM (
  SELECT a, b, (SELECT count(*) FROM P x JOIN P y ON y.from_id = x.to_id WHERE x.from_id = a AND y.to_id = b) AS inter,
    (SELECT count(*) FROM P x WHERE x.from_id = a) AS da, (SELECT count(*) FROM P x WHERE x.from_id = b) AS db
  FROM (SELECT 'cust:' || c_custkey AS a, 'region:' || n_regionkey AS b FROM customer JOIN nation ON n_nationkey = c_nationkey))""", _PAIRS),
)
def jaccard_path_mode(spark: SparkSession, sf: str) -> DataFrame:
    home = g.load(spark, sf, "customer").join(g.load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = home.select(g.key("cust", "c_custkey").alias("a"), g.key("region", "n_regionkey").alias("b"))
    return _r6(linkpred.jaccard(pairs, g.relationships(spark, sf), mode="reference"), "score")


@query(
    "preferential_attachment", "I14",
    g.with_graph("SELECT a, b, x.d * y.d AS score FROM SP JOIN DEG x ON x.id = a JOIN DEG y ON y.id = b", _PAIRS, _DEG, _SUPP_PAIRS),
)
def preferential_attachment(spark: SparkSession, sf: str) -> DataFrame:
    return linkpred.preferential_attachment(_supplier_pairs(spark, sf), g.relationships(spark, sf))


def _strong(spark: SparkSession, sf: str) -> DataFrame:
    """Strong ties: places, and purchases repeated at least three times."""
    rel = g.relationships(spark, sf, ["located_in", "purchases_from"])
    return rel.filter((F.col("relation") == "located_in") | (F.col("call_count") >= 3))


_STRONG = """SR AS (SELECT * FROM R WHERE relation = 'located_in' OR (relation = 'purchases_from' AND call_count >= 3)),
ADJ AS (SELECT id, value, max(confidence) AS confidence FROM (SELECT from_id AS id, to_id AS value, confidence FROM SR UNION ALL SELECT to_id, from_id, confidence FROM SR) WHERE id <> value GROUP BY 1, 2),
SZ AS (SELECT id, count(*) AS d FROM ADJ GROUP BY 1)"""
_STRUCT = """SELECT a AS from_id, 'similar_to' AS relation, b AS to_id, least(s * 1.5, 0.9) AS confidence, s AS weight, 'adamic_adar' AS source FROM (
  SELECT a, b, (SELECT sum(1 / ln(z.d + 1)) FROM ADJ x JOIN ADJ y ON y.value = x.value JOIN SZ z ON z.id = x.value WHERE x.id = a AND y.id = b) AS s
  FROM (SELECT DISTINCT x.value AS a, y.value AS b FROM ADJ x JOIN ADJ y ON y.id = x.id AND x.value < y.value JOIN SZ c ON c.id = x.id AND c.d < 5) p
  WHERE NOT EXISTS (SELECT 1 FROM ADJ k WHERE k.id = a AND k.value = b)) WHERE s > 0.3"""


@query(
    "structural_pairs", "I15 J8 U4",
    g.with_graph(f"SELECT from_id, to_id, relation, round(confidence, 6) AS confidence, round(weight, 6) AS weight, source FROM ({_STRUCT})", _STRONG),
)
def structural_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(linkpred.structural_pairs(_strong(spark, sf)), "confidence", "weight")


_SECOND = """SELECT e AS from_id, 'related_to' AS relation, f AS to_id, least(0.5 + n * 0.1, 0.8) AS confidence, CAST(n AS DOUBLE) AS weight, 'second_degree' AS source FROM (
  SELECT e, f, (SELECT count(*) FROM ADJ x JOIN ADJ y ON y.value = x.value WHERE x.id = e AND y.id = f) AS n FROM (SELECT DISTINCT e, f FROM (
    SELECT x.id AS e, y.value AS f, row_number() OVER (PARTITION BY x.id, x.value ORDER BY y.confidence DESC, y.value) AS rn
    FROM ADJ x JOIN SZ c ON c.id = x.id AND c.d < 5 JOIN ADJ y ON y.id = x.value AND y.value <> x.id) WHERE rn <= 10)) WHERE n >= 2"""


@query(
    "second_degree_links", "I16 A16",
    g.with_graph(f"SELECT from_id, to_id, relation, round(confidence, 6) AS confidence, weight, source FROM ({_SECOND})", _STRONG),
)
def second_degree_links(spark: SparkSession, sf: str) -> DataFrame:
    rel = _strong(spark, sf)
    adj = linkpred.undirected(rel)
    centres = adj.groupBy("id").agg(F.count(F.lit(1)).alias("d")).filter("d < 5").select("id")
    return _r6(linkpred.second_degree(centres, rel), "confidence")


def _corporate(spark: SparkSession, sf: str) -> DataFrame:
    """Corporate view: repeated purchases as employment, suppliers owned by their nation's first
    supplier, supply as ownership, and rivals = suppliers with the largest and smallest line of a part."""
    rel = g.relationships(spark, sf, ["purchases_from", "supplies_to", "located_in"])
    work = rel.filter("relation = 'purchases_from' and call_count >= 3").withColumn("relation", F.lit("works_at"))
    owns = rel.filter("relation = 'supplies_to' and call_count >= 2").withColumn("relation", F.lit("owns"))
    place = rel.filter("relation = 'located_in'")
    s = g.load(spark, sf, "supplier")
    head = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("head"))
    sub = s.join(head, "s_nationkey").filter("s_suppkey <> head")
    line = g.load(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.max_by("l_suppkey", F.struct("l_quantity", "l_suppkey")).alias("x"), F.min_by("l_suppkey", F.struct("l_quantity", "l_suppkey")).alias("y")
    ).filter("x <> y").select("x", "y").distinct()

    def edge(df: DataFrame, f: str, r: str, t: str) -> DataFrame:
        return df.select(
            g.key("supp", f).alias("from_id"), F.lit(r).alias("relation"), g.key("supp", t).alias("to_id"), g.d(0.9).alias("confidence"),
            F.lit(1).cast("long").alias("call_count"), F.lit(None).cast("double").alias("causal_weight"),
        )

    return (
        work.unionByName(owns).unionByName(place).unionByName(edge(sub, "s_suppkey", "subsidiary_of", "head"))
        .unionByName(edge(line, "x", "competitor_of", "y"))
    )


_CORP = """SH AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS head FROM supplier),
LM AS (SELECT DISTINCT x, y FROM (SELECT l_partkey, first(l_suppkey ORDER BY l_quantity DESC, l_suppkey DESC) AS x, first(l_suppkey ORDER BY l_quantity, l_suppkey) AS y FROM lineitem GROUP BY 1) WHERE x <> y),
CR AS (SELECT from_id, 'works_at' AS relation, to_id FROM R WHERE relation = 'purchases_from' AND call_count >= 3
  UNION ALL SELECT from_id, 'owns', to_id FROM R WHERE relation = 'supplies_to' AND call_count >= 2
  UNION ALL SELECT from_id, relation, to_id FROM R WHERE relation = 'located_in'
  UNION ALL SELECT 'supp:' || s_suppkey, 'subsidiary_of', 'supp:' || head FROM SH WHERE s_suppkey <> head
  UNION ALL SELECT 'supp:' || x, 'competitor_of', 'supp:' || y FROM LM)"""
_RULES = {
    "rule_transitive_employment": ("I17 P1", """SELECT DISTINCT a.from_id, b.to_id, 'works_at' AS relation, 0.7 AS confidence FROM CR a JOIN CR b ON b.from_id = a.to_id
      WHERE a.relation = 'works_at' AND b.relation = 'subsidiary_of' AND a.from_id <> b.to_id"""),
    "rule_inverse_ownership": ("I18 P1", """SELECT DISTINCT to_id AS from_id, from_id AS to_id, 'owned_by' AS relation, 0.95 AS confidence FROM CR JOIN E ON E.id = from_id
      WHERE relation = 'owns' AND type IN ('LegalEntity', 'Corporation')"""),
    "rule_symmetric_competition": ("I19 J8 P1", """SELECT DISTINCT a.to_id AS from_id, a.from_id AS to_id, 'competitor_of' AS relation, 0.95 AS confidence FROM CR a JOIN E ON E.id = a.from_id
      WHERE relation = 'competitor_of' AND type IN ('Corporation', 'Product')
        AND NOT EXISTS (SELECT 1 FROM CR b WHERE b.relation = 'competitor_of' AND b.from_id = a.to_id AND b.to_id = a.from_id)"""),
    "rule_containment": ("I20 P1", """SELECT DISTINCT a.from_id, b.to_id, 'located_in' AS relation, 0.85 AS confidence FROM CR a JOIN CR b ON b.from_id = a.to_id JOIN E x ON x.id = a.from_id
      JOIN E y ON y.id = b.from_id JOIN E z ON z.id = b.to_id WHERE a.relation = 'located_in' AND b.relation = 'located_in'
        AND x.type = 'Company' AND y.type = 'Nation' AND z.type = 'Region'"""),
}


def _rule(name: str) -> rules.Rule:
    if name == "rule_containment":
        return rules.containment(("Company", "Nation", "Region"), "located_in", 0.85)
    return rules.RULES[name.removeprefix("rule_")]


def _rule_query(name: str):
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        out = _rule(name)(_corporate(spark, sf), g.entities(spark, sf))
        return out.select("from_id", "to_id", "relation", "confidence")

    return fn


for _name, (_ids, _sql) in _RULES.items():
    query(_name, _ids, g.with_graph(_sql, _CORP))(_rule_query(_name))


_CO = """SELECT from_id, 'cooccurs_with' AS relation, to_id, least(0.6 + least(n * 0.05, 0.3) + CASE WHEN days < 30 THEN 0.2 ELSE 0 END, 0.95) AS confidence,
  CAST(n AS DOUBLE) AS weight, 'temporal_cooccurrence' AS source FROM (
  SELECT from_id, to_id, n, floor((epoch(t1) - epoch(t0)) / 86400) AS days, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS rn FROM (
    SELECT a.entity AS from_id, b.entity AS to_id, count(*) AS n, date_trunc('second', min(w.ts)) AS t0, date_trunc('second', max(w.ts)) AS t1
    FROM MD a JOIN MD b ON b.source = a.source AND b.entity <> a.entity JOIN MW w ON w.source = a.source GROUP BY 1, 2) WHERE n >= 2) WHERE rn <= 20"""
_MD = g.MENTION_SQL + ", MD AS (SELECT DISTINCT entity, source FROM MN), MW AS (SELECT source, min(ts) AS ts FROM MN GROUP BY 1)"


@query(
    "source_cooccurrence", "I21 J11 U5",
    f"WITH {_MD} SELECT from_id, to_id, relation, round(confidence, 6) AS confidence, weight, source FROM ({_CO})",
)
def source_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(rules.source_cooccurrence(g.mentions(spark, sf), k=rules.SOURCE_PARTNERS), "confidence")


_SIM = """SELECT 'supp:' || a AS from_id, 'supp:' || b AS to_id, 'simulated_with' AS relation, round(least(0.7 + n * 0.1, 0.95), 6) AS confidence, CAST(n AS DOUBLE) AS weight, 'simulation_cooccurrence' AS source FROM (
  SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, 'supp:' || b) AS rn FROM (
    SELECT x.s AS a, y.s AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) x
    JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) y ON y.o = x.o AND y.s <> x.s GROUP BY 1, 2)) WHERE rn <= 10"""


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one order take part in one episode."""
    return g.load(spark, sf, "lineitem").select(g.key("supp", "l_suppkey").alias("id"), F.col("l_orderkey").alias("value")).distinct()


@query("simulation_cooccurrence", "I21 J11", _SIM)
def simulation_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(rules.simulation_cooccurrence(_episodes(spark, sf), k=rules.SIMULATION_PARTNERS), "confidence")


@query(
    "source_cooccurrence_all", "I21 J11",
    f"WITH {_MD} SELECT from_id, to_id, relation, round(confidence, 6) AS confidence, weight, source FROM ({_CO.replace(' WHERE rn <= 20', '')})",
)
def source_cooccurrence_all(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(rules.source_cooccurrence(g.mentions(spark, sf)), "confidence")


_SIM_RAW = _SIM.replace("round(least(0.7 + n * 0.1, 0.95), 6)", "least(0.7 + n * 0.1, 0.95)")


@query(
    "enrichment_job", "I22 U1 W3 T8",
    g.with_graph(f"""SELECT from_id, relation, to_id, round(confidence, 6) AS confidence, round(weight, 6) AS weight, source FROM (
  SELECT *, row_number() OVER (PARTITION BY from_id, relation, to_id ORDER BY confidence DESC, weight DESC, source DESC) AS rn FROM (
    {_STRUCT} UNION ALL {_SECOND} UNION ALL
    SELECT DISTINCT a.from_id, 'located_in', b.to_id, CAST(0.85 AS DOUBLE), CAST(1 AS DOUBLE), 'containment' FROM SR a JOIN SR b ON b.from_id = a.to_id JOIN E x ON x.id = a.from_id
      JOIN E y ON y.id = b.from_id JOIN E z ON z.id = b.to_id WHERE a.relation = 'located_in' AND b.relation = 'located_in' AND x.type = 'Company' AND y.type = 'Nation' AND z.type = 'Region'
      AND a.from_id IN (SELECT id FROM CE)
    UNION ALL SELECT * FROM ({_CO}) WHERE from_id IN (SELECT id FROM CE) UNION ALL SELECT from_id, relation, to_id, confidence, weight, source FROM ({_SIM_RAW}) WHERE from_id IN (SELECT id FROM CE)))
WHERE rn = 1 AND confidence >= 0.6""", _STRONG, _MD, "CE AS (SELECT E.id FROM E LEFT JOIN SZ ON SZ.id = E.id WHERE coalesce(d, 0) < 5)"),
)
def enrichment_job(spark: SparkSession, sf: str) -> DataFrame:
    chosen = {"containment": rules.containment(("Company", "Nation", "Region"), "located_in", 0.85)}
    out = rules.enrich(g.entities(spark, sf), _strong(spark, sf), g.mentions(spark, sf), chosen, episodes=_episodes(spark, sf))
    return _r6(out, "confidence", "weight")


@query(
    "enrichment_status", "M12",
    g.with_graph("""SELECT type, CAST(sum(coalesce(n, 0)) AS BIGINT) AS connection_count, count(n) AS enriched FROM E LEFT JOIN (SELECT from_id AS id, count(*) AS n FROM (
  SELECT DISTINCT a.from_id, b.to_id FROM CR a JOIN CR b ON b.from_id = a.to_id WHERE a.relation = 'works_at' AND b.relation = 'subsidiary_of') GROUP BY 1) USING (id) GROUP BY 1""", _CORP),
)
def enrichment_status(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    inferred = rules.RULES["transitive_employment"](_corporate(spark, sf), ent)
    x = rules.enrichment_status(ent, inferred, F.lit("2024-01-01").cast("timestamp"))
    return x.groupBy("type").agg(F.sum("connection_count").alias("connection_count"), F.count("last_enriched").alias("enriched"))


_W = "coalesce(nullif(causal_weight, 0), confidence)"


@query(
    "shortest_paths_to_region", "I1 I2",
    g.with_graph(
        """SELECT source, target, hops, array_to_string(path, '>') AS path, array_to_string(rels, '>') AS relations, round(total, 6) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hops, path) AS rn FROM (
    SELECT s.id AS source, b.t AS target, 2 AS hops, [s.id, a.t, b.t] AS path, [a.r, b.r] AS rels, a.w + b.w AS total
      FROM E s JOIN A a ON a.f = s.id JOIN A b ON b.f = a.t WHERE s.type = 'Company' AND b.t = 'region:0'
    UNION ALL SELECT s.id, c.t, 3, [s.id, a.t, b.t, c.t], [a.r, b.r, c.r], a.w + b.w + c.w
      FROM E s JOIN A a ON a.f = s.id JOIN A b ON b.f = a.t JOIN A c ON c.f = b.t WHERE s.type = 'Company' AND c.t = 'region:0')) WHERE rn = 1""",
        f"A AS (SELECT from_id AS f, to_id AS t, min(relation) AS r, arg_min({_W}, relation) AS w FROM R GROUP BY 1, 2)",
    ),
)
def shortest_paths_to_region(spark: SparkSession, sf: str) -> DataFrame:
    pairs = g.entities(spark, sf).filter("type = 'Company'").select(F.col("id").alias("source"), F.lit("region:0").alias("target"))
    x = paths.shortest_paths(pairs, g.relationships(spark, sf), max_hops=3)
    return x.select(
        "source", "target", "hops", F.array_join("path", ">").alias("path"), F.array_join("rels", ">").alias("relations"), F.round("total", 6).alias("total")
    )


_CAUSAL = ("purchases_from", "operates_in", "part_of")
_TRACE = """C AS (SELECT from_id, relation, to_id, least(coalesce(nullif(causal_weight, 0), CAST(0.5 AS DOUBLE)), CAST(1 AS DOUBLE)) AS w FROM R WHERE relation IN ('purchases_from', 'operates_in', 'part_of')),
T AS (
  SELECT E.id AS target, from_id AS head, [from_id, to_id] AS nodes, [relation] AS rels, [w] AS ws, w AS tw FROM E JOIN C ON to_id = E.id WHERE type = 'Industry'
  UNION ALL SELECT target, C.from_id, list_prepend(C.from_id, nodes), list_prepend(C.relation, rels), list_prepend(w, ws), tw * w FROM T JOIN C ON C.to_id = T.head WHERE len(nodes) < 6 AND NOT list_contains(nodes, C.from_id)),
TP AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tw DESC, len(nodes), nodes, rels) AS path_rank FROM T) WHERE path_rank <= 20)"""


@query(
    "causal_paths", "I3 W2 U4",
    g.with_graph(
        "SELECT target, path_rank, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS relations, round(tw, 6) AS total_weight FROM TP",
        _TRACE, recursive=True,
    ),
)
def causal_paths(spark: SparkSession, sf: str) -> DataFrame:
    targets = g.entities(spark, sf).filter("type = 'Industry'").select("id")
    x = paths.trace_causal_paths(targets, g.relationships(spark, sf, _CAUSAL), _CAUSAL)
    return x.select(
        "target", "path_rank", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ">").alias("relations"), F.round("total_weight", 6).alias("total_weight")
    )


@query(
    "causal_path_narratives", "I4 N15",
    g.with_graph(
        """SELECT target, path_rank, (SELECT name FROM E WHERE id = nodes[1]) || ' ' || array_to_string([
    '→[unknown mechanism]→ ' || coalesce((SELECT name FROM E WHERE id = n), n) FOR n IN nodes[2:]], ' ') AS narrative,
  round(0.01 + list_sum([w * exp(-0.1 * (i - 1)) FOR w, i IN ws]), 6) AS intensity FROM TP""",
        _TRACE, recursive=True,
    ).replace(
        """(SELECT name FROM E WHERE id = nodes[1]) || ' ' || array_to_string([
    '→[unknown mechanism]→ ' || coalesce((SELECT name FROM E WHERE id = n), n) FOR n IN nodes[2:]], ' ') AS narrative""",
        """(SELECT string_agg(e.name, ' →[unknown mechanism]→ ' ORDER BY p) FROM (SELECT unnest(nodes) AS n, generate_subscripts(nodes, 1) AS p) u JOIN E e ON e.id = u.n) AS narrative""",
    ),
)
def causal_path_narratives(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    targets = ent.filter("type = 'Industry'").select("id")
    x = paths.decorate_paths(paths.trace_causal_paths(targets, g.relationships(spark, sf, _CAUSAL), _CAUSAL), ent)
    return x.select("target", "path_rank", "narrative", F.round("intensity", 6).alias("intensity"))


@query(
    "merged_neighbourhood", "I5 U6",
    g.with_graph(
        """SELECT hop, type, count(*) AS n, (SELECT count(*) FROM N2 r JOIN H x ON x.id = r.from_id JOIN H y ON y.id = r.to_id) AS edges
FROM H JOIN E ON E.id = H.id GROUP BY 1, 2""",
        """N2 AS (SELECT * FROM R WHERE relation IN ('located_in', 'operates_in')), U AS (SELECT from_id AS a, to_id AS b FROM N2 UNION SELECT to_id, from_id FROM N2),
H0 AS (SELECT id FROM E WHERE type = 'FinancialInstitution'), H1 AS (SELECT DISTINCT b AS id FROM U JOIN H0 ON a = H0.id), H2 AS (SELECT DISTINCT b AS id FROM U JOIN H1 ON a = H1.id),
H AS (SELECT id, min(hop) AS hop FROM (SELECT id, 0 AS hop FROM H0 UNION ALL SELECT id, 1 FROM H1 UNION ALL SELECT id, 2 FROM H2) GROUP BY 1)""",
    ),
)
def merged_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    nodes, edges = paths.neighbourhood(
        ent.filter("type = 'FinancialInstitution'").select("id"), g.relationships(spark, sf, ["located_in", "operates_in"]), 2
    )
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    return nodes.join(ent, "id").groupBy("hop", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("edges", n_edges)


_FACTOR = "CASE WHEN regime IN ('stressed', 'pre_tipping') THEN 1.5 ELSE 1.0 END"


def _shock_sql() -> str:
    """Three levels of the propagation, written out, over purchases and supply places."""
    v = f"""PR AS (SELECT * FROM R WHERE relation IN ('purchases_from', 'located_in')),
L0 AS (SELECT id AS seed, id AS node, CAST({_FACTOR} AS DOUBLE) AS impact, [name] AS path FROM E WHERE type = 'Company' AND regime = 'stressed'), S0 AS (SELECT seed, node FROM L0), D0 AS (SELECT seed, 0 AS used FROM L0)"""
    for i in (1, 2, 3):
        v += f""",
V{i} AS (SELECT * FROM (SELECT f.seed, r.to_id AS node, f.impact, f.path, r.confidence AS c, r.from_id AS p, r.relation AS rl, row_number() OVER (PARTITION BY f.seed, r.to_id ORDER BY r.confidence DESC, r.from_id, r.relation) AS rn
  FROM L{i - 1} f JOIN PR r ON r.from_id = f.node WHERE NOT EXISTS (SELECT 1 FROM S{i - 1} s WHERE s.seed = f.seed AND s.node = r.to_id)) WHERE rn = 1),
K{i} AS (SELECT v.seed, v.node, e.name, e.type, v.impact * 0.7 * {_FACTOR} AS impact, v.path, v.c, v.p, v.rl FROM V{i} v JOIN E e ON e.id = v.node),
A{i} AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.seed ORDER BY c DESC, p, rl, node) + used AS rk FROM K{i} k JOIN D{i - 1} d ON d.seed = k.seed WHERE abs(impact) > 0.05) WHERE rk <= 50),
L{i} AS (SELECT seed, node, impact, list_append(path, name) AS path FROM A{i}), S{i} AS (SELECT * FROM S{i - 1} UNION ALL SELECT seed, node FROM K{i}),
D{i} AS (SELECT seed, max(used) AS used FROM (SELECT * FROM D{i - 1} UNION ALL SELECT seed, max(rk) FROM A{i} GROUP BY 1) GROUP BY 1)"""
    out = " UNION ALL ".join(
        f"SELECT seed, node AS id, name, type, {i} AS level, array_to_string(path, '>') AS path, floor(impact * 1000 + 0.5) / 1000 AS residual_impact FROM A{i}" for i in (1, 2, 3)
    )
    return g.with_graph(out, v)


def _shocked(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    seeds = ent.filter("type = 'Company' and regime = 'stressed'").select(F.col("id").alias("seed"), "id", F.lit("shock").alias("intervention"))
    return paths.propagate(seeds, g.relationships(spark, sf, ["purchases_from", "located_in"]), ent, cap=paths.AFFECTED_CAP)


@query("shock_propagation", "I6 O3 U4", _shock_sql())
def shock_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return _shocked(spark, sf).withColumn("path", F.array_join("path", ">"))


@query(
    "contagion_by_type", "A4",
    f"SELECT type, round(sum(abs(residual_impact)), 3) AS total_impact, count(*) AS total_updates, round(sum(abs(residual_impact)) / count(*), 6) AS avg_residual_impact FROM ({_shock_sql()}) GROUP BY 1",
)
def contagion_by_type(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.contagion_by_type(_shocked(spark, sf))
    return _r6(x, "avg_residual_impact").withColumn("total_impact", F.round("total_impact", 3))


@query(
    "ultimate_parents", "I24",
    """WITH RECURSIVE C AS (SELECT s_suppkey AS id, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 0),
W AS (SELECT id, parent, parent AS pos, CAST(1 AS BIGINT) AS depth FROM C UNION ALL SELECT W.id, W.parent, C.parent, W.depth + 1 FROM W JOIN C ON C.id = W.pos)
SELECT 'supp:' || id AS id, 'supp:' || any_value(parent) AS parent, 'supp:' || arg_max(pos, depth) AS root, max(depth) AS depth FROM W GROUP BY id""",
)
def ultimate_parents(spark: SparkSession, sf: str) -> DataFrame:
    s = g.load(spark, sf, "supplier").filter("s_suppkey > 0").withColumn("p", F.expr("s_suppkey div 2"))
    rel = s.select(g.key("supp", "s_suppkey").alias("from_id"), F.lit("subsidiary_of").alias("relation"), g.key("supp", "p").alias("to_id"), F.lit(0.9).alias("confidence"))
    return paths.ultimate_parents(rel)


# --- event intensity ------------------------------------------------------------------------

_ASOF = "2024-02-01 00:00:00"
_ALPHA = g.EV_SQL + """, AL AS (SELECT entity_id, count(*) AS n_events, count(*) / greatest(1.0, any_value(nn) * (any_value(nn) - 1) / 2) / ln(count(*) + 2) AS alpha
  FROM EV, (SELECT CAST(count(*) AS DOUBLE) AS nn FROM events) GROUP BY 1)"""
# event weights of the intensity queries: share of all events
_SHARE = g.EV_SQL + ", AL AS (SELECT entity_id, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS alpha FROM EV GROUP BY 1)"


def _asof() -> Column:
    return F.lit(_ASOF).cast("timestamp_ntz")


def _share(ev: DataFrame) -> DataFrame:
    n = ev.agg(F.count(F.lit(1)).cast("double")).scalar()
    return ev.groupBy("entity_id").agg(F.count(F.lit(1)).alias("c")).select("entity_id", (F.col("c") / n).alias("alpha"))


@query(
    "hawkes_alpha", "A17 C12",
    f"WITH {_ALPHA} SELECT entity_id, n_events, round(alpha * 1000000, 6) AS alpha_ppm FROM AL",
)
def hawkes_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return hawkes.estimate_alpha(g.events(spark, sf)).select("entity_id", "n_events", F.round(F.col("alpha") * 1000000, 6).alias("alpha_ppm"))


@query(
    "hawkes_recalibration", "A17 F11 T7",
    """SELECT count(*) AS n_events, round(count(*) / 720.0, 6) AS mu, CAST(0.1 AS DOUBLE) AS beta, CAST(0.001 AS DOUBLE) AS gamma
FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 720 HOUR""",
)
def hawkes_recalibration(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(hawkes.estimate_params(hawkes.recent(g.events(spark, sf), _asof(), min_events=10), 720), "mu")


@query(
    "branching_ratio", "A18",
    f"""WITH {_SHARE} SELECT entity_id, round(t - alpha, 6) AS branching_ratio, t - alpha > 1 AS is_tipping,
  CASE WHEN t - alpha > 1 THEN 'super-critical' WHEN t - alpha > 0.5 THEN 'elevated' ELSE 'stable' END AS band FROM AL, (SELECT sum(alpha) AS t FROM AL)""",
)
def branching_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(hawkes.branching(_share(g.events(spark, sf))), "branching_ratio").select("entity_id", "branching_ratio", "is_tipping", "band")


_TAU = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0"
_NOW = f"""OWN AS (SELECT EV.entity_id, sum(alpha * intensity * 0.1 * exp(-0.1 * {_TAU})) AS own FROM EV JOIN AL ON AL.entity_id = EV.entity_id GROUP BY 1),
LAM AS (SELECT entity_id, 0.01 + t - own AS lam FROM OWN, (SELECT sum(own) AS t FROM OWN))"""


@query("hawkes_intensity", "I7", f"WITH {_SHARE}, {_NOW} SELECT entity_id, round(lam, 6) AS intensity FROM LAM")
def hawkes_intensity(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    return _r6(hawkes.intensity_now(ev, _share(ev), _asof()), "intensity")


@query(
    "hawkes_intensity_at_events", "I8 W10 W11",
    f"""WITH {_SHARE}, T AS (SELECT entity_id, epoch_us(ts) // 1000 AS ms, sum(alpha * intensity * 0.1) AS m FROM EV JOIN AL USING (entity_id) GROUP BY 1, 2)
SELECT x.entity_id, x.ms, round(0.01 + coalesce(sum(y.m * exp(-0.1 * (x.ms - y.ms) / 3600000.0)) FILTER (WHERE y.entity_id <> x.entity_id), 0), 6) AS intensity
FROM T x LEFT JOIN T y ON y.ms < x.ms GROUP BY 1, 2""",
)
def hawkes_intensity_at_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    return _r6(hawkes.intensity_at_events(ev, _share(ev)), "intensity")


@query(
    "hawkes_intensity_grid", "I8",
    f"""WITH {_SHARE}, T AS (SELECT epoch_us(ts) // 1000 AS ms, alpha * intensity * 0.1 AS m FROM EV JOIN AL USING (entity_id)), H AS (SELECT DISTINCT ms // 3600000 * 3600000 AS hour_ms FROM T)
SELECT hour_ms, round(0.01 + coalesce(sum(m * exp(-0.1 * (hour_ms - ms) / 3600000.0)), 0), 6) AS intensity FROM H LEFT JOIN T ON ms < hour_ms GROUP BY 1""",
)
def hawkes_intensity_grid(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    return _r6(hawkes.intensity_grid(ev, _share(ev)), "intensity")


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every customer-backed user: one point per nation."""
    return g.load(spark, sf, "customer").select(
        g.key("user", "c_custkey").alias("entity_id"), (F.col("c_nationkey") * 5.0 - 60.0).alias("lat"), (F.col("c_nationkey") * 14.0 - 170.0).alias("lon")
    )


@query(
    "spatial_intensity", "I9 C12",
    f"""WITH {_SHARE}, PL AS (SELECT 'user:' || c_custkey AS entity_id, c_nationkey * 5.0 - 60.0 AS lat, c_nationkey * 14.0 - 170.0 AS lon FROM customer),
M AS (SELECT EV.entity_id, lat, lon, sum(alpha * intensity * 0.1 * exp(-0.1 * {_TAU})) AS m FROM EV JOIN AL USING (entity_id) LEFT JOIN PL USING (entity_id) GROUP BY 1, 2, 3)
SELECT t.entity_id, round(0.01 + 1000 * coalesce(sum(m * 0.001 * exp(-0.001 * coalesce(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 0))), 0), 6) AS scaled FROM (
  SELECT t.entity_id, m, pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2) AS h
  FROM PL t LEFT JOIN M s ON s.entity_id <> t.entity_id) t GROUP BY 1""",
)
def spatial_intensity(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    pl = _placed(spark, sf)
    x = hawkes.spatial_intensity(pl, ev.join(pl, "entity_id", "left"), _share(ev), _asof(), error=1e-12)
    return x.select("entity_id", F.round((F.col("intensity") - 0.01) * 1000 + 0.01, 6).alias("scaled"))


@query(
    "contagion_state", "I10 A18 W2",
    f"""WITH {_SHARE}, {_NOW}, CT AS (SELECT EV.entity_id AS source, alpha * intensity * 0.1 * exp(-0.1 * {_TAU}) AS c, {_TAU} AS tau, ts FROM EV JOIN AL USING (entity_id) WHERE {_TAU} BETWEEN 0 AND 168),
RK AS (SELECT LAM.entity_id, source, c, tau, row_number() OVER (PARTITION BY LAM.entity_id ORDER BY c DESC, ts DESC, source) AS rn FROM LAM JOIN CT ON source <> LAM.entity_id AND c > 0.001),
DR AS (SELECT entity_id, string_agg(source || ':' || printf('%.3f', floor(c * 1000 + 0.5) / 1000) || ':' || printf('%.1f', floor(tau * 10 + 0.5) / 10), ',' ORDER BY rn) AS drivers FROM RK WHERE rn <= 5 GROUP BY 1)
SELECT LAM.entity_id, floor(round(lam * 1000, 6) + 0.5) / 1000 AS intensity, floor(round((t - alpha) * 1000, 6) + 0.5) / 1000 AS branching_ratio, coalesce(drivers, '') AS drivers, t - alpha > 1 AS is_tipping
FROM LAM JOIN AL USING (entity_id) LEFT JOIN DR USING (entity_id), (SELECT sum(alpha) AS t FROM AL)""",
)
def contagion_state(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    x = hawkes.contagion_state(ev, _share(ev), _asof())
    return x.withColumn("drivers", F.coalesce("drivers", F.lit("")))


def _busiest(ev: DataFrame) -> DataFrame:
    """The most active entity of every event type."""
    n = ev.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("entity_type").agg(F.max_by("entity_id", F.struct("n", "entity_id")).alias("entity_id"))


_BUSY = "BS AS (SELECT entity_type, first(entity_id ORDER BY n DESC, entity_id DESC) AS entity_id FROM (SELECT entity_type, entity_id, count(*) AS n FROM EV GROUP BY 1, 2) GROUP BY 1)"


@query(
    "active_neighbours", "J14",
    f"""WITH {g.EV_SQL}, {_BUSY} SELECT DISTINCT a.entity_id AS seed, b.entity_id FROM (SELECT EV.* FROM EV JOIN (SELECT DISTINCT entity_id FROM BS) s USING (entity_id)) a
JOIN EV b ON b.entity_id <> a.entity_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 86400000000""",
)
def active_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    return hawkes.active_neighbours(_busiest(ev), hawkes.activity_days(ev))


@query(
    "shock_cascade", "I11 O5 O6",
    f"""WITH {_SHARE}, {_NOW}, {_BUSY}, TY AS (SELECT entity_id, first(entity_type ORDER BY ts, entity_type) AS ty FROM EV GROUP BY 1),
NB AS (SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM (SELECT EV.* FROM EV JOIN (SELECT DISTINCT entity_id FROM BS) s USING (entity_id)) a JOIN EV b ON b.entity_id <> a.entity_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 86400000000),
W1 AS (SELECT *, row_number() OVER (PARTITION BY shock ORDER BY b) AS rn FROM (SELECT entity_type AS shock, b, 2.0 * (t - alpha) * 0.7 AS mag FROM BS JOIN NB ON a = BS.entity_id JOIN AL ON AL.entity_id = BS.entity_id, (SELECT sum(alpha) AS t FROM AL))),
ALLW AS (SELECT entity_type AS shock, entity_id, 2.0 AS mag, 0 AS wave FROM BS UNION ALL SELECT shock, b, mag, 1 FROM W1 WHERE rn <= 99)
SELECT shock, ALLW.entity_id, ty AS entity_type, wave + 1 AS peak_time_hours, floor(mag * lam * 1000 + 0.5) / 1000 AS peak_intensity, floor(mag * lam * ln(2) / 0.1 * 2 * 1000 + 0.5) / 1000 AS total_impact
FROM ALLW JOIN LAM USING (entity_id) JOIN TY USING (entity_id)""",
)
def shock_cascade(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    shocks = _busiest(ev).select(F.col("entity_type").alias("shock"), "entity_id", F.lit(2.0).alias("magnitude"))
    return hawkes.simulate_shock(shocks, ev, _share(ev), _asof(), cap=hawkes.CASCADE_CAP)


def _all_waves_sql(waves: int = 5) -> str:
    """Cascade without a limit on visits, wave by wave; the table is reached as a whole well before the last one."""
    parts = []
    for i in range(1, waves + 1):
        before = " UNION ALL ".join(f"SELECT shock, entity_id FROM C{j}" for j in range(i))
        parts.append(f"""C{i} AS (SELECT f.shock, NB.b AS entity_id, max(f.mag * r * 0.7) AS mag, {i} AS wave FROM C{i - 1} f JOIN BR ON BR.entity_id = f.entity_id AND r > 0.1 AND f.mag * r * 0.7 > 0.05
  JOIN NB ON NB.a = f.entity_id WHERE NOT EXISTS (SELECT 1 FROM ({before}) d WHERE d.shock = f.shock AND d.entity_id = NB.b) GROUP BY 1, 2)""")
    whole = " UNION ALL ".join(f"SELECT * FROM C{j}" for j in range(waves + 1))
    return f"""WITH {_SHARE}, {_NOW}, {_BUSY}, TY AS (SELECT entity_id, first(entity_type ORDER BY ts, entity_type) AS ty FROM EV GROUP BY 1),
NB AS (SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM EV a JOIN EV b ON b.entity_id <> a.entity_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 86400000000),
BR AS (SELECT entity_id, t - alpha AS r FROM AL, (SELECT sum(alpha) AS t FROM AL)), C0 AS (SELECT entity_type AS shock, entity_id, CAST(2 AS DOUBLE) AS mag, 0 AS wave FROM BS),
{", ".join(parts)}, CX AS ({whole}), CR AS (
SELECT shock, CX.entity_id, ty AS entity_type, wave + 1 AS peak_time_hours, floor(mag * lam * 1000 + 0.5) / 1000 AS peak_intensity, floor(mag * lam * ln(2) / 0.1 * 2 * 1000 + 0.5) / 1000 AS total_impact
FROM CX JOIN LAM USING (entity_id) JOIN TY USING (entity_id))"""


def _whole_cascade(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.events(spark, sf)
    shocks = _busiest(ev).select(F.col("entity_type").alias("shock"), "entity_id", F.lit(2.0).alias("magnitude"))
    return hawkes.simulate_shock(shocks, ev, _share(ev), _asof())


@query("shock_cascade_all", "I11 O5", _all_waves_sql() + " SELECT * FROM CR")
def shock_cascade_all(spark: SparkSession, sf: str) -> DataFrame:
    return _whole_cascade(spark, sf)


@query(
    "shock_summary", "I11",
    _all_waves_sql() + " SELECT shock, count(*) AS total_affected, max(peak_time_hours) - 1 AS max_depth, max(peak_intensity) < 0.5 AS stable FROM CR GROUP BY 1",
)
def shock_summary(spark: SparkSession, sf: str) -> DataFrame:
    return hawkes.shock_summary(_whole_cascade(spark, sf))
