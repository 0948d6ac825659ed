"""Queries: crash explanation, portfolios, scenarios, policies, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import causal, export, lookup, neighbors, paths, policy, portfolio, scenario
from ripplegraph.plans import graph_view as g
from ripplegraph.plans.registry import query
from ripplegraph.session import materialize

# --- a causal graph over the driver tables --------------------------------------------------------
# Every nation is a crash.  Its causes are the market segments with customers in debt; customers in
# debt push their segment's strain; suppliers of the nation are exposed; two channels transmit.

_SEG_KEY = "'strain:' || c_mktsegment"
CG_SQL = f"""CT AS (SELECT 'crash:' || n_nationkey AS id, 'MarketCrash' AS type, n_name || ' crash' AS name, -5.0 - 2.5 * n_nationkey AS drawdown, 100 + 10 * n_nationkey AS recovery_days FROM nation),
CE AS (SELECT id, type, name FROM CT UNION ALL SELECT DISTINCT {_SEG_KEY}, 'CrashFactor', c_mktsegment || ' strain' FROM customer
  UNION ALL SELECT 'cust:' || c_custkey, 'Company', c_name FROM customer UNION ALL SELECT 'supp:' || s_suppkey, 'Corporation', s_name FROM supplier
  UNION ALL SELECT * FROM (VALUES ('channel:credit', 'RiskChannel', 'Credit Channel'), ('channel:liquidity', 'RiskChannel', 'Liquidity Channel')) v),
DEBT AS (SELECT c_nationkey AS k, c_mktsegment AS seg, count(*) AS n, min(c_acctbal) AS worst FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2),
CR AS (SELECT 'strain:' || seg AS from_id, 'TRIGGERED' AS relation, 'crash:' || k AS to_id, least(1.0, n / 10.0) AS causal_weight, 0.9 AS confidence, CAST(NULL AS VARCHAR) AS mechanism, CAST(NULL AS DOUBLE) AS contagion_weight, CAST(NULL AS DOUBLE) AS loss_pct FROM DEBT
  UNION ALL SELECT 'cust:' || c_custkey, 'impacts', {_SEG_KEY}, least(1.0, -c_acctbal / 1000.0), 0.8, NULL, NULL, NULL FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'crash:' || n_nationkey, 'TRANSMITTED_THROUGH', 'channel:' || unnest(['credit', 'liquidity']), NULL, 0.7, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'supp:' || s_suppkey, 'EXPOSED_TO', 'crash:' || s_nationkey, NULL, 0.6, NULL, NULL, round(s_acctbal / 100.0, 4) FROM supplier
  UNION ALL SELECT 'supp:' || s_suppkey, 'CASCADED_TO', 'crash:' || s_nationkey, NULL, 0.6, CASE WHEN s_acctbal < 3000 THEN 'margin' ELSE 'funding' END, CASE WHEN s_acctbal > 6000 THEN 0.9 END, NULL FROM supplier
  UNION ALL SELECT 'crash:' || s_nationkey, 'impacts', 'supp:' || s_suppkey, NULL, 0.5 + (s_suppkey % 40) / 100.0, NULL, NULL, NULL FROM supplier)"""


def _causal_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(crashes, entities, relationships) of the causal view."""
    n, c, s = (g.load(spark, sf, t) for t in ("nation", "customer", "supplier"))
    crash = n.select(
        g.key("crash", "n_nationkey").alias("id"), F.lit("MarketCrash").alias("type"), F.concat("n_name", F.lit(" crash")).alias("name"),
        (F.col("n_nationkey") * -2.5 - 5.0).alias("drawdown"), (F.col("n_nationkey") * 10 + 100).alias("recovery_days"),
    )
    seg = F.concat(F.lit("strain:"), "c_mktsegment")
    e = lambda df, i, t, nm: df.select(i.alias("id"), F.lit(t).alias("type"), nm.alias("name"))
    channels = spark.createDataFrame([("channel:credit", "RiskChannel", "Credit Channel"), ("channel:liquidity", "RiskChannel", "Liquidity Channel")], "id string, type string, name string")
    ent = reduce(DataFrame.unionByName, [
        crash.select("id", "type", "name"), e(c.select("c_mktsegment").distinct(), seg, "CrashFactor", F.concat("c_mktsegment", F.lit(" strain"))),
        e(c, g.key("cust", "c_custkey"), "Company", F.col("c_name")), e(s, g.key("supp", "s_suppkey"), "Corporation", F.col("s_name")), channels,
    ])

    def r(df: DataFrame, f: Column, rel: str, t: Column, w: Column | None, conf: Column | float, mech: Column | None = None, cw: Column | None = None, loss: Column | None = None) -> DataFrame:
        num = lambda v: (F.lit(None).cast("double") if v is None else v)
        return df.select(
            f.alias("from_id"), F.lit(rel).alias("relation"), t.alias("to_id"), num(w).alias("causal_weight"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence"),
            (F.lit(None).cast("string") if mech is None else mech).alias("mechanism"), num(cw).alias("contagion_weight"), num(loss).alias("loss_pct"),
        )

    debt = c.filter("c_acctbal < 0")
    at = g.key("crash", "s_nationkey")
    supp = g.key("supp", "s_suppkey")
    two = n.withColumn("ch", F.explode(F.array(F.lit("channel:credit"), F.lit("channel:liquidity"))))
    rel = reduce(DataFrame.unionByName, [
        r(debt.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")), seg, "TRIGGERED", g.key("crash", "c_nationkey"), F.least(F.lit(1.0), F.col("n") / 10.0), 0.9),
        r(debt, g.key("cust", "c_custkey"), "impacts", seg, F.least(F.lit(1.0), -F.col("c_acctbal") / 1000.0), 0.8),
        r(two, g.key("crash", "n_nationkey"), "TRANSMITTED_THROUGH", F.col("ch"), None, 0.7),
        r(s, supp, "EXPOSED_TO", at, None, 0.6, loss=F.round(F.col("s_acctbal") / 100.0, 4)),
        r(s, supp, "CASCADED_TO", at, None, 0.6, F.when(F.col("s_acctbal") < 3000, "margin").otherwise("funding"), F.when(F.col("s_acctbal") > 6000, 0.9)),
        r(s, at, "impacts", supp, None, (F.col("s_suppkey") % 40) / 100.0 + 0.5),
    ])
    return crash, ent, rel


def _crash_paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    crash, ent, rel = _causal_graph(spark, sf)
    return crash, ent, rel, materialize(paths.trace_causal_paths(crash, rel, ("TRIGGERED", "impacts")), "crash-paths")


_TP = """C AS (SELECT from_id, relation, to_id, least(coalesce(nullif(causal_weight, 0), CAST(0.5 AS DOUBLE)), CAST(1 AS DOUBLE)) AS w FROM CR WHERE relation IN ('TRIGGERED', 'impacts')),
T AS (SELECT CT.id AS target, from_id AS head, [from_id, to_id] AS nodes, [relation] AS rels, [from_id || '|' || relation || '|' || to_id] AS es, CAST(w AS DOUBLE) AS tw FROM CT JOIN C ON to_id = CT.id
  UNION ALL SELECT target, C.from_id, list_prepend(C.from_id, nodes), list_prepend(C.relation, rels), list_prepend(C.from_id || '|' || C.relation || '|' || C.to_id, es), tw * w FROM T JOIN C ON C.to_id = T.head
    WHERE len(rels) < 5 AND NOT list_contains(es, C.from_id || '|' || C.relation || '|' || C.to_id)),
TP AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tw DESC, len(nodes), nodes, rels) AS path_rank FROM T) WHERE path_rank <= 20)"""
_ROOT = """MP AS (SELECT * FROM (VALUES ('TRIGGERED', 'direct trigger'), ('impacts', 'downstream impact')) v(r, m)),
RG AS (SELECT target, nodes[1] AS root, sum(tw) AS w, count(*) AS paths, string_agg(DISTINCT m, ', ' ORDER BY m) AS mechanisms FROM TP JOIN MP ON r = rels[1] GROUP BY 1, 2),
RC AS (SELECT * FROM (SELECT *, w / sum(w) OVER (PARTITION BY target) AS share, row_number() OVER (PARTITION BY target ORDER BY w DESC, root) AS root_rank FROM RG) WHERE root_rank <= 10)"""
_MECH = """TX AS (SELECT to_id AS target, coalesce(mechanism, 'unknown') AS mechanism, from_id, to_id, coalesce(contagion_weight, 0.5) AS cw FROM CR JOIN CT ON CT.id = to_id WHERE relation IN ('TRANSMITTED_THROUGH', 'PROPAGATED_TO', 'CASCADED_TO', 'AMPLIFIED_CRASH')),
TM AS (SELECT target, mechanism, count(DISTINCT e) AS entities_affected, any_value(s) / 0.1 AS amplification FROM (SELECT target, mechanism, unnest([from_id, to_id]) AS e, sum(cw) OVER (PARTITION BY target, mechanism) AS s FROM TX) GROUP BY 1, 2)"""


@query(
    "crash_root_causes", "A5 J17",
    f"WITH RECURSIVE {CG_SQL}, {_TP}, {_ROOT} SELECT target, root, root_rank, paths, round(share, 6) AS share, mechanisms, round(least(0.95, 0.5 + paths * 0.1), 6) AS confidence FROM RC",
)
def crash_root_causes(spark: SparkSession, sf: str) -> DataFrame:
    *_, p = _crash_paths(spark, sf)
    return causal.root_causes(p).withColumn("share", F.round("share", 6)).withColumn("confidence", F.round("confidence", 6))


@query(
    "crash_transmission", "A6",
    f"WITH {CG_SQL}, {_MECH} SELECT target, mechanism, entities_affected, round(entities_affected / 24.0, 6) AS peak_speed, round(amplification / 2, 4) AS half_amplification FROM (SELECT target, mechanism, entities_affected, (SELECT sum(cw) FROM TX WHERE TX.target = TM.target AND TX.mechanism = TM.mechanism) / 0.1 AS amplification FROM TM)",
)
def crash_transmission(spark: SparkSession, sf: str) -> DataFrame:
    crash, _, rel = _causal_graph(spark, sf)
    x = causal.transmission(crash, rel)
    return x.select("target", "mechanism", "entities_affected", F.round("peak_speed", 6).alias("peak_speed"), F.round(F.col("amplification") / 2, 4).alias("half_amplification"))


@query(
    "crash_most_affected", "A7",
    f"""WITH {CG_SQL} SELECT target, entity, name, type, loss_pct FROM (SELECT to_id AS target, from_id AS entity, name, type, loss_pct, row_number() OVER (PARTITION BY to_id ORDER BY coalesce(loss_pct, 0) DESC, from_id, relation) AS rn
  FROM CR JOIN CE ON CE.id = from_id WHERE relation IN ('EXPOSED_TO', 'CRASHED', 'VULNERABLE_TO')) WHERE rn <= 20""",
)
def crash_most_affected(spark: SparkSession, sf: str) -> DataFrame:
    crash, ent, rel = _causal_graph(spark, sf)
    return causal.most_affected(crash, rel, ent)


@query(
    "crash_explanation", "X1 X2 F9",
    f"""WITH RECURSIVE {CG_SQL}, {_TP}, {_ROOT}, {_MECH},
R3 AS (SELECT target, string_agg(name, ', ' ORDER BY root_rank) AS causes FROM RC JOIN CE ON CE.id = root WHERE root_rank <= 3 GROUP BY 1),
M2 AS (SELECT target, string_agg(mechanism, ' and ' ORDER BY rn) AS channels FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY amplification DESC, mechanism) AS rn FROM TM) WHERE rn <= 2 GROUP BY 1),
N AS (SELECT target, sum(entities_affected) AS k FROM TM GROUP BY 1), P AS (SELECT target, count(*) AS n_paths, max(tw) AS best FROM TP GROUP BY 1)
SELECT CT.id AS target, CT.name || ' (' || CAST(drawdown AS DOUBLE) || '% drawdown) was primarily caused by ' || coalesce(causes, 'multiple factors') || '. The crash propagated through ' || coalesce(channels, 'various channels') || ', affecting ' || CAST(coalesce(k, 0) AS BIGINT) || ' entities.' AS summary,
  coalesce(n_paths, 0) AS n_paths, round(best, 6) AS best_weight FROM CT LEFT JOIN R3 ON R3.target = id LEFT JOIN M2 ON M2.target = id LEFT JOIN N ON N.target = id LEFT JOIN P ON P.target = id""",
)
def crash_explanation(spark: SparkSession, sf: str) -> DataFrame:
    crash, ent, rel, p = _crash_paths(spark, sf)
    return causal.explain(crash, p, rel, ent).withColumn("best_weight", F.round("best_weight", 6))


@query(
    "crash_report", "X2 I4",
    f"""WITH RECURSIVE {CG_SQL}, {_TP}, {_ROOT}, {_MECH}
SELECT id AS target, 1 AS section, 1 AS line_no, '## ' || name AS line FROM CT
UNION ALL SELECT target, 2, root_rank, '- **' || name || '** (' || printf('%.1f', share * 100) || '% contribution): ' || mechanisms FROM RC JOIN CE ON CE.id = root WHERE root_rank <= 5
UNION ALL SELECT target, 3, rn, '- **' || mechanism || '**: Affected ' || entities_affected || ' entities' FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY amplification DESC, mechanism) AS rn FROM TM) WHERE rn <= 5
UNION ALL SELECT target, 4, path_rank, '- ' || (SELECT string_agg(CASE WHEN p = 1 THEN e.name ELSE '→[' || m || ']→ ' || e.name END, ' ' ORDER BY p) FROM (SELECT unnest(nodes) AS n, generate_subscripts(nodes, 1) AS p, unnest(list_prepend('TRIGGERED', rels)) AS rr) u JOIN CE e ON e.id = u.n JOIN MP ON r = rr) FROM TP WHERE path_rank <= 5""",
)
def crash_report(spark: SparkSession, sf: str) -> DataFrame:
    crash, ent, rel, p = _crash_paths(spark, sf)
    return causal.report(crash, paths.decorate_paths(p, ent), rel, ent)


@query(
    "crash_counterfactual", "X3",
    f"""WITH RECURSIVE {CG_SQL}, {_TP}, H AS (SELECT target, path_rank, any_value(tw) AS tw, any_value(len(nodes)) AS n, bool_or(contains(lower(name), 'building')) AS hit FROM (SELECT target, path_rank, tw, nodes, unnest(nodes) AS nid FROM TP) JOIN CE ON CE.id = nid GROUP BY 1, 2),
G AS (SELECT target, sum(tw) AS base, sum(CASE WHEN hit THEN tw ELSE 0 END) AS gone, sum(CASE WHEN hit THEN n ELSE 0 END) AS saved, count(*) FILTER (WHERE hit) AS k FROM H GROUP BY 1)
SELECT CT.id AS target, floor(round(drawdown * (base - gone) / nullif(base, 0) * 10, 6) + 0.5) / 10 AS simulated_drawdown, CAST(coalesce(saved, 0) AS BIGINT) AS entities_saved, coalesce(gone > base * 0.5, false) AS cascade_prevented, round(least(0.9, 0.5 + coalesce(k, 0) * 0.1), 6) AS confidence
FROM CT LEFT JOIN G ON target = id""",
)
def crash_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    crash, ent, _, p = _crash_paths(spark, sf)
    return causal.counterfactual(crash, p, ent, "BUILDING").withColumn("confidence", F.round("confidence", 6))


@query(
    "event_star", "J10",
    f"""WITH {CG_SQL} SELECT event, section, neighbour, name, type, relation, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event, section ORDER BY score DESC, neighbour, relation) AS rn FROM (
  SELECT to_id AS event, 'factors' AS section, from_id AS neighbour, name, type, relation, coalesce(causal_weight, 0) AS score FROM CR JOIN CE ON CE.id = from_id WHERE relation IN ('TRIGGERED', 'SHOCKED', 'causes', 'caused_by') AND to_id LIKE 'crash:%'
  UNION ALL SELECT from_id, 'channels', to_id, name, type, relation, confidence FROM CR JOIN CE ON CE.id = to_id WHERE relation IN ('TRANSMITS_THROUGH', 'TRANSMITTED_THROUGH') AND from_id LIKE 'crash:%'
  UNION ALL SELECT from_id, 'affected', to_id, name, type, relation, confidence FROM CR JOIN CE ON CE.id = to_id WHERE relation = 'impacts' AND type = 'Corporation' AND from_id LIKE 'crash:%'))
WHERE rn <= CASE section WHEN 'factors' THEN 10 WHEN 'affected' THEN 20 ELSE 1000000 END""",
)
def event_star(spark: SparkSession, sf: str) -> DataFrame:
    crash, ent, rel = _causal_graph(spark, sf)
    return causal.event_star(crash, rel, ent).withColumn("score", F.round("score", 6))


@query(
    "narrative_brief", "A15",
    """SELECT seed, neighbour, rank, rank = 1 AS dominant FROM (SELECT source AS seed, 'doc:' || d.doc_id AS neighbour, row_number() OVER (PARTITION BY source ORDER BY 0.5 + 0.4 * coalesce(quality, 0) DESC, 'doc:' || d.doc_id) AS rank FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE rank <= 10""",
)
def narrative_brief(spark: SparkSession, sf: str) -> DataFrame:
    c = g.claims(spark, sf)
    rel = c.select(F.col("entity").alias("from_id"), F.lit("DRIVES_NARRATIVE").alias("relation"), F.col("target").alias("to_id"), "confidence")
    ent = c.select(F.col("target").alias("id"), F.lit("Narrative").alias("type"), F.col("target").alias("name"))
    hop = neighbors.neighbours(c.select(F.col("entity").alias("id")).distinct(), rel, ent)
    return causal.narrative_brief(hop).select("seed", "neighbour", "rank", "dominant")


@query(
    "find_event", "F9 O4",
    f"WITH {CG_SQL} SELECT id, name FROM CE WHERE type IN ('MarketCrash', 'SectorCrash', 'FlashCrash', 'BankRun', 'LiquidityCrisis', 'CurrencyCrisis') AND contains(lower(name), 'nation_1') ORDER BY id LIMIT 1",
)
def find_event(spark: SparkSession, sf: str) -> DataFrame:
    _, ent, _ = _causal_graph(spark, sf)
    return lookup.find_events(ent.withColumn("confidence", F.lit(1.0)), "nation_1").select("id", "name")


# --- portfolios -------------------------------------------------------------------------------------

_LINKS = """LK AS (SELECT 'cust:' || c_custkey AS entity, 'channel' AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 'credit' WHEN 'MACHINERY' THEN 'liquidity' WHEN 'FURNITURE' THEN 'sentiment' WHEN 'HOUSEHOLD' THEN 'supply_chain' ELSE 'regulation' END AS label, 0.5 + (c_custkey % 50) / 100.0 AS conf FROM customer
  UNION ALL SELECT 'cust:' || c_custkey, 'regime', CASE WHEN c_acctbal < 0 THEN 'stressed' WHEN c_acctbal < 1000 THEN 'pre_tipping' WHEN c_acctbal > 9000 THEN 'post_event' ELSE 'normal' END, 0.5 + (c_custkey % 50) / 100.0 FROM customer
  UNION ALL SELECT 'cust:' || c_custkey, 'crash', 'crash ' || c_mktsegment, 0.0 FROM customer WHERE c_acctbal < 0)"""


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure of every customer: a channel by market segment, a regime by balance, a crash when in debt."""
    c = g.load(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    ch = F.when(seg == "BUILDING", "credit").when(seg == "MACHINERY", "liquidity").when(seg == "FURNITURE", "sentiment").when(seg == "HOUSEHOLD", "supply_chain").otherwise("regulation")
    conf = (F.col("c_custkey") % 50) / 100.0 + 0.5
    bal = F.col("c_acctbal")
    regime = F.when(bal < 0, "stressed").when(bal < 1000, "pre_tipping").when(bal > 9000, "post_event").otherwise("normal")
    x = lambda kind, label, cf: F.struct(F.lit(kind).alias("kind"), label.alias("label"), cf.alias("confidence"))
    rows = F.array(x("channel", ch, conf), x("regime", regime, conf), F.when(bal < 0, x("crash", F.concat(F.lit("crash "), seg), F.lit(0.0))))
    return c.select(g.key("cust", "c_custkey").alias("entity"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("entity", "r.*")


@query(
    "portfolio_risk_map", "A8 A10",
    f"""WITH {g.POS_SQL}, {_LINKS}, TOT AS (SELECT portfolio_id, sum(weight) AS t FROM POS GROUP BY 1),
X AS (SELECT portfolio_id, label, sum(weight * conf) AS raw FROM POS JOIN LK USING (entity) WHERE kind = 'channel' GROUP BY 1, 2),
M AS (SELECT TOT.portfolio_id, v.ch AS channel, floor(round(coalesce(raw, 0) / t * 100, 6) + 0.5) / 100 AS exposure FROM TOT CROSS JOIN (VALUES ('credit'), ('liquidity'), ('sentiment'), ('supply_chain'), ('counterparty')) v(ch) LEFT JOIN X ON X.portfolio_id = TOT.portfolio_id AND label = ch)
SELECT portfolio_id, channel, exposure, row_number() OVER (PARTITION BY portfolio_id ORDER BY exposure DESC, channel) AS rank, CASE WHEN exposure > 0.3 THEN 'HIGH' WHEN exposure > 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS warning FROM M""",
)
def portfolio_risk_map(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.channel_map(g.positions(spark, sf), _links(spark, sf))


@query(
    "portfolio_crash_exposure", "A8",
    f"""WITH {g.POS_SQL}, {_LINKS} SELECT portfolio_id, crash, round(exposure, 4) AS exposure, positions FROM (SELECT portfolio_id, label AS crash, sum(weight * 0.5) AS exposure, count(*) AS positions, row_number() OVER (PARTITION BY portfolio_id ORDER BY sum(weight * 0.5) DESC, label) AS rn
  FROM POS JOIN LK USING (entity) WHERE kind = 'crash' GROUP BY 1, 2) WHERE rn <= 5""",
)
def portfolio_crash_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.crash_exposure(g.positions(spark, sf), _links(spark, sf)).withColumn("exposure", F.round("exposure", 4))


@query(
    "portfolio_exposure_edges", "A9",
    f"""WITH {g.POS_SQL}, {_LINKS}, TOT AS (SELECT portfolio_id, sum(weight) AS t FROM POS GROUP BY 1)
SELECT portfolio_id AS from_id, 'PORTFOLIO_EXPOSED_TO' AS relation, kind || '-' || replace(label, '_', '-') AS to_id, round(sum(weight * conf) / any_value(t), 4) AS score, least(1.0, round(sum(weight * conf) / any_value(t), 4)) AS confidence
FROM POS JOIN LK USING (entity) JOIN TOT USING (portfolio_id) WHERE kind IN ('channel', 'regime') GROUP BY portfolio_id, kind, label""",
)
def portfolio_exposure_edges(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.exposure_edges(g.positions(spark, sf), _links(spark, sf))


# --- scenarios ----------------------------------------------------------------------------------------

_PROJ = """PJ AS (SELECT name AS scenario, variant, floor(round(drawdown * m * 10, 6) + 0.5) / 10 AS projected_drawdown, CAST(floor(recovery_days * m + 0.5) AS BIGINT) AS recovery_days, round(greatest(0.3, 0.8 - (m - 1) * 0.2), 6) AS confidence
  FROM CT CROSS JOIN (VALUES ('mild', 0.5), ('moderate', 1.0), ('severe', 1.5), ('systemic', 2.0)) v(variant, m))"""


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    crash, _, _ = _causal_graph(spark, sf)
    return scenario.project(crash.select(F.col("name").alias("scenario"), "drawdown", "recovery_days"))


@query("scenario_projection", "X4", f"WITH {CG_SQL}, {_PROJ} SELECT * FROM PJ")
def scenario_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf).withColumn("confidence", F.round("confidence", 6))


_REC = """SELECT scenario, worst, a.action, a.urgency FROM (SELECT scenario, worst, unnest(list_filter([CASE WHEN worst < {hi} THEN {{'action': 'reduce_exposure', 'urgency': 'high'}} END, CASE WHEN worst < {mid} THEN {{'action': 'hedge_tail_risk', 'urgency': 'medium'}} END,
  {{'action': 'monitor_channels', 'urgency': 'low'}}], x -> x IS NOT NULL)) AS a FROM (SELECT scenario, min({expr}) AS worst FROM PJ GROUP BY 1))"""


@query(
    "custom_variant_projection", "P5 X4",
    f"""WITH {CG_SQL} SELECT name AS scenario, variant, floor(round(drawdown * m * 10, 6) + 0.5) / 10 AS projected_drawdown, CAST(floor(recovery_days * m + 0.5) AS BIGINT) AS recovery_days, round(greatest(0.3, 0.8 - (m - 1) * 0.2), 6) AS confidence
FROM CT CROSS JOIN (VALUES ('half', 0.5), ('extreme', 3.2)) v(variant, m)""",
)
def custom_variant_projection(spark: SparkSession, sf: str) -> DataFrame:
    crash, _, _ = _causal_graph(spark, sf)
    x = scenario.project(crash.select(F.col("name").alias("scenario"), "drawdown", "recovery_days"), (("half", 0.5), ("extreme", 3.2)))
    return x.withColumn("confidence", F.round("confidence", 6))


@query("scenario_recommendations", "X5", f"WITH {CG_SQL}, {_PROJ} " + _REC.format(hi=-30, mid=-15, expr="projected_drawdown").replace("x -> x", "lambda x: x"))
def scenario_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.recommend(_projected(spark, sf), ["scenario"])


@query("scenario_recommendations_by_size", "X5", f"WITH {CG_SQL}, {_PROJ} " + _REC.format(hi=-20, mid=-10, expr="-abs(projected_drawdown)").replace("x -> x", "lambda x: x"))
def scenario_recommendations_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.recommend_by_size(_projected(spark, sf), ["scenario"])


@query(
    "worst_historical_crashes", "O4 X4",
    f"WITH {CG_SQL} SELECT id, drawdown FROM CT ORDER BY drawdown, id LIMIT 5",
)
def worst_historical_crashes(spark: SparkSession, sf: str) -> DataFrame:
    return _causal_graph(spark, sf)[0].orderBy("drawdown", "id").limit(5).select("id", "drawdown")


@query(
    "simulated_outcomes", "X6",
    """SELECT 'plan ' || n_name AS scenario, 'out:' || c_custkey AS to_id, -c_acctbal / 1000 AS drawdown, 0.5 AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE contains('plan ' || lower(n_name), 'nation_2') ORDER BY drawdown, to_id LIMIT 10""",
)
def simulated_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    c, n = g.load(spark, sf, "customer"), g.load(spark, sf, "nation")
    none = F.lit(None).cast("double")
    plans = n.select(g.key("plan", "n_nationkey").alias("id"), F.lit("Scenario").alias("type"), F.concat(F.lit("plan "), "n_name").alias("name"), none.alias("drawdown"), none.alias("confidence"))
    out = c.select(g.key("out", "c_custkey").alias("id"), F.lit("SimulatedOutcome").alias("type"), F.lit("o").alias("name"), (-F.col("c_acctbal") / 1000).alias("drawdown"), F.lit(0.5).alias("confidence"))
    rel = c.select(g.key("plan", "c_nationkey").alias("from_id"), g.key("out", "c_custkey").alias("to_id"))
    return scenario.simulated_outcomes(rel, plans.unionByName(out), "nation_2")


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """One scenario per customer: magnitude and excitation from its balance and key."""
    c = g.load(spark, sf, "customer")
    # halves are frequent here: rounded on the binary value, as SQL does, not on its shortest decimal form
    magnitude = F.floor(F.col("c_acctbal") / 5000 * 100 + 0.5) / 100
    return c.select(
        g.key("sc", "c_custkey").alias("scenario_id"), F.when(F.col("c_acctbal") >= 0, magnitude).alias("magnitude"),
        ((F.col("c_custkey") % 10) / 10.0).alias("alpha"), (F.col("c_nationkey") + 4).alias("rounds"),
    )


_SC = "SC AS (SELECT 'sc:' || c_custkey AS scenario_id, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal / 5000, 2) END AS magnitude, (c_custkey % 10) / 10.0 AS alpha, c_nationkey + 4 AS rounds FROM customer)"
@query("scenario_drawdowns", "X7 X19", f"WITH {_SC} SELECT scenario_id, round(coalesce(magnitude, 0.5) * 15 * (alpha * rounds / 24 + 1), 6) AS raw_drawdown FROM SC")
def scenario_drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.closed_form(_scenarios(spark, sf)).select("scenario_id", F.round("raw_drawdown", 6).alias("raw_drawdown"))


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a landed action trace: a user's run, event types as agents, errors, views and clicks as sales."""
    sale = F.col("event_type").isin("error", "view", "click")
    return g.load(spark, sf, "events").select(
        F.col("user_id").alias("scenario_id"), F.col("event_id").alias("round"), F.col("event_type").alias("agent_id"), F.when(sale, "SELL").otherwise("HOLD").alias("action_type"), F.col("value").alias("intensity")
    )


@query(
    "scenario_trace_metrics", "A19",
    """SELECT user_id AS scenario_id, count(*) AS total_actions, round(max(value), 6) AS peak_intensity, count(DISTINCT event_type) FILTER (WHERE event_type IN ('error', 'view', 'click')) AS affected_agents FROM events GROUP BY 1""",
)
def scenario_trace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.trace_metrics(_trace(spark, sf)).withColumn("peak_intensity", F.round("peak_intensity", 6))


@query(
    "sell_runs", "W5",
    """WITH A AS (SELECT user_id AS scenario_id, event_id AS round, event_type IN ('error', 'view', 'click') AS hit FROM events),
B AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY scenario_id ORDER BY round) AS run_id, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY scenario_id) AS n FROM A)
SELECT scenario_id, run_id, min(round) AS start, count(*) AS length FROM B WHERE hit AND run_id < n GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def sell_runs(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.sell_runs(_trace(spark, sf))


@query(
    "scenario_participants", "X8",
    f"""WITH {_SC} SELECT scenario_id, kind, behaviour, round(alpha * a, 6) AS sensitivity, round(100 * a, 6) AS exposure FROM SC CROSS JOIN (VALUES ('Hedge Fund', 'aggressive', 0.8), ('Pension Fund', 'conservative', 0.3), ('Investment Bank', 'neutral', 0.6), ('Retail Investor', 'reactive', 0.5), ('Central Bank', 'stabilizer', 0.2), ('Regulator', 'interventionist', 0.1)) v(kind, behaviour, a)""",
)
def scenario_participants(spark: SparkSession, sf: str) -> DataFrame:
    x = scenario.participants(_scenarios(spark, sf))
    return x.select("scenario_id", "kind", "behaviour", F.round("sensitivity", 6).alias("sensitivity"), F.round("exposure", 6).alias("exposure"))


@query(
    "simulation_result_edges", "X9 M15 W9 T6",
    """WITH S AS (SELECT o_orderkey, 'cust:' || o_custkey AS c, 'supp:' || l_suppkey AS s, 'part:' || l_partkey AS p, l_linenumber AS ln, l_quantity / 50 AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT relation, f AS from_id, t AS to_id, round(weight, 6) AS weight, round(confidence, 6) AS confidence FROM (
  SELECT 'causes' AS relation, c AS f, p AS t, w AS weight, least(w * 1.5, 0.95) AS confidence FROM S UNION ALL SELECT 'enables', c, s, w * 0.8, least(w * 1.2, 0.9) FROM S UNION ALL SELECT 'enables', s, p, w * 0.8, least(w * 1.2, 0.9) FROM S)""",
)
def simulation_result_edges(spark: SparkSession, sf: str) -> DataFrame:
    x = g.load(spark, sf, "orders").join(g.load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    c, s, p = g.key("cust", "o_custkey"), g.key("supp", "l_suppkey"), g.key("part", "l_partkey")
    res = x.select(g.key("sim", "o_orderkey").alias("sim_id"), c.alias("from_id"), p.alias("to_id"), F.array(c, s, p).alias("path"), (F.col("l_quantity") / 50).alias("weight"))
    e = scenario.result_edges(res)
    return e.select("relation", "from_id", "to_id", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"))


@query(
    "scenario_plan_edges", "M16",
    """SELECT 'sc:' || c_custkey AS from_id, 'SCENARIO_PRODUCES' AS relation, 'out:' || c_custkey AS to_id, 0.9 AS confidence FROM customer UNION ALL SELECT 'plan:' || c_custkey, 'BASED_ON', 'crash:' || c_nationkey, 0.85 FROM customer
UNION ALL SELECT 'out:' || c_custkey, 'SIMULATED_IMPACT', unnest([c_name, c_mktsegment]), 0.8 FROM customer""",
)
def scenario_plan_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = g.load(spark, sf, "customer")
    plans = c.select(g.key("plan", "c_custkey").alias("plan_id"), g.key("sc", "c_custkey").alias("scenario_id"), g.key("out", "c_custkey").alias("outcome_id"), g.key("crash", "c_nationkey").alias("based_on"), F.array("c_name", "c_mktsegment").alias("names"))
    return scenario.plan_edges(plans)


@query(
    "regime_environment", "X10 J9",
    g.with_graph("""SELECT regime, n AS members, n = max(n) OVER () AS dominant, CASE regime WHEN 'stressed' THEN 2.5 WHEN 'pre_tipping' THEN 4.0 WHEN 'post_event' THEN 1.8 ELSE 1.0 END AS volatility_multiplier,
  CASE regime WHEN 'stressed' THEN 'high' WHEN 'pre_tipping' THEN 'extreme' WHEN 'post_event' THEN 'decaying' ELSE 'low' END AS correlation, CASE regime WHEN 'stressed' THEN 'tight' WHEN 'pre_tipping' THEN 'frozen' WHEN 'post_event' THEN 'recovering' ELSE 'normal' END AS liquidity,
  CASE regime WHEN 'normal' THEN 5.0 ELSE 2.0 END AS max_leverage, regime <> 'pre_tipping' AS short_selling, CASE regime WHEN 'stressed' THEN -0.07 ELSE -0.1 END AS circuit_breaker, -0.2 AS forced_liquidation
FROM (SELECT regime, count(*) AS n FROM E WHERE regime IS NOT NULL GROUP BY 1)"""),
)
def regime_environment(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.regime_environment(g.entities(spark, sf))


@query(
    "channel_activity", "J9",
    f"WITH {CG_SQL} SELECT id, name, (SELECT count(*) FROM CR JOIN nation ON from_id = 'crash:' || n_nationkey AND n_regionkey > 1 WHERE relation = 'TRANSMITTED_THROUGH' AND to_id = CE.id) AS active_events FROM CE WHERE type = 'RiskChannel'",
)
def channel_activity(spark: SparkSession, sf: str) -> DataFrame:
    _, ent, rel = _causal_graph(spark, sf)
    ev = g.load(spark, sf, "nation").select(g.key("crash", "n_nationkey").alias("id"), F.when(F.col("n_regionkey") > 1, F.lit("2008-01-01")).alias("start_date"))
    return scenario.channel_activity(ent, rel, ev)


def _channel_sql() -> str:
    """Channel-restricted propagation written out, over purchases and places, for stressed companies."""
    f = "CASE WHEN regime IN ('stressed', 'pre_tipping') THEN 1.5 ELSE 1.0 END"
    v = f"""PR AS (SELECT *, CASE relation WHEN 'purchases_from' THEN 'credit' ELSE 'sentiment' END AS ch FROM R WHERE relation IN ('purchases_from', 'located_in')),
VR AS (SELECT * FROM (VALUES ('mild', 0.5, ['sentiment']), ('severe', 1.5, ['credit', 'liquidity', 'sentiment']), ('systemic', 2.0, ['credit', 'liquidity', 'sentiment', 'counterparty'])) v(vn, m, chs)),
L0 AS (SELECT id || '/' || vn AS seed, id AS node, chs, CAST(m * {f} AS DOUBLE) AS impact FROM E CROSS JOIN VR WHERE type = 'Company' AND regime = 'stressed'), S0 AS (SELECT seed, node FROM L0), D0 AS (SELECT seed, 0 AS used FROM L0)"""
    for i in (1, 2):
        v += f""",
V{i} AS (SELECT * FROM (SELECT f.seed, r.to_id AS node, f.impact, f.chs, r.confidence AS c, r.from_id AS p, r.relation AS rl, row_number() OVER (PARTITION BY f.seed, r.to_id ORDER BY r.confidence DESC, r.from_id, r.relation) AS rn
  FROM L{i - 1} f JOIN PR r ON r.from_id = f.node AND list_contains(f.chs, r.ch) WHERE NOT EXISTS (SELECT 1 FROM S{i - 1} s WHERE s.seed = f.seed AND s.node = r.to_id)) WHERE rn = 1),
K{i} AS (SELECT v.seed, v.node, v.chs, v.impact * 0.7 * {f} AS impact, v.c, v.p, v.rl FROM V{i} v JOIN E e ON e.id = v.node),
L{i} AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.seed ORDER BY c DESC, p, rl, node) + used AS rk FROM K{i} k JOIN D{i - 1} d ON d.seed = k.seed WHERE abs(impact) > 0.05) WHERE rk <= 50),
S{i} AS (SELECT * FROM S{i - 1} UNION ALL SELECT seed, node FROM K{i}), D{i} AS (SELECT seed, max(used) AS used FROM (SELECT * FROM D{i - 1} UNION ALL SELECT seed, max(rk) FROM L{i} GROUP BY 1) GROUP BY 1)"""
    return g.with_graph(
        "SELECT seed, level, count(*) AS n, round(sum(floor(impact * 1000 + 0.5) / 1000), 3) AS impact FROM (SELECT seed, 1 AS level, impact FROM L1 UNION ALL SELECT seed, 2, impact FROM L2) GROUP BY 1, 2", v
    )


@query("channel_restricted_shocks", "X11", _channel_sql())
def channel_restricted_shocks(spark: SparkSession, sf: str) -> DataFrame:
    ent = g.entities(spark, sf)
    rel = g.relationships(spark, sf, ["purchases_from", "located_in"]).withColumn("channel", F.when(F.col("relation") == "purchases_from", "credit").otherwise("sentiment"))
    seeds = scenario.channel_shocks(ent.filter("type = 'Company' and regime = 'stressed'").select(F.col("id").alias("seed"), "id"))
    x = paths.propagate(seeds, rel, ent, depth=2, cap=paths.AFFECTED_CAP, edge_channel="channel")
    return x.groupBy("seed", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("residual_impact"), 3).alias("impact"))


# --- policies -----------------------------------------------------------------------------------------


def _policy_sql(rows: list[tuple[str, int, list[tuple[str, str, int]]]], types: str = "") -> str:
    """Policy check for the governed types of the view, untyped."""
    tot = ", ".join(f"('{t}', {m})" for t, m, _ in rows)
    req = ", ".join(f"('{t}', {i}, '{r}', '{tt}', {n})" for t, _, rs in rows for i, (r, tt, n) in enumerate(rs))
    return g.with_graph(
        f"""SELECT e.id, e.type, coalesce(n, 0) AS total, min_edges, coalesce(missing, '') AS missing, missing IS NULL AND coalesce(n, 0) >= min_edges AS compliant
FROM E e JOIN PT ON PT.type = e.type LEFT JOIN (SELECT from_id, count(*) AS n FROM R GROUP BY 1) c ON c.from_id = e.id LEFT JOIN GP ON GP.id = e.id""",
        f"PT AS (SELECT * FROM (VALUES {tot}) v(type, min_edges)), PQ AS (SELECT * FROM (VALUES {req}) v(type, req, relation, tt, mn))",
        """GP AS (SELECT id, string_agg((mn - n) || ' more ' || relation || ' to ' || tt, '; ' ORDER BY req) AS missing FROM (
  SELECT e.id, req, q.relation, tt, mn, count(r.to_id) AS n FROM E e JOIN PQ q ON q.type = e.type LEFT JOIN R r ON r.from_id = e.id AND r.relation = q.relation GROUP BY 1, 2, 3, 4, 5) WHERE n < mn GROUP BY 1)""",
    )


@query(
    "edge_policy", "X12",
    _policy_sql([("Corporation", 5, [("headquartered_in", "Location", 1), ("operates_in", "Industry", 1), ("competes_with", "Corporation", 2)]), ("Industry", 5, [("contains", "Corporation", 3)])]),
)
def edge_policy(spark: SparkSession, sf: str) -> DataFrame:
    return policy.check_policy(g.entities(spark, sf), g.relationships(spark, sf), policy.EDGE_POLICY, typed=False)


@query(
    "connection_budget", "X14",
    _policy_sql([("Corporation", 5, [("headquartered_in", "Location", 1), ("operates_in", "Industry", 1), ("competes_with", "Corporation", 2)]), ("Industry", 4, [("contains", "Corporation", 3)])]),
)
def connection_budget(spark: SparkSession, sf: str) -> DataFrame:
    return policy.check_policy(g.entities(spark, sf), g.relationships(spark, sf), policy.CONNECTION_BUDGET, typed=False)


@query(
    "typed_policy", "X13",
    f"""WITH {CG_SQL} SELECT id, type, coalesce(n, 0) AS total, 8 AS min_edges, (CASE WHEN crashed < 5 THEN (5 - crashed) || ' more CRASHED to Corporation/Company/Asset/FinancialInstitution; ' ELSE '' END) || '2 more TRANSMITTED_THROUGH to Channel; 1 more DRIVES_NARRATIVE to Narrative; 1 more IN_REGIME to Regime; 1 more PART_OF_CHAIN to CausalChain' AS missing, false AS compliant
FROM (SELECT id, type, (SELECT count(*) FROM CR WHERE from_id = CT.id) AS n, (SELECT count(*) FROM CR WHERE from_id = CT.id AND relation = 'impacts') AS crashed FROM CT)""",
)
def typed_policy(spark: SparkSession, sf: str) -> DataFrame:
    _, ent, rel = _causal_graph(spark, sf)
    named = rel.withColumn("relation", F.when(F.col("relation") == "impacts", "CRASHED").otherwise(F.col("relation")))
    return policy.check_policy(ent, named, policy.REGIME_POLICY, typed=True)


@query(
    "event_pattern_edges", "X15",
    """WITH EV AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'fed_decision' WHEN 'O' THEN 'product_launch' ELSE 'nothing' END AS cat FROM orders)
SELECT source, relation, to_type, count(*) AS n FROM (SELECT 'macro_event:' || cat AS source, s.r AS relation, s.t AS to_type, least(s.m, x.n) AS m FROM EV JOIN (VALUES ('fed_decision', 'issued_by', 'CentralBank', 1), ('fed_decision', 'impacts', 'Corporation', 10), ('fed_decision', 'affects', 'Industry', 4), ('fed_decision', 'moves', 'Asset', 5), ('fed_decision', 'signals', 'Narrative', 2),
  ('product_launch', 'announced_by', 'Corporation', 1), ('product_launch', 'impacts', 'Corporation', 5), ('product_launch', 'affects', 'Industry', 3), ('product_launch', 'involves', 'Person', 2)) s(c, r, t, m) ON s.c = cat JOIN (VALUES ('impacts', 7), ('affects', 2), ('involves', 3)) x(r, n) ON x.r = s.r), range(100) u(i) WHERE i < m GROUP BY 1, 2, 3""",
)
def event_pattern_edges(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda p, n: F.array(*[F.lit(f"{p}{i}") for i in range(n)])
    m = F.create_map(F.lit("impacts"), names("firm", 7), F.lit("affects"), names("sector", 2), F.lit("involves"), names("who", 3))
    s = F.col("o_orderstatus")
    cat = F.when(s == "F", "fed_decision").when(s == "O", "product_launch").otherwise("nothing")
    ev = g.load(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), cat.alias("category"), m.alias("targets"))
    return policy.event_edges(ev).groupBy("source", "relation", "to_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_density_repair", "X16 C18",
    """SELECT 'cust:' || c_custkey AS from_id, relation, to_id, confidence FROM (
  SELECT c_custkey, 'TRANSMITS_THROUGH' AS relation, unnest(CASE WHEN c_acctbal < 0 THEN ['channel-credit', 'channel-liquidity', 'channel-sentiment'] ELSE ['channel-supply-chain', 'channel-regulation'] END) AS to_id, 0.7 AS confidence FROM customer
  UNION ALL SELECT c_custkey, 'DRIVES_NARRATIVE', 'narr-auto-' || substr(md5('Impact of ' || c_name), 1, 8), 0.6 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, 'IN_REGIME', CASE WHEN c_acctbal < 0 THEN 'regime-pre-tipping' ELSE 'regime-normal' END, 0.8 FROM customer)""",
)
def event_density_repair(spark: SparkSession, sf: str) -> DataFrame:
    low = F.col("c_acctbal") < 0
    ev = g.load(spark, sf, "customer").select(
        g.key("cust", "c_custkey").alias("event_id"), F.col("c_name").alias("name"), F.when(low, F.array(F.lit("credit"))).otherwise(F.array(F.lit("supply_chain"), F.lit("regulation"))).alias("channels"),
        F.when(~low, F.array(F.lit("told"))).alias("narratives"), F.when(low, F.lit("pre_tipping")).alias("regime"),
    )
    return policy.density_repair(ev)


@query(
    "mission_roles", "X17 U5",
    """SELECT array_to_string(CASE WHEN len(l) = 0 THEN ['cultural_analyst'] ELSE l END, ',') AS roles, count(*) AS n FROM (SELECT list_filter([CASE WHEN contains(t, 'thing') OR contains(t, 'ention') THEN 'english' END, CASE WHEN contains(t, 'eaux') THEN 'french' END, CASE WHEN contains(t, 'ung') OR contains(t, 'lich') THEN 'german' END], lambda x: x IS NOT NULL) AS l
  FROM (SELECT lower(text) AS t FROM documents UNION ALL SELECT lower(text) FROM conversations)) GROUP BY 1""",
)
def mission_roles(spark: SparkSession, sf: str) -> DataFrame:
    roles = {"english": ("thing", "ention"), "french": ("eaux",), "german": ("ung", "lich")}
    t = g.load(spark, sf, "documents").select("text").unionByName(g.load(spark, sf, "conversations").select("text"))
    return policy.label_roles(t, "text", roles).groupBy(F.array_join("roles", ",").alias("roles")).agg(F.count(F.lit(1)).alias("n"))


_ROLE_SQL = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{r}' END" for r, ws in policy.ROLE_KEYWORDS.items()
)


@query(
    "mission_roles_default_table", "X17",
    f"SELECT array_to_string(CASE WHEN len(l) = 0 THEN ['cultural_analyst'] ELSE l END, ',') AS roles, count(*) AS n FROM (SELECT list_filter([{_ROLE_SQL}], lambda x: x IS NOT NULL) AS l FROM (SELECT lower(text) AS t FROM documents)) GROUP BY 1",
)
def mission_roles_default_table(spark: SparkSession, sf: str) -> DataFrame:
    return policy.label_roles(g.load(spark, sf, "documents"), "text").groupBy(F.array_join("roles", ",").alias("roles")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "data_quality", "X18",
    g.with_graph("""SELECT 'unknown_type' AS issue, type AS item, count(*) AS n FROM E WHERE type NOT IN ('Company', 'Corporation', 'Nation', 'Region', 'Product') GROUP BY type UNION ALL SELECT 'unknown_relation', relation, count(*) FROM R WHERE relation NOT IN ('located_in', 'part_of') GROUP BY relation
UNION ALL SELECT 'orphan_end', relation, sum(CAST(f IS NULL AS INT) + CAST(t IS NULL AS INT)) FROM (SELECT relation, a.id AS f, b.id AS t FROM R LEFT JOIN (SELECT id FROM E WHERE type <> 'Industry') a ON a.id = from_id LEFT JOIN (SELECT id FROM E WHERE type <> 'Industry') b ON b.id = to_id) WHERE f IS NULL OR t IS NULL GROUP BY relation""").replace(
        "FROM E WHERE type NOT IN ('Company'", "FROM E WHERE type <> 'Industry' AND type NOT IN ('Company'"
    ),
)
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    types = spark.createDataFrame([(t,) for t in ("Company", "Corporation", "Nation", "Region", "Product")], "type string")
    rels = spark.createDataFrame([("located_in",), ("part_of",)], "relation string")
    return policy.data_quality(g.entities(spark, sf).filter("type <> 'Industry'"), g.relationships(spark, sf), types, rels)


@query(
    "simulation_boundary", "F6 X18",
    """SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN c_acctbal < 0 AND s_acctbal >= 0 AND r <> 'READS_FROM' THEN 'simulation may only READS_FROM reality' WHEN c_acctbal >= 0 AND s_acctbal < 0 THEN 'reality may not point at simulation' END AS reason
  FROM (SELECT c_acctbal, s_acctbal, CASE WHEN o_orderstatus = 'F' THEN 'READS_FROM' ELSE 'buys' END AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)) GROUP BY 1""",
)
def simulation_boundary(spark: SparkSession, sf: str) -> DataFrame:
    sim = lambda b, other: F.when(F.col(b) < 0, "SimAgent").otherwise(other)
    c = g.load(spark, sf, "customer").select(g.key("cust", "c_custkey").alias("id"), sim("c_acctbal", "Company").alias("type"))
    s = g.load(spark, sf, "supplier").select(g.key("supp", "s_suppkey").alias("id"), sim("s_acctbal", "Corporation").alias("type"))
    x = g.load(spark, sf, "orders").join(g.load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rel = x.select(g.key("cust", "o_custkey").alias("from_id"), F.when(F.col("o_orderstatus") == "F", "READS_FROM").otherwise("buys").alias("relation"), g.key("supp", "l_suppkey").alias("to_id"))
    return lookup.boundary_check(rel, c.unionByName(s)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sparse_entities", "F5 O7",
    g.with_graph("""SELECT e.id, coalesce(d, 0) AS degree FROM E e LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT from_id AS id FROM R WHERE relation = 'located_in' UNION ALL SELECT to_id FROM R WHERE relation = 'located_in') GROUP BY 1) g ON g.id = e.id WHERE coalesce(d, 0) < 5"""),
)
def sparse_entities(spark: SparkSession, sf: str) -> DataFrame:
    from ripplegraph.operators.stats import degrees

    return lookup.sparse_entities(g.entities(spark, sf), degrees(g.relationships(spark, sf, ["located_in"]))).select("id", "degree")


@query(
    "placeholder_filter", "F12",
    "SELECT c_mktsegment AS type, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1",
)
def placeholder_filter(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    e = g.load(spark, sf, "customer").select(F.when(seg == "BUILDING", F.when(F.col("c_acctbal") < 5000, "  ").otherwise("Placeholder")).otherwise(F.col("c_name")).alias("name"), seg.alias("type"))
    return lookup.drop_placeholders(e).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "autonomous_agents", "F13",
    "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1",
)
def autonomous_agents(spark: SparkSession, sf: str) -> DataFrame:
    org = g.load(spark, sf, "supplier").withColumn("org_type", F.when(F.col("s_acctbal") > 5000, "AutonomousAgent").otherwise("Corporation"))
    return lookup.autonomous_agents(org).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "simulation_result_signals", "M15 X9",
    """SELECT 'signal' AS kind, 'sim_prediction:' || o_orderpriority AS label, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2
UNION ALL SELECT 'regime', CASE s WHEN 'F' THEN 'stressed' WHEN 'O' THEN 'normal' ELSE 'post_event' END, count(*), 0 FROM (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_totalprice)) AS s FROM orders GROUP BY 1) GROUP BY 2""",
)
def simulation_result_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    regime = F.when(s == "F", "stressed").when(s == "O", "normal").otherwise("post_event")
    who = g.key("cust", "o_custkey")
    pred = F.struct(who.alias("entity"), F.col("o_orderpriority").alias("horizon"), F.col("o_totalprice").alias("predicted_value"), F.lit(0.6).alias("confidence"))
    move = F.struct(who.alias("entity"), regime.alias("to_regime"), F.col("o_totalprice").alias("probability"))
    res = g.load(spark, sf, "orders").select(g.key("sim", "o_orderkey").alias("sim_id"), F.array(pred).alias("predictions"), F.array(move).alias("regime_transitions"), F.col("o_orderdate").alias("completed_at"))
    sig = scenario.result_signals(res).groupBy(F.lit("signal").alias("kind"), F.col("metric").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    reg = scenario.result_regimes(res).groupBy(F.lit("regime").alias("kind"), F.col("regime").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total"))
    return sig.unionByName(reg)


# --- exports ------------------------------------------------------------------------------------------


@query(
    "ontology_export", "K5 F8",
    g.with_graph("""SELECT 'entity' AS kind, type AS label, count(*) AS n FROM E GROUP BY type UNION ALL SELECT 'edge', a.type || ' ' || relation || ' ' || b.type, count(*) FROM R JOIN E a ON a.id = from_id JOIN E b ON b.id = to_id GROUP BY 2"""),
)
def ontology_export(spark: SparkSession, sf: str) -> DataFrame:
    return export.ontology(g.entities(spark, sf), g.relationships(spark, sf))


@query(
    "sentence_export", "K6",
    g.with_graph("""SELECT name || ' is a ' || type || '.' AS sentence FROM E UNION ALL SELECT a.name || ' ' || replace(relation, '_', ' ') || ' ' || b.name || '.' FROM R JOIN E a ON a.id = from_id JOIN E b ON b.id = to_id"""),
)
def sentence_export(spark: SparkSession, sf: str) -> DataFrame:
    return export.sentences(g.entities(spark, sf), g.relationships(spark, sf))


@query(
    "key_value_export", "K2 K3",
    g.with_graph("SELECT 'graph:entity:' || name AS key FROM E UNION ALL SELECT 'graph:edge:' || from_id || ':' || relation || ':' || to_id FROM R UNION ALL SELECT entity || '>' || target FROM CL", g.CLAIM_SQL),
)
def key_value_export(spark: SparkSession, sf: str) -> DataFrame:
    cl = export.claims_as_relationships(g.claims(spark, sf)).select(F.concat_ws(">", "from", "to").alias("key"))
    return export.entity_keys(g.entities(spark, sf)).select("key").unionByName(export.edge_keys(g.relationships(spark, sf)).select("key")).unionByName(cl)


@query(
    "vocabulary_export", "K7",
    g.with_graph("""SELECT CASE type WHEN 'Company' THEN 'FIRM' WHEN 'Corporation' THEN 'FIRM' WHEN 'FinancialInstitution' THEN 'BANK' WHEN 'Industry' THEN 'SECTOR' ELSE 'GENERIC' END AS export_type, count(*) AS n FROM E GROUP BY 1"""),
)
def vocabulary_export(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.export_vocabulary(g.entities(spark, sf)).groupBy("export_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "backup_export", "K1 K4",
    g.with_graph("SELECT 'entities' AS part, type AS label, count(*) AS n FROM E GROUP BY type UNION ALL SELECT 'relationships', relation, count(*) FROM R GROUP BY relation"),
)
def backup_export(spark: SparkSession, sf: str) -> DataFrame:
    from ripplegraph.session import scratch_path

    path = scratch_path(spark, "backup")
    export.write_labelled(g.entities(spark, sf), g.relationships(spark, sf), path)
    export.write_backup(g.entities(spark, sf), g.relationships(spark, sf), f"{path}/full")
    back = spark.read.schema("id string, type string, name string, confidence double, regime string").json(f"{path}/full/entities")
    n = back.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("entities"))
    e = spark.read.parquet(f"{path}/edges").groupBy(F.col("relation").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("relationships"))
    return n.unionByName(e).select("part", "label", "n")


@query(
    "backup_restore", "K1 S5 M6",
    g.with_graph("""SELECT id, type, name, round(confidence, 6) AS confidence, stub, coalesce(n, 0) AS n_edges, round(coalesce(c, 0), 4) AS edge_confidence FROM (
  SELECT id, type, name, confidence, false AS stub FROM E WHERE type IN ('Company', 'Corporation', 'FinancialInstitution')
  UNION ALL SELECT id, type, name, CAST(0.1 AS DOUBLE), false FROM E WHERE type IN ('Nation', 'Region')
  UNION ALL SELECT id, 'Unknown', id, CAST(0 AS DOUBLE), true FROM E WHERE type NOT IN ('Company', 'Corporation', 'FinancialInstitution', 'Nation', 'Region') AND id IN (SELECT from_id FROM R UNION SELECT to_id FROM R)) x
LEFT JOIN (SELECT from_id AS id, count(*) AS n, sum(confidence) AS c FROM R GROUP BY 1) USING (id)"""),
)
def backup_restore(spark: SparkSession, sf: str) -> DataFrame:
    """A backup of firms and of all edges is written, read and restored into a store of places with old edges."""
    from ripplegraph.operators import merge
    from ripplegraph.session import in_pass, materialize_passes, passes_for, scratch_path

    ent, rel, path = g.entities(spark, sf), g.relationships(spark, sf), scratch_path(spark, "backup")
    export.write_backup(ent.filter(F.col("type").isin("Company", "Corporation", "FinancialInstitution")), rel, path)
    saved, saved_rel = export.read_backup(spark, path)
    store = ent.filter(F.col("type").isin("Nation", "Region")).withColumn("confidence", F.lit(0.1))
    old = g.relationships(spark, sf, ["located_in"]).withColumn("confidence", F.lit(0.2))
    nodes, edges = merge.restore(store, old, saved, saved_rel)
    p = passes_for(rel.count())
    sums = lambda df: df.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("confidence"), 4).alias("edge_confidence"))
    n = materialize_passes(lambda i: sums(edges.filter(in_pass("from_id", i, p))), p, "edges-by-end").drop("pass")
    return nodes.join(n, "id", "left").select("id", "type", "name", F.round("confidence", 6).alias("confidence"), "stub", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("edge_confidence", F.lit(0.0)).alias("edge_confidence"))


@query(
    "entities_by_id", "M7",
    g.with_graph("""SELECT q.id, E.type, E.name, E.id IS NOT NULL AS found FROM (SELECT DISTINCT 'supp:' || l_suppkey AS id FROM lineitem UNION SELECT DISTINCT 'order:' || l_orderkey FROM lineitem) q LEFT JOIN E ON E.id = q.id"""),
)
def entities_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and orders of all line items, asked for by id; orders are no entities."""
    line = g.load(spark, sf, "lineitem")
    ids = line.select(F.explode(F.array(g.key("supp", "l_suppkey"), g.key("order", "l_orderkey"))).alias("id"))
    return lookup.by_ids(g.entities(spark, sf), ids).select("id", "type", "name", "found")
