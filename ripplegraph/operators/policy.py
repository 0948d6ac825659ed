"""Graph-quality policies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.identity import md5_id
from ripplegraph.functions.text import lookup_column
from ripplegraph.sources.feeds import CHANNEL_IDS, REGIME_IDS

# Fixed values: (entity type, minimum edges, required (relation, target types, minimum)).
EDGE_POLICY = (
    ("Corporation", 5, (("headquartered_in", ("Location",), 1), ("operates_in", ("Industry",), 1), ("competes_with", ("Corporation",), 2))),
    ("MacroEvent", 8, (("impacts", ("Corporation",), 3), ("affects", ("Industry",), 2), ("occurs_in", ("Location",), 1))),
    ("Person", 4, (("works_at", ("Corporation",), 1),)),
    ("Industry", 5, (("contains", ("Corporation",), 3),)),
    ("Asset", 4, (("issued_by", ("Corporation",), 1),)),
    ("Government", 5, (("governs", ("Location",), 1),)),
)
CONNECTION_BUDGET = (
    ("Corporation", 5, (("headquartered_in", ("Location",), 1), ("operates_in", ("Industry",), 1), ("competes_with", ("Corporation",), 2))),
    ("MacroEvent", 8, (("affects", ("Industry",), 2), ("involves", ("Location",), 1), ("impacts", ("Corporation",), 3))),
    ("Industry", 4, (("contains", ("Corporation",), 3),)),
    ("Location", 3, ()),
    ("Asset", 4, (("issued_by", ("Corporation",), 1), ("traded_in", ("Location",), 1))),
    ("Person", 3, (("works_at", ("Corporation",), 1),)),
    ("Government", 4, (("governs", ("Location",), 1),)),
)
REGIME_POLICY = (
    ("MacroEvent", 5, (
        ("impacts", ("Corporation", "Company", "FinancialInstitution", "Asset"), 3), ("affects", ("Industry", "EconomicSector"), 2), ("TRANSMITS_THROUGH", ("Channel",), 2),
        ("DRIVES_NARRATIVE", ("Narrative",), 1), ("IN_REGIME", ("Regime",), 1),
    )),
    ("MarketCrash", 8, (
        ("CRASHED", ("Corporation", "Company", "Asset", "FinancialInstitution"), 5), ("TRANSMITTED_THROUGH", ("Channel",), 2), ("DRIVES_NARRATIVE", ("Narrative",), 1),
        ("IN_REGIME", ("Regime",), 1), ("PART_OF_CHAIN", ("CausalChain",), 1),
    )),
    ("Channel", 5, (("CHANNEL_AFFECTS", ("Corporation", "Asset", "Industry"), 3),)),
    ("Narrative", 2, (("NARRATIVE_INFLUENCES", ("Corporation", "Asset", "Industry"), 2),)),
    ("Portfolio", 1, (("PORTFOLIO_HOLDS", ("Corporation", "Asset"), 1), ("PORTFOLIO_EXPOSED_TO", ("Channel",), 1))),
    ("DataSource", 1, (("EXTRACTED_FROM", ("RawData",), 1),)),
)
# Event category -> slots (relation, target type, most targets).
EVENT_PATTERNS = {
    "fed_decision": (("issued_by", "CentralBank", 1), ("impacts", "Corporation", 10), ("affects", "Industry", 4), ("moves", "Asset", 5), ("signals", "Narrative", 2)),
    "earnings_report": (("reported_by", "Corporation", 1), ("impacts", "Corporation", 5), ("affects", "Industry", 2), ("moves", "Asset", 3), ("involves", "Person", 2)),
    "ma_announcement": (("involves", "Corporation", 3), ("impacts", "Corporation", 5), ("affects", "Industry", 3), ("involves", "Person", 3), ("signals", "Narrative", 2)),
    "regulatory_action": (("issued_by", "Government", 1), ("targets", "Corporation", 5), ("affects", "Industry", 3), ("occurs_in", "Location", 2), ("signals", "Narrative", 2)),
    "geopolitical_event": (("involves", "Government", 5), ("occurs_in", "Location", 3), ("impacts", "Corporation", 10), ("affects", "Industry", 5), ("moves", "Asset", 5), ("signals", "Narrative", 3)),
    "economic_data": (("issued_by", "Government", 1), ("occurs_in", "Location", 1), ("affects", "Industry", 5), ("moves", "Asset", 5), ("signals", "Narrative", 2)),
    "product_launch": (("announced_by", "Corporation", 1), ("impacts", "Corporation", 5), ("affects", "Industry", 3), ("involves", "Person", 2)),
    "supply_disruption": (("occurs_in", "Location", 3), ("impacts", "Corporation", 10), ("affects", "Industry", 5), ("involves", "Government", 2), ("signals", "Narrative", 2)),
}
# Role -> keywords of a mission text.
ROLE_KEYWORDS = {
    "cultural_analyst": ("cultural", "perception", "gdelt", "values", "belief", "identity", "cross-cultural", "how does", "perceive", "attitude toward"),
    "brand_strategist": ("brand", "marketing", "sell", "product", "consumer", "luxury", "fashion", "advertising", "campaign", "target audience"),
    "geo_cartographer": ("geo", "location", "city", "region", "country", "population", "osm", "map", "where", "geographic", "district", "village"),
    "narrative_tracker": ("narrative", "story", "discourse", "sentiment", "reddit", "social", "public opinion", "talk about", "trending", "viral"),
    "identity_modeller": ("identity", "belong", "group", "tribe", "community", "values survey", "world values", "demographic", "psychographic"),
    "prediction_validator": ("predict", "forecast", "price", "will", "expect", "signal", "validate", "resolution", "backtest"),
    "simulation_seeder": ("simulate", "oasis", "what-if", "scenario", "digital twin"),
}
DEFAULT_ROLE = "cultural_analyst"

Policy = tuple[tuple[str, int, tuple[tuple[str, tuple[str, ...], int], ...]], ...]


def policy_frames(spark: SparkSession, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """A policy as (type, min_edges) and (type, req, relation, target_type, target_types, min_count), a few rows each."""
    totals = spark.createDataFrame([(t, m) for t, m, _ in policy], "type string, min_edges int")
    rows = [(t, i, r, tt, "/".join(types), n) for t, _, reqs in policy for i, (r, types, n) in enumerate(reqs) for tt in types]
    return totals, spark.createDataFrame(rows, "type string, req int, relation string, target_type string, target_types string, min_count int")


def check_policy(ent: DataFrame, rel: DataFrame, policy: Policy, typed: bool) -> DataFrame:
    """Every entity of a governed type with its edges, what is missing and whether it complies.

    ``typed`` also requires the neighbour to have one of the target types.  Edges are counted per
    (entity, relation[, neighbour type]) before they meet the requirements.
    """
    totals, reqs = policy_frames(ent.sparkSession, policy)
    e = ent.select("id", "type").join(totals, "type")
    edges = rel.select(F.col("from_id").alias("id"), "relation", "to_id")
    counts = edges.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    if typed:
        kinds = edges.join(ent.select(F.col("id").alias("to_id"), F.col("type").alias("target_type")), "to_id")
        per, on = kinds.groupBy("id", "relation", "target_type").agg(F.count(F.lit(1)).alias("n")), ["id", "relation", "target_type"]
        need = reqs
    else:
        per, on = edges.groupBy("id", "relation").agg(F.count(F.lit(1)).alias("n")), ["id", "relation"]
        need = reqs.select("type", "req", "relation", "target_types", "min_count").distinct()
    have = e.select("id", "type").join(need, "type").join(per, on, "left")
    gap = have.groupBy("id", "req", "relation", "target_types", "min_count").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    gap = gap.filter(F.col("n") < F.col("min_count")).withColumn("text", F.format_string("%d more %s to %s", F.col("min_count") - F.col("n"), F.col("relation"), F.col("target_types")))
    # at most as many gaps as the policy has requirements
    gaps = gap.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("req", "text"))), lambda x: x["text"]), "; ").alias("missing"))
    x = e.join(counts, "id", "left").join(gaps, "id", "left")
    total = F.coalesce("total", F.lit(0))
    return x.select("id", "type", total.alias("total"), "min_edges", F.coalesce("missing", F.lit("")).alias("missing"), (F.col("missing").isNull() & (total >= F.col("min_edges"))).alias("compliant"))


def event_edges(events: DataFrame) -> DataFrame:
    """events(event_id, category, targets map<relation, array<name>>) -> one edge per slot target, .9."""
    slots = [
        F.struct(F.lit(c).alias("category"), F.lit(r).alias("relation"), F.lit(t).alias("target_type"), F.lit(n).alias("most")) for c, ss in EVENT_PATTERNS.items() for r, t, n in ss
    ]
    x = events.withColumn("s", F.explode(F.filter(F.array(*slots), lambda s: s["category"] == F.col("category"))))
    names = F.slice(F.coalesce(F.element_at("targets", F.col("s.relation")), F.array().cast("array<string>")), F.lit(1), F.col("s.most"))
    return x.select(
        F.col("event_id").alias("from_id"), F.col("s.relation").alias("relation"), F.col("s.target_type").alias("to_type"), F.explode(names).alias("to_name"),
        F.lit(0.9).alias("confidence"), F.concat(F.lit("macro_event:"), "category").alias("source"),
    )


def density_repair(events: DataFrame) -> DataFrame:
    """Links that a sparse event is given: events(event_id, name, channels, narratives, regime).

    Fewer than two channels gain sentiment and liquidity; the first four in name order are linked
    (.7); no narrative gives an automatic one (.6); the regime is always linked (.8).
    """
    ch = F.coalesce("channels", F.array().cast("array<string>"))
    ch = F.when(F.size(ch) < 2, F.array_sort(F.array_union(ch, F.array(F.lit("sentiment"), F.lit("liquidity"))))).otherwise(ch)
    link = lambda to, rel, c: F.struct(to.alias("to_id"), F.lit(rel).alias("relation"), F.lit(c).alias("confidence"))
    chans = F.transform(F.slice(ch, 1, 4), lambda c: link(lookup_column(CHANNEL_IDS, c), "TRANSMITS_THROUGH", 0.7))
    auto = F.concat(F.lit("Impact of "), "name")
    story = F.when(F.size(F.coalesce("narratives", F.array().cast("array<string>"))) == 0, F.array(link(md5_id("narr-auto", auto, 8), "DRIVES_NARRATIVE", 0.6)))
    regime = F.array(link(lookup_column(REGIME_IDS, F.coalesce("regime", F.lit("normal")), REGIME_IDS["normal"]), "IN_REGIME", 0.8))
    links = F.concat(F.filter(chans, lambda x: x["to_id"].isNotNull()), F.coalesce(story, F.array()), regime)
    return events.select(F.col("event_id").alias("from_id"), F.explode(links).alias("l")).select("from_id", "l.relation", "l.to_id", "l.confidence")


def label_roles(texts: DataFrame, text: str, roles: dict[str, tuple[str, ...]] | None = None, default: str = DEFAULT_ROLE) -> DataFrame:
    """Role labels of a text by contained keywords, else the default; a row expression, no join.

    The text is lowered once, and a role's keywords are tried until one is found.
    """
    x = texts.withColumn("_t", F.lower(text))
    label = lambda role, ws: F.when(reduce(or_, [F.contains(F.col("_t"), F.lit(w)) for w in ws]), F.lit(role))
    found = F.filter(F.array(*[label(r, ws) for r, ws in (roles or ROLE_KEYWORDS).items()]), lambda r: r.isNotNull())
    x = x.withColumn("_f", found).drop("_t")
    return x.withColumn("roles", F.when(F.size("_f") == 0, F.array(F.lit(default))).otherwise(F.col("_f"))).drop("_f")


def data_quality(ent: DataFrame, rel: DataFrame, types: DataFrame, relations: DataFrame) -> DataFrame:
    """(issue, item, n): types and relations missing from the dimension tables, edges with a missing end."""
    t = ent.join(types, "type", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_type").alias("issue"), F.col("type").alias("item"), "n")
    r = rel.join(relations, "relation", "left_anti").groupBy("relation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_relation").alias("issue"), F.col("relation").alias("item"), "n")
    ids = ent.select("id")
    orphan = rel.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select("relation").unionByName(
        rel.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("relation")
    )
    o = orphan.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_end").alias("issue"), F.col("relation").alias("item"), "n")
    return t.unionByName(r).unionByName(o)
