"""Name lookup and entity filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.common import scalar, top_k

# Entity type groups used by lookups.
CRASH_TYPES = ("MarketCrash", "SectorCrash", "FlashCrash", "BankRun", "LiquidityCrisis", "CurrencyCrisis")
SIMULATION_TYPES = ("Corporation", "FinancialInstitution", "Nation", "MarketCrash", "Asset", "FinancialInstrument")
SIMULATION_LAYER = ("SimAgent", "SimEpisode")


def find_by_name(ent: DataFrame, q: str, type_: str | None = None, limit: int | None = None) -> DataFrame:
    """entities whose lower-cased name contains ``q``; exact hits first, then confidence; all of them without ``limit``."""
    name = F.lower("name")
    hit = ent.filter(F.contains(name, F.lit(q.lower())))
    if type_:
        hit = hit.filter(F.col("type") == type_)
    hit = hit.orderBy((name == q.lower()).desc(), F.col("confidence").desc(), F.col("id"))
    return hit if limit is None else hit.limit(limit)


def query_entities(
    ent: DataFrame, q: str = "", type_: str | None = None, min_confidence: float = 0.0, limit: int | None = None
) -> DataFrame:
    """filtered listing with the confidence floor pushed into the scan."""
    return find_by_name(ent.filter(F.col("confidence") >= min_confidence), q, type_, limit).select(
        "id", "type", "name", "confidence"
    )


def _grams(text: Column, n: int) -> Column:
    """Distinct character ``n``-grams of ``text``."""
    size = F.length(text)
    positions = F.when(size >= n, F.sequence(F.lit(1), size - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(positions, lambda i: F.substring(text, i, F.lit(n))))


def match_names(seeds: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """(seed, id) for every name that contains the seed text, without a nested-loop join.

    seeds(seed), names(id, name).  A name that contains the seed contains each of its character
    grams, so each seed is looked up under its rarest gram only and then verified.  Seeds shorter
    than ``gram`` use grams of their own length; an empty seed matches every name.
    """
    n = names.select("id", F.lower("name").alias("nl"))
    s = seeds.select("seed", F.lower("seed").alias("q")).filter(F.col("q").isNotNull())
    parts = []
    for size in range(1, gram + 1):
        mine = s.filter(F.length("q") == size) if size < gram else s.filter(F.length("q") >= gram)
        wanted = mine.select("seed", "q", F.explode(_grams(F.col("q"), size)).alias("g"))
        index = n.select("id", "nl", F.explode(_grams(F.col("nl"), size)).alias("g"))
        hits = index.join(wanted.select("g").distinct(), "g", "left_semi")
        freq = hits.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        # no name carries the gram -> no name can contain the seed
        rare = wanted.join(freq, "g", "left").groupBy("seed", "q").agg(
            F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), F.col("g"))).alias("g")
        )
        parts.append(hits.join(rare, "g").filter(F.contains("nl", "q")).select("seed", "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # an empty seed text matches every name: the ids are passed through, nothing is joined
    empty_seeds = scalar(s.filter("q = ''").agg(F.count(F.lit(1))))
    everything = n.filter(empty_seeds > 0).select(F.lit("").alias("seed"), "id")
    return out.unionByName(everything).distinct()


def resolve(seeds: DataFrame, ent: DataFrame) -> DataFrame:
    """F1 for many seeds: best entity per seed text (exact hit, then confidence, then id).

    An exact hit outranks any other, so only seeds without one are looked up by their grams.
    """
    texts = seeds.select("seed").filter(F.col("seed").isNotNull()).distinct()
    exact = texts.join(ent, F.lower("seed") == F.lower("name"))
    order = [F.col("confidence").desc(), F.col("id")]
    first = top_k(exact, ["seed"], order, 1)
    rest = texts.join(first.select("seed"), "seed", "left_anti")
    part = top_k(match_names(rest, ent).join(ent, "id"), ["seed"], order, 1)
    return first.select("seed", *ent.columns).unionByName(part.select("seed", *ent.columns))


def resolve_typed(seeds: DataFrame, ent: DataFrame, priority: dict[str, int], other: int = 9) -> DataFrame:
    """J4 first half: like ``resolve`` with types tried in ``priority`` order before any other type."""
    hit = match_names(seeds, ent).join(ent, "id")
    rank = F.lit(other)
    for t, p in sorted(priority.items(), key=lambda kv: -kv[1]):
        rank = F.when(F.col("type") == t, F.lit(p)).otherwise(rank)
    exact = (F.lower("name") == F.lower("seed")).desc()
    return top_k(hit.withColumn("priority", rank), ["seed"], [F.col("priority"), exact, F.col("confidence").desc(), F.col("id")], 1)


def find_events(ent: DataFrame, q: str, types: Iterable[str] = CRASH_TYPES) -> DataFrame:
    """first event of one of ``types`` whose name contains ``q``."""
    return (
        ent.filter(F.col("type").isin(list(types)) & F.contains(F.lower("name"), F.lit(q.lower())))
        .orderBy(F.col("confidence").desc(), F.col("id"))
        .limit(1)
    )


def sparse_entities(ent: DataFrame, degree: DataFrame, below: int = 5, limit: int | None = None) -> DataFrame:
    """entities with fewer than ``below`` connections, never enriched first, then oldest."""
    x = ent.join(degree.select("id", "degree"), "id", "left").filter(F.coalesce("degree", F.lit(0)) < below)
    order = [F.col(c).asc_nulls_first() for c in ("last_enriched", "first_seen") if c in x.columns]
    x = x.withColumn("degree", F.coalesce("degree", F.lit(0)))
    return x.orderBy(*order, "degree", "id").limit(limit) if limit is not None else x


def boundary_check(rel: DataFrame, ent: DataFrame) -> DataFrame:
    """does each edge respect the border between reality and the simulation layer, and if not, why."""
    f = ent.select(F.col("id").alias("from_id"), F.col("type").alias("from_type"))
    t = ent.select(F.col("id").alias("to_id"), F.col("type").alias("to_type"))
    x = rel.join(f, "from_id").join(t, "to_id")
    from_sim, to_sim = F.col("from_type").isin(*SIMULATION_LAYER), F.col("to_type").isin(*SIMULATION_LAYER)
    reason = F.when(
        from_sim & ~to_sim & (F.col("relation") != "READS_FROM"), "simulation may only READS_FROM reality"
    ).when(~from_sim & to_sim, "reality may not point at simulation")
    return x.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def simulation_worthy(ent: DataFrame, types: Iterable[str] = SIMULATION_TYPES) -> DataFrame:
    """F7"""
    return ent.filter(F.col("type").isin(list(types)))


def priority(ent: DataFrame) -> DataFrame:
    """C14: simulation priority in 0..1 and the queue it belongs to."""
    hot = F.col("regime").isin("stressed", "pre_tipping")
    p = (
        F.lit(0.5)
        + F.when(F.col("type").isin("FinancialInstitution", "MarketCrash"), 0.3).otherwise(0.0)
        + F.when(F.coalesce(F.col("regime"), F.lit("normal")) != "normal", 0.2).otherwise(0.0)
        + F.when(F.coalesce(hot, F.lit(False)), 0.3).otherwise(0.0)
    )
    # sums of tenths: one decimal is exact and keeps the 0.8 border stable
    p = F.round(F.least(p, F.lit(1.0)), 1)
    return ent.withColumn("priority", p).withColumn("queue", F.when(F.col("priority") >= 0.8, "priority").otherwise("batch"))


def pending_predictions(pred: DataFrame, asof: Column) -> DataFrame:
    """unresolved predictions with the hours left to their resolution."""
    hours = (F.unix_timestamp(F.col("resolution_time").cast("timestamp")) - F.unix_timestamp(asof.cast("timestamp"))) / 3600.0
    return pred.filter(~F.col("resolved")).withColumn("hours_to_resolution", hours)


def drop_placeholders(ent: DataFrame) -> DataFrame:
    """rows without a usable name or type, or marked as placeholders, are dropped."""
    bad = F.coalesce(F.trim("name"), F.lit("")) == ""
    return ent.filter(~bad & F.col("type").isNotNull() & ~F.lower("name").isin("placeholder", "unknown", "n/a"))


def autonomous_agents(orgs: DataFrame) -> DataFrame:
    """organisations that are autonomous agents."""
    return orgs.filter(F.col("org_type") == "AutonomousAgent")


def entity_profile(seeds: DataFrame, ent: DataFrame, rel: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Each seed text resolved by type priority, then a row per neighbour in either direction, with its relation and name.

    Rows rather than a list per relation, so that a hub's profile is spread like any other table.
    """
    best = resolve_typed(seeds, ent, priority).select("seed", F.col("id").alias("entity"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"))
    wanted = best.select(F.col("entity").alias("src"))
    name = ent.select(F.col("id").alias("neighbour"), F.col("name").alias("neighbour_name"), F.col("type").alias("neighbour_type"))
    hops = [
        rel.select(F.col(a).alias("entity"), F.lit(way).alias("direction"), "relation", F.col(b).alias("neighbour"), "confidence").join(wanted.select(F.col("src").alias("entity")).distinct(), "entity", "left_semi")
        for way, a, b in (("out", "from_id", "to_id"), ("in", "to_id", "from_id"))
    ]
    return best.join(hops[0].unionByName(hops[1]), "entity").join(name, "neighbour")


def entity_claims(seeds: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of every seed text by entity name, case-insensitively, with all columns; surest first, then id."""
    texts = seeds.select("seed").filter(F.col("seed").isNotNull()).distinct()
    hit = texts.join(claims, F.lower("seed") == F.lower("entity"))
    return hit.orderBy("seed", F.col("confidence").desc(), "id")


def by_ids(ent: DataFrame, ids: DataFrame) -> DataFrame:
    """M7: point reads of a list of ids(id): one row per asked id with its entity, or nulls where it is absent."""
    found = ent.withColumn("found", F.lit(True))
    return ids.select("id").distinct().join(found, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
