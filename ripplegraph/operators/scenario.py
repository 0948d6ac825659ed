"""Scenario projection, participant tables, traces and result import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.text import lookup_column
from ripplegraph.operators.common import round_js, scalar, top_k
from ripplegraph.operators.timeline import runs

# Default variants, channel sets, participants, regime multipliers and export vocabulary.
VARIANTS = (("mild", 0.5), ("moderate", 1.0), ("severe", 1.5), ("systemic", 2.0))
CHANNEL_VARIANTS = {
    "mild": (0.5, ("sentiment",)), "severe": (1.5, ("credit", "liquidity", "sentiment")), "systemic": (2.0, ("credit", "liquidity", "sentiment", "counterparty")),
}
PARTICIPANTS = (
    ("Hedge Fund", "aggressive", 0.8), ("Pension Fund", "conservative", 0.3), ("Investment Bank", "neutral", 0.6),
    ("Retail Investor", "reactive", 0.5), ("Central Bank", "stabilizer", 0.2), ("Regulator", "interventionist", 0.1),
)
REGIME_PARAMS = {"normal": (1.0, "low", "normal"), "stressed": (2.5, "high", "tight"), "pre_tipping": (4.0, "extreme", "frozen"), "post_event": (1.8, "decaying", "recovering")}
CHANNEL_EDGE = {
    "credit": "CREDIT_CONTAGION", "liquidity": "LIQUIDITY_DRAIN", "sentiment": "NARRATIVE_SPREAD", "supply_chain": "SUPPLY_DISRUPTION",
    "regulation": "REGULATORY_SHIFT", "counterparty": "COUNTERPARTY_DEFAULT",
}
EXPORT_TYPE = {
    "Corporation": "FIRM", "Company": "FIRM", "FinancialInstitution": "BANK", "Asset": "ASSET", "Industry": "SECTOR", "MarketCrash": "CRISIS_EVENT",
    "SectorCrash": "CRISIS_EVENT", "CrashFactor": "SHOCK_SOURCE", "CrashMechanism": "TRANSMISSION_MECHANISM", "Channel": "CHANNEL", "Regime": "MARKET_STATE",
    "Narrative": "NARRATIVE", "MacroEvent": "EXOGENOUS_EVENT", "Policy": "POLICY_ACTION", "CentralBank": "CENTRAL_BANK", "Government": "GOVERNMENT", "Location": "GEOGRAPHY",
}
DEFAULT_DRAWDOWN, DEFAULT_RECOVERY = -10.0, 90


def _variants(variants: tuple[tuple[str, float], ...]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(float(m)).alias("magnitude")) for n, m in variants]))


def project(crashes: DataFrame, variants: tuple[tuple[str, float], ...] = VARIANTS) -> DataFrame:
    """crashes(scenario, drawdown, recovery_days) under every variant.

    drawdown * m to one digit, recovery * m, confidence max(.3, .8 - .2 (m - 1)).
    """
    x = crashes.withColumn("v", _variants(variants)).select("*", "v.*").drop("v")
    m = F.col("magnitude")
    base = F.coalesce(F.when(F.col("drawdown") != 0, F.col("drawdown")), F.lit(DEFAULT_DRAWDOWN))
    days = F.coalesce(F.when(F.col("recovery_days") != 0, F.col("recovery_days")), F.lit(DEFAULT_RECOVERY))
    return x.select(
        "scenario", "variant", round_js(base * m, 1).alias("projected_drawdown"), round_js(days * m, 0).cast("long").alias("recovery_days"),
        F.greatest(F.lit(0.3), F.lit(0.8) - (m - 1) * 0.2).alias("confidence"),
    )


def recommend(projected: DataFrame, key: list[str], high: float = -30.0, medium: float = -15.0) -> DataFrame:
    """One row per recommended action from the worst projected drawdown per key (-10 without any)."""
    worst = projected.groupBy(*key).agg(F.coalesce(F.min("projected_drawdown"), F.lit(-10.0)).alias("worst"))
    act = lambda cond, action, urgency: F.when(cond, F.struct(F.lit(action).alias("action"), F.lit(urgency).alias("urgency")))
    acts = F.array(
        act(F.col("worst") < high, "reduce_exposure", "high"), act(F.col("worst") < medium, "hedge_tail_risk", "medium"), act(F.lit(True), "monitor_channels", "low")
    )
    return worst.withColumn("a", F.explode(F.filter(acts, lambda a: a.isNotNull()))).select(*key, "worst", "a.*")


def recommend_by_size(results: DataFrame, key: list[str]) -> DataFrame:
    """X5, second form: borders 20 and 10 on the absolute worst drawdown."""
    return recommend(results.withColumn("projected_drawdown", -F.abs("projected_drawdown")), key, -20.0, -10.0)


def simulated_outcomes(rel: DataFrame, ent: DataFrame, needle: str, k: int = 10) -> DataFrame:
    """Outcomes linked from scenarios whose name contains ``needle``, worst first."""
    s = ent.filter((F.col("type") == "Scenario") & F.contains(F.lower("name"), F.lit(needle.lower()))).select(F.col("id").alias("from_id"), F.col("name").alias("scenario"))
    o = ent.filter("type = 'SimulatedOutcome'").select(F.col("id").alias("to_id"), "drawdown", "confidence")
    return rel.select("from_id", "to_id").join(s, "from_id").join(o, "to_id").orderBy("drawdown", "to_id").limit(k).select("scenario", "to_id", "drawdown", "confidence")


def closed_form(scenarios: DataFrame) -> DataFrame:
    """scenarios(scenario_id, magnitude, alpha, rounds) -> drawdown 15 m (1 + alpha rounds / 24)."""
    m = F.coalesce("magnitude", F.lit(0.5))
    x = scenarios.select("scenario_id", (m * 15 * (F.col("alpha") * F.col("rounds") / 24 + 1)).alias("raw_drawdown"))
    return x.withColumn("final_drawdown", F.round("raw_drawdown", 2))


def participants(scenarios: DataFrame) -> DataFrame:
    """Scenario x participant profile: sensitivity = alpha * aggression, exposure = 100 * aggression."""
    p = F.array(*[F.struct(F.lit(i).alias("agent_id"), F.lit(n).alias("kind"), F.lit(b).alias("behaviour"), F.lit(a).alias("aggression")) for i, (n, b, a) in enumerate(PARTICIPANTS)])
    x = scenarios.withColumn("p", F.explode(p)).select("scenario_id", "alpha", "p.*")
    return x.select("scenario_id", "agent_id", "kind", "behaviour", (F.col("alpha") * F.col("aggression")).alias("sensitivity"), (F.col("aggression") * 100).alias("exposure"))


def trace_metrics(actions: DataFrame) -> DataFrame:
    """Total actions, peak intensity and agents that sold, per simulation."""
    sold = F.col("action_type").isin("SELL", "LIQUIDATE")
    return actions.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("total_actions"), F.max("intensity").alias("peak_intensity"), F.countDistinct(F.when(sold, F.col("agent_id"))).alias("affected_agents")
    )


def sell_runs(actions: DataFrame, min_length: int = 2, first: int | None = None) -> DataFrame:
    """Closed runs of at least ``min_length`` sales per simulation, the earliest ``first`` if given: (scenario_id, run_id, start, length)."""
    r = runs(actions, ["scenario_id"], ["round"], F.col("action_type").isin("SELL", "LIQUIDATE"), F.col("round"), 10_000)
    g = r.groupBy("scenario_id", "run_id").agg(F.min("round").alias("start"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= min_length)
    return g if first is None else top_k(g, ["scenario_id"], [F.col("start")], first)


def result_edges(results: DataFrame) -> DataFrame:
    """results(sim_id, from_id, to_id, path, weight) -> ``causes`` and consecutive ``enables`` edges."""
    w = F.col("weight")
    direct = results.select("from_id", F.lit("causes").alias("relation"), "to_id", w.alias("weight"), F.least(w * 1.5, F.lit(0.95)).alias("confidence"), "sim_id")
    steps = results.filter(F.size("path") >= 2).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("path") - 1)))
    inner = steps.select(
        F.element_at("path", F.col("i")).alias("from_id"), F.lit("enables").alias("relation"), F.element_at("path", F.col("i") + 1).alias("to_id"), (w * 0.8).alias("weight"),
        F.least(w * 1.2, F.lit(0.9)).alias("confidence"), "sim_id",
    )
    return direct.unionByName(inner)


def result_signals(results: DataFrame) -> DataFrame:
    """results(sim_id, predictions array<struct<entity, horizon, predicted_value, confidence>>) -> prediction signals."""
    return results.select("sim_id", F.explode("predictions").alias("p")).select(
        F.col("p.entity").alias("entity"), F.concat_ws(":", F.lit("sim_prediction"), "p.horizon").alias("metric"), F.col("p.predicted_value").alias("value"),
        F.col("p.confidence").alias("confidence"), "sim_id",
    )


def result_regimes(results: DataFrame) -> DataFrame:
    """results(completed_at, regime_transitions array<struct<entity, to_regime, probability>>) -> newest regime per entity."""
    x = results.select("completed_at", F.explode("regime_transitions").alias("t")).select("completed_at", "t.*")
    best = F.max_by(F.struct("to_regime", "probability"), F.struct("completed_at", "probability", "to_regime"))
    return x.groupBy("entity").agg(best.alias("b")).select(F.col("entity").alias("name"), F.col("b.to_regime").alias("regime"), F.col("b.probability").alias("probability"))


def plan_edges(plans: DataFrame) -> DataFrame:
    """plans(plan_id, scenario_id, outcome_id, based_on, names) -> SCENARIO_PRODUCES, SIMULATED_IMPACT per name, BASED_ON .85."""
    e = lambda f, r, t, c: plans.select(F.col(f).alias("from_id"), F.lit(r).alias("relation"), F.col(t).alias("to_id"), F.lit(c).alias("confidence"))
    hit = plans.select(F.col("outcome_id").alias("from_id"), F.lit("SIMULATED_IMPACT").alias("relation"), F.explode("names").alias("to_id"), F.lit(0.8).alias("confidence"))
    return e("scenario_id", "SCENARIO_PRODUCES", "outcome_id", 0.9).unionByName(hit).unionByName(e("plan_id", "BASED_ON", "based_on", 0.85))


def regime_environment(ent: DataFrame) -> DataFrame:
    """Every regime with its members, multipliers and trading constraints; the largest is marked."""
    n = ent.filter(F.col("regime").isNotNull()).groupBy("regime").agg(F.count(F.lit(1)).alias("members"))
    r = F.col("regime")
    text = lambda i: lookup_column({k: str(v[i]) for k, v in REGIME_PARAMS.items()}, r, str(REGIME_PARAMS["normal"][i]))
    dominant = scalar(n.agg(F.max_by("regime", F.struct("members", "regime"))))
    return n.select(
        "regime", "members", (r == dominant).alias("dominant"), text(0).cast("double").alias("volatility_multiplier"), text(1).alias("correlation"), text(2).alias("liquidity"),
        F.when(r == "normal", 5.0).otherwise(2.0).alias("max_leverage"), (r != "pre_tipping").alias("short_selling"),
        F.when(r == "stressed", -0.07).otherwise(-0.10).alias("circuit_breaker"), F.lit(-0.20).alias("forced_liquidation"),
    )


def channel_activity(ent: DataFrame, rel: DataFrame, events: DataFrame) -> DataFrame:
    """Channels with the number of their events that have a start date, none counted as zero."""
    ch = ent.filter(F.col("type").isin("Channel", "RiskChannel")).select("id", "name")
    ev = events.filter(F.col("start_date").isNotNull()).select(F.col("id").alias("from_id"))
    act = rel.filter(F.col("relation").isin("TRANSMITS_THROUGH", "TRANSMITTED_THROUGH")).join(ev, "from_id", "left_semi").groupBy("to_id").agg(F.count(F.lit(1)).alias("active_events"))
    return ch.join(act, ch.id == act.to_id, "left").select("id", "name", F.coalesce("active_events", F.lit(0)).alias("active_events"))


def export_vocabulary(ent: DataFrame) -> DataFrame:
    """K7: entity types in the exchange vocabulary."""
    return ent.withColumn("export_type", lookup_column(EXPORT_TYPE, F.col("type"), "GENERIC"))


def channel_shocks(seeds: DataFrame) -> DataFrame:
    """X11: seeds(seed, id) under every channel variant, ready for ``propagate(edge_channel=…)``."""
    v = F.array(*[
        F.struct(F.lit(n).alias("variant"), F.lit(float(m)).alias("magnitude"), F.array(*[F.lit(c) for c in ch]).alias("channels")) for n, (m, ch) in CHANNEL_VARIANTS.items()
    ])
    x = seeds.withColumn("v", F.explode(v))
    return x.select(F.concat_ws("/", "seed", "v.variant").alias("seed"), "id", F.lit("shock").alias("intervention"), "v.magnitude", "v.channels")
