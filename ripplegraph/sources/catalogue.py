"""Crash catalogue expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.identity import md5_id
from ripplegraph.sources.staging import union

CRASH = (
    "crash_id string, name string, crash_type string, start_date string, end_date string, peak_drawdown_pct double, recovery_days int, regime_during string, "
    "root_causes array<struct<name:string,type:string,causal_weight:double,description:string,preceded_by_days:int>>, "
    "channels array<struct<type:string,intensity:double>>, mechanisms array<struct<type:string,amplification:double,entities_affected:int>>, "
    "entities_affected array<struct<name:string,type:string,loss_pct:double,outcome:string>>, "
    "interventions array<struct<entity:string,type:string,action:string>>, narratives array<string>"
)


def expand_crashes(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crash records -> (nodes(id, type, name, crash_id), edges(from_id, relation, to_id, weight, mechanism, crash_id)).

    Eight branches: crash, root causes, channels, mechanisms, affected, interventions, regime, narratives.
    """
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def node(df: DataFrame, id_: Column, type_: Column, name: Column) -> DataFrame:
        return df.select(id_.alias("id"), type_.alias("type"), name.alias("name"), "crash_id")

    def edge(df: DataFrame, f: Column, rel: Column, t: Column, w: Column, m: Column) -> DataFrame:
        return df.select(f.alias("from_id"), rel.alias("relation"), t.alias("to_id"), w.alias("weight"), m.alias("mechanism"), "crash_id")

    me, gen = F.col("crash_id"), lambda col: md5_id("ent", col, 12)
    one = lambda field: c.select("crash_id", F.explode(field).alias("x"))
    cause, chan, mech = one("root_causes"), one("channels"), one("mechanisms")
    hit, act, narr = one("entities_affected"), one("interventions"), one("narratives")
    x = F.col("x")
    pretty = lambda col: F.initcap(F.regexp_replace(col, "_", " "))
    mech_id = gen(F.concat_ws("-", "crash_id", x["type"]))
    narr_id = gen(F.concat(F.lit("narrative-"), x))
    regime_id = F.concat(F.lit("regime-"), F.col("regime_during"))
    nodes = union(
        node(c, me, F.col("crash_type"), F.col("name")), node(cause, gen(x["name"]), F.coalesce(x["type"], F.lit("CrashFactor")), x["name"]),
        node(chan, F.concat(F.lit("channel-"), x["type"]), F.lit("RiskChannel"), F.concat(F.initcap(x["type"]), F.lit(" Channel"))),
        node(mech, mech_id, x["type"], pretty(x["type"])), node(hit, gen(x["name"]), F.coalesce(x["type"], F.lit("Corporation")), x["name"]),
        node(act, gen(x["entity"]), F.lit("LegalEntity"), x["entity"]), node(c, regime_id, F.lit("Regime"), pretty(F.col("regime_during"))),
        node(narr, narr_id, F.lit("Narrative"), x),
    )
    edges = union(
        edge(cause, gen(x["name"]), F.lit("TRIGGERED"), me, x["causal_weight"], x["description"]),
        edge(chan, me, F.lit("TRANSMITTED_THROUGH"), F.concat(F.lit("channel-"), x["type"]), x["intensity"], none_s),
        edge(mech, mech_id, F.lit("AMPLIFIED_CRASH"), me, x["amplification"], x["type"]),
        edge(hit, gen(x["name"]), F.lit("EXPOSED_TO"), me, x["loss_pct"], x["outcome"]),
        edge(act, gen(x["entity"]), x["type"], me, none_d, x["action"]), edge(c, me, F.lit("part_of"), regime_id, none_d, none_s),
        edge(narr, me, F.lit("supports"), narr_id, none_d, none_s),
    )
    return nodes, edges


def crash_counts(c: DataFrame) -> DataFrame:
    """Node and edge rows per crash, as the loader reports them (interventions add no node)."""
    n = lambda f: F.coalesce(F.size(f), F.lit(0))
    parts = n("root_causes") + n("channels") + n("mechanisms") + n("entities_affected") + n("narratives")
    return c.select("crash_id", (parts + 2).alias("entities"), (parts + n("interventions") + 1).alias("relationships"))
