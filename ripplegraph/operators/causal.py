"""Crash explanation and counterfactuals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.common import round_js, top_k
from ripplegraph.operators.paths import mechanism_of

# Relation groups, row limits and constants of the explanation.
TRANSMISSION = ("TRANSMITTED_THROUGH", "PROPAGATED_TO", "CASCADED_TO", "AMPLIFIED_CRASH")
EXPOSURE = ("EXPOSED_TO", "CRASHED", "VULNERABLE_TO")
ROOT_LIMIT, AFFECTED_LIMIT = 10, 20
DEFAULT_INTENSITY, INPUT_INTENSITY, WINDOW_HOURS = 0.5, 0.1, 24
DEFAULT_DRAWDOWN = -20.0


def root_causes(paths: DataFrame) -> DataFrame:
    """A5: (target, root, paths, share, mechanisms, confidence), the ten heaviest roots per target.

    Input is the bounded output of ``trace_causal_paths``.
    """
    x = paths.select("target", F.element_at("nodes", 1).alias("root"), "total_weight", mechanism_of(F.element_at("relations", 1)).alias("m"))
    g = x.groupBy("target", "root").agg(
        F.sum("total_weight").alias("w"), F.count(F.lit(1)).alias("paths"), F.array_join(F.array_sort(F.collect_set("m")), ", ").alias("mechanisms")
    )
    total = g.groupBy("target").agg(F.sum("w").alias("t"))
    g = g.join(total, "target").withColumn("share", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0))
    best = top_k(g, ["target"], [F.col("w").desc(), F.col("root")], ROOT_LIMIT, rank="root_rank")
    return best.select("target", "root", "root_rank", "paths", "share", "mechanisms", F.least(F.lit(0.95), F.lit(0.5) + F.col("paths") * 0.1).alias("confidence"))


def transmission(targets: DataFrame, rel: DataFrame, relations: Iterable[str] = TRANSMISSION) -> DataFrame:
    """Per target and mechanism the distinct entities, their speed n / 24 and amplification sum / .1.

    rel needs ``mechanism`` and ``contagion_weight``; an edge belongs to a target it points at or
    names in ``crash_context``.
    """
    e = rel.filter(F.col("relation").isin(list(relations))).withColumn("mechanism", F.coalesce("mechanism", F.lit("unknown")))
    ids = targets.select(F.col("id").alias("target")).distinct()
    hit = e.join(ids, F.col("to_id") == F.col("target"))
    if "crash_context" in rel.columns:
        # context is the id itself or a comma list of ids
        ctx = e.withColumn("target", F.explode(F.split(F.coalesce("crash_context", F.lit("")), r"\s*,\s*"))).join(ids, "target", "left_semi")
        hit = hit.unionByName(ctx.select(*hit.columns)).dropDuplicates(["target", "from_id", "relation", "to_id"])
    flow = hit.groupBy("target", "mechanism").agg(F.sum(F.coalesce("contagion_weight", F.lit(DEFAULT_INTENSITY))).alias("s"))
    who = hit.select("target", "mechanism", F.explode(F.array("from_id", "to_id")).alias("e")).distinct()
    n = who.groupBy("target", "mechanism").agg(F.count(F.lit(1)).alias("entities_affected"))
    return flow.join(n, ["target", "mechanism"]).select(
        "target", "mechanism", "entities_affected", (F.col("entities_affected") / WINDOW_HOURS).alias("peak_speed"), (F.col("s") / INPUT_INTENSITY).alias("amplification")
    )


def most_affected(targets: DataFrame, rel: DataFrame, ent: DataFrame, k: int = AFFECTED_LIMIT) -> DataFrame:
    """Entities exposed to each target, largest ``loss_pct`` first."""
    ids = targets.select(F.col("id").alias("to_id")).distinct()
    hit = rel.filter(F.col("relation").isin(*EXPOSURE)).join(ids, "to_id", "left_semi")
    best = top_k(hit, ["to_id"], [F.coalesce("loss_pct", F.lit(0.0)).desc(), F.col("from_id"), F.col("relation")], k)
    return best.join(ent.select(F.col("id").alias("from_id"), "name", "type"), "from_id").select(
        F.col("to_id").alias("target"), F.col("from_id").alias("entity"), "name", "type", "loss_pct"
    )


def explain(targets: DataFrame, paths: DataFrame, rel: DataFrame, ent: DataFrame) -> DataFrame:
    """One row per target(id, name, drawdown) with its summary sentence and counts.

    Lists in the summary are the bounded top three causes and top two mechanisms.
    """
    roots = root_causes(paths).join(ent.select(F.col("id").alias("root"), F.col("name").alias("root_name")), "root")
    mech = transmission(targets, rel)
    joined = lambda k, v, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), sep)
    top3 = roots.filter("root_rank <= 3").groupBy("target").agg(joined("root_rank", "root_name", ", ").alias("causes"))
    top2 = top_k(mech, ["target"], [F.col("amplification").desc(), F.col("mechanism")], 2, rank="r").groupBy("target").agg(joined("r", "mechanism", " and ").alias("channels"))
    n_mech = mech.groupBy("target").agg(F.sum("entities_affected").alias("n_affected"))
    n_path = paths.groupBy("target").agg(F.count(F.lit(1)).alias("n_paths"), F.max("total_weight").alias("best_weight"))
    x = targets.select(F.col("id").alias("target"), "name", "drawdown")
    for part in (top3, top2, n_mech, n_path):
        x = x.join(part, "target", "left")
    summary = F.format_string(  # fixed output format of the summary sentence
        "%s (%s%% drawdown) was primarily caused by %s. The crash propagated through %s, affecting %d entities.",
        F.col("name"), F.col("drawdown").cast("string"), F.coalesce("causes", F.lit("multiple factors")), F.coalesce("channels", F.lit("various channels")), F.coalesce("n_affected", F.lit(0)),
    )
    return x.select("target", summary.alias("summary"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "best_weight")


def report(targets: DataFrame, paths: DataFrame, rel: DataFrame, ent: DataFrame) -> DataFrame:
    """Markdown report lines (target, section, line_no, line): five causes, mechanisms and chains each.

    The line templates are a fixed output format.
    """
    names = ent.select(F.col("id").alias("root"), F.col("name").alias("root_name"))
    cause = root_causes(paths).filter("root_rank <= 5").join(names, "root").select(
        "target", F.lit(2).alias("section"), F.col("root_rank").alias("line_no"),
        F.format_string("- **%s** (%.1f%% contribution): %s", F.col("root_name"), F.col("share") * 100, F.col("mechanisms")).alias("line"),
    )
    mech = top_k(transmission(targets, rel), ["target"], [F.col("amplification").desc(), F.col("mechanism")], 5, rank="line_no").select(
        "target", F.lit(3).alias("section"), "line_no", F.format_string("- **%s**: Affected %d entities", "mechanism", "entities_affected").alias("line")
    )
    chain = paths.filter("path_rank <= 5").select("target", F.lit(4).alias("section"), F.col("path_rank").alias("line_no"), F.concat(F.lit("- "), "narrative").alias("line"))
    head = targets.select(F.col("id").alias("target"), F.lit(1).alias("section"), F.lit(1).alias("line_no"), F.format_string("## %s", "name").alias("line"))
    return head.unionByName(cause).unionByName(mech).unionByName(chain)


def counterfactual(targets: DataFrame, paths: DataFrame, ent: DataFrame, removed: str | Column) -> DataFrame:
    """Drawdown without the paths that touch an entity whose name contains ``removed``.

    NULL drawdown when a target has no path.  ``removed`` may be a column of targets.
    """
    what = F.lit(removed) if isinstance(removed, str) else removed
    t = targets.select(F.col("id").alias("target"), F.coalesce(F.when(F.col("drawdown") != 0, F.col("drawdown")), F.lit(DEFAULT_DRAWDOWN)).alias("drawdown"), F.lower(what).alias("needle"))
    on = paths.select("target", "path_rank", "total_weight", F.size("nodes").alias("n"), F.explode("nodes").alias("id")).join(ent.select("id", F.lower("name").alias("nm")), "id", "left").join(t, "target")
    per = on.groupBy("target", "path_rank").agg(
        F.max("total_weight").alias("w"), F.max("n").alias("n"), F.max(F.coalesce(F.contains(F.coalesce("nm", "id"), "needle"), F.lit(False))).alias("hit")
    )
    g = per.groupBy("target").agg(
        F.sum("w").alias("base"), F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("gone"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("saved"), F.count_if("hit").alias("k"),
    )
    x = t.join(g, "target", "left")
    ratio = (F.col("base") - F.col("gone")) / F.nullif(F.col("base"), F.lit(0.0))
    return x.select(
        "target", round_js(F.col("drawdown") * ratio, 1).alias("simulated_drawdown"), F.coalesce("saved", F.lit(0)).alias("entities_saved"),
        F.coalesce(F.col("gone") > F.col("base") * 0.5, F.lit(False)).alias("cascade_prevented"), F.least(F.lit(0.9), F.lit(0.5) + F.coalesce("k", F.lit(0)) * 0.1).alias("confidence"),
    )


# Sections of an event explanation: (section, side of the event, relations, neighbour types, limit).
SECTIONS = (
    ("factors", "in", ("TRIGGERED", "SHOCKED", "causes", "caused_by"), None, 10),
    ("channels", "out", ("TRANSMITS_THROUGH", "TRANSMITTED_THROUGH"), ("Channel", "RiskChannel"), None),
    ("affected", "out", ("CRASHED", "impacts", "PROPAGATED_TO", "CASCADED_TO"), ("Corporation", "Company", "FinancialInstitution", "Asset", "Industry"), 20),
    ("narratives", "out", ("DRIVES_NARRATIVE",), ("Narrative",), None),
    ("chain", "out", ("PART_OF_CHAIN",), ("CausalChain",), 1),
    ("regime", "out", ("IN_REGIME",), ("Regime",), 1),
)


def event_star(events: DataFrame, rel: DataFrame, ent: DataFrame) -> DataFrame:
    """(event, section, neighbour, name, type, relation, score) in one pass over the edges.

    The score is the causal weight for factors and the confidence elsewhere; limited sections
    keep their best rows.
    """
    ids = events.select(F.col("id").alias("event")).distinct()
    used = sorted({r for s in SECTIONS for r in s[2]})
    e = rel.filter(F.col("relation").isin(used))
    side = lambda s, ev, nb: e.select(F.col(ev).alias("event"), F.col(nb).alias("neighbour"), "relation", "confidence", "causal_weight", F.lit(s).alias("side"))
    star = side("in", "to_id", "from_id").unionByName(side("out", "from_id", "to_id")).join(ids, "event", "left_semi")
    star = star.join(ent.select(F.col("id").alias("neighbour"), "name", "type"), "neighbour")
    section, limit = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, s, rels, types, n in SECTIONS:
        here = (F.col("side") == s) & F.col("relation").isin(*rels)
        if types:
            here = here & F.col("type").isin(*types)
        section = F.when(here, F.lit(name)).otherwise(section)
        limit = F.when(here, F.lit(n)).otherwise(limit)
    score = F.when(F.col("side") == "in", F.coalesce("causal_weight", F.lit(0.0))).otherwise(F.coalesce("confidence", F.lit(0.0)))
    star = star.withColumn("section", section).withColumn("_limit", limit.cast("int")).withColumn("score", score).filter(F.col("section").isNotNull())
    cols = ["event", "section", "neighbour", "name", "type", "relation", "score"]
    few = top_k(star.filter("_limit is not null"), ["event", "section"], [F.col("score").desc(), F.col("neighbour"), F.col("relation")], 20, rank="_rn")
    return star.filter("_limit is null").select(*cols).unionByName(few.filter("_rn <= _limit").select(*cols))


def narrative_brief(hop: DataFrame, k: int = 10) -> DataFrame:
    """Strongest narratives per seed of a ``neighbours`` result, the first one flagged dominant."""
    n = hop.filter("neighbour_type = 'Narrative'")
    return top_k(n, ["seed"], [F.col("confidence").desc(), F.col("neighbour")], k, rank="rank").withColumn("dominant", F.col("rank") == 1)
