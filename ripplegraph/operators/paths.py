"""Level-synchronous path operators.

Each level is one join of a small frontier with the edge table.  The frontier is written
between levels (``materialize``), so plans stay one level deep and survive executor loss.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.common import HotJoin, scalar, top_k, unless_small
from ripplegraph.session import materialize

# Causal relation names and the phrase used for each.
CAUSAL_RELATIONS = ("TRIGGERED", "SHOCKED", "causes", "caused_by", "impacts", "amplifies")
MECHANISMS = {
    "TRIGGERED": "direct trigger",
    "SHOCKED": "exogenous shock",
    "causes": "causal chain",
    "caused_by": "upstream cause",
    "impacts": "downstream impact",
    "amplifies": "amplification",
    "TRANSMITTED_THROUGH": "transmission channel",
    "PROPAGATED_TO": "contagion spread",
    "CASCADED_TO": "cascade effect",
    "FORCED_LIQUIDATION": "margin call",
    "AMPLIFIED_CRASH": "shock amplifier",
}
MAX_HOPS = 5


def mechanism_of(relation: Column) -> Column:
    """I4: phrase for a relation."""
    m = F.create_map(*[F.lit(x) for kv in MECHANISMS.items() for x in kv])
    return F.coalesce(F.element_at(m, relation), F.lit("unknown mechanism"))


def edge_weight() -> Column:
    """Causal weight or else confidence; zero counts as missing."""
    return F.coalesce(F.when(F.col("causal_weight") != 0, F.col("causal_weight")), F.col("confidence"))


def shortest_paths(pairs: DataFrame, rel: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Bounded directed shortest path of every (source, target), with its edge weights summed.

    Ties: smallest node list, then smallest relation.  Labels run backward from the targets: after
    level h each node that reaches a target in h hops has one row per target, with its best way on.
    The way of a node is its smallest next node followed by that node's own way, so a level is one
    join of the last level's labels with the edges and one minimum per (target, node); labels are at
    most nodes x targets, whatever the number of sources, and sources meet them at the end.
    A source that is its own target has no path.
    """
    hops = max(1, min(max_hops, MAX_HOPS))
    adj = rel.groupBy("from_id", "to_id").agg(F.min_by(F.struct("relation", edge_weight().alias("w")), "relation").alias("e"))
    adj = materialize(adj.select("from_id", F.col("to_id").alias("node"), "e.relation", "e.w"), "adjacency")
    asked = materialize(pairs.filter("source is not null and target is not null").select("source", "target").distinct(), "asked-pairs")
    edges = HotJoin(adj, "node")

    sources = asked.select(F.col("source").alias("from_id")).distinct()
    none = F.array().cast("array<string>")
    front = materialize(
        asked.select("target").distinct().select("target", F.col("target").alias("node"), F.lit(0).alias("hops"), F.array("target").alias("path"), none.alias("rels"), F.lit(0.0).alias("total")),
        "labels",
    )
    labels = front
    way = F.min(F.struct("node", F.concat(F.array("from_id"), "path").alias("path"), F.concat(F.array("relation"), "rels").alias("rels"), (F.col("w") + F.col("total")).alias("total"))).alias("b")
    for h in range(1, hops + 1):
        step = edges.join(front.select("target", "node", "path", "rels", "total"))
        if h == hops:  # the last level is asked for by its sources alone
            step = step.join(sources, "from_id", "left_semi")
        step = step.groupBy("target", "from_id").agg(way).select("target", F.col("from_id").alias("node"), F.lit(h).alias("hops"), "b.path", "b.rels", "b.total")
        front = materialize(step.join(labels.select("target", "node"), ["target", "node"], "left_anti"), "labels")
        if front.isEmpty():
            break
        labels = labels.unionByName(front)
    found = labels.filter("hops > 0").withColumnRenamed("node", "source").join(asked, ["source", "target"])
    return found.select("source", "target", "path", "rels", "total", "hops")


def trace_causal_paths(
    targets: DataFrame, rel: DataFrame, relations: Iterable[str] = CAUSAL_RELATIONS, max_depth: int = MAX_HOPS, k: int = 20
) -> DataFrame:
    """Strongest ``k`` causal paths of at most ``max_depth`` edges into each target, no edge used twice.

    weight = product of coalesce(causal_weight, .5).  Every prefix of the walk back is itself a
    path.  With W the largest weight, or 1 if none is larger, a partial path is followed only while
    its weight times W for every edge still allowed exceeds the k-th best path found so far: a
    longer path of equal weight ranks behind.  So while no weight is above 1 fewer than ``k``
    partial paths per level and target are followed, whatever the fan-in.
    """
    weight = F.coalesce(F.when(F.col("causal_weight") != 0, F.col("causal_weight")), F.lit(0.5))
    e = rel.filter(F.col("relation").isin(list(relations))).select("from_id", "relation", "to_id", weight.alias("w"))
    largest = F.greatest(F.lit(1.0), F.coalesce(scalar(e.agg(F.max("w"))), F.lit(1.0)))
    depth = max(1, min(max_depth, MAX_HOPS))
    front = targets.select(
        F.col("id").alias("target"), F.col("id").alias("head"), F.array("id").alias("nodes"),
        F.array().cast("array<string>").alias("relations"), F.array().cast("array<double>").alias("weights"),
        F.array().cast("array<string>").alias("edges"), F.lit(1.0).alias("total_weight"),
    )
    order = [F.col("total_weight").desc(), F.size("nodes"), F.col("nodes"), F.col("relations")]
    best = None
    for level in range(1, depth + 1):
        edge_key = F.concat_ws("|", "from_id", "relation", "to_id")
        step = (
            front.join(e, F.col("head") == F.col("to_id"))
            .filter(~F.array_contains("edges", edge_key))
            .select(
                "target", F.col("from_id").alias("head"), F.concat(F.array("from_id"), "nodes").alias("nodes"),
                F.concat(F.array("relation"), "relations").alias("relations"), F.concat(F.array("w"), "weights").alias("weights"),
                F.concat(F.array(edge_key), "edges").alias("edges"), (F.col("total_weight") * F.col("w")).alias("total_weight"),
            )
        )
        # no more than k rows per target can come out, nor be followed, of a level that all outweigh
        step = materialize(step, "paths")
        best = top_k(step if best is None else best.unionByName(step), ["target"], order, k)
        best = materialize(best, "best-paths")
        full = best.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.min("total_weight").alias("_kth")).filter(F.col("_n") >= k)
        reach = F.col("total_weight") * F.pow(largest, F.lit(float(depth - level)))
        front = step.join(full, "target", "left").filter(F.col("_kth").isNull() | (reach > F.col("_kth"))).drop("_n", "_kth")
    return top_k(best, ["target"], order, k, rank="path_rank").drop("edges")


def decorate_paths(paths: DataFrame, ent: DataFrame) -> DataFrame:
    """I4: mechanism per edge, arrow narrative over names, decayed intensity .01 + sum w e^(-.1 i)."""
    names = ent.select(F.col("id").alias("_n"), F.col("name"))
    pos = (
        paths.select("target", "path_rank", F.posexplode("nodes").alias("i", "_n")).join(names, "_n", "left")
        .groupBy("target", "path_rank")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "_n").alias("v")))), lambda x: x["v"]).alias("names"))
    )
    x = paths.join(pos, ["target", "path_rank"]).withColumn("mechanisms", F.transform("relations", mechanism_of))
    hops = F.transform(
        F.sequence(F.lit(1), F.size("relations")),
        lambda i: F.concat(F.lit("→["), F.element_at("mechanisms", i), F.lit("]→ "), F.element_at("names", i + 1)),
    )
    intensity = F.aggregate(
        F.transform("weights", lambda w, i: w * F.exp(i.cast("double") * -0.1)), F.lit(0.01), lambda a, v: a + v
    )
    return x.withColumn("narrative", F.concat_ws(" ", F.element_at("names", 1), F.array_join(hops, " "))).withColumn("intensity", intensity)


def chain_rows(paths: DataFrame) -> DataFrame:
    """One row per node of a traced path, in order."""
    return paths.select(
        "target", "path_rank", F.element_at("nodes", 1).alias("root"), F.size("relations").alias("hops"),
        F.posexplode("nodes").alias("position", "node"),
    ).withColumn("relation", F.lit("PART_OF_CHAIN"))


def neighbourhood(seeds: DataFrame, rel: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Merged undirected ``hops``-neighbourhood of all seeds: (nodes(id, hop), edges)."""
    nodes = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = nodes.select("id")
    for h in range(1, hops + 1):
        out = rel.join(front.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
        back = rel.join(front.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
        new = out.unionByName(back).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        nodes = materialize(nodes.unionByName(new), "neighbourhood")
        front = nodes.filter(F.col("hop") == h).select("id")
    ids = nodes.select("id")
    edges = rel.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(
        ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"
    )
    return nodes, edges


# First impact per intervention and the propagation constants.
INTERVENTIONS = {"shock": 1.0, "boost": 0.8, "remove": -0.5}
REGIME_FACTOR, ATTENUATION, IMPACT_FLOOR, AFFECTED_CAP = 1.5, 0.7, 0.05, 50
STRESSED = ("stressed", "pre_tipping")


def _regime_factor(col: str) -> Column:
    return F.when(F.col(col).isin(*STRESSED), REGIME_FACTOR).otherwise(1.0)


def propagate(
    seeds: DataFrame, rel: DataFrame, ent: DataFrame, depth: int = 3, cap: int | None = None, edge_channel: str | None = None
) -> DataFrame:
    """Spread interventions breadth first; a node keeps its first visit.

    seeds(seed, id, intervention[, magnitude][, channels]).  Each hop multiplies by .7 and by
    1.5 in a stressed or pre-tipping node; impacts of at most .05 stop.  Visits of a level are
    ordered by edge confidence desc, parent, node; with a ``cap``, the first visits of a seed count.
    With ``edge_channel`` only edges whose channel is in the seed's ``channels`` are followed.
    """
    start = ent.select("id", F.col("name").alias("_name"), F.col("regime").alias("_regime"))
    base = F.lit(0.0)
    for k, v in INTERVENTIONS.items():
        base = F.when(F.col("intervention") == k, v).otherwise(base)
    if "magnitude" in seeds.columns:
        base = base * F.col("magnitude")
    extra = ["channels"] if edge_channel else []
    front = seeds.join(start, "id").select(
        "seed", F.col("id").alias("node"), (base * _regime_factor("_regime")).alias("impact"), F.array("_name").alias("path"), *extra
    )
    front = materialize(front, "shock-seeds")
    seen = front.select("seed", "node")
    done = None
    info = ent.select(F.col("id").alias("node"), "name", "type", F.col("regime").alias("_regime"))
    for level in range(1, depth + 1):
        step = unless_small(front).join(rel, F.col("node") == F.col("from_id"))
        if edge_channel:
            step = step.filter(F.array_contains("channels", F.col(edge_channel)))
        step = step.select(
            "seed", F.col("to_id").alias("node"),
            F.struct((-F.col("confidence")).alias("c"), F.col("from_id").alias("p"), "relation").alias("visit"), "impact", "path", *extra,
        )
        payload = F.struct("impact", "path", *extra)
        first = (
            step.join(unless_small(seen), ["seed", "node"], "left_anti").groupBy("seed", "node")
            .agg(F.min("visit").alias("visit"), F.min_by(payload, "visit").alias("x"))
        )
        reached = first.join(info, "node").select(
            "seed", "node", "name", "type", "visit", (F.col("x.impact") * ATTENUATION * _regime_factor("_regime")).alias("impact"),
            F.col("x.path").alias("path"), *[F.col(f"x.{c}").alias(c) for c in extra],
        )
        reached = materialize(reached, "shock-reached")
        if cap is not None:
            # visits that count: large enough, and within the cap together with earlier levels
            big = reached.filter(F.abs("impact") > IMPACT_FLOOR)
            big = top_k(big, ["seed"], [F.col("visit"), F.col("node")], cap, rank="_rn")
            if done is not None:
                used = done.groupBy("seed").agg(F.count(F.lit(1)).alias("_used"))
                big = big.join(used, "seed", "left").filter(F.col("_rn") + F.coalesce("_used", F.lit(0)) <= cap).drop("_used")
            kept = big.drop("_rn")
        else:
            kept = reached.filter(F.abs("impact") > IMPACT_FLOOR)
        kept = materialize(kept.withColumn("level", F.lit(level)), "shock-level")
        done = kept if done is None else done.unionByName(kept)
        if level < depth:
            seen = seen.unionByName(reached.select("seed", "node"))
            front = kept.select("seed", "node", "impact", F.concat("path", F.array("name")).alias("path"), *extra)
    return done.select(
        "seed", F.col("node").alias("id"), "name", "type", "level", "path",
        (F.floor(F.col("impact") * 1000 + 0.5) / 1000).alias("residual_impact"),
    )


def ultimate_parents(rel: DataFrame, relation: str = "subsidiary_of", max_doublings: int = 20) -> DataFrame:
    """(id, parent, root, depth) along the surest ``relation`` edge of each entity.

    Pointer doubling: every round jumps twice as far, so a chain of length n needs log2(n)
    joins.  Entities on a cycle get a NULL root.
    """
    best = top_k(rel.filter(F.col("relation") == relation), ["from_id"], [F.col("confidence").desc(), F.col("to_id")], 1)
    jump = materialize(best.select(F.col("from_id").alias("id"), F.col("to_id").alias("parent"), F.col("to_id").alias("at"), F.lit(1).cast("long").alias("depth")), "chain")
    for _ in range(max_doublings):
        nxt = jump.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("d2"))
        moved = jump.join(nxt, "at", "left").select(
            "id", "parent", F.coalesce("at2", "at").alias("at"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.col("at2").isNotNull().alias("_moved"),
        )
        moved = materialize(moved, "chain")
        jump = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return jump.withColumnRenamed("at", "root")
    on_cycle = moved.withColumn("root", F.when(~F.col("_moved"), F.col("at"))).withColumn("depth", F.when(~F.col("_moved"), F.col("depth")))
    return on_cycle.select("id", "parent", "root", "depth")
