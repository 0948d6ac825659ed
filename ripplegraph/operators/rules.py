"""Rule-based edge inference and the enrichment job.

A rule is a function (edges, entities) -> inferred edges; ``RULES`` is the registry that
callers extend with their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.linkpred import second_degree, structural_pairs, undirected
from ripplegraph.operators.lookup import sparse_entities
from ripplegraph.operators.overlap import shared_count_pairs, shared_in_blocks, top_shared
from ripplegraph.session import materialize

Rule = Callable[[DataFrame, DataFrame], DataFrame]
INFERRED = ("from_id", "relation", "to_id", "confidence", "weight", "source")


def _typed(rel: DataFrame, relation: str) -> DataFrame:
    return rel.filter(F.col("relation") == relation).select("from_id", "to_id").distinct()


def _of_type(ent: DataFrame, types: Iterable[str], col: str) -> DataFrame:
    return ent.filter(F.col("type").isin(list(types))).select(F.col("id").alias(col))


def _inferred(df: DataFrame, relation: str, confidence: float | Column, weight: Column | None, source: str) -> DataFrame:
    conf = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    return df.select(
        "from_id", F.lit(relation).alias("relation"), "to_id", conf.alias("confidence"),
        (weight if weight is not None else F.lit(1.0)).alias("weight"), F.lit(source).alias("source"),
    )


def transitive(first: str, second: str, result: str, confidence: float) -> Rule:
    """a -first-> m -second-> b gives a -result-> b."""

    def rule(rel: DataFrame, ent: DataFrame) -> DataFrame:
        f = _typed(rel, first).withColumnRenamed("to_id", "m")
        s = _typed(rel, second).withColumnRenamed("from_id", "m")
        hit = f.join(s, "m").filter("from_id <> to_id").select("from_id", "to_id").distinct()
        return _inferred(hit, result, confidence, None, f"transitive:{first}.{second}")

    return rule


def inverse(relation: str, result: str, types: Iterable[str], confidence: float) -> Rule:
    """a -relation-> b gives b -result-> a, for a of ``types``."""

    def rule(rel: DataFrame, ent: DataFrame) -> DataFrame:
        e = _typed(rel, relation).join(_of_type(ent, types, "from_id"), "from_id", "left_semi")
        return _inferred(e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), result, confidence, None, f"inverse:{relation}")

    return rule


def symmetric(relation: str, types: Iterable[str], confidence: float) -> Rule:
    """a -relation-> b gives b -relation-> a where that is missing, for a of ``types``."""

    def rule(rel: DataFrame, ent: DataFrame) -> DataFrame:
        all_ = _typed(rel, relation)
        e = all_.join(_of_type(ent, types, "from_id"), "from_id", "left_semi")
        back = e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
        return _inferred(back.join(all_, ["from_id", "to_id"], "left_anti"), relation, confidence, None, f"symmetric:{relation}")

    return rule


def containment(types: tuple[str, str, str], relation: str, confidence: float) -> Rule:
    """Typed two-step containment t0 -> t1 -> t2."""

    def rule(rel: DataFrame, ent: DataFrame) -> DataFrame:
        e = _typed(rel, relation)
        a = e.join(_of_type(ent, [types[0]], "from_id"), "from_id", "left_semi")
        b = e.join(_of_type(ent, [types[1]], "from_id"), "from_id", "left_semi").join(
            _of_type(ent, [types[2]], "to_id"), "to_id", "left_semi"
        )
        hit = a.withColumnRenamed("to_id", "m").join(b.withColumnRenamed("from_id", "m"), "m")
        return _inferred(hit.select("from_id", "to_id").distinct(), relation, confidence, None, "containment")

    return rule


# The four inference rules with their confidences.
RULES: dict[str, Rule] = {
    "transitive_employment": transitive("works_at", "subsidiary_of", "works_at", 0.7),
    "inverse_ownership": inverse("owns", "owned_by", ("LegalEntity", "Corporation"), 0.95),
    "symmetric_competition": symmetric("competitor_of", ("Corporation", "Product"), 0.95),
    "geo_containment": containment(("City", "Region", "Nation"), "located_in", 0.85),
}


def apply_rules(rel: DataFrame, ent: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Union of what all rules infer."""
    parts = [r(rel, ent) for r in (rules or RULES).values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_cooccurrence(mentions: DataFrame, min_shared: int = 2, k: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Entities mentioned by the same sources; the best ``k`` of each entity, or all pairs.

    confidence = min(.6 + min(.05 n, .3) + (.2 if the shared sources span < 30 days), .95).
    Pairs are counted with their spans inside tasks and pass no shuffle (``overlap.shared_in_blocks``).  ``seeds``
    (id) states whose partners are asked for.
    """
    member = mentions.select(F.col("entity").alias("id"), F.col("source").alias("value")).distinct()
    seconds = F.unix_timestamp(F.min("ts").cast("timestamp"))
    when = mentions.groupBy(F.col("source").alias("value")).agg(seconds.alias("at"))
    x = shared_in_blocks(member, when, min_shared, k, seeds).select(
        F.col("lid").alias("from_id"), F.col("rid").alias("to_id"), F.col("n_common").alias("n"),
        F.floor((F.col("last") - F.col("first")) / 86400).alias("days"),
    )
    conf = F.least(
        F.lit(0.6) + F.least(F.col("n") * 0.05, F.lit(0.3)) + F.when(F.col("days") < 30, 0.2).otherwise(0.0), F.lit(0.95)
    )
    return _inferred(x, "cooccurs_with", conf, F.col("n").cast("double"), "temporal_cooccurrence")


def partners(member: DataFrame, k: int | None, min_shared: int, seeds: DataFrame | None) -> DataFrame:
    """(lid, rid, n_common) of keys that share ``min_shared`` values: the best ``k`` of each, or all."""
    if k is not None:
        return top_shared(member, k, min_shared, seeds)
    pairs = shared_count_pairs(member, min_shared)
    return pairs if seeds is None else pairs.join(seeds.select(F.col("id").alias("lid")).distinct(), "lid", "left_semi")


def simulation_cooccurrence(member: DataFrame, k: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Entities in the same simulation episode, confidence = min(.7 + .1 n, .95); the best ``k`` of each, or all."""
    x = partners(member, k, 1, seeds).select(F.col("lid").alias("from_id"), F.col("rid").alias("to_id"), F.col("n_common").alias("n"))
    conf = F.least(F.lit(0.7) + F.col("n") * 0.1, F.lit(0.95))
    return _inferred(x, "simulated_with", conf, F.col("n").cast("double"), "simulation_cooccurrence")


def strongest(edges: DataFrame) -> DataFrame:
    """One row per (from, relation, to): the highest confidence and its weight."""
    best = F.max_by(F.struct("confidence", "weight", "source"), F.struct("confidence", "weight", "source"))
    return edges.groupBy("from_id", "relation", "to_id").agg(best.alias("b")).select("from_id", "relation", "to_id", "b.*")


#: Partners that the enrichment keeps of a source and of a simulation family.
SOURCE_PARTNERS, SIMULATION_PARTNERS = 20, 10


def enrich(
    ent: DataFrame, rel: DataFrame, mentions: DataFrame, rules: dict[str, Rule] | None = None,
    below: int = 5, min_confidence: float = 0.6, episodes: DataFrame | None = None, changed: DataFrame | None = None,
) -> DataFrame:
    """Sparse entities -> structural, second-degree, rule, source and simulation edges -> best per edge.

    Every family starts from the sparse entities (fewer than ``below`` neighbours): structural pairs
    are proposed by them, the other families give edges from them.  ``episodes`` (id, value) are the
    simulations an entity takes part in.  ``changed`` (id) asks for some of the sparse entities only.
    """
    adj = undirected(rel)
    degree = adj.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    centres = sparse_entities(ent, degree, below, limit=None).select("id")
    if changed is not None:
        centres = centres.join(changed.select("id").distinct(), "id", "left_semi")
    centres = materialize(centres, "sparse-centres")
    from_centres = centres.select(F.col("id").alias("from_id"))
    parts = [
        structural_pairs(rel, below, centres=centres), second_degree(centres, rel), apply_rules(rel, ent, rules).join(from_centres, "from_id", "left_semi"),
        source_cooccurrence(mentions, k=SOURCE_PARTNERS, seeds=centres),
    ]
    if episodes is not None:
        parts.append(simulation_cooccurrence(episodes, k=SIMULATION_PARTNERS, seeds=centres))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return strongest(out).filter(F.col("confidence") >= min_confidence)


def enrichment_status(ent: DataFrame, inferred: DataFrame, now: Column) -> DataFrame:
    """Add the number of new edges to ``connection_count`` and stamp ``last_enriched``."""
    n = inferred.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    x = ent.join(n, "id", "left")
    old = F.coalesce(F.col("connection_count"), F.lit(0)) if "connection_count" in ent.columns else F.lit(0)
    last = F.col("last_enriched") if "last_enriched" in ent.columns else F.lit(None).cast("timestamp")
    return (
        x.withColumn("connection_count", (old + F.coalesce("_n", F.lit(0))).cast("long"))
        .withColumn("last_enriched", F.when(F.col("_n").isNotNull(), now).otherwise(last)).drop("_n")
    )
