"""Exports (K1-K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators.stats import graph_stats
from ripplegraph.session import shuffles_dropped

EXPORT_VERSION = "1.0"
ENTITY = "id string, type string, name string, confidence double, regime string"
RELATIONSHIP = "from_id string, relation string, to_id string, confidence double, call_count bigint, causal_weight double"


def write_backup(ent: DataFrame, rel: DataFrame, path: str, fmt: str = "json") -> None:
    """K1: full backup: entities, relationships, and stats with version and time, as one folder each.

    Text is packed: an edge takes some 120 bytes as JSON, a tenth of it in gzip.
    """
    packed = {"compression": "gzip"} if fmt in ("json", "csv", "text") else {}
    meta = graph_stats(ent, rel).withColumn("version", F.lit(EXPORT_VERSION)).withColumn("exported_at", F.current_timestamp())
    with shuffles_dropped(ent.sparkSession):
        for df, name in ((ent, "entities"), (rel, "relationships"), (meta, "stats")):
            df.write.format(fmt).options(**packed).save(f"{path}/{name}")


def read_backup(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Entities and relationships as ``write_backup`` left them."""
    return spark.read.format(fmt).schema(ENTITY).load(f"{path}/entities"), spark.read.format(fmt).schema(RELATIONSHIP).load(f"{path}/relationships")


def claims_as_relationships(claims: DataFrame) -> DataFrame:
    """K2"""
    return claims.select(F.col("entity").alias("from"), "relation", F.col("target").alias("to"), "confidence")


def entity_keys(ent: DataFrame) -> DataFrame:
    """K3: one key-value row per entity."""
    return ent.select(F.concat_ws(":", F.lit("graph"), F.lit("entity"), "name").alias("key"), F.to_json(F.struct(*ent.columns)).alias("value"))


def edge_keys(rel: DataFrame) -> DataFrame:
    """K3: one key-value row per edge."""
    return rel.select(F.concat_ws(":", F.lit("graph"), F.lit("edge"), "from_id", "relation", "to_id").alias("key"), F.to_json(F.struct(*rel.columns)).alias("value"))


def write_labelled(ent: DataFrame, rel: DataFrame, path: str) -> None:
    """K4: one folder per entity type and per relation."""
    ent.write.partitionBy("type").parquet(f"{path}/nodes")
    rel.write.partitionBy("relation").parquet(f"{path}/edges")


def ontology(ent: DataFrame, rel: DataFrame, types: list[str] | None = None) -> DataFrame:
    """K5: (kind, label, n): entity types and typed edge triples among them."""
    e = ent if types is None else ent.filter(F.col("type").isin(types))
    nodes = e.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), F.col("type").alias("label"), "n")
    t = e.select("id", "type")
    x = rel.join(t.select(F.col("id").alias("from_id"), F.col("type").alias("ft")), "from_id").join(t.select(F.col("id").alias("to_id"), F.col("type").alias("tt")), "to_id")
    edges = x.groupBy("ft", "relation", "tt").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.concat_ws(" ", "ft", "relation", "tt").alias("label"), "n")
    return nodes.unionByName(edges)


def sentences(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """K6: one sentence per entity ("X is a T.") and per edge ("A rel B."), as rows."""
    n = ent.select("id", "name")
    facts = ent.select(F.format_string("%s is a %s.", "name", "type").alias("sentence"))
    x = rel.join(n.select(F.col("id").alias("from_id"), F.col("name").alias("a")), "from_id").join(n.select(F.col("id").alias("to_id"), F.col("name").alias("b")), "to_id")
    return facts.unionByName(x.select(F.format_string("%s %s %s.", F.col("a"), F.regexp_replace("relation", "_", " "), F.col("b")).alias("sentence")))
