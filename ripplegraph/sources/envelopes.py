"""Request envelopes: bulk, raw batch, direct arrays and backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.sources.staging import Batch

# Defaults of the envelopes and the keys that never become properties.
RAW_ENTITY_CONFIDENCE, RAW_EDGE_CONFIDENCE = 0.9, 0.8
KNOWN_KEYS = ("type", "name", "source", "confidence", "properties", "id", "_force_new")
_MAP = "map<string,string>"


def bulk_entities(payloads: DataFrame, source: str = "bulk") -> DataFrame:
    """payload(body JSON text) with ``entities`` or ``nodes``; unknown top-level fields of an
    item fold into its properties, given properties win, ``id`` and ``_force_new`` are dropped."""
    item = "array<map<string,string>>"
    body = F.coalesce(
        F.from_json(F.get_json_object("body", "$.entities"), item), F.from_json(F.get_json_object("body", "$.nodes"), item)
    )
    x = payloads.select(F.posexplode(body).alias("seq", "e"))
    given = F.coalesce(F.from_json(F.element_at("e", "properties"), _MAP), F.create_map().cast(_MAP))
    extra = F.map_filter("e", lambda k, v: ~k.isin(*KNOWN_KEYS) & v.isNotNull())
    props = F.map_concat(given, F.map_filter(extra, lambda k, v: ~F.array_contains(F.map_keys(given), k)))
    return x.select(
        F.element_at("e", "type").alias("type"), F.trim(F.element_at("e", "name")).alias("name"),
        F.coalesce(F.element_at("e", "source"), F.lit(source)).alias("source"), F.element_at("e", "confidence").cast("double").alias("confidence"),
        props.alias("properties"),
    ).filter(F.coalesce("name", F.lit("")) != "")


def bulk_connections(payloads: DataFrame) -> DataFrame:
    """The ``connections`` of a payload, still with both ``relation`` and ``relationship``."""
    body = F.from_json(F.get_json_object("body", "$.connections"), "array<map<string,string>>")
    x = payloads.select(F.posexplode(body).alias("seq", "c"))
    text = lambda k: F.element_at("c", k).alias(k)
    return x.select(
        *[text(k) for k in ("from_type", "from_name", "relation", "relationship", "to_type", "to_name", "source")],
        F.element_at("c", "confidence").cast("double").alias("confidence"),
        F.coalesce(F.from_json(F.element_at("c", "properties"), _MAP), F.create_map().cast(_MAP)).alias("properties"), F.col("seq").cast("long"),
    )


RAW_ITEM = (
    "struct<name:string,type:string,source:string,confidence:double,properties:map<string,string>,"
    "relationships:array<struct<targetName:string,targetType:string,relation:string,confidence:double>>>"
)


def raw_batch(payloads: DataFrame, source: str = "raw_batch") -> Batch:
    """S3: ``batch`` items with nested relationships; .9 for entities and .8 for edges by default."""
    items = F.from_json(F.get_json_object("body", "$.batch"), f"array<{RAW_ITEM}>")
    x = payloads.select(F.explode(items).alias("i")).select("i.*")
    src = F.coalesce("source", F.lit(source))
    empty = F.create_map().cast(_MAP)
    ent = x.select(
        "type", F.trim("name").alias("name"), src.alias("source"), F.coalesce("confidence", F.lit(RAW_ENTITY_CONFIDENCE)).alias("confidence"),
        F.coalesce("properties", empty).alias("properties"),
    )
    rel = x.select(F.col("type").alias("from_type"), F.col("name").alias("from_name"), src.alias("source"), F.explode("relationships").alias("r"))
    con = rel.select(
        "from_type", "from_name", F.coalesce("r.relation", F.lit("related_to")).alias("relation"), F.col("r.targetType").alias("to_type"),
        F.col("r.targetName").alias("to_name"), "source", F.coalesce("r.confidence", F.lit(RAW_EDGE_CONFIDENCE)).alias("confidence"), empty.alias("properties"),
    )
    return Batch(ent, con)


def backup(payloads: DataFrame) -> Batch:
    """Backup file rows (body JSON text); defaults .9 and .8, to be written with ``patch_nodes``."""
    e = F.from_json(F.get_json_object("body", "$.entities"), "array<struct<type:string,name:string,source:string,confidence:double,properties:map<string,string>>>")
    r = F.from_json(
        F.get_json_object("body", "$.relationships"),
        "array<struct<from_type:string,from_name:string,relation:string,to_type:string,to_name:string,source:string,confidence:double>>",
    )
    empty = F.create_map().cast(_MAP)
    ent = payloads.select(F.explode(e).alias("e")).select("e.*").withColumn("confidence", F.coalesce("confidence", F.lit(0.9)))
    con = payloads.select(F.explode(r).alias("r")).select("r.*").withColumn("confidence", F.coalesce("confidence", F.lit(0.8)))
    return Batch(ent.withColumn("properties", F.coalesce("properties", empty)), con.withColumn("properties", empty))
