"""Staged rows that every reader produces, and the file readers themselves.

A reader is a function over a DataFrame in the source's own shape; where that frame comes from
(JSON lines, CSV, XML, a stream) is decided by ``read`` or by the caller.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_COLUMNS = ("type", "name", "source", "confidence", "properties")
CONNECTION_COLUMNS = ("from_type", "from_name", "relation", "to_type", "to_name", "source", "confidence", "properties")


class Batch(NamedTuple):
    entities: DataFrame
    connections: DataFrame


def _col(v: str | float | Column | None) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def properties(**props: str | float | Column | None) -> Column:
    """Map of the non-empty properties, as text."""
    if not props:
        return F.create_map().cast("map<string,string>")
    m = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), _col(v).cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def entity_row(type_: str | Column, name: Column | str, source: str | Column, confidence: float | Column = 0.75, **props: object) -> Column:
    """One staged entity as a struct column."""
    return F.struct(
        _col(type_).alias("type"), F.trim(_col(name)).alias("name"), _col(source).alias("source"),
        _col(confidence).cast("double").alias("confidence"), properties(**props).alias("properties"),
    )


def connection_row(
    from_type: str | Column, from_name: Column | str, relation: str | Column, to_type: str | Column, to_name: Column | str,
    source: str | Column, confidence: float | Column = 0.75, **props: object,
) -> Column:
    """One staged connection as a struct column."""
    return F.struct(
        _col(from_type).alias("from_type"), F.trim(_col(from_name)).alias("from_name"), _col(relation).alias("relation"),
        _col(to_type).alias("to_type"), F.trim(_col(to_name)).alias("to_name"), _col(source).alias("source"),
        _col(confidence).cast("double").alias("confidence"), properties(**props).alias("properties"),
    )


def entities(df: DataFrame, *rows: Column) -> DataFrame:
    """All entity rows of ``df`` from one scan; rows without a name are dropped."""
    x = df.select(F.explode(F.array(*rows)).alias("r")) if len(rows) > 1 else df.select(rows[0].alias("r"))
    return x.select("r.*").filter(F.coalesce("name", F.lit("")) != "")


def connections(df: DataFrame, *rows: Column) -> DataFrame:
    """All connection rows of ``df`` from one scan; rows without both names are dropped."""
    x = df.select(F.explode(F.array(*rows)).alias("r")) if len(rows) > 1 else df.select(rows[0].alias("r"))
    return x.select("r.*").filter((F.coalesce("from_name", F.lit("")) != "") & (F.coalesce("to_name", F.lit("")) != ""))


def entity(df: DataFrame, *args: object, **kwargs: object) -> DataFrame:
    """``entities`` for a single row per record."""
    return entities(df, entity_row(*args, **kwargs))


def connection(df: DataFrame, *args: object, **kwargs: object) -> DataFrame:
    """``connections`` for a single row per record."""
    return connections(df, connection_row(*args, **kwargs))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str, fmt: str, schema: str, **options: str) -> DataFrame:
    """Landed files with an explicit schema: json (lines, bad lines tolerated), csv (header), xml (rowTag), parquet."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true").option("escape", '"')
    if fmt == "json":
        r = r.option("mode", "PERMISSIVE")
    return r.format(fmt).options(**options).load(path)
