"""Portfolio exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.common import round_js, top_k

# Exposure channels and the warning borders.
CHANNELS = ("credit", "liquidity", "sentiment", "supply_chain", "regulation", "counterparty")
RISK_CHANNELS = ("credit", "liquidity", "sentiment", "supply_chain", "counterparty")
HIGH, MEDIUM, DEFAULT_CONFIDENCE = 0.3, 0.15, 0.5


def exposures(positions: DataFrame, links: DataFrame) -> DataFrame:
    """(portfolio_id, kind, label, score): sum of weight * confidence / total weight.

    links(entity, kind, label, confidence): exposure of an entity to a channel, a regime or a crash.
    Portfolio totals are aggregated first, then one join on the entity.
    """
    total = positions.groupBy("portfolio_id").agg(F.sum("weight").alias("total"))
    x = positions.join(links, "entity").withColumn("w", F.col("weight") * F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(DEFAULT_CONFIDENCE)))
    g = x.groupBy("portfolio_id", "kind", "label").agg(F.sum("w").alias("raw"), F.count(F.lit(1)).alias("positions"))
    return g.join(total, "portfolio_id").select(
        "portfolio_id", "kind", "label", "raw", "positions", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(0.0).alias("score")
    )


def channel_map(positions: DataFrame, links: DataFrame, channels: tuple[str, ...] = RISK_CHANNELS, digits: int = 2) -> DataFrame:
    """Every channel of every portfolio, zeros included, with rank and warning level."""
    every = positions.select("portfolio_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(c) for c in channels])))
    got = exposures(positions, links.filter("kind = 'channel'")).select("portfolio_id", "label", "score")
    x = every.join(got, ["portfolio_id", "label"], "left").withColumn("exposure", round_js(F.coalesce("score", F.lit(0.0)), digits))
    x = top_k(x, ["portfolio_id"], [F.col("exposure").desc(), F.col("label")], len(channels), rank="rank")
    level = F.when(F.col("exposure") > HIGH, "HIGH").when(F.col("exposure") > MEDIUM, "MEDIUM").otherwise("LOW")
    return x.select("portfolio_id", F.col("label").alias("channel"), "exposure", "rank", level.alias("warning"))


def crash_exposure(positions: DataFrame, links: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` crashes a portfolio is most exposed to, with the number of positions behind each."""
    x = exposures(positions, links.filter("kind = 'crash'"))
    return top_k(x, ["portfolio_id"], [F.col("raw").desc(), F.col("label")], k).select("portfolio_id", F.col("label").alias("crash"), F.col("raw").alias("exposure"), "positions")


def exposure_edges(positions: DataFrame, links: DataFrame) -> DataFrame:
    """PORTFOLIO_EXPOSED_TO edges by channel and by regime, score to four digits, confidence min(score, 1)."""
    x = exposures(positions, links.filter("kind in ('channel', 'regime')")).filter("score > 0")
    return x.select(
        F.col("portfolio_id").alias("from_id"), F.lit("PORTFOLIO_EXPOSED_TO").alias("relation"), F.concat_ws("-", "kind", F.regexp_replace("label", "_", "-")).alias("to_id"),
        F.round("score", 4).alias("score"), F.least(F.round("score", 4), F.lit(1.0)).alias("confidence"),
    )
