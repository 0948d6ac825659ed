"""Forecast scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.text import lookup_column
from ripplegraph.operators.timeline import asof_join

# Asset symbol -> price-feed id; sample-size guards.
COIN_IDS = {"BTC": "bitcoin", "ETH": "ethereum", "SOL": "solana", "DOGE": "dogecoin", "XRP": "ripple"}
MIN_RUN, MIN_PUBLISH, WARN_RATE = 20, 100, 0.70


def coin_id(asset: Column) -> Column:
    """J17"""
    return F.coalesce(lookup_column(COIN_IDS, F.upper(asset)), F.lower(asset))


def _score(x: DataFrame) -> DataFrame:
    """direction_correct = (actual > predicted) == (predicted > 0)."""
    right = (F.col("actual_price") > F.col("predicted_price")) == (F.col("predicted_price") > 0)
    return x.withColumn("resolved", F.col("actual_price").isNotNull()).withColumn("direction_correct", F.when(F.col("actual_price").isNotNull(), right))


def resolve_asof(pred: DataFrame, prices: DataFrame) -> DataFrame:
    """pred(asset, resolution_time, predicted_price, …) with the last price(asset, ts, actual_price) at or before resolution."""
    return _score(asof_join(pred, prices, "asset", "resolution_time", "ts", "actual_price"))


def resolve_daily(pred: DataFrame, daily: DataFrame) -> DataFrame:
    """The price of the resolution day, daily(asset, day, actual_price)."""
    return _score(pred.withColumn("day", F.to_date("resolution_time")).join(daily, ["asset", "day"], "left"))


def backtest(pred: DataFrame) -> DataFrame:
    """Win rate and mean absolute error of resolved predictions with the sample-size flags."""
    ok = pred.filter(F.col("resolved") & F.col("actual_price").isNotNull() & (F.col("actual_price") != 0))
    x = ok.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("direction_correct").cast("double")).alias("win_rate"),
        F.avg(F.abs(F.col("actual_price") - F.col("predicted_price")) / F.col("actual_price")).alias("mae"),
    )
    n = F.col("n")
    return x.withColumn("enough", n >= MIN_RUN).withColumn("publish", n >= MIN_PUBLISH).withColumn("warn", (n < MIN_PUBLISH) & (F.col("win_rate") > WARN_RATE))


def leaderboard(pred: DataFrame, min_resolved: int = MIN_RUN) -> DataFrame:
    """Assets with enough resolved predictions by win rate."""
    g = pred.filter("resolved").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if("direction_correct").alias("wins"))
    return g.filter(F.col("n") >= min_resolved).withColumn("win_rate", F.col("wins") / F.col("n")).orderBy(F.col("win_rate").desc(), "asset")
