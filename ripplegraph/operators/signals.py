"""Time-series and market signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.text import words
from ripplegraph.operators.common import top_k
from ripplegraph.operators.overlap import weighted_overlap
from ripplegraph.operators.timeline import HOUR, lagged, micros

# Thresholds of the signal rules, topic table, source intervals in seconds.
DIVERGENCE, BOND, BOND_SCALE = 0.04, 0.97, 0.85
SETTLE_LOW, SETTLE_HIGH, WHALE_SHARE, JUMP = 0.85, 0.97, 0.30, 0.15
TOPICS = (
    ("indices/sp500", "BUY", ("fed rate", "fomc", "rate cut")), ("indices/sp500", "SELL", ("rate hike", "hawkish")), ("indices/nasdaq", "BUY", ("bitcoin", "btc", "crypto")),
    ("forex/gbpusd", "SELL", ("trump", "election", "republican")), ("commodities/oil", "BUY", ("ukraine", "russia", "nato")), ("commodities/gold", "BUY", ("gold", "safe haven")),
    ("indices/ftse", "SELL", ("recession", "gdp slowdown")),
)
SOURCE_INTERVALS = {"daily": 86400, "monthly": 2592000, "6h": 21600, "12h": 43200, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200}
DAY_US = 24 * HOUR * 1_000_000


def latest_signals(signals: DataFrame, per_metric: int = 100, overall: int | None = 100) -> DataFrame:
    """Latest rows per (entity, metric), then the latest per entity."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    x = top_k(signals, ["entity", "metric"], order, per_metric)
    return x if overall is None else top_k(x, ["entity"], order, overall)


def divergence(prices: DataFrame, a: str, b: str, threshold: float = DIVERGENCE) -> DataFrame:
    """prices(venue, market, day, price) of two venues that differ by more than the threshold."""
    side = lambda v: prices.filter(F.col("venue") == v).select("market", "day", F.col("price").alias(f"price_{v}"))
    gap = F.col(f"price_{a}") - F.col(f"price_{b}")
    return (
        side(a).join(side(b), ["market", "day"]).withColumn("gap", gap).filter(F.abs("gap") > threshold)
        .withColumn("direction", F.when(F.col("gap") > 0, "bullish").otherwise("bearish"))
        .withColumn("confidence", F.least(F.lit(0.85), F.abs("gap") * 4 + 0.5))
    )


def bond_signals(prices: DataFrame, matched: Column, threshold: float = BOND) -> DataFrame:
    """Near-certain prices on a matched topic; confidence .85 * price."""
    return prices.filter((F.col("price") > threshold) & matched).withColumn("confidence", F.col("price") * BOND_SCALE)


def match_titles(a: DataFrame, b: DataFrame, min_words: int = 3, min_len: int = 4) -> DataFrame:
    """Pairs of a(id, title) and b(id, title) that share at least ``min_words`` long words.

    The two commonest words of a title never propose a pair (see ``overlap``), so a word found in
    every title costs nothing, and no pair is lost.
    """
    tok = lambda df, k: df.select(F.col("id").alias(k), F.explode(F.array_distinct(words(F.col("title"), min_len))).alias("value"))
    left, right = tok(a, "lid"), tok(b, "rid")
    both = left.select("value").unionByName(right.select("value"))
    w = both.groupBy("value").agg(F.lit(1.0).alias("w"), F.count(F.lit(1)).alias("f"))
    # ids of the two venues live in different spaces: mark them so equal ids are not taken for a self pair
    left, right = left.withColumn("lid", F.concat(F.lit("a:"), "lid")), right.withColumn("rid", F.concat(F.lit("b:"), "rid"))
    out = weighted_overlap(left, right, w, float(min_words), max_tail=max(1, min_words - 1))
    return out.select(F.substring("lid", 3, 1_000_000).alias("a"), F.substring("rid", 3, 1_000_000).alias("b"), F.col("n_common").alias("shared"))


def topics(texts: DataFrame, text: str, table: tuple[tuple[str, str, tuple[str, ...]], ...] = TOPICS) -> DataFrame:
    """One row per matched (instrument, direction) of a text."""
    t = F.lower(text)
    rows = [
        F.when(F.array_contains(F.array(*[F.contains(t, F.lit(w)) for w in ws]), True), F.struct(F.lit(i).alias("instrument"), F.lit(d).alias("direction"))) for i, d, ws in table
    ]
    hit = texts.withColumn("_m", F.explode(F.filter(F.array(*rows), lambda m: m.isNotNull())))
    return hit.select(*texts.columns, "_m.instrument", "_m.direction")


def yes_price(markets: DataFrame) -> DataFrame:
    """markets(tokens array<struct<outcome, price>>, last_trade, best_ask) -> price of YES, else last trade, else ask."""
    yes = F.get(F.filter("tokens", lambda t: F.upper(t["outcome"]) == "YES"), F.lit(0))["price"]
    return markets.withColumn("yes_price", F.coalesce(yes, "last_trade", "best_ask"))


def midpoint(ask: Column, bid: Column) -> Column:
    """Cents to probability."""
    return (ask + bid) / 2 / 100


def settlement_gap(settled: DataFrame, prices: DataFrame) -> DataFrame:
    """Markets settled at one venue that still trade between .85 and .97 at the other."""
    return prices.filter(F.col("price").between(SETTLE_LOW, SETTLE_HIGH)).join(settled.select("market", "day"), ["market", "day"], "left_semi")


def top_wallets(trades: DataFrame, k: int = 30) -> DataFrame:
    """trades(maker, market, usdc) -> largest wallets by volume with their rank."""
    g = trades.groupBy("maker").agg(F.sum("usdc").alias("volume"), F.count(F.lit(1)).alias("trades"))
    best = g.orderBy(F.col("volume").desc(), "maker").limit(k).withColumn("_all", F.lit(0))
    return top_k(best, ["_all"], [F.col("volume").desc(), F.col("maker")], k, rank="rank").drop("_all")


def whales(trades: DataFrame, share: float = WHALE_SHARE) -> DataFrame:
    """The largest wallet of every market when it holds more than ``share`` of the volume."""
    per = trades.groupBy("market", "maker").agg(F.sum("usdc").alias("v"))
    m = per.groupBy("market").agg(F.sum("v").alias("total"), F.max(F.struct("v", "maker")).alias("top"))
    return m.select("market", F.col("top.maker").alias("maker"), (F.col("top.v") / F.col("total")).alias("share")).filter(F.col("share") > share)


def jumps(prices: DataFrame, key: str, threshold: float = JUMP) -> DataFrame:
    """prices(key, ts, price, id) that moved by more than the threshold since the previous row."""
    x = lagged(prices, [key], ["ts", "id"], ["price"], micros("ts"), DAY_US)
    move = F.abs(F.col("price") - F.col("prev_price")) / F.col("prev_price")
    return x.withColumn("move", move).filter((F.col("prev_price") > 0) & (F.col("move") > threshold))


def crossings(scores: DataFrame, key: str, level: float = 0.5) -> DataFrame:
    """Rows where a score crosses the level."""
    x = lagged(scores, [key], ["ts", "id"], ["score"], micros("ts"), DAY_US)
    return x.filter(F.col("prev_score").isNotNull() & ((F.col("score") > level) != (F.col("prev_score") > level)))


def gaps(rows: DataFrame, key: str, cycle_seconds: int, cycles: int = 2) -> DataFrame:
    """Silences of more than ``cycles`` cycles between rows of a key."""
    x = lagged(rows.withColumn("_us", micros("ts")), [key], ["ts", "id"], ["_us"], micros("ts"), DAY_US)
    silent = (F.col("_us") - F.col("prev__us")) / 1_000_000
    return x.withColumn("silent_seconds", silent).filter(F.col("silent_seconds") > cycle_seconds * cycles).drop("_us", "prev__us")


def transitions(states: DataFrame, key: str, state: str) -> DataFrame:
    """Rows whose state differs from the key's previous state."""
    x = lagged(states, [key], ["ts", "id"], [state], micros("ts"), DAY_US)
    return x.filter(F.col(f"prev_{state}").isNotNull() & (F.col(state) != F.col(f"prev_{state}")))


def momentum(events: DataFrame, key: str, asof: Column, hours: int = 48) -> DataFrame:
    """Events of the last ``hours`` against the ``hours`` before, per key."""
    step = F.make_dt_interval(hours=F.lit(hours))
    now, before = asof - step, asof - step - step
    x = events.filter((F.col("ts") > before) & (F.col("ts") <= asof))
    return x.groupBy(key).agg(F.count_if(F.col("ts") > now).alias("recent"), F.count_if(F.col("ts") <= now).alias("previous")).withColumn("momentum", F.col("recent") - F.col("previous"))


def staleness(rows: DataFrame, key: str, asof: Column, cadence: str = "1h") -> DataFrame:
    """Age of the newest row per source in seconds and whether the source is due again."""
    last = rows.groupBy(key).agg(F.max("ts").alias("last_ts"))
    age = (F.unix_micros(asof.cast("timestamp")) - micros("last_ts")) / 1_000_000
    return last.withColumn("age_seconds", age).withColumn("due", F.col("age_seconds") >= SOURCE_INTERVALS[cadence])
