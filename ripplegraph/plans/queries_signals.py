"""Queries: signals, markets, forecasts, task logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.operators import forecast, signals, stats
from ripplegraph.plans import graph_view as g
from ripplegraph.plans.registry import query

_ASOF = "2024-01-25 00:00:00"


def _asof() -> Column:
    return F.lit(_ASOF).cast("timestamp_ntz")


@query(
    "latest_signals", "W1 W2 T3",
    """SELECT entity, metric, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS r2 FROM (
  SELECT 'user:' || user_id AS entity, event_type AS metric, event_id, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r1 FROM events) WHERE r1 <= 5) WHERE r2 <= 12""",
)
def latest_signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals.latest_signals(g.signals(spark, sf), 5, 12).select("entity", "metric", "event_id", "value")


@query(
    "venue_divergence", "N1",
    f"""WITH {g.VP_SQL} SELECT market, CAST(day AS VARCHAR) AS day, round(gap, 6) AS gap, CASE WHEN gap > 0 THEN 'bullish' ELSE 'bearish' END AS direction, round(least(0.85, 0.5 + 4 * abs(gap)), 6) AS confidence
FROM (SELECT a.market, a.day, a.price - b.price AS gap FROM VP a JOIN VP b ON b.market = a.market AND b.day = a.day WHERE a.venue = 'A' AND b.venue = 'B') WHERE abs(gap) > 0.04""",
)
def venue_divergence(spark: SparkSession, sf: str) -> DataFrame:
    x = signals.divergence(g.venue_prices(spark, sf), "A", "B")
    return x.select("market", F.col("day").cast("string").alias("day"), F.round("gap", 6).alias("gap"), "direction", F.round("confidence", 6).alias("confidence"))


@query(
    "bond_signals", "N2 N7",
    f"""WITH {g.VP_SQL} SELECT 'bond' AS kind, market, CAST(day AS VARCHAR) AS day, round(price * 0.85, 6) AS score FROM VP WHERE venue = 'B' AND price > 0.8
UNION ALL SELECT 'settlement', market, CAST(day AS VARCHAR), round(price, 6) FROM VP b WHERE venue = 'B' AND price BETWEEN 0.85 AND 0.97 AND EXISTS (SELECT 1 FROM VP a WHERE a.venue = 'A' AND a.market = b.market AND a.day = b.day)""",
)
def bond_signals(spark: SparkSession, sf: str) -> DataFrame:
    p = g.venue_prices(spark, sf)
    b = p.filter("venue = 'B'")
    bond = signals.bond_signals(b, F.lit(True), threshold=0.8).select(F.lit("bond").alias("kind"), "market", "day", F.round("confidence", 6).alias("score"))
    gap = signals.settlement_gap(p.filter("venue = 'A'"), b).select(F.lit("settlement").alias("kind"), "market", "day", F.round("price", 6).alias("score"))
    return bond.unionByName(gap).withColumn("day", F.col("day").cast("string"))


@query(
    "title_matches", "N3 U5",
    """WITH H AS (SELECT page_id AS id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')), '') AS t FROM pages),
A AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS w FROM H),
B AS (SELECT DISTINCT item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS w FROM benchmark)
SELECT CAST(A.id AS VARCHAR) AS a, CAST(B.id AS VARCHAR) AS b, count(*) AS shared FROM A JOIN B ON A.w = B.w GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def title_matches(spark: SparkSession, sf: str) -> DataFrame:
    a = g.load(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), text.html_title(F.col("html")).alias("title"))
    b = g.load(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("title"))
    return signals.match_titles(a, b)


_TOPICS = (("indices/a", "BUY", ("the thing", "ention the")), ("indices/b", "SELL", ("eaux", "ement")), ("forex/c", "SELL", ("und", "lich")))


@query(
    "topic_instruments", "N4 J17",
    """SELECT instrument, direction, source, count(*) AS n FROM (SELECT source, lower(text) AS t FROM documents) JOIN (VALUES ('indices/a', 'BUY', 'the thing', 'ention the'), ('indices/b', 'SELL', 'eaux', 'ement'), ('forex/c', 'SELL', 'und', 'lich')) v(instrument, direction, k1, k2) ON contains(t, k1) OR contains(t, k2) GROUP BY 1, 2, 3""",
)
def topic_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return signals.topics(g.load(spark, sf, "documents"), "text", _TOPICS).groupBy("instrument", "direction", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "market_yes_prices", "N5 N6",
    """SELECT l_orderkey AS market, l_linenumber AS line, round(CASE WHEN l_returnflag = 'A' THEN l_discount WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount + 0.5 END, 6) AS yes_price, round((l_quantity + l_tax * 100) / 2 / 100, 6) AS mid FROM lineitem""",
)
def market_yes_prices(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    tok = lambda o, p: F.struct(F.lit(o).alias("outcome"), p.alias("price"))
    m = g.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("market"), F.col("l_linenumber").alias("line"), F.when(flag == "A", F.array(tok("No", F.lit(0.1)), tok("Yes", F.col("l_discount")))).otherwise(F.array(tok("No", F.lit(0.1)))).alias("tokens"),
        F.when(flag == "R", F.col("l_tax")).alias("last_trade"), (F.col("l_discount") + 0.5).alias("best_ask"), signals.midpoint(F.col("l_quantity"), F.col("l_tax") * 100).alias("mid"),
    )
    return signals.yes_price(m).select("market", "line", F.round("yes_price", 6).alias("yes_price"), F.round("mid", 6).alias("mid"))


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    x = g.load(spark, sf, "lineitem").join(g.load(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(g.key("cust", "o_custkey").alias("maker"), g.key("part", "l_partkey").alias("market"), F.col("l_extendedprice").alias("usdc"))


_TRADES = "TD AS (SELECT 'cust:' || o_custkey AS maker, 'part:' || l_partkey AS market, l_extendedprice AS usdc FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(
    "top_wallets", "N8",
    f"WITH {_TRADES} SELECT maker, round(sum(usdc), 2) AS volume, count(*) AS trades, row_number() OVER (ORDER BY sum(usdc) DESC, maker) AS rank FROM TD GROUP BY 1 ORDER BY rank LIMIT 30",
)
def top_wallets(spark: SparkSession, sf: str) -> DataFrame:
    return signals.top_wallets(_trades(spark, sf)).withColumn("volume", F.round("volume", 2))


@query(
    "whale_markets", "N9",
    f"""WITH {_TRADES}, P AS (SELECT market, maker, sum(usdc) AS v FROM TD GROUP BY 1, 2) SELECT market, maker, round(share, 6) AS share FROM (SELECT market, arg_max(maker, (v, maker)) AS maker, max(v) / sum(v) AS share FROM P GROUP BY 1) WHERE share > 0.1""",
)
def whale_markets(spark: SparkSession, sf: str) -> DataFrame:
    return signals.whales(_trades(spark, sf), 0.1).withColumn("share", F.round("share", 6))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return g.load(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), (F.col("value") / 100).alias("score"), F.col("event_type").alias("regime"))


@query(
    "price_jumps", "N10",
    """SELECT key, id, round(abs(price - prev) / prev, 6) AS move FROM (SELECT user_id AS key, event_id AS id, value AS price, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev > 0 AND abs(price - prev) / prev > 0.15""",
)
def price_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return signals.jumps(_stream(spark, sf), "key").select("key", "id", F.round("move", 6).alias("move"))


@query(
    "sentiment_crossings", "N11",
    """SELECT key, id FROM (SELECT user_id AS key, event_id AS id, value / 100 AS s, lag(value / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL AND (s > 0.5) <> (p > 0.5)""",
)
def sentiment_crossings(spark: SparkSession, sf: str) -> DataFrame:
    return signals.crossings(_stream(spark, sf), "key").select("key", "id")


@query(
    "data_gaps", "N12",
    """SELECT key, id, round(s, 3) AS silent_seconds FROM (SELECT user_id AS key, event_id AS id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS s FROM events) WHERE s > 86400""",
)
def data_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return signals.gaps(_stream(spark, sf), "key", 43200).select("key", "id", F.round("silent_seconds", 3).alias("silent_seconds"))


@query(
    "regime_transitions", "N13",
    """SELECT p AS from_state, t AS to_state, count(*) AS n FROM (SELECT event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL AND p <> t GROUP BY 1, 2""",
)
def regime_transitions(spark: SparkSession, sf: str) -> DataFrame:
    x = signals.transitions(_stream(spark, sf), "key", "regime")
    return x.groupBy(F.col("prev_regime").alias("from_state"), F.col("regime").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "narrative_momentum", "N16",
    """SELECT event_type, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-23') AS recent, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-23') AS previous, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-23') - count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-23') AS momentum
FROM events WHERE ts > TIMESTAMP '2024-01-21' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1""",
)
def narrative_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return signals.momentum(g.load(spark, sf, "events"), "event_type", _asof())


@query(
    "source_staleness", "T9 A20",
    """SELECT user_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0, 3) AS age_seconds, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0 >= 86400 AS due FROM events GROUP BY 1""",
)
def source_staleness(spark: SparkSession, sf: str) -> DataFrame:
    x = signals.staleness(g.load(spark, sf, "events"), "user_id", F.lit("2024-02-01").cast("timestamp_ntz"), "daily")
    return x.select("user_id", F.round("age_seconds", 3).alias("age_seconds"), "due")


# --- forecasts ----------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase predicts its own value for a day later."""
    ev = g.load(spark, sf, "events").filter("event_type = 'purchase'")
    return ev.select("event_id", g.key("user", "user_id").alias("asset"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("resolution_time"), F.col("value").alias("predicted_price"))


def _view_prices(spark: SparkSession, sf: str) -> DataFrame:
    ev = g.load(spark, sf, "events").filter("event_type = 'view'")
    return ev.select(g.key("user", "user_id").alias("asset"), "ts", F.col("value").alias("actual_price"))


_RES = """PD AS (SELECT event_id, 'user:' || user_id AS asset, ts + INTERVAL 24 HOUR AS rt, value AS predicted_price FROM events WHERE event_type = 'purchase'),
PX AS (SELECT 'user:' || user_id AS asset, ts, value AS actual_price FROM events WHERE event_type = 'view'),
RS AS (SELECT event_id, PD.asset, predicted_price, actual_price, CASE WHEN actual_price IS NOT NULL THEN (actual_price > predicted_price) = (predicted_price > 0) END AS direction_correct FROM PD ASOF LEFT JOIN PX ON PX.asset = PD.asset AND PX.ts <= PD.rt)"""


@query("prediction_resolution", "J15", f"WITH {_RES} SELECT event_id, asset, actual_price, direction_correct FROM RS")
def prediction_resolution(spark: SparkSession, sf: str) -> DataFrame:
    x = forecast.resolve_asof(_predictions(spark, sf), _view_prices(spark, sf))
    return x.select("event_id", "asset", "actual_price", "direction_correct")


@query(
    "prediction_resolution_daily", "J15",
    """SELECT p.event_id, round(a, 6) AS actual_price, CASE WHEN a IS NOT NULL THEN (a > p.value) = (p.value > 0) END AS direction_correct FROM (SELECT *, CAST(ts + INTERVAL 24 HOUR AS DATE) AS d FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON v.user_id = p.user_id AND v.d = p.d""",
)
def prediction_resolution_daily(spark: SparkSession, sf: str) -> DataFrame:
    daily = _view_prices(spark, sf).groupBy("asset", F.to_date("ts").alias("day")).agg(F.max("actual_price").alias("actual_price"))
    x = forecast.resolve_daily(_predictions(spark, sf), daily)
    return x.select("event_id", F.round("actual_price", 6).alias("actual_price"), "direction_correct")


@query(
    "forecast_backtest", "A11",
    f"""WITH {_RES} SELECT n, round(win_rate, 6) AS win_rate, round(mae, 5) AS mae, n >= 20 AS enough, n >= 100 AS publish, n < 100 AND win_rate > 0.7 AS warn FROM (
  SELECT count(*) AS n, avg(CAST(direction_correct AS INT)) AS win_rate, avg(abs(actual_price - predicted_price) / actual_price) AS mae FROM RS WHERE actual_price IS NOT NULL AND actual_price <> 0)""",
)
def forecast_backtest(spark: SparkSession, sf: str) -> DataFrame:
    x = forecast.backtest(forecast.resolve_asof(_predictions(spark, sf), _view_prices(spark, sf)))
    return x.withColumn("win_rate", F.round("win_rate", 6)).withColumn("mae", F.round("mae", 5))


@query(
    "forecast_leaderboard", "A12",
    f"WITH {_RES} SELECT asset, count(*) AS n, count(*) FILTER (WHERE direction_correct) AS wins, round(count(*) FILTER (WHERE direction_correct) / CAST(count(*) AS DOUBLE), 6) AS win_rate FROM RS WHERE actual_price IS NOT NULL GROUP BY 1 HAVING count(*) >= 10",
)
def forecast_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    x = forecast.leaderboard(forecast.resolve_asof(_predictions(spark, sf), _view_prices(spark, sf)), 10)
    return x.withColumn("win_rate", F.round("win_rate", 6))


@query(
    "pending_predictions", "F10 S29 M17",
    """SELECT event_id, CAST(epoch(ts + INTERVAL 24 HOUR) - epoch(TIMESTAMP '2024-01-25') AS BIGINT) AS seconds_left FROM (SELECT event_id, date_trunc('second', ts) AS ts, value FROM events WHERE event_type = 'purchase') WHERE value >= 50""",
)
def pending_predictions(spark: SparkSession, sf: str) -> DataFrame:
    from ripplegraph.operators import lookup, merge

    p = _predictions(spark, sf).select(F.col("event_id").cast("string").alias("timestamp"), "asset", "predicted_price", "resolution_time", F.lit(False).alias("resolved"))
    done = p.filter("predicted_price < 50").select("timestamp", "asset", F.lit(None).cast("double").alias("predicted_price"), F.lit(None).cast("timestamp_ntz").alias("resolution_time"), F.lit(True).alias("resolved"))
    x = lookup.pending_predictions(merge.upsert_predictions(p, done), _asof())
    return x.select(F.col("timestamp").cast("long").alias("event_id"), F.round(F.col("hours_to_resolution") * 3600).cast("long").alias("seconds_left"))


# --- task logs ----------------------------------------------------------------------------------------


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return g.load(spark, sf, "events").select(
        g.key("user", "user_id").alias("agent_id"), F.when(F.col("user_id") % 2 == 0, "analyst").otherwise("tracker").alias("role"), "ts", F.col("event_id").alias("task_id"), F.col("event_type").alias("outcome")
    )


@query(
    "task_fitness", "A22",
    """SELECT agent_id, role, round(f, 6) AS fitness, CASE WHEN f < 0.3 THEN 'kill' WHEN f >= 0.85 THEN 'clone' ELSE 'keep' END AS label FROM (
  SELECT 'user:' || user_id AS agent_id, CASE WHEN user_id % 2 = 0 THEN 'analyst' ELSE 'tracker' END AS role, least(1.0, (count(*) - count(*) FILTER (WHERE event_type = 'error')) / CAST(count(*) AS DOUBLE) * 0.8 + 0.2) AS f FROM events GROUP BY 1, 2)""",
)
def task_fitness(spark: SparkSession, sf: str) -> DataFrame:
    return stats.task_fitness(_tasks(spark, sf)).select("agent_id", "role", F.round("fitness", 6).alias("fitness"), "label")


@query(
    "last_tasks", "W6",
    "SELECT agent_id, task_id FROM (SELECT 'user:' || user_id AS agent_id, event_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20",
)
def last_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.last_tasks(_tasks(spark, sf), 20).select("agent_id", "task_id")


@query(
    "fact_corroboration", "A25",
    """SELECT source AS entity, lang AS fact, count(*) AS corroborations, count(DISTINCT n_chars % 100) AS n_sources FROM documents GROUP BY 1, 2""",
)
def fact_corroboration(spark: SparkSession, sf: str) -> DataFrame:
    f = g.load(spark, sf, "documents").select(F.col("source").alias("entity"), F.col("lang").alias("fact"), (F.col("n_chars") % 100).alias("source"), F.col("doc_id").alias("ts"))
    return stats.corroboration(f).select("entity", "fact", "corroborations", "n_sources")


@query(
    "source_runs", "A20",
    """SELECT event_type AS source, CAST(sum(user_id) AS BIGINT) AS entities, CAST(sum(event_id) AS BIGINT) AS connections, count(*) FILTER (WHERE value < 1) AS errors FROM events GROUP BY 1""",
)
def source_runs(spark: SparkSession, sf: str) -> DataFrame:
    a = g.load(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("entities"), F.col("event_id").alias("connections"), (F.col("value") < 1).cast("int").alias("errors"), "ts")
    return stats.source_run_stats(a).select("source", "entities", "connections", "errors")


@query(
    "metric_lines", "K8 A13",
    g.with_graph("""SELECT line FROM (SELECT 'graph_nodes_total ' || count(*) AS line FROM E UNION ALL SELECT 'graph_edges_total ' || count(*) FROM R UNION ALL SELECT 'graph_nodes{type="' || type || '"} ' || count(*) FROM E GROUP BY type UNION ALL SELECT 'graph_edges{relation="' || relation || '"} ' || count(*) FROM R GROUP BY relation
  UNION ALL SELECT 'http_request_duration_ms_bucket{endpoint="' || event_type || '",le="' || le || '"} ' || count(*) FILTER (WHERE value * 10.0 <= ub) FROM events CROSS JOIN (VALUES ('10', 10.0), ('50', 50.0), ('100', 100.0), ('250', 250.0), ('500', 500.0), ('1000', 1000.0), ('2500', 2500.0), ('5000', 5000.0), ('+Inf', 1e300)) v(le, ub) GROUP BY event_type, le)"""),
)
def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    return stats.metric_lines(g.entities(spark, sf), g.relationships(spark, sf), g.request_log(spark, sf))
