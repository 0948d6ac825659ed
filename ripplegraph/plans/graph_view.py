"""Graph tables seen over the driver's Parquet tables, in Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import exists, in_pass, passes_for, scratch_path, shuffles_for, size_tasks, write_scratch

RELATIONS = ("located_in", "part_of", "purchases_from", "supplies_to", "operates_in")
TYPES = ("Region", "Nation", "Company", "FinancialInstitution", "Corporation", "Product", "Industry")
#: Values of the column by which a graph table lies in folders.
_VALUES = {"entities": TYPES, "relationships": RELATIONS}
#: Relations that shuffle all lines twice over, made in passes over their first end.
_IN_PASSES = ("operates_in",)


_ROWS: dict[tuple[str, str, str], int] = {}


def _rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a driver table, read from its footers once per session."""
    k = (spark.sparkContext.applicationId, sf_dir, name)
    if k not in _ROWS:
        _ROWS[k] = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return _ROWS[k]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the session's tasks are sized for its rows."""
    size_tasks(spark, _rows(spark, sf_dir, name))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d(x: float) -> Column:
    return F.lit(float(x))


def key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def _regime(col: str) -> Column:
    c = F.col(col)
    return (
        F.when(c < 0, "stressed").when(c < 1000, "pre_tipping").when(c > 9000, "post_event").otherwise("normal")
    )


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, by: str, build: Callable[[SparkSession, str], dict[str, DataFrame]]) -> DataFrame:
    """Graph table written once per session, a folder for each value of ``by``; later queries only read it.

    A filter on ``by`` prunes directories, and the files' sizes let the planner pick joins.  ``build`` gives
    the rows of each value, so no task sorts its rows by ``by``, as ``partitionBy`` would.
    """
    k = (spark.sparkContext.applicationId, sf_dir, name)
    lines = _rows(spark, sf_dir, "lineitem")
    size_tasks(spark, lines)
    if k not in _STORED or not all(exists(spark, f"{_STORED[k]}/{by}={v}") for v in _VALUES[name]):
        path = scratch_path(spark, name)
        with shuffles_for(spark, lines):
            parts = build(spark, sf_dir)
            for v in _VALUES[name]:
                n = passes_for(lines) if v in _IN_PASSES else 1
                for i in range(n):
                    write_scratch(parts[v].filter(in_pass("from_id", i, n)).drop(by) if n > 1 else parts[v].drop(by), f"{path}/{by}={v}", "append")
        _STORED[k] = path
    return spark.read.parquet(_STORED[k])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities(id, type, name, confidence, regime), partitioned by type."""
    return _stored(spark, sf_dir, "entities", "type", derive_entities).select("id", "type", "name", "confidence", "regime")


def relationships(spark: SparkSession, sf_dir: str, relations: Iterable[str] = RELATIONS) -> DataFrame:
    """relationships(from_id, relation, to_id, confidence, call_count, causal_weight), partitioned by relation."""
    t = _stored(spark, sf_dir, "relationships", "relation", derive_relationships)
    wanted = list(relations)
    t = t if set(wanted) == set(RELATIONS) else t.filter(F.col("relation").isin(wanted))
    return t.select("from_id", "relation", "to_id", "confidence", "call_count", "causal_weight")


def derive_entities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Entities of each type from the driver tables."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, id_: Column, type_: Column, name: Column, conf: Column, regime: Column) -> DataFrame:
        return df.select(
            id_.alias("id"), type_.alias("type"), name.alias("name"), conf.alias("confidence"), regime.alias("regime")
        )

    def conf(col: str) -> Column:
        return d(0.5) + (F.col(col) % 50) / d(100)

    part, supplier = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    financial = F.coalesce(F.col("s_suppkey") % 10 == 0, F.lit(False))
    frames = [
        rows(load(spark, sf_dir, "region"), key("region", "r_regionkey"), F.lit("Region"), F.col("r_name"), d(0.95), none),
        rows(load(spark, sf_dir, "nation"), key("nation", "n_nationkey"), F.lit("Nation"), F.col("n_name"), d(0.95), none),
        rows(
            load(spark, sf_dir, "customer"), key("cust", "c_custkey"), F.lit("Company"), F.col("c_name"),
            conf("c_custkey"), _regime("c_acctbal"),
        ),
        *(
            rows(supplier.filter(which), key("supp", "s_suppkey"), F.lit(type_), F.col("s_name"), conf("s_suppkey"), _regime("s_acctbal"))
            for type_, which in (("FinancialInstitution", financial), ("Corporation", ~financial))
        ),
        rows(
            part, key("part", "p_partkey"), F.lit("Product"),
            F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")), d(0.8), none,
        ),
        rows(part.select("p_brand").distinct(), key("industry", "p_brand"), F.lit("Industry"), F.col("p_brand"), d(0.9), none),
    ]
    return dict(zip(TYPES, frames, strict=True))


def derive_relationships(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Relationships of each relation from the driver tables."""
    no_weight = F.lit(None).cast("double")
    one = F.lit(1).cast("long")

    def edge(df: DataFrame, f: Column, rel: str, t: Column, conf: Column, n: Column, cw: Column) -> DataFrame:
        return df.select(
            f.alias("from_id"), F.lit(rel).alias("relation"), t.alias("to_id"), conf.alias("confidence"),
            n.alias("call_count"), cw.alias("causal_weight"),
        )

    places = [
        edge(load(spark, sf_dir, table), key(prefix, k), "located_in", key(above, nk), d(0.95), one, no_weight)
        for table, prefix, k, above, nk in (
            ("customer", "cust", "c_custkey", "nation", "c_nationkey"), ("supplier", "supp", "s_suppkey", "nation", "s_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey")
        )
    ]
    frames = [reduce(DataFrame.unionByName, places)]
    frames.append(edge(load(spark, sf_dir, "part"), key("part", "p_partkey"), "part_of", key("industry", "p_brand"), d(0.9), one, no_weight))
    line = load(spark, sf_dir, "lineitem")
    g = (
        load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        .join(line.select("l_orderkey", "l_suppkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    )
    frames.append(
        edge(
            g, key("cust", "o_custkey"), "purchases_from", key("supp", "l_suppkey"),
            F.least(d(0.99), d(0.5) + d(0.05) * F.col("n")), F.col("n"), F.least(d(1), F.col("q") / d(500)),
        )
    )
    g = line.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    frames.append(
        edge(
            g, key("supp", "l_suppkey"), "supplies_to", key("part", "l_partkey"),
            F.least(d(0.99), d(0.5) + d(0.05) * F.col("n")), F.col("n"), no_weight,
        )
    )
    # count per (supplier, part) first: the join then carries pre-aggregated rows
    per_part = line.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    g = (
        per_part.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand").agg(F.sum("n").alias("n"))
    )
    frames.append(
        edge(
            g, key("supp", "l_suppkey"), "operates_in", key("industry", "p_brand"),
            F.least(d(0.99), d(0.3) + d(0.01) * F.col("n")), F.col("n"), no_weight,
        )
    )
    return dict(zip(RELATIONS, frames, strict=True))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hawkes_events(entity_id, entity_type, ts, intensity)"""
    return load(spark, sf_dir, "events").select(
        key("user", "user_id").alias("entity_id"), F.col("event_type").alias("entity_type"), "ts",
        F.col("value").alias("intensity"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        key("user", "user_id").alias("entity"), F.col("event_type").alias("metric"), "value", "ts", "event_id"
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("endpoint"), (F.col("value") * d(10)).alias("duration_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", (F.col("value") / d(100)).alias("cost")
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claims(id, entity, relation, target, assertion, confidence): every document is one publication claim."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        key("claim", "doc_id").alias("id"), F.col("source").alias("entity"), F.lit("published").alias("relation"),
        key("doc", "doc_id").alias("target"), F.col("text").alias("assertion"),
        (d(0.5) + d(0.4) * F.coalesce(F.col("quality"), F.lit(0))).alias("confidence"), "doc_id",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positions(portfolio_id, entity, weight): one portfolio per nation, one position per customer."""
    spend = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("weight"))
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nat = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        spend.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("portfolio_id"), key("cust", "o_custkey").alias("entity"), "weight")
    )


def venue_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue_prices(venue, market, day, price): A = purchase, B = view, daily mean scaled into 0..1."""
    ev = load(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    return (
        ev.withColumn("venue", F.when(F.col("event_type") == "purchase", "A").otherwise("B"))
        .groupBy("venue", key("user", "user_id").alias("market"), F.to_date("ts").alias("day"))
        .agg(F.avg("value").alias("v"))
        .select("venue", "market", "day", (F.col("v") / (F.col("v") + d(50))).alias("price"))
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mentions(entity, source, ts): a source is one topic key on one day."""
    return load(spark, sf_dir, "events").select(
        key("user", "user_id").alias("entity"),
        F.concat(F.get_json_object("props", "$.k"), F.lit("@"), F.to_date("ts").cast("string")).alias("source"), "ts",
    )


# --- the same views as SQL common table expressions -----------------------------------------

_REGIME_SQL = "CASE WHEN {c} < 0 THEN 'stressed' WHEN {c} < 1000 THEN 'pre_tipping' WHEN {c} > 9000 THEN 'post_event' ELSE 'normal' END"

E_SQL = f"""E AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS name, CAST(0.95 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS regime FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, CAST(0.95 AS DOUBLE), NULL FROM nation
  UNION ALL SELECT 'cust:' || c_custkey, 'Company', c_name, CAST(0.5 AS DOUBLE) + (c_custkey % 50) / CAST(100 AS DOUBLE), {_REGIME_SQL.format(c='c_acctbal')} FROM customer
  UNION ALL SELECT 'supp:' || s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'FinancialInstitution' ELSE 'Corporation' END, s_name,
    CAST(0.5 AS DOUBLE) + (s_suppkey % 50) / CAST(100 AS DOUBLE), {_REGIME_SQL.format(c='s_acctbal')} FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Product', p_name || '#' || p_partkey, CAST(0.8 AS DOUBLE), NULL FROM part
  UNION ALL SELECT DISTINCT 'industry:' || p_brand, 'Industry', p_brand, CAST(0.9 AS DOUBLE), NULL FROM part
)"""

R_SQL = """R AS (
  SELECT 'cust:' || c_custkey AS from_id, 'located_in' AS relation, 'nation:' || c_nationkey AS to_id, CAST(0.95 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS call_count, CAST(NULL AS DOUBLE) AS causal_weight FROM customer
  UNION ALL SELECT 'supp:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, CAST(0.95 AS DOUBLE), 1, NULL FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'located_in', 'region:' || n_regionkey, CAST(0.95 AS DOUBLE), 1, NULL FROM nation
  UNION ALL SELECT 'part:' || p_partkey, 'part_of', 'industry:' || p_brand, CAST(0.9 AS DOUBLE), 1, NULL FROM part
  UNION ALL SELECT 'cust:' || o_custkey, 'purchases_from', 'supp:' || l_suppkey, least(CAST(0.99 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n), n, least(CAST(1 AS DOUBLE), q / CAST(500 AS DOUBLE))
    FROM (SELECT o_custkey, l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) g
  UNION ALL SELECT 'supp:' || l_suppkey, 'supplies_to', 'part:' || l_partkey, least(CAST(0.99 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n), n, NULL
    FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) g
  UNION ALL SELECT 'supp:' || l_suppkey, 'operates_in', 'industry:' || p_brand, least(CAST(0.99 AS DOUBLE), CAST(0.3 AS DOUBLE) + CAST(0.01 AS DOUBLE) * n), n, NULL
    FROM (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) g
)"""

EV_SQL = "EV AS (SELECT 'user:' || user_id AS entity_id, event_type AS entity_type, ts, value AS intensity, event_id FROM events)"

POS_SQL = """POS AS (
  SELECT n_name AS portfolio_id, 'cust:' || o_custkey AS entity, w AS weight
  FROM (SELECT o_custkey, sum(o_totalprice) AS w FROM orders GROUP BY 1) o
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

CLAIM_SQL = """CL AS (
  SELECT 'claim:' || d.doc_id AS id, source AS entity, 'published' AS relation, 'doc:' || d.doc_id AS target, text AS assertion,
    CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) * coalesce(quality, 0) AS confidence, d.doc_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

VP_SQL = """VP AS (
  SELECT CASE WHEN event_type = 'purchase' THEN 'A' ELSE 'B' END AS venue, 'user:' || user_id AS market, CAST(ts AS DATE) AS day,
    avg(value) / (avg(value) + CAST(50 AS DOUBLE)) AS price
  FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3
)"""

MENTION_SQL = """MN AS (
  SELECT 'user:' || user_id AS entity, json_extract_string(props, '$.k') || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS source, ts FROM events
)"""


def with_graph(body: str, *extra: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the entity and relationship views (and further view texts)."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([E_SQL, R_SQL, *extra])}\n{body}"
