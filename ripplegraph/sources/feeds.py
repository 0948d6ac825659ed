"""News, social, price and document feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.identity import md5_id
from ripplegraph.functions.text import lookup_column, tone_score
from ripplegraph.operators.common import top_k
from ripplegraph.sources.staging import Batch, connection, entity, union

# Risk channels and regimes with their node ids.
CHANNEL_IDS = {
    "credit": "channel-credit", "liquidity": "channel-liquidity", "sentiment": "channel-sentiment",
    "supply_chain": "channel-supply-chain", "regulation": "channel-regulation", "counterparty": "channel-counterparty",
}
REGIME_IDS = {"normal": "regime-normal", "stressed": "regime-stressed", "pre_tipping": "regime-pre-tipping", "post_event": "regime-post-event"}
# Macro series -> channel.
SERIES_CHANNEL = {
    "DGS2": "credit", "DGS10": "credit", "T10Y2Y": "credit", "FEDFUNDS": "liquidity", "SOFR": "liquidity", "BAMLH0A0HYM2": "credit",
    "TEDRATE": "counterparty", "CPIAUCSL": "regulation", "PCEPI": "regulation", "UNRATE": "sentiment", "VIXCLS": "sentiment",
}
# Entity span label -> ontology type.
ONTOLOGY = {
    "central bank": "FinancialInstitution", "financial institution": "FinancialInstitution", "corporation": "Corporation",
    "crypto asset": "CryptoAsset", "fiat currency": "FiatCurrency", "stock index": "FinancialInstrument", "commodity": "Commodity",
    "government agency": "LegalEntity", "regulatory body": "LegalEntity", "country": "Jurisdiction", "jurisdiction": "Jurisdiction",
    "macro event": "Event", "policy change": "Policy", "market event": "Event", "person": "Person",
}

FEED_ITEM = "title string, link string, pubDate string, description string"
POST = "title string, selftext string, score bigint, num_comments bigint, url string, id string"


def feed_items(items: DataFrame, per_feed: int | None = None, confidence: float = 0.70, kind: str = "reports", family: str = "rss") -> Batch:
    """items(feed, position, title, link, published, description) -> events of a source.

    With ``per_feed``, a feed contributes its first items only.  The whole title is the event's name.
    """
    x = items if per_feed is None else top_k(items, ["feed"], [F.col("position")], per_feed)
    x = x.filter(F.coalesce("title", F.lit("")) != "")
    title = F.col("title")
    slug = F.concat(F.lit(family + ":"), F.regexp_replace(F.lower("feed"), " ", "_"))
    ent = union(
        entity(
            x, "Event", title, slug, confidence, url=F.col("link"), published=F.col("published"), description=F.col("description"), feed=F.col("feed")
        ),
        entity(x.select("feed").distinct(), "InformationSource", F.col("feed"), family, type="news_feed"),
    )
    return Batch(ent, connection(x, "InformationSource", F.col("feed"), "related_to", "Event", title, family, type=kind))


def articles(rows: DataFrame) -> Batch:
    """Article list rows(theme, title, url, domain, sourcecountry, language, seendate, tone)."""
    x = rows.withColumn("t", F.col("title")).filter(F.coalesce("t", F.lit("")) != "")
    ent = union(
        entity(
            x, "Event", F.col("t"), "gdelt", 0.70, url=F.col("url"), source_country=F.col("sourcecountry"), language=F.col("language"),
            domain=F.col("domain"), seendate=F.col("seendate"), theme=F.col("theme"), tone=F.col("tone"),
        ),
        entity(x.select("domain", "sourcecountry").distinct(), "InformationSource", F.col("domain"), "gdelt", type="news_outlet", country=F.col("sourcecountry")),
    )
    return Batch(ent, connection(x, "InformationSource", F.col("domain"), "related_to", "Event", F.col("t"), "gdelt", type="reports"))


def coins(c: DataFrame) -> DataFrame:
    """coins(name, symbol, market_cap, current_price, change_24h, rank)."""
    return entity(
        c, "FinancialInstrument", F.col("name"), "coingecko", 0.90, symbol=F.upper("symbol"), type="cryptocurrency", market_cap_usd=F.col("market_cap"),
        current_price_usd=F.col("current_price"), price_change_24h=F.col("change_24h"),
    )


def exchanges(x: DataFrame) -> Batch:
    """exchanges(name, country, trust_score) with headquarters when a country is given."""
    ent = entity(x, "FinancialInstitution", F.col("name"), "coingecko", 0.85, type="crypto_exchange", country=F.col("country"), trust_score=F.col("trust_score"))
    return Batch(ent, connection(x, "FinancialInstitution", F.col("name"), "headquartered_in", "Jurisdiction", F.col("country"), "coingecko"))


def traded_on(c: DataFrame, venues: list[str], top: int = 10) -> DataFrame:
    """The ``top`` coins by rank on each of the named venues (a request parameter, not data)."""
    best = c.orderBy("rank", "name").limit(top).withColumn("venue", F.explode(F.array(*[F.lit(v) for v in venues])))
    return connection(best, "FinancialInstrument", F.col("name"), "traded_on", "FinancialInstitution", F.col("venue"), "crypto_loader", 0.7)


def macro_latest(obs: DataFrame) -> DataFrame:
    """observations(series_id, date, value text) -> newest row per series, skipped when it is ``.``.

    (id, series_id, date, value, channel_id) with the ``indicates`` target as a column.
    """
    last = obs.groupBy("series_id").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    x = last.filter(F.col("value") != ".")
    return x.select(
        F.concat_ws("-", F.lit("ts-fred"), "series_id", "date").alias("id"), "series_id", "date", F.col("value").cast("double").alias("value"),
        lookup_column(CHANNEL_IDS, lookup_column(SERIES_CHANNEL, F.col("series_id"))).alias("channel_id"),
    )


def price_mood(prices: DataFrame) -> DataFrame:
    """prices(asset, day, price, change_24h) -> mood and, on fear, the sentiment channel it indicates."""
    c = F.col("change_24h")
    return prices.withColumn("mood", F.when(c < -5, "fear").when(c > 5, "greed").otherwise("neutral")).withColumn(
        "channel_id", F.when(c < -5, F.lit(CHANNEL_IDS["sentiment"]))
    )


def mood_index(points: DataFrame) -> DataFrame:
    """points(day, value 0..100, classification) -> sentiment points scaled to 0..1 with their channel."""
    return points.select(
        F.concat_ws("-", F.lit("sentiment-crypto-fng"), F.col("day").cast("string")).alias("id"), "classification",
        (F.col("value") / 100.0).alias("score"), F.lit(CHANNEL_IDS["sentiment"]).alias("channel_id"), F.lit(0.8).alias("confidence"),
    )


def event_actors(records: DataFrame, per_record: int | None = None) -> DataFrame:
    """S23/W7/X-E7: records(url, title, themes, persons, orgs comma lists, tone) -> (actor, url, title, themes, tone, score).

    Persons come before organisations; names shorter than two characters are skipped.  With
    ``per_record``, only the first non-blank names of a record count.
    """
    names = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    who = F.concat(names("persons"), names("orgs"))
    who = who if per_record is None else F.slice(who, 1, per_record)
    x = records.select("url", "title", "themes", F.col("tone").cast("double").alias("tone"), F.explode(who).alias("actor"))
    return x.filter(F.length("actor") >= 2).withColumn("score", tone_score(F.col("tone")))


def actor_signals(actors: DataFrame) -> DataFrame:
    return actors.select(F.col("actor").alias("entity"), F.lit("cross_border_sentiment").alias("metric"), F.col("score").alias("value"))


def actor_claims(actors: DataFrame) -> DataFrame:
    themes = F.split("themes", ",")
    return actors.select(
        F.col("actor").alias("entity"), F.lit("GDELT_EVENT").alias("relation"), F.col("url").alias("target"),
        F.to_json(F.struct("title", "tone", themes.alias("themes"))).alias("assertion"), F.lit(0.7).alias("confidence"),
    )


def listing_posts(landed: DataFrame) -> DataFrame:
    """Listing JSON text (group, body) -> posts."""
    kids = F.from_json(F.get_json_object("body", "$.data.children"), f"array<struct<data:struct<{POST.replace(' ', ':').replace(',:', ',')}>>>")
    return landed.select("group", F.explode(kids).alias("k")).select("group", "k.data.*")


def spans(docs: DataFrame, ontology: dict[str, str] | None = None) -> DataFrame:
    """docs(document_id, raw_text, spans array<struct<text,start,end,label,score>>) -> entity rows.

    The surface form is cut from the text by offsets; unknown labels become ``Entity``.
    """
    s = F.col("s")
    x = docs.select("document_id", "raw_text", F.explode("spans").alias("s"))
    surface = F.coalesce(F.nullif(s["text"], F.lit("")), F.substring(F.col("raw_text"), s["start"] + 1, s["end"] - s["start"]))
    return x.select(
        "document_id", surface.alias("name"), lookup_column(ontology or ONTOLOGY, F.lower(s["label"]), "Entity").alias("type"),
        s["score"].alias("confidence"), s["start"].alias("start"), s["end"].alias("end"),
    )


def document_entities(docs: DataFrame) -> DataFrame:
    """One id per distinct (type, name) mention of a document."""
    x = spans(docs)
    return x.withColumn("id", md5_id("ent", F.concat_ws(":", "type", "name"), 12))


def span_entities(rows: DataFrame, ontology: dict[str, str] | None = None) -> DataFrame:
    """Span rows (document_id, name, start, stop, label, score) with their type and id."""
    x = rows.withColumn("type", lookup_column(ontology or ONTOLOGY, F.lower("label"), "Entity"))
    return x.withColumn("id", md5_id("ent", F.concat_ws(":", "type", "name"), 12))


PREDICTION_LOG = "timestamp string, asset string, predicted_price double, resolution_time string, actual_price double, direction_correct boolean, resolved boolean"


def prediction_flags(text: Column) -> Column:
    """Any spelling of true/false -> BOOLEAN, blank -> NULL."""
    t = F.lower(F.trim(text))
    return F.when(t == "true", True).when(t == "false", False)
