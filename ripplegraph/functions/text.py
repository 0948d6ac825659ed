"""Text helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns.
BARE_DOMAIN = r"(?:https?://)?(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,})(?:/|$)"
SENIORITY = r"(?i)\b(senior|sr|junior|jr|lead|principal|associate|staff|vp of|head of|director of|chief)\b"
TOOL_PREFIX = r"^{name}[/_-]?"

# JSON field name -> entity type.
FIELD_TYPES = {
    "company": "Company", "organization": "Company", "business": "Company", "firm": "Company",
    "person": "Person", "name": "Person", "author": "Person", "creator": "Person",
    "location": "Location", "city": "Location", "country": "Location", "region": "Location", "address": "Location",
    "domain": "Domain", "website": "Domain", "url": "Domain",
    "technology": "Technology", "tech": "Technology", "platform": "Technology", "tool": "Technology",
    "industry": "Industry", "sector": "Industry", "market": "Market",
    "event": "Event", "incident": "Event", "occurrence": "Event",
    "trend": "Trend", "pattern": "Trend", "movement": "Trend",
    "risk": "Risk", "threat": "Risk", "danger": "Risk",
    "opportunity": "Opportunity", "prospect": "Opportunity",
    "topic": "Topic", "subject": "Topic", "theme": "Topic",
    "sentiment": "Sentiment", "mood": "Sentiment", "feeling": "Sentiment",
    "indicator": "Indicator", "metric": "Indicator", "signal": "Indicator",
    "forecast": "Forecast", "prediction": "Forecast", "projection": "Forecast",
    "policy": "Policy", "rule": "Policy", "regulation": "Regulation",
    "asset": "Asset", "resource": "Asset", "holding": "Asset",
    "actor": "Actor", "agent": "Actor", "player": "Actor",
    "network": "Network", "graph": "Network", "system": "Network",
    "narrative": "Narrative", "story": "Narrative", "account": "Narrative",
    "source": "InformationSource", "origin": "InformationSource", "reference": "InformationSource",
}


def lookup_column(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """Value of a small fixed table for ``key``."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hit = F.element_at(m, key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def extract_domain(text: Column) -> Column:
    """Host of a URL or bare domain without ``www.``; it must hold a dot and more than three characters."""
    url = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    bare = F.regexp_extract(text, BARE_DOMAIN, 1)
    return F.when(F.contains(host, F.lit(".")) & (F.length(host) > 3), host).otherwise(F.when(bare != "", bare))


def normalise_title(title: Column) -> Column:
    """Job title without seniority words, in title case.

    ``initcap`` starts a word after white space only, so ``co-founder`` keeps its small f.
    """
    s = F.regexp_replace(title, SENIORITY, "")
    return F.initcap(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))))


def clean_properties(props: Column) -> Column:
    """Drop NULL and empty values."""
    return F.map_filter(props, lambda k, v: v.isNotNull() & (v != ""))


def tool_name(name: Column, prefix: str = "") -> Column:
    """Lower case, optional product prefix removed, dashes and blanks to underscores."""
    s = F.lower(name)
    if prefix:
        s = F.regexp_replace(s, TOOL_PREFIX.format(name=prefix), "")
    return F.trim(F.regexp_replace(s, r"[-\s]", "_"))


def tone_score(tone: Column) -> Column:
    """max(-1, min(1, tone / 10))."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tone / 10.0))


def html_lines(html: Column, drop: tuple[str, ...] = ("script", "style", "nav", "footer", "aside")) -> Column:
    """Visible text lines, without comments and the dropped elements."""
    s = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in drop:
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", "\n")
    lines = F.transform(F.split(s, r"\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def html_text(html: Column) -> Column:
    return F.array_join(html_lines(html), "\n")


def _first_group(html: Column, pattern: str) -> Column:
    hit = F.regexp_extract(html, pattern, 1)
    return F.when(hit != "", hit)


def html_title(html: Column) -> Column:
    """<title>, else the first <h1>."""
    strip = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"<[^>]+>", "")), F.lit(""))
    return F.coalesce(
        strip(_first_group(html, r"(?is)<title[^>]*>(.*?)</title>")), strip(_first_group(html, r"(?is)<h1[^>]*>(.*?)</h1>"))
    )


def html_field(html: Column, selector: str) -> Column:
    """Text of the first element matching ``tag``, ``#id`` or ``.class``."""
    if selector.startswith("#"):
        p = rf"""(?is)<(\w+)[^>]*\bid=["']{selector[1:]}["'][^>]*>(.*?)</\1>"""
        raw = F.regexp_extract(html, p, 2)
    elif selector.startswith("."):
        p = rf"""(?is)<(\w+)[^>]*\bclass=["'][^"']*\b{selector[1:]}\b[^"']*["'][^>]*>(.*?)</\1>"""
        raw = F.regexp_extract(html, p, 2)
    else:
        raw = F.regexp_extract(html, rf"(?is)<{selector}\b[^>]*>(.*?)</{selector}>", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, r"<[^>]+>", "")), F.lit(""))


def words(text: Column, min_len: int = 1) -> Column:
    """Lower-case words of letters and digits of at least ``min_len`` characters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= min_len)


def sentiment(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """C17: (key, positive, negative, neutral, compound) from lexicon(word, score).

    Texts are split once; a text's tokens stay in its partition, so they combine map-side and
    one row per text is shuffled.
    """
    tok = texts.select(key, F.explode(words(F.col(text))).alias("word")).join(lexicon, "word", "left")
    x = tok.groupBy(key).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("score") > 0).alias("p"), F.count_if(F.col("score") < 0).alias("m"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"),
    )
    t, s = F.col("t"), F.col("s")
    return x.select(
        key, (F.col("p") / t).alias("positive"), (F.col("m") / t).alias("negative"),
        ((t - F.col("p") - F.col("m")) / t).alias("neutral"), (s / F.sqrt(s * s + 15)).alias("compound"),
    )


def pattern_spans(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, name, start, stop): all matches of ``pattern`` in whole texts, by code points, stop exclusive.

    Matches and the pieces between them come from two expressions; places are running sums over a
    text's matches as rows, so a text with very many costs time in proportion.  The pattern must
    not match the empty string; rows of one key are one text each by their own number.
    """
    x = docs.filter(F.col(text).isNotNull()).select(
        F.monotonically_increasing_id().alias("_r"), F.col(key).alias(key), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")
    ).filter(F.size("m") > 0)
    x = x.select("_r", key, F.posexplode(F.arrays_zip("m", F.slice("g", F.lit(1), F.size("m")).alias("g"))).alias("i", "z"))
    x = x.select("_r", key, "i", F.col("z.m").alias("name"), (F.length("z.g") + F.length("z.m")).cast("bigint").alias("_n"))
    run = Window.partitionBy("_r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("_n").over(run)
    return x.select(key, "name", (stop - F.length("name")).alias("start"), stop.alias("stop"))
