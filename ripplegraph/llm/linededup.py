"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the pages of the host; lines whose ratio
exceeds the limit are boilerplate and leave every page of that host.  A line is compared without
blanks at its ends; blank lines are neither counted nor dropped.

Only 16-byte digests of lines are shuffled, one per line and page, and counts are combined before
they move.  A host that holds a third of the pages is no hot key, as pages are counted by (host,
line).  Null texts stay null with no lines, empty texts have one blank line; a null host is a host
of its own; rows alike in id, host and text are separate pages; extra columns pass through, except that ``n_lines``
and ``n_dropped`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import KEY, row_key
from ripplegraph.session import materialize


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def _page_lines(docs: DataFrame, host: Column, text: str) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != ""), _digest))


def boilerplate(docs: DataFrame, host: Column, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, line digest, pages, host_pages) of the lines above the limit."""
    host = F.coalesce(host.cast("string"), F.lit(""))
    pages = docs.select(host.alias("_host"), _page_lines(docs, host, text).alias("_lines"))
    totals = materialize(pages.groupBy("_host").agg(F.count("*").alias("_host_pages")), "host-pages")
    counts = pages.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_pages"))
    return counts.filter(F.col("_pages") >= min_pages).join(totals, "_host").filter(F.col("_pages") > F.lit(ratio) * F.col("_host_pages"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ids: str = "doc_id", ratio: float = 0.1, min_pages: int = 3, spare: bool = False) -> DataFrame:
    """``docs`` with cleaned text and the columns ``n_lines`` and ``n_dropped``.

    A line is dropped where its pages exceed ``ratio`` of the pages of the host; at least ``min_pages``
    pages must hold it, so that a site of one or two pages has no boilerplate.  With ``spare``, a page
    of which only blank lines would stay keeps its text.
    """
    limit = materialize(boilerplate(docs, F.col(host), text, ratio, min_pages).select("_host", "_line"), "boilerplate")
    keyed = docs.withColumn(KEY, row_key(ids, host, text))
    own = F.coalesce(F.col(host).cast("string"), F.lit(""))
    hits = keyed.select(KEY, own.alias("_host"), F.explode(_page_lines(keyed, own, text)).alias("_line")).join(limit, ["_host", "_line"]).groupBy(KEY).agg(F.collect_set("_line").alias("_drop"))
    lines = F.split(F.col(text), "\n", -1)
    keep = F.filter(F.col("_all"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_drop"), _digest(x)))
    out = keyed.join(hits, KEY, "left").withColumn("_all", lines).withColumn("_left", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(keep))
    if spare:
        out = out.withColumn("_left", F.when(F.exists("_left", lambda x: F.trim(x) != ""), F.col("_left")).otherwise(F.col("_all")))
    out = out.withColumn("n_lines", F.coalesce(F.size("_all"), F.lit(0))).withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.size("_all") - F.size("_left")))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines")))
    return out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_left", "\n")).otherwise(F.col(text))).select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
