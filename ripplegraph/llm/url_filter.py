"""URL filter: stated rules first, else the empirical-Bayes reputation of the host.

Outcomes are labelled pages (bad or not).  The bad rate of a host is a beta-binomial whose prior is the
posterior mean of its registered domain, whose prior is that of its public suffix, whose prior is the
rate of all labelled pages.  How strongly a level shrinks to the one above it comes from the data by
moments: with A the share of page pairs of one group of which one is bad, and B the same for pairs of
different groups under one parent, a Beta(mean, strength) model has strength = A / (B - A), kept
between ``STRENGTH``'s limits; sums are whole numbers, so they do not depend on the order of rows.  What a level tells the one below leaves out that one's own pages, and
carries its uncertainty along: the prior is the Beta with the mean and the total variance.  A host is
blocked when the lower posterior bound of its bad rate, mean - z * deviation, exceeds ``worst``: few bad
pages alone never block a host.

The host is what follows the first ``://`` up to ``/ ? #``, with A-Z lower-cased; a port and a user do
not count for the registered domain; addresses of digits are their own domain without suffix.  Of the
rules that fit, the longest (host and path together, then the host) decides.

Hosts are counted before anything is joined, so a host with a third of all pages is one row.  Hosts with
more than a thousandth of the pages, at most a thousand, are sent to all tasks; the others are joined by host.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are judged as the host
"".  Very long urls are read whole.  Each row is judged by itself, repeated ones alike; a page id counts
once per host among the outcomes, and is bad if any of its labels is; rows without id are judged but have no outcome.  Without
outcomes everything that no rule blocks is allowed; an empty table gives no rows.  Only the id and the url are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import lower_ascii
from ripplegraph.session import materialize

#: Second-level names that form a public suffix below a country code of two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Limits of the prior strength, in pages; 2 is that of a uniform prior.
STRENGTH = (2.0, 1000.0)
#: Block above this bad rate, by the bound this many deviations below the mean.
WORST, Z = 0.5, 1.645
#: Hosts above total / HOT pages are joined by broadcast; there are fewer than HOT of them.
HOT = 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where ``://`` is missing."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(text, "://([^/?#]*)", 1)), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    address = name.rlike(r"^\[|^[0-9.]*$")
    pattern = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*)$"
    suffix = F.when(address, F.lit("")).otherwise(F.regexp_extract(name, pattern, 1))
    head = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.when(address, name).otherwise(F.concat(F.regexp_extract(head, r"([^.]*\.)$", 1), suffix)), suffix


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host/path) that fits; null without one.  A stated list: one expression holds it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[1])):  # the longest is tested first, so it is added last
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_outcomes(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, pages, n, k) per host: rows, labelled pages and bad ones.  ``outcomes`` is (page_id, bad)."""
    labels = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = urls.select("page_id", "host").filter("page_id is not null").distinct().join(labels, "page_id")
    counted = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("k"))
    hosts = urls.groupBy("host").agg(F.count("*").alias("pages")).join(counted, "host", "left")
    domain, suffix = domain_parts(F.col("host"))
    return hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))


def _moments(table: DataFrame) -> tuple[int, int, int, int]:
    """Sums of n, k, n squared and k (n - k), exact."""
    n, k = (F.col(c).cast("decimal(19,0)") for c in "nk")
    return tuple(int(x or 0) for x in table.agg(*(F.sum(F.col(c).cast("decimal(38,0)")) for c in "nk"), F.sum(n * n), F.sum(k * (n - k))).first())


def strengths(tables: Sequence[DataFrame], limits: tuple[float, float] = STRENGTH) -> tuple[float, list[float]]:
    """Rate of all pages, and the prior strength of each table's level below the level before it."""
    sums = [_moments(t) for t in tables]
    n, k = sums[0][:2]
    pairs, mixed, out = n * n, k * (n - k), []
    for _, _, own_pairs, own_mixed in sums:
        same = float(own_mixed) / float(own_pairs - n) if own_pairs > n else None
        apart = float(mixed - own_mixed) / float(pairs - own_pairs) if pairs > own_pairs else None
        fit = same / (apart - same) if same is not None and apart is not None and apart > same else limits[1]
        out.append(min(max(fit, limits[0]), limits[1]))
        pairs, mixed = own_pairs, own_mixed
    return float(k) / float(n) if n else 0.0, out


def _shrunk(n: Column, k: Column, mean: Column, var: Column, strength: float) -> tuple[Column, Column]:
    """Mean and variance of a rate after k of n, below a rate of this mean and variance: the prior is the Beta of the same two moments."""
    spread = mean * (F.lit(1.0) - mean)
    prior = spread / F.lit(strength + 1.0) + var * F.lit(strength / (strength + 1.0))
    weight = F.when(spread > 0, spread / prior - F.lit(1.0)).otherwise(F.lit(strength))
    after = (k + weight * mean) / (n + weight)
    return after, after * (F.lit(1.0) - after) / (n + weight + F.lit(1.0))


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """``hosts`` with mean and lower bound of the posterior bad rate."""
    hosts = materialize(hosts, "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_domain"), F.sum("k").alias("k_domain")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n_domain").alias("n_suffix"), F.sum("k_domain").alias("k_suffix")), "suffixes")
    rate, (s_suffix, s_domain, s_host) = strengths([suffixes.toDF("suffix", "n", "k"), domains.toDF("domain", "suffix", "n", "k"), hosts])
    # what a level tells a host leaves out the host's own part of it, so no page counts twice
    of_suffix = suffixes.select("suffix", "n_suffix", "k_suffix")
    of_domain = domains.join(of_suffix, "suffix")
    for c in "nk":
        of_domain = of_domain.withColumn(c, F.col(f"{c}_suffix") - F.col(f"{c}_domain"))
    mean, var = _shrunk(F.col("n"), F.col("k"), F.lit(rate), F.lit(0.0), s_suffix)
    of_domain = of_domain.select("domain", "suffix", "n_domain", "k_domain", mean.alias("m_suffix"), var.alias("v_suffix"))
    row = hosts.join(of_domain, ["domain", "suffix"])
    mean, var = _shrunk(F.col("n_domain") - F.col("n"), F.col("k_domain") - F.col("k"), F.col("m_suffix"), F.col("v_suffix"), s_domain)
    row = row.withColumn("m_domain", mean).withColumn("v_domain", var)
    mean, var = _shrunk(F.col("n"), F.col("k"), F.col("m_domain"), F.col("v_domain"), s_host)
    row = row.withColumn("mean", mean).withColumn("var", var)
    return row.select("host", "domain", "suffix", "pages", "n", "k", "mean", (F.col("mean") - F.lit(z) * F.sqrt("var")).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], worst: float = WORST, z: float = Z, ids: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, domain, labelled, bad, mean, bound) per row of ``pages``."""
    host, path = url_parts(F.col(url))
    urls = pages.select(F.col(ids).alias("page_id"), host.alias("host"), path.alias("path"))
    known = materialize(reputation(host_outcomes(urls, outcomes), z), "reputation")
    columns = known.select("host", "domain", F.col("n").alias("labelled"), F.col("k").alias("bad"), "mean", "bound", "pages")
    total = known.agg(F.sum("pages")).first()[0] or 0
    hot = materialize(columns.filter(F.col("pages") * HOT > total), "hot-hosts")
    often = urls.join(F.broadcast(hot), "host")
    seldom = urls.join(F.broadcast(hot.select("host")), "host", "left_anti").join(columns.filter(F.col("pages") * HOT <= total), "host")
    rule, stated = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(stated, F.when(F.col("bound") > worst, F.lit("block")).otherwise(F.lit("allow")))
    return often.unionByName(seldom).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "domain", "labelled", "bad", "mean", "bound")


def keep_allowed(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``pages`` (page_id, url, ...) whose url is allowed; rows of one id and url share a verdict."""
    verdicts = judge(pages.select("page_id", "url").distinct(), outcomes, rules, **options).filter("verdict = 'block'")
    host, path = url_parts(F.col("url"))
    blocked = verdicts.select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    return pages.withColumn("_host", host).withColumn("_path", path).join(blocked, ["_host", "_path"], "left_anti").select(*pages.columns)
