"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns; the digest of each candidate value is counted by distinct
uses, repositories and owners over the whole corpus.  A value in more than ``max_repos`` repositories
or with more than ``max_owners`` owners is a widely copied example, also if one owner copies it through
all repositories; any other that looks live (varied characters, no placeholder) is owner-specific and
adds a span of its own.  Everything is DataFrame expressions.

Null texts are empty, very long ones are read whole.  Candidates and their places are written once,
without texts; only digests are grouped and joined, after counts were combined per repository, so a value
copied into a third of all rows is counted as one row per task.  Digests with more than a share of 1/HOT
of all uses, fewer than HOT of them, meet their uses by broadcast, the others by a join.  Rows alike in
id and text share a result.  A null repository or owner counts as one of its own.  An empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import KEY, joined_spans, row_key, with_spans
from ripplegraph.session import materialize

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "opaque": r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{24,}+",
}
#: Span kinds in their order; the first three are the base kinds, the others the method's.
KINDS = ("assign", "access", "hex", "live", "opaque")
#: Digests with more than a thousandth of all uses are hot: fewer than HOT of them, whatever the corpus.
HOT = 1000
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|redacted|x{4,}|\*{3,}|(.)\1{5,}|123456|abcdef"


def looks_live(value: Column) -> Column:
    """At least eight different characters, letters and digits, no placeholder word."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return varied & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (accepted base spans) and ``cands`` (values whose ownership is counted)."""
    df = with_spans(docs, text, PATTERNS)

    def base(kind: str, order: int) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    def cand(spans: Column, kind: str, order: int, value=lambda s: s["hit"]) -> Column:  # noqa: ANN001
        return F.transform(spans, lambda s: F.struct((s["stop"] - F.length(value(s))).alias("start"), F.lit(order).alias("ord"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), value(s).alias("value")))

    of_assign = lambda s: F.regexp_extract(s["hit"], ASSIGN, 1)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(of_assign(s)) >= 6))
    df = df.withColumn("opaque", F.filter("opaque", lambda s: s["hit"].rlike("[A-Z]") & s["hit"].rlike("[a-z]") & s["hit"].rlike("[0-9]")))
    known = F.concat(cand(F.col("assign"), "live", 3, of_assign), cand(F.col("access"), "live", 3), cand(F.col("hex"), "live", 3))
    outside = F.filter("opaque", lambda s: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    df = df.withColumn("base", F.array_sort(F.concat(base("assign", 0), base("access", 1), base("hex", 2))))
    return df.withColumn("cands", F.concat(known, cand(outside, "opaque", 4))).drop(*PATTERNS)


def ownership(cands: DataFrame) -> DataFrame:
    """(digest) with n_docs, n_repos, n_owners; input has digest, repo, owner."""
    per_repo = cands.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return per_owner.groupBy("digest").agg(F.sum("n").alias("n_uses"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def with_ownership(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """``rows`` with the counts of their digest; hot digests reach their uses where these are."""
    total = owned.agg(F.sum("n_uses")).first()[0] or 0
    hot = owned.withColumn("hot", F.col("n_uses") * HOT > total)
    near = rows.join(F.broadcast(hot.filter("hot").select("digest", "n_owners", "n_repos")), "digest", "left")
    cold = near.filter("n_owners is null").drop("n_owners", "n_repos").join(hot.filter("not hot").select("digest", "n_owners", "n_repos"), "digest")
    return near.filter("n_owners is not null").unionByName(cold)


def scan_secrets(docs: DataFrame, ids: str = "doc_id", text: str = "text", repo: str = "repo", owner: str = "owner", max_owners: int = 2, max_repos: int = 3) -> DataFrame:
    """One row per document: ``base`` and ``spans`` (start, ord, stop, kind), counts of owner-specific and of copied values, most owners and repositories of a value."""
    keyed = docs.select(F.col(ids).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner")).withColumn(KEY, row_key("doc_id", "text"))
    found = materialize(candidates(keyed).select(KEY, "doc_id", "repo", "owner", "base", "cands"), "secret-candidates")
    rows = found.filter(F.size("cands") > 0).select(KEY, "repo", "owner", F.explode("cands").alias("c")).select(KEY, "repo", "owner", "c.*")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("value"), 256))).withColumn("live", looks_live(F.col("value"))).drop("value")
    owned = materialize(ownership(rows), "secret-ownership")
    judged = with_ownership(rows, owned).withColumn("few", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    span = F.struct("start", "ord", "stop", "kind")
    extra = judged.groupBy(KEY).agg(F.collect_set(F.when(F.col("few") & F.col("live"), span)).alias("added"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"), F.countDistinct(F.when(~F.col("few"), F.col("digest"))).alias("n_copied"))
    out = found.join(extra, KEY, "left")
    none = F.expr("cast(array() as array<struct<start:int,ord:int,stop:int,kind:string>>)")
    added = F.coalesce("added", none)
    return out.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"), F.size(added).cast("bigint").alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repos", F.lit(0)).alias("most_repos"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the scan's contract."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), "n_owned", "n_copied", "most_owners", "most_repos")
