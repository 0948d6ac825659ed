"""Personal data: patterns for protected values and an information-theoretic test for the terms around them.

Protected values (e-mail, address, card, phone) are found by patterns.  The corpus then says how
strongly a term reveals a value: with n(t) documents that hold term t, n(e) that hold value e and
n(t,e) that hold both, among N documents,

    reveal(t, e) = PMI(t; e) / I(e),   PMI = log2(n(t,e) / n(t)) + I(e),   I(e) = -log2(n(e) / N).

It is 1 where t stands in no document without e.  A term above ``remove_at`` is removed, one above
``generalise_at`` is generalised, wherever it stands in any document; at least ``min_uses`` joint
documents are evidence.  Terms are words of any length outside of values.  Copies are one text: each
different text is looked at once and counts once, so a copied document is no evidence by itself.

Everything is DataFrame expressions, and counts are combined per task.  A pair is only made where n(t)
is small enough for the pair to pass even if every document of e holds t, so common words meet no rare
value.  Revealing terms go to all tasks in blocks of ``BLOCK`` digests of fixed size, and words are
looked up where they are: the words of the corpus are not shuffled.

Null texts are empty.  Very long texts are read whole.  Rows of one text share a result, repeated ones
too; rows without id have one like any other.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import KEY, joined_spans, lower_ascii, pieces_of, with_places, with_spans
from ripplegraph.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Possessive where giving back could not help, and starting only where a run of the first class starts: linear on any text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TOKEN = PATTERNS["email"] + r"|[\p{L}\p{M}]++"
#: Revealing terms that are sent to all tasks at once: 24 bytes each.
BLOCK = 200_000
SORTED = "array<struct<ord:int,start:int,stop:int,kind:string>>"


def _luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _accepted(kind: str, order: int) -> Column:
    valid = F.filter(kind, lambda s: _valid(kind, s["hit"]))
    return F.transform(valid, lambda s: F.struct(F.lit(order).alias("ord"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["hit"].alias("hit")))


def protected(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: sorted structs (ord, start, stop, kind, hit) of the accepted values."""
    df = with_spans(docs, text, PATTERNS)
    return df.withColumn("base", F.array_sort(F.concat(*(_accepted(k, i) for i, k in enumerate(KINDS))))).drop(*KINDS)


def _words(text: str) -> Column:
    """E-mail values and, outside of them, words, as they follow each other; no other value holds letters."""
    return F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(TOKEN), F.lit(0))


def _terms(text: str) -> Column:
    return F.array_distinct(F.filter(_words(text), lambda x: ~F.contains(x, F.lit("@"))))


def _value(e: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", e["kind"], e["hit"]), 256))


def revealing_terms(base: DataFrame, min_uses: int, generalise_at: float) -> DataFrame:
    """(term, reveal) of the terms that reveal some value, over whole different texts (``_row_key``, ``text``, ``base``)."""
    n_docs = max(base.count(), 1)
    counts = materialize(base.select(F.explode(_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") >= min_uses), "pii-words")
    held = base.filter(F.size("base") > 0)
    values = held.select(KEY, F.explode(F.array_distinct(F.transform("base", _value))).alias("value"))
    info = -F.log2(F.least(F.col("n_value") / F.lit(n_docs), F.lit(0.5)))
    known = values.groupBy("value").agg(F.count("*").alias("n_value")).filter(F.col("n_value") >= min_uses).withColumn("info", info)
    # n_both <= n_value, so a more frequent term cannot pass; a little more lets rounding pass
    known = known.withColumn("most", F.col("n_value") * F.pow(F.lit(2.0), (1 - generalise_at) * F.col("info")) * 1.000001)
    values = materialize(values.join(known, "value"), "pii-values")
    words = held.join(values.groupBy(KEY).agg(F.max("most").alias("most")), KEY).select(KEY, "most", F.explode(_terms("text")).alias("term")).distinct()
    words = words.join(counts, "term").filter(F.col("n_term") <= F.col("most")).drop("most")
    pairs = words.join(values, KEY).filter(F.col("n_term") <= F.col("most"))
    joint = pairs.groupBy("value", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("info").alias("info")).filter(F.col("n_both") >= min_uses)
    reveal = 1 + F.log2(F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))) / F.col("info")
    return joint.select("term", reveal.alias("reveal")).filter(F.col("reveal") >= generalise_at).groupBy("term").agg(F.max("reveal").alias("reveal"))


def with_marked(df: DataFrame, remove_at: float) -> DataFrame:
    """Add ``added``: spans (ord, start, stop, kind) of the words of ``text`` that stand in ``marks``, those that touch a value left out."""
    between = F.split(lower_ascii(F.col("text")), TOKEN, -1)
    df = df.withColumn("_words", F.when(F.col("marks").isNotNull(), _words("text")))
    df = with_places(df.withColumn("_pieces", F.when(F.size("_words") > 0, pieces_of(F.col("_words"), between))).drop("_words"), "_placed", "_pieces")
    known = F.filter("_placed", lambda s: F.map_contains_key("marks", s["hit"]))
    free = F.filter(known, lambda s: ~F.exists("base", lambda e: (e["start"] < s["stop"]) & (s["start"] < e["stop"])))

    def span(s: Column) -> Column:
        gone = F.element_at("marks", s["hit"]) >= remove_at
        return F.struct(F.when(gone, len(KINDS)).otherwise(len(KINDS) + 1).cast("int").alias("ord"), s["start"].alias("start"), s["stop"].alias("stop"), F.when(gone, "reveal").otherwise("hint").alias("kind"))

    return df.withColumn("added", F.when(F.col("marks").isNull(), F.expr(f"cast(array() as {SORTED})")).otherwise(F.transform(free, span))).drop("_placed")


def marked_terms(base: DataFrame, hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, marks): the revealing terms of each text with their scores; ``hits`` meet the words of all texts in blocks."""
    digest = lambda c: F.unhex(F.md5(F.encode(c, "utf-8")))
    blocks = max(1, -(-hits.count() // block))
    own = hits.select(digest(F.col("term")).alias("digest"), "reveal", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    words = base.select(KEY, F.explode(_terms("text")).alias("term")).withColumn("digest", digest(F.col("term")))
    out = None
    for i in range(blocks):
        met = words.join(F.broadcast(own.filter(F.col("block") == i).drop("block")), "digest").select(KEY, "term", "reveal")
        out = met if out is None else out.unionByName(met)
    return out.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "reveal"))).alias("marks"))


def find_pii(docs: DataFrame, ids: str = "doc_id", text: str = "text", min_uses: int = 2, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """One row per document: ``text`` (null where nothing was found), ``base`` and ``spans`` (ord, start, stop, kind).

    The method's kinds are ``reveal`` (a term to be removed) and ``hint`` (a term to be generalised),
    sorted after the base kinds.
    """
    keyed = docs.select(F.col(ids).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn(KEY, F.unhex(F.sha2("text", 256)))
    base = materialize(protected(keyed.select(KEY, "text").dropDuplicates([KEY])).select(KEY, "base", "text"), "pii-base")
    hits = materialize(revealing_terms(base, min_uses, generalise_at), "pii-terms")
    own = F.transform("base", lambda s: F.struct(s["ord"].alias("ord"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    # exactly the texts with spans: a marked word is left out only beside a value
    some = base.join(materialize(marked_terms(base, hits), "pii-marks"), KEY, "left").filter((F.size("base") > 0) | F.col("marks").isNotNull())
    done = materialize(with_marked(some, remove_at).select(KEY, "base", F.array_sort(F.concat(own, "added")).alias("spans")), "pii-spans")
    out = keyed.join(done, KEY, "left").withColumn("text", F.when(F.col("spans").isNotNull(), F.col("text")))
    none = lambda c: F.coalesce(c, F.array().cast(done.schema[c].dataType)).alias(c)
    return out.select("doc_id", "text", none("base"), none("spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """(doc_id, clean): values as [KIND], terms generalised as [TERM] or removed; null where nothing was found."""
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["kind"] == "reveal", "").when(s["kind"] == "hint", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        ok = s["start"] >= acc["at"]
        return F.struct(F.when(ok, s["stop"]).otherwise(acc["at"]).alias("at"), F.when(ok, F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), put)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return found.withColumn("_d", done).select("doc_id", F.when(F.col("text").isNotNull(), F.concat("_d.out", F.col("text").substr(F.col("_d.at") + 1, F.length("text")))).alias("clean"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    extra = F.size(F.filter("spans", lambda s: s["ord"] >= len(KINDS))).cast("bigint").alias("n_terms")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), extra)
