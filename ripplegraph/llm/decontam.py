"""Benchmark decontamination by winnowing.

The smallest k-gram hash of each sliding window of w k-grams is kept, so every shared span of
``span = w + k - 1`` words has a common fingerprint.  Fingerprints of documents and benchmark items
are joined; each hit is extended over equal words to its full length, and spans of at least ``span``
words count.  Items of fewer words are looked up whole, by the hash of all their words.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.  A bitmap of
fixed size over the benchmark's hashes (``2**BITS`` bits, whatever the benchmark's size) leaves out
most fingerprints that cannot meet one; a full bitmap only lets more rows reach the join.  Texts are
read again only for documents with a joint fingerprint.

Null texts have no words and are clean.  Rows alike in id and text share a result.  An item without
id marks words but is not counted or named; repeated items count once.  Empty tables on either side
give no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import KEY, WORD_TABLE, row_key
from ripplegraph.session import materialize

BITS = 24
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    """64-bit hashes of words, with a bounded memory."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; runs of different lengths never share a hash by design."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * PRIME + h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= MIX
    return out ^ (out >> np.uint64(32))


def winnow(h: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are smallest in a window of span - k + 1 of them (all places on ties)."""
    g, w = grams(h, k), span - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), g[:0]
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
    keep = np.zeros(len(g), bool)
    for j in range(w):
        keep[j : j + n] |= g[j : j + n] == low
    at = np.flatnonzero(keep)
    return at, g[at]


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


def item_prints(items: DataFrame, k: int, span: int) -> DataFrame:
    """(item, print, n_words) of benchmark items, written once; ``item`` is the item's row key."""
    schema = pa.schema([("item", pa.binary()), ("print", pa.int64()), ("short", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hashes.of(split(text.as_py()))
                n = len(h)
                found = np.unique(winnow(h, k, span)[1] if n >= span else grams(h, n)) if n else h
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.binary()), pa.array(found.view(np.int64)), pa.array([n if n < span else 0] * len(found), pa.int32())], schema=schema)

    return materialize(items.select(KEY, F.col("text").cast("binary")).mapInArrow(run, "item binary, print bigint, short int"), "item-prints")


def bitmap(prints: DataFrame) -> np.ndarray:
    """2**BITS bits, set where the benchmark has a print; at most 2**(BITS - 6) rows are gathered."""
    low = F.pmod("print", F.lit(1 << BITS))
    words = prints.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(pmod(print, 64) as int))")).alias("b")).collect()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in words:
        out[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return out


def document_prints(docs: DataFrame, bits: np.ndarray, shorts: list[int], k: int, span: int) -> DataFrame:
    """(key, doc_id, n_words, prints): the prints of each document that the bitmap lets pass."""
    schema = pa.schema([(KEY, pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("prints", pa.list_(pa.int64()))])
    mask = np.uint64((1 << BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            counts, prints = [], []
            for text in b.column(2):
                h = hashes.of(split(text.as_py()))
                g = np.concatenate([winnow(h, k, span)[1], *(grams(h, n) for n in shorts)])
                low = g & mask
                hit = (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)
                counts.append(len(h))
                prints.append(np.unique(g[hit.astype(bool)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], schema=schema)

    return docs.select(KEY, "doc_id", F.col("text").cast("binary")).mapInArrow(run, f"{KEY} binary, doc_id bigint, n_words bigint, prints array<bigint>")


def extend(words: list[bytes], h: np.ndarray, item: list[bytes], ih: np.ndarray, k: int, span: int, places: dict[int, list[int]], hit: np.ndarray) -> bool:
    """Mark in ``hit`` the words of all spans of at least ``span`` words shared with ``item``; are there any?"""
    n, found = len(item), False
    if n < span:
        for p in np.flatnonzero(grams(h, n) == grams(ih, n)[0]):
            if words[p : p + n] == item:
                hit[p : p + n] = found = True
        return found
    done: dict[int, int] = {}  # diagonal -> end of the last extension
    for q, g in zip(*(x.tolist() for x in winnow(ih, k, span)), strict=True):
        for p in places.get(g, ()):
            if p < done.get(p - q, 0):
                continue
            a, b = 0, 0
            while p - a and q - a and words[p - a - 1] == item[q - a - 1]:
                a += 1
            while p + b < len(words) and q + b < n and words[p + b] == item[q + b]:
                b += 1
            done[p - q] = p + b
            if a + b >= span:
                hit[p - a : p + b] = found = True
    return found


def confirm(texts: DataFrame, k: int, span: int) -> DataFrame:
    """(key, n_hit, items) from (key, text, items: array of (item_id, text))."""
    schema = pa.schema([(KEY, pa.binary()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            rows: list[tuple[int, list[str]]] = []
            for text, items in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = split(text.as_py())
                h = hashes.of(words)
                hit = np.zeros(len(words), bool)
                places: dict[int, list[int]] = {}
                for p, g in zip(*(x.tolist() for x in winnow(h, k, span)), strict=True):
                    places.setdefault(g, []).append(p)
                named = set()
                for x in items:
                    own = split(x["text"])
                    if extend(words, h, own, hashes.of(own), k, span, places, hit):
                        named.add(x["item_id"])
                rows.append((int(hit.sum()), sorted(named - {None})))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], schema=schema)

    return texts.select(KEY, F.col("text").cast("binary"), "items").mapInArrow(run, f"{KEY} binary, n_hit bigint, items array<string>")


def find_leaks(docs: DataFrame, bench: DataFrame, ids: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 5, span: int = 10) -> DataFrame:
    """One row per document: its key, doc_id, n_words, n_hit and the sorted ``items`` (ids as strings) with occurring windows."""
    if not 1 <= k <= span:
        raise ValueError("a k-gram is at most as long as the span")
    keyed = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(KEY, row_key("doc_id", "text"))
    items = bench.select(F.col(item).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn(KEY, row_key("item_id", "text")).dropDuplicates([KEY])
    prints = item_prints(items, k, span)
    shorts = sorted(r["short"] for r in prints.filter("short > 0").select("short").distinct().collect())  # below `span` values
    seen = materialize(document_prints(keyed, bitmap(prints), shorts, k, span), "document-prints")
    pairs = seen.filter(F.size("prints") > 0).select(KEY, F.explode("prints").alias("print")).join(prints, "print").select(KEY, "item").distinct()
    named = items.select(F.col(KEY).alias("item"), "item_id", F.col("text").cast("binary").alias("text"))
    asked = pairs.join(named, "item").groupBy(KEY).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    asked = materialize(asked, "asked-documents")
    found = confirm(keyed.select(KEY, "text").join(asked, KEY), k, span).filter("n_hit > 0").groupBy(KEY).agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"))
    out = seen.drop("prints").join(found, KEY, "left")
    return out.select(KEY, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def drop_leaks(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` without any benchmark window."""
    bad = materialize(find_leaks(docs, bench, **options).filter("n_hit > 0").select(KEY).distinct(), "leaks")
    return docs.withColumn(KEY, row_key("doc_id", "text")).join(bad, KEY, "left_anti").drop(KEY)
