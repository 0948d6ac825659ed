"""Ranked lexical search: item vocabulary tiles times document impact tiles, in float64.

Terms are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters of the whole text.
With N documents that have a term, L terms in all of them, n terms in one, df documents with a term and
tf uses of it in a document, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), its impact is
(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, and a score sums w * impact over the terms
of an item, once each.

1. Items are dealt to blocks of bounded size (twice ``BLOCK`` pairs of item and term and twice ``ITEMS``
   items, or a single larger item); a block's vocabulary goes to all tasks, and all documents meet every block.
2. A pass over the texts writes, per document, n and the uses of the block's terms.  df, N and L are
   sums over that table.
3. Items of a block are tiled, each tile with its own compact vocabulary, cut into pieces of at most
   ``TERMS`` columns.  A dense tile of document impacts times a dense tile of weights gives partial
   sums; impacts are below 10^6, so the number of columns is also kept below 2^53 / (10^6 max w), which
   makes every partial sum an exact whole number in float64.  Pieces are added up as 64-bit integers.
4. A task keeps the k best of each item over its tiles (all rows at or above the k-th score are looked
   at, equal scores by id), then partial lists are merged per item and salt, and per item.

Null texts and texts without terms take part in nothing.  Each row is a document of its own, repeated
ones too; rows without id count in the statistics but are no results.  Repeated item ids are one item
with the terms of all; items without id or terms have no results.  Very long texts are read in pieces
cut between terms.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.llm.common import WORD_TABLE, lower_ascii
from ripplegraph.session import materialize

#: Pairs and items of a block, items and vocabulary columns and documents of a tile, salts of the merge.
BLOCK, ITEMS, TILE_ITEMS, TERMS, TILE_DOCS, SALTS = 1 << 16, 4096, 256, 4096, 512, 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text, in pieces of about ``piece`` bytes that end between terms."""
    at = 0
    while at < len(text):
        end = at + piece
        part = text[at:end].translate(WORD_TABLE)
        while end < len(text) and part[-1] != 32:  # go on to the end of the term
            more = text[end : end + 4096].translate(WORD_TABLE)
            stop = more.find(b" ")
            part += more if stop < 0 else more[: stop + 1]
            end += len(more) if stop < 0 else stop + 1
        yield part.split()
        at = end


def uses(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows with terms; ``terms`` are ascending numbers of the vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            ids, n, terms, tfs = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                count, found = 0, []
                for words in words_of(text.as_py() or b""):
                    count += len(words)
                    numbers = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    found.append(np.unique(numbers[numbers >= 0], return_counts=True))
                if not count:
                    continue
                t, c = found[0]
                if len(found) > 1:
                    t, place = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                    c = np.bincount(place, np.concatenate([x[1] for x in found]), len(t)).astype(np.int64)
                ids.append(i), n.append(count), terms.append(t), tfs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Best:
    """The k best (score, id) of each item over tiles; rows below an item's k-th score never enter."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor, self.rows = k, np.ones(items, np.int64), [np.empty((0, 3), np.int64)]
        self.waiting = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (documents x items) of the items from ``first`` on."""
        doc, item = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.rows.append(np.stack([item + first, scores[doc, item], ids[doc]], axis=1))
        self.waiting += len(doc)
        if self.waiting > 4 * self.k * len(self.floor):
            self.prune()

    def prune(self) -> np.ndarray:
        r = np.concatenate(self.rows)
        r = r[np.lexsort((r[:, 2], -r[:, 1], r[:, 0]))]
        starts = np.searchsorted(r[:, 0], np.arange(len(self.floor)))
        r = r[np.arange(len(r)) - starts[r[:, 0]] < self.k]
        counts = np.bincount(r[:, 0], minlength=len(self.floor))
        full = np.flatnonzero(counts >= self.k)
        self.floor[full] = r[np.cumsum(counts)[full] - 1, 1]
        self.rows, self.waiting = [r], 0
        return r


def _impacts(n: np.ndarray, tfs: np.ndarray, row: np.ndarray, docs: int, total: int) -> np.ndarray:
    big = 50 * int(n.max(initial=0)) * docs >= 1 << 63
    m = 50 + (np.array([50 * int(x) * docs // total for x in n], np.int64) if big else 50 * n * docs // total)
    return (1_000_000_000 * tfs // (1000 * tfs + 20 * m[row])).astype(np.float64)


def top_of_tiles(postings: DataFrame, names: np.ndarray, item: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(item_id, score, doc_id): the k best rows of every task for the items ``names``; pairs (item, term) are sorted by item."""
    schema = pa.schema([("item_id", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])
    columns = max(1, min(TERMS, (1 << 53) // (1_000_000 * max(1, int(weight.max(initial=1))))))

    def tiles() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First item, items, and of a piece of their vocabulary: its terms, and the pairs' columns and items."""
        for first in range(0, len(names), TILE_ITEMS):
            last = min(first + TILE_ITEMS, len(names))
            a, b = np.searchsorted(item, [first, last])
            own = np.unique(term[a:b])
            col = np.searchsorted(own, term[a:b])
            for c in range(0, len(own), columns):
                here = np.flatnonzero((col >= c) & (col < c + columns))
                yield first, last - first, own[c : c + columns], col[here] - c, item[a:b][here] - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        local = np.full(len(weight), -1, np.int32)
        for b in batches:
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tfs = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), lengths)
            impact = _impacts(n, tfs, row, docs, total)
            first, sums = 0, None
            for at, width, own, col, who in tiles():
                if sums is not None and at != first:
                    best.add(first, sums, ids)
                    sums = None
                if sums is None:
                    first, sums = at, np.zeros((len(ids), width), np.int64)
                weights = np.zeros((len(own), width))
                weights[col, who] = weight[own[col]]
                local[own] = np.arange(len(own))
                place = local[terms]
                used = np.flatnonzero(place >= 0)
                cut = np.searchsorted(row[used], np.arange(0, len(ids) + TILE_DOCS, TILE_DOCS))
                for j, d in enumerate(range(0, len(ids), TILE_DOCS)):
                    u = used[cut[j] : cut[j + 1]]
                    if len(u):
                        tile = np.zeros((min(TILE_DOCS, len(ids) - d), len(own)))
                        tile[row[u] - d, place[u]] = impact[u]
                        sums[d : d + TILE_DOCS] += (tile @ weights).astype(np.int64)
                local[own] = -1
            if sums is not None:
                best.add(first, sums, ids)
        r = best.prune()
        for at in range(0, len(r), 1 << 16):
            part = r[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[part[:, 0]]), pa.array(part[:, 1].copy()), pa.array(part[:, 2].copy())], schema=schema)

    return postings.filter("doc_id is not null").mapInArrow(run, "item_id bigint, score bigint, doc_id bigint")


def blocks_of(items: DataFrame, block: int, most: int) -> tuple[DataFrame, list[int]]:
    """(block, item_id, term) and the blocks: items above ``block`` pairs have one each, the others are hashed into as many as keep them below 2 ``block``."""
    term = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    pairs = materialize(items.filter("item_id is not null").select("item_id", term.alias("term")).distinct(), "item-terms")
    sizes = materialize(pairs.groupBy("item_id").agg(F.count("*").alias("pairs")), "item-sizes")
    large = [r["item_id"] for r in sizes.filter(F.col("pairs") > block).select("item_id").collect()]  # at most pairs / block ids
    small = sizes.filter(F.col("pairs") <= block)
    total, n = small.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
    count = max(-(-total // block), -(-n // most))
    while count:
        dealt = F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int")
        if small.groupBy(dealt.alias("block")).agg(F.sum("pairs").alias("pairs"), F.count("*").alias("items")).filter((F.col("pairs") > 2 * block) | (F.col("items") > 2 * most)).isEmpty():
            break
        count *= 2
    own = F.create_map(*(F.lit(x) for i, v in enumerate(large) for x in (v, count + i)))[F.col("item_id")] if large else F.lit(None).cast("int")
    return pairs.withColumn("block", F.coalesce(own, dealt) if count else own), list(range(count + len(large)))


def search(docs: DataFrame, items: DataFrame, ids: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 50, block: int = BLOCK, most: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, equal scores by id."""
    texts = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    dealt, blocks = blocks_of(asked, block, most)
    counts, parts = None, []
    for number in blocks:
        pairs = dealt.filter(F.col("block") == number).select("item_id", "term").orderBy("item_id", "term").toPandas()  # one block, see blocks_of
        if pairs.empty:
            continue
        words = {w.encode(): i for i, w in enumerate(sorted(set(pairs["term"])))}
        names, who = np.unique(pairs["item_id"].to_numpy(np.int64), return_inverse=True)
        term = np.array([words[w.encode()] for w in pairs["term"]], np.int64)
        postings = materialize(uses(texts, words), "term-uses")
        if counts is None:
            counts = [int(x or 0) for x in postings.agg(F.count("*"), F.sum("n")).first()]
        n_docs, total = counts
        if not n_docs:
            break
        df = np.zeros(len(words), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.float64)
        parts.append(materialize(top_of_tiles(postings, names, who, term, weight, n_docs, total, k), "tile-tops"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = (F.desc("score"), F.asc("doc_id"))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    near = salted.withColumn("r", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    ranked = near.select("item_id", "doc_id", "score", F.row_number().over(W.partitionBy("item_id").orderBy(*order)).alias("rank"))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
