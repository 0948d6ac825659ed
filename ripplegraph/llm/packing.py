"""Best-fit packing of tokenised documents into sequences, bulk-synchronously.

Token counts are whole numbers up to the capacity, so the range-sorted lists of documents and gaps
are runs of equal values: at most ``capacity`` runs, whatever the number of documents.  A round

1. sweeps both lists from large to small; every document size meets the smallest gap that holds it
   (its successor), each gap takes one document at most;
2. resolves conflicts by rank: of n documents of one size that want m equal gaps, the first
   min(n, m) by rank get them, in rank order, and the others the next larger gaps;
3. updates the gaps.

Rounds repeat until all is placed; a size that fits in no gap any more opens new sequences.  Sweeps run on the runs (counts per size, bounded by the capacity), and give
rank intervals per size with their sequences and offsets.  Rows find their rank within their size by
salted windows, so neither a size that a third of all pieces share nor the corpus meets one task.

Null texts are empty; an empty document is its end token alone.  Only documents longer than the
capacity are cut: all pieces but the first are full.  Repeated rows are packed each.  Null ids are
kept.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.session import materialize, scratch_path

#: White space beside a blank: the text can't be cut at its blanks there.
UNSAFE = re.compile(r" \s|\s ")
#: Fixed value: the string of the vocabulary's special token, which the tokenizer takes as one id.
SPECIAL = "<|endoftext|>"


class Tokens(dict):
    """Ids of a text as little-endian unsigned 32-bit bytes, with a bounded memory of units.

    A unit is a blank and the characters up to the next one.  Where both neighbours of a blank are no
    white space, the byte-level vocabulary's word pattern always cuts before the blank, so ids of
    units can be joined.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, limit: int) -> None:
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full = Tokenizer.from_file(json_path)
        self.limit = limit

    def encode(self, text: str) -> list[int]:
        # letters beyond the Latin ones, and the special token, go to the library that defines the ids
        if text and max(text) > "ɏ" or SPECIAL in text:
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def pack(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.pack(" " + unit)
        if len(self) < self.limit:
            self[unit] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or SPECIAL in text or UNSAFE.search(text):
            return self.pack(text)
        if len(self) >= self.limit:
            self.clear()
        first, *units = text.split(" ")
        return self.pack(first) + b"".join(map(self.__getitem__, units))


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def tokenise(docs: DataFrame, ids: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True, cache: int = 300_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece; ``ids`` are little-endian unsigned 32-bit."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    out = pa.schema(fields)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*tokenizer_files(), cache)
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = tokens.of(t.as_py() or "") + tail
                n = len(body) // 4
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n, capacity), n]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = body[4 * lo : 4 * hi]
                    rows.append((d, i, lo, hi - lo, zlib.crc32(part)) + (part,) * with_ids)
                    held += len(part) * with_ids + 40
                if held > 16 << 20:
                    yield _batch(rows, out)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, out)

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


Interval = tuple[int, int, int, int, int]


def sweep_plan(counts: dict[int, int], capacity: int, shares: tuple[float, ...] = (0.0, 0.5, 0.8, 0.9, 1.0)) -> list[Interval]:
    """(length, first rank, ranks, first sequence, offset) per interval: rank r goes to first sequence + r - first rank.

    How many sequences the largest documents open before the first sweep is a choice: the best of
    ``shares`` of the least possible number is taken.
    """
    plans = [_plan(counts, capacity, x) for x in shares]
    return min(plans, key=lambda plan: max((first + n for _, _, n, first, _ in plan), default=0))


def _plan(counts: dict[int, int], capacity: int, share: float) -> list[Interval]:
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals of sequences
    plan: list[Interval] = []
    opened = 0

    def place(size: int, n: int, first: int, gap: int, after: dict[int, list[tuple[int, int]]]) -> None:
        plan.append((size, used[size], n, first, capacity - gap))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]
        if gap > size:
            after.setdefault(gap - size, []).append((first, n))

    # documents over half the capacity cannot share; beyond them, the stated share of the volume's least number
    new = max(sum(n for s, n in left.items() if 2 * s > capacity), int(-(-sum(s * n for s, n in left.items()) // capacity) * share))
    for size in sorted(left, reverse=True):
        n = min(new, left[size])
        if n:
            place(size, n, opened, capacity, gaps)
            opened += n
            new -= n
    while left:
        # the largest size fits in no gap any more: it opens as many sequences as its documents fill
        top = max(left)
        if top > max(gaps, default=0):
            n = -(-left[top] // (capacity // top))
            place(top, n, opened, capacity, gaps)
            opened += n
        stack: list[list[int]] = []  # [gap, first sequence, sequences], smallest gap on top
        after: dict[int, list[tuple[int, int]]] = {}
        for value in sorted(gaps.keys() | left.keys(), reverse=True):
            stack += [[value, *x] for x in gaps.get(value, ())]
            while stack and value in left:
                gap, first, n = stack.pop()
                take = min(n, left[value])
                place(value, take, first, gap, after)
                if take < n:
                    stack.append([gap, first + take, n - take])
        for gap, first, n in stack:
            after.setdefault(gap, []).append((first, n))
        gaps = after
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, per_salt: int = 2000) -> DataFrame:
    """``pieces`` (written table) with ``sequence_id`` and ``offset``; needs doc_id, piece, start, length, ids_crc32."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(1, sum(counts.values()) // per_salt)
    plan = sorted(sweep_plan(counts, capacity))
    starts = np.array([s * (1 << 44) + r for s, r, _, _, _ in plan], np.int64)
    shift = np.array([q - r for _, r, _, q, _ in plan], np.int64)
    offsets = np.array([o for *_, o in plan], np.int64)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("bigint")).drop("_salt", "_before")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(starts, b.column(b.schema.get_field_index("length")).to_numpy() * (1 << 44) + rank, "right") - 1
            own = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rank + shift[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return ranked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenise, write the pieces once, pack them."""
    pieces = tokenise(docs, capacity=capacity, with_ids=with_ids)
    if not with_ids:
        return pack(materialize(pieces, "pieces"), capacity)
    path = scratch_path(docs.sparkSession, "pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    return pack(docs.sparkSession.read.schema(pieces.schema).parquet(path), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces that carry ``ids``: the sequences themselves."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("length"), joined.alias("ids"))
