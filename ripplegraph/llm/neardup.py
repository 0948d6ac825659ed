"""MinHash near-dedup with min-max hashing, exact links and connected components.

A document's set are the hashes of its distinct 5-word shingles (64 bits).  Each permutation keeps
the smallest *and* the largest hash of the set, so ``perms`` permutations give ``2 * perms`` values;
values are banded ``rows`` at a time, and two sets that agree in a band are candidates.

1. Documents with equal sets form a class; its smallest id stands for it from here on.
2. Every bucket has a pivot, and its classes are compared with the pivot alone (a star, not all pairs);
   compared means: exact intersection and union of the full sets.  Pivots are voted for: the class whose
   buckets hold most rows in all, as the base of a group of near copies shares a bucket with more of them
   than any copy does.  Links are joined to components.
3. Buckets that still hold several components are looked at again.  Those of at most ``SMALL`` classes
   have all their pairs of different components tested by sketch and set size, and the rest compared.
   Larger ones take ``ROUNDS`` further pivots, one a round, each compared with the members of other
   components that sketch and size do not exclude; a round has at most one row per member.
4. Classes of larger buckets that are still mixed are dealt anew by ``2 * (sketch_perms - perms) / rows``
   bands of further min-max values, which go through 2 and 3 once more.
5. Buckets of either dealing that are mixed even then are cut into blocks of about ``BLOCK`` classes, and all pairs
   of different components are tested by sketch and set size, a pair of blocks in a task, which holds their full
   sets, compares the rest at once and gives the links that join components: fewer rows than it has classes.

A group of n copies costs n comparisons.  With the defaults a pair of large sets at similarity 0.75
misses all bands with probability 5e-6, and the sketch test excludes it with probability 3e-6; both fall
fast above 0.75.  Minimum and maximum depend on each other in small sets (3 of 4 shingles: 1e-4), so
sets of at most ``FEW`` shingles also have one bucket per shingle: two of them that are linked share one.
No pair that shares a bucket is passed over for the bucket's size; step 5 copies a row once per block of its
bucket and tests in the worst case the square of a bucket, in tasks of bounded memory, without making rows of pairs.

Words are what lies between white space (blank, tab to carriage return) after A-Z became lower case.
With fewer than five words the whole sequence is the one shingle; null, empty and blank texts have an
empty set and link with nothing.  Rows of one doc_id are one document; if their texts differ, the one
with the smallest set hash stands for it.  A row without id takes no part: its component is null and
it is kept.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ripplegraph.llm.common import KEY, LOWER_TABLE
from ripplegraph.llm.decontam import WordHash, grams
from ripplegraph.session import materialize

#: Permutations of the bands, and of the sketch that step 3 estimates with; values per band.
PERMS, SKETCH_PERMS, ROWS = 64, 128, 4
#: Largest set with a bucket per shingle, classes of a bucket that meet pairwise, further pivots of larger ones.
FEW, SMALL, ROUNDS = 16, 32, 3
#: Classes of a bucket that one block of step 5 holds, and shingles of their sets.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Bits of the map of the documents whose full sets are needed; a full map only lets more texts reach the join.
MAP_BITS = 23
#: Rows of a bucket per salt; heads with more than a thousandth of all pairs are salted, fewer than HOT of them.
SHARE, HOT, SALTS = 4096, 1000, 32


def shingles(text: bytes | None, hashes: WordHash, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    words = (text or b"").translate(LOWER_TABLE).split()
    # bytes.split() cuts at blank, tab, line feed, vertical tab, form feed and carriage return
    h = hashes.of(words)
    return np.unique(grams(h, min(size, len(h)))) if len(h) else h


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest and largest value of the set under each permutation: 2 * perms values."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mul), np.uint64)
    for at in range(0, len(s), 2048):
        v = s[at : at + 2048, None] * mul + add
        v ^= v >> np.uint64(32)
        np.minimum(low, v.min(axis=0), out=low)
        np.maximum(high, v.max(axis=0), out=high)
    return np.concatenate([low, high])


def _permutations(perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, perms, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, perms, np.uint64)


def sets_of(docs: DataFrame, size: int = 5, perms: int = PERMS, sketch_perms: int = SKETCH_PERMS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """(doc_id, key, n_shingles, set_hash, sketch, bands, more) per row; sketch: one byte per signature value, more: bands of the further permutations."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sketch", pa.binary()), ("bands", longs), ("more", longs)])
    if perms > sketch_perms:
        raise ValueError("bands use the first permutations of the sketch")
    mul, add = _permutations(sketch_perms, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        # the smallest and the largest value of a permutation side by side, cut into bands
        sides = np.arange(2 * sketch_perms).reshape(2, sketch_perms).T
        order, further = sides[:perms].reshape(-1, rows), sides[perms:].reshape(-1, rows)
        for b in batches:
            count, digest, sketch, bands, more = [], [], [], [], []
            for text in b.column(2):
                s = shingles(text.as_py(), hashes, size)
                count.append(len(s))
                if not len(s):
                    digest.append(None), sketch.append(None), bands.append(None), more.append(None)
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s, mul, add)
                sketch.append((sig >> np.uint64(11)).astype(np.uint8).tobytes())
                few = s.view(np.int64) if len(s) <= FEW else s[:0].view(np.int64)
                bands.append(np.concatenate([grams_of_bands(sig[order]), few]))
                more.append(grams_of_bands(sig[further]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, longs), pa.array(more, longs)], schema=schema)

    return docs.select("doc_id", KEY, "text").mapInArrow(run, "doc_id bigint, key binary, n_shingles bigint, set_hash binary, sketch binary, bands array<bigint>, more array<bigint>")


def grams_of_bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, from its values and its number."""
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    for j in range(values.shape[1]):
        key = (key ^ values[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int = 5) -> DataFrame:
    """(id, set array<bigint>) of the documents named in ``wanted`` (id, key), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            for at in range(0, b.num_rows, 256):  # short batches: a set is about as large as its text
                part = [shingles(t.as_py(), hashes, size).view(np.int64) for t in b.column(1)[at : at + 256]]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in part])]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 256], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part)))], names=["id", "set"])

    wanted = materialize(wanted.select(F.col("id").alias("doc_id"), F.col("key").alias(KEY)), "wanted")
    # texts that are not wanted stay where they are: a map of fixed size goes to all tasks
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    bits = wanted.groupBy(F.shiftright(place(), 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << MAP_BITS}) % 64 as int))")).alias("bits"))
    hit = F.expr(f"shiftrightunsigned(bits, cast(pmod(xxhash64(doc_id), {1 << MAP_BITS}) % 64 as int)) & 1") == 1
    some = docs.withColumn("word", F.shiftright(place(), 6)).join(F.broadcast(bits), "word").filter(hit)
    # ids are wanted once; a semi join would be pushed below the map and shuffle all texts
    texts = some.select("doc_id", KEY, "text").join(wanted, ["doc_id", KEY]).dropDuplicates(["doc_id", KEY])
    return materialize(texts.select("doc_id", "text").mapInArrow(run, "id bigint, set array<bigint>"), "shingle-sets")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (written) by the intersection and union of their full sets; a head ``a`` of very many pairs is met in salts."""
    total = pairs.count()
    # fewer than HOT ids, whatever the number of pairs
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).filter((F.col("n") * HOT > total) & (F.col("n") > SMALL)).select("a", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    heads = sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("set").alias("sa"))
    heads = heads.join(F.broadcast(hot), "a", "left").select("a", "sa", copies.alias("salt"))
    members = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", salt.alias("salt")).join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = members.join(heads, ["a", "salt"])
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    union = F.size("sa").cast("bigint") + F.size("sb") - shared
    return both.select("a", "b", (100 * shared >= percent * union).alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable, of the ids in ``edges`` (a, b), by alternating large-star and small-star steps."""

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s"))
        out = materialize(e, "star-edges")
        return out, tuple(seen.get.values())

    edges, last = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("n", "u").alias("m"))
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges, now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _floor(percent: int, values: int) -> float:
    """Least share of equal sketch bytes of a linked pair: bytes agree by chance in 1 of 256; 4.5 standard deviations below the threshold."""
    least = percent / 100
    return least + (1 - least) / 256 - 4.5 * float(np.sqrt(least * (1 - least) / values))


def not_excluded(pairs: DataFrame, percent: int, values: int) -> DataFrame:
    """(a, b) of pairs (a, b, sa, sb, na, nb) whose sketches and set sizes allow a link."""
    floor = _floor(percent, values)
    sized = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                one, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
                yield b.filter(pa.array((one == other).mean(axis=1) >= floor)).select([0, 1])

    return sized.mapInArrow(run, "a bigint, b bigint")


def small_pairs(members: DataFrame, percent: int, values: int) -> DataFrame:
    """(a, b) of different components in buckets of bounded size that sketches and set sizes allow."""
    floor = _floor(percent, values)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        ids, size, comp = (group[c].to_numpy() for c in ("id", "n_shingles", "comp"))
        sk = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        found = []
        for i in range(len(ids)):
            near = np.flatnonzero((ids > ids[i]) & (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            found += [(int(ids[i]), int(ids[j])) for j in near[(sk[near] == sk[i]).mean(axis=1) >= floor]]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return members.select("bucket", "id", "n_shingles", "comp", "sketch").groupBy("bucket").applyInPandas(meet, "a bigint, b bigint").distinct()


def block_links(members: DataFrame, sets: DataFrame, percent: int, values: int) -> DataFrame:
    """(a, b) linked, of buckets (n) of any size: each pair of blocks of a bucket meets in a group of its own.

    A group compares full sets, and passes over pairs that its links have joined by then, so what it
    gives are the edges of a forest over its components.
    """
    load = members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(load, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with")).join(sets, "id")
    floor = _floor(percent, values)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, size, block = (group[c].to_numpy() for c in ("id", "n_shingles", "block"))
        comp = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        within = group["one"].iloc[0] == group["other"].iloc[0]
        sk = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        own = np.append(0, np.cumsum([len(x) for x in group["set"]]))
        known, flat = np.unique(np.concatenate(group["set"].to_list()), return_inverse=True)
        sets = [flat[own[i] : own[i + 1]].astype(np.int32) for i in range(len(ids))]
        mine, found = np.zeros(len(known), bool), []
        for i in range(len(ids) - 1):
            at = slice(i + 1, None)
            fits = (comp[at] != comp[i]) & (100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i]))
            near = i + 1 + np.flatnonzero(fits if within else fits & (block[at] != block[i]))
            near = near[(sk[near] == sk[i]).mean(axis=1) >= floor]
            if not len(near):
                continue
            mine[sets[i]] = True
            shared = np.add.reduceat(mine[np.concatenate([sets[j] for j in near])].astype(np.int64), np.append(0, np.cumsum([len(sets[j]) for j in near[:-1]])).astype(np.int64))
            mine[sets[i]] = False
            for j in near[100 * shared >= percent * (size[near] + size[i] - shared)]:
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    found.append((int(ids[i]), int(ids[j])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    columns = ["bucket", "one", "other", "block", "id", "n_shingles", "comp", "sketch", "set"]
    return dealt.select(*columns).groupBy("bucket", "one", "other").applyInPandas(meet, "a bigint, b bigint").distinct()


def buckets_of(rep: DataFrame, bands: str) -> DataFrame:
    """(bucket, n, id, n_shingles, score) of buckets of several classes; score: rows of all buckets of the class."""
    # dealt by bucket once, for the counts and for the join with them
    member = rep.select("id", "n_shingles", F.explode(F.array_distinct(bands)).alias("bucket")).repartition("bucket")
    counts = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    inside = materialize(member.join(counts, "bucket"), "members")
    return materialize(inside.join(inside.groupBy("id").agg(F.sum("n").alias("score")), "id"), "voters")


def pivots_of(members: DataFrame, *carried: str) -> DataFrame:
    """(bucket, salt, pivot, p_...) for each bucket, once per ``SHARE`` of its rows; the member of most votes, then the smallest id."""
    best = F.max(F.struct("score", (-F.col("id")).alias("neg"), *carried)).alias("p")
    top = members.groupBy("bucket").agg(best, F.max("n").alias("n"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SHARE).cast("int") - 1)).alias("salt")
    return top.select("bucket", (-F.col("p.neg")).alias("pivot"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in carried), parts)


def with_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SHARE)).cast("int")
    return members.withColumn("salt", salt).join(pivots, ["bucket", "salt"]).filter("id <> pivot")


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).dropDuplicates(["lo", "hi"])


def _named(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _mixed(members: DataFrame, label: str) -> DataFrame:
    """Members of buckets with several components; n is counted anew."""
    again = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("bucket", "n")
    return materialize(members.drop("n").join(again, "bucket"), label)


class Links:
    """Pairs compared so far and the components that their links make."""

    def __init__(self, full: DataFrame, percent: int) -> None:
        self.full, self.percent = full, percent
        self.seen: DataFrame | None = None
        self.comp: DataFrame | None = None

    def add(self, pairs: DataFrame, label: str) -> None:
        """Compare those of ``pairs`` (a, b) that are new; a is the head.  Links join components by what they make of these."""
        new = _unordered(pairs)
        if self.seen is not None:
            new = new.join(self.seen, ["lo", "hi"], "left_anti")
        new = materialize(new.select("a", "b", "lo", "hi"), label)
        self.seen = new.select("lo", "hi") if self.seen is None else self.seen.unionByName(new.select("lo", "hi"))
        if self.comp is not None and new.isEmpty():
            return
        linked = materialize(compare(new.select("a", "b"), self.full, self.percent).filter("linked").select("a", "b"), f"{label}-linked")
        if self.comp is None:
            self.comp = components(linked)
            return
        self.join(linked)

    def join(self, linked: DataFrame) -> None:
        """Links (a, b), written, join the components known so far."""
        if linked.isEmpty():
            return
        ends = linked.select(F.col("a").alias("id")).unionByName(linked.select(F.col("b").alias("id"))).distinct()
        known = self.comp.unionByName(ends.join(self.comp, "id", "left_anti").select("id", F.col("id").alias("comp")))
        one, other = (known.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
        met = linked.join(one, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        joined = components(met).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        self.comp = materialize(known.join(joined, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "components")


def link_buckets(rep: DataFrame, inside: DataFrame, links: Links, percent: int, values: int) -> DataFrame | None:
    """Steps 2 and 3 over buckets (``buckets_of``); members of large ones that stay mixed, None without any."""
    star = with_pivots(inside, pivots_of(inside, "n_shingles"))
    fits = 100 * F.least("n_shingles", "p_n_shingles") >= percent * F.greatest("n_shingles", "p_n_shingles")
    links.add(star.filter(fits).select(F.col("pivot").alias("a"), F.col("id").alias("b")), "star-pairs")

    used = pivots_of(inside).select("bucket", F.col("pivot").alias("id")).distinct()
    # the first pivot has met all others of its bucket
    rest = _mixed(_named(inside.join(used, ["bucket", "id"], "left_anti"), links.comp), "mixed-members")
    rest = materialize(rest.join(rep.select("id", "sketch"), "id"), "mixed-sketches")
    for _ in range(ROUNDS):
        large = rest.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        chosen = materialize(pivots_of(large, "comp", "n_shingles", "sketch"), "pivots")
        met = with_pivots(large, chosen).filter("comp <> p_comp")
        met = met.select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("p_sketch").alias("sa"), F.col("sketch").alias("sb"), F.col("p_n_shingles").alias("na"), F.col("n_shingles").alias("nb"))
        links.add(not_excluded(met, percent, values), "pivot-pairs")
        used = chosen.select("bucket", F.col("pivot").alias("id")).distinct()
        rest = _mixed(_named(rest.join(used, ["bucket", "id"], "left_anti"), links.comp), "mixed-sketches")
    small = rest.filter(F.col("n") <= SMALL)
    if not small.isEmpty():
        links.add(small_pairs(small, percent, values), "small-pairs")
    left = rest.filter(F.col("n") > SMALL)
    return None if left.isEmpty() else materialize(left, "still-mixed")


def link_rest(members: DataFrame, links: Links, percent: int, values: int) -> None:
    """Step 5 over ``members`` of buckets that stayed mixed."""
    rest = _mixed(_named(members, links.comp), "rest-mixed")
    if not rest.isEmpty():
        links.join(materialize(block_links(rest, links.full, percent, values), "rest-linked"))


def near_duplicates(docs: DataFrame, ids: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, perms: int = PERMS, sketch_perms: int = SKETCH_PERMS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    keyed = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).withColumn(KEY, F.unhex(F.md5("text")))
    sets = materialize(sets_of(keyed, size, perms, sketch_perms, rows), "sets")
    known = sets.filter("doc_id is not null and set_hash is not null")
    chosen = materialize(known.groupBy("doc_id").agg(F.min(F.struct("set_hash", "key")).alias("c")).select("doc_id", "c.*"), "chosen")
    classes = chosen.groupBy("set_hash").agg(F.min(F.struct("doc_id", "key")).alias("c")).select("set_hash", F.col("c.doc_id").alias("doc_id"), F.col("c.key").alias("key"))
    rep = known.join(classes, ["doc_id", "set_hash", "key"]).dropDuplicates(["doc_id", "set_hash", "key"]).select(F.col("doc_id").alias("id"), "key", "set_hash", "n_shingles", "sketch", "bands", "more")
    rep = materialize(rep, "classes")
    inside = buckets_of(rep, "bands")
    links = Links(full_sets(keyed, rep.select("id", "key").join(inside.select("id").distinct(), "id", "left_semi"), size), percent)
    left = link_buckets(rep, inside, links, percent, 2 * sketch_perms)
    if left is not None:
        again = rep.join(left.select("id").distinct(), "id", "left_semi")
        more = link_buckets(rep, buckets_of(again, "more"), links, percent, 2 * sketch_perms) if sketch_perms > perms else None
        link_rest(left if more is None else left.unionByName(more), links, percent, 2 * sketch_perms)
    comp = links.comp

    of_class = rep.select("set_hash", "id").join(comp, "id", "left").select("set_hash", F.coalesce("comp", "id").alias("component_id"))
    of_doc = chosen.select("doc_id", "set_hash").join(materialize(of_class, "class-components"), "set_hash").select("doc_id", "component_id")
    out = sets.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` that are kept, one per doc_id; rows without id stay."""
    kept = materialize(near_duplicates(docs, **options).filter("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
