"""Near-dedup against all pairs on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ripplegraph.llm import neardup
from tests.llm.conftest import EDGES, prose


def brute(rows):
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            parent[i] = i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "".join(rng.choice("abcdefghij") for _ in range(6))
    return " ".join(out)


def check(df, rows):
    want, got = brute(rows), df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_groups_chains_and_edges(make_docs, no_docs):
    rng = random.Random(5)
    rows, n = list(EDGES[:-4]), 100
    for g in range(6):
        base = prose(50 + g, rng.choice([20, 60, 150])).split()
        for _ in range(rng.choice([2, 5, 30])):
            rows.append((n, edited(rng, base, rng.randrange(0, 6)), "en", "s"))
            n += 1
    chain = prose(90, 120).split()
    for _ in range(25):  # each differs a little from the one before it
        rows.append((n, " ".join(chain), "en", "s"))
        chain[rng.randrange(len(chain))] = f"w{n}"
        chain[rng.randrange(len(chain))] = f"v{n}"
        n += 1
    rng.shuffle(rows)
    check(neardup.near_duplicates(make_docs(rows)), rows)
    assert neardup.near_duplicates(no_docs).collect() == []
    kept = neardup.keep_one(make_docs(rows))
    want = brute(rows)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert kept.filter("doc_id is null").count() == sum(r[0] is None for r in rows) and kept.columns == make_docs([]).columns


def test_threshold_is_inclusive(make_docs):
    w = [f"w{i}" for i in range(11)]
    rows = [(1, " ".join(w), "en", "s"), (2, " ".join(w[:10] + ["x"]), "en", "s"), (3, " ".join(w[:10]), "en", "s")]
    check(neardup.near_duplicates(make_docs(rows)), rows)  # 6 of 7 and 6 of 8 shared


def test_links_that_no_bucket_head_has(make_docs):
    """Copies far from each other are joined only through a base that heads no bucket."""
    rng = random.Random(9)
    base = prose(77, 200).split()
    rows = [(i, edited(rng, base, 5), "en", "s") for i in range(150)] + [(1000, " ".join(base), "en", "s")]
    check(neardup.near_duplicates(make_docs(rows)), rows)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 2000), (2000, 2000)], "a bigint, b bigint"))
    got = dict(tuple(r) for r in neardup.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 301)}, 2000: 1000}


def test_rows_of_each_step_are_linear_in_a_group(make_docs, monkeypatch):
    """A group of near copies, a passage that unlike documents share, and what each step writes for them."""
    counts = {}
    real = neardup.materialize

    def counted(df, label):
        out = real(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    rng = random.Random(12)
    base, passage = prose(300, 160).split(), prose(301, 60)
    rows = [(i, edited(rng, base, rng.randrange(0, 7)), "en", "s") for i in range(600)]
    rows += [(1000 + i, prose(5000 + i, 50) + " " + passage, "en", "s") for i in range(300)]
    monkeypatch.setattr(neardup, "materialize", counted)
    got = neardup.near_duplicates(make_docs(rows))
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: c for i, (_, c) in want.items()}
    buckets = 2 * neardup.PERMS // neardup.ROWS + neardup.FEW
    assert all(n <= len(rows) * buckets for n in counts.values()), counts
    assert counts["star-pairs"] <= len(rows) * buckets // 2 and counts.get("small-pairs", 0) <= len(rows) * 8, counts


def test_recall_by_set_size(make_docs):
    """Pairs at the threshold, from one shingle to many: hardly any link is lost."""
    rng, rows, want = random.Random(21), [], set()
    for n, shared in [(3, 4), (6, 8), (12, 16), (15, 20), (30, 40), (90, 120)]:  # n of `shared` shingles are common
        for i in range(60):
            words = [f"{rng.getrandbits(40):x}" for _ in range(shared + 4)]
            a = len(rows)
            rows += [(a, " ".join(words), "en", "s"), (a + 1, " ".join(words[: n + 4]), "en", "s")]
            want.add(a)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make_docs(rows)).collect()}
    assert sum(got[a + 1] == a for a in want) == len(want)


def test_buckets_that_stay_mixed_meet_in_blocks(make_docs, monkeypatch):
    """All documents in one bucket, which no pivot beside the first looks at: pairs meet in blocks of 4."""
    for name, value in (("SMALL", 1), ("ROUNDS", 0), ("BLOCK", 4), ("grams_of_bands", lambda values: values[:1, 0].view("int64") * 0)):
        monkeypatch.setattr(neardup, name, value, raising=False)
    rows = []
    for g in range(7):
        own = prose(70 + g, 60).split()
        rows += [(2 * g, " ".join(own), "en", "s"), (2 * g + 1, " ".join([*own[:-1], "x"]), "en", "s")]
    check(neardup.near_duplicates(make_docs(rows), sketch_perms=neardup.PERMS), rows)


def test_blocks_make_no_rows_of_pairs(make_docs, monkeypatch):
    """Many documents of one bucket that are nearly linked: block pairs give links, not the pairs that they compare."""
    counts = {}
    real = neardup.materialize

    def counted(df, label):
        out = real(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    for name, value in (("SMALL", 1), ("ROUNDS", 0), ("BLOCK", 16), ("grams_of_bands", lambda values: values[:1, 0].view("int64") * 0), ("materialize", counted)):
        monkeypatch.setattr(neardup, name, value)
    passage = prose(400, 200)
    rows = [(i, f"{passage} {prose(500 + i, 45)}", "en", "s") for i in range(60)]
    rows += [(100 + i, r[1] + " end", "en", "s") for i, r in enumerate(rows[:10])]
    check(neardup.near_duplicates(make_docs(rows), sketch_perms=neardup.PERMS), rows)
    assert max(n for label, n in counts.items() if label.startswith("rest") and label != "rest-mixed") <= 100, counts
