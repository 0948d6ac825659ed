"""One hub holds most edges: results stay whole and no join emits the hub's all-pairs product."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ripplegraph.operators import hawkes, linkpred, merge, neighbors, overlap, paths, rules

N = 15_000  # in-edges and out-edges of the hub each; their product would be 225 million rows


def _hub(spark):
    """s0..sN -> hub -> t0..tN, plus one private middle per (s, t) pair of the same index."""
    i = spark.range(N)
    edge = lambda f, t, c: i.select(f.alias("from_id"), F.lit("r").alias("relation"), t.alias("to_id"), F.lit(c).alias("confidence"), F.lit(None).cast("double").alias("causal_weight"))
    s, t, m = F.concat(F.lit("s"), "id"), F.concat(F.lit("t"), "id"), F.concat(F.lit("m"), "id")
    return edge(s, F.lit("hub"), 0.5).unionByName(edge(F.lit("hub"), t, 0.5)).unionByName(edge(s, m, 0.9)).unionByName(edge(m, t, 0.9))


def test_two_hop_through_a_hub(spark):
    rel = _hub(spark)
    seeds = spark.range(N).select(F.concat(F.lit("s"), "id").alias("id"))
    out = neighbors.two_hop(seeds, rel, 3).cache()
    assert out.count() == 3 * N
    first = out.filter("seed = 's77'").orderBy(F.col("confidence").desc(), "target").collect()
    assert [(r.via, r.target) for r in first] == [("m77", "t77"), ("hub", "t0"), ("hub", "t1")]
    out.unpersist()


def test_adamic_adar_with_a_hub(spark):
    """The hub alone (1 / ln 30000 < .1) cannot carry a pair; with the private middle it adds its share."""
    rel = _hub(spark)
    ids = rel.select(F.col("from_id").alias("id")).union(rel.select("to_id")).distinct().withColumn("type", F.lit("T"))
    seeds = spark.range(N).select(F.concat(F.lit("s"), "id").alias("id"))
    out = linkpred.adamic_adar(seeds, rel, ids, k=5).cache()
    assert out.count() == N
    r = out.filter("source = 's5'").first()
    want = 1 / math.log(2) + 1 / math.log(2 * N)
    assert (r.target, r.common_neighbours) == ("t5", 2) and r.score == math.floor(want * 1000 + 0.5) / 1000
    out.unpersist()


def test_cooccurrence_with_a_source_everyone_is_in(spark):
    """Everybody shares the hot source; only pairs with a second common source count."""
    i = spark.range(N)
    hot = i.select(F.concat(F.lit("e"), "id").alias("entity"), F.lit("hot").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    own = i.select(F.concat(F.lit("e"), "id").alias("entity"), F.concat(F.lit("p"), F.floor(F.col("id") / 2)).alias("source"), F.lit("2024-03-01").cast("timestamp").alias("ts"))
    out = rules.source_cooccurrence(hot.unionByName(own), k=20).cache()
    assert out.count() == N
    r = out.filter("from_id = 'e10'").first()
    assert (r.to_id, r.weight, round(r.confidence, 6)) == ("e11", 2.0, 0.7)
    out.unpersist()


def test_merge_of_one_repeated_id(spark):
    rows = spark.range(200_000).select(
        F.lit("a").alias("id"), F.lit("T").alias("type"), F.lit("A").alias("name"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(0.5).alias("confidence"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("properties"), F.col("id").alias("seq"),
    )
    r = merge.collapse_nodes(rows).collect()
    assert len(r) == 1 and r[0].n == 200_000 and r[0].sources == ["s0", "s1", "s2"] and r[0].properties == {"k": "0"}


def _written(monkeypatch, module):
    """Rows of every table that a module writes, by label (the largest of each)."""
    counts, real = {}, module.materialize

    def counted(df, label):
        out = real(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    monkeypatch.setattr(module, "materialize", counted)
    return counts


def test_twenty_values_that_all_keys_share(spark, monkeypatch):
    """Every pair shares twenty values: the best k come out, and rows stay near k per key."""
    counts = _written(monkeypatch, overlap)
    k, i = 5, spark.range(N)
    hot = i.select(F.format_string("e%05d", "id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("v")).select("id", F.concat(F.lit("h"), "v").alias("value"))
    own = i.select(F.format_string("e%05d", "id").alias("id"), F.concat(F.lit("p"), F.floor(F.col("id") / 2)).alias("value"))
    out = overlap.top_shared(hot.unionByName(own), k).cache()
    assert out.count() == N * k
    first = out.filter("lid = 'e00100'").orderBy(F.desc("n_common"), "rid").collect()
    assert [(r.rid, r.n_common) for r in first] == [("e00101", 21), ("e00000", 20), ("e00001", 20), ("e00002", 20), ("e00003", 20)]
    assert max(n for label, n in counts.items() if label not in ("memberships", "weights")) <= N * (k + 16), counts
    out.unpersist()


def test_shortest_paths_through_a_hub(spark, monkeypatch):
    """Labels are at most nodes x targets, whatever the number of sources."""
    counts = _written(monkeypatch, paths)
    rel = _hub(spark)
    pairs = spark.range(N).select(F.concat(F.lit("s"), "id").alias("source"), F.explode(F.array(F.lit("t5"), F.lit("t9"))).alias("target"))
    out = paths.shortest_paths(pairs, rel, 3).cache()
    assert out.count() == 2 * N and out.filter("hops <> 2").count() == 0
    assert out.filter("source = 's5' and target = 't5'").first().path == ["s5", "hub", "t5"]
    assert counts["labels"] <= 2 * (2 * N + 3), counts
    out.unpersist()


def test_busy_day_cascades_in_linear_rows(spark, monkeypatch):
    """A hundred thousand entities on one day: a wave writes one row per entity and shock, and keeps every one."""
    counts = _written(monkeypatch, hawkes)
    n = 100_000
    t0 = F.lit("2024-01-02").cast("timestamp")
    ev = spark.range(n).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit("x").alias("entity_type"), (t0 + F.make_dt_interval(secs=F.col("id") % 80_000)).alias("ts"), F.lit(1.0).alias("intensity"))
    alpha = spark.range(n).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit(1.0 / n).alias("alpha"))
    shocks = spark.createDataFrame([("a", "e1", 2.0), ("b", "e2", 1.0)], "shock string, entity_id string, magnitude double")
    out = hawkes.simulate_shock(shocks, ev, alpha, F.lit("2024-01-05").cast("timestamp"))
    got = hawkes.shock_summary(out).orderBy("shock").collect()
    assert [(r.shock, r.total_affected, r.max_depth) for r in got] == [("a", n, 1), ("b", n, 1)]
    assert max(v for k, v in counts.items()) <= 2 * n, counts
