"""Neighbourhoods, paths, propagation and link prediction on hand-made graphs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import linkpred, lookup, neighbors, paths, rules, stats

EDGE = "from_id string, relation string, to_id string, confidence double, causal_weight double"


def _rel(spark, *edges):
    return spark.createDataFrame([(a, r, b, c, w) for a, r, b, c, w in edges], EDGE)


@pytest.fixture()
def diamond(spark):
    """A -> B -> D, A -> C -> D, D -> E."""
    return _rel(spark, ("A", "x", "B", 0.9, None), ("A", "x", "C", 0.8, 0.5), ("B", "x", "D", 0.7, None), ("C", "x", "D", 0.9, 0.4), ("D", "x", "E", 0.6, 0.0))


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_shortest_path_prefers_fewest_hops_then_smallest_nodes(spark, diamond, rows):
    pairs = spark.createDataFrame([("A", "E"), ("A", "D"), ("E", "A"), ("B", "E")], "source string, target string")
    got = rows(paths.shortest_paths(pairs, diamond), "source", "target", "hops", F.array_join("path", ""), "total")
    # A-E goes over B (smaller than C); weights: causal weight, or confidence when missing or zero
    assert got == [("A", "D", 2, "ABD", 1.6), ("A", "E", 3, "ABDE", 2.2), ("B", "E", 2, "BDE", 1.3)]


def test_shortest_path_respects_the_hop_limit(spark, diamond, rows):
    pairs = spark.createDataFrame([("A", "E")], "source string, target string")
    assert rows(paths.shortest_paths(pairs, diamond, max_hops=2)) == []


def test_causal_paths_use_no_edge_twice_and_multiply(spark, rows):
    rel = _rel(spark, ("a", "causes", "b", 1.0, 0.5), ("b", "causes", "a", 1.0, 0.9), ("b", "causes", "crash", 1.0, None))
    got = rows(paths.trace_causal_paths(_ids(spark, "crash"), rel), F.array_join("nodes", ">"), "total_weight")
    # the walk a>b>a>b would reuse a>b, so it stops at b>a>b
    assert got == [("a>b>crash", 0.25), ("b>a>b>crash", 0.225), ("b>crash", 0.5)]


@pytest.mark.parametrize("choices", [(0.3, 0.5, 0.8, 1.0), (0.4, 0.9, 1.7)])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_causal_beam_is_exact(spark, k, choices):
    r = random.Random(5)
    n = 9
    edges = sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(26)})
    w = {e: r.choice(choices) for e in edges if e[0] != e[1]}
    rel = _rel(spark, *[(a, "causes", b, 1.0, x) for (a, b), x in w.items()])
    best = []

    def walk(nodes, used, weight):
        if len(used) == 4:
            return
        for (a, b), x in w.items():
            if b == nodes[0] and (a, b) not in used:
                best.append((-(weight * x), len(nodes) + 1, [a, *nodes]))
                walk([a, *nodes], used | {(a, b)}, weight * x)

    walk(["n0"], frozenset(), 1.0)
    got = paths.trace_causal_paths(_ids(spark, "n0"), rel, max_depth=4, k=k).orderBy("path_rank").collect()
    want = sorted(best)[:k]
    assert [(x.nodes, round(x.total_weight, 9)) for x in got] == [(p[2], round(-p[0], 9)) for p in want]


def test_narrative_and_intensity(spark, rows):
    rel = _rel(spark, ("a", "TRIGGERED", "b", 1.0, 0.5), ("b", "causes", "c", 1.0, 0.4))
    ent = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", "Crash")], "id string, name string")
    x = paths.decorate_paths(paths.trace_causal_paths(_ids(spark, "c"), rel), ent)
    got = rows(x, "narrative", "intensity")
    assert ("Alpha →[direct trigger]→ Beta →[causal chain]→ Crash", round(0.01 + 0.5 + 0.4 * math.exp(-0.1), 6)) in got


def test_two_hop_never_returns_to_the_seed_and_matches_brute_force(spark):
    r = random.Random(11)
    nodes = [f"n{i}" for i in range(14)]
    edges = {(a, b): r.choice([0.5, 0.6, 0.7, 0.9]) for a in nodes for b in nodes if a != b and r.random() < 0.45}
    rel = _rel(spark, *[(a, "r", b, c, None) for (a, b), c in edges.items()])
    for k in (1, 2, 5):
        got = {(x.seed, x.via, x.target) for x in neighbors.two_hop(_ids(spark, *nodes), rel, k).collect()}
        want = set()
        for s in nodes:
            cand = [(-min(c1, c2), -c2, t, v) for (a, v), c1 in edges.items() if a == s for (b, t), c2 in edges.items() if b == v and t != s]
            want |= {(s, v, t) for _, _, t, v in sorted(cand)[:k]}
        assert got == want


def test_two_hop_directions(spark, diamond, rows):
    seed = _ids(spark, "D")
    assert rows(neighbors.two_hop(seed, diamond, 10), "target") == []
    assert rows(neighbors.two_hop(seed, diamond, 10, "in"), "via", "target") == [("B", "A"), ("C", "A")]
    assert len(rows(neighbors.two_hop(seed, diamond, 10, "both"))) == 2


def test_propagation_levels_factor_and_first_visit(spark, diamond, rows):
    ent = spark.createDataFrame([(n, n, "T", "stressed" if n in "AB" else None) for n in "ABCDE"], "id string, name string, type string, regime string")
    seeds = spark.createDataFrame([("s", "A", "shock"), ("r", "D", "remove")], "seed string, id string, intervention string")
    got = rows(paths.propagate(seeds, diamond, ent, depth=2), "seed", "id", "level", "residual_impact", F.array_join("path", ""))
    # 1.0 * 1.5 at the stressed start; B is stressed too (x 0.7 x 1.5); D is first reached over C (0.9 > 0.7)
    assert got == [("r", "E", 1, -0.35, "D"), ("s", "B", 1, 1.575, "A"), ("s", "C", 1, 1.05, "A"), ("s", "D", 2, 0.735, "AC")]


def test_propagation_reaches_all_of_a_hub(spark, rows):
    rel = spark.createDataFrame([("H", "r", f"n{i}", 0.9) for i in range(80)], "from_id string, relation string, to_id string, confidence double")
    ent = spark.createDataFrame([(n, n, "T", None) for n in ("H", *(f"n{i}" for i in range(80)))], "id string, name string, type string, regime string")
    seeds = spark.createDataFrame([("s", "H", "shock")], "seed string, id string, intervention string")
    assert len(rows(paths.propagate(seeds, rel, ent), "id")) == 80 and len(rows(paths.propagate(seeds, rel, ent, cap=paths.AFFECTED_CAP), "id")) == 50


def test_propagation_cap_counts_earlier_levels(spark, diamond, rows):
    ent = spark.createDataFrame([(n, n, "T", None) for n in "ABCDE"], "id string, name string, type string, regime string")
    seeds = spark.createDataFrame([("s", "A", "boost")], "seed string, id string, intervention string")
    assert [r[0] for r in rows(paths.propagate(seeds, diamond, ent, cap=3), "id")] == ["B", "C", "D"]
    assert [r[0] for r in rows(paths.propagate(seeds, diamond, ent, cap=1), "id")] == ["B"]


def test_ultimate_parents_and_cycles(spark, rows):
    chain = [(f"c{i}", "subsidiary_of", f"c{i + 1}", 0.9, None) for i in range(9)]
    got = {r[0]: r[1:] for r in rows(paths.ultimate_parents(_rel(spark, *chain)), "id", "parent", "root", "depth")}
    assert got["c0"] == ("c1", "c9", 9) and got["c8"] == ("c9", "c9", 1)
    loop = _rel(spark, ("a", "subsidiary_of", "b", 0.9, None), ("b", "subsidiary_of", "a", 0.9, None), ("x", "subsidiary_of", "y", 0.9, None))
    got = {r[0]: r[1:] for r in rows(paths.ultimate_parents(loop, max_doublings=4), "id", "root")}
    assert got == {"a": (None,), "b": (None,), "x": ("y",)}


def test_neighbourhood_keeps_inner_edges(spark, diamond, rows):
    nodes, edges = paths.neighbourhood(_ids(spark, "B"), diamond, 1)
    assert rows(nodes) == [("A", 1), ("B", 0), ("D", 1)]
    assert rows(edges, "from_id", "to_id") == [("A", "B"), ("B", "D")]


def test_adamic_adar_excludes_known_links_and_self(spark, rows):
    rel = _rel(spark, ("s", "r", "m1", 1.0, None), ("s", "r", "m2", 1.0, None), ("m1", "r", "t", 1.0, None), ("m2", "r", "t", 1.0, None), ("m1", "r", "s", 1.0, None), ("m2", "r", "m1", 1.0, None))
    ent = spark.createDataFrame([(i, "T") for i in ("s", "m1", "m2", "t")], "id string, type string")
    got = rows(linkpred.adamic_adar(_ids(spark, "s"), rel, ent, 5), "target", "score", "common_neighbours")
    # degrees: m1 = 4 (in s, m2; out t, s), m2 = 3
    assert got == [("t", round(math.floor((1 / math.log(4) + 1 / math.log(3)) * 1000 + 0.5) / 1000, 6), 2)]


def test_structural_pairs_agree_between_sparse_and_full_route(spark):
    spokes = [("H", "r", f"p{i}", 1.0, None) for i in range(4)] + [("G", "r", f"p{i}", 1.0, None) for i in range(3)]
    rel = _rel(spark, *spokes)
    full = {(r.from_id, r.to_id): round(r.weight, 9) for r in linkpred.structural_pairs(rel, below=None).collect()}
    some = {(r.from_id, r.to_id): round(r.weight, 9) for r in linkpred.structural_pairs(rel).collect()}
    assert some == full and full[("p0", "p1")] == round(1 / math.log(5) + 1 / math.log(4), 9)
    assert ("G", "H") in full and ("G", "p0") not in full


def test_rules(spark, rows):
    rel = _rel(
        spark, ("Ann", "works_at", "Sub", 1.0, None), ("Sub", "subsidiary_of", "Top", 1.0, None), ("Top", "owns", "Sub", 1.0, None), ("Sub", "competitor_of", "Riv", 1.0, None),
        ("Riv", "competitor_of", "Top", 1.0, None), ("Top", "competitor_of", "Riv", 1.0, None), ("Oslo", "located_in", "East", 1.0, None), ("East", "located_in", "Norway", 1.0, None),
    )
    types = {"Ann": "Person", "Sub": "Corporation", "Top": "LegalEntity", "Riv": "Corporation", "Oslo": "City", "East": "Region", "Norway": "Nation"}
    ent = spark.createDataFrame(list(types.items()), "id string, type string")
    got = rows(rules.apply_rules(rel, ent), "from_id", "relation", "to_id", "confidence")
    assert got == sorted([
        ("Ann", "works_at", "Top", 0.7), ("Sub", "owned_by", "Top", 0.95), ("Riv", "competitor_of", "Sub", 0.95), ("Oslo", "located_in", "Norway", 0.85),
    ], key=repr)


def test_strongest_keeps_weight_of_the_best(spark, rows):
    e = spark.createDataFrame([("a", "r", "b", 0.5, 9.0, "x"), ("a", "r", "b", 0.8, 1.0, "y")], "from_id string, relation string, to_id string, confidence double, weight double, source string")
    assert rows(rules.strongest(e)) == [("a", "r", "b", 0.8, 1.0, "y")]


def test_name_matching_is_exact_for_every_seed_length(spark):
    names = ["Acme Corp", "acme", "Beta AG", "x", "", "Zetacme"]
    seeds = ["acme", "a", "ac", "beta ag", "nope", "", "X"]
    n = spark.createDataFrame([(f"i{i}", v) for i, v in enumerate(names)], "id string, name string")
    got = {(r.seed, r.id) for r in lookup.match_names(spark.createDataFrame([(s,) for s in seeds], "seed string"), n).collect()}
    assert got == {(s, f"i{i}") for s in seeds for i, v in enumerate(names) if s.lower() in v.lower()}


def test_find_by_name_ranks_exact_hits_first(spark):
    e = spark.createDataFrame([("1", "T", "acme holding", 0.99), ("2", "T", "ACME", 0.2), ("3", "T", "other", 1.0)], "id string, type string, name string, confidence double")
    assert [r.id for r in lookup.find_by_name(e, "Acme").collect()] == ["2", "1"]


def test_boundary(spark, rows):
    ent = spark.createDataFrame([("s", "SimAgent"), ("e", "SimEpisode"), ("c", "Company")], "id string, type string")
    rel = spark.createDataFrame([("s", "READS_FROM", "c"), ("s", "buys", "c"), ("c", "buys", "s"), ("s", "joins", "e")], "from_id string, relation string, to_id string")
    assert rows(lookup.boundary_check(rel, ent), "from_id", "relation", "valid") == [("c", "buys", False), ("s", "READS_FROM", True), ("s", "buys", False), ("s", "joins", True)]


def test_degrees_and_histogram(spark, diamond, rows):
    assert rows(stats.degrees(diamond), "id", "out_degree", "in_degree", "degree")[3] == ("D", 1, 2, 3)
    log = spark.createDataFrame([("/q", 5.0, False), ("/q", 10.0, True), ("/q", 9999.0, False)], "endpoint string, duration_ms double, is_error boolean")
    got = {r.le: (r.cumulative, r.requests, r.errors) for r in stats.latency_histogram(log).collect()}
    assert got["10"] == (2, 3, 1) and got["5000"] == (2, 3, 1) and got["+Inf"] == (3, 3, 1)
