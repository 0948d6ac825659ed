"""Identity, text, extraction, readers and merges on small records."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import identity, text
from ripplegraph.operators import extract, merge, policy, scenario
from ripplegraph.operators.common import round_js
from ripplegraph.sources import catalogue, envelopes, feeds, registries, staging

NOW_TS = dt.datetime(2024, 1, 2)


def _one(spark, col, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("type_", "name", "canon"),
    [
        ("Company", "  Acme   Corp  ", "company:acme corp"),
        ("Company", "Acme Corp, Inc.", "company:acme corp"),
        ("Company", "Über & Söhne", "company:ber  shne"),
        ("Location", "USA", "location:united states"),
        ("Location", "London, GB", "location:london united kingdom"),
        ("Domain", "https://www.a.com/x", "domain:httpswwwacomx"),
        ("Person", "O'Neil Smith-Jones", "person:o'neil smith-jones"),
    ],
)
def test_canonical_form(spark, type_, name, canon):
    assert _one(spark, identity.canonicalize(F.col("t"), F.col("n")), t=type_, n=name) == canon


def test_domain_rule_first_when_not_compatible(spark):
    assert _one(spark, identity.canonicalize(F.lit("Domain"), F.col("n"), compat=False), n="https://www.a.com/x") == "domain:a.com"


def test_id_profiles(spark):
    c = b"company:acme"
    sha3, sha2 = hashlib.sha3_256(c).hexdigest(), hashlib.sha256(c).hexdigest()
    assert _one(spark, identity.entity_id(F.lit("Company"), F.col("n"), "sha3"), n="Acme") == f"{sha3[:16]}:{sha2[:12]}"
    assert _one(spark, identity.entity_id(F.lit("Company"), F.col("n")), n="Acme") == f"{sha2[:16]}:{sha2[:12]}"
    assert _one(spark, identity.parse_id(F.lit("ab:cd")))["secondary"] == "cd"
    assert _one(spark, identity.parse_id(F.lit("a:b:c"))) is None
    assert _one(spark, identity.hash_pii(F.lit(" Ann "))) == "pii:" + hashlib.sha256(b"ann").hexdigest()[:12]


@pytest.mark.parametrize(
    ("value", "domain"),
    [("https://www.Acme.com/a?b", "acme.com"), ("acme.co.uk", "acme.co.uk"), ("http://x", None), ("", None), ("ann@acme.com", "acme.com"), ("no domain here", None)],
)
def test_extract_domain(spark, value, domain):
    assert _one(spark, text.extract_domain(F.col("v")), v=value) == domain


def test_titles_and_rounding(spark):
    assert _one(spark, text.normalise_title(F.lit("Senior VP of  product MANAGER"))) == "Product Manager"
    assert _one(spark, text.tool_name(F.lit("Suite/Find-Leads"), "suite")) == "find_leads"
    assert [_one(spark, round_js(F.lit(v), 0)) for v in (-2.5, 2.5, 0.4)] == [-2.0, 3.0, 0.0]
    assert [_one(spark, text.tone_score(F.lit(v))) for v in (-30.0, 5.0, 30.0)] == [-1.0, 0.5, 1.0]


def test_html(spark):
    html = "<html><head><title> T &amp; x </title><style>p{}</style></head><body><nav>menu</nav><!-- c --><h1>Head</h1><p id='a'>One<br>two</p><p class='b c'>3</p><script>x()</script></body></html>"
    assert _one(spark, text.html_text(F.col("h")), h=html) == "T &amp; x\nHead\nOne\ntwo\n3"
    assert _one(spark, text.html_title(F.col("h")), h=html) == "T &amp; x"
    assert _one(spark, text.html_title(F.col("h")), h="<h1>Only <b>h1</b></h1>") == "Only h1"
    assert [_one(spark, text.html_field(F.col("h"), s), h=html) for s in ("h1", "#a", ".c", "#none")] == ["Head", "Onetwo", "3", None]


def _calls(spark, *pairs):
    return spark.createDataFrame([(str(i), t, json.dumps(r)) for i, (t, r) in enumerate(pairs)], "call_id string, tool string, result string")


def test_universal_walk_depth_lists_and_filters(spark, rows):
    deep = {"topic": "too deep"}
    for _ in range(6):
        deep = {"k": deep}
    body = {
        "company": "Acme", "Name": "Ann", "other": "x", "risk": "y", "website": "https://www.acme.com/a", "count": 3,
        "nested": {"industry": " Steel ", "list": [{"country": "Peru"}, "text", [{"sector": "Inner"}]]}, "deep": deep, "empty": {}, "none": None,
    }
    got = rows(extract.universal_nodes(_calls(spark, ("x", body))), "type", "name", "field")
    assert got == sorted([("Company", "Acme", "company"), ("Person", "Ann", "name"), ("Domain", "acme.com", "website"), ("Industry", "Steel", "industry"), ("Location", "Peru", "country"), ("Industry", "Inner", "sector")])
    five = {"topic": "deepest kept"}
    for _ in range(5):
        five = {"k": five}
    assert rows(extract.universal_nodes(_calls(spark, ("x", five), ("x", [{"theme": "top list"}]))), "name") == [("deepest kept",), ("top list",)]


def test_universal_takes_any_length_and_depth(spark, rows):
    deep = {"topic": "very deep"}
    for i in range(9):
        deep = {"k": [deep]} if i % 2 else {"k": deep}
    calls = _calls(spark, ("x", {"company": "A" * 300, "deep": deep}))
    assert rows(extract.universal_nodes(calls), "name") == [("A" * 300,)]
    assert rows(extract.universal_nodes(calls, longest=200), "name") == []
    assert rows(extract.extract(calls, max_depth=None).entities, "name") == [("A" * 300,), ("very deep",)]


def test_raw_data_keeps_its_whole_text(spark, rows):
    raw = spark.createDataFrame([("s", "word " * 400, ["e"])], "source string, text string, entity_ids array<string>")
    assert rows(merge.provenance(raw)[0], "name") == [("word " * 400,)]


def test_payload_pairs_join_different_types_only(spark, rows):
    b = extract.universal(_calls(spark, ("crm", {"company": "A", "firm": "BB", "city": "CC", "list": [{"company": "AA"}]})))
    assert rows(b.connections, "from_name", "to_name", "confidence") == [("AA", "CC", 0.5), ("BB", "CC", 0.5)]


def test_leads_fallbacks(spark, rows):
    lead = {"organization": "Org", "city": "Rome", "country": "IT", "first_name": "A", "last_name": "B", "jobTitle": "Lead buyer", "email": "a@org.it"}
    b = extract.extract(_calls(spark, ("find-leads", {"leads": [lead, {"name": "no firm"}]}), ("find_leads", [{"company": "Bare"}])))
    got = rows(b.connections, "relation", "from_name", "to_name")
    pii = "pii:" + hashlib.sha256(b"a b").hexdigest()[:12]
    assert got == sorted([("located_in", "Org", "Rome, IT"), ("works_at", pii, "Org"), ("works_at", pii, "Buyer"), ("has_domain", "Org", "org.it")], key=repr)
    assert ("Company", "Bare") in rows(b.entities, "type", "name")


def test_bulk_envelope_folds_unknown_fields(spark, rows):
    body = {"nodes": [{"type": "T", "name": "N", "id": "drop", "extra": "1", "kept": "outer", "properties": {"kept": "inner"}}, {"type": "T", "name": " "}]}
    x = envelopes.bulk_entities(spark.createDataFrame([(json.dumps(body),)], "body string"))
    r = x.collect()
    assert len(r) == 1 and r[0].properties == {"extra": "1", "kept": "inner"} and r[0].confidence is None


def test_sanctions_reader_skips_bad_lines(spark, tmp_path, rows):
    good = {"id": "1", "schema": "Person", "datasets": ["eu_fsf"], "properties": {"name": ["Ann", "A."], "country": ["ru", "long"], "position": ["Minister"]}}
    f = tmp_path / "s.jsonl"
    f.write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"id": "2", "schema": "Vessel", "properties": {"name": ["Ship"]}}) + "\n")
    b = registries.sanctions(staging.read(spark, str(f), "json", registries.SANCTIONS))
    assert rows(b.entities, "type", "name", "confidence") == [("Person", "Ann", 0.95)]
    assert rows(b.connections, "relation", "to_name") == [("holds_role", "Minister"), ("located_in", "RU")]


def test_prediction_flags_and_macro_dot(spark, rows):
    flags = spark.createDataFrame([("True",), ("false",), ("",)], "v string").select(feeds.prediction_flags(F.col("v")))
    assert [r[0] for r in flags.collect()] == [True, False, None]
    obs = spark.createDataFrame([("DGS2", "2024-01-01", "4.1"), ("DGS2", "2024-01-02", "4.2"), ("SOFR", "2024-01-01", "5"), ("SOFR", "2024-01-02", ".")], "series_id string, date string, value string")
    assert rows(feeds.macro_latest(obs), "series_id", "value", "channel_id") == [("DGS2", 4.2, "channel-credit")]


def test_actor_list_limits_before_the_length_rule(spark, rows):
    rec = spark.createDataFrame([("u", "t", "a,b", "Ann, ,B", "O1,O2,O3,O4", "25")], "url string, title string, themes string, persons string, orgs string, tone string")
    assert rows(feeds.event_actors(rec, 5), "actor", "score") == [("Ann", 1.0), ("O1", 1.0), ("O2", 1.0), ("O3", 1.0)]
    assert rows(feeds.event_actors(rec), "actor") == [("Ann",), ("O1",), ("O2",), ("O3",), ("O4",)]


def test_crash_expansion_counts(spark):
    c = {
        "crash_id": "c1", "name": "C", "crash_type": "MarketCrash", "start_date": "2008-01-01", "end_date": "2009-01-01", "peak_drawdown_pct": -50.0, "recovery_days": 100, "regime_during": "stressed",
        "root_causes": [{"name": "R1", "causal_weight": 0.6}, {"name": "R2", "causal_weight": 0.4}], "channels": [{"type": "credit", "intensity": 0.9}], "mechanisms": [{"type": "fire_sale"}],
        "entities_affected": [{"name": "Bank", "loss_pct": -80.0}], "interventions": [{"entity": "CB", "type": "bailout"}], "narratives": ["panic"],
    }
    df = spark.read.schema(catalogue.CRASH).json(spark.sparkContext.parallelize([json.dumps(c)]))
    nodes, edges = catalogue.expand_crashes(df)
    n = catalogue.crash_counts(df).first()
    assert edges.count() == n.relationships == 8 and n.entities == 8
    assert nodes.count() == 9  # the intervening body is a node row as well
    assert {r.relation for r in edges.collect()} == {"TRIGGERED", "TRANSMITTED_THROUGH", "AMPLIFIED_CRASH", "EXPOSED_TO", "bailout", "part_of", "supports"}


def _nodes(spark, *r):
    return spark.createDataFrame(
        [(i, "T", n, s, c, p, q) for i, n, s, c, p, q in r], "id string, type string, name string, source string, confidence double, properties map<string,string>, seq long"
    )


def _store(spark, *r):
    t = dt.datetime(2023, 1, 1)
    return spark.createDataFrame(
        [(i, "T", i, s, p, c, k, t, t) for i, s, p, c, k in r],
        "id string, type string, name string, sources array<string>, properties map<string,string>, confidence double, call_count long, first_seen timestamp, last_seen timestamp",
    )


def test_node_merge(spark):
    store = _store(spark, ("a", ["s0"], {"k": "old", "n": None}, 0.98, 4), ("z", ["s0"], {}, 0.5, 1))
    inc = _nodes(spark, ("a", "A", "s1", 0.6, {"k": "new", "n": "fill", "e": ""}, 2), ("a", "A", "s0", 0.6, {"m": "x"}, 1), ("b", "B1", "s2", 0.6, {"p": "1"}, 1), ("b", "B2", "s1", 0.9, {"p": "2", "q": "3"}, 2))
    got = {r.id: r for r in merge.merge_nodes(store, inc, F.lit(NOW_TS)).collect()}
    assert got["a"].properties == {"k": "old", "n": "fill", "m": "x"} and got["a"].sources == ["s0", "s1"]
    assert (got["a"].confidence, got["a"].call_count, got["a"].merged) == (0.99, 5, True)
    assert got["b"].name == "B1" and got["b"].properties == {"p": "1", "q": "3"} and got["b"].sources == ["s2", "s1"]
    assert (got["b"].confidence, got["b"].call_count, got["b"].merged) == (0.6, 1, False)
    assert got["z"].confidence == 0.5 and got["z"].last_seen.year == 2023 and got["a"].last_seen.year == 2024
    per_row = {r.id: r for r in merge.merge_nodes(store, inc, F.lit(NOW_TS), per_row=True).collect()}
    assert per_row["b"].confidence == pytest.approx(0.63) and per_row["b"].call_count == 2 and per_row["a"].call_count == 6


def test_merge_does_not_depend_on_partitioning_or_row_order(spark, rows):
    inc = _nodes(spark, *[(f"i{i % 3}", f"n{i}", f"s{i % 4}", 0.5, {"k": str(i)}, i) for i in range(24)])
    empty = _store(spark).limit(0)
    base = rows(merge.merge_nodes(empty, inc, F.lit(NOW_TS)))
    assert rows(merge.merge_nodes(empty, inc.orderBy(F.col("seq").desc()).repartition(5), F.lit(NOW_TS))) == base


def test_edge_merge_keys_on_the_triple(spark):
    s = "from_id string, relation string, to_id string, properties map<string,string>, confidence double, call_count long, first_seen timestamp, last_seen timestamp"
    t = dt.datetime(2023, 1, 1)
    store = spark.createDataFrame([("a", "r1", "b", {"x": "1"}, 0.97, 1, t, t)], s)
    inc = spark.createDataFrame([("a", "r1", "b", 0.1, {"x": "2"}, 1), ("a", "r2", "b", 0.3, {}, 1), ("a", "r2", "b", 0.4, {"l": "w"}, 2)], "from_id string, relation string, to_id string, confidence double, properties map<string,string>, seq long")
    got = {r.relation: r for r in merge.merge_edges(store, inc, F.lit(NOW_TS)).collect()}
    assert got["r1"].confidence == 0.99 and got["r1"].properties == {"x": "1"} and got["r2"].confidence == 0.4 and got["r2"].properties == {"l": "w"}


def test_added_connections_leave_known_endpoints_alone(spark):
    known = identity.entity_id(F.lit("LegalEntity"), F.lit("A"))
    nodes = _store(spark, ("x", ["s"], {"k": "v"}, 0.9, 7)).withColumn("id", known).withColumn("name", F.lit("A"))
    con = spark.createDataFrame([("A", "B", "owns", None, 1), ("A", "B", "owns", 0.6, 2), ("A", "", "owns", 0.6, 3)], "from_name string, to_name string, relationship string, confidence double, seq long")
    empty = spark.createDataFrame([], "from_id string, relation string, to_id string, properties map<string,string>, confidence double, call_count long, first_seen timestamp, last_seen timestamp")
    n, e = merge.add_connections(nodes, empty, con, F.lit(NOW_TS))
    got = {r.name: r for r in n.collect()}
    assert got["A"].call_count == 7 and got["A"].properties == {"k": "v"} and got["B"].confidence == 0.75 and len(got) == 2
    r = e.collect()
    assert len(r) == 1 and r[0].confidence == pytest.approx(0.65) and r[0].call_count == 2


def test_patch_overwrites_without_reinforcing(spark):
    store = _store(spark, ("a", ["s"], {"k": "old", "o": "1"}, 0.5, 3)).select("id", "type", "name", "confidence", "properties", "call_count")
    patch = spark.createDataFrame([("a", None, "New", 0.9, {"k": "new"}), ("b", "T", "B", 0.9, {})], "id string, type string, name string, confidence double, properties map<string,string>")
    got = {r.id: r for r in merge.patch_nodes(store, patch).collect()}
    assert got["a"].properties == {"k": "new", "o": "1"} and got["a"].confidence == 0.9 and got["a"].call_count == 3 and got["a"].type == "T" and got["b"].name == "B"


def test_perception_needs_two_sources(spark, rows):
    e = spark.createDataFrame([(1, 0.9, ["a"]), (2, 0.9, ["a", "b"]), (3, None, ["a"])], "id int, confidence double, sources array<string>")
    assert rows(merge.cap_unsourced(e), "id", "confidence") == [(1, 0.7), (2, 0.9), (3, 0.5)]


def test_typed_policy_counts_neighbour_types(spark, rows):
    ent = spark.createDataFrame([("e", "Portfolio"), ("c", "Corporation"), ("ch", "Channel"), ("p", "Person")], "id string, type string")
    rel = spark.createDataFrame([("e", "PORTFOLIO_HOLDS", "p"), ("e", "PORTFOLIO_EXPOSED_TO", "ch")], "from_id string, relation string, to_id string")
    got = {r.id: r for r in policy.check_policy(ent, rel, policy.REGIME_POLICY, typed=True).collect()}
    assert got["e"].missing == "1 more PORTFOLIO_HOLDS to Corporation/Asset" and not got["e"].compliant and got["e"].total == 2


def test_roles_default(spark):
    df = spark.createDataFrame([("Backtest the price",), ("nothing fits",)], "t string")
    assert [r.roles for r in policy.label_roles(df, "t").collect()] == [["prediction_validator"], ["cultural_analyst"]]


def test_result_edges_follow_the_path(spark, rows):
    res = spark.createDataFrame([("s", "a", "c", ["a", "b", "c"], 0.7)], "sim_id string, from_id string, to_id string, path array<string>, weight double")
    assert rows(scenario.result_edges(res), "relation", "from_id", "to_id", "confidence") == [("causes", "a", "c", 0.95), ("enables", "a", "b", 0.84), ("enables", "b", "c", 0.84)]
