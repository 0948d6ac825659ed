"""Bucketed timelines and event intensity against plain definitions."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import hawkes, signals
from ripplegraph.operators.timeline import asof_join, decayed_prefix, lagged, running_sum, runs

T0 = dt.datetime(2024, 1, 1)


def _events(seed, n=120, entities=5, hours=200):
    """Events where e0 owns about half of all rows."""
    r = random.Random(seed)
    return [("e0" if r.random() < 0.5 else f"e{r.randrange(entities)}", i, T0 + dt.timedelta(hours=r.random() * hours), round(r.random() * 10, 2)) for i in range(n)]


def _df(spark, ev):
    return spark.createDataFrame([(e, i, t, v) for e, i, t, v in ev], "k string, id int, ts timestamp, v double")


def test_lag_and_running_sum_cross_buckets(spark):
    ev = _events(1)
    df = _df(spark, ev).withColumn("n", (F.col("v") * 100).cast("long"))
    pos = F.unix_micros("ts")
    hour = 3_600_000_000
    got = {r.id: (r.prev_v, r.run_before, r.run_total) for r in lagged(running_sum(df, ["k"], ["ts", "id"], "n", pos, hour), ["k"], ["ts", "id"], ["v"], pos, hour).collect()}
    by = defaultdict(list)
    for e, i, t, v in ev:
        by[e].append((t, i, v))
    for rows in by.values():
        total, prev = 0, None
        for _, i, v in sorted(rows):
            c = int(v * 100 + 1e-9) if int(v * 100) == int(v * 100 + 1e-9) else int(v * 100)
            assert got[i] == (prev, total, total + c)
            total, prev = total + c, v


def test_runs_drop_the_open_tail(spark, rows):
    seq = "SSHSSSHHS"
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(seq)], "k string, i int, c string")
    got = rows(runs(df, ["k"], ["i"], F.col("c") == "S", F.col("i"), 4).groupBy("run_id").agg(F.min("i").alias("s"), F.count("*").alias("n")), "s", "n")
    assert got == [(0, 2), (3, 3)]


@pytest.mark.parametrize("beta", [0.1, 5.0, 200.0])
def test_decayed_prefix(spark, beta):
    ev = _events(2, hours=4000 if beta < 1 else 30)
    df = _df(spark, ev).withColumn("ms", F.unix_millis("ts"))
    got = {(r.k, r.ms): r.prefix for r in decayed_prefix(df, ["k"], "ms", "v", beta).collect()}
    ms = {i: int((t - T0).total_seconds() * 1000) for _, i, t, _ in ev}
    base = 1704067200000
    for e, i, t, _ in ev:
        want = sum(v * math.exp(-beta * (ms[i] - ms[j]) / 3.6e6) for f, j, u, v in ev if f == e and ms[j] < ms[i])
        assert got[(e, base + ms[i])] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_asof_join_takes_equal_times_and_carries_over_days(spark, rows):
    left = spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + dt.timedelta(days=5)), ("b", 3, T0)], "k string, id int, t timestamp")
    right = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(days=1), 2.0), ("a", T0 + dt.timedelta(days=9), 3.0)], "k string, u timestamp, price double")
    assert rows(asof_join(left, right, "k", "t", "u", "price"), "id", "price") == [(1, 1.0), (2, 2.0), (3, None)]


def _hawkes(spark, ev):
    x = spark.createDataFrame([(e, "t" + e, t, v) for e, _, t, v in ev], "entity_id string, entity_type string, ts timestamp, intensity double")
    ents = sorted({e for e, *_ in ev})
    alpha = {e: 0.1 * (i + 1) for i, e in enumerate(ents)}
    return x, spark.createDataFrame(list(alpha.items()), "entity_id string, alpha double"), alpha


def test_intensity_equals_the_pair_sum(spark):
    ev = _events(3)
    x, a, alpha = _hawkes(spark, ev)
    asof = T0 + dt.timedelta(hours=150)
    got = {r.entity_id: r.intensity for r in hawkes.intensity_now(x, a, F.lit(asof)).collect()}
    for e in alpha:
        want = 0.01 + sum(alpha[f] * v * 0.1 * math.exp(-0.1 * (asof - t).total_seconds() / 3600) for f, _, t, v in ev if f != e and t < asof)
        assert got[e] == pytest.approx(want)


def test_missing_alpha_defaults_differ_between_intensity_and_drivers(spark):
    ev = _events(4, n=20, hours=10)
    x, a, alpha = _hawkes(spark, ev)
    none = a.filter("false")
    asof = T0 + dt.timedelta(hours=12)
    got = {r.entity_id: (r.intensity, r.drivers) for r in hawkes.contagion_state(x, none, F.lit(asof)).collect()}
    want = 0.01 + sum(0.01 * v * 0.1 * math.exp(-0.1 * (asof - t).total_seconds() / 3600) for f, _, t, v in ev if f != "e0")
    assert got["e0"][0] == pytest.approx(math.floor(want * 1000 + 0.5) / 1000)
    assert not got["e0"][1]


def test_branching_sums_to_total_minus_own(spark):
    _, a, alpha = _hawkes(spark, _events(5))
    got = {r.entity_id: r.branching_ratio for r in hawkes.branching(a).collect()}
    assert got == pytest.approx({e: sum(alpha.values()) - v for e, v in alpha.items()})


def test_spatial_intensity_ignores_distance_without_positions(spark):
    ev = _events(6, n=30)
    x, a, alpha = _hawkes(spark, ev)
    lat = {e: None if e == "e1" else float(i * 10) for i, e in enumerate(sorted(alpha))}
    pos = spark.createDataFrame([(e, v, v) for e, v in lat.items()], "entity_id string, lat double, lon double")
    asof = T0 + dt.timedelta(hours=300)
    got = {r.entity_id: r.intensity for r in hawkes.spatial_intensity(pos, x.join(pos, "entity_id"), a, F.lit(asof)).collect()}

    def km(p, q):
        if p is None or q is None:
            return 0.0
        s = math.sin(math.radians(q - p) / 2) ** 2
        h = s + math.cos(math.radians(p)) * math.cos(math.radians(q)) * s
        return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for e in alpha:
        want = 0.01 + sum(alpha[f] * v * 0.1 * math.exp(-0.1 * (asof - t).total_seconds() / 3600) * 0.001 * math.exp(-0.001 * km(lat[e], lat[f])) for f, _, t, v in ev if f != e)
        assert got[e] == pytest.approx(want)


def test_active_neighbours_equal_the_band_join(spark):
    ev = _events(8, n=60, entities=9, hours=700)
    x, _, _ = _hawkes(spark, ev)
    seeds = x.select("entity_id").distinct()
    got = {(r.seed, r.entity_id) for r in hawkes.active_neighbours(seeds, hawkes.activity_days(x)).collect()}
    assert got == {(e, f) for e, _, t, _ in ev for f, _, u, _ in ev if e != f and abs((t - u).total_seconds()) < 86400}


def test_shock_cascade_waves(spark, rows):
    at = lambda h: T0 + dt.timedelta(hours=h)
    x = spark.createDataFrame([("a", "t", at(0), 1.0), ("b", "t", at(20), 1.0), ("c", "t", at(40), 1.0)], "entity_id string, entity_type string, ts timestamp, intensity double")
    a = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "entity_id string, alpha double")
    shock = spark.createDataFrame([("s", "a", 1.0)], "shock string, entity_id string, magnitude double")
    got = rows(hawkes.simulate_shock(shock, x, a, F.lit(at(48))), "entity_id", "peak_time_hours")
    assert got == [("a", 1), ("b", 2), ("c", 3)]  # R = 1.0, so each wave keeps 0.7 of the magnitude
    assert rows(hawkes.simulate_shock(shock, x, a, F.lit(at(48)), cap=2), "entity_id") == [("a",), ("b",)]


def test_jump_and_crossing(spark, rows):
    df = spark.createDataFrame([("m", i, T0 + dt.timedelta(days=i), p) for i, p in enumerate([0.4, 0.45, 0.6, 0.5])], "k string, id int, ts timestamp, price double")
    assert rows(signals.jumps(df, "k"), "id") == [(2,), (3,)]
    assert rows(signals.crossings(df.withColumnRenamed("price", "score"), "k"), "id") == [(2,), (3,)]


def test_cascade_and_recent_events_have_no_limit_by_default(spark, rows):
    x = spark.createDataFrame([(f"e{i:03}", "t", T0, 1.0) for i in range(130)], "entity_id string, entity_type string, ts timestamp, intensity double")
    a = x.select("entity_id", F.lit(0.01).alias("alpha"))
    shock = spark.createDataFrame([("s", "e000", 1.0)], "shock string, entity_id string, magnitude double")
    now = F.lit(T0 + dt.timedelta(hours=1))
    assert len(rows(hawkes.simulate_shock(shock, x, a, now), "entity_id")) == 130
    assert len(rows(hawkes.simulate_shock(shock, x, a, now, cap=hawkes.CASCADE_CAP), "entity_id")) == 100
    assert hawkes.recent(x.limit(5), now).count() == 5 and hawkes.recent(x.limit(5), now, min_events=10).count() == 0


def test_cascade_reach_equals_pairs(spark):
    """The largest magnitude within 24 hours, against all pairs of events."""
    import random

    rng = random.Random(6)
    ev = [(f"e{rng.randrange(40)}", "x", T0 + dt.timedelta(minutes=rng.randrange(6 * 24 * 60)), 1.0) for _ in range(90)]
    ev += [("edge1", "x", T0 + dt.timedelta(hours=1), 1.0), ("edge2", "x", T0 + dt.timedelta(hours=25), 1.0), ("edge3", "x", T0 + dt.timedelta(hours=25, minutes=1), 1.0)]
    spread = [(s, f"e{i}", rng.random()) for s in "ab" for i in rng.sample(range(40), 6)] + [("c", "edge1", 0.5), ("d", "edge2", 0.5)]
    days = hawkes.activity_days(spark.createDataFrame(ev, "entity_id string, entity_type string, ts timestamp, intensity double"))
    got = {(r.shock, r.entity_id): r.magnitude for r in hawkes.strongest_reach(spark.createDataFrame(spread, "shock string, `from` string, magnitude double"), days).collect()}
    want = {}
    for s, a, m in spread:
        for x in (e for e in ev if e[0] == a):
            for y in ev:
                if x[2].date() == y[2].date() or abs((x[2] - y[2]).total_seconds()) < 86400:
                    want[s, y[0]] = max(want.get((s, y[0]), 0.0), m)
    assert got == want


def test_place_tree_keeps_its_bound(spark):
    """Sums over the tree stay within the stated error of the exact ones; far fewer pairs than places."""
    import math
    import random

    rng = random.Random(8)
    places = [(rng.gauss(40, 8), rng.gauss(10, 20), rng.random()) for _ in range(3000)] + [(-60.0, -170.0, 5.0), (89.9, 179.9, 2.0)]
    at = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(20)]

    def km(a, o, b, p):
        a, o, b, p = map(math.radians, (a, o, b, p))
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2
        return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    exact = {t: sum(m * 0.001 * math.exp(-0.001 * km(*t, a, o)) for a, o, m in places) for t in at}
    frame = spark.createDataFrame(places, "lat double, lon double, m double")
    total = sum(p[2] for p in places)
    for error in (0.1, 0.01, 0.0):
        got = {(r.tlat, r.tlon): r["all"] for r in hawkes.spatial_sums(spark.createDataFrame(at, "lat double, lon double"), frame, 0.001, error).collect()}
        assert all(abs(got[t] - exact[t]) <= error * 0.001 * total + 1e-9 for t in at)
