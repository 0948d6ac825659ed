"""Streaming equals batch, late data, replays."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ripplegraph.streaming import jobs, late, state, store

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id int, k string, ts timestamp, value double"


def _land(spark, path, *batches):
    """One file per batch, so that one trigger reads one batch."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").json(f"{path}/{i}")


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def _ev(i, hours, k="a", value=1.0):
    return (i, k, T0 + dt.timedelta(hours=hours), value)


def test_late_rows_miss_closed_windows_only(spark, tmp_path, rows):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _land(spark, src, [_ev(1, 0.5), _ev(2, 5.0)], [_ev(4, 4.2)], [_ev(3, 0.6), _ev(5, 9.0)])
    x = jobs.windowed_activity(_stream(spark, src), "k").select(F.hour("window.start").alias("h"), "n")
    jobs.run_now(x.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    # row 4 is behind the newest row but in time; row 3 comes after its window was closed (watermark 4:00)
    assert rows(spark.read.schema("h int, n long").parquet(out)) == [(0, 1), (4, 1), (5, 1)]


def _changes(spark, tmp_path, name, stream, schema):
    """Run what is there and read all changes written so far; the same name goes on from its checkpoint."""
    out = str(tmp_path / name / "out")
    jobs.run_now(stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / name / "cp")))
    return spark.read.schema(schema).parquet(out)


def test_decay_state_is_independent_of_arrival_order(spark, tmp_path):
    ev = [_ev(i, h, "ab"[i % 2], float(i + 1)) for i, h in enumerate([0.2, 7.5, 3.1, 3.9, 12.0, 1.4])]
    got = []
    for name, batches in (("x", [ev[:2], ev[2:4], ev[4:]]), ("y", [ev[4:], ev[:2], ev[2:4]]), ("z", [ev])):
        src = str(tmp_path / name / "in")
        _land(spark, src, *batches)
        s = _stream(spark, src).select(F.col("k").alias("entity_id"), "ts", F.col("value").alias("mass"))
        c = _changes(spark, tmp_path, name, state.decayed_state(s, 0.1, watermark="1 day"), state.DECAYED)
        got.append({r.entity_id: (r.s, r.last_hour) for r in state.decay_snapshot(c, 0.1).collect()})
    for g in got[1:]:
        assert {k: v[1] for k, v in g.items()} == {k: v[1] for k, v in got[0].items()}
        assert {k: v[0] for k, v in g.items()} == pytest.approx({k: v[0] for k, v in got[0].items()})


def test_state_over_five_batches_and_a_restart(spark, tmp_path):
    """Latest points and decayed mass equal a batch computation after a restart from the checkpoint."""
    import math

    ev = [_ev(i, i * 0.4, "abc"[i % 3], float(i % 7)) for i in range(50)]
    src = str(tmp_path / "in")
    for part in ([ev[:10], ev[10:20], ev[20:30]], [ev[30:40], ev[40:]]):  # five files, two runs
        done = len(list((tmp_path / "in").glob("*"))) if (tmp_path / "in").exists() else 0
        for i, b in enumerate(part):
            _land(spark, f"{src}/{done + i}", b)
        stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{src}/*/*")
        p = _changes(spark, tmp_path, "p", state.latest_points(stream().select(F.col("k").alias("entity"), F.lit("m").alias("metric"), "value", "ts"), 4), state.POINTS)
        d = _changes(spark, tmp_path, "d", state.decayed_state(stream().select(F.col("k").alias("entity_id"), "ts", F.col("value").alias("mass")), 0.1), state.DECAYED)
    got = sorted((r.entity, r.ts, r.value) for r in state.points_snapshot(p, 4).collect())
    assert got == sorted((k, t, v) for x in "abc" for _, k, t, v in sorted((e for e in ev if e[1] == x), key=lambda e: e[2])[-4:])
    for r in state.decay_snapshot(d, 0.1).collect():
        end = r.last_hour + 1 - T0.replace(tzinfo=dt.UTC).timestamp() / 3600
        want = sum(v * math.exp(-0.1 * (end - i * 0.4)) for i, k, _, v in ev if k == r.entity_id)
        assert r.s == pytest.approx(want)
    assert p.groupBy("entity", "salt").agg(F.max("seq").alias("s")).agg(F.max("s")).first()[0] > 1


def test_state_expires(spark, tmp_path):
    """A key that saw nothing for the time to live leaves the state; its last rows are marked."""
    src = str(tmp_path / "in")
    _land(spark, src, [_ev(1, 0.0, "old"), _ev(2, 0.1, "new")], [_ev(3, 30.0, "new")], [_ev(4, 60.0, "new")], [_ev(5, 61.0, "new")])
    s = _stream(spark, src).select(F.col("k").alias("entity"), F.lit("m").alias("metric"), "value", "ts")
    c = _changes(spark, tmp_path, "e", state.latest_points(s, 3, ttl_hours=24, salts=1), state.POINTS)
    assert {r.entity for r in state.points_snapshot(c, 3).collect()} == {"new"}
    assert {r.entity for r in state.points_snapshot(c, 3, expired=True).collect()} == {"old", "new"}


def test_replayed_batch_is_applied_once(spark, tmp_path, rows):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([_ev(1, 1.0)], SCHEMA).select(F.col("k").alias("entity_id"), "ts", F.col("value").alias("mass"))

    def step(x, version):
        new = jobs.decay_hours(x, 0.1)
        return {"decay": jobs.merge_decay(jobs.touched_state(new, root, "decay", version, jobs.DECAY), new, 0.1)}

    body = jobs.each_version(root, step)
    body(df, 0)
    first = rows(store.read_latest(spark, f"{root}/decay", jobs.DECAY))
    body(df, 0)
    assert rows(store.read_latest(spark, f"{root}/decay", jobs.DECAY)) == first and store.versions(spark, f"{root}/decay") == [1]
    body(df, 1)
    assert rows(store.read_latest(spark, f"{root}/decay", jobs.DECAY))[0][1] == pytest.approx(2 * first[0][1], abs=1e-5)


def test_polls_are_deduplicated_across_batches(spark, tmp_path, rows):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _land(spark, src, [_ev(1, 0.1), _ev(2, 0.2)], [_ev(2, 0.2), _ev(3, 0.3)])
    x = jobs.dedupe_polls(_stream(spark, src), ["id"]).select("id")
    jobs.run_now(x.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    assert rows(spark.read.schema("id int").parquet(out)) == [(1,), (2,), (3,)]


def test_ingest_stream_reinforces_per_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, names in enumerate((["Acme", "Acme", "Beta"], ["Acme"])):
        spark.createDataFrame([(f"{i}{j}", "crm", f'{{"company": "{n}"}}') for j, n in enumerate(names)], "call_id string, tool string, result string").coalesce(1).write.json(f"{src}/{i}")
    calls = spark.readStream.schema("call_id string, tool string, result string").option("maxFilesPerTrigger", 1).json(f"{src}/*")
    jobs.run_now(jobs.ingest_tool_outputs(calls, out, str(tmp_path / "cp"), F.lit(T0)))
    got = {r.name: (round(r.confidence, 2), r.call_count) for r in store.read_latest(spark, f"{out}/nodes", jobs.NODES).collect()}
    assert got == {"Acme": (0.63, 2), "Beta": (0.6, 1)}


def test_append_sinks_keep_every_batch(spark, tmp_path, rows):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(f"e{i}", "Corporation", "stressed"), (f"b{i}", "Corporation", "normal")], "id string, type string, regime string").coalesce(1).write.json(f"{src}/{i}")
    ent = spark.readStream.schema("id string, type string, regime string").option("maxFilesPerTrigger", 1).json(f"{src}/*")
    jobs.run_now(jobs.route_by_priority(ent, out, str(tmp_path / "cp")))
    assert rows(store.read_all(spark, f"{out}/priority", "id string")) == [("e0",), ("e1",), ("e2",)]
    assert rows(store.read_all(spark, f"{out}/batch", "id string")) == [("b0",), ("b1",), ("b2",)]
    touched = spark.readStream.schema("id string, type string, regime string").option("maxFilesPerTrigger", 1).json(f"{src}/*")

    def enrich(seeds):
        return seeds.selectExpr("'hub' as from_id", "'related_to' as relation", "substring(id, 1, 1) as to_id", "0.5D as confidence", "1.0D as weight", "'t' as source")

    jobs.run_now(jobs.enrich_touched(touched, enrich, f"{out}/t", str(tmp_path / "cp2")))
    assert rows(jobs.inferred_edges(spark, f"{out}/t").select("to_id")) == [("b",), ("e",)]


def test_state_rewrites_touched_buckets_and_keeps_two_versions(spark, tmp_path, rows):
    root = str(tmp_path / "s")
    for v, ids in enumerate((["a", "b"], ["a"], ["a"], ["a"]), 1):
        df = spark.createDataFrame([(i, float(v), 0) for i in ids], jobs.DECAY)
        store.write_state(df, f"{root}/decay", v, ["entity_id"], 64)
    assert rows(store.read_latest(spark, f"{root}/decay", jobs.DECAY)) == [("a", 4.0, 0), ("b", 1.0, 0)]
    held = [store._buckets(spark, f"{root}/decay", v) for v in (1, 2, 3, 4)]
    assert len(held[0]) == 1 and held[1] == [] and len(held[2]) == len(held[3]) == 1


def test_late_rows_are_kept_and_repaired(spark, tmp_path):
    """Sliding windows after a repair equal a batch run over all rows; only windows with late rows are counted anew."""
    src = str(tmp_path / "in")
    batches = [[_ev(1, 0.5), _ev(2, 5.0), _ev(3, 4.1, "b")], [_ev(4, 4.2), _ev(5, 0.7), _ev(6, 0.6, "b")], [_ev(7, 12.0), _ev(8, 0.1, "c", 3.0), _ev(9, 5.1)], [_ev(10, 12.5)]]
    _land(spark, src, *batches)
    agg = jobs.windowed_activity(_stream(spark, src), "k", length="1 hour", slide="30 minutes")
    out = str(tmp_path / "out")
    jobs.run_now(agg.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    written = spark.read.schema("window struct<start:timestamp,end:timestamp>, k string, n bigint, total double").parquet(out)
    root = str(tmp_path / "late")
    jobs.run_now(late.keep_late(_stream(spark, src), root, str(tmp_path / "cp2"), "k", slide="30 minutes"))
    fixed = late.repair(spark, root, SCHEMA, "k", slide="30 minutes")
    got = {(r.window.start, r.k): (r.n, r.total) for r in late.repaired(written, fixed, "k").collect()}
    want = {}
    for _, k, t, v in (e for b in batches for e in b):
        for half in range(60):
            start = T0 + dt.timedelta(minutes=30 * (half - 1))
            if start <= t < start + dt.timedelta(hours=1) and start + dt.timedelta(hours=1) <= T0 + dt.timedelta(hours=11.5):
                n, total = want.get((start, k), (0, 0.0))
                want[start, k] = (n + 1, total + v)
    assert got == want
    assert {(r.window.start, r.k) for r in fixed.collect()} == {(T0 + dt.timedelta(minutes=m), k) for m, k in [(0, "a"), (30, "a"), (0, "b"), (30, "b"), (-30, "c"), (0, "c")]}
