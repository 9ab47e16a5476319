"""Exact semantics on small frames: nulls, ties, gaps, bounds, empty input."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.functions import windows as w
from pulsegrid.operators import audit, detectors, evaluation, features, fusion, inject, joins, learn, master
from pulsegrid.streaming import live

T0 = datetime(2024, 1, 1)
BY, ORDER = ["h"], ["ts"]


def frame(spark, values, minutes=None, host="a", schema="h string, ts timestamp_ntz, v double"):
    minutes = minutes or range(len(values))
    return spark.createDataFrame([(host, T0 + timedelta(minutes=m), v) for m, v in zip(minutes, values, strict=True)], schema)


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def test_run_lengths(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 1, 1, 0, 0, 1]
    out = w.with_runs(frame(spark, [float(x) for x in flags]), F.col("v") == 1, BY, ORDER)
    assert column(out, "run_pos") == [0, 1, 2, 0, 1, 2, 3, 4, 5, 0, 0, 1]
    assert column(out, "run_len") == [1, 2, 2, 1, 5, 5, 5, 5, 5, 2, 2, 1]
    assert column(w.persistent(frame(spark, [float(x) for x in flags]), F.col("v") == 1, BY, ORDER, 3, "p"), "p") == [i in range(4, 9) for i in range(12)]


def test_null_flag_is_false(spark):
    assert column(w.with_runs(frame(spark, [None, 1.0, None]), F.col("v") == 1, BY, ORDER), "run_pos") == [0, 1, 0]


def test_sessions_keep_equal_gap(spark):
    df = frame(spark, [1.0] * 7, [0, 1, 2, 5, 65, 125, 186])
    assert sorted(r.n_rows for r in fusion.sessions(df, ["h"], "ts", 60).collect()) == [1, 6]


def test_rolling_needs_values(spark):
    df = frame(spark, [1.0, None, None, 4.0])
    assert column(df.withColumn("m", w.rolling(F.col("v"), w.trailing(BY, ORDER, 3), 2)), "m") == [None] * 4
    assert column(df.withColumn("m", w.rolling(F.col("v"), w.trailing(BY, ORDER, 4), 2)), "m")[3] == 2.5


@pytest.mark.parametrize("seed", range(2))
def test_slope_is_least_squares(spark, seed):
    x = np.random.default_rng(seed).normal(size=40)
    got = column(w.slope(frame(spark, x.tolist()), "v", BY, ORDER, 10, "k"), "k")
    want = [None] * 9 + [np.polyfit(np.arange(10), x[i - 9 : i + 1], 1)[0] for i in range(9, 40)]
    assert got[:9] == want[:9] and np.allclose(got[9:], want[9:])


def test_ewma_equals_pandas(spark):
    x = [1.0, None, 3.0, 2.0, None, None, 8.0]
    want = pd.Series(x).ewm(span=30, adjust=True).mean()
    for f in (w.ewma,):
        assert np.allclose(column(f(frame(spark, x), "v", BY, ORDER, 30, "e"), "e"), want)
    y = np.random.default_rng(1).normal(10, 3, 3000)  # many blocks, the gap longer than one
    y[500:620] = np.nan
    got = column(w.ewma(frame(spark, [None if np.isnan(v) else float(v) for v in y]), "v", BY, ORDER, 3, "e"), "e")
    assert np.allclose(np.array(got, float), pd.Series(y).ewm(span=3, adjust=True).mean())


def test_robust_z_falls_back(spark):
    flat = frame(spark, [5.0] * 39 + [6.0])
    z = column(w.robust_z(flat, "v", F.lit(True), "z"), "z")
    assert z[0] == 0 and z[-1] == pytest.approx(1 / np.std([5.0] * 39 + [6.0], ddof=1))
    assert set(column(w.robust_z(frame(spark, [1.0, 9.0]), "v", F.lit(True), "z"), "z")) == {0.0}


def test_mode_takes_least_on_ties(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", None)], "h string, c string")
    assert [tuple(r) for r in w.mode_of(df, ["h"], "c", "m").collect()] == [("a", "x")]


def test_spikes_and_poison(spark):
    flat = [10.0, 11.0] * 10
    out = audit.flag_spikes(frame(spark, [*flat, 99.0, None, 500.0]), "v", BY, ORDER, 10, 3.0)
    assert column(out, "spike")[20:] == [True, False, False]


def test_flatline_breaks_at_missing(spark):
    out = column(audit.flag_flatlines(frame(spark, [7.0] * 4 + [None] + [7.0] * 2), "v", BY, ORDER, 3), "flatline")
    assert out == [True] * 4 + [False] * 3


def test_asof_takes_earlier_on_ties(spark):
    left = frame(spark, [0.0], [10]).drop("v")
    right = frame(spark, [1.0, 2.0], [8, 12])
    assert joins.asof(left, right, ["h"], "ts", ["v"], 300).collect()[0].v == 1.0
    assert joins.asof(left, right, ["h"], "ts", ["v"], 60).collect()[0].v is None
    assert joins.asof(left, right.limit(0), ["h"], "ts", ["v"], 60).collect()[0].v is None


def test_interval_joins_meet_brute_force(spark):
    rng = np.random.default_rng(3)
    spans = [(i, "ab"[i % 2], int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 600, 40), rng.integers(0, 200, 40), strict=True))]
    at = lambda m: T0 + timedelta(minutes=m)
    df = spark.createDataFrame([(i, h, at(a), at(b)) for i, h, a, b in spans], "i int, h string, a timestamp_ntz, b timestamp_ntz")
    other = df.select(F.col("i").alias("j"), "h", F.col("a").alias("c"), F.col("b").alias("d"))
    got = {(r.i, r.j) for r in joins.overlaps(df, other, ["h"], ("a", "b"), ("c", "d"), 3600).collect()}
    assert got == {(i, j) for i, h, a, b in spans for j, g, c, d in spans if h == g and a <= d and b >= c}
    points = spark.createDataFrame([(k, "a", at(7 * k)) for k in range(100)], "k int, h string, ts timestamp_ntz")
    for closed in (True, False):
        got = sorted((r.k, r.i) for r in joins.point_in_interval(points, df, ["h"], "ts", "a", "b", closed).collect())
        assert got == sorted((k, i) for k in range(100) for i, h, a, b in spans if h == "a" and a <= 7 * k and (7 * k <= b if closed else 7 * k < b))


def test_wildcard_reaches_all_hosts(spark):
    rows = frame(spark, [1.0], [30]).union(frame(spark, [1.0], [30], "b"))
    events = spark.createDataFrame([("*", T0, T0 + timedelta(hours=1))], "h string, event_start timestamp_ntz, event_end timestamp_ntz")
    assert evaluation.row_labels(rows.withColumn("id", F.col("h")), "id", events, "h", "ts").count() == 2


def test_regime_bounds(spark):
    windows = [(T0 + timedelta(minutes=2), T0 + timedelta(minutes=4))]
    df = frame(spark, [0.0] * 6)
    assert column(df.withColumn("g", master.regime_id(F.col("ts"), windows)), "g") == [0, 0, -1, -1, 1, 1]
    assert column(df.withColumn("g", master.in_maintenance(F.col("ts"), windows)), "g") == [False, False, True, True, True, False]


def test_job_expansion(spark):
    jobs = spark.createDataFrame([(1, T0 + timedelta(seconds=30), T0 + timedelta(minutes=2)), (2, T0, T0 + timedelta(hours=101)), (3, T0 + timedelta(minutes=1), T0)], "j int, a timestamp_ntz, b timestamp_ntz")
    assert [(r.j, r.n) for r in master.expand_jobs(jobs, "a", "b").groupBy("j").agg(F.count("*").alias("n")).collect()] == [(1, 3)]


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {tuple(r) for r in master.last_per(df, ["k"], ["o"]).select("k", "v").collect()} == {("a", "y"), ("b", None)}


def test_scalars(spark):
    df = spark.createDataFrame([("{104,105}", "[1, 2]", "x-1-2", "3.7"), ("{300}", '{1,"a b"}', "rpc-12-7", "bad"), (None, None, None, None)], "b string, l string, h string, n string")
    rows = df.select(scalars.decode_bytes(F.col("b")), scalars.parse_strings(F.col("l")), scalars.rack_id(F.col("h")), scalars.to_int(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("hi", ["1", "2"], 1, 3), ("{300}", ["1", "a b"], 12, None), (None, [], None, None)]


def test_episode_peaks_take_in_gaps(spark):
    df = frame(spark, [1.0, 1.0, 0.0, 1.0, 1.0]).withColumn("p", F.when(F.col("v") == 0, 0.6).otherwise(0.0))
    out = fusion.candidate_episodes(df, BY, ORDER, F.col("v") == 1, ["p"], agree={"p": 0.5}).collect()
    assert [(r.peak_p, r.n_active, r.n_agree) for r in out] == [(0.6, 4, 1)]


def test_rolling_median_of_long_frames(spark):
    rng = np.random.default_rng(3)
    x = [float(v) if rng.random() < 0.9 else None for v in rng.normal(size=900)]
    df = frame(spark, x)
    want = pd.Series(x, dtype=float).rolling(300, min_periods=60).median()
    got = w.rolling_median(df, F.col("v"), BY, ORDER, 300, 60, "m").orderBy(*ORDER).toPandas()["m"]
    assert np.allclose(got, want, equal_nan=True)
    flags = [bool(b) for b in rng.random(200) < 0.7]
    runs = w.in_runs(frame(spark, [float(b) for b in flags]), {"a": (F.col("v") == 1, 3), "b": (F.col("v") == 1, 1)}, BY, ORDER).orderBy(*ORDER).collect()
    plain = w.persistent(frame(spark, [float(b) for b in flags]), F.col("v") == 1, BY, ORDER, 3, "a").orderBy(*ORDER).collect()
    assert [r.a for r in runs] == [r.a for r in plain] and [r.b for r in runs] == flags


def test_episodes_merge_by_rows(spark):
    flags = [1, 1] + [0] * 10 + [1, 1, 1] + [0] * 11 + [1, 1] + [0, 1, 0]
    out = fusion.candidate_episodes(frame(spark, [float(x) for x in flags]), BY, ORDER, F.col("v") == 1, ["v"], 2, 11)
    assert sorted(r.n_active for r in out.collect()) == [2, 5]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=2, max_size=30))
def test_auroc_mirrors(spark, pairs):
    df = spark.createDataFrame([(float(s), y) for s, y in pairs], "s double, y boolean")
    a = evaluation.auroc(df, "s", "y").collect()[0][0]
    b = evaluation.auroc(df.withColumn("s", -F.col("s")), "s", "y").collect()[0][0]
    p, n = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    if not p or not n:
        assert a is None
    else:
        want = np.mean([(x > z) + 0.5 * (x == z) for x in p for z in n])
        assert a == pytest.approx(want) and a + b == pytest.approx(1)


def test_injection_fires_only_inside(spark):
    df = frame(spark, [10.0, 10.5] * 30, host="hx").withColumnRenamed("h", "hostname").withColumn("id", F.monotonically_increasing_id())
    bad, events = inject.inject(df, [{"type": "peer_node_divergence", "power_factor": 2.0, "hostname": "hx", "start": "2024-01-01 00:40:00", "end": "2024-01-01 00:50:00", "column": "v"}])
    stats_until = F.col("ts") < F.lit("2024-01-01 00:40:00").cast("timestamp_ntz")
    flagged = detectors.zscore_detector(bad, ["v"], "hostname", ["ts"], stats_until, columns_least=1)
    hits = [r.ts for r in flagged.where("is_flagged").collect()]
    assert len(events) == 1 and len(hits) == 10 and min(hits) == T0 + timedelta(minutes=40)


def test_isolation_forest_ranks_outlier():
    x = np.concatenate([np.random.default_rng(0).normal(size=(500, 2)), [[9.0, 9.0]]])
    assert learn.IsolationForest(x).score(x).argmin() == 500


def test_boosted_trees_learn(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0.5)) for a, b in rng.random((200, 2))], "a double, b double, y int")
    out = learn.boosted_trees(df, df, ["a", "b"], "y", 2, 3)
    assert evaluation.auroc(out.withColumn("t", F.col("y") == 1), "prob", "t").collect()[0][0] > 0.95


def test_stream_equals_batch(spark, tmp_path):
    df = frame(spark, [float(i) for i in range(300)], [7 * i for i in range(300)])
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.tumbling(live.source(spark, str(tmp_path / "in")), "ts", ["h"], "v", "1 hour")
    live.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {tuple(r) for r in live.tumbling(df, "ts", ["h"], "v", "1 hour").collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got <= batch and len(batch) - len(got) <= 2  # windows still open at the watermark


def test_stream_profile(spark, tmp_path):
    df = frame(spark, [1.0, 2.0, None, 6.0])
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    live.drain_batches(live.running_profile(live.source(spark, str(tmp_path / "in")), "ts", "h", "v"), lambda b, _: seen.extend(b.collect()), str(tmp_path / "cp"))
    assert (seen[-1].run_n, seen[-1].run_mean, seen[-1].run_max) == (3, 3.0, 6.0)


def test_empty_input(spark):
    e = frame(spark, [1.0]).limit(0)
    assert w.with_runs(e, F.lit(True), BY, ORDER).count() == 0
    assert fusion.sessions(e, ["h"], "ts").count() == 0
    assert features.rolling_features(e, "v", BY, ORDER).count() == 0


def test_stages_run_end_to_end(spark, tmp_path):
    from pulsegrid import run

    rng = np.random.default_rng(0)
    rows = []
    for h in ("rpc-1-1", "rpc-1-2"):
        for m in range(240):
            hot = h == "rpc-1-2" and 200 <= m < 220
            rows += [(T0 + timedelta(minutes=m), h, s, float(50 + rng.normal() + 60 * hot)) for s in ("power", "temp")]
    spark.createDataFrame(rows, "timestamp timestamp_ntz, hostname string, sensor string, value double").write.parquet(str(tmp_path / "in/readings"))
    spark.createDataFrame([(1, "rpc-1-2", "power", T0 + timedelta(minutes=200), T0 + timedelta(minutes=220))], "event_id long, hostname string, category string, event_start timestamp_ntz, event_end timestamp_ntz").write.parquet(str(tmp_path / "in/incidents"))
    config = run.Config(train_end="2024-01-01 03:00:00", val_end="2024-01-01 03:10:00", sensors=["power", "temp"])
    took = run.run(spark, config, f"file://{tmp_path}/in", f"file://{tmp_path}/out", run.select())
    assert list(took) == list(run.STAGES)
    found = spark.read.parquet(str(tmp_path / "out/evaluate")).collect()[0]
    assert found.tp >= 1 and found.fn == 0
    assert run.select(start="episodes") == ["episodes", "evaluate"] and run.select(only="detect") == ["detect"]


def test_raw_files(spark, tmp_path):
    from pulsegrid.sources import files

    (tmp_path / "a.csv").write_text('Timestamp,Value,Name\n1704067200,1.5,"{104,105}"\n2024-01-01 00:01:00,bad,x\n')
    n = files.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"), ["timestamp"], ["name"])
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).orderBy("timestamp").select(F.date_format("timestamp", "HH:mm"), "value", "name").collect()]
    assert n == 2 and got == [("00:00", 1.5, "hi"), ("00:01", None, "x")]
    (tmp_path / "t.csv").write_text("start_time,end_time,hostnames,category,severity,description,job_id\n2024-01-01 00:00:00,2024-01-01 01:00:00,a| b |,overheated,high,x,\n")
    assert sorted((r.hostname, r.category, r.severity, r.duration_min) for r in files.read_tickets(spark, str(tmp_path / "t.csv")).collect()) == [("a", "thermal", 3, 60.0), ("b", "thermal", 3, 60.0)]
    (tmp_path / "f.csv").write_text("timestamp,hostname,failure_type,duration_min,ticket_id,job_id\n2024-01-01 00:00:00,a,disk,,1,\n")
    f = files.read_node_failures(spark, str(tmp_path / "f.csv")).collect()[0]
    assert (f.category, f.duration_min, f.event_start.hour) == ("hardware", 60.0, 6)
    (tmp_path / "j.csv").write_text("job_id,node,start_time,end_time,exit_code,failure_reason\n1,a,2024-01-01 00:00:00,2024-01-01 01:00:00,137:0,\n2,a,2024-01-01 00:00:00,2024-01-01 01:00:00,0:0,NODE_FAIL\n3,a,2024-01-01 00:00:00,2024-01-01 01:00:00,0:0,\n4,a,2024-01-01 00:00:00,2024-01-01 01:00:00,1:0,\n")
    assert sorted((r.job_id, r.severity) for r in files.read_job_failures(spark, str(tmp_path / "j.csv")).collect()) == [(1, 2), (2, 3), (4, 1)]


def test_density_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(6, 0.3, (40, 2)), [[30.0, -30.0]]])
    labels = learn.density_clusters(x)
    assert labels[80] == -1 and len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1 and labels[0] != labels[40]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x[:80])], "i int, a double, b double")
    assert learn.cluster_profiles(df, ["a", "b"], "i").select("cluster_id").distinct().count() == 2


def test_text_clauses(spark):
    from pulsegrid.operators import narrative as n

    df = spark.createDataFrame([(90.0, 30.0, [1, 2, 3, 4, 5]), (None, None, [])], "p double, b double, j array<int>")
    got = df.select(
        n.sensor("Inlet", F.col("p"), F.col("b"), "C"), n.jobs(F.col("j"), 3), n.deviation(F.col("p"), F.col("b")), n.paragraph(F.lit(None).cast("string"), F.lit("x"), F.lit("")),
        n.contributions(["u", "v", "w"], [F.col("p"), -F.col("b"), F.lit(0.0)], 2), F.size(n.evidence([F.lit("a"), F.lit("a"), F.lit(None).cast("string")])), n.peers(F.col("p") / 10, F.lit(4)),
    ).collect()
    assert tuple(got[0]) == ("Inlet peaked at 90.0 C (30.0 before).", "Running jobs: 1, 2, 3 and 2 more.", 2.0, "x", "Main drivers: u, v.", 1, "The host departs from 4 peers of its job by 9.0 deviations.")
    assert tuple(got[1]) == (None, None, None, "x", None, 1, None)
    at = spark.createDataFrame([(T0, T0 + timedelta(minutes=90))], "a timestamp_ntz, b timestamp_ntz")
    assert at.select(n.lead_time(F.col("a"), F.col("b")), n.minute(F.col("a")), n.sentence_case(F.lit("power"))).collect()[0][:] == ("90 min before the incident", "2024-01-01 00:00 UTC", "Power")


def test_job_context_helpers(spark):
    from pulsegrid.operators import jobs as j

    alerts = spark.createDataFrame([("x", "h1", 0, 0.5), ("x", "h2", 0, 0.5), ("y", "h3", 0, 0.95), ("z", "h9", 0, 0.4)], "alert string, host string, minute int, conf double")
    ctx = spark.createDataFrame([("h1", 0, "JOB_EXPLAINED"), ("h2", 0, "INFRA_FAULT"), ("h3", 0, "COOLING_FAULT")], "host string, minute int, ctx string")
    got = {r.alert: (r.context, r.conf) for r in j.enrich(alerts, ctx, "host", "minute", "alert", "ctx", "conf").collect()}
    assert {k: (c, round(v, 6)) for k, (c, v) in got.items()} == {"x": ("INFRA_FAULT", 0.35), "y": ("COOLING_FAULT", 0.8), "z": (None, 0.4)}
    v = spark.createDataFrame([(i, [float(i)], 0 if i < 5 else 1 if i < 9 else 2) for i in range(10)], "i int, v array<double>, cluster_id int")
    merged = j.merge_small(v, "v", "cluster_id", {0: [2.0], 1: [6.5], 2: [9.0]}, 3)
    assert {r.i: r.cluster_id for r in merged.collect()}[9] == 1
    first = spark.createDataFrame([(T0, T0 + timedelta(minutes=15)), (T0 + timedelta(minutes=30), T0)], "s timestamp_ntz, o timestamp_ntz")
    assert [round(r[0], 6) for r in first.select(j.onset_alignment(F.col("s"), F.col("o"))).collect()] == [round(float(np.exp(-1)), 6)] * 2


def test_permutation_importance(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b), bool(a > 0.5)) for i, (a, b) in enumerate(rng.random((400, 2)))], "k int, a double, b double, y boolean")
    loss = evaluation.permutation_importance(df, F.col("a") + 0.01 * F.col("b"), ["a", "b"], "y", "k")
    assert loss["a"] > 0.3 and abs(loss["b"]) < 0.05
