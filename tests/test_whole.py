"""Queries cover all rows, compared with plain versions on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import catalog
from pulsegrid.sources import adapters


@pytest.fixture(scope="module")
def few_jobs(spark, tmp_path_factory):
    """Some orders' tasks, on any host and with any number of cpus: their folder and their rows."""
    d = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey % 10 = 3").write.parquet(f"{d}/lineitem.parquet")
    return d, adapters.jobs(spark, d).collect()


def test_overlaps_of_all_hosts(spark, few_jobs):
    d, tasks = few_jobs
    assert len({t.host_id % 10 for t in tasks}) > 1
    want: dict = {}
    for a in tasks:
        n = sum(a.host_id == b.host_id and a.start_time <= b.end_time and a.end_time >= b.start_time for b in tasks)
        want[a.job_id, a.task] = want.get((a.job_id, a.task), 0) + n
    assert {(r.job_a, r.task_a): r.n_overlaps for r in catalog.queries()["interval_overlap"](spark, d).collect()} == want


def test_job_context_has_all_jobs(spark, few_jobs):
    d, tasks = few_jobs
    assert max(t.cpus for t in tasks) > 32
    active: dict = {}
    count: dict = {}
    for t in tasks:
        day = t.start_time.replace(hour=0, minute=0, second=0, microsecond=0)
        while day <= t.end_time:
            active.setdefault((t.host_id, day), set()).add((t.job_id, t.cpus))
            count.setdefault((t.host_id, day), []).append(t.cpus)
            day += timedelta(days=1)
    share: dict = {}
    want = {}
    for (host, day), found in active.items():
        found = sorted(found)
        for job, cpus in found:
            share[host, job] = share.get((host, job), 0) + cpus
        want[host, day] = ("|".join(str(j) for j, _ in found), len(found), *found[0], sum(c for _, c in found), len(found) > 1)
    run = lambda name: catalog.queries()[name](spark, d).collect()
    columns = ("jobs", "active_job_count", "primary_job_id", "primary_job_share", "total_job_share", "is_multi_job")
    assert {(r.host_id, r.ts): tuple(r[c] for c in columns) for r in run("job_context_per_bucket")} == want
    assert {(r.host_id, r.job_id): r.share for r in run("cpu_share_merge")} == share
    assert {(r.host_id, r.ts): (r.n, r.cpus) for r in run("job_minute_expand")} == {k: (len(v), sum(v)) for k, v in count.items()}


@pytest.mark.parametrize("step, unit", [("1 minute", 60), ("1 hour", 3600), ("1 day", 86400)])
def test_contexts_by_blocks_are_those_of_expanded_jobs(spark, step, unit):
    from pulsegrid.operators import master

    rng = np.random.default_rng(1)
    begin = datetime(1970, 1, 1) - timedelta(seconds=300 * unit)  # steps before and after 0
    rows = []
    for i in range(400):
        a = begin + timedelta(seconds=int(rng.integers(0, 1500 * unit)))
        length = int(rng.integers(0, 60 * unit)) if i % 20 else 1400 * unit
        rows.append((None if i % 9 == 0 else int(rng.integers(0, 3)), int(rng.integers(0, 40)), None if i % 11 == 0 else float(rng.integers(1, 3)), a, a + timedelta(seconds=length - (2 * length if i % 50 == 7 else 0))))
    rows.append((1, 5, 1.0, begin, None))
    jobs = spark.createDataFrame(rows, "h long, j long, c double, a timestamp_ntz, b timestamp_ntz")
    limit = 1300 * unit / 3600
    want = master.job_context(master.expand_jobs(jobs, "a", "b", step, limit), ["h", "ts"], "j", "c")
    got = master.job_contexts(jobs, ["h"], "j", "c", "a", "b", step, limit)
    assert got.columns == ["h", "ts", *want.columns[2:]] and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("active_job_count > 3").count() > 100


def shuffled_rows(spark, df) -> int:
    """Rows that the exchanges of a query write."""
    found, rest = 0, [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        if node.nodeName().startswith("Exchange"):
            found += node.metrics().apply("shuffleRecordsWritten").value()
        rest += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["cpu_share_merge", "job_context_per_bucket"])
def test_jobs_are_shuffled_before_they_are_expanded(spark, few_jobs, name):
    d, tasks = few_jobs
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.queries()[name](spark, d)
        df.collect()
        assert 0 < shuffled_rows(spark, df) <= 3 * len(tasks)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_isolation_threshold_covers_all_rows(spark):
    from pulsegrid.operators import learn

    rng = np.random.default_rng(0)
    n = 25_001
    df = spark.createDataFrame(pd.DataFrame({"i": range(n), "h": "a", "x": rng.normal(size=n), "y": rng.normal(size=n)}))
    raw = learn.isolation_scores(df, ["x", "y"], "i", "h", 0.02).select("if_raw").toPandas()["if_raw"]
    assert len(raw) == n and np.quantile(raw, 0.02) == pytest.approx(0, abs=1e-12)
    assert learn.TREES == 200
    draws = learn._draws(df, ["x", "y"], "i")
    assert [len(d) for d in draws] == [learn.SUBSAMPLE] * 200
    assert len(np.unique(np.concatenate(draws), axis=0)) > 20_000


def test_isolation_of_few_rows(spark):
    from pulsegrid.operators import learn

    df = spark.createDataFrame([(i, "a", float(x), 1.0) for i, x in enumerate([0, 1, 2, 3, 90])], "i long, h string, x double, y double")
    out = {r.i: r for r in learn.isolation_scores(df, ["x", "y"], "i", "h", 0.2).collect()}
    assert out[4].if_is_anomaly and out[4].if_anomaly_score == 1 and not any(out[i].if_is_anomaly for i in range(4))
    assert learn.isolation_scores(df.where("i < 0"), ["x", "y"], "i", "h").count() == 0


def test_rolling_goes_on_over_months(spark, tmp_path):
    """Hourly rows around the ends of months, and around those of the stretches that the window is dealt by."""
    from pulsegrid.operators import detectors

    rng = np.random.default_rng(1)
    times = pd.date_range("2024-01-20", "2024-04-10", freq="h")[rng.random(1945) < 0.9]
    series = pd.Series(rng.normal(size=len(times)), times)
    want = series.rolling("6h", min_periods=5).median().fillna(series.expanding().median())
    df = spark.createDataFrame(pd.DataFrame({"h": "a", "ts": times, "v": series.to_numpy()})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = detectors.fleet_relative(df, "h", "ts", "v", 6).toPandas().set_index("ts").sort_index()
    assert len(got) == len(series) and np.allclose(got["fleet_level"], want)

    events = spark.createDataFrame(
        pd.DataFrame({"event_id": range(1, len(times) + 1), "ts": times, "user_id": 1, "event_type": "view", "value": rng.uniform(0, 75, len(times))})
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    value = events.toPandas().set_index("ts").sort_index()
    roll = ((value["value"] > 50) & (value["event_id"] % 17 != 0)).astype(float).rolling("6h", min_periods=1).mean()
    hot = roll[roll >= 0.3].reset_index()
    hot.columns = ["ts", "roll"]
    episode = (hot["ts"].diff() > pd.Timedelta("1h")).cumsum()
    want = hot.groupby(episode).agg(a=("ts", "min"), b=("ts", "max"), peak=("roll", "max"), n=("ts", "size"))
    want = want.round({"peak": 6}).sort_values(["peak", "a"], ascending=[False, True]).head(20)
    found = [tuple(r) for r in catalog.queries()["suspicious_periods"](spark, str(tmp_path)).collect()]
    assert found == [(a.to_pydatetime(), b.to_pydatetime(), p, n) for a, b, p, n in want.itertuples(index=False)]


def test_kmeans_finds_twelve_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = 100 * np.eye(12)
    rows = [(i, (centres[i % 12] + rng.normal(size=12)).tolist()) for i in range(360)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.queries()["kmeans_fit"](spark, str(tmp_path)).select("cluster_id").distinct().count() == 12
