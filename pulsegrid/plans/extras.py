"""Queries: labels of episodes, threshold choice, job context, windows of scores, file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import detectors, evaluation, fusion, learn, narrative
from pulsegrid.operators import jobs as job_ops
from pulsegrid.plans.base import BY, ORDER, G, J, T, W, query, r
from pulsegrid.plans.events import _EP, _GW, _SC, _VB, _episodes, _scored
from pulsegrid.plans.signals import rows
from pulsegrid.sources import files
from pulsegrid.sources.adapters import job_states, jobs, table, truth
from pulsegrid.sources.shared import shared_folder

NTZ = "timestamp_ntz"


@query("WITH p AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.95) AS lim FROM orders GROUP BY 1) SELECT o_orderkey, ROUND(o_totalprice - lim, 6) AS excess FROM orders JOIN p USING (o_orderpriority) WHERE o_totalprice > lim")
def theta_excess(spark, d):
    o = table(spark, d, "orders")
    limit = o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.95).alias("lim"))
    return o.join(F.broadcast(limit), "o_orderpriority").where("o_totalprice > lim").select("o_orderkey", r(F.col("o_totalprice") - F.col("lim")).alias("excess"))


_FEED = f"{G.replace('g AS', 'g0 AS')}, g AS (SELECT gt_id, CASE WHEN gt_id % 9 = 0 THEN 'pdu-' || CAST(gt_id % 10 AS VARCHAR) || '-1' ELSE hostname END AS hostname, category, event_start, event_end FROM g0)"


@query(_EP + f", {_FEED}, {_GW} SELECT e.hostname, episode_start, episode_end, bool_or(COALESCE(gw.hostname = e.hostname OR gw.hostname = '*' OR TRY_CAST(regexp_extract(gw.hostname, '^pdu-([0-9]+)', 1) AS INTEGER) = CAST(split_part(e.hostname, '-', 2) AS INTEGER), FALSE)) AS label FROM eps e LEFT JOIN gw ON episode_start <= we AND episode_end >= ws GROUP BY ALL")
def label_episodes(spark, d):
    g = truth(spark, d)
    g = g.withColumn("hostname", F.when(F.col("gt_id") % 9 == 0, F.concat(F.lit("pdu-"), (F.col("gt_id") % 10).cast("string"), F.lit("-1"))).otherwise(F.col("hostname")))
    e = _episodes(spark, d).select("hostname", "episode_start", "episode_end").withColumn("rack_id", F.split("hostname", "-")[1].cast("int"))
    return evaluation.label_episodes(e, g, "hostname", "rack_id").drop("rack_id")


_GRID = [0.02, 0.05, 0.1, 0.2, 0.3, 0.4]
_GSQL = f"WITH {_SC}, p AS (SELECT s / 200 AS prob, y FROM sc), t AS (SELECT unnest({_GRID})::DOUBLE AS t), q AS (SELECT t, COUNT(*) FILTER (y) / COUNT(*) AS pr, COUNT(*) FILTER (y) / (SELECT COUNT(*) FROM p WHERE y) AS rc FROM p JOIN t ON prob >= t GROUP BY t), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) END AS f1 FROM q)"


def _grid(spark, d):
    return evaluation.threshold_grid(_scored(spark, d).withColumn("prob", F.col("s") / 200), "prob", "y", _GRID)


@query(_GSQL + " SELECT (SELECT t FROM f ORDER BY COALESCE(f1, 0) DESC, t LIMIT 1) AS best_f1, (SELECT t FROM f WHERE pr >= 0.05 ORDER BY rc DESC, t LIMIT 1) AS for_precision, (SELECT t FROM f WHERE rc >= 0.3 ORDER BY pr DESC, t LIMIT 1) AS for_recall")
def threshold_choice(spark, d):
    g = _grid(spark, d)
    picks = [evaluation.pick_threshold(g, "f1"), evaluation.pick_threshold(g, "precision", 0.05), evaluation.pick_threshold(g, "recall", 0.3)]
    a, b, c = (p.withColumnRenamed("t", n) for p, n in zip(picks, ("best_f1", "for_precision", "for_recall"), strict=True))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k", "left").join(c.withColumn("k", F.lit(1)), "k", "left").drop("k")


@query(_GSQL + ", m AS (SELECT list(t ORDER BY t) AS l FROM f WHERE f1 >= (SELECT MAX(f1) FROM f) - 0.05) SELECT l[CAST(floor((len(l) - 1) / 2) + 1 AS INTEGER)] AS t FROM m")
def threshold_plateau(spark, d):
    return evaluation.plateau_threshold(_grid(spark, d), None, 0.05)


@query("SELECT p_brand AS platform, CASE WHEN p_size % 2 = 0 THEN 'fan_rpm' ELSE 'power' END AS metric, CASE WHEN p_size % 2 <> 0 THEN ROUND(1.05 * MAX(p_retailprice), 6) END AS high, CASE WHEN p_size % 2 = 0 AND MIN(p_retailprice) > 100 THEN ROUND(greatest(0.9 * MIN(p_retailprice), 500.0), 6) END AS low FROM part GROUP BY p_brand, p_size % 2")
def dynamic_limits(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("platform"), F.when(F.col("p_size") % 2 == 0, "fan_rpm").otherwise("power").alias("metric"), F.col("p_retailprice").alias("p99"), F.col("p_retailprice").alias("p001"))
    return detectors.dynamic_limits(p, "platform", "metric").select("platform", "metric", r("high").alias("high"), r("low").alias("low"))


@query(f"WITH {T}, s AS (SELECT *, value / 100 AS x, lag(value / 100) OVER ({W}) AS b, lead(value / 100) OVER ({W}) AS a FROM t), m AS (SELECT *, CASE WHEN x > 0.3 AND COALESCE(b, 0) <= 0.3 AND COALESCE(a, 0) <= 0.3 THEN COALESCE((b + a) / 2, b, a, x) ELSE x END AS smooth FROM s) SELECT event_id, ROUND(smooth, 6) AS smooth, MAX(COALESCE(smooth > 0.7, FALSE)::INT) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS excluded FROM m")
def smooth_isolated(spark, d):
    out = detectors.smooth_isolated(rows(spark, d).withColumn("x", F.col("value") / 100), "x", BY, ORDER)
    return out.select("event_id", r("smooth").alias("smooth"), "excluded")


@query(f"WITH {T}, o AS (SELECT hostname, row_number() OVER ({W}) AS i, COALESCE(value, 0.0) AS x FROM t), w AS (SELECT hostname, i AS e, AVG(x) OVER (PARTITION BY hostname ORDER BY i ROWS 9 PRECEDING) AS sc FROM o), k AS (SELECT hostname, sc, unnest(generate_series(e - 9, e)) AS row FROM w WHERE e >= 10 AND (e - 10) % 5 = 0) SELECT hostname, row, ROUND(AVG(sc), 6) AS score FROM k GROUP BY ALL")
def window_scores_to_rows(spark, d):
    w = learn.sliding_windows(rows(spark, d), BY, ORDER, "value", 10, 5)
    scored = w.withColumn("score", F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 10)
    return detectors.spread_window_scores(scored, BY, "end_row", "score", 10).withColumn("score", r("score"))


@query(f"WITH {T}, q AS (SELECT *, AVG(COALESCE(value > 50, FALSE)::INT) OVER (PARTITION BY hostname) AS rate FROM t), n AS (SELECT *, AVG((value > 50)::INT) OVER (PARTITION BY hostname) AS rt FROM t) SELECT event_id, COALESCE(CASE WHEN rt > 0.20 THEN FALSE WHEN rt > 0.15 THEN value > 70 ELSE value > 50 END, FALSE) AS is_anomaly FROM n")
def collapse_rule(spark, d):
    return detectors.collapse_rule(rows(spark, d), "hostname", "value", 50.0, 70.0).select("event_id", "is_anomaly")


@query("SELECT l_suppkey, date_trunc('month', l_shipdate) AS ts, first(l_orderkey ORDER BY l_quantity DESC, l_orderkey) AS dominant_job FROM lineitem GROUP BY ALL")
def dominant_job(spark, d):
    li = table(spark, d, "lineitem").withColumn("ts", F.date_trunc("month", "l_shipdate").cast(NTZ))
    return job_ops.dominant_job(li, ["l_suppkey", "ts"], "l_orderkey", "l_quantity")


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 < 2 AND (o_orderstatus = 'F' OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) THEN 'JOB_OVER_EXPECTATION' ELSE ['AMBIGUOUS','JOB_EXPLAINED','INFRA_FAULT'][CAST(o_orderkey % 3 + 1 AS INTEGER)] END AS context FROM orders")
def failed_job_override(spark, d):
    c = F.element_at(F.array(*[F.lit(x) for x in ("AMBIGUOUS", "JOB_EXPLAINED", "INFRA_FAULT")]), (F.col("job_id") % 3 + 1).cast("int"))
    state = F.when(F.col("job_id") % 11 == 0, "CANCELLED").otherwise(F.col("job_state"))
    code = F.when(F.col("job_id") % 13 == 0, "1:0").when(F.col("job_id") % 2 == 0, "0:0")
    return job_states(spark, d).select("job_id", job_ops.failed_override(c, state, code).alias("context"))


@query(f"WITH {T}, x AS (SELECT DISTINCT t.event_id FROM t JOIN t e ON e.hostname = t.hostname AND e.sensor = 'error' AND e.value > 50 AND t.ts BETWEEN e.ts - INTERVAL 600 MINUTE AND e.ts) SELECT event_id, event_id IN (SELECT event_id FROM x) AS oom_window FROM t")
def oom_windows(spark, d):
    e = rows(spark, d).where("sensor = 'error' and value > 50").select("hostname", F.col("ts").alias("end"))
    return job_ops.oom_windows(rows(spark, d), e, ["hostname"], "ts", "end", 600).select("event_id", "oom_window")


@query(f"WITH {T} SELECT event_id, ROUND(CASE WHEN MIN(COALESCE(value > 20, FALSE)::INT) OVER w = 1 AND COUNT(*) OVER w = 3 THEN greatest(COALESCE(value, 0) / 100, 0.8) ELSE COALESCE(value, 0) / 100 END, 6) AS s FROM t WINDOW w AS ({W} ROWS 2 PRECEDING)")
def sustained_lift(spark, d):
    df = rows(spark, d).withColumn("s", F.coalesce(F.col("value"), F.lit(0.0)) / 100)
    return fusion.sustained(df, F.col("value") > 20, "s", BY, ORDER).select("event_id", r("s").alias("s"))


@query(_EP + ", i AS (SELECT eps.hostname, episode_start, episode_end, sensor, t.value FROM eps JOIN t ON t.hostname = eps.hostname AND t.ts BETWEEN episode_start AND episode_end), cn AS (SELECT hostname, episode_start, episode_end, sensor, COUNT(*) AS n FROM i GROUP BY ALL), m AS (SELECT hostname, episode_start, episode_end, first(sensor ORDER BY n DESC, sensor) AS sensor FROM cn GROUP BY ALL), ag AS (SELECT hostname, episode_start, episode_end, COALESCE(bool_or(value > 60), FALSE) AS high, COUNT(*) AS n_rows FROM i GROUP BY ALL) SELECT * FROM ag JOIN m USING (hostname, episode_start, episode_end)")
def episode_rule_summary(spark, d):
    f = rows(spark, d).withColumn("high", F.col("value") > 60)
    return fusion.rule_summary(_episodes(spark, d), f, BY, "ts", ["high"], ["sensor"])


@query(f"WITH {_VB} SELECT CAST(n AS BIGINT) AS n_votes, COUNT(*) AS n FROM (SELECT vote_thr::BIGINT + vote_phys::BIGINT AS n FROM v) GROUP BY n")
def vote_bins(spark, d):
    f = rows(spark, d).withColumns({"thr": F.col("value") > 50, "phys": F.col("event_id") % 3 == 0})
    return fusion.vote_bins(f, "hostname", "ts", {"thr": 1.0, "phys": 2.0}, 720).groupBy("n_votes").agg(F.count("*").alias("n"))


@query(f"WITH {T}, {G}, {_GW}, al AS (SELECT event_id, hostname, ts AS a, ts + INTERVAL 15 MINUTE AS b, value AS p, ['thermal','power','network'][CAST(event_id % 3 + 1 AS INTEGER)] AS kind FROM t WHERE value > 90), pairs AS (SELECT gt_id, category, p, kind FROM al JOIN gw ON (gw.hostname = al.hostname OR gw.hostname = '*') AND a <= we AND b >= ws) SELECT gt_id, category, first(kind ORDER BY p DESC, kind DESC) AS predicted, bool_or(kind = category) AS lenient, first(kind ORDER BY p DESC, kind DESC) = category AS strict FROM pairs GROUP BY gt_id, category")
def type_attribution(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("thermal", "power", "network")]), (F.col("event_id") % 3 + 1).cast("int"))
    a = rows(spark, d).where("value > 90").select("event_id", "hostname", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL '15' MINUTE")).alias("b"), F.col("value").alias("p"), kind.alias("kind"))
    return evaluation.type_attribution(a, truth(spark, d), "hostname", ("a", "b"), "p", "kind")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_roundtrip(spark, d):
    where = shared_folder(spark, "csv")
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    joined = n.join(F.broadcast(g), n.n_regionkey == g.r_regionkey).select("n_nationkey", "n_name", "r_name")
    joined.write.option("header", True).csv(where)
    return files.read_csv(spark, where, "n_nationkey bigint, n_name string, r_name string")


@query(f"WITH {J}, s AS (SELECT job_id, host_id, MIN(start_time) AS a, MAX(end_time) AS b, SUM(power) AS p FROM j GROUP BY ALL) SELECT host_id, COUNT(*) AS n_jobs, ROUND(AVG(epoch_us(b) - epoch_us(a)) / 6e7, 4) AS mean_minutes, ROUND(SUM(p), 2) AS power FROM s GROUP BY host_id")
def job_segments(spark, d):
    s = jobs(spark, d).groupBy("job_id", "host_id").agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"), F.sum("power").alias("p"))
    minutes = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 6e7
    return s.groupBy("host_id").agg(F.count("*").alias("n_jobs"), r(F.avg(minutes), 4).alias("mean_minutes"), r(F.sum("p"), 2).alias("power"))


_DUR = "CASE WHEN {m} < 120 THEN CAST(CAST(ROUND({m}) AS BIGINT) AS VARCHAR) || ' min' WHEN {m} < 2880 THEN printf('%.1f', ROUND({m} / 60.0 + 1e-9, 1)) || ' h' ELSE printf('%.1f', ROUND({m} / 1440.0 + 1e-9, 1)) || ' days' END"


@query(f"WITH {T}, a AS (SELECT event_id, hostname, rack_id, value, (event_id % 6)::INTEGER AS fam, CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'CANDIDATE' ELSE 'NONE' END AS tier, (event_id % 4000)::DOUBLE AS m FROM t) SELECT event_id, 'Host ' || hostname || ' in rack ' || CAST(rack_id AS VARCHAR) AS target, CASE tier WHEN 'CRITICAL' THEN 'Act within 15 minutes.' WHEN 'CONFIRMED' THEN 'Act within two hours.' WHEN 'CANDIDATE' THEN 'Review during the shift.' END AS severity, CASE WHEN fam >= 1 THEN CAST(fam AS VARCHAR) || ' sensor famil' || CASE WHEN fam = 1 THEN 'y is' ELSE 'ies are' END || ' silent.' END AS families, CASE WHEN fam >= 4 THEN 'Check the management controller of ' || hostname || '.' WHEN fam >= 2 THEN 'Check the sensor links of ' || hostname || '.' END AS hint, 'A similar alert came ' || {_DUR.format(m='m')} || ' before.' AS cooldown FROM a")
def alert_clauses(spark, d):
    e = F.col("event_id")
    tier = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "CONFIRMED", "CANDIDATE", "NONE")]), (e % 4 + 1).cast("int"))
    n = (e % 6).cast("int")
    return rows(spark, d).select(
        "event_id", narrative.target(F.col("hostname"), F.col("rack_id")).alias("target"), narrative.severity(tier).alias("severity"), narrative.families(n).alias("families"),
        narrative.controller(n, F.col("hostname")).alias("hint"), narrative.cooldown((e % 4000).cast("double")).alias("cooldown"),
    )


@query("WITH a AS (SELECT l_orderkey AS job, list(l_linenumber ORDER BY l_linenumber) AS l FROM lineitem GROUP BY 1) SELECT job, 'Running jobs: ' || array_to_string(l[1:4], ', ') || CASE WHEN len(l) > 4 THEN ' and ' || CAST(len(l) - 4 AS VARCHAR) || ' more' ELSE '' END || '.' AS jobs FROM a")
def jobs_sentence(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    return a.select("job", narrative.jobs(F.col("l")).alias("jobs"))


@query("WITH a AS (SELECT event_id, (event_id % 90) / 10.0 AS p, (event_id % 70) / 10.0 AS q, (event_id % 3)::INTEGER AS v FROM events), w AS (SELECT *, CASE WHEN greatest(p, q) >= 8 THEN 'severe' WHEN greatest(p, q) >= 5 THEN 'anomalous' WHEN greatest(p, q) >= 3 THEN 'raised' END AS word FROM a) SELECT event_id, concat_ws(' ', CASE WHEN word IS NOT NULL THEN CASE WHEN q > p THEN 'Thermal' ELSE 'Power' END || ' residual is ' || word || '.' END, CASE WHEN v > 0 THEN CAST(v AS VARCHAR) || ' constraints are violated.' END) AS physics FROM w")
def physics_sentence(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", narrative.physics((e % 90) / 10, (e % 70) / 10, e % 3).alias("physics"))


@query(f"WITH {T}, f AS (SELECT hostname, MIN(ts) AS f FROM t GROUP BY 1), n AS (SELECT t.hostname, sensor, rack_id FROM t JOIN f USING (hostname) WHERE ts <= f + INTERVAL 2880 MINUTE) SELECT hostname, array_to_string(list_sort(list(DISTINCT sensor)), ', ') AS channels, array_to_string(list_sort(list(DISTINCT 'r' || CAST(rack_id AS VARCHAR))), '|') AS rules FROM n GROUP BY hostname")
def culprit_channels(spark, d):
    f = rows(spark, d).withColumn("rule", F.concat(F.lit("r"), F.col("rack_id").cast("string")))
    return narrative.culprits(f, ["hostname"], "rule", "sensor", "ts", 2880)


@query(f"WITH {T}, p AS (SELECT hostname, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'pre' ELSE 'epi' END AS phase, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN value ELSE 5.0 END AS b FROM t), l AS (SELECT hostname, phase, 'a' AS channel, a AS x FROM p UNION ALL SELECT hostname, phase, 'b', b FROM p) SELECT hostname, channel, COALESCE(stddev_pop(x) FILTER (phase = 'epi') < 1e-6 AND stddev_pop(x) FILTER (phase = 'pre') > 1e-3, FALSE) AS flatline, COALESCE(AVG((x IS NULL)::INT) FILTER (phase = 'epi') > 0.5, FALSE) AS dropout FROM l GROUP BY ALL")
def faulty_channels(spark, d):
    pre = F.col("ts") < F.lit("2024-01-15 00:00:00").cast(NTZ)
    p = rows(spark, d).select("hostname", F.when(pre, "pre").otherwise("epi").alias("phase"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("a"), F.when(pre, F.col("value")).otherwise(5.0).alias("b"))
    return narrative.faulty_channels(p, ["hostname"], ["a", "b"], "phase")


@query(f"WITH {T}, al AS (SELECT event_id // 5 AS alert, hostname, date_trunc('hour', ts) AS hour, event_id % 10 / 10.0 AS conf FROM t WHERE value > 30), cx AS (SELECT hostname, date_trunc('hour', ts) AS hour, CASE MIN(event_id) % 5 WHEN 0 THEN 'INFRA_FAULT' WHEN 1 THEN 'COOLING_FAULT' WHEN 2 THEN 'JOB_OVER_EXPECTATION' WHEN 3 THEN 'AMBIGUOUS' ELSE '' END AS ctx FROM t GROUP BY ALL), p AS (SELECT alert, hostname, conf, NULLIF(ctx, '') AS ctx, CASE ctx WHEN 'INFRA_FAULT' THEN 3 WHEN 'COOLING_FAULT' THEN 2 WHEN 'JOB_OVER_EXPECTATION' THEN 1 ELSE 0 END AS pri FROM al LEFT JOIN cx USING (hostname, hour)), b AS (SELECT alert, MAX(conf) AS conf, first(ctx ORDER BY pri DESC, hostname) FILTER (ctx IS NOT NULL) AS context FROM p GROUP BY alert) SELECT alert, context, ROUND(CASE WHEN context IN ('INFRA_FAULT', 'COOLING_FAULT') THEN greatest(conf - 0.15, 0) WHEN context = 'JOB_OVER_EXPECTATION' THEN least(conf + 0.15, 1) ELSE conf END, 6) AS conf FROM b")
def enrich_alerts(spark, d):
    hour = F.date_trunc("hour", "ts").cast(NTZ).alias("hour")
    al = rows(spark, d).where("value > 30").select(F.floor(F.col("event_id") / 5).alias("alert"), "hostname", hour, (F.col("event_id") % 10 / 10).alias("conf"))
    n = F.min("event_id") % 5
    ctx = F.when(n == 0, "INFRA_FAULT").when(n == 1, "COOLING_FAULT").when(n == 2, "JOB_OVER_EXPECTATION").when(n == 3, "AMBIGUOUS").otherwise("")
    cx = rows(spark, d).groupBy("hostname", hour).agg(ctx.alias("ctx"))
    return job_ops.enrich(al, cx, "hostname", "hour", "alert", "ctx", "conf").select("alert", "context", r("conf").alias("conf"))


def _profiles(spark, d):
    names = ("view", "click", "purchase", "error")
    pivoted = rows(spark, d).groupBy("hostname").agg(*[F.coalesce(F.avg(F.when(F.col("sensor") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in names], F.count("*").alias("n"))
    return pivoted, names


@query()
def boosted_scores(spark, d):
    """Gradient-boosted trees: whether a host's error mean is over 25, from its other means. Learned, so without SQL."""
    p, names = _profiles(spark, d)
    p = p.withColumn("y", (F.col("error") > 25).cast("int"))
    return learn.boosted_trees(p, p, list(names[:3]), "y", 3, 5).select("hostname", "y", r("prob").alias("prob"))


@query()
def merged_clusters(spark, d):
    """k-means clusters of host profiles, those under five members merged into the nearest other. Learned, so without SQL."""
    p, names = _profiles(spark, d)
    vectors = p.select("hostname", F.array(*names).alias("v"))
    assigned, model = learn.kmeans(vectors, "v")
    centroids = {i: [float(x) for x in c] for i, c in enumerate(model.clusterCenters())}
    return job_ops.merge_small(assigned, "v", "cluster_id", centroids, 5).select("hostname", "cluster_id")
