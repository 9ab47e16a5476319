"""Queries: phase-1 reports, job operators, physics, fusion, evaluation, alerts, injection, streams, extras."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import windows as W_
from pulsegrid.operators import alerts, evaluation, fusion, inject, joins, learn, master, physics
from pulsegrid.operators import jobs as job_ops
from pulsegrid.plans.base import BY, ORDER, TRAIN_END, VAL_END, G, J, T, W, query, r
from pulsegrid.plans.signals import _runs, rows
from pulsegrid.sources.adapters import job_states, jobs, table, truth
from pulsegrid.sources.shared import shared_folder
from pulsegrid.streaming import live

NTZ = "timestamp_ntz"
def _train():
    return F.col("ts") <= F.lit(TRAIN_END).cast(NTZ)


_TRAIN = f"ts <= TIMESTAMP '{TRAIN_END}'"
_MIN = "(epoch_us({b}) - epoch_us({a})) / 6e7"


# Phase-1 report


@query(f"WITH {T}, f AS (SELECT *, COALESCE(value > 60, FALSE) AS fl, {_TRAIN} AS tr FROM t) SELECT sensor, COUNT(*) AS n, ROUND(AVG(fl::INT), 6) AS rate, ROUND(AVG(CASE WHEN tr THEN fl::INT END), 6) AS rate_train, ROUND(AVG(CASE WHEN NOT tr THEN fl::INT END), 6) AS rate_later FROM f GROUP BY sensor")
def alert_rates(spark, d):
    f = rows(spark, d).withColumn("fl", F.coalesce(F.col("value") > 60, F.lit(False)).cast("double"))
    return f.groupBy("sensor").agg(F.count("*").alias("n"), r(F.avg("fl")).alias("rate"), r(F.avg(F.when(_train(), F.col("fl")))).alias("rate_train"), r(F.avg(F.when(~_train(), F.col("fl")))).alias("rate_later"))


@query(f"WITH {T}, f AS (SELECT COALESCE(value > 50, FALSE) AS a, COALESCE(event_id % 3 = 0, FALSE) AS b FROM t) SELECT COUNT(*) FILTER (a AND b) AS both, COUNT(*) FILTER (a AND NOT b) AS only_a, COUNT(*) FILTER (NOT a AND b) AS only_b, COUNT(*) FILTER (NOT a AND NOT b) AS neither, ROUND(AVG((a = b)::INT), 6) AS agree FROM f")
def agreement_matrix(spark, d):
    f = rows(spark, d).select((F.col("value") > 50).alias("a"), (F.col("event_id") % 3 == 0).alias("b"))
    return evaluation.agreement(f, "a", "b").withColumn("agree", r("agree"))


@query(f"WITH {T}, h AS (SELECT date_trunc('hour', ts) AS ts, AVG(COALESCE(value > 50, FALSE)::INT) AS frac FROM t GROUP BY 1), m AS (SELECT ts, frac, AVG(frac) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS roll FROM h), k AS (SELECT *, roll >= 0.3 AS z FROM m), a AS (SELECT * FROM k WHERE z), b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) <= 3600000000 THEN 0 ELSE 1 END AS c FROM a), s AS (SELECT *, SUM(c) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM b) SELECT MIN(ts) AS period_start, MAX(ts) AS period_end, ROUND(MAX(roll), 6) AS peak, COUNT(*) AS hours FROM s GROUP BY p ORDER BY peak DESC, period_start LIMIT 20")
def suspicious_periods(spark, d):
    h = rows(spark, d).groupBy(F.date_trunc("hour", "ts").cast(NTZ).alias("ts")).agg(F.avg(F.coalesce(F.col("value") > 50, F.lit(False)).cast("double")).alias("frac"))
    h = W_.with_lead(h.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "us", 6 * 3_600_000_000)
    roll = F.avg("frac").over(Window.partitionBy("_part").orderBy("us").rangeBetween(-(6 * 3_600_000_000 - 1), 0))
    hot = h.withColumn("roll", roll).where("_own and roll >= 0.3").withColumn("k", F.lit(0)).select("k", "ts", "roll")
    s = fusion.sessions(hot, ["k"], "ts", 60)
    peaks = joins.point_in_interval(hot, s.drop("n_rows"), ["k"], "ts", "episode_start", "episode_end", True, 86400)
    out = peaks.groupBy("episode_start", "episode_end").agg(r(F.max("roll")).alias("peak"), F.count("*").alias("hours"))
    return out.select(F.col("episode_start").alias("period_start"), F.col("episode_end").alias("period_end"), "peak", "hours").orderBy(F.desc("peak"), "period_start").limit(20)


@query(f"WITH {T}, dd AS (SELECT hostname, date_trunc('day', ts) AS day, COUNT(*) FILTER (value > 50) AS c FROM t GROUP BY ALL), b AS (SELECT hostname, first(day ORDER BY c DESC, day) AS busiest FROM dd GROUP BY 1), s AS (SELECT hostname, ROUND(AVG(COALESCE(value > 50, FALSE)::INT), 6) AS rate, ROUND(quantile_cont(value, 0.95), 6) AS p95, MAX(value) AS top FROM t GROUP BY 1) SELECT * FROM s JOIN b USING (hostname)")
def node_summary(spark, d):
    e = rows(spark, d)
    days = e.groupBy("hostname", F.date_trunc("day", "ts").cast(NTZ).alias("day")).agg(F.count_if(F.col("value") > 50).alias("c"))
    busiest = days.groupBy("hostname").agg(F.min_by("day", F.struct(-F.col("c"), F.col("day"))).alias("busiest"))
    s = e.groupBy("hostname").agg(r(F.avg(F.coalesce(F.col("value") > 50, F.lit(False)).cast("double"))).alias("rate"), r(F.percentile("value", 0.95)).alias("p95"), F.max("value").alias("top"))
    return s.join(busiest, "hostname")


@query(f"WITH {T}, a AS (SELECT hostname, value, lag(value) OVER ({W}) AS p FROM t) SELECT hostname, CASE WHEN COUNT(*) FILTER (value IS NOT NULL AND p IS NOT NULL) > 1 THEN ROUND(corr(value, p), 6) END AS autocorr FROM a GROUP BY hostname HAVING COUNT(*) FILTER (value IS NOT NULL AND p IS NOT NULL) > 2")
def autocorr_lag1(spark, d):
    e = rows(spark, d).withColumn("p", F.lag("value").over(W_.over(BY, ORDER)))
    enough = e.groupBy("hostname").agg(F.count_if(F.col("value").isNotNull() & F.col("p").isNotNull()).alias("n")).where("n > 2")
    return evaluation.autocorrelation(rows(spark, d), BY, ORDER, "value").join(enough, "hostname").select("hostname", r("autocorr").alias("autocorr"))


@query(f"WITH {T}, s AS (SELECT date_trunc('day', MIN(ts)) AS a, date_trunc('day', MAX(ts)) AS b, hostname FROM t GROUP BY hostname), c AS (SELECT hostname, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM s), v AS (SELECT hostname, date_trunc('day', ts) AS day, COUNT(*) AS n FROM t GROUP BY ALL) SELECT c.hostname, c.day, COALESCE(n, 0) AS n FROM c LEFT JOIN v USING (hostname, day)")
def resample_calendar(spark, d):
    days = rows(spark, d).withColumn("day", F.date_trunc("day", "ts").cast(NTZ))
    cal = master.calendar(days, ["hostname"], "day", "1 day")
    return cal.join(days.groupBy("hostname", "day").agg(F.count("*").alias("n")), ["hostname", "day"], "left").na.fill(0, ["n"])


@query(f"WITH {T} SELECT CAST(least(floor(value / 10), 9) AS BIGINT) AS bin, sensor, COUNT(*) AS n FROM t WHERE value IS NOT NULL GROUP BY ALL")
def score_histogram(spark, d):
    return rows(spark, d).where("value is not null").groupBy(F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("long").alias("bin"), "sensor").agg(F.count("*").alias("n"))


# Jobs


@query(f"WITH {T}, {J}, s AS (SELECT DISTINCT 'rpc-' || CAST(user_id % 10 AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) AS hostname, CAST(date_trunc('day', ts) AS TIMESTAMP) AS a FROM events WHERE event_type = 'error'), x AS (SELECT s.hostname, s.a, t.ts, t.value FROM s JOIN t ON t.hostname = s.hostname AND t.ts BETWEEN s.a AND s.a + INTERVAL 3 DAY) SELECT hostname, a, COUNT(*) AS n_rows, ROUND(AVG(value), 6) AS v_mean, ROUND(stddev_samp(value), 6) AS v_std, MAX(value) AS v_max, MIN(value) AS v_min, ROUND(quantile_cont(value, 0.95), 6) AS v_p95 FROM x GROUP BY ALL HAVING COUNT(*) >= 2")
def profile_segment(spark, d):
    s = rows(spark, d).where("sensor = 'error'").select("hostname", F.date_trunc("day", "ts").cast(NTZ).alias("a")).distinct().withColumn("b", F.col("a") + F.expr("INTERVAL '3' DAY"))
    p = job_ops.profile(s, rows(spark, d).select("hostname", "ts", "value"), ["hostname"], "a", "ts", "value", ("a", "b"))
    return p.select("hostname", "a", "n_rows", r("v_mean").alias("v_mean"), r("v_std").alias("v_std"), "v_max", "v_min", r("v_p95").alias("v_p95"))


@query("WITH p AS (SELECT l_orderkey AS job_id, COUNT(*) AS n, stddev_samp(l_quantity) / abs(AVG(l_quantity)) AS c1, stddev_samp(l_extendedprice) / abs(AVG(l_extendedprice)) AS c2 FROM lineitem GROUP BY 1 HAVING COUNT(*) >= 2) SELECT job_id, n AS n_runs, ROUND((c1 + c2) / 2, 6) AS mean_cv, ROUND(greatest(least(1 - (c1 + c2) / 2, 1), 0), 6) AS score FROM p")
def reproducibility_cv(spark, d):
    p = job_ops.reproducibility(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "job_id"), "job_id", ["l_quantity", "l_extendedprice"])
    return p.select("job_id", "n_runs", r("mean_cv").alias("mean_cv"), r("score").alias("score"))


@query("WITH d AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * x))) AS d0, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1) * (x::DOUBLE - 0.1)))) AS d1, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE + 0.1) * (x::DOUBLE + 0.1)))) AS d2 FROM embeddings) SELECT vec_id, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INTEGER) AS cluster_id, ROUND(least(d0, d1, d2), 6) AS cluster_dist FROM d")
def kmeans_assign_given_centroids(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select(F.size("embedding").alias("n")).first()["n"]
    out = job_ops.nearest_centroid(e.withColumn("v", F.col("embedding").cast("array<double>")), "v", [[x] * n for x in (0.0, 0.1, -0.1)])
    return out.select("vec_id", "cluster_id", r("cluster_dist").alias("cluster_dist"))


@query()
def kmeans_fit(spark, d):
    out, _ = learn.kmeans(table(spark, d, "embeddings"), "embedding")
    return out.select("vec_id", "cluster_id")


@query("WITH f AS (SELECT label AS job, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT job, k, quantile_cont(x, 0.5) AS m FROM f GROUP BY ALL), e AS (SELECT job, vec_id, sqrt(SUM((x - m) * (x - m))) AS dist FROM f JOIN m USING (job, k) GROUP BY ALL), c AS (SELECT job, quantile_cont(dist, 0.5) AS md, MAX(dist) AS mx, COUNT(*) AS n FROM e GROUP BY job HAVING COUNT(*) >= 2), q AS (SELECT job, quantile_cont(abs(dist - md), 0.5) AS mad FROM e JOIN c USING (job) GROUP BY job) SELECT vec_id, job, n AS n_peers, ROUND(dist, 6) AS dist, ROUND(CASE WHEN 1.4826 * mad > 1e-6 THEN (dist - md) / (1.4826 * mad) ELSE 0 END, 3) + 0.0 AS coherence_z, ROUND(CASE WHEN mx > 0 THEN dist / mx ELSE 0 END, 6) AS coherence_score FROM e JOIN c USING (job) JOIN q USING (job)")
def coherence_vector(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("job"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    c = job_ops.coherence(v, ["job"], "vec_id", "v")
    return c.select("vec_id", "job", "n_peers", r("dist").alias("dist"), r("coherence_z", 3).alias("coherence_z"), r("coherence_score").alias("coherence_score"))


@query("WITH b AS (SELECT l_suppkey AS host, date_trunc('month', l_shipdate) AS ts, l_suppkey % 5 AS job, SUM(l_extendedprice) AS p FROM lineitem GROUP BY ALL), w AS (SELECT *, COUNT(p) OVER k AS n, SUM(p) OVER k AS s, SUM(p * p) OVER k AS q FROM b WINDOW k AS (PARTITION BY ts, job)), z AS (SELECT *, (s - p) / (n - 1) AS peer_mean FROM w WHERE n >= 3) SELECT host, ts, n AS peer_count, ROUND(peer_mean, 2) AS peer_mean, ROUND((p - peer_mean) / NULLIF(sqrt(greatest((q - p * p) / (n - 1) - peer_mean * peer_mean, 0)), 0), 2) + 0.0 AS pwr_z FROM z")
def peer_loo_zscore(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("host"), F.date_trunc("month", "l_shipdate").cast(NTZ).alias("ts"), (F.col("l_suppkey") % 5).alias("job")).agg(F.sum("l_extendedprice").alias("p"))
    out = job_ops.peer_z(b, ["ts", "job"], "host", "p", ["ts"], ["host", "job"])
    return out.select("host", "ts", "peer_count", r("peer_mean", 2).alias("peer_mean"), r("pwr_z", 2).alias("pwr_z"))


@query(f"WITH {T} SELECT event_id, COUNT(value) OVER w AS run_n, ROUND(AVG(value) OVER w, 6) AS run_mean, ROUND(stddev_samp(value) OVER w, 6) AS run_std, MAX(value) OVER w AS run_max FROM t WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)")
def running_profile_replay(spark, d):
    out = job_ops.running_profile(rows(spark, d), BY, ORDER, "value")
    return out.select("event_id", "run_n", r("run_mean").alias("run_mean"), r("run_std").alias("run_std"), "run_max")


@query("WITH c AS (SELECT l_orderkey AS alert, l_linenumber AS job, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS power, l_tax AS onset, CASE WHEN l_orderkey % 3 = 0 THEN l_discount * 2 END AS cluster FROM lineitem), w AS (SELECT *, MAX((power IS NOT NULL)::INT) OVER k * 0.30 AS wp, 0.30 * MAX((onset IS NOT NULL)::INT) OVER k AS wo, MAX((cluster IS NOT NULL)::INT) OVER k * 0.25 AS wc FROM c WINDOW k AS (PARTITION BY alert)) SELECT alert, job, ROUND((wp * COALESCE(power, 0) + wo * COALESCE(onset, 0) + wc * COALESCE(cluster, 0)) / (wp + wo + wc), 6) AS score FROM w")
def attribution_rank(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_orderkey").alias("alert"), F.col("l_linenumber").alias("job"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("power"), F.col("l_tax").alias("onset"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_discount") * 2).alias("cluster"), F.lit(None).cast("double").alias("coherence"))
    return job_ops.attribute(c, ["alert"], "job").select("alert", "job", r("score").alias("score"))


@query("WITH s AS (SELECT l_orderkey AS job, CAST(l_suppkey AS VARCHAR) AS node, l_quantity > 40 AS f, l_discount AS x FROM lineitem), a AS (SELECT job, COALESCE(list_sort(list(DISTINCT node) FILTER (f)), []) AS an, list_sort(list(DISTINCT node)) AS al, MIN(x) AS score_min, MAX(x) AS score_max, ROUND(SUM(x), 6) AS score_sum, ROUND(AVG(x), 6) AS score_mean FROM s GROUP BY job) SELECT job, array_to_string(an, '|') AS anomalous_nodes, array_to_string(list_filter(al, lambda n: NOT list_contains(an, n)), '|') AS clean_nodes, score_min, score_max, score_sum, score_mean FROM a")
def multi_node_collect(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_suppkey").cast("string").alias("node"), (F.col("l_quantity") > 40).alias("f"), F.col("l_discount").alias("x"))
    return job_ops.per_job(s, "job", "node", "f", "x").withColumns({"score_sum": r("score_sum"), "score_mean": r("score_mean")})


# Physics


def _load(spark, d):
    return rows(spark, d).where("value is not null").select("event_id", "hostname", "ts", F.hour("ts").cast("double").alias("x"), (F.col("value") * 2 + F.hour("ts") * 3).alias("power"))


_L = f"{T}, l AS (SELECT event_id, hostname, ts, hour(ts)::DOUBLE AS x, value * 2 + hour(ts) * 3 AS power FROM t WHERE value IS NOT NULL), m AS (SELECT COUNT(*) AS n, AVG(x) AS mx, AVG(power) AS my, stddev_pop(x) AS sx, covar_pop(x, power) AS c FROM l WHERE {_TRAIN}), k AS (SELECT *, (c * n / sx) / (n + 1.0) / sx AS b FROM m), res AS (SELECT l.*, power - (my - b * mx + b * x) AS resid FROM l, k)"


@query(f"WITH {_L} SELECT event_id, ROUND(resid, 3) AS power_residual_w FROM res")
def ridge_power_closed_form(spark, d):
    df = _load(spark, d)
    coef, base = physics.ridge(df, ["x"], "power", _train())
    return physics.residual(df, coef, base, "power", "resid").select("event_id", r("resid", 3).alias("power_residual_w"))


@query(f"WITH {_L}, h AS (SELECT hostname, regr_slope(resid, x) AS s, regr_intercept(resid, x) AS i, COUNT(*) AS n FROM res WHERE {_TRAIN} GROUP BY hostname HAVING COUNT(*) >= 5) SELECT event_id, ROUND(resid - COALESCE(s * x + i, 0), 3) AS resid_adj FROM res LEFT JOIN h USING (hostname)")
def thermal_slope_correct(spark, d):
    df = _load(spark, d)
    coef, base = physics.ridge(df, ["x"], "power", _train())
    out = physics.slope_correction(physics.residual(df, coef, base, "power", "resid"), "hostname", "x", "resid", _train(), 5)
    return out.select("event_id", r("resid_adj", 3).alias("resid_adj"))


@query(f"WITH {_L}, h AS (SELECT hostname, AVG(resid) AS b, stddev_pop(resid) AS s FROM res WHERE {_TRAIN} GROUP BY hostname HAVING COUNT(*) >= 10), f AS (SELECT stddev_pop(resid) AS f FROM res WHERE {_TRAIN}) SELECT event_id, ROUND((resid - COALESCE(b, 0)) / greatest(COALESCE(s, f), 0.1), 3) + 0.0 AS resid_z FROM res LEFT JOIN h USING (hostname), f")
def host_bias_z(spark, d):
    df = _load(spark, d)
    coef, base = physics.ridge(df, ["x"], "power", _train())
    return physics.host_bias(physics.residual(df, coef, base, "power", "resid"), "hostname", "resid", _train(), 10).select("event_id", r("resid_z", 3).alias("resid_z"))


@query(f"WITH {T}, q AS (SELECT event_id, value, COUNT(value) OVER w AS n, (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) / 1.349 AS s FROM t WINDOW w AS ({W} ROWS 29 PRECEDING)) SELECT event_id, CASE WHEN value IS NOT NULL THEN ROUND(value / CASE WHEN n >= 10 THEN greatest(least(s, 50.0), 5.0) ELSE 10.0 END, 6) END AS z FROM q")
def adaptive_iqr_z(spark, d):
    return physics.adaptive_z(rows(spark, d), "value", BY, ORDER, 10.0, 30, 10, "z").select("event_id", r("z").alias("z"))


@query(f"WITH {T}, tr AS (SELECT DISTINCT hostname, ts FROM t WHERE sensor = 'error'), n AS (SELECT t.event_id, MIN(abs(epoch_us(t.ts) - epoch_us(tr.ts))) / 6e7 AS gap FROM t LEFT JOIN tr USING (hostname) GROUP BY t.event_id) SELECT event_id, ROUND(COALESCE(1 - exp(-least(gap, 20.0) / 5), 1.0), 6) AS job_transition_atten FROM n".replace("t.ts) - epoch_us(tr.ts)", "t.ts) - epoch_us(tr.ts)"))
def transition_attenuation(spark, d):
    marks = rows(spark, d).where("sensor = 'error'").select("hostname", "ts").distinct()
    return physics.transition_attenuation(rows(spark, d), marks, ["hostname"], "ts").select("event_id", r("job_transition_atten").alias("job_transition_atten"))


_IDLE = "sensor IN ('view','click')"


def _idle():
    return F.col("sensor").isin("view", "click")


@query(f"WITH {T}, f AS (SELECT *, value * 20 AS fan FROM t), m AS (SELECT *, lag(value, 5) OVER ({W}) AS p, quantile_cont(fan, 0.5) OVER (PARTITION BY hostname) AS med FROM f) SELECT event_id, COALESCE(value - p > 0.75 AND fan < 0.9 * med AND {_IDLE}, FALSE) AS const1 FROM m")
def c1_temp_fan(spark, d):
    df = rows(spark, d).withColumn("fan", F.col("value") * 20)
    return physics.temp_fan(df, "value", "fan", _idle(), BY, ORDER).select("event_id", "const1")


_RK = f"{T}, h AS (SELECT hostname, rack_id, date_trunc('day', ts) AS ts, AVG(value) AS v, bool_or({_IDLE}) AS idle FROM t GROUP BY ALL)"


def _daily(spark, d):
    return rows(spark, d).groupBy("hostname", "rack_id", F.date_trunc("day", "ts").cast(NTZ).alias("ts")).agg(F.avg("value").alias("v"), F.bool_or(_idle()).alias("idle"))


@query(f"WITH {_RK}, u AS (SELECT *, COALESCE(v - lag(v, 3) OVER (PARTITION BY hostname ORDER BY ts) > 1.5, FALSE) AS up FROM h), p AS (SELECT rack_id, ts, AVG((up AND idle)::INT) AS warm_share, SUM(v) AS pdu_sum FROM u GROUP BY ALL), b AS (SELECT *, lag(pdu_sum, 3) OVER (PARTITION BY rack_id ORDER BY ts) AS back FROM p) SELECT rack_id, ts, ROUND(warm_share, 6) AS warm_share, COALESCE(warm_share >= 0.3 AND abs(pdu_sum - back) < 0.5 * back, FALSE) AS const2 FROM b")
def c2_rack_thermal(spark, d):
    h = _daily(spark, d)
    pdu = h.groupBy("rack_id", "ts").agg(F.sum("v").alias("pdu_sum"))
    return physics.rack_thermal(h, pdu, ["rack_id", "ts"], "v", "idle", 3, 1.5, 0.3, 0.5).select("rack_id", "ts", r("warm_share").alias("warm_share"), "const2")


@query(f"WITH {T}, w AS (SELECT *, value * 5 AS p, lag(value * 5, 2) OVER k AS p1, lag(value * 5, 4) OVER k AS p2, lag(value, 2) OVER k AS t1, lag(value * 5, 1) OVER k AS ps, lag(value, 1) OVER k AS ts1 FROM t WINDOW k AS ({W})) SELECT event_id, COALESCE(p1 - p2 > 0.2 * p2 AND p1 - p2 > 30 AND value - t1 < 1.5, FALSE) OR COALESCE({_IDLE} AND abs(p - ps) < 20 AND value - ts1 > 1.5, FALSE) AS const3 FROM w")
def c3_dynamics(spark, d):
    df = rows(spark, d).withColumn("p", F.col("value") * 5)
    return physics.dynamics(df, "p", "value", _idle(), BY, ORDER, 2, stable=1).select("event_id", "const3")


@query("WITH b AS (SELECT s_nationkey AS rack, date_trunc('month', l_shipdate) AS ts, SUM(l_extendedprice) AS pdu, SUM(l_quantity * 100) AS hosts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), w AS (SELECT *, lag(pdu, 3) OVER k AS p3, lag(hosts, 3) OVER k AS h3 FROM b WINDOW k AS (PARTITION BY rack ORDER BY ts)) SELECT rack, ts, COALESCE(pdu - p3 > 0.15 * p3 AND pdu - p3 > 100 AND abs(hosts - h3) < 0.1 * h3 AND (pdu - p3) - (hosts - h3) > 50, FALSE) AS const4 FROM w")
def c4_crossplane(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("rack"))
    b = table(spark, d, "lineitem").join(s, "l_suppkey").groupBy("rack", F.date_trunc("month", "l_shipdate").cast(NTZ).alias("ts")).agg(F.sum("l_extendedprice").alias("pdu"), F.sum(F.col("l_quantity") * 100).alias("hosts"))
    return physics.crossplane(b, ["rack"], ["ts"], "pdu", "hosts", still=0.1).select("rack", "ts", "const4")


@query(f"WITH {T}, o AS (SELECT *, row_number() OVER ({W}) AS rn, sensor <> 'error' AS act, lag(sensor) OVER ({W}) AS ps FROM t), c AS (SELECT *, rn - MAX(CASE WHEN sensor IS DISTINCT FROM ps THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS since, MIN(act::INT) OVER f AS mn, COUNT(*) OVER f AS cf, CASE WHEN COUNT(value) OVER w >= 10 THEN MAX(value) OVER w END AS top FROM o WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), w AS ({W} ROWS 29 PRECEDING)) SELECT event_id, COALESCE(value < 0.85 * top AND value < 0.5 * top AND act AND since >= 0 AND mn = 1 AND cf = 2, FALSE) AS const5 FROM c")
def c5_alloc_idle(spark, d):
    out = physics.allocated_idle(rows(spark, d), "value", "value", F.col("sensor") != "error", "sensor", BY, ORDER, roll=30, c=0.5, grace=0, tail=2, run=1)
    return out.select("event_id", "const5")


@query("WITH f AS (SELECT event_id, event_id % 2 = 0 AS c1, event_id % 3 = 0 AS c2, event_id % 5 = 0 AS c3, event_id % 7 = 0 AS c4, event_id % 11 = 0 AS c5 FROM events) SELECT event_id, CAST(c1::INT + 2*c2::INT + 4*c3::INT + 8*c4::INT + 16*c5::INT AS INTEGER) AS constraint_mask, CAST(c1::INT + c2::INT + c3::INT + c4::INT + c5::INT AS INTEGER) AS n_constraints_violated, concat_ws('|', CASE WHEN c1 THEN 'TEMP_FAN' END, CASE WHEN c2 THEN 'RACK_THERMAL' END, CASE WHEN c3 THEN 'DYNAMICS' END, CASE WHEN c4 THEN 'CROSSPLANE' END, CASE WHEN c5 THEN 'ALLOC_IDLE' END) AS constraint_flags FROM f")
def constraint_flags(spark, d):
    e = table(spark, d, "events").select("event_id", *[(F.col("event_id") % p == 0).alias(f"c{i}") for i, p in enumerate((2, 3, 5, 7, 11))])
    return physics.constraint_flags(e, [f"c{i}" for i in range(5)]).select("event_id", "constraint_mask", "n_constraints_violated", "constraint_flags")


@query("""WITH f AS (SELECT event_id, value / 10 AS z, value > 40 AS pa, value / 12 AS tz, event_id % 3 = 0 AS ta, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'TEMP_FAN' WHEN 2 THEN 'DYNAMICS' WHEN 3 THEN 'CROSSPLANE' ELSE '' END AS fl, event_id % 4 AS jobs, CASE event_id % 3 WHEN 0 THEN 'ISOLATED' WHEN 1 THEN 'CLUSTER_WIDE' ELSE 'N/A' END AS iso, CASE WHEN event_id % 6 <> 0 THEN (event_id % 100)::DOUBLE END AS cpu, (event_id % 10) / 10.0 AS req, value AS act, 30.0 AS exp_ FROM events),
 w AS (SELECT *, COALESCE(jobs > 0 AND cpu >= 65, FALSE) OR COALESCE(jobs > 0 AND req >= 0.6 AND cpu IS NOT NULL, FALSE) AS works, ta AND NOT pa AS tonly FROM f)
 SELECT event_id, CASE WHEN jobs = 0 AND (pa OR ta OR fl <> '') THEN 'NO_JOBS' WHEN fl = 'CROSSPLANE' THEN 'MEASUREMENT_DISCREPANCY' WHEN iso = 'ISOLATED' AND pa AND NOT works THEN 'INFRA_FAULT' WHEN iso = 'CLUSTER_WIDE' AND works AND z < 4 THEN 'JOB_EXPLAINED' WHEN pa AND act > 1.4 * exp_ THEN 'JOB_OVER_EXPECTATION'
 WHEN tonly AND fl = 'TEMP_FAN' THEN 'COOLING_FAULT' WHEN tonly AND works AND tz < 5 THEN 'JOB_EXPLAINED' WHEN tonly AND works THEN 'AMBIGUOUS' WHEN tonly THEN 'COOLING_FAULT' WHEN fl = 'DYNAMICS' AND NOT ta THEN 'SENSOR_DRIFT' WHEN pa AND works AND z < 4 THEN 'JOB_EXPLAINED' WHEN pa AND works THEN 'AMBIGUOUS' WHEN pa AND (cpu IS NULL OR cpu < 65) THEN 'INFRA_FAULT' WHEN pa THEN 'AMBIGUOUS' WHEN fl = 'TEMP_FAN' THEN 'COOLING_FAULT' ELSE 'AMBIGUOUS' END AS context FROM w""")
def context_classify(spark, d):
    e = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (e % n + 1).cast("int"))
    context = physics.classify(F.col("value") / 10, F.col("value") > 40, F.col("value") / 12, e % 3 == 0, pick(5, "", "TEMP_FAN", "DYNAMICS", "CROSSPLANE", ""), e % 4, pick(3, "ISOLATED", "CLUSTER_WIDE", "N/A"), F.when(e % 6 != 0, (e % 100).cast("double")), (e % 10) / 10, F.col("value"), F.lit(30.0))
    return table(spark, d, "events").select("event_id", context.alias("context"))


# Fusion


_RZ = f"{T}, c AS (SELECT quantile_cont(value, 0.5) AS med, COUNT(value) AS n, stddev_samp(value) AS sd FROM t WHERE {_TRAIN} AND value IS NOT NULL), q AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM t, c WHERE {_TRAIN} AND value IS NOT NULL), z AS (SELECT t.*, CASE WHEN n < 30 THEN 0 ELSE COALESCE((value - med) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END, 0) END AS z FROM t, c, q)"


@query(f"WITH {_RZ} SELECT event_id, ROUND(z, 6) AS z FROM z")
def robust_z(spark, d):
    return W_.robust_z(rows(spark, d), "value", _train(), "z").select("event_id", r("z").alias("z"))


@query(f"WITH {_RZ}, s AS (SELECT event_id, greatest(least(z, 5), -5) AS a, CASE WHEN event_id % 2 = 0 THEN greatest(least(z * 2, 5), -5) ELSE 0 END AS b, (event_id % 7)::INT AS n FROM z) SELECT event_id, ROUND((a + b) / 2, 6) AS phase1, ROUND((greatest(least(a, 3), 0) / 3 + least(n / 5.0, 1)) / 2 * 0.5, 6) AS phase3 FROM s")
def phase_scores(spark, d):
    z = W_.robust_z(rows(spark, d), "value", _train(), "z").withColumn("b", F.when(F.col("event_id") % 2 == 0, F.col("z") * 2)).withColumn("n", (F.col("event_id") % 7).cast("int"))
    return z.select("event_id", r(fusion.phase_score(["z", "b"])).alias("phase1"), r(fusion.physics_score("z", "n", F.lit(None).cast("double"))).alias("phase3"))


@query(f"WITH {T}, a AS (SELECT hostname, date_trunc('hour', ts) AS ts, CASE WHEN bool_or(sensor = 'view') THEN 'cpu' END AS component, 0 AS m FROM t WHERE sensor IN ('view','click') GROUP BY ALL), b AS (SELECT hostname, date_trunc('hour', ts) AS ts, 'gpu' AS component, 1 AS m FROM t WHERE sensor IN ('error','click') GROUP BY ALL) SELECT COALESCE(a.hostname, b.hostname) AS hostname, COALESCE(a.ts, b.ts) AS ts, COALESCE(a.component, b.component) AS component, CAST(greatest(COALESCE(a.m, 0), COALESCE(b.m, 0)) AS INTEGER) AS maintenance FROM a FULL JOIN b ON a.hostname = b.hostname AND a.ts = b.ts")
def key_union(spark, d):
    hour = F.date_trunc("hour", "ts").cast(NTZ).alias("ts")
    a = rows(spark, d).where("sensor in ('view','click')").groupBy("hostname", hour).agg(F.when(F.bool_or(F.col("sensor") == "view"), "cpu").alias("component"), F.lit(0).alias("maintenance"))
    b = rows(spark, d).where("sensor in ('error','click')").groupBy("hostname", hour).agg(F.lit("gpu").alias("component"), F.lit(1).alias("maintenance"))
    return fusion.key_union([a, b], ["hostname", "ts"], ["component"], ["maintenance"])


_VB = f"{T}, f AS (SELECT event_id, hostname, floor(epoch_us(ts) / (720 * 60000000.0)) AS bin, value > 50 AS thr, event_id % 3 = 0 AS phys FROM t), v AS (SELECT event_id, COALESCE(bool_or(thr) OVER k, FALSE) AS vote_thr, COALESCE(bool_or(phys) OVER k, FALSE) AS vote_phys FROM f WINDOW k AS (PARTITION BY hostname, bin))"


@query(f"WITH {_VB} SELECT event_id, vote_thr, vote_phys, vote_thr::BIGINT + vote_phys::BIGINT AS n_votes, vote_thr::INT * 1.0::DOUBLE + vote_phys::INT * 2.0::DOUBLE AS weighted_votes FROM v")
def weighted_votes(spark, d):
    f = rows(spark, d).withColumns({"thr": F.col("value") > 50, "phys": F.col("event_id") % 3 == 0})
    return fusion.vote_bins(f, "hostname", "ts", {"thr": 1.0, "phys": 2.0}, 720).select("event_id", "vote_thr", "vote_phys", "n_votes", "weighted_votes")


_EP = _runs("value > 25") + f", g2 AS (SELECT *, row_number() OVER ({W}) AS rn FROM n), r1 AS (SELECT hostname, run, MIN(rn) AS s, MAX(rn) AS e, MIN(ts) AS ts0, MAX(ts) AS ts1, COUNT(*) AS k FROM g2 WHERE z AND len >= 2 GROUP BY ALL), r2 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY hostname ORDER BY s) > 10 THEN 1 WHEN lag(e) OVER (PARTITION BY hostname ORDER BY s) IS NULL THEN 1 ELSE 0 END AS f FROM r1), r3 AS (SELECT *, SUM(f) OVER (PARTITION BY hostname ORDER BY s ROWS UNBOUNDED PRECEDING) AS ep FROM r2), r4 AS (SELECT hostname, MIN(s) AS s, MAX(e) AS e, MIN(ts0) AS episode_start, MAX(ts1) AS episode_end, CAST(SUM(k) AS BIGINT) AS n_active FROM r3 GROUP BY hostname, ep), eps AS (SELECT r4.hostname, episode_start, episode_end, n_active, MAX(g2.value) AS peak_value, MAX(g2.event_id % 7 / 2.0) AS peak_other, (epoch_us(episode_end) - epoch_us(episode_start)) // 60000000 + 1 AS duration_min, CAST(COALESCE(MAX(g2.value) >= 40, FALSE) AS BIGINT) + CAST(MAX(g2.event_id % 7 / 2.0) >= 2 AS BIGINT) AS n_agree FROM r4 JOIN g2 ON g2.hostname = r4.hostname AND g2.rn BETWEEN r4.s AND r4.e GROUP BY ALL)"


def _episodes(spark, d):
    df = rows(spark, d).withColumn("other", F.col("event_id") % 7 / 2)
    return fusion.candidate_episodes(df, BY, ORDER, F.col("value") > 25, ["value", "other"], agree={"value": 40.0, "other": 2.0})


@query(_EP + " SELECT * FROM eps")
def candidate_episodes(spark, d):
    return _episodes(spark, d)


@query(_EP + " SELECT eps.hostname, episode_start, episode_end, ROUND(AVG(t.value), 6) AS value_mean, MAX(t.value) AS value_max, MAX(t.value) AS value_absmax, COALESCE(bool_or(t.value > 60), FALSE) AS high_any FROM eps JOIN t ON t.hostname = eps.hostname AND t.ts BETWEEN episode_start AND episode_end GROUP BY ALL")
def episode_features(spark, d):
    f = fusion.episode_features(_episodes(spark, d).select("hostname", "episode_start", "episode_end"), rows(spark, d).withColumn("high", F.col("value") > 60), BY, "ts", ["value"], ["value"], ["high"])
    return f.withColumn("value_mean", r("value_mean"))


@query(_EP + f" SELECT eps.hostname, episode_start, episode_end, first(sp ORDER BY n DESC, sp) AS split FROM (SELECT hostname, episode_start, episode_end, sp, COUNT(*) AS n FROM (SELECT eps.hostname, episode_start, episode_end, CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts <= TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS sp FROM eps JOIN t ON t.hostname = eps.hostname AND t.ts BETWEEN episode_start AND episode_end) GROUP BY ALL) eps GROUP BY ALL")
def split_of_episode(spark, d):
    e = _episodes(spark, d).select("hostname", "episode_start", "episode_end")
    inside = joins.point_in_interval(rows(spark, d).withColumn("split", master.split_of(F.col("ts"), TRAIN_END, VAL_END)), e, BY, "ts", "episode_start", "episode_end", True, 86400)
    return W_.mode_of(inside, ["hostname", "episode_start", "episode_end"], "split", "split")


@query("SELECT vec_id, CASE WHEN p >= 0.9 THEN 'CRITICAL' WHEN p >= 0.7 THEN 'CONFIRMED' WHEN p >= 0.4 THEN 'CANDIDATE' ELSE 'NONE' END AS tier FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS p FROM embeddings)")
def tier_assign(spark, d):
    return table(spark, d, "embeddings").select("vec_id", fusion.tier((F.col("vec_id") % 100) / 100, 0.4, 0.7, 0.9).alias("tier"))


@query(f"WITH {T} SELECT event_id, COALESCE(value > 50, FALSE) OR event_id % 3 = 0 OR event_id % 5 = 0 AS any_of, COALESCE(value > 50, FALSE) AND event_id % 3 = 0 AND event_id % 5 = 0 AS all_of, COALESCE(value > 50, FALSE)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT >= 2 AS two_of_three FROM t")
def ensemble_flags(spark, d):
    f = rows(spark, d).withColumns({"a": F.col("value") > 50, "b": F.col("event_id") % 3 == 0, "c": F.col("event_id") % 5 == 0})
    return fusion.ensembles(f, "a", "b", "c").select("event_id", "any_of", "all_of", "two_of_three")


# Evaluation


_GW = "gw AS (SELECT * , event_start - INTERVAL 60 MINUTE AS ws, event_end + INTERVAL 30 MINUTE AS we FROM g)"


@query(f"WITH {T}, {G}, {_GW} SELECT t.event_id FROM t WHERE sensor <> 'error' AND (EXISTS (SELECT 1 FROM gw WHERE gw.hostname = t.hostname AND t.ts BETWEEN ws AND we) OR EXISTS (SELECT 1 FROM gw WHERE gw.hostname = '*' AND t.ts BETWEEN ws AND we))")
def wildcard_event_match(spark, d):
    return evaluation.row_labels(rows(spark, d).where("sensor <> 'error'"), "event_id", truth(spark, d), "hostname", "ts")


_AL = "al AS (SELECT event_id, hostname, ts AS a, ts + INTERVAL 15 MINUTE AS b FROM t WHERE value > 90)"


def _alerts(spark, d):
    return rows(spark, d).where("value > 90").select("event_id", "hostname", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL '15' MINUTE")).alias("b"))


_PAIRS = f"WITH {T}, {G}, {_GW}, {_AL}, pairs AS (SELECT al.event_id, gw.gt_id, category FROM al JOIN gw ON gw.hostname = al.hostname AND a <= we AND b >= ws UNION SELECT al.event_id, gw.gt_id, category FROM al JOIN gw ON gw.hostname = '*' AND a <= we AND b >= ws)"


@query(_PAIRS + ", k AS (SELECT (SELECT COUNT(DISTINCT event_id) FROM pairs) AS tp, (SELECT COUNT(*) FROM al) AS n, (SELECT COUNT(*) FROM g) AS m, (SELECT COUNT(DISTINCT gt_id) FROM pairs) AS found) SELECT tp, n - tp AS fp, m - found AS fn, ROUND(tp / NULLIF(n, 0), 6) AS precision, ROUND(tp / NULLIF(tp + m - found, 0), 6) AS recall FROM k")
def event_level_match(spark, d):
    out = evaluation.event_metrics(_alerts(spark, d), truth(spark, d), "event_id", "gt_id", "hostname", ("a", "b"))
    return out.select("tp", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"))


@query(_PAIRS + " SELECT g.category, COUNT(*) AS n, COUNT(f.gt_id) AS found, ROUND(COUNT(f.gt_id) / COUNT(*), 6) AS recall FROM g LEFT JOIN (SELECT DISTINCT gt_id FROM pairs) f USING (gt_id) GROUP BY g.category")
def recall_by_category(spark, d):
    g = truth(spark, d)
    hit = evaluation.matched(_alerts(spark, d), g, "hostname", ("a", "b")).select("gt_id").distinct().withColumn("hit", F.lit(1))
    return g.join(hit, "gt_id", "left").groupBy("category").agg(F.count("*").alias("n"), F.count("hit").alias("found"), r(F.count("hit") / F.count("*")).alias("recall"))


@query(f"WITH {T}, a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({W})) <= 21600000000 THEN 0 ELSE 1 END AS c FROM t), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT hostname, MIN(ts) AS episode_start, MAX(ts) AS episode_end, COUNT(*) AS n_rows FROM b GROUP BY hostname, s")
def dedup_sessions(spark, d):
    return fusion.sessions(rows(spark, d), ["hostname"], "ts", 360)


def _scored(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return labels.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.round(F.col("n_chars") / 100).alias("s"), (F.col("toxic") == 1).alias("y"))


_SC = "sc AS (SELECT l.doc_id, ROUND(n_chars / 100) AS s, toxic = 1 AS y FROM (SELECT doc_id, MAX(toxic) AS toxic FROM labels GROUP BY 1) l JOIN documents USING (doc_id))"


@query(f"WITH {_SC}, g AS (SELECT s, COUNT(*) FILTER (y) AS p, COUNT(*) FILTER (NOT y) AS n FROM sc GROUP BY s), c AS (SELECT *, SUM(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS pp FROM g) SELECT ROUND(SUM(n * (pp - p) + 0.5 * n * p) / (SUM(p)::DOUBLE * SUM(n)), 6) AS auroc FROM c")
def auroc(spark, d):
    return evaluation.auroc(_scored(spark, d), "s", "y").select(r("auroc", 6).alias("auroc"))


@query(f"WITH {_SC}, g AS (SELECT s, COUNT(*) FILTER (y) AS p, COUNT(*) FILTER (NOT y) AS n FROM sc GROUP BY s), c AS (SELECT *, SUM(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS pp, SUM(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS nn FROM g) SELECT ROUND(SUM(p * pp / (pp + nn)) / SUM(p), 6) AS auprc FROM c")
def auprc(spark, d):
    return evaluation.average_precision(_scored(spark, d), "s", "y").select(r("auprc", 6).alias("auprc"))


@query(f"WITH {_SC}, o AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS rn FROM sc) SELECT CAST(k AS INTEGER) AS k, ROUND(AVG(y::INT), 6) AS precision FROM o, (VALUES (10), (50), (100)) v(k) WHERE rn <= k GROUP BY k")
def precision_at_k(spark, d):
    return evaluation.precision_at(_scored(spark, d), "s", "y", "doc_id", (10, 50, 100)).withColumn("precision", r("precision", 6))


@query(f"WITH {_SC}, p AS (SELECT s / 200 AS prob, y FROM sc), t AS (SELECT unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS t) SELECT t, COUNT(*) FILTER (y) AS tp, COUNT(*) FILTER (NOT y) AS fp, ROUND(COUNT(*) FILTER (y) / COUNT(*), 6) AS precision, ROUND(COUNT(*) FILTER (y) / (SELECT COUNT(*) FROM p WHERE y), 6) AS recall FROM p JOIN t ON prob >= t GROUP BY t")
def threshold_grid(spark, d):
    g = evaluation.threshold_grid(_scored(spark, d).withColumn("prob", F.col("s") / 200), "prob", "y", (0.05, 0.1, 0.2, 0.4))
    return g.select("t", "tp", "fp", r("precision", 6).alias("precision"), r("recall", 6).alias("recall"))


@query(f"WITH {T}, f AS (SELECT sensor, CASE WHEN {_TRAIN} THEN 'train' ELSE 'later' END AS split, COALESCE(value > 50, FALSE) AS fl FROM t) SELECT COALESCE(sensor, 'all') AS sensor, COALESCE(split, 'all') AS split, COUNT(*) AS n, COUNT(*) FILTER (fl) AS n_flagged FROM f GROUP BY CUBE (sensor, split)")
def detector_cube(spark, d):
    f = rows(spark, d).select("sensor", F.when(_train(), "train").otherwise("later").alias("split"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("fl"))
    out = f.cube("sensor", "split").agg(F.count("*").alias("n"), F.count_if("fl").alias("n_flagged"))
    return out.select(F.coalesce("sensor", F.lit("all")).alias("sensor"), F.coalesce("split", F.lit("all")).alias("split"), "n", "n_flagged")


_TC = ", ".join(f"COUNT(*) FILTER (b = '{c}') AS {c}" for c in ("thermal", "power", "network"))


@query(f"WITH f AS (SELECT ['thermal','power','network'][CAST(event_id % 3 + 1 AS INTEGER)] AS a, ['thermal','power','network'][CAST(event_id % 7 % 3 + 1 AS INTEGER)] AS b FROM events) SELECT a, {_TC} FROM f GROUP BY a")
def type_confusion(spark, d):
    kinds = ("thermal", "power", "network")
    pick = lambda n: F.element_at(F.array(*[F.lit(k) for k in kinds]), (n + 1).cast("int"))
    f = table(spark, d, "events").select(pick(F.col("event_id") % 3).alias("a"), pick(F.col("event_id") % 7 % 3).alias("b"))
    return evaluation.confusion(f, "a", "b", kinds)


@query(_PAIRS + " SELECT COUNT(*) AS n_events, (SELECT COUNT(DISTINCT gt_id) FROM pairs) AS covered FROM g")
def coverage(spark, d):
    g = truth(spark, d)
    hit = evaluation.matched(_alerts(spark, d), g, "hostname", ("a", "b")).select("gt_id").distinct()
    return g.agg(F.count("*").alias("n_events")).join(hit.agg(F.count("*").alias("covered")), how="cross")


@query(f"WITH {T} SELECT rack_id, COUNT(DISTINCT hostname) AS hosts, COUNT(*) AS n FROM t WHERE rack_id IN (SELECT rack_id FROM t WHERE sensor = 'error' AND value > 95) GROUP BY rack_id")
def rack_fanout_match(spark, d):
    hot = rows(spark, d).where("sensor = 'error' and value > 95").select("rack_id").distinct()
    return rows(spark, d).join(hot, "rack_id", "left_semi").groupBy("rack_id").agg(F.count_distinct("hostname").alias("hosts"), F.count("*").alias("n"))


# Alerts


@query("WITH f AS (SELECT event_id, value, CASE WHEN value > 60 THEN 5 END AS t1, CASE WHEN event_id % 3 = 0 THEN 3 END AS t2, event_id % 29 = 0 AS dr, CASE event_id % 5 WHEN 1 THEN 'COOLING_FAULT' WHEN 2 THEN 'INFRA_FAULT' WHEN 3 THEN 'SENSOR_DRIFT' WHEN 4 THEN 'MEASUREMENT_DISCREPANCY' ELSE 'AMBIGUOUS' END AS cx FROM events) SELECT event_id, CASE WHEN dr THEN 'sensor_dropout' WHEN t2 IS NOT NULL THEN 'thermal' WHEN t1 IS NOT NULL THEN 'power' WHEN cx = 'COOLING_FAULT' THEN 'cooling_failure' WHEN cx = 'INFRA_FAULT' THEN 'hardware' WHEN cx = 'MEASUREMENT_DISCREPANCY' THEN 'measurement_glitch' WHEN value > 20 THEN 'peer_node_divergence' ELSE 'unknown' END AS category FROM f")
def category_precedence(spark, d):
    e = F.col("event_id")
    cx = F.element_at(F.array(*[F.lit(x) for x in ("AMBIGUOUS", "COOLING_FAULT", "INFRA_FAULT", "SENSOR_DRIFT", "MEASUREMENT_DISCREPANCY")]), (e % 5 + 1).cast("int"))
    c = alerts.category([("power", F.col("value") > 60, F.lit(5)), ("thermal", e % 3 == 0, F.lit(3))], cx, F.col("value") / 10, e % 29 == 0)
    return table(spark, d, "events").select("event_id", c.alias("category"))


@query(f"WITH {T} SELECT event_id, ROUND((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY hostname, sensor ORDER BY ts, event_id))) / 6e7, 6) AS prev_similar_min FROM t")
def prev_similar(spark, d):
    return alerts.minutes_since_similar(rows(spark, d), ["hostname", "sensor"], "ts", ["event_id"]).select("event_id", r("prev_similar_min").alias("prev_similar_min"))


@query("WITH s AS (SELECT event_id, (event_id % 50) / 10.0 AS a, (event_id % 31) / 10.0 AS b, (event_id % 23) / 10.0 AS c FROM events), n AS (SELECT *, a / 4 AS na, b / 3 AS nb, c / 3 AS nc, greatest(a / 4, b / 3, c / 3) AS top FROM s), k AS (SELECT event_id, [CASE WHEN a >= 4 OR (na >= 0.9 * top AND na >= 0.25) THEN {'o': -na, 'p': 'sensor'} END, CASE WHEN b >= 4 OR (nb >= 0.9 * top AND nb >= 0.25) THEN {'o': -nb, 'p': 'job'} END, CASE WHEN c >= 4 OR (nc >= 0.9 * top AND nc >= 0.25) OR event_id % 13 = 0 THEN {'o': -nc, 'p': 'physics'} END] AS l FROM n) SELECT event_id, array_to_string(list_transform(list_sort(list_filter(l, lambda x: x IS NOT NULL)), lambda x: x.p), '|') AS caught_by FROM k")
def caught_by(spark, d):
    e = F.col("event_id")
    out = alerts.caught_by({"sensor": (e % 50) / 10, "job": (e % 31) / 10, "physics": (e % 23) / 10}, e % 13 == 0)
    return table(spark, d, "events").select("event_id", out.alias("caught_by"))


@query(f"WITH {T}, a AS (SELECT event_id, hostname, (event_id % 100)::BIGINT AS m, CASE WHEN value > 50 THEN 'high' ELSE '' END AS why, CASE WHEN event_id % 2 = 0 THEN 'CRITICAL' ELSE 'CONFIRMED' END AS tier FROM t) SELECT event_id, '[' || tier || '] ' || hostname || ' power anomaly for ' || CAST(m AS VARCHAR) || ' min' || CASE WHEN why <> '' THEN ': ' || why ELSE '' END || '.' AS message FROM a")
def alert_text(spark, d):
    e = F.col("event_id")
    df = rows(spark, d).withColumns({"end": F.col("ts") + F.make_dt_interval(mins=(e % 100).cast("int")), "category": F.lit("power"), "tier": F.when(e % 2 == 0, "CRITICAL").otherwise("CONFIRMED"), "why": F.when(F.col("value") > 50, "high").otherwise("")})
    return alerts.alert_card(df, "hostname", "ts", "end", "category", "tier", "why").select("event_id", "message")


@query(f"WITH {T}, p AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'pre' ELSE 'epi' END AS phase, value * 1.5 + 1 AS other FROM t), l AS (SELECT hostname, phase, 'value' AS channel, value AS x FROM p UNION ALL SELECT hostname, phase, 'other', other FROM p), e AS (SELECT hostname, channel, MAX(x) FILTER (phase = 'epi') AS peak, quantile_cont(x, 0.5) FILTER (phase = 'pre') AS m, COUNT(x) FILTER (phase = 'pre') AS n FROM l GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY peak DESC, channel DESC) AS rn FROM e WHERE peak IS NOT NULL) SELECT hostname, channel, ROUND(peak, 6) AS peak, CASE WHEN n >= 3 THEN ROUND(m, 6) END AS baseline FROM o WHERE rn = 1")
def peak_and_baseline(spark, d):
    p = rows(spark, d).select("hostname", F.when(F.col("ts") < F.lit("2024-01-15 00:00:00").cast(NTZ), "pre").otherwise("epi").alias("phase"), "value", (F.col("value") * 1.5 + 1).alias("other"))
    return alerts.peak_and_baseline(p, ["hostname"], ["value", "other"], "phase").select("hostname", "channel", r("peak").alias("peak"), r("baseline").alias("baseline"))


# Injection


_HOST, _A, _B = "rpc-3-13", "2024-01-10 00:00:00", "2024-01-14 00:00:00"
_M = f"hostname = '{_HOST}' AND ts >= TIMESTAMP '{_A}' AND ts < TIMESTAMP '{_B}'"
_spec = {"hostname": _HOST, "start": _A, "end": _B, "column": "value"}


@query(f"WITH {T} SELECT event_id, ROUND(CASE WHEN {_M} THEN value + (epoch_us(ts) - epoch_us(TIMESTAMP '{_A}')) / 3.6e9 * 0.05 ELSE value END, 6) AS value FROM t")
def inject_ramp(spark, d):
    out, _ = inject.inject(rows(spark, d), [_spec | {"type": "gradual_thermal_drift"}])
    return out.select("event_id", r("value").alias("value"))


@query(f"WITH {T} SELECT event_id, ROUND(CASE WHEN {_M} THEN value * 1.4 ELSE value END, 6) AS value FROM t")
def inject_scale(spark, d):
    out, _ = inject.inject(rows(spark, d), [_spec | {"type": "peer_node_divergence"}])
    return out.select("event_id", r("value").alias("value"))


@query(f"WITH {T} SELECT event_id, CASE WHEN {_M} THEN NULL ELSE value END AS value FROM t")
def inject_dropout(spark, d):
    out, _ = inject.inject(rows(spark, d), [_spec | {"type": "sensor_dropout"}])
    return out.select("event_id", "value")


@query(f"WITH {T}, l AS (SELECT quantile_cont(value, 0.5) AS lvl FROM t WHERE hostname = '{_HOST}' AND ts >= TIMESTAMP '{_A}' - INTERVAL 72 HOUR AND ts < TIMESTAMP '{_A}') SELECT event_id, ROUND(CASE WHEN {_M} THEN COALESCE(lvl, value) ELSE value END, 6) AS value FROM t, l")
def inject_stuck_median(spark, d):
    out, _ = inject.inject(rows(spark, d), [_spec | {"type": "sensor_stuck_at_value", "lookback_hr": 72}])
    return out.select("event_id", r("value").alias("value"))


_T_IN = f"(epoch_us(ts) - epoch_us(TIMESTAMP '{_A}')) / 6e7"


@query(f"WITH {T} SELECT event_id, ROUND(CASE WHEN {_M} AND value IS NOT NULL THEN least(greatest(value + {_T_IN} / 5760 * 80, 0), 100) ELSE value END, 6) AS memoryusage, ROUND(CASE WHEN {_M} AND value IS NOT NULL THEN greatest(value * (1 - {_T_IN} / 5760 * 0.8), 0) ELSE value END, 6) AS freememory FROM t")
def inject_memory_leak(spark, d):
    df = rows(spark, d).select("event_id", "hostname", "ts", F.col("value").alias("memoryusage"), F.col("value").alias("freememory"))
    out, _ = inject.inject(df, [{"type": "memory_leak", "hostname": _HOST, "start": _A, "end": _B}])
    return out.select("event_id", r("memoryusage").alias("memoryusage"), r("freememory").alias("freememory"))


@query(f"WITH {T} SELECT event_id, CASE WHEN {_M} THEN least(greatest(COALESCE(value, 99), 99), 100) ELSE value END AS cpuusage, CASE WHEN {_M} THEN greatest(COALESCE(value, 500), 500) ELSE value END AS totalcpupower, value AS gpucpuusage FROM t")
def inject_cpu_exhaustion(spark, d):
    df = rows(spark, d).select("event_id", "hostname", "ts", *[F.col("value").alias(c) for c in ("cpuusage", "totalcpupower", "gpucpuusage")])
    out, _ = inject.inject(df, [{"type": "cpu_exhaustion", "hostname": _HOST, "start": _A, "end": _B}])
    return out.select("event_id", "cpuusage", "totalcpupower", "gpucpuusage")


@query(f"WITH {T} SELECT event_id, ROUND(CASE WHEN {_M} AND value IS NOT NULL THEN greatest(value * 0.2, 5) ELSE value END, 6) AS fanrpm, ROUND(CASE WHEN {_M} THEN value + 4 * least({_T_IN} / 15, 1) ELSE value END, 6) AS inlettemp FROM t")
def inject_fan_drop(spark, d):
    df = rows(spark, d).select("event_id", "hostname", "ts", F.col("value").alias("fanrpm"), F.col("value").alias("inlettemp"))
    out, _ = inject.inject(df, [{"type": "fan_rpm_drop", "hostname": _HOST, "start": _A, "end": _B, "rpm_floor": 5, "temp_bump_c": 4.0}])
    return out.select("event_id", r("fanrpm").alias("fanrpm"), r("inlettemp").alias("inlettemp"))


@query(f"WITH {T} SELECT event_id, ROUND(CASE WHEN {_M} THEN value + 5 * least({_T_IN} / 30, 1) ELSE value END, 6) AS inlet_temp, ROUND(CASE WHEN hostname = '{_HOST}' AND ts >= TIMESTAMP '{_A}' AND ts < TIMESTAMP '{_A}' + INTERVAL 96 HOUR THEN value * 1.25 ELSE value END, 6) AS pdu_power FROM t")
def inject_cooling_and_glitch(spark, d):
    df = rows(spark, d).select("event_id", "hostname", "ts", F.col("value").alias("inlet_temp"), F.col("value").alias("pdu_power"))
    specs = [{"type": "cooling_failure", "hostname": _HOST, "start": _A, "end": _B}, {"type": "measurement_glitch", "hostname": _HOST, "start": _A, "duration_hr": 96}]
    out, _ = inject.inject(df, specs)
    return out.select("event_id", r("inlet_temp").alias("inlet_temp"), r("pdu_power").alias("pdu_power"))


# Streams: each drains a directory of files and gives the batch result


def _drained(spark, d, build, mode="append"):
    from pulsegrid.sources.adapters import table as _table

    where = shared_folder(spark, "stream")
    _table(spark, d, "events").write.parquet(f"{where}/in")
    live.drain(build(live.source(spark, f"{where}/in")), f"{where}/out", f"{where}/checkpoint", mode)
    return spark, where


@query()
def stream_tumbling_availablenow(spark, d):
    spark, where = _drained(spark, d, lambda s: live.tumbling(s, "ts", ["event_type"], "value", "1 day"))
    return spark.read.parquet(f"{where}/out")


@query()
def stream_session(spark, d):
    spark, where = _drained(spark, d, lambda s: live.sessions(s, "ts", ["user_id"], "6 hours"))
    return spark.read.parquet(f"{where}/out")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, ROUND(AVG(value), 6) AS mean, COUNT(*) AS n FROM events GROUP BY ALL")
def batch_tumbling(spark, d):
    return live.tumbling(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day").withColumn("mean", r("mean"))


# Extras that the engine has for free


@query("SELECT COALESCE(l_returnflag, 'all') AS l_returnflag, COALESCE(l_linestatus, 'all') AS l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def cube_rollup(spark, d):
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))
    return out.na.fill("all", ["l_returnflag", "l_linestatus"])


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def intersect_except(spark, d):
    o = table(spark, d, "orders")
    both = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))
    return both.subtract(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT p_partkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS q FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def rank_family(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select("p_partkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("long").alias("q"))


@query(f"WITH {J} SELECT o_state AS job_state, COUNT(*) AS n, ROUND(SUM(power), 2) AS power FROM j JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'PENDING' END AS o_state FROM orders) ON job_id = o_orderkey GROUP BY o_state")
def job_states_power(spark, d):
    return jobs(spark, d).join(job_states(spark, d), "job_id").groupBy("job_state").agg(F.count("*").alias("n"), r(F.sum("power"), 2).alias("power"))


@query(f"WITH {T}, h AS (SELECT hostname, sensor, date_trunc('hour', ts) AS ts, AVG(value) AS v FROM t GROUP BY ALL), s AS (SELECT hostname, sensor, AVG(v) AS m, stddev_samp(v) AS sd, COUNT(v) AS n FROM h GROUP BY ALL), z AS (SELECT h.hostname, h.ts, MAX(CASE WHEN n >= 3 AND sd >= 1e-6 THEN abs(v - m) / sd ELSE 0 END) AS z, COUNT(*) FILTER (v IS NOT NULL) AS sensors FROM h JOIN s USING (hostname, sensor) GROUP BY ALL) SELECT hostname, COUNT(*) AS hours, ROUND(MAX(z), 3) AS max_z, ROUND(AVG((z > 2)::INT), 6) AS flag_rate FROM z GROUP BY hostname")
def flagship(spark, d):
    h = master.bucket_mean(rows(spark, d), ["hostname", "sensor"], "ts", "value", "hour")
    s = h.groupBy("hostname", "sensor").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    z = F.when((F.col("n") >= 3) & (F.col("sd") >= 1e-6), F.abs(F.col("value") - F.col("m")) / F.col("sd")).otherwise(0.0)
    per = h.join(s, ["hostname", "sensor"]).groupBy("hostname", "ts").agg(F.max(z).alias("z"))
    return per.groupBy("hostname").agg(F.count("*").alias("hours"), r(F.max("z"), 3).alias("max_z"), r(F.avg((F.col("z") > 2).cast("double"))).alias("flag_rate"))
