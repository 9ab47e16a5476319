"""Queries: scans and scalar functions, pivots, joins, audit flags, features and sensor detectors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.functions import windows as W_
from pulsegrid.operators import audit, detectors, features, joins, learn, master
from pulsegrid.plans.base import BY, ORDER, TRAIN_END, VAL_END, J, T, W, query, r
from pulsegrid.sources.adapters import jobs, table, telemetry

MAINTENANCE = [(datetime(2024, 1, 8), datetime(2024, 1, 10)), (datetime(2024, 1, 18), datetime(2024, 1, 19))]
SENSORS = ["click", "error", "purchase", "signup", "view"]
KEY = ["event_id"]


def rows(spark, d):
    return telemetry(spark, d)


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error','view') AND value > 20 AND ts >= TIMESTAMP '2024-01-05 00:00:00'")
def scan_filter_project(spark, d):
    e = table(spark, d, "events")
    return e.where(F.col("event_type").isin("error", "view") & (F.col("value") > 20) & (F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))).select("event_id", "event_type", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop_extract(spark, d):
    return table(spark, d, "events").select("event_id", scalars.to_int(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS num, CAST(NULL AS BIGINT) AS bad FROM customer")
def safe_cast_numeric(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", scalars.to_int(F.regexp_extract("c_name", r"(\d+)$", 1)).alias("num"), scalars.to_int(F.col("c_mktsegment")).alias("bad"))


@query("SELECT event_id, CAST([65 + event_id % 26, 97] AS VARCHAR) AS raw, chr(CAST(65 + event_id % 26 AS INTEGER)) || 'a' AS decoded, '{300,1}' AS kept FROM events".replace("CAST([65 + event_id % 26, 97] AS VARCHAR)", "'{' || CAST(65 + event_id % 26 AS VARCHAR) || ',97}'"))
def bytea_decode(spark, d):
    raw = F.concat(F.lit("{"), (65 + F.col("event_id") % 26).cast("string"), F.lit(",97}"))
    return table(spark, d, "events").select("event_id", raw.alias("raw"), scalars.decode_bytes(raw).alias("decoded"), scalars.decode_bytes(F.lit("{300,1}")).alias("kept"))


@query("SELECT event_id, CAST(3 AS BIGINT) AS n_json, CAST(event_id + user_id + 1 AS BIGINT) AS total, '1|' || CAST(user_id AS VARCHAR) AS listed FROM events")
def parse_list_variants(spark, d):
    js = F.concat(F.lit("[1, "), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit("]"))
    pg = F.concat(F.lit('{1,"'), F.col("user_id").cast("string"), F.lit('"}'))
    ints = scalars.parse_ints(js)
    return table(spark, d, "events").select("event_id", F.size(ints).cast("long").alias("n_json"), F.aggregate(ints, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_join(scalars.parse_strings(pg), "|").alias("listed"))


@query("SELECT event_id, date_trunc('minute', ts) AS at_seconds, date_trunc('minute', ts) AS at_nanos FROM events")
def epoch_unit_sniff(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", scalars.minute_of_epoch(s.cast("string")).alias("at_seconds"), scalars.minute_of_epoch((s * 1_000_000_000).cast("string")).alias("at_nanos"))


@query(f"WITH {T} SELECT event_id, hostname, CAST(regexp_extract(hostname, '^[A-Za-z]+-([0-9]+)-[0-9]+', 1) AS INTEGER) AS rack FROM t")
def rack_id_regex(spark, d):
    return rows(spark, d).select("event_id", "hostname", scalars.rack_id(F.col("hostname")).alias("rack"))


@query("SELECT item_id, length(text) AS n, regexp_matches(text, '[0-9]') AS digits, CASE WHEN regexp_matches(lower(text), 'therm|temp|cool|fan|overheat') THEN 'thermal' WHEN regexp_matches(lower(text), 'power|psu|pdu|outage|voltage') THEN 'power' WHEN regexp_matches(lower(text), 'hard|disk|dimm|memory|cpu|gpu|node') THEN 'hardware' WHEN regexp_matches(lower(text), 'soft|kernel|driver|os|job') THEN 'software' WHEN regexp_matches(lower(text), 'net|link|switch|infiniband') THEN 'network' ELSE 'unknown' END AS category FROM benchmark")
def category_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("n"), F.col("text").rlike("[0-9]").alias("digits"), scalars.category(F.col("text")).alias("category"))


@query(f"WITH {T} SELECT hostname, sensor, date_trunc('hour', ts) AS ts, ROUND(AVG(value), 6) AS value, COUNT(*) AS n_raw FROM t GROUP BY ALL")
def minute_avg_long(spark, d):
    return master.bucket_mean(rows(spark, d), ["hostname", "sensor"], "ts", "value", "hour").withColumn("value", r("value"))


@query(f"WITH {T}, c AS (SELECT hostname, date_trunc('day', ts) AS ts, COUNT(*) AS n_raw FROM t GROUP BY ALL) SELECT *, n_raw > greatest(4 * (SELECT quantile_cont(n_raw, 0.5) FROM c), 2.0) AS dup FROM c")
def dup_count_side_agg(spark, d):
    return audit.flag_duplicates(master.bucket_mean(rows(spark, d), ["hostname"], "ts", "value", "day").drop("value"))


_pivot = ", ".join(f"ROUND(AVG(value) FILTER (sensor = '{s}'), 6) AS {s}_avg" for s in SENSORS)


@query(f"WITH {T} SELECT hostname, date_trunc('day', ts) AS ts, {_pivot} FROM t GROUP BY ALL")
def long_to_wide_pivot(spark, d):
    long = rows(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    wide = master.long_to_wide(long, ["hostname", "ts"], "sensor", "value", SENSORS)
    return wide.select("hostname", "ts", *[r(f"{s}_avg").alias(f"{s}_avg") for s in SENSORS])


@query(f"WITH {T}, s AS (SELECT hostname, ROUND(AVG(value), 6) AS mean, ROUND(MAX(value), 6) AS top FROM t GROUP BY hostname) SELECT hostname, 'mean' AS stat, mean AS x FROM s UNION ALL SELECT hostname, 'top', top FROM s")
def unpivot_stats(spark, d):
    s = rows(spark, d).groupBy("hostname").agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("top"))
    return master.wide_to_long(s, ["hostname"], ["mean", "top"], "stat", "x")


@query(f"WITH {T} SELECT hostname, day, event_id, value FROM (SELECT *, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY hostname, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS n FROM t) WHERE n = 1")
def last_row_per_bucket(spark, d):
    keyed = rows(spark, d).select("hostname", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "ts", "event_id", "value")
    return master.last_per(keyed, ["hostname", "day"], ["ts", "event_id"]).select("hostname", "day", "event_id", "value")


@query(f"WITH {T}, a AS (SELECT hostname, date_trunc('hour', ts) AS ts, MAX(value) AS view_max FROM t WHERE sensor = 'view' GROUP BY ALL), b AS (SELECT hostname, date_trunc('hour', ts) AS ts, MAX(value) AS click_max, bool_or(value > 50) AS f FROM t WHERE sensor = 'click' GROUP BY ALL) SELECT COALESCE(a.hostname, b.hostname) AS hostname, COALESCE(a.ts, b.ts) AS ts, view_max, click_max, COALESCE(f, FALSE) AS audit_any FROM a FULL JOIN b ON a.hostname = b.hostname AND a.ts = b.ts")
def full_outer_metrics(spark, d):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    a = rows(spark, d).where("sensor = 'view'").groupBy("hostname", hour).agg(F.max("value").alias("view_max")).withColumn("audit_any", F.lit(False))
    b = rows(spark, d).where("sensor = 'click'").groupBy("hostname", hour).agg(F.max("value").alias("click_max"), F.bool_or(F.col("value") > 50).alias("audit_any"))
    return master.merge_outer([a, b], ["hostname", "ts"])


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def left_job_context(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    return features.attach(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@query("WITH p AS (SELECT s_nationkey AS rack, date_trunc('month', l_shipdate) AS ts, SUM(l_extendedprice) AS pdu_sum, COUNT(DISTINCT s_suppkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), h AS (SELECT s_nationkey AS rack, date_trunc('month', l_shipdate) AS ts, SUM(l_quantity * 1000) AS host_sum FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), o AS (SELECT s_nationkey AS rack, COUNT(*) AS n FROM supplier GROUP BY 1), u AS (SELECT n AS usual FROM (SELECT n, COUNT(*) AS c FROM o GROUP BY n ORDER BY c DESC, n LIMIT 1)) SELECT p.rack, p.ts, ROUND(pdu_sum / host_sum, 6) AS ratio, COALESCE(pdu_sum / host_sum > 1.5 * least(o.n / usual, 1.0) OR pdu_sum / host_sum < 0.85 * least(o.n / usual, 1.0), FALSE) AS is_flagged FROM p JOIN h USING (rack, ts) JOIN o USING (rack), u")
def inner_rack_budget(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("rack"))
    lines = table(spark, d, "lineitem").join(s, "l_suppkey").withColumn("ts", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz"))
    pdu = lines.groupBy("rack", "ts").agg(F.sum("l_extendedprice").alias("pdu_sum"))
    hosts = lines.groupBy("rack", "ts").agg(F.sum(F.col("l_quantity") * 1000).alias("host_sum"))
    return detectors.rack_balance(pdu, hosts, ["rack", "ts"], s.groupBy("rack").agg(F.count("*").alias("n"))).select("rack", "ts", r("ratio").alias("ratio"), "is_flagged")


@query(f"WITH {T}, l AS (SELECT event_id, hostname, ts FROM t WHERE sensor = 'click'), v AS (SELECT event_id AS eid, hostname, ts AS vts, value FROM t WHERE sensor = 'view'), m AS (SELECT l.event_id, v.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(vts)), vts, eid DESC) AS n FROM l JOIN v ON l.hostname = v.hostname AND abs(epoch_us(l.ts) - epoch_us(vts)) <= 86400000000) SELECT l.event_id, m.value FROM l LEFT JOIN m ON l.event_id = m.event_id AND n = 1")
def asof_nearest_tol(spark, d):
    left, right = rows(spark, d).where("sensor = 'click'").select("event_id", "hostname", "ts"), rows(spark, d).where("sensor = 'view'").select("hostname", "ts", "value", "event_id")
    return joins.asof(left, right, ["hostname"], "ts", ["value"], 86400, "nearest", "event_id").select("event_id", "value")


@query(f"WITH {T}, l AS (SELECT event_id, hostname, ts FROM t WHERE sensor = 'click'), v AS (SELECT event_id AS eid, hostname, ts AS vts, value FROM t WHERE sensor = 'view'), m AS (SELECT l.event_id, v.value, row_number() OVER (PARTITION BY l.event_id ORDER BY vts DESC, eid DESC) AS n FROM l JOIN v ON l.hostname = v.hostname AND vts <= l.ts) SELECT l.event_id, m.value FROM l LEFT JOIN m ON l.event_id = m.event_id AND n = 1")
def asof_backward(spark, d):
    left, right = rows(spark, d).where("sensor = 'click'").select("event_id", "hostname", "ts"), rows(spark, d).where("sensor = 'view'").select("hostname", "ts", "value", "event_id")
    return joins.asof(left, right, ["hostname"], "ts", ["value"], None, "backward", "event_id").select("event_id", "value")


@query(f"WITH {T}, x AS (SELECT hostname, ts, event_id FROM t WHERE sensor = 'error') SELECT t.event_id, COUNT(x.event_id) AS n_open FROM t JOIN x ON t.hostname = x.hostname AND t.ts BETWEEN x.ts AND x.ts + INTERVAL 12 HOUR GROUP BY t.event_id")
def point_in_interval(spark, d):
    spans = rows(spark, d).where("sensor = 'error'").select("hostname", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL '12' HOUR")).alias("b"), F.col("event_id").alias("x"))
    return joins.point_in_interval(rows(spark, d), spans, ["hostname"], "ts", "a", "b").groupBy("event_id").agg(F.count("x").alias("n_open"))


@query(f"WITH {J} SELECT a.job_id AS job_a, a.task AS task_a, COUNT(*) AS n_overlaps FROM j a JOIN j b ON a.host_id = b.host_id AND a.start_time <= b.end_time AND a.end_time >= b.start_time GROUP BY ALL")
def interval_overlap(spark, d):
    a = jobs(spark, d).select("host_id", F.col("job_id").alias("job_a"), F.col("task").alias("task_a"), F.col("start_time").alias("sa"), F.col("end_time").alias("ea"))
    b = a.select("host_id", F.col("sa").alias("sb"), F.col("ea").alias("eb"))
    return joins.overlaps(a, b, ["host_id"], ("sa", "ea"), ("sb", "eb"), 30 * 86400).groupBy("job_a", "task_a").agg(F.count("*").alias("n_overlaps"))


@query("SELECT s.s_suppkey, n_orders FROM supplier s JOIN (SELECT l_suppkey, COUNT(*) AS n_orders FROM lineitem GROUP BY 1) x ON s.s_suppkey = x.l_suppkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_returnflag = 'R')")
def semi_covered(spark, d):
    li = table(spark, d, "lineitem")
    n = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_orders"))
    return table(spark, d, "supplier").select("s_suppkey").join(li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").join(n, "s_suppkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_uncovered(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_type, COUNT(*) AS n_parts, ROUND(MAX(p_retailprice), 2) AS top, ROUND(quantile_cont(p_retailprice, 0.99), 6) AS p99 FROM part GROUP BY p_type")
def thresholds_by_type(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n_parts"), r(F.max("p_retailprice"), 2).alias("top"), r(F.percentile("p_retailprice", 0.99)).alias("p99"))


# Audit


@query(f"""WITH {T}, a AS (SELECT *, first_value(value) OVER w AS f, COUNT(*) OVER p AS k, COALESCE(SUM(COALESCE(value, 0)) OVER p, 0) AS s, COALESCE(SUM(COALESCE(value, 0) * COALESCE(value, 0)) OVER p, 0) AS q,
 MAX(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER w AS bad FROM t WHERE event_id % 17 <> 0
 WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING), p AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, (s + (10 - k) * f) / 10 AS mean, sqrt(greatest((q + (10 - k) * f * f) / 10 - ((s + (10 - k) * f) / 10) * ((s + (10 - k) * f) / 10), 0)) AS dev FROM a)
 SELECT event_id, COALESCE(bad = 0 AND dev >= 1e-6 AND abs(value - mean) / dev > 2.5, FALSE) AS spike FROM b""")
def flag_spike(spark, d):
    return audit.flag_spikes(rows(spark, d).where("value is not null"), "value", BY, ORDER, 10, 2.5).select("event_id", "spike")


@query(f"WITH {T}, v AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE floor(value / 40) END AS x FROM t), a AS (SELECT *, CASE WHEN x = lag(x) OVER ({W}) THEN 0 ELSE 1 END AS c FROM v), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, x IS NOT NULL AND COUNT(*) OVER (PARTITION BY hostname, run) >= 3 AS flatline FROM b")
def flag_flatline(spark, d):
    return audit.flag_flatlines(rows(spark, d).withColumn("x", F.floor(F.col("value") / 40)), "x", BY, ORDER, 3).select("event_id", "flatline")


@query(f"WITH {T}, l AS (SELECT sensor, quantile_cont(value, 0.02) AS p001, quantile_cont(value, 0.98) AS p999 FROM t WHERE hostname LIKE 'rpc-1-%' GROUP BY sensor) SELECT event_id, COALESCE(value < 0 OR value > p999 * 1.05 OR value < p001 * 0.95, FALSE) AS bad_range FROM t JOIN l USING (sensor)")
def flag_bad_range(spark, d):
    limits = rows(spark, d).where(F.col("hostname").startswith("rpc-1-")).groupBy("sensor").agg(F.percentile("value", 0.02).alias("p001"), F.percentile("value", 0.98).alias("p999"))
    return audit.flag_range(rows(spark, d), "value", limits, "sensor").select("event_id", "bad_range")


@query(f"WITH {T}, f AS (SELECT sensor, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN value > 80 THEN 2 ELSE 0 END + CASE WHEN value < 10 THEN 8 ELSE 0 END AS flags FROM t) SELECT sensor, COUNT(*) AS n, COUNT(*) FILTER (flags & 1 > 0) AS n_dup, COUNT(*) FILTER (flags & 2 > 0) AS n_spike, COUNT(*) FILTER (flags & 4 > 0) AS n_flatline, COUNT(*) FILTER (flags & 8 > 0) AS n_bad_range FROM f GROUP BY sensor")
def audit_bitmask_summary(spark, d):
    flagged = rows(spark, d).withColumn("flags", audit.bitmask(dup=F.col("event_id") % 7 == 0, spike=F.col("value") > 80, bad_range=F.col("value") < 10))
    return audit.summary(flagged, ["sensor"])


@query(f"WITH {T}, f AS (SELECT *, (event_id % 16)::INTEGER AS f0, user_idle FROM (SELECT *, sensor = 'view' AS user_idle FROM t)), m AS (SELECT *, CASE WHEN user_idle THEN f0 & 11 WHEN sensor <> 'error' THEN f0 & 13 ELSE f0 END AS flags FROM f) SELECT event_id, CASE WHEN flags & 8 > 0 AND ts <= TIMESTAMP '{TRAIN_END}' THEN NULL ELSE value END AS value, flags, flags > 0 AS audit_any FROM m")
def selective_mask(spark, d):
    f = rows(spark, d).withColumn("flags", (F.col("event_id") % 16).cast("int"))
    out = audit.selective_mask(f, "flags", "value", F.col("sensor") == "view", F.col("sensor") == "error", master.split_of(F.col("ts"), TRAIN_END, VAL_END) == "train")
    return out.select("event_id", "value", "flags", "audit_any")


@query(f"WITH {T}, q AS (SELECT *, value IS NULL AS z FROM t), a AS (SELECT *, CASE WHEN z = lag(z) OVER ({W}) THEN 0 ELSE 1 END AS c FROM q), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, CASE WHEN z THEN row_number() OVER (PARTITION BY hostname, run ORDER BY ts, event_id) ELSE 0 END AS streak, z AND row_number() OVER (PARTITION BY hostname, run ORDER BY ts, event_id) > 1 AS silent FROM b")
def sensor_silence(spark, d):
    return audit.silence(rows(spark, d), "value", F.lit(True), BY, ORDER, 1).select("event_id", "streak", "silent")


# Job timeline


@query(f"WITH {J}, x AS (SELECT host_id, job_id, cpus, unnest(generate_series(date_trunc('day', start_time), date_trunc('day', end_time), INTERVAL 1 DAY)) AS ts FROM j) SELECT host_id, ts, COUNT(*) AS n, SUM(cpus) AS cpus FROM x GROUP BY ALL")
def job_minute_expand(spark, d):
    x = master.expand_jobs(jobs(spark, d), "start_time", "end_time", "1 day", 24 * 60)
    return x.groupBy("host_id", "ts").agg(F.count("*").alias("n"), F.sum("cpus").alias("cpus"))


_ctx = f"WITH {J}, x AS (SELECT DISTINCT host_id, job_id, cpus, unnest(generate_series(date_trunc('day', start_time), date_trunc('day', end_time), INTERVAL 1 DAY)) AS ts FROM j), c AS (SELECT host_id, ts, list(job_id ORDER BY job_id, cpus) AS jl, list(cpus ORDER BY job_id, cpus) AS cl FROM x GROUP BY ALL)"


@query(_ctx + " SELECT host_id, ts, array_to_string(jl, '|') AS jobs, CAST(len(jl) AS BIGINT) AS active_job_count, jl[1] AS primary_job_id, cl[1] AS primary_job_share, list_sum(cl) AS total_job_share, len(jl) > 1 AS is_multi_job FROM c")
def job_context_per_bucket(spark, d):
    c = master.job_contexts(jobs(spark, d), ["host_id"], "job_id", "cpus", "start_time", "end_time", "1 day", 24 * 60)
    return c.select("host_id", "ts", F.array_join(F.transform("jobs", lambda j: j.cast("string")), "|").alias("jobs"), "active_job_count", "primary_job_id", "primary_job_share", "total_job_share", "is_multi_job")


@query(_ctx + " SELECT host_id, job_id, SUM(cpus) AS share FROM x GROUP BY ALL")
def cpu_share_merge(spark, d):
    c = master.job_contexts(jobs(spark, d), ["host_id"], "job_id", "cpus", "start_time", "end_time", "1 day", 24 * 60)
    return master.share_per_job(c, ["host_id"])


@query(f"WITH {T} SELECT CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts <= TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split, sensor, COUNT(*) AS n FROM t GROUP BY ALL")
def split_assign(spark, d):
    return rows(spark, d).groupBy(master.split_of(F.col("ts"), TRAIN_END, VAL_END).alias("split"), "sensor").agg(F.count("*").alias("n"))


_seg = f"WITH {T}, a AS (SELECT *, CASE WHEN sensor IS NOT DISTINCT FROM lag(sensor) OVER w AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS b FROM t WINDOW w AS ({W})), s AS (SELECT *, SUM(b) OVER ({W} ROWS UNBOUNDED PRECEDING) AS seg_id FROM a)"


@query(_seg + " SELECT hostname, CAST(seg_id AS BIGINT) AS seg_id, MIN(ts) AS seg_start, MAX(ts) AS seg_end, COUNT(*) AS n_rows, ROUND(AVG(value), 6) AS v_mean FROM s GROUP BY ALL")
def segment_by_change(spark, d):
    s = master.segments(rows(spark, d), BY, ORDER, ["sensor"], 43200)
    return s.groupBy("hostname", "seg_id").agg(F.min("ts").alias("seg_start"), F.max("ts").alias("seg_end"), F.count("*").alias("n_rows"), r(F.avg("value")).alias("v_mean"))


@query(f"WITH {T}, c AS (SELECT hostname, sensor, COUNT(*) AS n FROM t GROUP BY ALL) SELECT hostname, first(sensor ORDER BY n DESC, sensor) AS mode FROM c GROUP BY hostname")
def segment_mode_split(spark, d):
    return W_.mode_of(rows(spark, d), ["hostname"], "sensor", "mode")


# Features


@query(f"WITH {T} SELECT event_id, ROUND(value - lag(value) OVER w, 6) AS value_roc1, lag(value, 1) OVER w AS value_lag1, lag(value, 5) OVER w AS value_lag5, lag(value, 15) OVER w AS value_lag15 FROM t WINDOW w AS ({W})")
def roc_lag(spark, d):
    out = features.change_and_lags(rows(spark, d), "value", BY, ORDER)
    return out.select("event_id", r("value_roc1").alias("value_roc1"), "value_lag1", "value_lag5", "value_lag15")


_roll = ", ".join(f"CASE WHEN COUNT(value) OVER w{n} >= {max(1, n // 2)} THEN ROUND({f}(value) OVER w{n}, 6) END AS value_r{a}{n}" for n in (5, 15, 60) for f, a in (("AVG", "mean"), ("stddev_samp", "std")))
_wins = "WINDOW " + ", ".join(f"w{n} AS ({W} ROWS {n - 1} PRECEDING)" for n in (5, 15, 60))


@query(f"WITH {T} SELECT event_id, {_roll} FROM t {_wins}")
def rolling_mean_std(spark, d):
    out = features.rolling_features(rows(spark, d), "value", BY, ORDER, (5, 15, 60), (), ())
    return out.select("event_id", *[r(f"value_r{a}{n}").alias(f"value_r{a}{n}") for n in (5, 15, 60) for a in ("mean", "std")])


_rq = ", ".join(f"CASE WHEN COUNT(value) OVER w15 >= 7 THEN ROUND(quantile_cont(value, {q}) OVER w15, 6) END AS value_rp{int(q * 100):02d}_15" for q in (0.05, 0.25, 0.75, 0.95))


@query(f"WITH {T} SELECT event_id, {_rq} FROM t WINDOW w15 AS ({W} ROWS 14 PRECEDING)")
def rolling_quantiles(spark, d):
    out = features.rolling_features(rows(spark, d), "value", BY, ORDER, (), (0.05, 0.25, 0.75, 0.95), (15,))
    return out.select("event_id", *[r(f"value_rp{q}_15").alias(f"value_rp{q}_15") for q in ("05", "25", "75", "95")])


_slope = f"WITH {T}, a AS (SELECT *, row_number() OVER ({W}) AS i, COALESCE(value, 0) AS x FROM t), s AS (SELECT event_id, i, regr_slope(x, i) OVER w AS k, AVG(value) OVER w AS lvl, SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER w AS m FROM a WINDOW w AS ({W} ROWS 11 PRECEDING))"


@query(_slope + " SELECT event_id, CASE WHEN i >= 12 AND m <= 2.4 THEN ROUND(k, 6) END AS slope FROM s")
def rolling_slope_prefix(spark, d):
    return W_.slope(rows(spark, d), "value", BY, ORDER, 12, "slope").select("event_id", r("slope").alias("slope"))


@query(_slope + " SELECT event_id, CASE WHEN i >= 12 AND m <= 2.4 THEN ROUND(k * 12 / NULLIF(abs(lvl), 0), 6) END AS drift FROM s")
def drift_norm(spark, d):
    return features.drift(rows(spark, d), "value", BY, ORDER, 12, "drift").select("event_id", r("drift").alias("drift"))


def _runs(flag: str) -> str:
    return f"WITH {T}, q AS (SELECT *, COALESCE({flag}, FALSE) AS z FROM t), a AS (SELECT *, CASE WHEN z = lag(z) OVER ({W}) THEN 0 ELSE 1 END AS c FROM q), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a), n AS (SELECT *, COUNT(*) OVER (PARTITION BY hostname, run) AS len, row_number() OVER (PARTITION BY hostname, run ORDER BY ts, event_id) AS pos FROM b)"


@query(_runs("value > 40") + " SELECT event_id, len AS busy_len, CASE WHEN z THEN pos ELSE 0 END AS busy_pos FROM n")
def run_length_busy(spark, d):
    return W_.with_runs(rows(spark, d), F.col("value") > 40, BY, ORDER, "busy").select("event_id", "busy_len", "busy_pos")


@query(f"WITH {T}, q AS (SELECT *, value > 20 AS z FROM t), o AS (SELECT *, COALESCE(z, FALSE) AS on_ FROM q), a AS (SELECT *, CASE WHEN on_ AND lag(on_) OVER ({W}) AND sensor = lag(sensor) OVER ({W}) THEN 0 ELSE 1 END AS c FROM o), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, CASE WHEN on_ THEN row_number() OVER (PARTITION BY hostname, run ORDER BY ts, event_id) ELSE 0 END AS job_run FROM b")
def same_job_run(spark, d):
    return features.same_job_run(rows(spark, d), "sensor", F.coalesce(F.col("value") > 20, F.lit(False)), BY, ORDER, "job_run").select("event_id", "job_run")


@query("SELECT event_id, ROUND(sin(2*pi()*(hour(ts) + minute(ts)/60.0)/24), 6) + 0.0 AS hour_sin, ROUND(cos(2*pi()*(hour(ts) + minute(ts)/60.0)/24), 6) + 0.0 AS hour_cos, ROUND(sin(2*pi()*(isodow(ts)-1)/7), 6) + 0.0 AS dow_sin, ROUND(cos(2*pi()*(isodow(ts)-1)/7), 6) + 0.0 AS dow_cos FROM events")
def cyclic_time(spark, d):
    return table(spark, d, "events").select("event_id", *[r(c).alias(n) for n, c in features.cyclic_time(F.col("ts")).items()])


_reg = "CASE WHEN (ts >= '2024-01-08'::TIMESTAMP AND ts < '2024-01-10'::TIMESTAMP) OR (ts >= '2024-01-18'::TIMESTAMP AND ts < '2024-01-19'::TIMESTAMP) THEN -1 ELSE (CASE WHEN ts >= '2024-01-10'::TIMESTAMP THEN 1 ELSE 0 END) + (CASE WHEN ts >= '2024-01-19'::TIMESTAMP THEN 1 ELSE 0 END) END"


@query(f"SELECT event_id, CAST({_reg} AS INTEGER) AS regime, ts BETWEEN '2024-01-08'::TIMESTAMP AND '2024-01-10'::TIMESTAMP OR ts BETWEEN '2024-01-18'::TIMESTAMP AND '2024-01-19'::TIMESTAMP AS maintenance FROM events")
def regime_id(spark, d):
    return table(spark, d, "events").select("event_id", master.regime_id(F.col("ts"), MAINTENANCE).alias("regime"), master.in_maintenance(F.col("ts"), MAINTENANCE).alias("maintenance"))


@query(f"WITH {T}, q AS (SELECT *, {_reg} AS g FROM t), a AS (SELECT *, CASE WHEN g = lag(g) OVER ({W}) THEN 0 ELSE 1 END AS c FROM q), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS blk FROM a) SELECT event_id, CASE WHEN g >= 0 AND COUNT(value) OVER w >= 4 THEN ROUND(AVG(value) OVER w, 6) END AS m FROM b WINDOW w AS (PARTITION BY hostname, blk ORDER BY ts, event_id ROWS 7 PRECEDING)")
def rolling_by_regime(spark, d):
    df = rows(spark, d).withColumn("g", master.regime_id(F.col("ts"), MAINTENANCE))
    return features.by_regime(df, "value", "g", BY, ORDER, 8, "mean", "m").select("event_id", r("m").alias("m"))


def _wide(spark, d):
    return rows(spark, d).select("hostname", "ts", "event_id", "value", (F.col("value") * 2 + F.col("event_id") % 7).alias("other"))


@query(f"WITH {T}, w AS (SELECT hostname, value, value * 2 + event_id % 7 AS other FROM t WHERE ts <= TIMESTAMP '{TRAIN_END}') SELECT hostname, 'value' AS feature, ROUND(AVG(value), 6) AS mean, ROUND(stddev_samp(value), 6) AS std, COUNT(value) AS n FROM w GROUP BY hostname UNION ALL SELECT hostname, 'other', ROUND(AVG(other), 6), ROUND(stddev_samp(other), 6), COUNT(other) FROM w GROUP BY hostname")
def norm_stats_clean(spark, d):
    s = features.norm_stats(_wide(spark, d), ["value", "other"], "hostname", F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz"))
    return s.select("hostname", "feature", r("mean").alias("mean"), r("std").alias("std"), "n")


@query(f"WITH {T}, s AS (SELECT hostname, AVG(value) AS m, stddev_samp(value) AS sd FROM t WHERE ts <= TIMESTAMP '{TRAIN_END}' GROUP BY hostname) SELECT event_id, ROUND(greatest(least((value - m) / CASE WHEN sd >= 1e-3 THEN sd ELSE 1 END, 10), -10), 6) AS value_norm FROM t LEFT JOIN s USING (hostname)".replace("ROUND(greatest(least(", "CASE WHEN value IS NOT NULL AND m IS NOT NULL THEN ROUND(greatest(least(").replace("-10), 6) AS", "-10), 6) END AS"))
def zscore_normalize(spark, d):
    s = features.norm_stats(_wide(spark, d), ["value"], "hostname", F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz"))
    out = features.normalise(_wide(spark, d), s, "hostname", "value")
    return out.select("event_id", F.when(F.col("value").isNotNull() , r("value_norm")).alias("value_norm"))


@query(f"WITH {J} SELECT job_id, task, CAST(CASE WHEN cpus < 4 THEN 0 WHEN host_id % 25 = 0 THEN 4 WHEN task = 7 THEN 2 WHEN cpus <= 16 THEN 1 WHEN cpus <= 64 THEN 2 ELSE 3 END AS INTEGER) AS power_class FROM j")
def power_class(spark, d):
    j = jobs(spark, d)
    return j.select("job_id", "task", features.power_class(F.col("cpus") >= 4, F.when(F.col("task") != 7, F.col("cpus")), F.col("host_id") % 25 == 0).alias("power_class"))


@query("WITH e AS (SELECT s_nationkey AS rack, l_shipdate AS ts, l_suppkey, SUM(l_quantity) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT rack, ts, ROUND(SUM(s), 6) AS rack_sum, ROUND(AVG(s), 6) AS rack_mean, ROUND(sqrt(AVG(s * s)), 6) AS rack_rms, COUNT(*) AS outlets FROM e GROUP BY ALL")
def rack_power_features(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("rack"))
    li = table(spark, d, "lineitem").join(F.broadcast(s) if s.count() < 100_000 else s, "l_suppkey").withColumn("ts", F.col("l_shipdate"))
    return features.rack_features(li, ["rack", "ts"], "l_suppkey", "l_quantity").select("rack", "ts", r("rack_sum").alias("rack_sum"), r("rack_mean").alias("rack_mean"), r("rack_rms").alias("rack_rms"), "outlets")


# Detectors


@query(f"WITH {T}, c AS (SELECT * FROM t WHERE ts <= TIMESTAMP '{TRAIN_END}') SELECT hostname, ROUND(greatest(90.0, 1.1 * quantile_cont(value, 0.995)), 6) AS threshold FROM c GROUP BY hostname".replace("1.1 * quantile_cont(value, 0.995)", "COALESCE(1.1 * quantile_cont(value, 0.995), 90.0)"))
def rule_threshold_host_floor(spark, d):
    t = detectors.host_thresholds(rows(spark, d), "hostname", ["value"], 90.0, F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz"))
    return t.select("hostname", r("threshold").alias("threshold"))


@query(_runs("value > 30") + " SELECT event_id, z AND len >= 3 AS hot FROM n")
def rule_persist(spark, d):
    return W_.persistent(rows(spark, d), F.col("value") > 30, BY, ORDER, 3, "hot").select("event_id", "hot")


@query(f"WITH {T}, m AS (SELECT *, CASE WHEN COUNT(value) OVER w >= 6 THEN quantile_cont(value * 10, 0.5) OVER w END AS med FROM t WINDOW w AS ({W} ROWS 19 PRECEDING)) SELECT event_id, COALESCE(value * 10 < 0.5 * med AND med > 100 AND value * 10 < 400, FALSE) AS fan_drop FROM m")
def rule_fan_pct_drop(spark, d):
    df = rows(spark, d).withColumn("rpm", F.col("value") * 10)
    return detectors.drop_below_median(df, "rpm", BY, ORDER, 20, 6, 0.5, 400, "fan_drop").select("event_id", "fan_drop")


@query(f"WITH {T}, m AS (SELECT *, CASE WHEN COUNT(CASE WHEN sensor IN ('view','click') THEN value END) OVER w >= 4 THEN quantile_cont(CASE WHEN sensor IN ('view','click') THEN value END, 0.5) OVER w END AS med FROM t WINDOW w AS ({W} ROWS 29 PRECEDING)), q AS (SELECT *, COALESCE(sensor IN ('view','click') AND value > med + 5, FALSE) AS z FROM m), a AS (SELECT *, CASE WHEN z = lag(z) OVER ({W}) THEN 0 ELSE 1 END AS c FROM q), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, z AND COUNT(*) OVER (PARTITION BY hostname, run) >= 2 AS surge FROM b")
def rule_idle_surge(spark, d):
    return detectors.idle_surge(rows(spark, d), "value", F.col("sensor").isin("view", "click"), BY, ORDER, 30, 4, 5.0, 2, "surge").select("event_id", "surge")


@query(f"WITH {T}, m AS (SELECT *, CASE WHEN COUNT(value) OVER w >= 3 THEN stddev_samp(value) OVER w END AS s, CASE WHEN COUNT(value) OVER p >= 4 THEN stddev_samp(value) OVER p END AS o FROM t WINDOW w AS ({W} ROWS 3 PRECEDING), p AS ({W} ROWS BETWEEN 19 PRECEDING AND 4 PRECEDING)), q AS (SELECT *, COALESCE(s < 0.5 * o AND o > 1, FALSE) AS z FROM m), a AS (SELECT *, CASE WHEN z = lag(z) OVER ({W}) THEN 0 ELSE 1 END AS c FROM q), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, z AND COUNT(*) OVER (PARTITION BY hostname, run) >= 2 AS flat FROM b")
def rule_flatline_std(spark, d):
    return detectors.flat_against_past(rows(spark, d), "value", BY, ORDER, 4, 3, 16, 4, 0.5, 1.0, 2, "flat").select("event_id", "flat")


@query(_runs("(value IS NULL)::INT + (value IS NULL OR value < 30)::INT >= 2 OR FALSE").replace("COALESCE((value IS NULL)::INT", "COALESCE((value IS NULL)::INT") + " SELECT event_id, z AND len >= 1 AS dropout FROM n")
def rule_dropout_families(spark, d):
    df = rows(spark, d).withColumn("other", F.when(F.col("value") >= 30, F.col("value")))
    return detectors.dropout(df, ["value", "other"], BY, ORDER, 2, 1, "dropout").select("event_id", "dropout")


@query(f"WITH {T}, f AS (SELECT event_id, COALESCE(value > 80, FALSE) AS hot, COALESCE(value < 15 AND value > 0, FALSE) AS cold, value IS NULL AS gone FROM t) SELECT event_id, hot::BIGINT + cold::BIGINT + gone::BIGINT AS flag_count, hot OR cold OR gone AS is_flagged, concat_ws('|', CASE WHEN hot THEN 'hot' END, CASE WHEN cold THEN 'cold' END, CASE WHEN gone THEN 'gone' END) AS triggered_rules FROM f")
def rules_triggered(spark, d):
    df = rows(spark, d).withColumns({"hot": F.col("value") > 80, "cold": (F.col("value") < 15) & (F.col("value") > 0), "gone": F.col("value").isNull()})
    return detectors.triggered(df, ["hot", "cold", "gone"]).select("event_id", "flag_count", "is_flagged", "triggered_rules")


_z = f"WITH {T}, w AS (SELECT *, value * 2 + event_id % 7 AS other FROM t), s AS (SELECT hostname, AVG(value) AS mv, stddev_samp(value) AS sv, COUNT(value) AS nv, AVG(other) AS mo, stddev_samp(other) AS so, COUNT(other) AS no FROM w WHERE ts <= TIMESTAMP '{VAL_END}' GROUP BY hostname)"


@query(_z + f", q AS (SELECT w.*, COALESCE(CASE WHEN nv >= 5 AND sv >= 1e-6 THEN abs(value - mv) / sv END, 0) AS zv, COALESCE(CASE WHEN no >= 5 AND so >= 1e-6 THEN abs(other - mo) / so END, 0) AS zo FROM w LEFT JOIN s USING (hostname)), f AS (SELECT *, greatest(zv, zo) AS mz, (zv > 0.8)::BIGINT + (zo > 0.8)::BIGINT AS nh FROM q), k AS (SELECT *, nh >= 2 AND mz > 1.0 AS z FROM f), a AS (SELECT *, CASE WHEN z = lag(z) OVER ({W}) THEN 0 ELSE 1 END AS c FROM k), b AS (SELECT *, SUM(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, ROUND(mz, 6) AS max_z, nh AS n_high, z AND COUNT(*) OVER (PARTITION BY hostname, run) >= 2 AS is_flagged FROM b")
def zscore_detector(spark, d):
    out = detectors.zscore_detector(_wide(spark, d), ["value", "other"], "hostname", ORDER, F.col("ts") <= F.lit(VAL_END).cast("timestamp_ntz"), 0.8, 1.0, 2, 2, None, 5)
    return out.select("event_id", r("max_z").alias("max_z"), "n_high", "is_flagged")


@query(f"WITH RECURSIVE {T}, o AS (SELECT *, row_number() OVER ({W}) AS i FROM t), e AS (SELECT hostname, i, event_id, COALESCE(value, 0.0) AS num, CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END AS den FROM o WHERE i = 1 UNION ALL SELECT o.hostname, o.i, o.event_id, e.num * (1 - 2.0/31) + COALESCE(o.value, 0.0), CAST(e.den * (1 - 2.0/31) + CASE WHEN o.value IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) FROM e JOIN o ON o.hostname = e.hostname AND o.i = e.i + 1) SELECT event_id, CASE WHEN den > 0 THEN ROUND(num / den, 6) END AS ewma FROM e".replace("THEN 0.0 ELSE 1.0 END AS den FROM o WHERE", "THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS den FROM o WHERE"))
def ewma_detector(spark, d):
    return W_.ewma(rows(spark, d), "value", BY, ORDER, 30, "ewma").select("event_id", r("ewma").alias("ewma"))


@query("WITH c AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.95) AS p, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1) SELECT l_suppkey, ROUND(p, 6) AS threshold FROM c WHERE n >= 10")
def pdu_p95(spark, d):
    t = detectors.outlet_thresholds(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", F.col("l_shipdate") <= F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    return t.select("l_suppkey", r("threshold").alias("threshold"))


@query(f"WITH {T}, s AS (SELECT event_id, hostname, date_trunc('hour', ts) AS ts, value FROM t WHERE value IS NOT NULL), m AS (SELECT ts, quantile_cont(value, 0.5) AS m FROM s GROUP BY ts), l AS (SELECT ts, COALESCE(CASE WHEN COUNT(m) OVER w >= 5 THEN quantile_cont(m, 0.5) OVER w END, quantile_cont(m, 0.5) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS lvl FROM m WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW)) SELECT event_id, ROUND(value - lvl, 6) AS rel, value - lvl > 0.2 AS is_anomaly_rel FROM s JOIN l USING (ts)")
def cluster_relative(spark, d):
    s = rows(spark, d).where("value is not null").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).select("event_id", "hostname", "ts", "value")
    return detectors.fleet_relative(s, "hostname", "ts", "value", 6).select("event_id", r("rel").alias("rel"), "is_anomaly_rel")


@query(_z.replace("AVG(value) AS mv", "AVG(value) AS mv") + ", q AS (SELECT w.event_id, abs(COALESCE(value, 0) - mv) / greatest(sv, 1e-3) AS zv, abs(COALESCE(other, 0) - mo) / greatest(so, 1e-3) AS zo FROM w JOIN s USING (hostname)) SELECT event_id, CASE WHEN least(zo, 50) >= least(zv, 50) THEN 'other' ELSE 'value' END AS top1 FROM q WHERE zo IS NOT NULL AND zv IS NOT NULL AND abs(zo - zv) > 1e-9")
def top3_features(spark, d):
    cut = F.col("ts") <= F.lit(VAL_END).cast("timestamp_ntz")
    s = features.norm_stats(_wide(spark, d), ["value", "other"], "hostname", cut)
    wide = s.groupBy("hostname").agg(*[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for f in ("value", "other") for c in ("mean", "std")])
    out = detectors.top_features(_wide(spark, d), ["value", "other"], s, "hostname", 1).join(wide, "hostname")
    z = {f: F.abs(F.coalesce(F.col(f), F.lit(0.0)) - F.col(f"mean_{f}")) / F.greatest(f"std_{f}", F.lit(1e-3)) for f in ("value", "other")}
    return out.where(z["value"].isNotNull() & z["other"].isNotNull() & (F.abs(z["other"] - z["value"]) > 1e-9)).select("event_id", F.element_at("top", 1).alias("top1"))


@query()
def iforest_score(spark, d):
    out = learn.isolation_scores(_wide(spark, d), ["value", "other"], "event_id", "hostname", 0.02)
    return out.select("event_id", "hostname", "if_raw", "if_anomaly_score", "if_is_anomaly")


@query()
def pca_recon(spark, d):
    df = _wide(spark, d).withColumn("hour", F.hour("ts").cast("double"))
    return learn.linear_autoencoder(df, ["value", "other", "hour"], "event_id", 1).select("event_id", "recon_error")


@query(f"WITH {T}, o AS (SELECT hostname, row_number() OVER ({W}) AS i, COALESCE(value, 0.0) AS x FROM t), w AS (SELECT hostname, i, list(x) OVER (PARTITION BY hostname ORDER BY i ROWS 9 PRECEDING) AS l FROM o) SELECT hostname, i AS end_row, ROUND(list_sum(l), 6) AS total FROM w WHERE i >= 10 AND (i - 10) % 5 = 0")
def sliding_windows(spark, d):
    w = learn.sliding_windows(rows(spark, d), BY, ORDER, "value", 10, 5)
    return w.select("hostname", "end_row", r(F.aggregate("window", F.lit(0.0), lambda a, x: a + x)).alias("total"))
