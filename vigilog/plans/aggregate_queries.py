"""Queries of aggregates, orders and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.functions import common
from vigilog.functions.signatures import DETECTORS
from vigilog.operators import aggregates, events, flows, reports, sessions, topk
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.function_queries import _ADMIN, _LOLBIN, _NORMAL, _NUMBER, normalized
from vigilog.plans.join_queries import _SCORES, _SESSION, sequence, statistical
from vigilog.plans.registry import query
from vigilog.plans.signature_queries import PLANTED, planted
from vigilog.plans.window_queries import _GAPS, _RUNS, web_runs, web_sessions
from vigilog.sources import writers
from vigilog.sources.storage import shared_path

_DAY = 86_400_000_000
_FLAGGED = f"""{_NORMAL}, masked AS (SELECT *, {_NUMBER} AS m, {_LOLBIN} AS is_lolbin, {_ADMIN} AS is_admin, EventID IN (4656, 4660, 4663, 5140, 5145) AS carries FROM norm)"""
_FEATURES = f"""{_FLAGGED}, feats AS (SELECT "SubjectUserName" AS "user", us // {_DAY} * {_DAY} AS window_us,
CAST(count(*) FILTER (carries AND (m & 1) <> 0) AS BIGINT) AS total_read_operations, count(*) FILTER (carries AND (m & 2) <> 0) + count(*) FILTER (carries AND (m & 4) <> 0) AS total_write_operations,
count(*) FILTER (carries AND (m & 65536) <> 0) AS total_delete_operations, count(*) AS total_events,
round(count(*) FILTER (carries AND (m & 1) <> 0) / (count(*) FILTER (carries AND (m & 2) <> 0) + count(*) FILTER (carries AND (m & 4) <> 0) + 1), 4) AS read_write_ratio,
count(DISTINCT "ObjectName") AS distinct_files_accessed,
len(list_distinct(list_concat(coalesce(list("ProcessName") FILTER ("ProcessName" <> ''), []), coalesce(list("NewProcessName") FILTER ("NewProcessName" <> ''), [])))) AS distinct_processes_used,
count(*) FILTER (is_admin) AS admin_share_access_count, count(*) FILTER (is_lolbin) AS lolbin_event_count,
round(count(*) FILTER (NOT hour("TimeCreated") BETWEEN 8 AND 17) / count(*), 4) AS off_hour_activity_ratio,
round(sin(2 * pi() * median(hour("TimeCreated")) / 24), 4) AS hour_sin, round(cos(2 * pi() * median(hour("TimeCreated")) / 24), 4) AS hour_cos,
count(*) FILTER (EventID = 4624) AS successful_logon_count, count(*) FILTER (EventID = 4625) AS failed_logon_count,
round(coalesce(count(*) FILTER (EventID = 4625) / nullif(count(*) FILTER (EventID IN (4624, 4625)), 0), 0), 4) AS failed_logon_ratio,
count(DISTINCT "IpAddress") FILTER (EventID IN (4624, 4625) AND "IpAddress" NOT IN ('', 'local', '-')) AS distinct_logon_source_ips,
count(*) FILTER (EventID = 4648) AS explicit_credential_count, count(*) FILTER (EventID = 4688) AS new_process_count, count(*) FILTER (EventID = 4688 AND is_lolbin) AS suspicious_process_count,
count(DISTINCT "ParentProcessName") FILTER (EventID = 4688 AND "ParentProcessName" <> '') AS distinct_parent_processes, count(*) FILTER (EventID = 4698) AS scheduled_task_created_count,
count(*) FILTER (EventID = 7045) AS service_installed_count, count(*) FILTER (EventID = 1102) AS audit_log_cleared_count, count(*) FILTER (EventID = 4660) AS object_deleted_count,
count(*) FILTER (EventID = 5140) AS share_session_count, count(DISTINCT "ShareName") FILTER (EventID = 5140 AND "ShareName" <> '') AS distinct_shares_accessed FROM masked GROUP BY ALL)"""


def ueba(spark: SparkSession, sf_dir: str, window: str = "1 day") -> DataFrame:
    found = events.ueba_window_features(events.flag_events(normalized(spark, sf_dir)), window=window)
    return found.withColumn("window_us", common.micros(F.col("window_start"))).drop("window_start")


@query(f"{_FEATURES} SELECT * FROM feats")
def a1_ueba_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ueba(spark, sf_dir)


_HOSTS = f"""{cte("flows")}, hosts AS (SELECT source_ip, count(*) AS total_flows, count(*) FILTER (score < 0) AS anomaly_flows, avg(score) AS mean_score, min(score) AS min_score, count(DISTINCT destination_ip) AS unique_dest,
CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(bytes_received) AS BIGINT) AS bytes_received, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us, count(*) FILTER (score < 0) / count(*) AS anomaly_ratio FROM flows GROUP BY source_ip),
ends AS (SELECT min(anomaly_ratio) AS lo, max(anomaly_ratio) AS hi, max(anomaly_flows) AS most FROM hosts),
risky AS (SELECT *, 0.7 * ((anomaly_ratio - lo) / (hi - lo + 1e-6)) + 0.3 * (anomaly_flows / (most + 1e-6)) AS risk_score FROM hosts, ends)"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.host_behavior_summary(adapter(spark, sf_dir, "flows"))


@query(f"{_HOSTS} SELECT source_ip, total_flows, anomaly_flows, round(mean_score, 6) AS mean_score, min_score, unique_dest, bytes_sent, bytes_received, first_seen_us, last_seen_us, (last_seen_us - first_seen_us) / 1e6 AS active_duration, anomaly_ratio FROM hosts")
def a2_host_behavior_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).withColumn("mean_score", F.round("mean_score", 6))


@query(f"{_HOSTS}, q AS (SELECT quantile_cont(risk_score, 0.9) AS q FROM risky) SELECT source_ip, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= q THEN 1 ELSE 0 END AS apt_flag FROM risky, q")
def a3_host_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.host_risk_score(hosts(spark, sf_dir)).select("source_ip", F.round("risk_score", 6).alias("risk_score"), "apt_flag")


@query(f"""{_HOSTS}, q AS (SELECT quantile_cont(risk_score, 0.9) AS q FROM risky)
SELECT flow_id, flows.source_ip, bytes, total_flows, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= q THEN 1 ELSE 0 END AS apt_flag FROM flows JOIN risky USING (source_ip), q WHERE score < 0""")
def s11_anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it is written and read back."""
    report, path = flows.anomaly_report(adapter(spark, sf_dir, "flows"), flows.host_risk_score(hosts(spark, sf_dir))), shared_path(spark, "report")
    writers.write_report(report, path)
    return spark.read.schema(report.schema).json(path).select("flow_id", "flow.source_ip", "flow.bytes", "host.total_flows", "host.risk_score", "host.apt_flag")


@query(f"""{_HOSTS}, q AS (SELECT quantile_cont(risk_score, 0.9) AS q FROM risky)
SELECT (SELECT count(*) FROM flows) AS total_flows, (SELECT count(*) FROM flows WHERE score < 0) AS anomalous_flows, count(*) AS hosts, count(*) FILTER (hosts.anomaly_flows > 0) AS anomalous_hosts, count(*) FILTER (risk_score >= q) AS flagged_hosts
FROM hosts JOIN risky USING (source_ip), q""")
def s11_report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.report_metadata(adapter(spark, sf_dir, "flows"), flows.host_risk_score(hosts(spark, sf_dir)))


_EXT = "CASE WHEN contains(uri_path, '.') THEN '.' || lower(split_part(uri_path, '.', -1)) ELSE '' END"


@query(f"""{_GAPS}, p AS (SELECT *, us - lag(us) OVER (PARTITION BY source_ip, session_seq ORDER BY us, event_id) AS idle, {_EXT} AS ext FROM sess)
SELECT source_ip, session_seq, min(us) AS start_us, (max(us) - min(us) + 5000) // 10000 / 100 AS session_duration_sec, count(*) AS total_requests,
round(count(*) / (greatest((max(us) - min(us)) / 1000000, 1.0) / 60), 2) AS req_per_min, (coalesce(min(idle), 0) + 50) // 100 / 10000 AS min_interarrival_sec, round(sum(length(uri_path) - length(replace(uri_path, '/', ''))) / count(*), 2) AS avg_uri_depth,
round(count(*) FILTER (status_code = 404) / count(*), 4) AS error_404_rate, round(count(*) FILTER (status_code = 403) / count(*), 4) AS error_403_rate, round(count(*) FILTER (status_code >= 500) / count(*), 4) AS error_50x_rate,
round(count(*) FILTER (http_method = 'POST') / count(*), 4) AS post_rate, round(count(*) FILTER (http_method NOT IN ('GET', 'POST', 'HEAD')) / count(*), 4) AS rare_method_rate, round(count(DISTINCT uri_path) / count(*), 4) AS unique_path_ratio,
round(count(*) FILTER (ext IN ('.png', '.jpg', '.jpeg', '.gif', '.css', '.js', '.ico', '.woff', '.woff2', '.svg')) / count(*), 4) AS static_asset_ratio,
round(count(*) FILTER (ext IN ('.bak', '.sql', '.env', '.old', '.log', '.git', '.sh', '.zip', '.inc', '.php')) / count(*), 4) AS suspicious_ext_rate,
count(DISTINCT status_code) AS status_diversity, count(DISTINCT user_agent) AS unique_uas, round(sum(bytes_sent) / count(*), 2) AS avg_payload_bytes, max(bytes_sent) AS max_resp_bytes, count(*) FILTER (flagged) AS l1_alert_count,
coalesce(array_to_string(list_sort(list_distinct(list(alert) FILTER (alert IS NOT NULL))), '|'), '') AS l1_alert_types,
CASE WHEN hour(make_timestamp(min(us))) < 6 OR hour(make_timestamp(min(us))) > 18 THEN 1 ELSE 0 END AS is_off_hours FROM p GROUP BY source_ip, session_seq""")
def a4_session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_features(web_sessions(spark, sf_dir), _SESSION)


@query(f"""{cte("turns")} SELECT session_id, count(*) AS session_event_count, count(DISTINCT apt_phase) AS session_phase_count, count(*) FILTER (severity <> 'NORMAL') AS session_attack_count, min(us) AS session_start_us, max(us) AS session_end_us,
(max(us) - min(us)) / 1e6 AS session_duration_sec FROM turns GROUP BY session_id""")
def a5_timeline_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.timeline_session_stats(adapter(spark, sf_dir, "turns"))


@query(f"""{cte("turns")}, f AS (SELECT session_id, apt_phase, min(us) AS t0, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'WARNING') AS w, max(us) AS hi,
CASE apt_phase WHEN 'reconnaissance' THEN 0 WHEN 'initial_access' THEN 1 WHEN 'execution' THEN 2 ELSE 5 END AS rank FROM turns GROUP BY ALL),
p AS (SELECT *, rank > lag(rank) OVER (PARTITION BY session_id ORDER BY t0) AS forward FROM f),
g AS (SELECT session_id, min(t0) AS start_us, max(hi) AS end_us, string_agg(apt_phase, ' → ' ORDER BY t0) AS phases_observed, count(*) AS phase_count, round(count(*) FILTER (forward) / (count(*) - 1), 3) AS apt_score,
CAST(sum(n) AS BIGINT) AS event_count, CAST(sum(c) AS BIGINT) AS critical_count, CAST(sum(w) AS BIGINT) AS warning_count FROM p GROUP BY session_id HAVING count(*) >= 2)
SELECT *, (end_us - start_us) / 1e6 AS duration_sec FROM g WHERE apt_score > 0 OR critical_count > 0""")
def a6_kill_chain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.kill_chain_candidates(adapter(spark, sf_dir, "turns"))


_CASES = f"""{_SCORES}, f AS (SELECT source_ip || '_' || CAST(session_seq AS STRING) AS session_id, session_seq, bool_or(flagged) AS has_alert, count(*) AS total_requests, max(bytes_sent) AS max_resp_bytes, 's' || CAST(session_seq AS STRING) AS sequence_summary FROM sess GROUP BY ALL),
cases AS (SELECT parent_tracking_id AS incident_tracking_id, max(statistical_threat_score) AS max_statistical_score, max(markov_threat_score) AS max_markov_score, CAST(max(max_resp_bytes) AS DOUBLE) AS max_resp_bytes,
bool_or(has_alert) AS has_alert, CAST(sum(total_requests) AS BIGINT) AS total_raw_events, string_agg(sequence_summary, ' | ' ORDER BY session_seq) AS sequence_chain FROM a JOIN b USING (session_id, parent_tracking_id) LEFT JOIN f USING (session_id) GROUP BY ALL),
levels AS (SELECT *, CASE WHEN has_alert OR greatest(max_statistical_score, max_markov_score) >= 80 THEN 'CRITICAL' WHEN greatest(max_statistical_score, max_markov_score) >= 50 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS overall_threat_level FROM cases)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilog.operators import joins

    df = web_sessions(spark, sf_dir)
    features = df.groupBy(F.concat_ws("_", "source_ip", F.col("session_seq").cast("string")).alias("session_id"), "session_seq").agg(
        F.bool_or("flagged").alias("has_alert"), F.count("*").alias("total_requests"), F.max("bytes_sent").alias("max_resp_bytes")
    )
    scored = joins.attach_features(joins.merge_scores(statistical(spark, sf_dir), sequence(spark, sf_dir)), features)
    return aggregates.correlate_incidents(scored.withColumn("sequence_summary", F.concat(F.lit("s"), F.col("session_seq").cast("string"))), "parent_tracking_id", "session_seq", ["max_resp_bytes"])


@query(f"{_CASES} SELECT *, incident_tracking_id AS source_ip FROM levels")
def a7_correlate_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir)


@query(f"{_CASES} SELECT incident_tracking_id, overall_threat_level, max_statistical_score, max_markov_score, max_resp_bytes, total_raw_events FROM levels WHERE overall_threat_level <> 'NORMAL'")
def p22_flatten_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flatten_incidents(incidents(spark, sf_dir), ["max_resp_bytes"])


@query(f"""{_RUNS}, flags AS (SELECT event_id, flagged, alert, status_code FROM web)
SELECT c.event_id, CASE WHEN is_run THEN 'bulk' WHEN flagged THEN 'alert: ' || alert WHEN status_code >= 400 THEN 'error' ELSE 'normal' END AS kind FROM compressed c JOIN flags USING (event_id)""")
def p24_label_timeline_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = web_runs(spark, sf_dir).join(adapter(spark, sf_dir, "web").select("event_id", "flagged", "alert", "status_code"), "event_id")
    return joined.select("event_id", reports.event_kind(*map(F.col, ("is_run", "flagged", "alert", "status_code"))).alias("kind"))


@query(f"""{_NORMAL}, b AS (SELECT "EventCategory", EventID, count(*) AS events, count(DISTINCT "SubjectUserName") AS users, min(us) AS first_us, max(us) AS last_us FROM norm GROUP BY GROUPING SETS (("EventCategory"), ("EventCategory", EventID), ()))
SELECT *, round(events / (SELECT count(*) FROM norm) * 100, 2) AS percent FROM b""")
def a8_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.category_breakdown(normalized(spark, sf_dir))


@query(f"""{_CASES} SELECT overall_threat_level AS name, 'incidents' AS metric, count(*) AS n FROM levels GROUP BY 1 UNION ALL SELECT alert, 'alerts', count(*) FROM web WHERE alert IS NOT NULL GROUP BY 1
UNION ALL SELECT source_ip, 'events', count(*) FROM web GROUP BY 1 UNION ALL SELECT uri_path, 'uris', count(*) FROM web WHERE flagged GROUP BY 1""")
def a9_dashboard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard_metrics(incidents(spark, sf_dir), adapter(spark, sf_dir, "web"))


_METRICS = f"{cte('scored')}, c AS (SELECT count(*) FILTER (score >= 60 AND truth = 1) AS tp, count(*) FILTER (score >= 60 AND truth = 0) AS fp, count(*) FILTER (score < 60 AND truth = 0) AS tn, count(*) FILTER (score < 60 AND truth = 1) AS fn FROM scored)"


@query(f"""{_METRICS} SELECT tp, fp, tn, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tn / (tn + fn), 4) AS normal_precision,
round(tn / (tn + fp), 4) AS normal_recall, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(fp / (fp + tn), 4) AS fpr, round(fn / (fn + tp), 4) AS fnr FROM c""")
def a10_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.confusion_metrics(adapter(spark, sf_dir, "scored"), (F.col("score") >= 60).cast("int"), F.col("truth"))


_CURVE = f"""{cte("scored")}, g AS (SELECT score, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM scored GROUP BY score),
curve AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS positives, sum(n) OVER () AS negatives, p, n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"{_CURVE} SELECT round(sum(n * (tp + tp - p) / 2) / max(positives * negatives), 6) AS roc_auc, round(sum(p * (tp / (tp + fp))) / max(positives), 6) AS pr_auc FROM curve")
def a11_roc_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.roc_pr_auc(aggregates.score_curve(adapter(spark, sf_dir, "scored"), "score", "truth"))


@query(f"""{cte("scored")}, t AS (SELECT unnest([40, 50, 60, 70, 80, 90]) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp,
count(*) FILTER (score < threshold AND truth = 1) AS fn, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM scored, t GROUP BY threshold) SELECT threshold, tp, fp, fn, round(tp / p, 6) AS recall, round(fp / n, 6) AS fpr FROM c""")
def a12_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.threshold_sweep(adapter(spark, sf_dir, "scored"), "score", "truth")


@query(f"{_CURVE} SELECT min(score) AS threshold, round(max(tp / positives), 6) AS recall FROM curve WHERE fp <= 0.05 * negatives")
def a13_threshold_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.threshold_at_fpr(aggregates.score_curve(adapter(spark, sf_dir, "scored"), "score", "truth"), 0.05)


@query(f"{cte('scored')} SELECT count(*) FILTER (detector_a) AS by_model, count(*) FILTER (detector_b) AS by_whitelist, count(*) FILTER (detector_a AND detector_b) AS both_found, count(*) FILTER (detector_b AND NOT detector_a) AS whitelist_only FROM scored")
def a14_detection_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detection_sources(adapter(spark, sf_dir, "scored"), F.col("detector_a"), F.col("detector_b"))


@query(f"{cte('turns')} SELECT severity, apt_phase, count(*) AS n FROM turns WHERE severity <> 'NORMAL' GROUP BY GROUPING SETS ((severity), (apt_phase))")
def a15_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detection_summary(adapter(spark, sf_dir, "turns"))


@query(f"{cte('web')} SELECT count(*) AS processed, count(*) FILTER (flagged) AS flagged_events, round(count(*) FILTER (flagged) / count(*) * 100, 4) AS flagged_percent FROM web")
def a16_layer1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.layer1_stats(adapter(spark, sf_dir, "web"))


@query(f"{_RUNS} SELECT CAST(sum(count) AS BIGINT) AS raw_events, count(*) AS compressed_events, round((sum(count) - count(*)) / sum(count), 6) AS rate FROM compressed")
def a17_compression_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compression_rate(web_runs(spark, sf_dir))


@query(f"""{cte("flows")}, s AS (SELECT avg(bytes) AS m, stddev_pop(bytes) AS d, min(packets) AS lo, max(packets) AS hi FROM flows WHERE flow_id % 2 = 0)
SELECT flow_id, round((bytes - m) / d, 6) AS bytes_z, round(least(greatest((packets - lo) / (hi - lo) * 100, 0), 100), 6) AS packets_scaled FROM flows, s""")
def a18_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "flows").select("flow_id", F.col("bytes").cast("double"), F.col("packets").cast("double"))
    train = df.filter("flow_id % 2 = 0")
    z = aggregates.scale(df, aggregates.standard_scaler(train, ["bytes"]), ["bytes"])
    both = aggregates.scale(z, aggregates.standard_scaler(train, ["packets"]), ["packets"], kind="min_max")
    return both.select("flow_id", F.round("bytes", 6).alias("bytes_z"), F.round("packets", 6).alias("packets_scaled"))


_ITEMS = "SELECT doc_id % 97 AS message, CASE WHEN doc_id % 2 = 0 THEN 'url' ELSE 'attachment' END AS kind, CAST(n_chars % 13 AS INT) AS engines, CAST(doc_id % 3 AS INT) AS signature_hits, CAST(doc_id % 5 AS DOUBLE) / 2 AS sandbox_score FROM documents"


@query(f"""WITH i AS ({_ITEMS}), s AS (SELECT message, least(engines * 5, 50) + CASE WHEN kind = 'attachment' AND signature_hits > 0 THEN 60 ELSE 0 END + CASE WHEN kind = 'attachment' THEN CAST(floor(sandbox_score * 10) AS INT) ELSE 0 END AS p FROM i)
SELECT message, CAST(sum(p) AS BIGINT) AS final_score, count(*) FILTER (p > 0) AS n_reasons, CASE WHEN sum(p) >= 50 THEN 'REJECT' WHEN sum(p) >= 20 THEN 'QUARANTINE' ELSE 'ACCEPT' END AS recommended_action FROM s GROUP BY message""")
def a19_email_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _ITEMS.removeprefix("SELECT ").removesuffix(" FROM documents").split(", ")
    return aggregates.email_risk_score(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*columns), "message")


_WINDOWS = f"{_FEATURES}, scored AS (SELECT \"user\", window_us, CAST(total_events * 10 + failed_logon_count AS DOUBLE) AS score, total_events >= 4 AS is_anomaly FROM feats)"


def _scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ueba(spark, sf_dir).select("user", "window_us", (F.col("total_events") * 10 + F.col("failed_logon_count")).cast("double").alias("score"), (F.col("total_events") >= 4).alias("is_anomaly"))


@query(f"{_WINDOWS} SELECT \"user\", count(*) AS windows, count(*) FILTER (is_anomaly) AS anomalies, round(avg(score), 4) AS mean_score, max(score) AS max_score, round(count(*) FILTER (is_anomaly) / count(*), 4) AS rate FROM scored GROUP BY ROLLUP (\"user\")")
def a20_anomaly_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.rollup_summary(_scored_windows(spark, sf_dir))


_TAGS = ("SQLi", "XSS", "RCE", "LFI", "SSRF", "PROTOCOL")


@query(f"""WITH u AS (SELECT DISTINCT p.payload, p.tags FROM events, (SELECT unnest([{", ".join(str(i) for i in range(len(PLANTED)))}]) AS i, unnest([{", ".join("'" + x[0].replace("'", "''") + "'" for x in PLANTED)}]) AS payload, unnest([{", ".join(f"'{x[1]}'" for x in PLANTED)}]) AS tags) p WHERE event_id % {len(PLANTED)} = i),
l AS (SELECT d.detector, list_contains(string_split(tags, ','), d.detector) AS truth FROM u, (SELECT unnest({list(_TAGS)}) AS detector) d)
SELECT detector, count(*) FILTER (truth) AS attacks, count(*) FILTER (truth) AS detected, count(*) FILTER (NOT truth) AS benign, 0 AS false_alarms, 1.0 AS recall, 0.0 AS fpr FROM l GROUP BY detector HAVING count(*) FILTER (truth) > 0""")
def a21_detector_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector over the requests of all events: the payloads that were planted for it are its attacks, all others benign."""
    df = planted(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id")
    tags = F.split(F.element_at(F.array(*(F.lit(x[1]) for x in PLANTED)), (F.col("event_id") % len(PLANTED) + 1).cast("int")), ",")
    hits = df.select("payload", tags.alias("tags"), *(test(F.col("payload")).alias(name) for name, test in DETECTORS.items()))
    found = [aggregates.detector_benchmark(hits.withColumn("truth", F.array_contains("tags", name).cast("int")), [name], "payload", "truth") for name in _TAGS]
    return reduce(DataFrame.union, found)


@query(f"{cte('web')} SELECT event_id, row_number() OVER (ORDER BY us, event_id) AS place FROM web WHERE ts IS NOT NULL")
def t1_order_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each event in time: that in its minute and the events of the minutes before, from a table of a row a minute."""
    df = topk.order_timeline(adapter(spark, sf_dir, "web"), "us", "event_id").select("event_id", "us", F.floor(F.col("us") / 60_000_000).alias("minute"))
    before = df.groupBy("minute").agg(F.count("*").alias("n")).select("minute", (F.sum("n").over(Window.orderBy("minute")) - F.col("n")).alias("before"))
    own = df.withColumn("own", F.row_number().over(Window.partitionBy("minute").orderBy("us", "event_id")))
    return own.join(before, "minute").select("event_id", (F.col("own") + F.col("before")).alias("place"))


@query(f"{_WINDOWS}, r AS (SELECT \"user\", window_us, score, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, window_us) AS rank FROM scored) SELECT * FROM r WHERE rank <= 3")
def t2_top_anomalous_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_per_group(_scored_windows(spark, sf_dir).drop("is_anomaly"), "user", F.desc("score"), 3, "window_us")


@query(f"{cte('web')} SELECT source_ip, count(*) AS n FROM web WHERE flagged GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def t3_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_n(adapter(spark, sf_dir, "web").filter("flagged"), "source_ip")


_DEVIATING = ("total_events", "total_read_operations", "failed_logon_count", "new_process_count", "share_session_count", "object_deleted_count")
_LONG = " UNION ALL ".join(f"SELECT \"user\", window_us, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feats" for f in _DEVIATING)


@query(f"""{_FEATURES}, l AS ({_LONG}), s AS (SELECT *, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS d, max(window_us) OVER w AS latest FROM l WINDOW w AS (PARTITION BY "user", feature)),
z AS (SELECT "user", feature, value, round(abs(value - m) / CASE WHEN d = 0 THEN 1.0 ELSE d END, 6) AS deviation FROM s WHERE window_us = latest),
r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY deviation DESC, feature) AS rank FROM z) SELECT * FROM r WHERE rank <= 5""")
def t5_top_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_deviations(ueba(spark, sf_dir), "user", "window_us", list(_DEVIATING))


@query(f"""{cte("scored")}, n AS (SELECT count(*) AS n FROM scored WHERE truth = 1), r AS (SELECT id, truth, row_number() OVER (ORDER BY md5(CAST(id AS STRING)), id) AS i FROM scored WHERE truth = 0)
SELECT id, truth FROM scored WHERE truth = 1 UNION ALL SELECT id, truth FROM r, n WHERE i <= n""")
def t6_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "scored").select("id", "truth", (F.col("truth") == 1).alias("is_attack"))
    return topk.balanced_sample(df, "is_attack", "id").select("id", "truth")


@query(f"""{cte("web")}, r AS (SELECT event_id, host, row_number() OVER (PARTITION BY host ORDER BY md5(CAST(event_id AS STRING)), event_id) AS i FROM web) SELECT event_id, host FROM r WHERE i <= 40""")
def t6_limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty events of each host by hash, for quick runs."""
    return topk.limit_rows(adapter(spark, sf_dir, "web").select("event_id", "host"), "host", 40, "event_id")


@query(f"""{cte("scored")}, u AS (SELECT payload, truth, bool_or(detector_a) AS hit FROM scored GROUP BY ALL) SELECT payload FROM u WHERE truth = 1 AND NOT hit""")
def a21_missed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack payloads that a detector never hits."""
    return aggregates.missed_payloads(adapter(spark, sf_dir, "scored"), "detector_a", "payload", "truth")
