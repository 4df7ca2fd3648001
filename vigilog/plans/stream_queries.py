"""Streaming queries: each reads its table as a stream to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.common import micros
from vigilog.operators import rules
from vigilog.operators.events import DIFFERENT
from vigilog.plans.adapters import adapter, cte
from vigilog.plans import window_queries  # noqa: F401
from vigilog.plans.registry import ORACLE, query
from vigilog.plans.rule_queries import _DAY
from vigilog.sources.storage import shared_path
from vigilog.streaming import jobs
from vigilog.streaming.processors import RuleSet, rule_stream


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    return jobs.run_available(stream, shared_path(spark, name))


@query(ORACLE["r1_brute_force"])
def r1_brute_force_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "mail", stream=True)
    action = F.col("action")
    return _run(spark, jobs.threshold_stream(df, "ip", rules.is_failure(action), rules.Threshold(3, 2 * _DAY), "Brute Force", "HIGH", reset=action == "Login", forget_seconds=3 * _DAY), "r1")


@query(ORACLE["r2_password_spraying"])
def r2_password_spraying_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "mail", stream=True)
    return _run(spark, jobs.threshold_stream(df, "ip", rules.is_failure(F.col("action")), rules.Threshold(5, None, True), "Password Spraying", "CRITICAL", value="user", forget_seconds=90 * _DAY), "r2")


@query(f"({ORACLE['r3_off_hours_login']}) UNION ALL ({ORACLE['r5_relay_attempt']})")
def r9_stateless_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.stateless_alerts(adapter(spark, sf_dir, "mail", stream=True)), "r9")


@query(ORACLE["r9_run_rules"])
def r9_rule_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules as one stream."""
    chosen = RuleSet(rules.Threshold(3, 2 * _DAY), rules.Threshold(5, None, True), rules.Threshold(4, 3 * _DAY), rules.Threshold(3, 4 * _DAY), 50)
    return _run(spark, rule_stream(adapter(spark, sf_dir, "mail", stream=True), chosen), "r9s")


@query(f"({ORACLE['r7_impossible_travel']}) UNION ALL ({ORACLE['r8_first_time_ip']})")
def r7_login_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.login_alerts(adapter(spark, sf_dir, "mail", stream=True), 50), "r7")


_LATE = 600_000_000


@query(f"""{cte("web")}, l AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY source_ip ORDER BY us, event_id) > 21600000000, false) AS starts FROM web),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS q FROM l)
SELECT source_ip, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS total_requests, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent FROM s GROUP BY source_ip, q HAVING max(us) + 21600000000 <= (SELECT max(us) FROM web) - {_LATE}""")
def r10_gap_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, jobs.gap_session_stream(adapter(spark, sf_dir, "web", stream=True), "source_ip", gap="6 hours"), "r10")
    return found.select("source_ip", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"), "total_requests", "bytes_sent")


_CAPPED = ORACLE["w6_capped_sessions"]
_WALK = _CAPPED[: _CAPPED.index("SELECT event_id, session_seq")]


@query(f"""{_WALK}, parts AS (SELECT source_ip, min(first_us) AS parent_us, session_seq, split_seq, min(us) AS start_us, max(us) AS end_us, count(*) AS total_requests, max(split_seq) OVER (PARTITION BY source_ip, session_seq) AS last FROM walk GROUP BY source_ip, session_seq, split_seq),
ended AS (SELECT *, lead(start_us) OVER (PARTITION BY source_ip ORDER BY start_us) IS NOT NULL AS over FROM parts)
SELECT source_ip, parent_us, start_us, end_us, total_requests FROM ended WHERE over OR (end_us + 21600000000) // 1000 + 1 <= (SELECT max(us) FROM web) // 1000 - 600000""")
def r10_capped_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.capped_session_stream(adapter(spark, sf_dir, "web", stream=True), "source_ip", gap_seconds=21600, max_seconds=14400, max_events=5), "r10c")


@query(f"""{cte("windows")} SELECT "SubjectUserName" AS "user", us // 86400000000 * 86400000000 AS window_us, count(*) AS total_events, count(*) FILTER (EventID = 4624) AS successful_logon_count, count(*) FILTER (EventID = 4625) AS failed_logon_count,
count(*) FILTER (EventID = 4688) AS new_process_count, count(DISTINCT "ObjectName") AS distinct_files_accessed,
len(list_distinct(list_concat(coalesce(list("ProcessName") FILTER ("ProcessName" <> ''), []), coalesce(list("NewProcessName") FILTER ("NewProcessName" <> ''), [])))) AS distinct_processes_used,
count(DISTINCT "IpAddress") FILTER (EventID IN (4624, 4625) AND "IpAddress" NOT IN ('', 'local', '-')) AS distinct_logon_source_ips, count(DISTINCT "ParentProcessName") FILTER (EventID = 4688 AND "ParentProcessName" <> '') AS distinct_parent_processes,
count(DISTINCT "ShareName") FILTER (EventID = 5140 AND "ShareName" <> '') AS distinct_shares_accessed FROM windows GROUP BY 1, 2 HAVING us // 86400000000 * 86400000000 + 86400000000 <= (SELECT max(us) FROM windows) - {_LATE}""".replace("HAVING us //", "HAVING window_us + 86400000000 <= (SELECT max(us) FROM windows) - 600000000 --"))
def r11_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, jobs.window_stream(adapter(spark, sf_dir, "windows", stream=True), "SubjectUserName", "TimeCreated", "1 day"), "r11")
    return found.select("user", micros(F.col("window_start")).alias("window_us"), "total_events", "successful_logon_count", "failed_logon_count", "new_process_count", *DIFFERENT.values())


_HOP = 21_600_000_000


@query(f"""{cte("mail")}, h AS (SELECT ip, us // {_HOP} * {_HOP} - unnest([0, 1, 2, 3]) * {_HOP} AS window_us FROM mail WHERE contains(action, 'auth failed'))
SELECT ip, window_us, count(*) AS hits FROM h GROUP BY 1, 2 HAVING count(*) >= 3 AND window_us + 4 * {_HOP} <= (SELECT max(us) FROM mail WHERE contains(action, 'auth failed')) - {_LATE}""")
def r12_hopping_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.hopping_counts(adapter(spark, sf_dir, "mail", stream=True), "ip", F.col("action").contains("auth failed"), 3, window="1 day", slide="6 hours")
    return _run(spark, stream, "r12").select("ip", micros(F.col("window_start")).alias("window_us"), "hits")
