"""Queries of running measures and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions import web
from vigilog.operators import rolling, sessions
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import query

GAP = 21600  # seconds; the test tables are sparse
_GAPS = f"""{cte("web")},
lagged AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY source_ip ORDER BY us, event_id) > {GAP}000000, false) AS starts FROM web),
sess AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM lagged)
"""
_STATE = """CASE WHEN event_source = 'apache_error' THEN 'SERVER_INTERNAL_ERROR'
  WHEN coalesce(status_code, 200) BETWEEN 400 AND 499 THEN 'CLIENT_ERR' WHEN coalesce(status_code, 200) >= 500 THEN 'SERVER_ERR'
  WHEN regexp_matches(lower(uri_path), 'login|log-in|auth|signin') THEN 'AUTH_ACTION'
  WHEN regexp_matches(lower(uri_path), 'admin|manager|dashboard|setup|config') THEN 'ADMIN_ACTION'
  WHEN regexp_matches(lower(uri_path), '[.](png|jpg|jpeg|gif|css|js|ico|woff|woff2|svg)$') THEN 'STATIC_ASSET'
  WHEN regexp_matches(lower(uri_path), '[.](bak|sql|env|old|log|git|sh|zip|inc|php)$') THEN 'SENSITIVE_FILE_ACCESS'
  WHEN http_method IN ('POST', 'PUT', 'DELETE') THEN 'FORM_SUBMISSION' WHEN uri_query NOT IN ('', '-', 'nan') THEN 'DYNAMIC_QUERY' ELSE 'GENERIC_GET' END"""


def web_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_sessions(adapter(spark, sf_dir, "web"), "source_ip", "us", "event_id", GAP)


def with_states(events: DataFrame) -> DataFrame:
    return events.withColumn("state", web.navigation_state(*map(F.col, ("event_source", "http_method", "status_code", "uri_path", "uri_query"))))


_BY_IP = "OVER (PARTITION BY rip ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"""{cte("auth")} SELECT event_id, count(*) OVER (PARTITION BY rip ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY rip, us) + row_number() OVER (PARTITION BY rip, us ORDER BY event_id) AS velocity FROM auth""")
def w1_rolling_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_velocity(adapter(spark, sf_dir, "auth"), seconds=3600).select("event_id", "velocity")


@query(f"""{cte("auth")}, marked AS (SELECT *, CASE WHEN "user" IS NOT NULL AND row_number() OVER (PARTITION BY rip, "user" ORDER BY us, event_id) = 1 THEN 1 ELSE 0 END AS f FROM auth)
SELECT event_id, CAST(sum(f) {_BY_IP} AS BIGINT) AS unique_users FROM marked""")
def w2_cumulative_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.cumulative_distinct_users(adapter(spark, sf_dir, "auth")).select("event_id", "unique_users")


_BLOCKS = f"""{cte("auth")}, blocks AS (SELECT *, CAST(sum(CASE WHEN action IN ('Disconnected', 'Session Closed') THEN 1 ELSE 0 END) {_BY_IP} AS BIGINT) AS session_block FROM auth)"""


@query(f"{_BLOCKS} SELECT event_id, session_block FROM blocks")
def w3_session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.session_risk(adapter(spark, sf_dir, "auth")).select("event_id", "session_block")


@query(f"""{_BLOCKS} SELECT event_id, CAST(sum(CASE WHEN action = 'Sudo Command' THEN 1 ELSE 0 END + CASE WHEN "user" = 'root' THEN 1 ELSE 0 END)
OVER (PARTITION BY rip, session_block ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_risk_score FROM blocks""")
def w4_session_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.session_risk(adapter(spark, sf_dir, "auth")).select("event_id", "session_risk_score")


@query(f"{_GAPS} SELECT event_id, source_ip, session_seq FROM sess")
def w5_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_sessions(spark, sf_dir).select("event_id", "source_ip", "session_seq")


@query(f"""WITH RECURSIVE {_GAPS[5:]},
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_ip, session_seq ORDER BY us, event_id) AS i,
  min(us) OVER (PARTITION BY source_ip, session_seq) AS first_us FROM sess),
walk AS (
  SELECT event_id, source_ip, session_seq, i, us, first_us, us AS begin_us, 1 AS n, 0 AS split_seq FROM numbered WHERE i = 1
  UNION ALL
  SELECT x.event_id, x.source_ip, x.session_seq, x.i, x.us, x.first_us,
    CASE WHEN x.us - w.begin_us > 14400000000 OR w.n >= 5 THEN x.us ELSE w.begin_us END,
    CASE WHEN x.us - w.begin_us > 14400000000 OR w.n >= 5 THEN 1 ELSE w.n + 1 END,
    CASE WHEN x.us - w.begin_us > 14400000000 OR w.n >= 5 THEN w.split_seq + 1 ELSE w.split_seq END
  FROM walk w JOIN numbered x ON x.source_ip = w.source_ip AND x.session_seq = w.session_seq AND x.i = w.i + 1)
SELECT event_id, session_seq, split_seq, source_ip || '_' || CAST(first_us AS STRING) AS parent_tracking_id FROM walk""")
def w6_capped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = sessions.capped_sessions(adapter(spark, sf_dir, "web"), "source_ip", "us", "event_id", GAP, 14400, 5)
    return capped.select("event_id", "session_seq", "split_seq", "parent_tracking_id")


@query(f"""{cte("web")}, d AS (SELECT us - lag(us) OVER (ORDER BY us) AS d FROM web)
SELECT least(greatest(quantile_cont(d, 0.95) * 3.0 / 1000000, 120.0), 86400.0) AS gap_seconds FROM d WHERE d IS NOT NULL""")
def w7_adaptive_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.adaptive_gap(adapter(spark, sf_dir, "web"), "us", 86400)


@query(f"""{cte("web")}, s AS (SELECT event_id, us, us - lag(us) OVER (ORDER BY us, event_id) > 900000000 AS starts FROM web)
SELECT event_id, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM s""")
def w5_keyless_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.keyless_sessions(adapter(spark, sf_dir, "web"), "us", 900).select("event_id", "session_id")


_STEPS = f"""{_GAPS}, states AS (SELECT *, {_STATE} AS state FROM sess),
steps AS (SELECT *, lead(state) OVER w AS next_state, greatest(0.0, (lead(us) OVER w - us) / 1000000) AS sec FROM states WINDOW w AS (PARTITION BY source_ip, session_seq ORDER BY us, event_id)),
trans AS (SELECT source_ip, session_seq, us, event_id, state, next_state,
  CASE WHEN sec < 0.1 THEN '[MACHINE_SPEED]' WHEN sec <= 300 THEN '[HUMAN_SPEED]' ELSE '[SESSION_RESUME]' END || '_' || next_state AS next FROM steps WHERE next_state IS NOT NULL)
"""


def web_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transitions(with_states(web_sessions(spark, sf_dir)), ["source_ip", "session_seq"])


@query(f"{_STEPS} SELECT event_id, source_ip, session_seq, state, next FROM trans")
def w8_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_transitions(spark, sf_dir).select("event_id", "source_ip", "session_seq", "state", "next")


_LOGINS = "SELECT * FROM mail WHERE action = 'Login' AND \"user\" <> 'unknown'"


def mail_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "mail").filter("action = 'Login' and user <> 'unknown'")


@query(f"""{cte("mail")}, l AS ({_LOGINS}),
p AS (SELECT *, lag(ip) OVER w AS pip, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(us) OVER w AS pus FROM l WINDOW w AS (PARTITION BY "user" ORDER BY us, event_id)),
k AS (SELECT *, sin(radians(lat - plat) / 2) ** 2 + cos(radians(plat)) * cos(radians(lat)) * sin(radians(lon - plon) / 2) ** 2 AS a FROM p WHERE pip <> ip AND us > pus),
v AS (SELECT *, 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM k)
SELECT event_id, "user", ip, pip AS previous_ip, round(km, 3) AS distance_km FROM v WHERE km / ((us - pus) / 3600000000) > 50""")
def w9_geo_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = rolling.geo_velocity(mail_logins(spark, sf_dir), limit_kmh=50)
    return fast.select("event_id", "user", "ip", "previous_ip", F.round("distance_km", 3).alias("distance_km"))


@query(f"""{cte("mail")}, l AS ({_LOGINS}),
p AS (SELECT *, row_number() OVER (PARTITION BY "user", ip ORDER BY us, event_id) AS i, row_number() OVER (PARTITION BY "user" ORDER BY us, event_id) AS u FROM l)
SELECT event_id, "user", ip FROM p WHERE i = 1 AND u > 1""")
def w10_first_time_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.first_time_ip(mail_logins(spark, sf_dir)).select("event_id", "user", "ip")


_RUNS = f"""{cte("web")}, m AS (SELECT host, us, event_id, flagged, CASE WHEN event_source = 'apache_error' THEN 'e' || error_message ELSE 'a' || substring(uri_path, 1, 3) END AS w FROM web),
b AS (SELECT *, coalesce(lag(w) OVER o <> w OR flagged OR lag(flagged) OVER o, true) AS br FROM m WINDOW o AS (PARTITION BY host ORDER BY us, event_id)),
i AS (SELECT *, sum(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
n AS (SELECT *, count(*) OVER (PARTITION BY host, island) AS c FROM i),
compressed AS (SELECT host, min(us) AS start_us, max(us) AS end_us, count(*) AS count, min(event_id) AS event_id, true AS is_run FROM n WHERE c > 2 GROUP BY host, island
UNION ALL SELECT host, us, us, 1, event_id, false FROM n WHERE c <= 2)"""


def run_of() -> Column:
    """What makes a run of web events."""
    return F.when(F.col("event_source") == "apache_error", F.concat(F.lit("e"), "error_message")).otherwise(F.concat(F.lit("a"), F.substring("uri_path", 1, 3)))


def web_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.compress_runs(adapter(spark, sf_dir, "web"), "host", run_of(), F.col("flagged"), longest=2)


@query(f"{_RUNS} SELECT * FROM compressed")
def w11_run_length_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_runs(spark, sf_dir)


@query(f"""{cte("web")}, a AS (SELECT *, CASE WHEN flagged OR status_code IN (500, 502, 503, 504) THEN 1 ELSE 0 END AS a, count(*) OVER (PARTITION BY source_ip) AS n,
  row_number() OVER (PARTITION BY source_ip ORDER BY us, event_id) AS i FROM web),
b AS (SELECT *, CASE WHEN max(a) OVER (PARTITION BY source_ip) > 0 THEN a ELSE CASE WHEN i = 1 OR i = n THEN 1 ELSE 0 END END AS anchor FROM a),
c AS (SELECT *, max(anchor) OVER (PARTITION BY source_ip ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY us, event_id) AS r FROM c WHERE n <= 20 OR near > 0)
SELECT event_id, source_ip FROM d WHERE n <= 20 OR r <= 20""")
def w12_context_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.col("flagged") | F.coalesce(F.col("status_code").isin(500, 502, 503, 504), F.lit(False))
    return sessions.context_sample(adapter(spark, sf_dir, "web"), "source_ip", anchor, near=5, most=20).select("event_id", "source_ip")


_DAYS = f"""{cte("windows")}, w AS (SELECT "SubjectUserName" AS "user", us // 86400000000 * 86400000000 AS window_us FROM windows GROUP BY ALL)"""


@query(f"""{_DAYS}, n AS (SELECT *, count(*) OVER (PARTITION BY "user") AS n, row_number() OVER (PARTITION BY "user" ORDER BY window_us) AS i FROM w)
SELECT "user", window_us, CASE WHEN n < 5 THEN 'skip' WHEN n = 5 THEN 'both' WHEN i <= least(greatest(floor(n * 0.8), 5), n - 1) THEN 'train' ELSE 'test' END AS role FROM n""")
def w13_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = adapter(spark, sf_dir, "windows").select(F.col("SubjectUserName").alias("user"), (F.floor(F.col("us") / 86400000000) * 86400000000).alias("window_us")).distinct()
    return rolling.chronological_split(days)


@query(f"""{cte("windows")}, s AS (SELECT (max(us) - min(us)) / 1000000 AS span_seconds FROM windows)
SELECT span_seconds, CASE WHEN span_seconds >= 21600 THEN 3600 WHEN span_seconds >= 10800 THEN 1800 WHEN span_seconds >= 5400 THEN 900
  WHEN span_seconds >= 1800 THEN 300 WHEN span_seconds >= 720 THEN 120 WHEN span_seconds >= 360 THEN 60 ELSE 30 END AS window_seconds FROM s""")
def w14_select_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.select_window(adapter(spark, sf_dir, "windows"))
