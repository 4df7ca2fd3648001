"""Queries of alert rules, over lowered thresholds: the test tables are sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilog.operators import rules
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import ORACLE, query

_FAIL = "(contains(action, 'Disconnected') OR contains(action, 'auth failed'))"
_DAY = 86_400


def _walk(key: str, hit: str, reset: str, count: int, seconds: int, name: str, severity: str, ip: str, user: str) -> str:
    """A recursive CTE that keeps the times counted so far of each key."""
    return f"""WITH RECURSIVE {cte("mail")[5:]}, h AS (SELECT *, {hit} AS hit, {reset} AS rst FROM mail WHERE {key} IS NOT NULL AND ({hit} OR {reset})),
n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS i FROM h),
walk AS (SELECT {key} AS k, i, us, event_id, CASE WHEN hit THEN [us] ELSE CAST([] AS BIGINT[]) END AS held, false AS alert FROM n WHERE i = 1
UNION ALL SELECT n.{key}, n.i, n.us, n.event_id, CASE WHEN n.rst THEN CAST([] AS BIGINT[]) WHEN len(list_filter(w.held, lambda x: x >= n.us - {seconds}000000)) + 1 >= {count} THEN CAST([] AS BIGINT[])
  ELSE list_append(list_filter(w.held, lambda x: x >= n.us - {seconds}000000), n.us) END, n.hit AND len(list_filter(w.held, lambda x: x >= n.us - {seconds}000000)) + 1 >= {count}
  FROM walk w JOIN n ON n.{key} = w.k AND n.i = w.i + 1)
SELECT '{name}' AS alert_type, '{severity}' AS severity, {ip} AS source_ip, {user} AS target_user, us, event_id FROM walk WHERE alert"""


@query(_walk("ip", _FAIL, "action = 'Login'", 3, 2 * _DAY, "Brute Force", "HIGH", "k", "CAST(NULL AS STRING)"))
def r1_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.brute_force(adapter(spark, sf_dir, "mail"), 3, 2 * _DAY)


@query(f"""WITH RECURSIVE {cte("mail")[5:]}, n AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us, event_id) AS i FROM mail WHERE {_FAIL}),
walk AS (SELECT ip, i, us, event_id, ["user"] AS seen, false AS alert FROM n WHERE i = 1
UNION ALL SELECT n.ip, n.i, n.us, n.event_id, CASE WHEN len(list_distinct(list_append(w.seen, n."user"))) >= 5 THEN CAST([] AS STRING[]) ELSE list_distinct(list_append(w.seen, n."user")) END,
  len(list_distinct(list_append(w.seen, n."user"))) >= 5 FROM walk w JOIN n ON n.ip = w.ip AND n.i = w.i + 1)
SELECT 'Password Spraying' AS alert_type, 'CRITICAL' AS severity, ip AS source_ip, CAST(NULL AS STRING) AS target_user, us, event_id FROM walk WHERE alert""")
def r2_password_spraying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.password_spraying(adapter(spark, sf_dir, "mail"))


_PLAIN = "SELECT '{}' AS alert_type, '{}' AS severity, ip AS source_ip, \"user\" AS target_user, us, event_id FROM mail WHERE {}"


@query(f"{cte('mail')} " + _PLAIN.format("Off-Hours Login", "MEDIUM", "action = 'Login' AND hour(ts) BETWEEN 2 AND 5"))
def r3_off_hours_login(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.off_hours_login(adapter(spark, sf_dir, "mail"))


@query(_walk("ip", "(service = 'postfix' AND coalesce(reason, '') = 'User unknown')", "false", 4, 3 * _DAY, "SMTP Enumeration", "HIGH", "k", "CAST(NULL AS STRING)"))
def r4_smtp_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.smtp_enumeration(adapter(spark, sf_dir, "mail"), 4, 3 * _DAY)


@query(f"{cte('mail')} " + _PLAIN.format("Relay Attempt", "MEDIUM", "service = 'postfix' AND reason = 'Relay access denied'"))
def r5_relay_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.relay_attempt(adapter(spark, sf_dir, "mail"))


@query(_walk('"user"', "(service = 'postfix' AND contains(action, 'queue active') AND \"user\" <> 'unknown')", "false", 3, 4 * _DAY, "Mass Outbound Spam", "CRITICAL", "CAST(NULL AS STRING)", "k"))
def r6_mass_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mass_outbound(adapter(spark, sf_dir, "mail"), 3, 4 * _DAY)


_LOGINS = f"""{cte("mail")}, l AS (SELECT * FROM mail WHERE action = 'Login' AND "user" <> 'unknown'),
p AS (SELECT *, lag(ip) OVER w AS pip, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(us) OVER w AS pus FROM l WINDOW w AS (PARTITION BY "user" ORDER BY us, event_id)),
k AS (SELECT *, sin(radians(lat - plat) / 2) ** 2 + cos(radians(plat)) * cos(radians(lat)) * sin(radians(lon - plon) / 2) ** 2 AS a FROM p WHERE pip <> ip AND us > pus),
fast AS (SELECT * FROM k WHERE 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) / ((us - pus) / 3600000000) > 50),
fresh AS (SELECT *, row_number() OVER (PARTITION BY "user", ip ORDER BY us, event_id) AS i, row_number() OVER (PARTITION BY "user" ORDER BY us, event_id) AS u FROM l)"""


@query(f"{_LOGINS} SELECT 'Impossible Travel' AS alert_type, 'CRITICAL' AS severity, ip AS source_ip, \"user\" AS target_user, us, event_id FROM fast")
def r7_impossible_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.impossible_travel(adapter(spark, sf_dir, "mail"), 50)


@query(f"{_LOGINS} SELECT 'First Time IP' AS alert_type, 'LOW' AS severity, ip AS source_ip, \"user\" AS target_user, us, event_id FROM fresh WHERE i = 1 AND u > 1")
def r8_first_time_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.new_ip(adapter(spark, sf_dir, "mail"))


_PARTS = [f"r{i}_{x}" for i, x in enumerate(("brute_force", "password_spraying", "off_hours_login", "smtp_enumeration", "relay_attempt", "mass_outbound", "impossible_travel", "first_time_ip"), 1)]


@query(" UNION ALL ".join(f"SELECT alert_type, severity, source_ip, target_user, us, event_id FROM ({ORACLE[x]})" for x in _PARTS))
def r9_run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_rules(adapter(spark, sf_dir, "mail"), (3, 2 * _DAY), 5, (4, 3 * _DAY), (3, 4 * _DAY), 50)
