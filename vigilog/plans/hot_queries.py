"""Queries of time lines with a key that has a third of all events and is scanned in segments. The SQL knows nothing of segments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators import joins, rolling, sessions, timelines
from vigilog.plans import join_queries, window_queries
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import ORACLE, query

#: Rows from which a key of these tables, which are small, is hot.
LEAST_ROWS = 50
HOT = "hot"


def _sql(name: str, table: str, key: str) -> str:
    """The SQL of a query over the table where every third event has the same key."""
    given = f"""hot_{table} AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN '{HOT}' ELSE "{key}" END AS "{key}") FROM {table})"""
    head = cte(table)
    rest = re.sub(rf"\bFROM {table}\b", f"FROM hot_{table}", ORACLE[name].replace(head, "<head>"))
    return rest.replace("<head>", f"{head}, {given}")


def _events(spark: SparkSession, sf_dir: str, table: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The events with their hot key, and the cuts of its time line."""
    events = adapter(spark, sf_dir, table).withColumn(key, F.when(F.col("event_id") % 3 == 0, HOT).otherwise(F.col(key)))
    return events, timelines.timeline_cuts(events, key, "us", LEAST_ROWS)


@query(_sql("w1_rolling_velocity", "auth", "rip"))
def w1_rolling_velocity_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cuts = _events(spark, sf_dir, "auth", "rip")
    return rolling.rolling_velocity(events, seconds=3600, cuts=cuts).select("event_id", "velocity")


@query(_sql("w2_cumulative_distinct_users", "auth", "rip"))
def w2_cumulative_distinct_users_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cuts = _events(spark, sf_dir, "auth", "rip")
    return rolling.cumulative_distinct_users(events, cuts=cuts).select("event_id", "unique_users")


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events, cuts = _events(spark, sf_dir, "web", "source_ip")
    return sessions.gap_sessions(events, "source_ip", "us", "event_id", window_queries.GAP, cuts=cuts), cuts


@query(_sql("w5_gap_sessions", "web", "source_ip"))
def w5_gap_sessions_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)[0].select("event_id", "source_ip", "session_seq")


@query(_sql("w8_transitions", "web", "source_ip"))
def w8_transitions_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cuts = _sessions(spark, sf_dir)
    steps = sessions.transitions(window_queries.with_states(events), ["source_ip", "session_seq"], cuts=cuts)
    return steps.select("event_id", "source_ip", "session_seq", "state", "next")


@query(_sql("w11_run_length_compress", "web", "host"))
def w11_run_length_compress_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cuts = _events(spark, sf_dir, "web", "host")
    return sessions.compress_runs(events, "host", window_queries.run_of(), F.col("flagged"), longest=2, cuts=cuts)


@query(_sql("j7_fill_logout_ip", "mail", "user"))
def j7_fill_logout_ip_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cuts = _events(spark, sf_dir, "mail", "user")
    return joins.fill_logout_ip(events, columns=("rip",), cuts=cuts).select("event_id", "user", "rip")


@query(_sql("j8_attribute_errors_to_ip", "web", "host"))
def j8_attribute_errors_to_ip_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cuts = _events(spark, sf_dir, "web", "host")
    masked = events.withColumn("source_ip", F.expr(join_queries._MASKED))
    return joins.attribute_errors(masked, seconds=600, cuts=cuts).select("event_id", "source_ip", "attributed")
