"""Alert rules over login and mail events. Alerts: alert_type, severity, source_ip, target_user, us, event_id."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.operators.rolling import first_time_ip, geo_velocity

SECOND = 1_000_000
ALERT_COLUMNS = ["alert_type", "severity", "source_ip", "target_user", "us", "event_id"]


@dataclass(frozen=True)
class Threshold:
    """`count` hits of one key within `seconds` (both ends in; None: no bound) raise an alert and clear what was counted."""

    count: int
    seconds: float | None
    distinct: bool = False


class Counter:
    """What a rule has counted for one key: times within its span, or different values since the last clearing."""

    def __init__(self, rule: Threshold):
        self.rule = rule
        self.span = None if rule.seconds is None else int(rule.seconds * SECOND)
        self.times: deque[int] = deque()
        self.values: set = set()

    def clear(self) -> None:
        self.times.clear()
        self.values.clear()

    def hit(self, us: int, value: object = None) -> bool:
        """Counts a hit; whether it raises the alert."""
        if self.rule.distinct:
            self.values.add(value)
            full = len(self.values) >= self.rule.count
        else:
            self.times.append(us)
            while self.span is not None and self.times[0] < us - self.span:
                self.times.popleft()
            full = len(self.times) >= self.rule.count
        if full:
            self.clear()
        return full


def sliding_alerts(us: np.ndarray, hit: np.ndarray, reset: np.ndarray, value: np.ndarray, counter: Counter) -> np.ndarray:
    """Which rows of one key, in order, raise an alert; the counter goes on from row to row and from batch to batch."""
    out = np.zeros(len(us), bool)
    for i in range(len(us)):
        if reset[i]:
            counter.clear()
        if hit[i]:
            out[i] = counter.hit(int(us[i]), value[i])
    return out


def threshold_rule(events: DataFrame, key: str, hit: Column, rule: Threshold, alert_type: str, severity: str, reset: Column | None = None, value: str | None = None, time: str = "us", order: str = "event_id", key_column: str = "source_ip") -> DataFrame:
    """Alerts of a rule whose state belongs to one key.

    Only hits and resets of keys with as many hits as the threshold asks for reach the scan, sorted by key
    in partitions of many keys; the scan goes from batch to batch and holds what it counted, not a key's rows.
    """
    marked = events.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_reset", F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)).filter(F.col(key).isNotNull() & (F.col("_hit") | F.col("_reset")))
    busy = marked.filter("_hit").groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= rule.count).select(key)
    rows = marked.join(busy, key, "left_semi").select(F.col(key).alias("k"), F.col(time).alias("us"), F.col(order).alias("o"), "_hit", "_reset", (F.col(value) if value else F.lit(None)).cast("string").alias("v"))
    kind = events.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, counter = None, Counter(rule)
        for pdf in batches:
            if pdf.empty:
                continue
            k, us, hits, resets, values = (pdf[c].to_numpy() for c in ("k", "us", "_hit", "_reset", "v"))
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            out = np.zeros(len(pdf), bool)
            for b, e in zip(edge[:-1], edge[1:]):
                if k[b] != last:
                    last, counter = k[b], Counter(rule)
                out[b:e] = sliding_alerts(us[b:e], hits[b:e], resets[b:e], values[b:e], counter)
            yield pdf.loc[out, ["k", "us", "o"]]

    # by a hash of the key: Spark leaves out a repartition by the join's own key, and its adaptive plan may then deal a key's rows to many tasks
    found = rows.repartition(F.xxhash64("k")).sortWithinPartitions("k", "us", "o").mapInPandas(scan, f"k {kind}, us long, o long")
    other = "target_user" if key_column == "source_ip" else "source_ip"
    return found.select(F.lit(alert_type).alias("alert_type"), F.lit(severity).alias("severity"), F.col("k").cast("string").alias(key_column), F.lit(None).cast("string").alias(other), "us", F.col("o").alias("event_id")).select(ALERT_COLUMNS)


def is_failure(action: Column) -> Column:
    return action.contains("Disconnected") | action.contains("auth failed")


def brute_force(events: DataFrame, count: int = 10, seconds: float = 300, failure: Column | None = None) -> DataFrame:
    action = F.col("action")
    return threshold_rule(events, "ip", is_failure(action) if failure is None else failure, Threshold(count, seconds), "Brute Force", "HIGH", reset=action == "Login")


def password_spraying(events: DataFrame, users: int = 5, failure: Column | None = None) -> DataFrame:
    return threshold_rule(events, "ip", is_failure(F.col("action")) if failure is None else failure, Threshold(users, None, True), "Password Spraying", "CRITICAL", value="user")


def smtp_enumeration(events: DataFrame, count: int = 20, seconds: float = 60) -> DataFrame:
    return threshold_rule(events, "ip", (F.col("service") == "postfix") & (F.col("reason") == "User unknown"), Threshold(count, seconds), "SMTP Enumeration", "HIGH")


def mass_outbound(events: DataFrame, count: int = 50, seconds: float = 60) -> DataFrame:
    hit = (F.col("service") == "postfix") & F.col("action").contains("queue active") & (F.col("user") != "unknown")
    return threshold_rule(events, "user", hit, Threshold(count, seconds), "Mass Outbound Spam", "CRITICAL", key_column="target_user")


def _alerts(rows: DataFrame, alert_type: str, severity: str) -> DataFrame:
    return rows.select(F.lit(alert_type).alias("alert_type"), F.lit(severity).alias("severity"), F.col("ip").cast("string").alias("source_ip"), F.col("user").cast("string").alias("target_user"), "us", "event_id")


def off_hours_login(events: DataFrame, ts: str = "ts") -> DataFrame:
    return _alerts(events.filter((F.col("action") == "Login") & F.hour(ts).between(2, 5)), "Off-Hours Login", "MEDIUM")


def relay_attempt(events: DataFrame) -> DataFrame:
    return _alerts(events.filter((F.col("service") == "postfix") & (F.col("reason") == "Relay access denied")), "Relay Attempt", "MEDIUM")


def logins_of(events: DataFrame) -> DataFrame:
    return events.filter((F.col("action") == "Login") & (F.col("user") != "unknown") & F.col("ip").isNotNull())


def impossible_travel(events: DataFrame, limit_kmh: float = 1000) -> DataFrame:
    return _alerts(geo_velocity(logins_of(events), limit_kmh=limit_kmh), "Impossible Travel", "CRITICAL")


def new_ip(events: DataFrame) -> DataFrame:
    return _alerts(first_time_ip(logins_of(events)), "First Time IP", "LOW")


def run_rules(events: DataFrame, brute: tuple = (10, 300), spray: int = 5, enumeration: tuple = (20, 60), outbound: tuple = (50, 60), kmh: float = 1000) -> DataFrame:
    """All alerts of all rules, with the time of the event that raised them."""
    found = brute_force(events, *brute)
    for more in (password_spraying(events, spray), off_hours_login(events), smtp_enumeration(events, *enumeration), relay_attempt(events), mass_outbound(events, *outbound), impossible_travel(events, kmh), new_ip(events)):
        found = found.unionByName(more)
    return found
