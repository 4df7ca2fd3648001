"""All alert rules over one stream: one state machine a key, whose counters, addresses and waiting rows are entries of their own that expire apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from vigilog.operators.rules import ALERT_COLUMNS, SECOND, Counter, Threshold, is_failure
from vigilog.streaming.jobs import stateless_alerts

_ALERT = "alert_type string, severity string, source_ip string, target_user string, us long, event_id long"
_ROW = "us long, o long, hits int, value string, ip string, lat double, lon double"
_COLUMNS = [c.split(" ")[0] for c in _ROW.split(", ")]
#: Bits of `hits`: what an event is to the rules.
FAILURE, LOGIN, UNKNOWN_USER, OUTBOUND, LOCATED = 1, 2, 4, 8, 16
#: The state store that keeps such state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class RuleSet:
    """Thresholds of the rules, and how long state stays without an event that renews it."""

    brute: Threshold = Threshold(10, 300)
    spray: Threshold = Threshold(5, None, True)
    enumeration: Threshold = Threshold(20, 60)
    outbound: Threshold = Threshold(50, 60)
    limit_kmh: float = 1000
    forget_seconds: float = 180 * 86_400

    def counting(self) -> dict[str, list[tuple]]:
        """Rules that count, by kind of key: name, severity, threshold, bits of a hit and of a reset."""
        return {
            "ip": [("Brute Force", "HIGH", self.brute, FAILURE, LOGIN), ("Password Spraying", "CRITICAL", self.spray, FAILURE, 0), ("SMTP Enumeration", "HIGH", self.enumeration, UNKNOWN_USER, 0)],
            "user": [("Mass Outbound Spam", "CRITICAL", self.outbound, OUTBOUND, 0)],
        }


@dataclass
class Rules(StatefulProcessor):
    """The rules of one key: an address (kind "ip") or a user.

    counters has an entry a rule (times and values counted), known one an address of a user (when it was last used),
    last is a user's last place. A batch reads and writes each entry that its rows change once. Without `ordered` the rows of a batch are
    taken in order as they come; with it they wait until the watermark has passed them, so that alerts don't depend on how
    events fell into batches. One timer a key is set for what is next: rows that may go on, or an entry that expires.
    """

    rules: RuleSet = field(default_factory=RuleSet)
    ordered: bool = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getMapState("counters", "rule string", "times array<bigint>, seen array<string>, us bigint")
        self.known = handle.getMapState("known", "ip string", "us bigint")
        self.last = handle.getValueState("last", "ip string, lat double, lon double, us bigint")
        self.waiting = handle.getListState("waiting", _ROW)
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for pdf in rows:
            values = pdf[_COLUMNS].astype(object)
            new += values.where(values.notna(), None).itertuples(index=False, name=None)
        if self.ordered:
            self.waiting.appendList(new)
            found: list[tuple] = []
        else:
            found = self._take(key, new)
        self._set_timer(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(found, columns=ALERT_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [tuple(r) for r in rows if r[0] <= now * 1000]
        found = self._take(key, ready)
        later = [tuple(r) for r in rows if r[0] > now * 1000]
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        gone = now * 1000 - int(self.rules.forget_seconds * SECOND)
        for state in (self.counters, self.known):
            for entry in [k for k, v in state.iterator() if v[-1] <= gone]:
                state.removeKey(entry)
        if self.last.exists() and self.last.get()[3] <= gone:
            self.last.clear()
        self._set_timer(now)
        yield pd.DataFrame(found, columns=ALERT_COLUMNS)

    def close(self) -> None:
        pass

    def _set_timer(self, now_ms: int) -> None:
        """Sets the timer for the first row that waits, or else for the first entry that expires, unless one is set for sooner."""
        keep = int(self.rules.forget_seconds * SECOND)
        times = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if not times:
            times = [v[-1] + keep for state in (self.counters, self.known) for _, v in state.iterator()]
            times += [self.last.get()[3] + keep] if self.last.exists() else []
        if times:
            at = max(-(-min(times) // 1000), now_ms + 1)
            if not self.timer.exists() or at < self.timer.get()[0]:
                if self.timer.exists():
                    self.handle.deleteTimer(self.timer.get()[0])
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def _take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """The alerts of rows, which are put in order; state goes on from them."""
        kind, own = key
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        found: list[tuple] = []
        for name, severity, rule, hit, reset in self.rules.counting()[kind]:
            mine = [r for r in rows if r[2] & (hit | reset)]
            if not mine:
                continue
            counter = Counter(rule)
            if self.counters.containsKey((name,)):
                times, seen, _ = self.counters.getValue((name,))
                counter.times.extend(times)
                counter.values.update(seen)
            for us, o, hits, value, *_ in mine:
                if hits & reset:
                    counter.clear()
                if hits & hit and counter.hit(us, value):
                    found.append((name, severity, own if kind == "ip" else None, own if kind == "user" else None, us, o))
            if counter.times or counter.values:
                self.counters.updateValue((name,), (list(counter.times), list(counter.values), mine[-1][0]))
            elif self.counters.containsKey((name,)):
                self.counters.removeKey((name,))
        if kind == "user" and (logins := [r for r in rows if r[2] & LOCATED]):
            found += self._logins(own, logins)
        return found

    def _logins(self, user: str, rows: list[tuple]) -> list[tuple]:
        """Alerts of a user's logins in order. Each address is looked up and written once, and the last place too, however many rows there are."""
        found: list[tuple] = []
        used: dict[str, int] = {}
        some = self.known.exists()
        before = last = self.last.get() if self.last.exists() else None
        for us, o, _, _, ip, lat, lon in rows:
            if some and ip not in used and not self.known.containsKey((ip,)):
                found.append(("First Time IP", "LOW", ip, user, us, o))
            used[ip], some = us, True
            if lat is None or lon is None:
                continue
            if last is not None:
                last_ip, last_lat, last_lon, last_us = last
                if last_ip != ip and us > last_us:
                    a1, a2, d = np.radians(last_lat), np.radians(lat), np.radians(lon - last_lon)
                    a = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(d / 2) ** 2
                    if 6371.0 * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) / ((us - last_us) / (3600 * SECOND)) > self.rules.limit_kmh:
                        found.append(("Impossible Travel", "CRITICAL", ip, user, us, o))
            last = (ip, float(lat), float(lon), us)
        for ip, us in used.items():
            self.known.updateValue((ip,), (us,))
        if last is not before:
            self.last.update(last)
        return found


def use_state_store(spark: SparkSession) -> None:
    """Streams of this session keep their state in the store that rule_stream() needs; it spills to disk and writes changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def rule_stream(events: DataFrame, rules: RuleSet = RuleSet(), ts: str = "ts", late: str = "10 minutes", ordered: bool = False) -> DataFrame:
    """The alerts of all rules over a stream of mail and login events, as one query; see Rules for `ordered`.

    An event goes to its address and to its user where a rule of either asks for it, so each key's state is one
    group of the same operator. Rules without state pass by. Rows later than the watermark are dropped.
    """
    use_state_store(events.sparkSession)
    seen = events.withWatermark(ts, late)
    action, mail = F.col("action"), F.col("service") == "postfix"
    bit = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0)
    login = (action == "Login") & (F.col("user") != "unknown") & F.col("ip").isNotNull()
    of_ip = bit(is_failure(action), FAILURE) + bit(action == "Login", LOGIN) + bit(mail & (F.col("reason") == "User unknown"), UNKNOWN_USER)
    of_user = bit(mail & action.contains("queue active") & (F.col("user") != "unknown"), OUTBOUND) + bit(login, LOCATED)
    row = lambda kind, key, hits: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("k"), hits.cast("int").alias("hits"))
    rows = seen.select(F.col(ts).alias("ts"), "us", F.col("event_id").alias("o"), F.col("user").cast("string").alias("value"), "ip", "lat", "lon", F.explode(F.array(row("ip", "ip", of_ip), row("user", "user", of_user))).alias("r"))
    rows = rows.select("ts", "us", "o", "value", "ip", "lat", "lon", "r.*").filter("k is not null and hits > 0")
    counted = rows.groupBy("kind", "k").transformWithStateInPandas(Rules(rules, ordered), _ALERT, "Append", "EventTime")
    return stateless_alerts(seen).unionByName(counted)
