"""Streaming operators: windows, sessions and alert rules with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilog.operators.events import DIFFERENT, values_of_event
from vigilog.operators.rules import ALERT_COLUMNS, SECOND, Counter, Threshold, logins_of, off_hours_login, relay_attempt, sliding_alerts

_ALERT = "alert_type string, severity string, source_ip string, target_user string, us long, event_id long"




def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote under path; batches that run again replace their files."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def threshold_stream(events: DataFrame, key: str, hit: Column, rule: Threshold, alert_type: str, severity: str, reset: Column | None = None, value: str | None = None, ts: str = "ts", late: str = "10 minutes", forget_seconds: float = 3600, key_column: str = "source_ip") -> DataFrame:
    """A threshold rule over a stream: what a key has counted is its state; the state goes when the key has been quiet for forget_seconds.

    Rows of a key are put in order within each batch; rows later than the watermark are dropped.
    """
    kind = events.schema[key].dataType.simpleString()
    marked = events.withWatermark(ts, late).select(
        F.col(key).alias("k"), F.col(ts).alias("ts"), "us", F.col("event_id").alias("o"), F.coalesce(hit, F.lit(False)).alias("hit"),
        (F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)).alias("rst"), (F.col(value) if value else F.lit(None)).cast("string").alias("v"),
    ).filter("k is not null and (hit or rst)")

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter = Counter(rule)
        if state.exists:
            times, values = state.get
            counter.times.extend(times)
            counter.values.update(values)
        rows = pd.concat(list(batches)).sort_values(["us", "o"])
        raised = sliding_alerts(rows["us"].to_numpy(), rows["hit"].to_numpy(), rows["rst"].to_numpy(), rows["v"].to_numpy(), counter)
        state.update((list(counter.times), list(counter.values)))
        last = int(rows["us"].iloc[-1]) // 1000 + int(forget_seconds * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [k[0]] * int(np.sum(raised)), "us": rows["us"].to_numpy()[raised], "o": rows["o"].to_numpy()[raised]})

    found = marked.groupBy("k").applyInPandasWithState(run, f"k {kind}, us long, o long", "times array<long>, seen array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    other = "target_user" if key_column == "source_ip" else "source_ip"
    return found.select(F.lit(alert_type).alias("alert_type"), F.lit(severity).alias("severity"), F.col("k").cast("string").alias(key_column), F.lit(None).cast("string").alias(other), "us", F.col("o").alias("event_id")).select(ALERT_COLUMNS)


def stateless_alerts(events: DataFrame) -> DataFrame:
    """The rules without state over a stream: logins in off hours, relay attempts."""
    return off_hours_login(events).unionByName(relay_attempt(events))


def login_alerts(events: DataFrame, limit_kmh: float = 1000, ts: str = "ts", late: str = "10 minutes", forget_days: float = 180) -> DataFrame:
    """Impossible travel and first-time addresses over a stream: a user's last place and known addresses are its state.

    The state goes when the user hasn't logged in for forget_days of event time; the next login is a first one again.
    """
    keep_ms = int(forget_days * 86_400_000)
    logins = logins_of(events).withWatermark(ts, late).select(F.col("user").alias("k"), "ip", "lat", "lon", "us", "event_id", ts)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=ALERT_COLUMNS)
            return
        known, last = (list(state.get[0]), tuple(state.get[1:])) if state.exists else ([], (None, None, None, None))
        seen, rows, out = set(known), pd.concat(list(batches)).sort_values(["us", "event_id"]), []
        for r in rows.itertuples():
            if r.ip not in seen:
                if seen:
                    out.append(("First Time IP", "LOW", r.ip, k[0], r.us, r.event_id))
                seen.add(r.ip)
            if not (pd.isna(r.lat) or pd.isna(r.lon)):
                if last[0] is not None and last[0] != r.ip and r.us > last[3]:
                    a1, a2, d = np.radians(last[1]), np.radians(r.lat), np.radians(r.lon - last[2])
                    a = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(d / 2) ** 2
                    km = 6371.0 * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
                    if km / ((r.us - last[3]) / (3600 * SECOND)) > limit_kmh:
                        out.append(("Impossible Travel", "CRITICAL", r.ip, k[0], r.us, r.event_id))
                last = (r.ip, float(r.lat), float(r.lon), int(r.us))
        state.update((list(seen), *last))
        state.setTimeoutTimestamp(max(int(rows["us"].iloc[-1]) // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=ALERT_COLUMNS)

    return logins.groupBy("k").applyInPandasWithState(run, _ALERT, "known array<string>, ip string, lat double, lon double, us long", "append", GroupStateTimeout.EventTimeTimeout)


def gap_session_stream(events: DataFrame, key: str, ts: str = "ts", gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Idle-gap sessions of a stream, given out when the watermark has passed their end."""
    grouped = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("total_requests"), F.sum("bytes_sent").alias("bytes_sent")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total_requests", "bytes_sent")


def capped_session_stream(events: DataFrame, key: str, ts: str = "ts", gap_seconds: float = 900, max_seconds: float = 7200, max_events: int = 3000, late: str = "10 minutes") -> DataFrame:
    """Sessions that also end when too old or too long: (key, parent_us, start_us, end_us, total_requests), given out as they end.

    The open session is the state: its parent's start, its own, its last event, its count; an event-time
    timer ends it when the key has been idle for longer than the gap.
    """
    gap, most = int(gap_seconds * SECOND), int(max_seconds * SECOND)
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, late).select(F.col(key).alias("k"), F.col(ts).alias("ts"), "us", F.col("event_id").alias("o"))
    names = ["k", "parent_us", "start_us", "end_us", "total_requests"]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            parent, start, last, n = state.get
            state.remove()
            yield pd.DataFrame([(k[0], parent, start, last, n)], columns=names)
            return
        now = tuple(state.get) if state.exists else None
        out = []
        for us in np.sort(pd.concat(list(batches))["us"].to_numpy()):
            us = int(us)
            if now is None:
                now = (us, us, us, 1)
            elif us - now[2] > gap:
                out.append((k[0], *now))
                now = (us, us, us, 1)
            elif us - now[1] > most or now[3] >= max_events:
                out.append((k[0], *now))
                now = (now[0], us, us, 1)
            else:
                now = (now[0], now[1], max(us, now[2]), now[3] + 1)
        state.update(now)
        state.setTimeoutTimestamp(max((now[2] + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    found = rows.groupBy("k").applyInPandasWithState(run, f"k {kind}, parent_us long, start_us long, end_us long, total_requests long", "parent long, start long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("k", key)


def window_stream(events: DataFrame, user: str, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling behaviour windows of a stream, with exact numbers of different values.

    A value that its window has had is dropped by the state of the values so far, which goes when the watermark
    has passed the window; what is left is counted with the events. No group holds a set.
    """
    seen = events.withWatermark(ts, late).withColumn("w", F.window(ts, window))
    counted = seen.select(F.col(user).alias("user"), "w", F.lit("event").alias("kind"), "EventID")
    values = seen.select(F.col(user).alias("user"), "w", F.explode(values_of_event()).alias("v")).select("user", "w", "v.kind", "v.value").dropDuplicates(["user", "w", "kind", "value"])
    both = counted.unionByName(values.select("user", "w", "kind", F.lit(None).cast(counted.schema["EventID"].dataType).alias("EventID")))
    number = lambda name, *ids: F.count_if((F.col("kind") == "event") & F.col("EventID").isin(*ids)).alias(name)
    grouped = both.groupBy("user", "w").agg(
        F.count_if(F.col("kind") == "event").alias("total_events"), number("successful_logon_count", 4624), number("failed_logon_count", 4625), number("new_process_count", 4688),
        *(F.count_if(F.col("kind") == kind).alias(name) for kind, name in DIFFERENT.items()),
    )
    return grouped.select("user", F.col("w.start").alias("window_start"), *grouped.columns[2:])


def hopping_counts(events: DataFrame, key: str, test: Column, least: int, ts: str = "ts", window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Hopping windows with at least `least` hits of a key: the approximation of the sliding rules that needs no state of its own."""
    grouped = events.filter(test).withWatermark(ts, late).groupBy(F.col(key), F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("hits"))
    return grouped.filter(F.col("hits") >= least).select(key, F.col("w.start").alias("window_start"), "hits")
