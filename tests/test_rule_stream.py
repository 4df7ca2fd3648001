"""All rules over one stream: the batch rules' alerts, also when events come in any order within the watermark; state that expires."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import rules
from vigilog.operators.rules import Threshold
from vigilog.streaming.jobs import run_available
from vigilog.streaming.processors import LOCATED, Rules, RuleSet, rule_stream

SCHEMA = "event_id long, us long, user string, ip string, service string, action string, reason string, lat double, lon double"
RULES = RuleSet(Threshold(2, 600), Threshold(4, None, True), Threshold(3, 900), Threshold(4, 3600), 300)
#: At three in the morning.
BASE = 1_700_018_000_000_000


def events(n, seed, step=25):
    rng = random.Random(seed)
    rows, us = [], BASE
    for i in range(n):
        us += rng.choice([0, 1, step]) * 1_000_000
        kind = rng.choice(["fail", "login", "login", "enum", "relay", "queue"])
        service, action, reason = {"fail": ("dovecot", "Disconnected (auth failed)", None), "login": ("dovecot", "Login", None), "enum": ("postfix", "NOQUEUE: reject", "User unknown"), "relay": ("postfix", "NOQUEUE: reject", "Relay access denied"), "queue": ("postfix", "queue active", None)}[kind]
        place = rng.choice([(50.0, 8.0), (40.0, -74.0), (None, None)])
        rows.append((i, us, rng.choice(["ann", "bob", "unknown", f"u{rng.randrange(9)}"]), rng.choice(["10.0.0.1", "10.0.0.2", f"10.0.1.{rng.randrange(30)}", None]), service, action, reason, *place))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def batch_alerts(df):
    found = rules.run_rules(df, (2, 600), 4, (3, 900), (4, 3600), 300)
    return sorted((tuple(r) for r in found.collect()), key=str)


def streamed(spark, tmp_path, parts, **options):
    for k, rows in enumerate(parts):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    schema = frame(spark, parts[0]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = run_available(rule_stream(stream, **options), f"file://{tmp_path}/run")
    return sorted((tuple(r) for r in found.select(rules.ALERT_COLUMNS).collect()), key=str)


def test_one_batch_is_the_batch_rules(spark, tmp_path):
    rows = events(400, 1)
    got = streamed(spark, tmp_path, [rows], rules=RULES)
    assert got == batch_alerts(frame(spark, rows)) and {r[0] for r in got} == {"Brute Force", "Password Spraying", "SMTP Enumeration", "Mass Outbound Spam", "Off-Hours Login", "Relay Attempt", "Impossible Travel", "First Time IP"}


def test_shuffled_batches_are_the_batch_rules(spark, tmp_path):
    """Events up to ten minutes out of order over seven batches; the last row lets the watermark pass all others."""
    rng = random.Random(3)
    rows = events(300, 2)
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(280) * 1_000_000)
    size = len(order) // 6
    parts = [order[k : k + size] for k in range(0, len(order), size)]
    end = [(10_000 + k, rows[-1][1] + (3_600 + k) * 1_000_000, "nobody", None, "dovecot", "x", None, None, None) for k in range(2)]
    got = streamed(spark, tmp_path, [*parts, end[:1], end[1:]], rules=RULES, ordered=True)
    assert got == batch_alerts(frame(spark, rows))


@pytest.mark.parametrize(("forget", "expected"), [(3600, 1), (10 * 86_400, 2)])
def test_addresses_expire_apart(spark, tmp_path, forget, expected):
    """The first address is used again and again and stays known; the second is forgotten and new again, if state doesn't stay that long."""
    hour = 3600 * 1_000_000
    login = lambda i, at, ip: (i, BASE + at, "ann", ip, "dovecot", "Login", None, None, None)
    parts = [[login(0, 0, "a"), login(1, 1, "b")]] + [[login(10 + k, k * hour // 2, "a")] for k in range(1, 9)] + [[login(50, 5 * hour, "b")]]
    got = streamed(spark, tmp_path, parts, rules=RuleSet(forget_seconds=forget))
    news = [r[5] for r in got if r[0] == "First Time IP"]
    assert news == ([1] if forget > 86_400 else [1, 50])
    assert len(news) == (1 if expected == 2 else 2)


def test_a_batch_asks_for_each_entry_once():
    """State is read and written once an address and not once a login."""
    calls = []

    class State(dict):
        def __getattr__(self, name):
            work = {"exists": lambda: bool(self), "containsKey": lambda k: k in self, "updateValue": self.__setitem__, "update": lambda v: self.__setitem__("own", v), "get": lambda: self["own"]}[name]
            return lambda *args: calls.append(name) or work(*args)

        get = property(lambda self: self.__getattr__("get"))
        update = property(lambda self: self.__getattr__("update"))

    machine = Rules(RULES)
    machine.counters, machine.known, machine.last = State(), State(), State()
    row = lambda i: (BASE + i * 1_000_000, i, LOCATED, "ann", "ab"[i % 2], 50.0, 8.0 - 80 * (i == 5))
    found = machine._take(("user", "ann"), [row(i) for i in range(500)])
    assert [(r[0], r[5]) for r in found] == [("First Time IP", 1), ("Impossible Travel", 5), ("Impossible Travel", 6)] and len(calls) < 10
    assert machine._take(("user", "ann"), [row(i) for i in range(500, 503)]) == [] and dict(machine.known) == {("a",): (row(502)[0],), ("b",): (row(501)[0],)}
