from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilog.functions import common, decode, mail, signatures, windows
from vigilog.models import forest, one_class, supervised
from vigilog.operators import aggregates, events, joins, parse, rolling, rules, sessions
from vigilog.sources import readers, writers

SECOND = 1_000_000


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_velocity_counts_ties_row_by_row(spark):
    df = spark.createDataFrame([("a", t * SECOND, i) for i, t in enumerate((0, 60, 60, 90))], "rip string, us long, event_id long")
    assert [r[1] for r in rows(rolling.rolling_velocity(df), "event_id", "velocity")] == [1, 1, 2, 3]


def test_an_idle_time_of_the_gap_stays_in_the_session(spark):
    df = spark.createDataFrame([("a", t * SECOND, i) for i, t in enumerate((0, 900, 1801))], "k string, us long, o long")
    assert [r[1] for r in rows(sessions.gap_sessions(df, "k", "us", "o", 900), "o", "session_seq")] == [0, 0, 1]


def _naive_caps(times, gap, most, events):
    out, begin, last, n, split = [], None, None, 0, 0
    for t in times:
        if last is not None and t - last > gap:
            begin, n, split = t, 1, 0
        elif begin is None:
            begin, n = t, 1
        elif t - begin > most or n >= events:
            begin, n, split = t, 1, split + 1
        else:
            n += 1
        last = t
        out.append(split)
    return out


def test_caps_as_a_plain_loop(spark):
    rng = random.Random(3)
    data, expected = [], {}
    for key in ("a", "b", None):
        times = sorted(rng.randrange(0, 40_000) * SECOND for _ in range(120))
        ids = [len(data) + i for i in range(len(times))]
        data += [(key, t, i) for t, i in zip(times, ids)]
        expected |= dict(zip(ids, _naive_caps(times, 900 * SECOND, 3000 * SECOND, 7)))
    df = spark.createDataFrame(data, "k string, us long, o long")
    assert dict(rows(sessions.capped_sessions(df, "k", "us", "o", 900, 3000, 7), "o", "split_seq")) == expected


def test_keyless_sessions_as_a_lag(spark):
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 200_000) * SECOND for _ in range(300))
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "us long, o long")
    expected, n = {}, 0
    for i, t in enumerate(times):
        n += i > 0 and t - times[i - 1] > 900 * SECOND
        expected[i] = n
    assert dict(rows(sessions.keyless_sessions(df, "us", 900), "o", "session_id")) == expected


def test_runs_of_five_stay_and_six_are_merged(spark):
    what = ["x"] * 5 + ["y"] * 6 + ["x", "x"]
    df = spark.createDataFrame([("h", i, i, w, i == 12) for i, w in enumerate(what)], "host string, us long, event_id long, w string, f boolean")
    found = sessions.compress_runs(df, "host", F.col("w"), F.col("f"))
    assert [r[1] for r in rows(found, "start_us", "count")] == [1] * 5 + [6, 1, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.booleans()), max_size=60), st.integers(1, 4), st.integers(1, 90))
def test_sliding_alerts_as_a_plain_list(steps, count, seconds):
    steps = sorted(steps, key=lambda x: x[0])
    us = np.array([t * SECOND for t, _ in steps], dtype=np.int64)
    resets = np.array([r for _, r in steps], dtype=bool)
    found = rules.sliding_alerts(us, ~resets, resets, np.array([None] * len(us)), rules.Counter(rules.Threshold(count, seconds)))
    held, expected = [], []
    for t, r in zip(us, resets):
        if r:
            held = []
            expected.append(False)
            continue
        held = [x for x in held if x >= t - seconds * SECOND] + [t]
        expected.append(len(held) >= count)
        if expected[-1]:
            held = []
    assert found.tolist() == expected


@pytest.mark.parametrize(("mask", "number"), [("0x0", 0), ("", 0), ("not_a_hex", 0), ("%%4416", 0), ("1", 1), ("0x10003", 0x10003), (None, 0), ("-", 0), ("nan", 0)])
def test_access_masks(spark, mask, number):
    df = spark.createDataFrame([(4663, mask)], "EventID int, m string")
    flags = windows.behaviour_flags(F.col("EventID"), F.col("m"))
    got = df.select(windows.hex_to_int(F.col("m")).alias("n"), *(c.alias(k) for k, c in flags.items())).first()
    assert got["n"] == number and got["is_read"] == bool(number & 1) and got["is_delete"] == bool(number & 0x10000)


def test_attack_chain_of_windows_events(spark):
    kinds = [4625] * 15 + [4624] + [4648] * 3 + [4688] * 3 + [4663] * 50 + [4698, 7045, 1102] + [4660] * 5
    at = pd.Timestamp("2024-03-01 02:00:00")
    data = [(at + pd.Timedelta(seconds=2 * i), k, "eve", r"\\srv\ADMIN$\x" if k == 4663 else "", "", "0x1" if k == 4663 else "0x0", "10.0.0.1", "", r"C:\Windows\cmd.exe" if k == 4688 else "", "", "") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["TimeCreated", "EventID", "SubjectUserName", "ObjectName", "ShareName", "AccessMask_Raw", "IpAddress", "ProcessName", "NewProcessName", "ParentProcessName", "x"]))
    got = events.ueba_window_features(events.flag_events(df)).first()
    assert (got["failed_logon_count"], got["explicit_credential_count"], got["scheduled_task_created_count"], got["service_installed_count"]) == (15, 3, 1, 1)
    assert (got["audit_log_cleared_count"], got["object_deleted_count"], got["off_hour_activity_ratio"], got["suspicious_process_count"]) == (1, 5, 1.0, 3)
    assert got["admin_share_access_count"] == 50 and got["total_read_operations"] == 50


def test_errors_get_the_address_of_two_seconds_before(spark):
    df = spark.createDataFrame([("h", "1.1.1.1", 0, 0), ("h", None, 2 * SECOND, 1), ("h", None, 2 * SECOND + 1, 2)], "host string, source_ip string, us long, event_id long")
    assert rows(joins.attribute_errors(df), "event_id", "source_ip", "attributed") == [(0, "1.1.1.1", False), (1, "1.1.1.1", True), (2, None, False)]


def test_parsers_keep_what_they_cannot_read_apart(spark):
    lines = ['1.2.3.4 - - [01/Jan/2024:10:00:00 +0200] "GET /a?b=1 HTTP/1.1" 200 - "-" "x"', "", "nonsense", 'v.example 1.2.3.4 - bob [01/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 404 12 "-" "x"']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = parse.parse_access_log(df).select("source_ip", "user_id", "bytes_sent", F.hour("ts").alias("h")).collect()
    assert [tuple(r) for r in got] == [("1.2.3.4", None, 0, 8)]
    assert rows(parse.reject_rows(df, "combined_access"), "value")[0] == ("nonsense",)
    assert parse.parse_access_log(df, "vhost_combined_access").first()["vhost"] == "v.example"


def test_uris_are_decoded_as_often_as_they_are_encoded(spark):
    df = spark.createDataFrame([("/a+b%zz?q=%2525252541",), ("/plain",), (None,)], "raw_uri string")
    got = {r["raw_uri"]: r for r in parse.split_uri(df).collect()}
    assert got["/a+b%zz?q=%2525252541"]["uri_path"] == "/a+b%zz" and got["/a+b%zz?q=%2525252541"]["decode_depth"] == 5 and got["/plain"]["decode_depth"] == 0
    assert decode.payload_of("x=%2527", True) == "x="


def test_detectors_on_attacks_and_look_alikes(spark):
    cases = {"sqli": ("1 UNION/**/SELECT a", "select a seat"), "xss": ("&lt;script&gt;alert(1)", "a < b"), "rce": ("x;cat${IFS}/etc/passwd", "cats; dogs"), "lfi": ("%c0%ae./../etc/passwd", "a..b"), "ssrf": ("http://127.0.0.1/", "http://example.org/"), "protocol": ("?next=//evil", "next door")}
    for name, (bad, good) in cases.items():
        df = spark.createDataFrame([(0, bad), (1, good), (2, None)], "i int, p string")
        got = rows(df.select("i", getattr(signatures, f"detect_{name}")(F.col("p")).alias("hit")), "i", "hit")
        assert got == [(0, True), (1, False), (2, False)], name


def test_mail_headers(spark):
    df = spark.createDataFrame([("A <a@x.org>", "b@y.org"), ("a@x.org", "A <b@x.org>"), ("a@x.org", None)], "f string, r string")
    assert [r[0] for r in df.select(mail.reply_to_mismatch(F.col("f"), F.col("r"))).collect()] == [True, False, False]
    assert df.select(common.ip_to_long(F.lit("1.2.3.256"))).first()[0] is None


def test_forest_finds_the_odd_row(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (400, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(401), "a": x[:, 0], "b": x[:, 1]}))
    scored = df.withColumn("s", forest.score_column(forest.fit(df, ["a", "b"], n_trees=40))).orderBy("s").limit(1).first()
    assert scored["id"] == 400 and -1 <= scored["s"] < -0.6
    svm = df.withColumn("s", one_class.score_column(one_class.fit(df, ["a", "b"]))).orderBy("s").limit(1).first()
    assert svm["id"] == 400


def test_per_user_models_need_five_windows(spark):
    data = [(u, i, "train" if i < n - 1 else "test", float(i % 3)) for u, n in (("four", 4), ("six", 6)) for i in range(n)]
    df = spark.createDataFrame(data, "user string, t long, role string, x double")
    got = forest.per_user_baseline(df, "user", "t", ["x"], n_trees=10).toPandas()
    assert set(got["user"]) == {"six"} and got["risk"].between(0, 100).all()


def test_hard_rules_and_metrics(spark):
    df = spark.createDataFrame([(1, True, False, False), (1, False, True, True), (1, False, True, False)], "v int, u boolean, r boolean, o boolean")
    assert sorted(r["final_verdict"] for r in supervised.apply_hard_rules(df, "v", F.col("u"), F.col("r"), F.col("o")).collect()) == [-1, -1, 1]
    empty = spark.createDataFrame([], "p int, t int")
    assert aggregates.confusion_metrics(empty, F.col("p"), F.col("t")).first()["precision"] == 0.0


def test_haversine(spark):
    km = spark.range(1).select(common.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert math.isclose(km, math.pi * 6371, rel_tol=1e-9)


def test_written_events_come_back(spark, tmp_path):
    df = spark.sql("select 1 as id, timestamp'2024-01-02 03:04:05' as ts")
    writers.write_events(df, str(tmp_path / "e"), time="ts")
    assert str(spark.read.parquet(str(tmp_path / "e")).first()["date"]) == "2024-01-02"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("x\ny\nz\n")
    assert rows(readers.read_log_lines(spark, str(tmp_path / "log")), "line_no", "value") == [(1, "x"), (2, "y"), (3, "z")]


def test_capped_sessions_are_scanned_from_batch_to_batch(spark):
    rng = random.Random(4)
    data, expected = [], {}
    for key in ("a", "b", None):
        times = sorted(rng.randrange(0, 40_000) * SECOND for _ in range(600))
        ids = [len(data) + i for i in range(len(times))]
        data += [(key, t, i, [i]) for t, i in zip(times, ids)]
        expected |= dict(zip(ids, _naive_caps(times, 900 * SECOND, 3000 * SECOND, 23)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        capped = sessions.capped_sessions(spark.createDataFrame(data, "k string, us long, o long, x array<long>"), "k", "us", "o", 900, 3000, 23)
        assert "FlatMapGroups" not in capped._jdf.queryExecution().toString()
        got = capped.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["o"]: r["split_seq"] for r in got} == expected and all(r["x"] == [r["o"]] for r in got)
