"""Queries of parsers, over log lines that are made from the event table; their SQL has the values that went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators import parse
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import query


def _time(layout: str) -> Column:
    return F.date_format(F.col("ts").cast("timestamp"), layout)


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "web").filter("event_source = 'combined_access'")
    user = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).otherwise("-")
    size = F.when(F.col("event_id") % 7 == 0, "-").otherwise(F.col("bytes_sent").cast("string"))
    uri = F.when(F.col("uri_query") != "", F.concat_ws("?", "uri_path", "uri_query")).otherwise(F.col("uri_path"))
    line = F.concat(F.col("source_ip"), F.lit(" - "), user, F.lit(" ["), _time("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), F.col("http_method"), F.lit(" "), uri, F.lit(' HTTP/1.1" '), F.col("status_code").cast("string"), F.lit(" "), size, F.lit(' "-" "'), F.col("user_agent"), F.lit('"'))
    line = F.when(F.col("event_id") % 41 == 0, F.concat(F.lit("garbage "), "user_agent")).when(F.col("event_id") % 43 == 0, "  ").otherwise(line)
    return df.select("event_id", F.col("host").alias("source_file"), line.alias("value"))


_ACCESS = f"{cte('web')}, a AS (SELECT *, CASE WHEN event_id % 41 = 0 THEN 'bad' WHEN event_id % 43 = 0 THEN 'blank' ELSE 'good' END AS kind FROM web WHERE event_source = 'combined_access')"


def _numbered(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("source_file").orderBy("event_id")))


@query(f"""{_ACCESS}, n AS (SELECT host, kind, row_number() OVER (PARTITION BY host ORDER BY event_id) AS i FROM a)
SELECT host AS source_file, CASE WHEN count(*) FILTER (kind = 'good') > 0 THEN 'combined_access' END AS format FROM n WHERE i <= 20 GROUP BY host""")
def p1_detect_log_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.detect_log_format(_numbered(access_lines(spark, sf_dir)))


@query(f"""{_ACCESS} SELECT event_id, source_ip, CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(event_id AS STRING) END AS user_id, us // 1000000 AS seconds, http_method, uri_path || CASE WHEN uri_query <> '' THEN '?' || uri_query ELSE '' END AS raw_uri,
status_code, CASE WHEN event_id % 7 = 0 THEN 0 ELSE bytes_sent END AS bytes_sent, '-' AS referer, user_agent FROM a WHERE kind = 'good'""")
def p2_parse_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse.parse_access_log(access_lines(spark, sf_dir).select("event_id", "value"))
    return df.select("event_id", "source_ip", "user_id", F.unix_seconds("ts").alias("seconds"), "http_method", "raw_uri", "status_code", "bytes_sent", "referer", "user_agent")


@query(f"""{cte("web")} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE source_ip END AS source_ip, us // 1000000 AS seconds, 'core:error' AS error_module, 'failure ' || CAST(event_id % 3 AS STRING) AS error_message FROM web WHERE event_source = 'apache_error'""")
def p3_parse_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "web").filter("event_source = 'apache_error'")
    client = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("[client "), "source_ip", F.lit(":4711] ")))
    when = F.when(F.col("event_id") % 2 == 0, _time("EEE MMM dd HH:mm:ss.SSSSSS yyyy")).otherwise(_time("EEE MMM dd HH:mm:ss yyyy"))
    lines = df.select("event_id", F.concat(F.lit("["), when, F.lit("] [core:error] [pid 17] "), client, "error_message").alias("value"))
    return parse.parse_error_log(lines).select("event_id", "source_ip", F.unix_seconds("ts").alias("seconds"), "error_module", "error_message")


@query(f"""{cte("web")} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE source_ip END AS source_ip, us // 1000000 AS seconds, 'error' AS error_module, 'failure ' || CAST(event_id % 3 AS STRING) AS error_message FROM web WHERE event_source = 'apache_error'""")
def p3_parse_nginx_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "web").filter("event_source = 'apache_error'")
    client = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(", client: "), "source_ip", F.lit(', server: shop, request: "GET /, x HTTP/1.1"')))
    lines = df.select("event_id", F.concat(_time("yyyy/MM/dd HH:mm:ss"), F.lit(" [error] 7#9: *3 "), "error_message", client).alias("value"))
    return parse.parse_error_log(lines, "nginx_error").select("event_id", "source_ip", F.unix_seconds("ts").alias("seconds"), "error_module", "error_message")


@query(f"SELECT event_id, list_extract(['{"', '".join(parse.FORMATS)}', NULL], CAST(event_id % 6 + 1 AS INT)) AS format FROM events")
def p1_detect_each_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a file of two lines in one of the five formats, or none."""
    access = '10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 5'
    both = (f'shop:443 {access} "-" "M \\"x\\""', f'{access} "-" "M"', access, "[Mon Jan 01 00:00:00 2024] [core:error] [client 10.0.0.1:80] gone", "2024/01/01 00:00:00 [error] 1#2: *3 gone, client: 10.0.0.1", "nothing known")
    line = F.element_at(F.array(*map(F.lit, both)), (F.col("event_id") % 6 + 1).cast("int"))
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("source_file"), line.alias("value"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line_no"))
    return parse.detect_log_format(files).select(F.col("source_file").alias("event_id"), "format")


@query(f"{_ACCESS} SELECT event_id, uri_path, uri_query, 0 AS decode_depth, false AS is_evasion_attempt FROM a WHERE kind = 'good'")
def p4_split_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse.split_uri(parse.parse_access_log(access_lines(spark, sf_dir).select("event_id", "value")))
    return df.select("event_id", "uri_path", "uri_query", "decode_depth", "is_evasion_attempt")


@query(f"""{cte("web")} SELECT event_id, uri_path || '/' || CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN '%41' ELSE '%' || repeat('25', CAST(event_id % 5 - 1 AS INT)) || '41' END AS uri_path, 'q=a+b%zz' AS uri_query,
CAST(event_id % 5 + 1 AS INT) AS decode_depth, event_id % 5 >= 2 AS is_evasion_attempt FROM web WHERE uri_path IS NOT NULL""")
def p4_split_encoded_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with paths that are encoded up to five times; plus signs and percent signs without digits stay."""
    df = adapter(spark, sf_dir, "web").filter("uri_path is not null")
    percent = F.col("event_id") % 5
    raw = F.concat("uri_path", F.lit("/%"), F.repeat(F.lit("25"), percent.cast("int")), F.lit("41?q=a+b%zz"))
    return parse.split_uri(df.select("event_id", raw.alias("raw_uri"))).select("event_id", "uri_path", "uri_query", "decode_depth", "is_evasion_attempt")


@query(f"{_ACCESS} SELECT event_id FROM a WHERE kind = 'bad'")
def p5_reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.reject_rows(access_lines(spark, sf_dir), "combined_access").select("event_id")


def _head(daemon: str) -> Column:
    return F.concat(_time("MMM d HH:mm:ss"), F.lit(f" mx {daemon}: "))


@query(f"""{cte("mail")} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'Login' WHEN event_type = 'error' THEN 'Disconnected' ELSE 'Logged out' END AS action, m."user", us // 1000000 AS seconds,
CASE WHEN event_type = 'view' THEN NULL ELSE ip END AS rip, CASE WHEN event_type = 'error' THEN CAST(event_id % 9 AS INT) ELSE 0 END AS attempts, CASE WHEN event_type = 'view' THEN event_id ELSE 0 END AS bytes_in
FROM mail m JOIN events USING (event_id) WHERE event_type IN ('signup', 'error', 'view')""")
def p11_parse_mail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, n = adapter(spark, sf_dir, "mail"), F.col("event_id").cast("string")
    who = F.concat(F.lit("user=<"), "user", F.lit(">, method=PLAIN, rip="), "ip", F.lit(", lip=10.0.0.9, TLS"))
    line = (
        F.when(F.col("action") == "Login", F.concat(_head("dovecot"), F.lit("imap-login: Login: "), who))
        .when(F.col("action").startswith("Disconnected"), F.concat(_head("dovecot"), F.lit("imap-login: Disconnected (auth failed, "), (F.col("event_id") % 9).cast("string"), F.lit(" attempts in 7 secs): "), who))
        .when(F.col("action") == "Logged out", F.concat(_head("dovecot"), F.lit("imap("), "user", F.lit("): Logged out in="), n, F.lit(" out=5")))
        .otherwise("noise")
    )
    parsed = parse.parse_mail_events(df.select("event_id", line.alias("value")), 2024)
    return parsed.select("event_id", "action", "user", F.unix_seconds("ts").alias("seconds"), "rip", "attempts", "bytes_in")


_AUTH_USER = "CASE WHEN \"user\" IS NULL THEN 'nobody' ELSE \"user\" END"


@query(f"""{cte("auth")} SELECT event_id, us // 1000000 AS seconds, program, CASE WHEN program = 'systemd' THEN 'Systemd Session Opened' ELSE action END AS action,
CASE WHEN action = 'Disconnected' THEN NULL ELSE {_AUTH_USER} END AS "user", CASE WHEN action IN ('Login Failed', 'Login Success', 'Disconnected') THEN coalesce(rip, '::1') END AS rip FROM auth WHERE event_id % 31 <> 0""")
def p12_parse_auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "auth").withColumns({"u": F.coalesce("user", F.lit("nobody")), "r": F.coalesce("rip", F.lit("::1"))})
    a = F.col("action")
    line = (
        F.when(F.col("event_id") % 31 == 0, F.concat(_head("CRON[9]"), F.lit("pam_unix(cron:session): session opened for user root")))
        .when(a == "Login Success", F.concat(_head("sshd[7]"), F.lit("Accepted publickey for "), "u", F.lit(" from "), "r", F.lit(" port 22")))
        .when(a == "Login Failed", F.concat(_head("sshd[7]"), F.lit("Failed password for invalid user "), "u", F.lit(" from "), "r", F.lit(" port 22")))
        .when(a == "Disconnected", F.concat(_head("sshd[7]"), F.lit("Received disconnect from "), "r", F.lit(" port 22")))
        .when(a == "Sudo Command", F.concat(_head("sudo"), F.lit("op : TTY=x ; USER="), "u", F.lit(" ; COMMAND=/bin/ls")))
        .otherwise(F.concat(_head("systemd[1]"), F.lit("pam_unix(systemd-user:session): session opened for user "), "u", F.lit(".")))
    )
    parsed = parse.parse_auth_events(df.select("event_id", line.alias("value")), 2024)
    return parsed.select("event_id", F.unix_seconds("ts").alias("seconds"), "program", "action", "user", "rip")


@query(f"""{cte("mail")} SELECT event_id, us // 1000000 AS seconds, service, CASE WHEN action = 'Logged out' THEN 'Login' WHEN service = 'dovecot' AND action <> 'Login' THEN 'Disconnected (auth failed, 1 attempts)' ELSE action END AS action,
CASE WHEN action = 'NOQUEUE: reject' THEN 'unknown' ELSE "user" END AS "user", CASE WHEN action = 'queue active' THEN NULL ELSE ip END AS ip, reason FROM mail""")
def p13_parse_rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "mail")
    who = F.concat(F.lit(": user=<"), "user", F.lit(">, rip="), "ip", F.lit(", lip=10.0.0.9"))
    line = (
        F.when(F.col("action").isin("Login", "Logged out"), F.concat(_time("MMM d HH:mm:ss"), F.lit(" mx dovecot: imap-login: Login"), who))
        .when(F.col("service") == "dovecot", F.concat(_time("MMM d HH:mm:ss"), F.lit(" mx dovecot: imap-login: Disconnected (auth failed, 1 attempts)"), who))
        .when(F.col("action") == "queue active", F.concat(_time("MMM d HH:mm:ss"), F.lit(" mx postfix/qmgr[5]: 4A: from=<"), "user", F.lit(">, size=9, nrcpt=1 (queue active)")))
        .otherwise(F.concat(_time("MMM d HH:mm:ss"), F.lit(" mx postfix/smtpd[6]: NOQUEUE: reject: RCPT from unknown["), "ip", F.lit("]: 550 "), F.coalesce("reason", F.lit("Rejected"))))
    )
    parsed = parse.parse_rule_events(df.select("event_id", line.alias("value")), 2024)
    return parsed.select("event_id", F.unix_seconds("ts").alias("seconds"), "service", "action", "user", "ip", "reason")


def request_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "requests")
    raw = F.concat("method", F.lit(" "), "url", F.lit(" HTTP/1.1\r\nHost: shop\r\nX-Long: a\r\n b\r\nContent-Length: "), F.length("body").cast("string"), F.lit("\r\n\r\n"), "body")
    return df.select("page_id", F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("?"), raw)).otherwise(raw).alias("raw"))


@query(f"""{cte("requests")} SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE method END AS method, CASE WHEN page_id % 9 = 0 THEN '' ELSE url END AS url, body AS body_raw, 'a b' AS x_long, page_id % 9 = 0 AS is_malformed FROM requests""")
def p17_parse_http_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse.parse_http_request(request_text(spark, sf_dir))
    return df.select("page_id", "method", "url", "body_raw", F.get(F.col("headers")["x-long"], 0).alias("x_long"), "is_malformed")
