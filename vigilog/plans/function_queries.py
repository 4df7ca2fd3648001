"""Queries of columns: flags, maps, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions import common, mail, web
from vigilog.functions import windows as win
from vigilog.operators import events, flows
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import query

_PROPS = "list_transform(range(20), lambda i: CASE WHEN i % 4 = 3 THEN '' ELSE 'v' || CAST((event_id + i) % 50 AS VARCHAR) END)"
_FIELD = {
    "user": "CASE WHEN EventID = 7045 THEN p[5] ELSE p[2] END",
    "mask": "CASE WHEN EventID IN (4663, 5145, 4656) THEN p[10] WHEN EventID = 5140 THEN p[9] ELSE '' END",
    "share": "CASE EventID WHEN 5145 THEN p[8] WHEN 5140 THEN p[6] ELSE '' END",
    "object": "CASE WHEN EventID IN (4663, 4656, 4660) THEN p[7] WHEN EventID = 4658 THEN p[6] ELSE '' END",
}


@query(f"""{cte("windows")}, x AS (SELECT *, {_PROPS} AS p FROM windows)
SELECT event_id, {_FIELD["user"]} AS "SubjectUserName", {_FIELD["object"]} AS "ObjectName", {_FIELD["mask"]} AS "AccessMask", {_FIELD["share"]} AS "ShareName",
  CASE EventID WHEN 4624 THEN p[19] WHEN 4625 THEN p[20] WHEN 5145 THEN p[6] WHEN 5140 THEN p[8] ELSE '' END AS "IpAddress" FROM x""")
def s3_map_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda i: F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("v"), ((F.col("event_id") + i) % 50).cast("string")))
    df = adapter(spark, sf_dir, "windows").select("event_id", "EventID", F.transform(F.sequence(F.lit(0), F.lit(19)), value).alias("properties"))
    return events.map_event_properties(df).select("event_id", "SubjectUserName", "ObjectName", "AccessMask", "ShareName", "IpAddress")


_NORMAL = f"""{cte("windows")}, norm AS (SELECT * REPLACE (
  CASE WHEN EventID IN (4624, 4625) THEN CASE WHEN "TargetUserName" <> '' THEN "TargetUserName" ELSE "SubjectUserName" END ELSE "SubjectUserName" END AS "SubjectUserName",
  CASE WHEN EventID IN (4663, 4656, 4658, 4660) THEN "ObjectName" WHEN EventID = 5145 THEN CASE WHEN "ShareName" <> '' THEN "ShareName" || chr(92) ELSE '' END WHEN EventID = 5140 THEN "ShareName"
    WHEN EventID = 1102 THEN 'Audit Log Cleared' ELSE '' END AS "ObjectName",
  CASE WHEN EventID = 4688 THEN "NewProcessName" ELSE "ProcessName" END AS "ProcessName"),
  CASE WHEN EventID IN (4624, 4625, 4648) THEN 'authentication' WHEN EventID IN (4698, 7045) THEN 'persistence' WHEN EventID = 4688 THEN 'process' WHEN EventID = 1102 THEN 'anti_forensics' ELSE 'file_access' END AS "EventCategory",
  CASE WHEN EventID IN (4663, 5145, 4656, 4660, 5140) AND coalesce("AccessMask", '') <> '' THEN "AccessMask" ELSE '0x0' END AS "AccessMask_Raw" FROM windows)"""
_NUMBER = """CASE WHEN regexp_full_match(lower(trim("AccessMask_Raw")), '0x[0-9a-f]{1,15}') THEN CAST(lower(trim("AccessMask_Raw")) AS BIGINT)
  WHEN regexp_full_match(trim("AccessMask_Raw"), '[0-9]{1,18}') THEN CAST(trim("AccessMask_Raw") AS BIGINT) ELSE 0 END"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalize_windows_events(adapter(spark, sf_dir, "windows"))


@query(f'{_NORMAL} SELECT event_id, EventID, "EventCategory", "SubjectUserName", "ObjectName", "ProcessName", "AccessMask_Raw" FROM norm')
def p6_normalize_windows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("event_id", "EventID", "EventCategory", "SubjectUserName", "ObjectName", "ProcessName", "AccessMask_Raw")


_FLAGS = ", ".join(f"EventID IN (4656, 4660, 4663, 5140, 5145) AND (m & {bit}) <> 0 AS {name}" for name, bit in win.BEHAVIOUR_FLAGS.items())
_NAMES = ", ".join(f"CASE WHEN (m & {bit}) <> 0 THEN '{name}' END" for name, bit in win.ACCESS_FLAGS.items())


@query(f"""{_NORMAL}, n AS (SELECT *, {_NUMBER} AS m FROM norm) SELECT event_id, m AS mask, {_FLAGS}, array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS names FROM n""")
def p7_decode_access_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events.flag_events(normalized(spark, sf_dir))
    mask = F.col("AccessMask_Raw")
    return df.select("event_id", win.hex_to_int(mask).alias("mask"), *win.BEHAVIOUR_FLAGS, F.array_join(win.decode_access_mask(mask), ",").alias("names"))


_BINS = ", ".join(f"'{x}'" for x in win.LOLBINS)
_LOLBIN = " OR ".join(f"lower(split_part(\"{c}\", chr(92), -1)) IN ({_BINS})" for c in ("ProcessName", "NewProcessName", "ParentProcessName"))


@query(f"{_NORMAL} SELECT event_id, {_LOLBIN} AS is_lolbin FROM norm")
def p8_flag_lolbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.flag_events(normalized(spark, sf_dir)).select("event_id", "is_lolbin")


_ADMIN = "(regexp_matches(upper(\"ObjectName\"), '(C|ADMIN|IPC|D|E)[$]') OR regexp_matches(upper(\"ShareName\"), '(C|ADMIN|IPC|D|E)[$]'))"


@query(f"{cte('windows')} SELECT event_id, {_ADMIN} AS is_admin_share FROM windows")
def p9_flag_admin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "windows").select("event_id", win.is_admin_share(F.col("ObjectName"), F.col("ShareName")).alias("is_admin_share"))


@query("""SELECT event_id, NOT hour(ts) BETWEEN 8 AND 17 AS file, hour(ts) >= 22 OR hour(ts) <= 5 AS mail, hour(ts) < 6 OR hour(ts) > 18 AS web, hour(ts) BETWEEN 2 AND 5 AS rule FROM events""")
def p10_flag_off_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", *(common.is_off_hours(F.col("ts"), kind).alias(kind) for kind in common.OFF_HOURS))


@query(f"""{cte("auth")} SELECT event_id, CASE action WHEN 'Login Success' THEN 1 WHEN 'Login Failed' THEN -1 WHEN 'Disconnected' THEN 2 WHEN 'Session Opened' THEN 3 WHEN 'Sudo Command' THEN 11 ELSE 0 END AS action_code,
CASE program WHEN 'sshd' THEN 1 WHEN 'sudo' THEN 4 WHEN 'systemd' THEN 5 ELSE 0 END AS program_code FROM auth""")
def p14_encode_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "auth")
    return df.select("event_id", common.encode(F.col("action"), common.AUTH_ACTION_CODES).alias("action_code"), common.encode(F.col("program"), common.PROGRAM_CODES).alias("program_code"))


@query(f"{cte('auth')} SELECT event_id, CASE WHEN rip = lip THEN 0 ELSE 1 END AS is_remote FROM auth")
def p15_is_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "auth").select("event_id", common.is_remote(F.col("rip"), F.col("lip")).alias("is_remote"))


@query(f"""{cte("flows")} SELECT flow_id, round(ln(1 + bytes_sent) - ln(1 + bytes_received), 6) AS byte_ratio, round(ln(1 + pkts_sent) - ln(1 + pkts_received), 6) AS packet_ratio,
round(ln(1 + bytes / (packets + 1)), 6) AS bytes_per_packet, round(ln(1 + packets / (elapsed + 1)), 6) AS connection_intensity, round(ln(1 + bytes / (ln(1 + elapsed) + 1)), 6) AS byte_rate FROM flows""")
def p16_flow_ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows.flow_ratio_features(adapter(spark, sf_dir, "flows"))
    return df.select("flow_id", *(F.round(c, 6).alias(c) for c in ("byte_ratio", "packet_ratio", "bytes_per_packet", "connection_intensity", "byte_rate")))


@query(f"{cte('web')} SELECT event_id, us FROM web WHERE us BETWEEN 1704499200000000 AND 1705104000000000")
def p18_time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilog.operators.topk import time_window_filter

    return time_window_filter(adapter(spark, sf_dir, "web"), "us", "us", 1704499200000000, 1705104000000000).select("event_id", "us")


@query(f"""{cte("scored")} SELECT id, CASE WHEN detector_a AND score / 100 >= 0.7 THEN 'CRITICAL' WHEN detector_a THEN 'WARNING' ELSE 'NORMAL' END AS severity,
CASE WHEN detector_b OR score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS threat_level,
CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 40 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS high_level FROM scored""")
def p19_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, score = adapter(spark, sf_dir, "scored"), F.col("score")
    return df.select(
        "id", common.severity(score / 100, F.col("detector_a")).alias("severity"),
        common.threat_level(score, F.lit(0.0), F.col("detector_b")).alias("threat_level"),
        common.threat_level(score, F.lit(0.0), F.lit(False), *common.SENSITIVITY["high"]).alias("high_level"),
    )


_P = {k: v.replace("'", "''") for k, v in web.REQUEST_PATTERNS.items()}
_COUNT = lambda name, c="payload": f"len(regexp_extract_all({c}, '{_P[name]}'))"
_HAS = lambda name, c="payload": f"CAST(regexp_matches({c}, '{_P[name]}') AS INT)"
_LENGTHS = "list_transform(vals, lambda v: length(v))"
_ENTROPY = lambda c: f"CASE WHEN {c} = '' THEN 0.0 ELSE round(-list_sum(list_transform(list_distinct(list_filter(str_split({c}, ''), lambda x: x <> '')), lambda x: (length({c}) - length(replace({c}, x, ''))) / length({c}) * log2((length({c}) - length(replace({c}, x, ''))) / length({c})))), 4) END"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_REQUESTS = f"""{cte("requests")}, a AS (SELECT *, url || body AS raw, url_decode(replace(url || body, '+', ' ')) AS payload,
CASE WHEN body = '' THEN [] ELSE list_transform(str_split(body, '&'), lambda x: split_part(x, '=', 2)) END AS vals, CASE WHEN body = '' THEN [] ELSE list_transform(str_split(body, '&'), lambda x: split_part(x, '=', 1)) END AS keys,
lower(regexp_extract(path, '([.][a-zA-Z0-9]{{2,5}})([?]|$|/)', 1)) AS ext FROM requests), r AS (SELECT *, array_to_string(keys, ' ') AS names FROM a),
f AS (SELECT page_id, CAST(method = 'GET' AS INT) AS method_get, CAST(method = 'POST' AS INT) AS method_post, length(url) AS url_length, length(body) AS body_length, n_headers AS num_headers, len(list_distinct(keys)) AS num_params,
round(length(body) / greatest(length(url), 1), 4) AS body_to_url_ratio, {_HAS("sql")} AS has_sql_keyword, {_HAS("xss")} AS has_xss, {_HAS("cmd")} AS has_cmd_injection, {_HAS("traversal")} AS has_traversal,
{_HAS("null", "raw")} AS has_null_byte, {_COUNT("sql")} AS sql_keyword_count, {_COUNT("xss")} AS xss_tag_count, round({_COUNT("special")} / greatest(length(payload), 1) * 100, 4) AS special_char_density,
length(raw) - length(replace(raw, '%', '')) AS encoded_char_count, CAST(contains(raw, '%25') AS INT) AS has_double_encoding, CAST(coalesce(contains(lower(content_type), 'urlencoded'), false) AS INT) AS content_type_form,
{_ENTROPY("payload")} AS payload_entropy, {_ENTROPY("names")} AS param_name_entropy, CAST(len(list_filter(list_distinct(str_split(payload, '')), lambda x: x <> '' AND contains(payload, repeat(x, 9)))) > 0 AS INT) AS has_repeated_chars,
coalesce(list_max({_LENGTHS}), 0) AS max_param_length, CASE WHEN len(vals) = 0 THEN 0.0 ELSE round(list_sum({_LENGTHS}) / len(vals), 2) END AS avg_param_length,
len(list_filter(vals, lambda v: regexp_full_match(v, '[0-9]+'))) AS num_numeric_params, CAST(coalesce(list_max({_LENGTHS}), 0) > 512 AS INT) AS has_long_param_value,
CAST(len(list_filter(vals, lambda v: regexp_matches(v, '{_P["email"]}'))) > 0 AS INT) AS has_email_in_param, length(path) - length(replace(path, '/', '')) AS path_depth,
CAST(ext <> '' AS INT) AS has_file_extension, CAST(ext IN {_LIST(web.EXEC_EXTENSIONS)} AS INT) AS extension_is_exec, {_HAS("ip", "url")} AS has_ip_in_url, CAST(path IN {_LIST(web.COMMON_PATHS)} AS INT) AS is_common_path,
{_COUNT("special")} AS special_char_count, round(len(regexp_extract_all(payload, '[0-9]')) / greatest(length(payload), 1), 4) AS digit_ratio, CAST(malformed AS INT) AS is_malformed FROM r)"""


def requests_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "requests")
    part = lambda k: F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split("body", "&"), lambda x: F.coalesce(F.get(F.split(x, "="), k), F.lit(""))))
    c = F.col
    return df.withColumns(web.request_features(c("method"), c("url"), c("body"), c("path"), part(1), part(0), c("n_headers"), c("content_type"), c("malformed")))


_FEATURES = [
    "method_get", "method_post", "url_length", "body_length", "num_headers", "num_params", "body_to_url_ratio", "has_sql_keyword", "has_xss", "has_cmd_injection", "has_traversal", "has_null_byte", "sql_keyword_count", "xss_tag_count",
    "special_char_density", "encoded_char_count", "has_double_encoding", "content_type_form", "payload_entropy", "param_name_entropy", "has_repeated_chars", "max_param_length", "avg_param_length", "num_numeric_params",
    "has_long_param_value", "has_email_in_param", "path_depth", "has_file_extension", "extension_is_exec", "has_ip_in_url", "is_common_path", "special_char_count", "digit_ratio", "is_malformed",
]


@query(f"{_REQUESTS} SELECT page_id, {', '.join(_FEATURES)} FROM f")
def f11_http_request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_with_features(spark, sf_dir).select("page_id", *_FEATURES)


@query(f"""{_REQUESTS} SELECT page_id, CASE WHEN has_cmd_injection > 0 THEN 'execution' WHEN has_null_byte > 0 THEN 'execution' WHEN has_sql_keyword > 0 THEN 'collection' WHEN has_xss > 0 THEN 'initial_access'
WHEN has_traversal > 0 THEN 'privilege_escalation' WHEN has_double_encoding > 0 OR encoded_char_count > 20 THEN 'defense_evasion' WHEN has_long_param_value > 0 OR body_length > 8000 THEN 'execution' ELSE 'reconnaissance' END AS apt_phase,
CASE WHEN has_cmd_injection > 0 THEN round(least(1.0, 0.7 + special_char_count * 0.03), 2) WHEN has_null_byte > 0 THEN 0.9 WHEN has_sql_keyword > 0 THEN round(least(1.0, 0.65 + special_char_count * 0.05), 2)
WHEN has_xss > 0 THEN round(least(1.0, 0.7 + encoded_char_count * 0.02), 2) WHEN has_traversal > 0 THEN 0.85 WHEN has_double_encoding > 0 OR encoded_char_count > 20 THEN round(least(1.0, 0.5 + encoded_char_count * 0.01), 2)
WHEN has_long_param_value > 0 OR body_length > 8000 THEN 0.75 ELSE 0.4 END AS confidence FROM f""")
def p20_owasp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = requests_with_features(spark, sf_dir)
    found = df.withColumn("c", web.attack_category({c: F.col(c) for c in _FEATURES}))
    return found.select("page_id", F.col("c.apt_phase").alias("apt_phase"), F.col("c.confidence").cast("double").alias("confidence"))


#: Requests and the state of each: source, method, status, path, query.
_STATES = (
    ("apache_error_stderr", "GET", 200, "/", "", "UNHANDLED_STDERR"), ("apache_error", "GET", 200, "/", "", "SERVER_INTERNAL_ERROR"), ("combined_access", "GET", 404, "/login", "", "CLIENT_ERR"), ("combined_access", "GET", 503, "/a", "", "SERVER_ERR"),
    ("combined_access", "POST", 200, "/wp-login.php", "", "AUTH_ACTION"), ("combined_access", "GET", 200, "/Admin/x.png", "", "ADMIN_ACTION"), ("combined_access", "GET", 304, "/img/a.PNG", "v=1", "STATIC_ASSET"), ("combined_access", "GET", 200, "/dump.sql", "", "SENSITIVE_FILE_ACCESS"),
    ("combined_access", "PUT", 201, "/form", "a=1", "FORM_SUBMISSION"), ("combined_access", "GET", 200, "/find", "q=1", "DYNAMIC_QUERY"), ("combined_access", "GET", 200, "/find", "-", "GENERIC_GET"), ("combined_access", "GET", None, None, None, "GENERIC_GET"),
)


@query(f"SELECT event_id, list_extract([{', '.join(repr(x[-1]) for x in _STATES)}], CAST(event_id % {len(_STATES)} + 1 AS INT)) AS state FROM events")
def p21_navigation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven states, each from the first test that holds."""
    pick = lambda k, kind: F.element_at(F.array(*(F.lit(x[k]).cast(kind) for x in _STATES)), (F.col("event_id") % len(_STATES) + 1).cast("int"))
    state = web.navigation_state(pick(0, "string"), pick(1, "string"), pick(2, "int"), pick(3, "string"), pick(4, "string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", state.alias("state"))


@query(f"{cte('flows')} SELECT flow_id, CASE WHEN label IS NULL THEN NULL WHEN upper(trim(label)) <> 'NORMAL' THEN 1 ELSE 0 END AS y_true FROM flows")
def p23_binarize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "flows").select("flow_id", common.binary_label(F.col("label")).alias("y_true"))


@query("""WITH c AS (SELECT page_id, length(url) AS n, unnest(list_distinct(list_filter(str_split(url, ''), lambda x: x <> ''))) AS ch, url FROM pages)
SELECT page_id, round(-sum((n - length(replace(url, ch, ''))) / n * log2((n - length(replace(url, ch, ''))) / n)), 4) AS entropy FROM c GROUP BY page_id""")
def f12_shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", common.shannon_entropy(F.col("url")).alias("entropy"))


@query(f"""{cte("mail")}, k AS (SELECT event_id, sin(radians(21.0285 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(21.0285)) * sin(radians(105.8542 - lon) / 2) ** 2 AS a FROM mail)
SELECT event_id, round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km FROM k""")
def f13_haversine_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = common.haversine_km(F.col("lat"), F.col("lon"), F.lit(21.0285), F.lit(105.8542))
    return adapter(spark, sf_dir, "mail").select("event_id", F.round(km, 3).alias("km"))


@query(f"""{cte("web")} SELECT event_id, source_ip LIKE '10.%' AS is_private, source_ip LIKE '10.%' AS is_lan,
CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS number FROM web""")
def f14_is_private_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.col("source_ip")
    return adapter(spark, sf_dir, "web").select("event_id", common.is_private_ip(ip).alias("is_private"), common.is_lan_prefix(ip).alias("is_lan"), common.ip_to_long(ip).alias("number"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^\s<>"'']+'))) AS n_urls, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'https?://[^\s<>"'']+'))), ' '), '') AS urls FROM pages""")
def f15_extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("u", mail.extract_urls(F.col("html")))
    return df.select("page_id", F.size("u").alias("n_urls"), F.array_join(F.array_sort("u"), " ").alias("urls"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages")
def f16_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(mail.strip_html(F.col("html"))).alias("text_md5"))


_HEADERS = "CASE event_id % 5 WHEN 0 THEN 'mx; SPF=pass dkim=fail' WHEN 1 THEN 'spf=softfail; dmarc=pass' WHEN 2 THEN 'dkim=pass dmarc=fail spf=fail' WHEN 3 THEN NULL ELSE '' END"


@query(f"""WITH h AS (SELECT event_id, lower(coalesce({_HEADERS}, '')) AS t FROM events) SELECT event_id,
CASE WHEN contains(t, 'spf=pass') THEN 'Pass' WHEN contains(t, 'spf=fail') OR contains(t, 'spf=softfail') THEN 'Fail' ELSE 'None/Unknown' END AS spf,
CASE WHEN contains(t, 'dkim=pass') THEN 'Pass' WHEN contains(t, 'dkim=fail') THEN 'Fail' ELSE 'None/Unknown' END AS dkim,
CASE WHEN contains(t, 'dmarc=pass') THEN 'Pass' WHEN contains(t, 'dmarc=fail') THEN 'Fail' ELSE 'None/Unknown' END AS dmarc FROM h""")
def f17_email_auth_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_HEADERS} AS h")
    return df.select("event_id", *(mail.auth_result(F.col("h"), c).alias(c) for c in ("spf", "dkim", "dmarc")))


_FROM = "'Name <u' || CAST(user_id AS STRING) || '@corp.example>'"
_REPLY = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x@mail.example' WHEN 2 THEN 'Other <u' || CAST(user_id AS STRING) || '@CORP.example>' ELSE 'nodomain' END"


@query(f"SELECT event_id, event_id % 4 IN (1, 3) AS is_anomalous FROM events WHERE {_FROM} IS NOT NULL")
def f18_reply_to_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_FROM} AS f", f"{_REPLY} AS r")
    return df.select("event_id", mail.reply_to_mismatch(F.col("f"), F.col("r")).alias("is_anomalous"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def f19_attachment_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", mail.attachment_hashes(F.col("text").cast("binary")).alias("h"))
    return df.select("doc_id", "h.md5", "h.sha256", "h.size")


@query("""SELECT doc_id, (doc_id % 7 = 0 OR doc_id % 11 = 0) AS is_suspicious FROM documents""")
def f20_static_file_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("MZ"), "text")).when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" wscript.SHELL"))).otherwise(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", mail.static_file_signature(planted.cast("binary")).alias("is_suspicious"))


@query(f"""{cte("web")} SELECT event_id, CASE WHEN contains(uri_path, '.') THEN '.' || lower(split_part(uri_path, '.', -1)) ELSE '' END AS extension, length(uri_path) - length(replace(uri_path, '/', '')) AS depth FROM web""")
def f21_uri_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.col("uri_path")
    return adapter(spark, sf_dir, "web").select("event_id", web.extension(uri).alias("extension"), web.uri_depth(uri).alias("depth"))
