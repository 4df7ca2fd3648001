"""Parsers of log lines: web access and error logs, mail and login logs, HTTP requests. Lines that don't parse are kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A field of an access log, as the servers document it: quoted (a quote inside has a backslash before it), in square brackets, or bare.
FIELD = r'"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^\s"\[]\S*'
_COMMON = ("source_ip", "ident", "user_id", "time", "request", "status", "bytes")
#: Fields of access formats, in order; the formats in the order in which ties are decided.
ACCESS_FORMATS = {"vhost_combined_access": ("vhost", *_COMMON, "referer", "user_agent"), "combined_access": (*_COMMON, "referer", "user_agent"), "common_access": _COMMON}
FORMATS = (*ACCESS_FORMATS, "apache_error", "nginx_error")
_BRACKETED, _QUOTED = ("time",), ("request", "referer", "user_agent")
#: What an error log has before its message: time and module, then process and client in brackets; or time, level and numbers.
_APACHE_LEAD = r"^((?:\[[^\]]*\] ){2}(?:\[(?:pid|tid|client|remote) [^\]]*\] ?)*)(.*)$"
_NGINX_LEAD = r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] \d+#\d+: (?:\*\d+ )?(.*)$"
ERROR_TIMES = ("EEE MMM d HH:mm:ss.SSSSSS yyyy", "EEE MMM d HH:mm:ss yyyy", "yyyy/MM/dd HH:mm:ss")
SAMPLE_LINES = 20


def access_fields(value: Column) -> Column:
    """The fields of a line, with their quotes and brackets; one pass for all access formats."""
    return F.regexp_extract_all(value, F.lit(FIELD), F.lit(0))


def _fits(fields: Column, name: str) -> Column:
    """Whether fields are those of an access format: each of its kind, a request of three parts, a numeric status."""
    at = {f: F.get(fields, i) for i, f in enumerate(ACCESS_FORMATS[name])}
    ok = at["request"].rlike(r'^"\S+\s+\S+\s+[^"]+"$') & at["status"].rlike("^[0-9]+$") & at["bytes"].isNotNull()
    for f, field in at.items():
        opening = field.substr(1, 1)
        ok = ok & (opening == "[" if f in _BRACKETED else opening == '"' if f in _QUOTED else ~opening.isin("[", '"'))
    return F.coalesce(ok, F.lit(False))


def matches(value: Column, name: str) -> Column:
    """Whether a line is of a format."""
    if name in ACCESS_FORMATS:
        return _fits(access_fields(value), name)
    return value.rlike(_APACHE_LEAD if name == "apache_error" else _NGINX_LEAD)


def detect_log_format(lines: DataFrame, file: str = "source_file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(source_file, format) by most matches among the first 20 lines of a file, ties in the order of FORMATS; null if none matches."""
    first = lines.filter(F.col(line_no) <= SAMPLE_LINES).select(file, value, access_fields(F.col(value)).alias("_fields"))
    test = {name: _fits(F.col("_fields"), name) if name in ACCESS_FORMATS else matches(F.col(value), name) for name in FORMATS}
    counts = first.groupBy(file).agg(*(F.count_if(t).alias(name) for name, t in test.items()))
    top = F.greatest(*FORMATS)
    found = F.lit(None).cast("string")
    for name in reversed(FORMATS):
        found = F.when((F.col(name) == top) & (top > 0), name).otherwise(found)
    return counts.select(file, found.alias("format"))


def access_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def error_time(text: Column) -> Column:
    """Any of three layouts; the day's name isn't read, two spaces before a one-digit day count as one."""
    bare = F.regexp_replace(F.regexp_replace(text, "^[A-Z][a-z]{2} ", ""), " +", " ")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(x.removeprefix("EEE "))) for x in ERROR_TIMES))


def parse_access_log(lines: DataFrame, name: str = "combined_access", value: str = "value") -> DataFrame:
    """Typed columns of the lines that match: address, user ('-' is null), UTC time, method, raw_uri, status, bytes ('-' is 0), referer, agent, vhost."""
    found = lines.select(*lines.columns, access_fields(F.col(value)).alias("_fields")).filter(_fits(F.col("_fields"), name))
    at = {f: F.get("_fields", F.lit(i)) for i, f in enumerate(ACCESS_FORMATS[name])}
    inner = lambda f: F.substring(at[f], F.lit(2), F.length(at[f]) - 2) if f in at else F.lit(None).cast("string")
    part = lambda i: F.get(F.split(inner("request"), r"\s+", 3), F.lit(i))
    size = F.when(at["bytes"].rlike("^[0-9]{1,18}$"), at["bytes"]).cast("bigint")
    return found.select(
        *lines.columns, F.lit(name).alias("event_source"), at["source_ip"].alias("source_ip"), F.when(at["user_id"] != "-", at["user_id"]).alias("user_id"), access_time(inner("time")).alias("ts"),
        part(0).alias("http_method"), part(1).alias("raw_uri"), at["status"].cast("int").alias("status_code"), F.coalesce(size, F.lit(0)).alias("bytes_sent"),
        inner("referer").alias("referer"), inner("user_agent").alias("user_agent"), at.get("vhost", F.lit(None).cast("string")).alias("vhost"),
    )


def parse_error_log(lines: DataFrame, name: str = "apache_error", value: str = "value") -> DataFrame:
    """Typed columns of the lines that match: UTC time, module or level, address (null if none, without its port), message."""
    v = F.col(value)
    found = lines.filter(matches(v, name))
    if name == "apache_error":
        lead = F.regexp_extract_all(F.regexp_extract(v, _APACHE_LEAD, 1), F.lit(r"\[([^\]]*)\]"), F.lit(1))
        client = F.get(F.filter("_lead", lambda x: x.startswith("client ")), F.lit(0))
        time, module, message = F.get("_lead", F.lit(0)), F.get("_lead", F.lit(1)), F.regexp_extract(v, _APACHE_LEAD, 2)
        address = F.regexp_replace(F.substring(client, F.lit(8), F.length(client)), r":\d+$", "")
    else:
        lead = F.split(F.regexp_extract(v, _NGINX_LEAD, 3), ", (?=(?:client|server|request|upstream|host|referrer): )")
        client = F.get(F.filter("_lead", lambda x: x.startswith("client: ")), F.lit(0))
        time, module, message = F.regexp_extract(v, _NGINX_LEAD, 1), F.regexp_extract(v, _NGINX_LEAD, 2), F.get("_lead", F.lit(0))
        address = F.substring(client, F.lit(9), F.length(client))
    return found.select(*lines.columns, lead.alias("_lead")).select(
        *lines.columns, F.lit(name).alias("event_source"), error_time(time).alias("ts"), module.alias("error_module"), F.nullif(address, F.lit("")).alias("source_ip"), message.alias("error_message"),
    )


def reject_rows(lines: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Lines that aren't blank and don't match."""
    return lines.filter((F.trim(value) != "") & ~matches(F.col(value), name))


def split_uri(df: DataFrame, raw: str = "raw_uri", most: int = 5) -> DataFrame:
    """df with uri_path, uri_query (of the URI decoded once), decode_depth and is_evasion_attempt (depth over 2).

    Only URIs with a percent sign are decoded, in vectorised Python: Spark's own decoder reads '+' as a space
    and fails on a percent sign without digits.
    """
    from vigilog.functions.decode import decode_uri

    needs = F.col(raw).contains("%")
    found = F.when(needs, decode_uri(F.when(needs, F.col(raw)))).otherwise(F.struct(F.col(raw).alias("once"), F.lit(0).alias("depth")))
    once = F.regexp_replace(F.col("_u.once"), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    bare = F.substring_index(once, "#", 1)
    return df.withColumn("_u", found).withColumns({
        "uri_path": F.substring_index(bare, "?", 1), "uri_query": F.when(bare.contains("?"), F.substring(bare, F.instr(bare, "?") + 1, 1 << 30)).otherwise(""),
        "decode_depth": F.least(F.col("_u.depth"), F.lit(most)), "is_evasion_attempt": F.col("_u.depth") > 2,
    }).drop("_u")


_SYSLOG = r"^([A-Z]?[a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+\S+\s+([^:\[]+)(?:\[\d+\])?:\s+(.*)$"


def syslog_time(text: Column, year: int) -> Column:
    """A time without a year; 'an' is read as Jan."""
    fixed = F.regexp_replace(F.regexp_replace(text, r"^an\b", "Jan"), " +", " ")
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), fixed), F.lit("yyyy MMM d HH:mm:ss"))


def parse_mail_events(lines: DataFrame, year: int, value: str = "value") -> DataFrame:
    """Login, Disconnected (failed) and Logged out lines of an IMAP server, with user, addresses, attempts, seconds and bytes; a logout has no address yet."""
    v = F.col(value)
    get = lambda p, i=1: F.regexp_extract(v, p, i)
    user, rip, lip = get(r"user=<([^>]*)>"), get(r"rip=([\d.]+)"), get(r"lip=([\d.]+)")
    failed, out = r"Disconnected \(auth failed, (\d+) attempts in (\d+) secs\)", r"imap\(([^)]*)\): Logged out in=(\d+) out=(\d+)"
    action = F.when(v.rlike(r"Login: user=<[^>]*>.*rip=[\d.]+, lip=[\d.]+"), "Login").when(v.rlike(failed + r": user=<[^>]*>.*rip=[\d.]+, lip=[\d.]+"), "Disconnected").when(v.rlike(out), "Logged out")
    number = lambda name, text, kind: F.when(F.col("action") == name, text).cast(kind)
    gone = F.col("action") == "Logged out"
    return lines.withColumn("action", action).filter("action is not null").select(
        *lines.columns, syslog_time(get(_SYSLOG, 1), year).alias("ts"), "action",
        F.when(gone, get(out)).otherwise(user).alias("user"), F.when(~gone, rip).alias("rip"), F.when(~gone, lip).alias("lip"),
        F.coalesce(number("Disconnected", get(failed, 1), "int"), F.lit(0)).alias("attempts"), F.coalesce(number("Disconnected", get(failed, 2), "int"), F.lit(0)).alias("duration_secs"),
        F.coalesce(number("Logged out", get(out, 2), "bigint"), F.lit(0)).alias("bytes_in"), F.coalesce(number("Logged out", get(out, 3), "bigint"), F.lit(0)).alias("bytes_out"),
    )


def parse_auth_events(lines: DataFrame, year: int, value: str = "value") -> DataFrame:
    """Login, session and privilege events of a system's authentication log; cron lines and unknown actions are dropped, a user's last dot too."""
    v = F.col(value)
    program, msg = F.trim(F.regexp_extract(v, _SYSLOG, 2)), F.regexp_extract(v, _SYSLOG, 3)
    has = lambda text: F.col("_m").contains(text)
    get = lambda p, i=1: F.nullif(F.regexp_extract("_m", p, i), F.lit(""))
    p, none = F.col("program"), F.lit(None).cast("string")
    ssh, systemd = p == "sshd", p.contains("systemd")
    login, opened = r"for (?:invalid user )?(\S+) from (\S+)", r"for user (\S+)"
    # one structure a kind of line: its test, action, user and address
    kinds = (
        (ssh & has("Accepted"), "Login Success", get(login), get(login, 2)), (ssh & has("Failed"), "Login Failed", get(login), get(login, 2)),
        (ssh & (has("Disconnected from") | has("Received disconnect")), "Disconnected", none, get(r"from (?:invalid user )?(\S+)")),
        (ssh & has("session opened"), "Session Opened", get(opened), none), (ssh & has("session closed"), "Session Closed", get(opened), none),
        ((p == "auth") & has("authentication failure"), "Login Failed", get(r"rhost=\S+\s+user=(\S+)"), get(r"rhost=(\S+)\s+user=")),
        ((p == "su") & has("Successful su for"), "Privilege Escalation (su)", get(r"for (\S+) by \S+"), none), ((p == "sudo") & has("COMMAND="), "Sudo Command", get(r"USER=(\S+)\s+;\s+COMMAND="), none),
        (systemd & (has("session opened") | has("New session")), "Systemd Session Opened", get(r"user (\S+)"), none),
    )
    event = None
    for test, action, user, rip in kinds:
        found = F.struct(F.lit(action).alias("action"), F.regexp_replace(user, r"\.$", "").alias("user"), rip.alias("rip"))
        event = F.when(test, found) if event is None else event.when(test, found)
    parsed = lines.withColumns({"program": program, "_m": msg, "ts": syslog_time(F.regexp_extract(v, _SYSLOG, 1), year)}).filter("program <> 'CRON' and ts is not null")
    return parsed.select(*lines.columns, "ts", "program", F.explode(F.array_compact(F.array(event))).alias("_e")).select(*lines.columns, "ts", "program", "_e.action", "_e.user", "_e.rip")


def parse_rule_events(lines: DataFrame, year: int, value: str = "value") -> DataFrame:
    """Events for the alert rules: IMAP logins, SMTP connections (address and reason read apart), queue lines, other system lines; the rest is dropped."""
    v = F.col(value)
    get = lambda p, i=1: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    imap, smtp, queue, system = r"(?:dovecot:\s+imap-login:|auth:\s+pam_unix\(dovecot:auth\):)\s+([^;:]+)", r"postfix/smtpd\[\d+\]:\s+(NOQUEUE: reject|connect|disconnect)", r"postfix/qmgr\[\d+\]:.*queue active", r"\s(?:CRON\[\d+\]|sshd\[\d+\]|systemd[^:]*):\s+(.*)"
    is_imap = v.rlike(imap) & v.rlike(r"(user=<|ruser=\S)") & v.rlike(r"(rip|rhost)=[\d.]+")
    is_smtp, is_queue, is_system = v.rlike(smtp), v.rlike(queue), v.rlike(system)
    service = F.when(is_imap, "dovecot").when(is_smtp | is_queue, "postfix").when(is_system, "system")
    user = F.when(is_imap, F.coalesce(get("user=<([^>]*)>"), get(r"ruser=(\S+)"), F.lit("unknown"))).when(is_queue, F.coalesce(get("from=<([^>]*)>"), F.lit("unknown"))).when(is_smtp, "unknown").otherwise("local_system")
    ip = F.when(is_imap, F.coalesce(get(r"rip=([\d.]+)"), get(r"rhost=([\d.]+)"))).when(is_smtp, F.coalesce(get(r"from \S*\[([\d.]+)\]"), F.lit("unknown"))).when(is_queue, None).otherwise("127.0.0.1")
    action = F.when(is_imap, get(imap)).when(is_smtp, get(smtp)).when(is_queue, "queue active").otherwise(get(system))
    return lines.withColumn("service", service).filter("service is not null").select(
        *lines.columns, syslog_time(get(r"^([A-Z]?[a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})"), year).alias("ts"), "service", action.alias("action"), user.alias("user"), ip.alias("ip"),
        F.when(is_smtp, get("(User unknown|Relay access denied)")).alias("reason"),
    )


#: Lines of a dump that are numbered together.
STRETCH = 10_000
METHODS = "GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT"


def request_blocks(lines: DataFrame, file: str = "source_file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(source_file, block, raw): requests of dump files; a line that begins with a method opens the next one.

    Blocks are numbered within stretches of STRETCH lines, and those of the stretches before are added: a file is as many
    tasks as it has stretches, and a request may go over their ends.
    """
    rows = lines.withColumn("_opens", F.coalesce(F.col(value).rlike(f"^({METHODS}) ").cast("int"), F.lit(0))).withColumn("_part", F.floor(F.col(line_no) / STRETCH))
    opened = rows.groupBy(F.col(file).alias("_file"), F.col("_part").alias("_p")).agg(F.sum("_opens").alias("_n"))
    before = opened.withColumn("_before", F.sum("_n").over(Window.partitionBy("_file").orderBy("_p")) - F.col("_n")).drop("_n")
    w = Window.partitionBy(file, "_part").orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_own", F.sum("_opens").over(w)).join(before, (F.col(file) == F.col("_file")) & (F.col("_part") == F.col("_p")))
    numbered = own.withColumn("block", F.col("_own") + F.col("_before")).filter("block > 0")
    ordered = F.array_sort(F.collect_list(F.struct(line_no, value)))
    return numbered.groupBy(file, "block").agg(F.array_join(F.transform(ordered, lambda x: x[value]), "\n").alias("raw"))


def parse_http_request(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with method, url, path, protocol, headers (map of lower-case names), body_raw, values of query and form parameters, is_malformed.

    Headers go on in lines that begin with white space.
    """
    text = F.regexp_replace(F.col(raw), "\r\n", "\n")
    head, body = F.substring_index(text, "\n\n", 1), F.when(text.contains("\n\n"), F.substring(text, F.instr(text, "\n\n") + 2, 1 << 30)).otherwise("")
    joined = F.regexp_replace(head, r"\n[ \t]+", " ")
    first = F.substring_index(joined, "\n", 1)
    request = rf"^({METHODS}) (\S+)(?: (HTTP/\S+))?\s*$"
    pairs = F.transform(F.filter(F.slice(F.split(joined, "\n"), 2, 1000), lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, 1 << 30)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    headers = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))
    url = F.regexp_extract(first, request, 2)
    form = F.concat_ws("&", F.when(url.contains("?"), F.substring(url, F.instr(url, "?") + 1, 1 << 30)), F.nullif(F.trim("_body"), F.lit("")))
    values = F.transform(F.filter(F.split(form, "&"), lambda x: x.contains("=")), lambda x: F.substring(x, F.instr(x, "=") + 1, 1 << 30))
    return df.withColumn("_body", body).withColumns({
        "method": F.nullif(F.regexp_extract(first, request, 1), F.lit("")), "url": url, "path": F.substring_index(F.regexp_replace(url, "^https?://[^/]*", ""), "?", 1),
        "protocol": F.regexp_extract(first, request, 3), "headers": headers, "body_raw": F.col("_body"), "param_values": values, "is_malformed": ~first.rlike(request),
    }).drop("_body")


def multipart_values(df: DataFrame, body: str = "body_raw", content_type: str = "content_type") -> DataFrame:
    """df with multipart_values: the parts of multipart bodies, by the standard library; empty for other bodies."""

    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from email import message_from_string

        for types, bodies in batches:
            out = []
            for t, b in zip(types, bodies):
                message = message_from_string(f"Content-Type: {t}\n\n{b}") if t and "multipart" in t else None
                out.append([p.get_payload() for p in message.get_payload()] if message is not None and message.is_multipart() else [])
            yield pd.Series(out)

    return df.withColumn("multipart_values", F.pandas_udf(parts, "array<string>")(F.col(content_type), F.col(body)))
