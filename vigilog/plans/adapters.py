"""Log-shaped views of the driver's tables, by arithmetic that Spark and DuckDB share.

Each adapter is a list of columns as SQL that both read alike; {us} stands for the microseconds of ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_ADAPTERS: dict[str, tuple[str, dict[str, str]]] = {
    "auth": ("events", {
        "event_id": "event_id", "ts": "ts", "us": "{us}",
        "rip": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE '10.0.0.' || CAST(user_id % 20 AS STRING) END",
        "lip": "CASE WHEN event_id % 5 = 0 THEN '10.0.0.' || CAST(user_id % 20 AS STRING) ELSE '10.0.3.1' END",
        "user": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'root' ELSE 'u' || CAST(event_id % 7 AS STRING) END",
        "program": "CASE event_type WHEN 'purchase' THEN 'sudo' WHEN 'click' THEN 'systemd' ELSE 'sshd' END",
        "action": "CASE event_type WHEN 'error' THEN 'Login Failed' WHEN 'signup' THEN 'Login Success' WHEN 'purchase' THEN 'Sudo Command' WHEN 'view' THEN 'Disconnected' ELSE 'Session Opened' END",
    }),
    "mail": ("events", {
        "event_id": "event_id", "ts": "ts", "us": "{us}",
        "user": "CASE WHEN event_id % 19 = 0 THEN 'unknown' ELSE 'm' || CAST(user_id % 50 AS STRING) END",
        "ip": "'172.20.' || CAST(user_id % 8 AS STRING) || '.' || CAST(event_id % 3 AS STRING)",
        "rip": "CASE WHEN event_type = 'view' THEN NULL ELSE '172.20.' || CAST(user_id % 8 AS STRING) || '.' || CAST(event_id % 3 AS STRING) END",
        "service": "CASE WHEN event_type IN ('click', 'purchase') THEN 'postfix' ELSE 'dovecot' END",
        "action": "CASE event_type WHEN 'error' THEN 'Disconnected (auth failed)' WHEN 'signup' THEN 'Login' WHEN 'view' THEN 'Logged out' WHEN 'click' THEN 'NOQUEUE: reject' ELSE 'queue active' END",
        "reason": "CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'User unknown' WHEN event_type = 'click' AND event_id % 3 = 1 THEN 'Relay access denied' END",
        "lat": "CAST(user_id % 8 * 20 - 70 AS DOUBLE)", "lon": "CAST(event_id % 3 * 100 - 90 AS DOUBLE)",
    }),
    "web": ("events", {
        "event_id": "event_id", "ts": "ts", "us": "{us}",
        "source_ip": "CASE WHEN user_id % 4 = 0 THEN '203.0.113.' ELSE '10.1.0.' END || CAST(user_id % 60 AS STRING)",
        "host": "'h' || CAST(user_id % 5 AS STRING)",
        "event_source": "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'apache_error' ELSE 'combined_access' END",
        "http_method": "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'POST' WHEN event_id % 29 = 0 THEN 'TRACE' ELSE 'GET' END",
        "uri_path": f"CASE event_type WHEN 'signup' THEN '/wp-login' WHEN 'purchase' THEN '/shop/pay' WHEN 'error' THEN '/old/' || CAST({_K} % 9 AS STRING) || '.php' WHEN 'view' THEN '/img/' || CAST({_K} % 5 AS STRING) || '.png' ELSE '/page/' || CAST({_K} % 7 AS STRING) END",
        "uri_query": "CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'q=' || CAST(event_id % 10 AS STRING) ELSE '' END",
        "status_code": "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 WHEN event_type = 'error' AND event_id % 3 = 1 THEN 403 WHEN event_type = 'error' THEN 404 ELSE 200 END",
        "bytes_sent": "CAST(floor(value * 10) AS BIGINT)",
        "user_agent": "'agent' || CAST(event_id % 4 AS STRING)",
        "flagged": "event_id % 23 = 0",
        "alert": "CASE WHEN event_id % 23 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'SQLi' ELSE 'XSS' END END",
        "error_message": "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'failure ' || CAST(event_id % 3 AS STRING) END",
    }),
    "windows": ("events", {
        "event_id": "event_id", "TimeCreated": "ts", "us": "{us}",
        "EventID": "CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 4663 ELSE 5145 END WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 5140 ELSE 4656 END WHEN 'error' THEN 4625 WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 4648 ELSE 4624 END ELSE CASE event_id % 6 WHEN 0 THEN 4698 WHEN 1 THEN 7045 WHEN 2 THEN 1102 WHEN 3 THEN 4660 ELSE 4688 END END",
        "SubjectUserName": "'w' || CAST(user_id % 40 AS STRING)",
        "TargetUserName": "CASE WHEN event_id % 9 = 0 THEN '' ELSE 't' || CAST(user_id % 11 AS STRING) END",
        "ObjectName": f"CASE WHEN event_type = 'click' THEN 'D:\\data\\f' || CAST({_K} % 30 AS STRING) WHEN event_type = 'view' THEN '\\\\srv\\ADMIN$' ELSE '' END",
        "ShareName": "CASE WHEN event_type = 'view' THEN '\\\\srv\\s' || CAST(event_id % 4 AS STRING) ELSE '' END",
        "AccessMask": f"CASE WHEN event_id % 10 = 0 THEN '%%4416' WHEN event_id % 10 = 1 THEN '' WHEN event_id % 10 = 2 THEN 'not_a_hex' WHEN event_id % 10 = 3 THEN CAST({_K} % 32 AS STRING) WHEN event_id % 10 = 4 THEN '0x10003' WHEN event_id % 10 = 5 THEN NULL ELSE '0x' || CAST({_K} % 100 AS STRING) END",
        "IpAddress": "CASE WHEN event_id % 6 = 0 THEN 'local' WHEN event_id % 6 = 1 THEN '-' ELSE '10.9.0.' || CAST(event_id % 5 AS STRING) END",
        "ProcessName": "CASE WHEN event_type = 'click' THEN 'C:\\Windows\\explorer.exe' ELSE '' END",
        "NewProcessName": "CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'C:\\Windows\\System32\\CMD.EXE' ELSE 'C:\\app\\tool.exe' END ELSE '' END",
        "ParentProcessName": "CASE WHEN event_type = 'purchase' THEN 'parent' || CAST(event_id % 3 AS STRING) ELSE '' END",
    }),
    "flows": ("lineitem", {
        "flow_id": "l_orderkey * 10 + l_linenumber", "ts": "l_shipdate",
        "source_ip": "'10.2.' || CAST(l_suppkey % 250 AS STRING) || '.1'", "destination_ip": "'10.3.0.' || CAST(l_partkey % 200 AS STRING)",
        "bytes_sent": "CAST(floor(l_extendedprice) AS BIGINT)", "bytes_received": "CAST(floor(l_extendedprice * l_discount) AS BIGINT)",
        "bytes": "CAST(floor(l_extendedprice) AS BIGINT) + CAST(floor(l_extendedprice * l_discount) AS BIGINT)",
        "pkts_sent": "CAST(l_quantity AS BIGINT)", "pkts_received": "CAST(l_linenumber AS BIGINT)", "packets": "CAST(l_quantity AS BIGINT) + l_linenumber",
        "elapsed": "l_tax * 100", "label": "CASE WHEN l_returnflag = 'R' THEN ' attack' WHEN l_returnflag = 'A' THEN NULL ELSE ' normal ' END",
        "score": "l_discount - l_tax",
    }),
    "scored": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber", "detector_a": "l_discount * 10 >= 0.7", "detector_b": "l_quantity > 30",
        "score": "CAST(l_partkey % 101 AS DOUBLE)", "truth": "CASE WHEN (l_partkey % 101) + (l_suppkey % 37) > 80 THEN 1 ELSE 0 END",
        "payload": "'p' || CAST(l_partkey AS STRING)",
    }),
    "requests": ("pages", {
        "page_id": "page_id", "url": "url", "method": "CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END",
        "path": "CASE WHEN page_id % 6 = 0 THEN '/tienda1/publico/ver.jsp' WHEN page_id % 9 = 0 THEN '/a/b.png' ELSE regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) END",
        "n_headers": "page_id % 9", "content_type": "CASE WHEN page_id % 3 = 0 THEN 'application/X-www-form-urlencoded' WHEN page_id % 3 = 1 THEN 'text/plain' END", "malformed": "page_id % 17 = 0",
        "body": "CASE WHEN page_id % 17 = 0 THEN 'mail=who%40site.example&pad=aaaaaaaaaaaa&n=12345' WHEN page_id % 19 = 0 THEN 'up=..%2f..%252fx+y&up=user@site.example' WHEN page_id % 5 = 0 THEN 'name=union select&x=1' WHEN page_id % 7 = 0 THEN 'f=%2e%2e%2fetc;cat' WHEN page_id % 11 = 0 THEN 'q=<script>alert(1)</script>' WHEN page_id % 13 = 0 THEN 'z=%2500' ELSE '' END",
    }),
    "turns": ("conversations", {
        "session_id": "conv_id", "seq": "turn", "us": "conv_id * 3600000000 + turn * 60000000",
        "apt_phase": "CASE (conv_id + turn) % 5 WHEN 0 THEN 'reconnaissance' WHEN 1 THEN 'initial_access' WHEN 2 THEN 'execution' WHEN 3 THEN 'collection' ELSE 'reconnaissance' END",
        "severity": "CASE WHEN turn % 4 = 3 THEN 'CRITICAL' WHEN turn % 4 = 1 THEN 'WARNING' ELSE 'NORMAL' END",
    }),
}


def adapter(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    table, columns = _ADAPTERS[name]
    us = "timestampdiff(MICROSECOND, CAST('1970-01-01 00:00:00' AS TIMESTAMP_NTZ), CAST(ts AS TIMESTAMP_NTZ))"
    path = f"{sf_dir}/{table}.parquet"
    read = spark.read.parquet(path)
    if stream:
        # as a pattern, since a stream's plain path must be a folder; with event times that a watermark takes
        read = spark.readStream.schema(read.schema).parquet(f"{path[:-1]}[{path[-1]}]")
        read = read.withColumns({c: read[c].cast("timestamp") for c, kind in read.dtypes if kind == "timestamp_ntz"})
    return read.selectExpr(*(f"{sql.replace('{us}', us).replace(chr(92), chr(92) * 2)} AS `{c}`" for c, sql in columns.items()))


def cte(*names: str) -> str:
    """WITH clauses of the adapters for DuckDB."""
    found = []
    for name in names:
        table, columns = _ADAPTERS[name]
        listed = ", ".join(f'{sql.replace("{us}", "epoch_us(ts)")} AS "{c}"' for c, sql in columns.items())
        found.append(f"{name} AS (SELECT {listed} FROM {table})")
    return "WITH " + ", ".join(found)
