"""Queries of readers: rows of the given tables are written as files of each kind, read again and compared with what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators.parse import parse_http_request
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import query
from vigilog.sources import readers, writers
from vigilog.sources.storage import shared_path


@query(f"""{cte("web")} SELECT count(*) AS lines, count(DISTINCT 'x' || CAST(event_id AS STRING)) AS places, CAST(sum(length(source_ip)) AS BIGINT) AS characters FROM web WHERE event_source = 'combined_access'""")
def s1_read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line has a place of its own, and all are there."""
    path = shared_path(spark, "lines")
    adapter(spark, sf_dir, "web").filter("event_source = 'combined_access'").select("source_ip").repartition(4).write.text(path)
    lines = readers.read_log_lines(spark, path)
    return lines.agg(F.count("*").alias("lines"), F.count_distinct("source_file", "line_no").alias("places"), F.sum(F.length("value")).alias("characters"))


@query(f"""{cte("windows")} SELECT event_id, EventID AS "EventID", us // 1000000 AS seconds, "SubjectUserName", CASE WHEN EventID = 4663 THEN "ObjectName" ELSE '' END AS "ObjectName" FROM windows""")
def s2_read_windows_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = shared_path(spark, "events"), adapter(spark, sf_dir, "windows")
    data = F.create_map(F.lit("SubjectUserName"), F.col("SubjectUserName"), F.lit("ObjectName"), F.when(F.col("EventID") == 4663, F.col("ObjectName")).otherwise(""), F.lit("TaskName"), F.col("event_id").cast("string"))
    time = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.date_format(F.col("TimeCreated").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("DateTime")))).otherwise(F.date_format(F.col("TimeCreated").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    even = df.select(F.col("EventID").alias("Id"), time.alias("TimeCreated"), data.alias("EventData"))
    even.write.json(path)
    found = readers.read_windows_events_json(spark, path, multi_line=False)
    return found.select(F.col("TaskName").cast("bigint").alias("event_id"), "EventID", F.unix_seconds("TimeCreated").alias("seconds"), "SubjectUserName", "ObjectName")


#: Rows of a CSV export, at most.
EXPORT_ROWS = 500_000


@query(f"""{cte("windows")} SELECT encoding, event_id, EventID AS "EventID", "SubjectUserName" || ' Jos\u00e9' AS "SubjectUserName" FROM windows, (SELECT unnest(['UTF-8', 'UTF-16', 'ISO-8859-1']) AS encoding)""")
def s4_read_windows_events_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as exports in three encodings, which the reader finds out. A file is one task of the reader, so exports have EXPORT_ROWS rows at most."""
    df, found = adapter(spark, sf_dir, "windows"), []
    for encoding in readers.CSV_ENCODINGS:
        path = shared_path(spark, "csv")
        user = F.concat("SubjectUserName", F.lit(" Jos\u00e9"))
        df.select(F.col("EventID").alias("EVENT ID"), user.alias("Account Name"), F.col("event_id").alias("number ")).write.option("header", True).option("maxRecordsPerFile", EXPORT_ROWS).option("encoding", encoding).csv(path)
        read = readers.read_windows_events_csv(spark, path)
        found.append(read.select(F.lit(encoding).alias("encoding"), F.col("number").cast("bigint").alias("event_id"), F.col("EventID").cast("int").alias("EventID"), "SubjectUserName"))
    return found[0].union(found[1]).union(found[2])


@query(f"""{cte("flows")} SELECT flow_id, CASE WHEN flow_id % 5 = 0 THEN 0.0 ELSE CAST(bytes AS DOUBLE) END AS bytes, CAST(packets AS DOUBLE) AS packets FROM flows""")
def s5_read_flow_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = shared_path(spark, "flows"), adapter(spark, sf_dir, "flows")
    df.select("flow_id", F.when(F.col("flow_id") % 5 != 0, F.col("bytes")).alias(" Bytes"), F.col("packets").alias("Packets ")).write.option("header", True).csv(path)
    return readers.read_flow_csv(spark, path).select(F.col("flow_id").cast("bigint").alias("flow_id"), F.col("Bytes").alias("bytes"), F.col("Packets").alias("packets"))


@query(f"""{cte("requests")} SELECT method, url, body AS body_raw, count(*) AS n FROM requests GROUP BY ALL""")
def s6_read_http_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = shared_path(spark, "dump"), adapter(spark, sf_dir, "requests")
    df.select(F.concat("method", F.lit(" "), "url", F.lit(" HTTP/1.1\nHost: shop\n\n"), "body")).write.text(path)
    found = parse_http_request(readers.read_http_dump(spark, path))
    return found.select("method", "url", F.regexp_replace("body_raw", r"\n+$", "").alias("body_raw")).groupBy("method", "url", "body_raw").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(text) AS attachment_md5, 'a' || CAST(doc_id AS STRING) || '@x.example' AS sender FROM documents""")
def s7_read_eml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the attachment of a message; the messages are parsed as files are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.concat(F.lit("From: a"), F.col("doc_id").cast("string"), F.lit('@x.example\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="f"\nContent-Transfer-Encoding: base64\n\n'))
    mails = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(head, F.base64(F.col("text").cast("binary")), F.lit("\n--b--\n")).cast("binary").alias("content"))
    parsed = readers.parse_mails(mails)
    return parsed.select(F.col("path").cast("bigint").alias("doc_id"), F.md5(F.get("attachments", 0)["content"]).alias("attachment_md5"), "sender")


@query("""SELECT doc_id AS line, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low' END AS label FROM labels WHERE toxic = 1 OR quality = 0""")
def s8_read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = shared_path(spark, "labels"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).when(F.col("quality") == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    df.select(F.col("doc_id").alias("line"), named.alias("labels")).write.json(path)
    return readers.read_labels(spark, path).select("line", F.get("labels", 0).alias("label"))


@query("""SELECT doc_id, md5(text) AS content_hash, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate, CAST(NULL AS STRING) AS format, doc_id * 1000 AS first_us, doc_id * 1000 + 7 AS last_us FROM documents
UNION ALL SELECT -1, md5(l), false, 'common_access', NULL, NULL FROM (SELECT '10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 5' || chr(10) AS l)""")
def s9_ingest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files, with the times of two events each, and one file of an access log."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log = spark.range(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 5\n').alias("text"))
    files = docs.select("doc_id", "text").union(log).select(F.format_string("%012d", "doc_id").alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").cast("binary").alias("content"))
    events = docs.select(F.format_string("%012d", "doc_id").alias("source_file"), F.explode(F.array(F.col("doc_id") * 1000, F.col("doc_id") * 1000 + 7)).alias("us"))
    return readers.ingest_catalog(files, events).select(F.col("path").cast("bigint").alias("doc_id"), "content_hash", "is_duplicate", "format", "first_us", "last_us")


@query(f"""{cte("web")} SELECT kind, event_id, source_ip FROM web, (SELECT unnest(['json', 'csv']) AS kind)""")
def s10_write_event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines and as CSV, read back."""
    found = []
    for kind in ("json", "csv"):
        path = shared_path(spark, "texts")
        writers.write_events(adapter(spark, sf_dir, "web").select("event_id", "source_ip"), path, kind=kind)
        found.append(spark.read.format(kind).option("header", True).schema("event_id long, source_ip string").load(path).select(F.lit(kind).alias("kind"), "event_id", "source_ip"))
    return found[0].union(found[1])


@query(f"""{cte("web")} SELECT event_id, source_ip, CAST(CAST(ts AS DATE) AS STRING) AS date FROM web""")
def s10_write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in folders by date, read back."""
    path = shared_path(spark, "stored")
    writers.write_events(adapter(spark, sf_dir, "web"), path, time="ts", cluster_by="source_ip")
    return spark.read.parquet(path).select("event_id", "source_ip", F.col("date").cast("string").alias("date"))


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def s12_alert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, table = shared_path(spark, "sink"), f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table[:-1]}[t]").filter("event_type = 'error'").select("event_id")
    stream.writeStream.foreachBatch(writers.alert_sink(f"{path}/alerts", "parquet")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return writers.read_alerts(spark, f"{path}/alerts", stream.schema, "parquet").select("event_id")


