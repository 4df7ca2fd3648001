"""Readers of logs, events, flows, mails and labels, and the catalogue of ingested files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.operators.events import FIELDS


def read_log_lines(spark: SparkSession, path: str, keep_numbers: bool = True) -> DataFrame:
    """(source_file, line_no, value) of text files, numbered from 1.

    Splits of a file are numbered apart and the lines of the splits before are added, so that no task
    holds a whole file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    if not keep_numbers:
        return lines.select("source_file", "value")
    sizes = lines.groupBy("source_file", "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block")) - F.col("_n")).drop("_n")
    own = lines.withColumn("_i", F.row_number().over(Window.partitionBy("source_file", "_block").orderBy("_id")))
    return own.join(before, ["source_file", "_block"]).select("source_file", (F.col("_i") + F.col("_before")).alias("line_no"), "value")


_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
WINDOWS_JSON = T.StructType([
    T.StructField("Id", T.LongType()), T.StructField("EventID", T.LongType()),
    T.StructField("TimeCreated", T.StringType()), T.StructField("EventData", _TEXT_MAP), T.StructField("UserData", T.MapType(T.StringType(), _TEXT_MAP)),
    T.StructField("Properties", T.ArrayType(T.StructType([T.StructField("Value", T.StringType())]))),
    *(T.StructField(f, T.StringType()) for f in FIELDS),
])


def _event_time(text: Column) -> Column:
    """A time as text, as {"DateTime": ...}, or as /Date(milliseconds)/."""
    inner = F.coalesce(F.get_json_object(text, "$.DateTime"), text)
    ms = F.nullif(F.regexp_extract(inner, r"/Date\((\d+)", 1), F.lit(""))
    iso = F.regexp_replace(F.regexp_replace(inner, r"(\.\d{6})\d+", "$1"), "Z$", "")
    return F.coalesce(F.try_to_timestamp(iso), F.timestamp_millis(ms.cast("bigint")))


def read_windows_events_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Events of JSON arrays, objects or lines: EventID, TimeCreated, named fields from flat keys, EventData or UserData, properties (array of text)."""
    df = spark.read.option("multiLine", multi_line).option("encoding", "UTF-8").schema(WINDOWS_JSON).json(path)
    user_data = F.aggregate(F.map_values("UserData"), F.create_map().cast(_TEXT_MAP), lambda s, m: F.map_concat(s, m))
    field = lambda f: F.coalesce(F.col(f), F.col("EventData")[f], F.col("_u")[f])
    return df.withColumn("_u", user_data).select(
        F.coalesce("Id", "EventID").cast("int").alias("EventID"), _event_time(F.col("TimeCreated")).alias("TimeCreated"),
        *(field(f).alias(f) for f in FIELDS), F.transform("Properties", lambda p: p["Value"]).alias("properties"),
    )


#: Header names of CSV exports that stand for a column, in any case.
CSV_SYNONYMS = {"EventID": ("eventid", "event id", "id", "event_id"), "TimeCreated": ("timecreated", "time created", "date and time", "timestamp", "timegenerated"), "SubjectUserName": ("subjectusername", "user", "username", "account name"), "Message": ("message", "description")}


#: Encodings that exports have, in the order in which they are tried.
CSV_ENCODINGS = ("UTF-8", "UTF-16", "ISO-8859-1")


def csv_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files under path by the first of CSV_ENCODINGS that all their bytes can be: without NUL and valid UTF-8, with NUL UTF-16, else the last.

    Every line is looked at, in the JVM; the driver gets a row a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.instr("value", "\0").alias("nul"), F.is_valid_utf8("value").alias("valid"))
    found: dict[str, list[str]] = {}
    for file, nul, valid in lines.groupBy("file").agg(F.max("nul") > 0, F.bool_and("valid")).orderBy("file").collect():
        found.setdefault(CSV_ENCODINGS[1] if nul else CSV_ENCODINGS[0] if valid else CSV_ENCODINGS[2], []).append(file)
    return found


def _standard_names(df: DataFrame) -> DataFrame:
    by_name = {c.strip().lstrip("\ufeff").lower(): c for c in df.columns}
    chosen = {by_name[s]: standard for standard, names in CSV_SYNONYMS.items() for s in reversed(names) if s in by_name}
    known = {f.lower(): f for f in FIELDS}
    return df.toDF(*(chosen.get(c) or known.get(c.strip().lower(), c.strip()) for c in df.columns))


def read_windows_events_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Columns of CSV exports under their standard names; headers are matched by synonym in any case and others kept.

    Without an encoding each file is read in the one that all its lines allow; files of different encodings may have
    different columns.
    """
    read = lambda name, files: _standard_names(spark.read.option("header", True).option("encoding", name).option("multiLine", True).csv(files))
    files = {encoding: [path]} if encoding else csv_encodings(spark, path)
    parts = [read(name, own) for name, own in files.items()] or [read(CSV_ENCODINGS[0], [path])]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more, allowMissingColumns=True)
    return found


FLOW_NUMBERS = ("Source Port", "Destination Port", "NAT Source Port", "NAT Destination Port", "Bytes", "Bytes Sent", "Bytes Received", "Packets", "Elapsed Time (sec)", "pkts_sent", "pkts_received")


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flows of a CSV export: headers trimmed, numbers typed, missing ones 0."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)) for c in FLOW_NUMBERS if c in df.columns})


def read_http_dump(spark: SparkSession, path: str) -> DataFrame:
    from vigilog.operators.parse import request_blocks

    return request_blocks(read_log_lines(spark, path))


#: Parsed headers that a task remembers.
HEADERS_KEPT = 1024
_MAIL = "path string, subject string, sender string, reply_to string, auth_headers string, body string, is_html boolean, attachments array<struct<filename:string,content:binary>>"


def parse_mails(files: DataFrame) -> DataFrame:
    """(path, subject, sender, reply_to, auth_headers, body, is_html, attachments) of (path, content) rows, one message each, by the standard library."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes
        from email.policy import EmailPolicy

        remember = lru_cache(HEADERS_KEPT)

        class Remembered(EmailPolicy):
            """The default policy, by which a header is parsed anew whenever it is asked for; here the last ones are remembered."""

            @remember
            def header_fetch_parse(self, name, value):
                return super().header_fetch_parse(name, value)

        default = Remembered()
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                m = message_from_bytes(bytes(content), policy=default)
                body = m.get_body(preferencelist=("plain", "html"))
                files = [{"filename": a.get_filename() or "", "content": a.get_payload(decode=True) or b""} for a in m.iter_attachments()]
                auth = " ".join(str(x) for h in ("Authentication-Results", "Received-SPF") for x in m.get_all(h, []))
                rows.append((path, str(m["Subject"] or ""), str(m["From"] or ""), str(m["Reply-To"] or ""), auth, body.get_content() if body else "", bool(body and body.get_content_type() == "text/html"), files))
            yield pd.DataFrame(rows, columns=["path", "subject", "sender", "reply_to", "auth_headers", "body", "is_html", "attachments"])

    return files.select("path", "content").mapInPandas(run, _MAIL)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    return parse_mails(spark.read.format("binaryFile").load(path))


def read_labels(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """(line, labels, rules) of JSON lines; those without labels are left out unless keep_empty."""
    df = spark.read.schema("line long, labels array<string>, rules map<string, array<string>>").json(path)
    return df if keep_empty else df.filter(F.size("labels") > 0)


def ingest_catalog(files: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(path, length, content_hash, is_duplicate, format[, first_us, last_us]) of binary files: of equal contents the first path is no duplicate.

    The format is that of a file's first lines (see detect_log_format), null if they are of none. events, if there are any, give
    the first and last time of each file.
    """
    from vigilog.operators.parse import SAMPLE_LINES, detect_log_format

    hashed = files.select("path", "length", F.md5("content").alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("path").alias("_first"))
    found = hashed.join(first, "content_hash").withColumn("is_duplicate", F.col("path") != F.col("_first")).drop("_first")
    head = F.slice(F.split(F.col("content").cast("string"), "\n", SAMPLE_LINES + 1), 1, SAMPLE_LINES)
    lines = files.select(F.col("path").alias("source_file"), F.posexplode(head).alias("line_no", "value")).withColumn("line_no", F.col("line_no") + 1)
    found = found.join(detect_log_format(lines).withColumnRenamed("source_file", "path"), "path", "left")
    if events is None:
        return found
    spans = events.groupBy(F.col("source_file").alias("path")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return found.join(spans, "path", "left")
