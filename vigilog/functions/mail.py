"""Columns of e-mail: links, plain text, authentication results, reply addresses, attachments, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://[^\s<>\"']+"


def extract_urls(text: Column) -> Column:
    """The different http(s) addresses of a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), 0))


def strip_html(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def auth_result(headers: Column, check: str) -> Column:
    """Pass, Fail (a soft failure too, for spf) or None/Unknown of spf, dkim or dmarc."""
    text = F.lower(F.coalesce(headers, F.lit("")))
    fails = text.contains(f"{check}=fail")
    if check == "spf":
        fails = fails | text.contains("spf=softfail")
    return F.when(text.contains(f"{check}=pass"), "Pass").when(fails, "Fail").otherwise("None/Unknown")


def address_of(header: Column) -> Column:
    """The lower-case address in angle brackets, or the whole header."""
    text = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    inside = F.regexp_extract(text, "<([^>]+)>", 1)
    return F.when(inside != "", inside).otherwise(text)


def domain_of(address: Column) -> Column:
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise("")


def reply_to_mismatch(from_header: Column, reply_to: Column) -> Column:
    """Whether replies go to another domain than the sender's."""
    a, b = address_of(from_header), address_of(reply_to)
    return (b != "") & (a != b) & (domain_of(a) != domain_of(b))


def attachment_hashes(content: Column) -> Column:
    return F.struct(F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("size"))


def static_file_signature(content: Column) -> Column:
    """An executable's header at the start, or either of two script commands in any case."""
    text = F.lower(F.decode(content, "ISO-8859-1"))
    return (F.substring(F.decode(content, "ISO-8859-1"), 1, 2) == "MZ") | text.contains("powershell.exe -nop -w hidden") | text.contains("wscript.shell")


def verdict(score: Column, reject: int = 50, quarantine: int = 20) -> Column:
    return F.when(score >= reject, "REJECT").when(score >= quarantine, "QUARANTINE").otherwise("ACCEPT")
