"""Text decoding that built-in functions can't do: percent signs, HTML entities, encoded fragments. Vectorised, on rows that need it."""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_DECODINGS = 5
_PADDED = re.compile(r"[A-Za-z0-9+/]{12,}={1,2}")
_BARE = re.compile(r"[A-Za-z0-9+/]{40,}")
_HEX = re.compile(r"0x([0-9a-fA-F]{8,})")
#: How base64 of a JSON array of texts begins: two characters, and a third that its third byte has a part in.
JSON_START = base64.b64encode(b'["').decode()[:2] + "[I-L]"
_JSON = re.compile(JSON_START + "[A-Za-z0-9+/]+")
_READABLE = re.compile(r"[\w/ -]{3}", re.ASCII)


def decode_depth(text: str) -> int:
    """How many times decoding changes a text, five at most."""
    depth = 0
    while depth < MOST_DECODINGS and (after := unquote(text)) != text:
        text, depth = after, depth + 1
    return depth


def fully_decoded(text: str) -> str:
    for _ in range(MOST_DECODINGS):
        after = unquote(text)
        if after == text:
            break
        text = after
    return text


def _fragments(text: str) -> str:
    """The ASCII part of what base64 and hexadecimal fragments of a text say, each once, where three characters in a row can be read."""
    raw: list[bytes] = []
    for code in dict.fromkeys(m.group().rstrip("=") for pattern in (_PADDED, _BARE, _JSON) for m in pattern.finditer(text)):
        try:
            raw.append(base64.b64decode(code + "=" * (-len(code) % 4)))
        except binascii.Error:
            continue
    raw += [bytes.fromhex(x[: len(x) // 2 * 2]) for x in dict.fromkeys(_HEX.findall(text))]
    return " ".join(x for x in (r.decode("ascii", "ignore") for r in raw) if _READABLE.search(x))


def payload_of(text: str, sanitize: bool) -> str:
    decoded = fully_decoded(text)
    whole = f"{decoded} {_fragments(decoded)}".strip().lower()
    return re.sub(r"[\"'\[\]]", "", whole) if sanitize else whole


@F.pandas_udf(T.StructType([T.StructField("once", T.StringType()), T.StructField("depth", T.IntegerType())]))
def _decode_uri(uris: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"once": [unquote(u) if u is not None else None for u in uris], "depth": [decode_depth(u) if u is not None else 0 for u in uris]})


def decode_uri(uri: Column) -> Column:
    return _decode_uri(uri)


def normalize_payload(*parts: Column, sanitize: bool = True, between: str = " ") -> Column:
    """Path, query, body, agent and referer as one lower-case text, decoded up to five times, with what its encoded fragments say.

    Texts without a percent sign, '0x', a long run of base64 characters or the start of a JSON array in it stay in the JVM.
    """
    joined = F.concat_ws(between, *parts)
    needs = joined.contains("%") | joined.contains("0x") | joined.rlike(rf"{JSON_START}|[A-Za-z0-9+/]{{12,}}={{1,2}}|[A-Za-z0-9+/]{{40,}}")

    @F.pandas_udf(T.StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: payload_of(x, sanitize) if x is not None else None)

    plain = F.lower(F.trim(joined))
    return F.when(needs, run(F.when(needs, joined))).otherwise(F.regexp_replace(plain, r"[\"'\[\]]", "") if sanitize else plain)


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        for _ in range(3):
            text = re.sub(r"[\x00\s]", "", html.unescape(text))
        return text

    return texts.map(lambda x: one(x) if x is not None else None)


def unescape_html(text: Column) -> Column:
    """A text without white space and NUL, HTML entities resolved up to three times; only texts with '&' leave the JVM."""
    needs, bare = text.contains("&"), text
    for sign in "\0 \t\n\x0b\f\r":
        bare = F.replace(bare, F.lit(sign), F.lit(""))
    return F.when(needs, _unescaped(F.when(needs, text))).otherwise(bare)
