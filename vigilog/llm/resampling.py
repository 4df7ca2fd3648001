"""Importance resampling: documents are drawn by how much likelier their n-grams are in a target than in the corpus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilog.llm.common import chunks, cut

LONGEST = 1
#: Buckets of n-grams; two arrays of so many numbers are all that reaches the driver or is broadcast.
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"

_WORD = re.compile(rb"([0-9a-z\x80-\xff]+)")
_LOWER = bytes(range(256)).lower()
#: Stands between the texts of a batch; it is in no word.
_SENTINEL = b"\n"


def grams(texts: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and CRC-32 of every run of 1 to `longest` words of some texts, and each text's number of words.

    The texts are joined by a sentinel and one pass of a regular expression finds all words. Whose they are is told by
    their places among the texts' ends; runs whose first and last word are of different texts are masked.
    """
    parts = _WORD.split(_SENTINEL.join(texts).translate(_LOWER))
    words = parts[1::2]
    begin = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1:2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    found = [(owner, crc)]
    for n in range(1, longest):
        crc = np.fromiter((zlib.crc32(b" " + w, c) for w, c in zip(words[n:], crc.tolist())), np.int64, max(len(words) - n, 0))
        whole = owner[n:] == owner[: len(crc)]
        found.append((owner[n:][whole], crc[whole]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), np.bincount(owner, minlength=len(texts))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all texts by bucket; each task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = _texts(batch)
            for part in chunks(texts):
                total += np.bincount(grams(texts[part], longest)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, with one n-gram more in every bucket."""
    s, t = corpus.astype(float), target.astype(float)
    size = len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, columns: list[str] | None = None) -> DataFrame:
    """row (the named columns of docs), id, n_features, n_words and weight (sum of the gains of all n-grams) of each row of docs."""
    own = F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("row")
    rows = docs.select(own, F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _texts(batch), [np.zeros((3, 0), np.int64)]
            for part in chunks(texts):
                owner, crc, n_words = grams(texts[part], longest)
                order = np.argsort(owner, kind="stable")
                upto = np.r_[0, np.cumsum(shared.value[crc[order] % len(shared.value)])]
                n = np.bincount(owner, minlength=len(n_words))
                ends = np.cumsum(n)
                found.append(np.stack([n, n_words, upto[ends] - upto[ends - n]]))
            measures = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *map(pa.array, measures)], names=["row", "id", "n_features", "n_words", "weight"])

    kinds = StructType([rows.schema["row"], rows.schema["id"], *(StructField(c, LongType()) for c in ("n_features", "n_words", "weight"))])
    return rows.mapInArrow(measure, kinds)


def with_places(df: DataFrame, *order) -> DataFrame:
    """The rows of df in the given order with their place, from 1. Sorted by ranges; a row a range is summed."""
    ordered = cut(df.orderBy(*order))
    numbered = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, columns: list[str] | None = None,
) -> DataFrame:
    """The rows of docs (or the named columns of them) with n_features, weight, score and rank.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased. Every run
    of 1 to `longest` of them is a feature, repeats counted, in the bucket of its CRC-32. A document's weight is the sum
    of its features' gains; score adds Gumbel noise from the SHA-256 of seed and id, so that the highest scores are a
    draw without replacement by exp(weight / 1000). Of documents with least_words words or more `percent` percent are
    drawn: rank is 1, 2, 3 ... by falling score, ties to the smaller id, and null for what isn't drawn.

    Null texts have no words. A null id counts as the text "null" for the noise and comes last among ties. Each row is a
    document; rows that share id and score follow each other in any order. Columns of docs with the names of the new ones
    are replaced; other names don't matter. An empty table gives an empty result; an empty target still weighs.
    """
    own = [c for c in columns or docs.columns if c not in ("n_features", "weight", "score", "rank")]
    counts = []
    for table in (docs, target):
        found = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, text_col, longest, buckets).collect():
            found[r["bucket"]] = r["n"]
        counts.append(found)
    rows = weigh(docs, bucket_gains(*counts), id_col, text_col, longest, own)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 2**32)))
    scored = cut(rows.withColumn("score", (F.col("weight") + noise).cast("bigint")))
    fit = F.col("n_words") >= least_words
    drawn = scored.filter(fit).count() * percent // 100
    placed = with_places(scored.withColumn("nth_row", F.monotonically_increasing_id()), (~fit), F.desc("score"), F.col("id").asc_nulls_last(), "nth_row")
    rank = F.when(fit & (F.col("place") <= drawn), F.col("place"))
    return placed.select(*(F.col(f"row.`{c}`") for c in own), "n_features", "weight", "score", rank.cast("bigint").alias("rank"))
