"""Helpers that the text operators share: shared storage, word hashes, components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Spans of more bytes are hashed one by one; those up to it all at once.
_SHORT = 128
#: Places over which the partners of one node are spread where they meet it.
SPREAD = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (now.get() if now.isDefined() else None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not now.isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def map_named(docs: DataFrame, id_col: str, text_col: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Frames of (id, text) of docs through run, which gives id and the columns of schema; the result's ids have the type of docs' ids.

    Ids travel as text: pandas makes integers beside a null floats, which round those beyond 2 ** 53.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id string, {schema}").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; Spark removes them when nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffle files of each query as soon as the query has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


class Tables:
    """Intermediate tables in the shared folder, for an operator that is done with all of them before it returns."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.places = spark, shared_path(spark, name), {}

    def keep(self, df: DataFrame) -> DataFrame:
        place = f"{self.path}/{len(self.places) + 1}"
        with brief_shuffles(self.spark):
            df.write.parquet(place)
        kept = self.spark.read.schema(df.schema).parquet(place)
        self.places[id(kept)] = place, kept
        return kept

    def drop(self, table: DataFrame | None = None) -> None:
        """Removes one table, or all of them."""
        drop_path(self.spark, self.places[id(table)][0] if table is not None else self.path)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x ^= x >> np.uint64(27)
    x = x * _M3
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes a step through a mixing function, BLAKE2 for long spans."""
    size = end - begin
    out = size.astype(np.uint64) * _M1
    eight = np.ndarray((len(data),), "<u8", buffer=data + bytes(8), strides=(1,))
    at = np.flatnonzero(size <= _SHORT)
    for k in range(0, _SHORT, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        block = eight[begin[at] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        out[at] = mix((out[at] ^ block) * _M1 + np.uint64(k))
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    return out


def chunks(texts: list[bytes] | list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of whole texts of about `most` bytes (or characters) together, so that arrays over their bytes stay small."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


class Words:
    """Words of some texts: a 64-bit hash, the byte span and the text of each; texts are joined by line feeds."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        self.text_at = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)
        inside = ~_SPACES[self.bytes]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        self.begin, self.end = edge[::2], edge[1::2]
        self.hash = span_hashes(joined, self.begin, self.end)
        self.first = np.searchsorted(self.begin, self.text_at)  # of each text; one more at the end


def shingles(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of each run of `size` words of one text, in order; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : n - k + 1 + i]) * _M1
        out ^= out >> np.uint64(32)
    return mix(out)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold only whole groups of rows with equal keys, from frames in which such rows follow each other."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[keys].iloc[-1]
        same = np.ones(len(pdf), bool)
        for k in keys:
            same &= (pdf[k] == last[k]).to_numpy()
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if begin == 0 and rest and all(rest[-1][k].iloc[-1] == last[k] for k in keys):
            rest.append(pdf)
            continue
        if begin or rest:
            yield pd.concat([*rest, pdf.iloc[:begin]], ignore_index=True)
        rest = [pdf.iloc[begin:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def place(other: str) -> Column:
    """Where a node meets this partner: one of SPREAD places, so that a node with very many partners meets them in as many tasks."""
    return F.pmod(F.xxhash64(other), F.lit(SPREAD))


def beside(pairs: DataFrame, side: str, other: str, table: DataFrame) -> DataFrame:
    """pairs joined with the row of table (whose key is named as side) of one of their two nodes, spread by the other."""
    dealt = pairs.withColumn("s", place(other))
    return dealt.join(dealt.select(side, "s").distinct().join(table, side), [side, "s"]).drop("s")


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, component) of every node in edges (a, b): the smallest node that it is connected with. keep stores each step's edges.

    Alternates large-star and small-star steps (Kiveris and others, 2014). Every step is a grouped minimum and a
    join; the partners of a node are dealt to SPREAD places, so that no component meets in one task or on the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("s", place("b"))
        parts = both.groupBy("a", "s").agg(F.min("b").alias("low"))
        low = parts.groupBy("a").agg(F.min("low").alias("low")).withColumn("low", F.least("a", "low"))
        near = both.join(parts.select("a", "s").join(low, "a"), ["a", "s"]).drop("s")
        if large:
            return near.filter("b > a").select(F.col("low").alias("a"), "b").filter("a < b")
        found = near.filter("b < a").select(F.col("low").alias("a"), "b").union(low.select(F.col("low").alias("a"), F.col("a").alias("b")))
        return found.filter("a < b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    now = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    was = mark(now)
    while was[0]:
        now = keep(star(keep(star(now, True)), False))
        if (is_now := mark(now)) == was:
            break
        was = is_now
    labelled = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return labelled.union(now.select("a", "a").distinct())
