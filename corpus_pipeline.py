"""The training-text pipeline: documents through quality, deduplication, mixing and tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.common import cut, drop_path, read, shared_path
from vigilog.llm.exact_dedup import drop_exact_duplicates
from vigilog.llm.minhash import drop_near_duplicates
from vigilog.llm.mixing import mix_sources
from vigilog.llm.pu_classifier import PREDICT_AT, scorer, train
from vigilog.llm.sentencepiece_fst import encode_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good; null and empty texts are scored like others."""
    score = scorer(train(docs, read(spark, sf_dir, "labels")))
    return docs.filter(score("text") >= PREDICT_AT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each different text, that with the largest id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows without words or without an id stay."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; their own columns move as one, whatever their names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    mixed = mix_sources(docs.select("doc_id", "text", "source", whole), columns=["document"]).filter("epochs > 0")
    return mixed.select("document", F.explode(F.sequence(F.lit(1).cast("bigint"), "epochs")).alias("epoch")).select("document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and counts of every document of the mix."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "n_fallback", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what lies between stages is written to the shared folder and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    found = cut(STAGES[-1][1](spark, docs, sf_dir))
    drop_path(spark, before)
    return found
