"""Supervised detectors on Spark's own learners: two-stage request detector, phishing text; rules over verdicts; warm-up."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.models import forest
from vigilog.sources.storage import computed_once


def fit_two_stage(train: DataFrame, features: list[str], label: str = "label", n_trees: int = 300, depth: int = 20, least: int = 5, forest_trees: int = 200, seed: int = 42, id_cols: tuple[str, ...] = ()):
    """(forest, random forest): the forest is fitted on normal rows and its score is a feature of the second; classes weigh alike."""
    first = forest.fit(train.filter(F.col(label) == 0), features, n_trees=forest_trees, sample=512, feature_fraction=0.8, id_cols=id_cols)
    counts = train.agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    weighted = train.crossJoin(F.broadcast(counts)).withColumn("_w", F.col("_n") / (2 * F.when(F.col(label) == 1, F.greatest("_p", F.lit(1))).otherwise(F.greatest(F.col("_n") - F.col("_p"), F.lit(1)))))
    assembled = _assemble(weighted, first)
    model = RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_w", numTrees=n_trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=seed).fit(assembled)
    return first, model


def _assemble(df: DataFrame, first: forest.Forest) -> DataFrame:
    typed = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in first.features}).withColumn("_stage1", forest.score_column(first))
    return VectorAssembler(inputCols=[*first.features, "_stage1"], outputCol="_v").transform(typed)


def score_two_stage(df: DataFrame, first: forest.Forest, model, blend: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """df with score: 0.4 of the forest's anomaly (0 to 1) and 0.6 of the classifier's probability."""
    scored = model.transform(_assemble(df, first))
    return scored.withColumn("score", blend[0] * -F.col("_stage1") + blend[1] * vector_to_array("probability")[1]).select(*df.columns, "score")


def feature_importance(spark, first: forest.Forest, model) -> DataFrame:
    """(feature, importance) by the classifier's Gini gain, and splits: how often the forest's nodes use it."""
    splits = [int((first.feature == i).sum()) for i in range(len(first.features))]
    values = model.featureImportances.toArray().tolist()
    rows = [(f, float(v), s) for f, v, s in zip([*first.features, "stage1_score"], values, [*splits, 0])]
    return spark.createDataFrame(rows, "feature string, importance double, splits int")


#: Characters of the texts that are looked at together, and of the texts whose terms are.
BLOCK_CHARS, BUCKET_CHARS = 4_000_000, 16_000_000
#: Tasks of a step at most; beyond, a task has several blocks or buckets, one after the other.
MOST_TASKS = 2000
_BLOCK, _MIX = "block int, bucket int", np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


@dataclass(frozen=True)
class PhishingModel:
    """terms: term (its 64-bit hash), n_docs, idf and the logarithms of its probability in plain (p0) and suspicious texts (p1); priors of both."""

    terms: DataFrame
    prior0: float
    prior1: float


def words_of(df: DataFrame, id_col: str, text: str, chars: int, *more: Column) -> DataFrame:
    """(id, block, words): 64-bit hashes of each text's words of two characters or more, in order. Texts are dealt to blocks by their id."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)[^\w]+", -1), lambda w: F.length(w) >= 2)
    block = F.pmod(F.xxhash64(id_col), F.lit(_parts(chars, BLOCK_CHARS))).cast("int")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), block.alias("block"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"), *more)
    return _apart(rows, "block", _parts(chars, BLOCK_CHARS))


def _apart(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows by a key of so many values, in tasks that Spark doesn't put together: their bytes are few for what there is to do."""
    return rows.repartition(min(parts, MOST_TASKS), key)


def _parts(chars: int | None, size: int) -> int:
    return max(1, -(-(chars or 0) // size))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(31))


def _terms_of(docs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each row's text by number (rows of one id are one text); its different terms in order; and (text, place of the term, tf) of each term of each text.

    Terms are words and pairs of neighbouring ones. A pair's hash is mixed of those of its words.
    """
    own = pd.factorize(docs["id"])[0]
    sizes = docs["words"].map(len).to_numpy()
    words = np.concatenate([np.empty(0, np.int64), *docs["words"]]).view(np.uint64)
    row = np.repeat(np.arange(len(docs)), sizes)
    first = np.flatnonzero(row[1:] == row[:-1])
    pairs = _mixed(words[first] * _MIX[0] + _mixed(words[first + 1] + _MIX[0]))
    at, terms = pd.factorize(np.concatenate([words, pairs]))
    order = np.argsort(terms)
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    keys, tf = np.unique(own[np.concatenate([row, row[first]])] * max(len(terms), 1) + place[at], return_counts=True)
    doc, at = np.divmod(keys, max(len(terms), 1))
    return own, terms[order], doc, at, tf


def _by_bucket(block: int, terms: np.ndarray, buckets: int, **values: np.ndarray) -> pd.DataFrame:
    """A row a bucket, with what belongs to its terms, as bytes. Buckets are ranges of hashes."""
    bucket = ((terms >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(terms) else np.zeros(1, int)
    cut = lambda x: [x[b:e].tobytes() for b, e in zip(edge[:-1], edge[1:])]
    return pd.DataFrame({"block": block, "bucket": bucket[edge[:-1]], "terms": cut(terms), **{name: cut(x) for name, x in values.items()}})


def _whole(parts: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _back(rows: pd.DataFrame, **values: np.ndarray) -> pd.DataFrame:
    """Values of the terms of a bucket's rows, in the order of the rows, for the blocks that they came from."""
    ends = np.cumsum(rows["terms"].map(len).to_numpy() // 8)
    cut = lambda x: [x[b:e].tobytes() for b, e in zip(np.r_[0, ends[:-1]], ends)]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], **{name: cut(x) for name, x in values.items()}})


def _unit(doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights of each text's terms at unit length."""
    length = np.sqrt(np.bincount(doc, weight * weight))[doc]
    return np.divide(weight, length, out=np.zeros(len(weight)), where=length > 0)


def fit_phishing(train: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label", least_docs: int = 1) -> PhishingModel:
    """Words and word pairs weighted by smoothed inverse document frequency, of unit length, for a multinomial naive Bayes with add-one smoothing.

    The vocabulary is a table that grows with the texts: every term that least_docs texts have is in it. A block of texts
    sends each of its terms once to the term's bucket and gets the number of texts back, then sends its sums.
    """
    n, positive, chars = train.agg(F.count("*"), F.count_if(F.col(label) == 1), F.sum(F.length(text))).first()
    buckets = _parts(chars, BUCKET_CHARS)
    words = words_of(train, id_col, text, chars, F.col(label).cast("double").alias("y"))

    def of_block(docs: pd.DataFrame) -> pd.DataFrame:
        _, terms, _, at, _ = _terms_of(docs)
        return _by_bucket(docs["block"].iloc[0], terms, buckets, n=np.bincount(at, minlength=len(terms)))

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        at, terms = pd.factorize(_whole(rows["terms"], np.uint64))
        return _back(rows, n=np.bincount(at, _whole(rows["n"], np.int64), len(terms)).astype(np.int64)[at])

    def summed(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        own, terms, doc, at, tf = _terms_of(docs)
        n_docs = _whole(counts.sort_values("bucket")["n"], np.int64)
        x = _unit(doc, tf * np.where(n_docs >= least_docs, np.log((1.0 + n) / (n_docs + 1)) + 1, 0.0)[at])
        y = docs["y"].to_numpy(float)
        sums = {f"s{c}": np.bincount(at, x * np.bincount(own, rows)[doc], len(terms)) for c, rows in ((0, (y != 1) & ~np.isnan(y)), (1, y == 1))}
        return _by_bucket(docs["block"].iloc[0] if len(docs) else 0, terms, buckets, n=n_docs, **sums)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        at, terms = pd.factorize(_whole(rows["terms"], np.uint64))
        n_docs = np.empty(len(terms), np.int64)
        n_docs[at] = _whole(rows["n"], np.int64)
        found = pd.DataFrame({"term": terms.view(np.int64), "n_docs": n_docs, **{s: np.bincount(at, _whole(rows[s], float), len(terms)) for s in ("s0", "s1")}})
        return found[n_docs >= least_docs]

    own = _apart(words.groupBy("block").applyInPandas(of_block, f"{_BLOCK}, terms binary, n binary"), "bucket", buckets)
    numbers = own.groupBy("bucket").applyInPandas(counted, f"{_BLOCK}, n binary")
    parts = words.groupBy("block").cogroup(numbers.groupBy("block")).applyInPandas(summed, f"{_BLOCK}, terms binary, n binary, s0 binary, s1 binary")
    sums = computed_once(_apart(parts, "bucket", buckets).groupBy("bucket").applyInPandas(table, "term long, n_docs long, s0 double, s1 double"))
    total = sums.agg(F.sum("s0").alias("all0"), F.sum("s1").alias("all1"), F.count("*").alias("size"))
    share = lambda c: F.log((F.col(f"s{c}") + 1) / (F.col(f"all{c}") + F.col("size"))).alias(f"p{c}")
    idf = (F.log(F.lit(1.0 + n) / (F.col("n_docs") + 1)) + 1).alias("idf")
    log = lambda k: math.log(k / n) if k else -math.inf
    return PhishingModel(sums.crossJoin(F.broadcast(total)).select("term", "n_docs", idf, share(0), share(1)), log(n - positive), log(positive))


def score_phishing(df: DataFrame, model: PhishingModel, id_col: str = "doc_id", text: str = "text", least: int = 10, suspicious: float = 60.0) -> DataFrame:
    """df with phishing_percent and is_suspicious (at least 60); texts under 10 characters aren't scored. id_col tells rows apart; terms that the model hasn't seen count nothing."""
    chars = df.agg(F.sum(F.length(text))).first()[0]
    buckets = _parts(chars, BUCKET_CHARS)
    words = words_of(df, id_col, text, chars)

    def of_block(docs: pd.DataFrame) -> pd.DataFrame:
        return _by_bucket(docs["block"].iloc[0], _terms_of(docs)[1], buckets)

    def looked_up(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        terms = _whole(rows["terms"], np.uint64)
        at = pd.Index(known["term"].to_numpy(np.int64)).get_indexer(terms.view(np.int64))
        return _back(rows, **{c: np.where(at >= 0, np.r_[known[c].to_numpy(float), 0.0][at], 0.0) for c in ("idf", "odds")})

    def scored(docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        own, _, doc, at, tf = _terms_of(docs)
        idf, odds = (_whole(values.sort_values("bucket")[c], float) for c in ("idf", "odds"))
        found = np.bincount(doc, _unit(doc, tf * idf[at]) * odds[at], own.max(initial=-1) + 1)
        return pd.DataFrame({"_id": docs["id"], "_odds": found[own]}).drop_duplicates("_id")

    known = model.terms.select(F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(term, 32) * {buckets}, 32) as int)").alias("bucket"), "term", "idf", (F.col("p0") - F.col("p1")).alias("odds"))
    own = _apart(words.groupBy("block").applyInPandas(of_block, f"{_BLOCK}, terms binary"), "bucket", buckets)
    values = own.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(looked_up, f"{_BLOCK}, idf binary, odds binary")
    odds = words.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(scored, f"_id {df.schema[id_col].dataType.simpleString()}, _odds double")
    joined = df.join(odds, F.col(id_col) == F.col("_id"), "left")
    prior = model.prior0 - model.prior1 if model.prior1 > -math.inf else math.inf
    percent = F.when(F.length(text) >= least, F.round(100 / (1 + F.exp(F.coalesce("_odds", F.lit(0.0)) + F.lit(float(prior)))), 2))
    return joined.withColumn("phishing_percent", percent).withColumn("is_suspicious", F.coalesce(F.col("phishing_percent") >= suspicious, F.lit(False))).drop("_id", "_odds")


def apply_hard_rules(df: DataFrame, verdict: str, unknown: Column, root_target: Column, off_hours: Column) -> DataFrame:
    """df with final_verdict: -1 for an unknown user or for root in off hours, else the model's verdict."""
    return df.withColumn("final_verdict", F.when(unknown | (root_target & off_hours), -1).otherwise(F.col(verdict)))


def warm_up_anomaly(events: DataFrame, features: list[str], time: str = "us", order: str = "event_id", warm_up: int = 500, percent: float = 5.0, n_trees: int = 50) -> DataFrame:
    """events with score and is_anomaly: the first `warm_up` events in time train a forest and are normal, later ones are scored by it."""
    first = events.orderBy(time, order).limit(warm_up)
    last = first.agg(F.max(F.struct(time, order)).alias("_last"))
    model = forest.fit(first, features, n_trees=n_trees)
    limit = forest.tail_threshold(first.withColumn("score", forest.score_column(model)), percent=percent)
    later = F.struct(time, order) > F.col("_last")
    scored = events.withColumn("score", forest.score_column(model)).crossJoin(F.broadcast(last)).crossJoin(F.broadcast(limit))
    return scored.withColumn("is_anomaly", later & (F.col("score") < F.col("threshold"))).drop("_last", "threshold")


