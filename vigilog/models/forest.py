"""Isolation forest (Liu, Ting and Zhou, 2008): trees grown in tasks from a bounded sample, scored in vectorised functions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.operators.aggregates import exact_percentile

#: Rows from which all trees draw their samples; a forest uses 256 a tree, whatever the table's size is.
MOST_ROWS = 16_384
SAMPLE = 256
_NODES = "tree int, node int, feature int, threshold double, left int, right int, size long"


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int, usable: np.ndarray) -> list[tuple]:
    """Nodes of one tree: node, feature (-1 a leaf), threshold, left, right, rows."""
    nodes: list[tuple] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(())
        part = x[rows]
        lo, hi = part.min(0), part.max(0)
        splits = usable[hi[usable] > lo[usable]] if len(rows) > 1 and level < depth else usable[:0]
        if not len(splits):
            nodes[me] = (me, -1, 0.0, -1, -1, len(rows))
            return me
        f = int(rng.choice(splits))
        cut = rng.uniform(lo[f], hi[f])
        below = part[:, f] < cut
        if not below.any() or below.all():  # neighbouring numbers have none between them
            nodes[me] = (me, -1, 0.0, -1, -1, len(rows))
            return me
        nodes[me] = (me, f, cut, add(rows[below], level + 1), add(rows[~below], level + 1), len(rows))
        return me

    add(np.arange(len(x)), 0)
    return nodes


@dataclass
class Forest:
    """Flat nodes of all trees, a few megabytes at any size of the input."""

    features: list[str]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    sample: int

    def _lengths(self, x: np.ndarray) -> np.ndarray:
        """Path lengths of rows over all trees: rows go down all trees at once, a level a step."""
        row = np.tile(np.arange(len(x)), len(self.roots))
        at = np.repeat(self.roots, len(x))
        total = np.zeros(len(x))
        leaf = np.where(self.feature < 0, _average_path(self.size), 0.0)
        depth = 0
        while len(row):
            inner = self.feature[at] >= 0
            ended = ~inner
            total += np.bincount(row[ended], depth + leaf[at[ended]], len(x))
            row, at = row[inner], at[inner]
            at = np.where(x[row, self.feature[at]] < self.threshold[at], self.left[at], self.right[at])
            depth += 1
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of each row: -1 is the oddest, about -0.5 an average row."""
        total = np.concatenate([np.zeros(0), *(self._lengths(x[k : k + 2048]) for k in range(0, len(x), 2048))])
        return -(2.0 ** (-total / len(self.roots) / max(float(_average_path(self.sample)), 1e-9)))


def draw_rows(df: DataFrame, features: list[str], most: int, id_cols: tuple[str, ...] = (), seed: int = 0) -> np.ndarray:
    """The values of `most` rows at random, in the order of a hash of their ids: equal rows are drawn as often as they are there.

    Without ids a random number of the seed takes the hash's place. Missing values count as 0.
    """
    key = F.xxhash64(*id_cols, F.lit(seed)) if id_cols else F.rand(seed)
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)]
    drawn = df.select(key.alias("_key"), *values).orderBy("_key", *(f"_{i}" for i in range(len(features)))).limit(most).collect()
    return np.array([tuple(r)[1:] for r in drawn], float).reshape(len(drawn), len(features))


def fit_table(df: DataFrame, features: list[str], n_trees: int = 100, sample: int = SAMPLE, feature_fraction: float = 1.0, seed: int = 0, id_cols: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of a forest as a table. Trees draw from MOST_ROWS rows by draw_rows."""
    spark = df.sparkSession
    x = draw_rows(df, features, MOST_ROWS, id_cols, seed)
    k = max(1, round(feature_fraction * len(features)))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tree in pdf["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                chosen = x[rng.choice(len(x), min(sample, len(x)), replace=False)] if len(x) else np.zeros((1, len(features)))
                usable = rng.choice(len(features), k, replace=False)
                rows += [(int(tree), *n) for n in grow(chosen, rng, int(np.ceil(np.log2(max(len(chosen), 2)))), usable)]
            yield pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    return spark.range(n_trees).mapInPandas(build, _NODES)


def from_table(nodes: DataFrame, features: list[str], sample: int = SAMPLE) -> Forest:
    """A forest from its node table, which has at most twice the sample's rows a tree."""
    pdf = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    roots = np.flatnonzero(pdf["node"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.r_[roots, len(pdf)]))
    child = lambda c: np.where(pdf[c] >= 0, pdf[c] + base, -1)
    sizes = pdf["size"].to_numpy()
    return Forest(features, roots, pdf["feature"].to_numpy(), pdf["threshold"].to_numpy(), child("left"), child("right"), sizes, int(min(sample, sizes[roots].max(initial=1))))


def fit(df: DataFrame, features: list[str], **options) -> Forest:
    return from_table(fit_table(df, features, **options), features, options.get("sample", SAMPLE))


def score_column(forest: Forest) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.fillna(0).to_numpy(float) for c in columns])))

    return run(*(F.col(f).cast("double") for f in forest.features))


def tail_threshold(scores: DataFrame, score: str = "score", percent: float = 2.0) -> DataFrame:
    """One row: the score below which `percent` percent of the training rows lie."""
    return exact_percentile(scores, score, percent / 100, "threshold")


def flag_tail(scored: DataFrame, threshold: DataFrame, score: str = "score") -> DataFrame:
    """scored with y_pred: -1 below the threshold, else 1."""
    return scored.crossJoin(F.broadcast(threshold)).withColumn("y_pred", F.when(F.col(score) < F.col("threshold"), -1).otherwise(1)).drop("threshold")


def per_user_baseline(windows: DataFrame, user: str, time: str, features: list[str], least: int = 5, n_trees: int = 100, contamination: float = 0.05) -> DataFrame:
    """(user, time, raw_score, risk, is_anomaly): a forest of each user on standardised features, fitted on its training rows (role train or both).

    risk puts raw scores from the training range to 0..100, high for odd rows (50 if the range is empty).
    Users with fewer than `least` rows are skipped. A user's windows are one group, of a row a window.
    """
    schema = f"user string, {time} long, raw_score double, risk double, is_anomaly boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, ignore_index=True)
        x = pdf[features].to_numpy(float)
        train = pdf["role"].isin(["train", "both"]).to_numpy()
        if len(pdf) < least or not train.any():
            return pd.DataFrame({"user": pdf["user"], time: pdf[time], "raw_score": 0.0, "risk": 0.0, "is_anomaly": False}).iloc[:0]
        mean, sd = x[train].mean(0), x[train].std(0)
        z = (x - mean) / np.where(sd == 0, 1, sd)
        rng = np.random.default_rng(0)
        nodes, roots, rows = [], [], z[train]
        for _ in range(n_trees):
            chosen = rows[rng.choice(len(rows), min(SAMPLE, len(rows)), replace=False)]
            base = len(nodes)
            roots.append(base)
            nodes += [(f, t, a + base if a >= 0 else -1, b + base if b >= 0 else -1, n) for _, f, t, a, b, n in grow(chosen, rng, int(np.ceil(np.log2(max(len(chosen), 2)))), np.arange(z.shape[1]))]
        f, t, a, b, n = (np.array(c) for c in zip(*nodes))
        raw = Forest(features, np.array(roots), f, t, a, b, n, min(SAMPLE, len(rows))).score(z)
        lo, hi = raw[train].min(), raw[train].max()
        risk = np.full(len(raw), 50.0) if hi - lo < 1e-12 else np.clip((hi - raw) / (hi - lo) * 100, 0, 100)
        return pd.DataFrame({"user": pdf["user"], time: pdf[time], "raw_score": raw, "risk": risk, "is_anomaly": raw < np.quantile(raw[train], contamination)})

    return windows.select(F.col(user).alias("user"), time, "role", *features).groupBy("user").applyInPandas(run, schema)


def save(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, features: list[str]) -> Forest:
    return from_table(spark.read.parquet(path), features)
