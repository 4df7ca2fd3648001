"""Quality classifier by positive-unlabelled learning (non-negative risk; Kiryo and others, 2017)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Words, chunks, encoded, shingles

#: A text is predicted good if its score is this or more.
PREDICT_AT = 0.3
#: Bounds of the training sample, in rows: trusted positives and unlabelled texts, first by hash of the id.
MOST_POSITIVES = 4000
MOST_UNLABELLED = 8000
HELD_OUT_MOD = 5

# Classes of bytes: lower case, upper case, digits, spaces, line feeds, sentence marks, shouts, symbols, other ASCII, beyond ASCII.
_CLASSES = 10
_CLASS = np.full(256, 8, np.int32)
for _k, _set in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"#*$%&|<>@=+~^_{}[]\\/")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 9
_GRAMS = _CLASSES**3
_EXTRA = 7
SIZE = _GRAMS + _EXTRA


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of the runs of three byte classes in each whole text (square roots), and measures of length and repetition."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for part in chunks(texts):
        own = texts[part]
        words = Words(own)
        kinds = _CLASS[words.bytes]
        grams = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:] if len(kinds) > 2 else kinds[:0]
        for i, text in enumerate(own):
            row = out[part.start + i]
            at, n = words.text_at[i], len(text)
            if n > 2:
                row[:_GRAMS] = np.sqrt(np.bincount(grams[at : at + n - 2], minlength=_GRAMS) / (n - 2))
            own_words = words.hash[words.first[i] : words.first[i + 1]]
            m = len(own_words)
            lines = [x for x in text.split(b"\n") if x.strip()]
            row[_GRAMS:] = (
                np.log1p(n), np.log1p(m), n / max(m, 1) / 10, len(np.unique(own_words)) / max(m, 1),
                len(np.unique(shingles(own_words, 3))) / max(m - 2, 1), len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)),
            )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from scores that rank them (Blanchard and others, 2010).

    Negatives only add to a tail: above any score, the unlabelled share is at least prior times the positive
    share, and where a tail is all positives it is just that. So the smallest such ratio is taken, over tails
    with half of the positives or more, which chance moves little.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(np.quantile(p, np.linspace(0.0, 0.5, 51)))
    of_p, of_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    return float(np.clip((of_u / of_p).min(), 0.02, 0.98))


def _risk_steps(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    w, b = np.zeros(SIZE, np.float32), 0.0
    m, v = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    some = lambda x, n: (x[rng.choice(len(x), min(len(x), n), replace=False)] - mean) / scale
    for step in range(1, steps + 1):
        pi, ui = some(positive, 1024), some(unlabelled, 2048)
        zp, zu = pi @ w + b, ui @ w + b
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu_minus = -sigmoid(-zp) / len(pi), sigmoid(zp) / len(pi), sigmoid(zu) / len(ui)
        if minus >= 0:
            gp, gu = prior * (gp_plus - gp_minus), gu_minus
        else:
            gp, gu = prior * gp_minus, -gu_minus
        grad = np.concatenate([pi.T @ gp.astype(np.float32) + ui.T @ gu.astype(np.float32) + decay * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    return w, float(b)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.02, decay: float = 1e-3, seed: int = 0) -> Model:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) for a linear score under the logistic loss.

    Where the second part of a step's risk falls below 0, the step climbs back out of it instead, as in
    the paper. Without a prior, one is estimated from a first fit at an even prior. Samples may be of half
    precision: only a step's rows are widened. Without positives or unlabelled texts every score is the prior.
    """
    if min(len(positive), len(unlabelled)) < (1 if prior else 2):
        prior = prior or 0.5
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), float(np.log(prior / (1 - prior))), prior)
    n = len(positive) + len(unlabelled)
    mean = ((positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n).astype(np.float32)
    spread = sum(((x[i : i + 512] - mean) ** 2).sum(0, dtype=np.float64) for x in (positive, unlabelled) for i in range(0, len(x), 512))
    scale = np.maximum(np.sqrt(spread / n), 0.01).astype(np.float32)
    if prior is None:
        # fitted on half of either sample, so that the scores of the other halves are as those of new texts
        first = Model(mean, scale, *_risk_steps(positive[::2], unlabelled[::2], mean, scale, 0.5, steps // 3, rate, decay, seed), 0.5)
        prior = estimate_prior(*(np.concatenate([first.score(x[i : i + 512]) for i in range(0, len(x), 512)]) for x in (positive[1::2], unlabelled[1::2])))
    return Model(mean, scale, *_risk_steps(positive, unlabelled, mean, scale, prior, steps, rate, decay, seed), prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo HELD_OUT_MOD, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == 0


def _featured(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype(str), "x": [r.tobytes() for r in features(encoded(pdf["text"])).astype(np.float16)]})

    # at most MOST_POSITIVES or MOST_UNLABELLED rows, in the same order whatever the partitions are
    rows = docs.select("id", "text").mapInPandas(run, "id string, x binary").collect()
    rows.sort()
    out = np.empty((len(rows), SIZE), np.float16)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row["x"], np.float16)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from trusted positives (label 1, not held out) and unlabelled texts (not held out); the class prior is estimated from both.

    Labels of 0 play no part. Both samples are bounded by MOST_POSITIVES and MOST_UNLABELLED ids, first by a
    hash of the id; their texts come by a join with those ids. Labels that are null don't count; of differing
    labels of an id the smaller counts.
    """
    known = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    texts = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = lambda ids, most: F.broadcast(ids.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most))
    positive = texts.join(first(known.filter("label = 1"), MOST_POSITIVES), "id", "left_semi")
    unlabelled = texts.join(first(texts, MOST_UNLABELLED), "id", "left_semi")
    return fit(_featured(positive), _featured(unlabelled))


def scorer(model: Model) -> Callable[[str | Column], Column]:
    """A column function that gives the score (0 to 1) of a whole text; null and empty texts have that of their (empty) features."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.score(features(encoded(texts.iloc[i : i + 500]))) for i in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return lambda text: score(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= PREDICT_AT), whatever else its columns are.

    The whole text is scored. Columns named score or predicted are replaced; null ids and repeated rows
    change nothing. An empty table gives an empty result.
    """
    scored = docs.drop("score", "predicted").withColumn("score", scorer(model)(text_col))
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0))
