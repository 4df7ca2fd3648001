"""One-class boundary by random Fourier features (Rahimi and Recht, 2007) and a linear objective; the ensemble with a forest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.models.forest import draw_rows

#: Rows of the training sample. The boundary approximates the kernel machine's by design.
MOST_ROWS = 8192


@dataclass
class OneClass:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Above 0 inside the boundary, below outside."""
        z = np.sqrt(2 / len(self.phases)) * np.cos((x - self.mean) / self.scale @ self.directions + self.phases)
        return z @ self.weights - self.offset


def fit(df: DataFrame, features: list[str], nu: float = 0.02, n_features: int = 256, steps: int = 300, seed: int = 0, id_cols: tuple[str, ...] = ()) -> OneClass:
    """Means and deviations are those of all rows; the boundary is fitted to MOST_ROWS rows by draw_rows.

    Minimises |w|^2 / 2 - r + mean(max(0, r - w z)) / nu over random features z of an RBF kernel with gamma 1 / (features x variance).
    """
    x = draw_rows(df, features, MOST_ROWS, id_cols, seed)
    if not len(x):
        x = np.zeros((1, len(features)))
    value = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    stats = df.agg(*(F.coalesce(f(v), F.lit(0.0)) for f in (F.avg, F.stddev_pop) for v in value)).first()
    mean, scale = np.array(stats[: len(features)]), np.array(stats[len(features) :])
    scale = np.where(scale == 0, 1, scale)
    rng = np.random.default_rng(seed)
    s = (x - mean) / scale
    gamma = 1 / (len(features) * max(s.var(), 1e-9))
    directions = rng.normal(0, np.sqrt(2 * gamma), (len(features), n_features))
    phases = rng.uniform(0, 2 * np.pi, n_features)
    z = np.sqrt(2 / n_features) * np.cos(s @ directions + phases)
    w, r = z.mean(0), 0.0
    for step in range(steps):
        margin = z @ w
        r = np.quantile(margin, nu)
        out = margin < r
        w -= (w - z[out].sum(0) / (nu * len(z))) * 0.5 / (1 + step / 20) if out.any() else w * 0.01
    return OneClass(features, mean, scale, directions, phases, w, float(np.quantile(z @ w, nu)))


def score_column(model: OneClass) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.fillna(0).to_numpy(float) for c in columns])))

    return run(*(F.col(f).cast("double") for f in model.features))


def ensemble_score(scored: DataFrame, train: DataFrame, columns: tuple[str, str] = ("forest", "one_class"), digits: int = 2) -> DataFrame:
    """scored with statistical_threat_score: the mean of both scores, each from its training range to 0..100 (low scores are odd), clipped."""
    ends = train.agg(*(f(c).alias(f"_{c}_{k}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    part = lambda c: F.least(F.greatest(F.coalesce(F.try_divide(F.col(f"_{c}_hi") - F.col(c), F.col(f"_{c}_hi") - F.col(f"_{c}_lo")), F.lit(0.0)) * 100, F.lit(0.0)), F.lit(100.0))
    return scored.crossJoin(F.broadcast(ends)).withColumn("statistical_threat_score", F.round((part(columns[0]) + part(columns[1])) / 2, digits)).select(*scored.columns, "statistical_threat_score")
