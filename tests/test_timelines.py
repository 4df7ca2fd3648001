"""Time lines in segments give the rows of the windows over whole keys, and a hot key is many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import joins, rolling, sessions, timelines

SCHEMA = "event_id long, key string, us long, user string, ip string, state string, what string, flagged boolean"


def make(spark, seed):
    """A key with most rows, some others, null keys; bursts of one time; gaps; values that are null or stay the same for long."""
    rng = random.Random(seed)
    rows, us = [], 0
    for i in range(1200):
        us += rng.choice([0, 0, 1_000_000, 20_000_000, 61_000_000, 700_000_000])
        key = rng.choice(["hot", "hot", "hot", "hot", "k1", "k2", None])
        rows.append((i, key, us, rng.choice(["ann", "bob", None, f"u{i // 40}"]), rng.choice([None, None, f"10.0.0.{i % 7}"]), rng.choice("abc"), rng.choice(["x"] * 12 + ["y", None]), rng.random() < 0.03))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in (df.select(columns) if columns else df).collect()), key=str)


@pytest.mark.parametrize(("seed", "least"), [(1, 100), (2, 10), (3, 10_000)])
def test_segments_as_whole_keys(spark, seed, least):
    df = make(spark, seed).cache()
    cuts = timelines.timeline_cuts(df, "key", "us", least_rows=least).cache()
    assert {r["cut_key"] for r in cuts.collect()} == ({"hot"} if least == 100 else {"hot", "k1", "k2", None} if least == 10 else set()) | ({"k1", "k2", None} if least == 100 else set())
    runs = lambda **o: sessions.compress_runs(df, "key", F.col("what"), F.col("flagged"), longest=2, **o)
    numbered = sessions.gap_sessions(df, "key", "us", "event_id", 60).cache()
    for name, make_rows in {
        "sessions": lambda **o: sessions.gap_sessions(df, "key", "us", "event_id", 60, **o),
        "velocity": lambda **o: rolling.rolling_velocity(df, "key", seconds=60, **o),
        "users": lambda **o: rolling.cumulative_distinct_users(df, "key", **o),
        "transitions": lambda **o: sessions.transitions(numbered, ["key", "session_seq"], **o),
        "runs": runs,
        "fill": lambda **o: joins.fill_logout_ip(df, "key", columns=("ip", "user"), **o),
        "errors": lambda **o: joins.attribute_errors(df, "key", "ip", seconds=30, **o),
    }.items():
        plain, cut = make_rows(), make_rows(cuts=cuts)
        assert sorted(plain.columns) == sorted(cut.columns), name
        assert rows_of(cut, plain.columns) == rows_of(plain), name
    assert runs().filter("is_run").count() > 5


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"), (F.col("id") * 1_000_000).alias("us"))
    cuts = timelines.timeline_cuts(df, "key", "us", least_rows=1000)
    sizes = timelines.in_segments(df, "key", "us", cuts).groupBy("key", timelines.SEGMENT).count().toPandas()
    hot = sizes[sizes["key"] == "hot"]
    assert len(hot) == timelines.SEGMENTS and hot["count"].max() < 3 * 6667 / timelines.SEGMENTS


def test_empty_time_lines(spark):
    none = spark.createDataFrame([], SCHEMA)
    cuts = timelines.timeline_cuts(none, "key", "us")
    assert cuts.count() == 0 and sessions.gap_sessions(none, "key", "us", "event_id", 60, cuts=cuts).count() == 0
    assert rolling.rolling_velocity(none, "key", cuts=cuts).count() == 0


@pytest.mark.parametrize("kind", ["different", "ties", "two values", "one value", "skewed"])
def test_exact_percentile_sorts_little(spark, kind):
    """numpy's percentiles, also where far fewer values are put in order than there are."""
    import numpy as np

    from vigilog.operators.aggregates import exact_percentile

    rng = np.random.default_rng(1)
    x = {"different": rng.normal(size=20_000), "ties": np.r_[np.full(12_000, 3.5), rng.random(8_000) * 7], "two values": np.repeat([1.0, 2.0], [9_000, 11_000]), "one value": np.full(5_000, 4.0), "skewed": rng.lognormal(0, 4, 20_000)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 9, "x double").repartition(4).cache()
    for share in (0.0, 0.02, 0.45, 0.5, 0.95, 1.0):
        for most in (50, 100_000):
            assert exact_percentile(df, "x", share, "p", most).first()["p"] == pytest.approx(np.percentile(x, share * 100), rel=1e-12), (share, most)
    assert exact_percentile(df.limit(0), "x", 0.5, "p").first()["p"] is None
