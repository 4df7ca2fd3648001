"""Models on rows that are known beforehand: orders, ranges and samples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vigilog.models import forest, one_class, supervised
from vigilog.operators.aggregates import exact_percentile
from vigilog.plans import registry

registry.load()


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.9, 1.0])
def test_exact_percentiles_as_numpy(spark, share):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=5000), rng.integers(0, 3, 5000), np.r_[np.zeros(14_000), rng.pareto(0.5, 6000)], [7.0], [1.0, 2.0]):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").repartition(3)
        assert exact_percentile(df, "x", share).first()[0] == pytest.approx(float(np.quantile(np.asarray(values, float), share)), rel=1e-12, abs=1e-12)
    assert exact_percentile(spark.createDataFrame([], "x double"), "x", share).first()[0] is None


def test_samples_draw_frequent_values_as_often_as_they_are(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).otherwise(1.0).alias("x"))
    for ids in (("id",), ()):
        drawn = forest.draw_rows(df, ["x"], 2000, ids)
        assert len(drawn) == 2000 and 0.97 < (drawn == 1.0).mean() < 1.0
    assert (forest.draw_rows(df.repartition(7), ["x"], 2000, ("id",)) == forest.draw_rows(df, ["x"], 2000, ("id",))).all()
    odd = df.select("id", "x").union(spark.createDataFrame([(-1, 1e9)], "id long, x double"))
    scored = odd.withColumn("score", forest.score_column(forest.fit(odd, ["x"], id_cols=("id",)))).cache()
    usual, oddest = scored.filter("x = 1").agg(F.avg("score")).first()[0], scored.filter("id = -1").first()["score"]
    assert oddest < usual - 0.1


def test_paths_of_all_trees_at_once_as_one_by_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    nodes, roots = [], []
    for _ in range(7):
        base = len(nodes)
        roots.append(base)
        nodes += [(f, t, a + base if a >= 0 else -1, b + base if b >= 0 else -1, n) for _, f, t, a, b, n in forest.grow(x[:64], rng, 6, np.arange(3))]
    f, t, a, b, n = (np.array(c) for c in zip(*nodes))
    model = forest.Forest(["a", "b", "c"], np.array(roots), f, t, a, b, n, 64)
    for row, got in zip(x, model.score(x)):
        total = 0.0
        for at in roots:
            depth = 0
            while f[at] >= 0:
                at, depth = (a[at] if row[f[at]] < t[at] else b[at]), depth + 1
            total += depth + float(forest._average_path(n[at]))
        assert got == pytest.approx(-(2.0 ** (-total / 7 / float(forest._average_path(64)))))


def test_one_class_scale_is_that_of_all_rows(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    model = one_class.fit(df, ["x"], id_cols=("id",))
    assert model.mean[0] == pytest.approx(4.5) and model.scale[0] == pytest.approx(np.std(np.arange(10)))
    inside, outside = model.score(np.array([[4.5], [500.0]]))
    assert inside > outside


def test_request_detector_tells_attacks_it_has_not_seen(spark):
    scored = registry.QUERIES["m7_two_stage_http_detector"](spark, SF).toPandas()
    assert len(scored) == spark.read.parquet(f"{SF}/pages.parquet").count() and scored["page_id"].is_unique
    attacks, normal = scored.loc[scored["label"] == 1, "score"], scored.loc[scored["label"] == 0, "score"]
    assert np.subtract.outer(attacks.to_numpy(), normal.to_numpy()).__gt__(0).mean() > 0.9


def test_importances_are_shares(spark):
    found = registry.QUERIES["m8_feature_importance"](spark, SF).toPandas()
    assert len(found) == 35 and found["importance"].sum() == pytest.approx(1.0) and (found["splits"] >= 0).all()


def test_phishing_words_raise_the_score(spark):
    rows = [(f"please verify your account password number {i} now", 1.0) for i in range(30)] + [(f"minutes of the garden meeting on day {i} are here", 0.0) for i in range(30)]
    model = supervised.fit_phishing(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, label double"))
    texts = [(1, "verify your password now"), (2, "the garden meeting minutes"), (3, "short"), (4, None)]
    bad, good, short, none = supervised.score_phishing(spark.createDataFrame(texts, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert bad["phishing_percent"] > 60 > 40 > good["phishing_percent"] and bad["is_suspicious"] and not good["is_suspicious"]
    assert short["phishing_percent"] is None and none["phishing_percent"] is None


def test_phishing_texts_meet_their_terms_by_block(spark, duck, monkeypatch):
    """Of many blocks and buckets the rows are those of SQL, and no row is made for each term of each text."""
    from tests.conftest import same

    monkeypatch.setattr(supervised, "BLOCK_CHARS", 60_000)
    monkeypatch.setattr(supervised, "BUCKET_CHARS", 90_000)
    found = registry.QUERIES["m9_phishing_text_score"](spark, SF)
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan
    same(found, duck.execute(registry.ORACLE["m9_phishing_text_score"]).df())


def test_phishing_texts_without_words_or_model(spark):
    """An id of several rows is one text; empty texts and an empty training set have the prior only, null labels are no texts of a class."""
    rows = [(2**60 + 1, "verify your password now", 1.0), (2**60 + 2, "the garden meeting minutes", 0.0), (3, None, None), (4, "verify the garden", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label double")
    texts = spark.createDataFrame([(2**60 + 1, "verify your"), (2**60 + 1, "password now"), (2**60 + 2, "garden minutes"), (5, "? ! ? ! ? !"), (None, "verify your password")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["phishing_percent"] for r in supervised.score_phishing(texts, supervised.fit_phishing(train)).collect()}
    assert len(got) == 5 and got[2**60 + 1, "verify your"] == got[2**60 + 1, "password now"] > got[5, "? ! ? ! ? !"] == got[None, "verify your password"] == 25.0 > got[2**60 + 2, "garden minutes"]
    empty = supervised.score_phishing(texts, supervised.fit_phishing(train.limit(0)))
    assert {r["phishing_percent"] for r in empty.collect()} == {0.0}


def test_nothing_is_odd_during_warm_up(spark):
    df = spark.range(700).select(F.col("id").alias("us"), F.col("id").alias("event_id"), F.when(F.col("id") == 650, 1000.0).otherwise((F.col("id") * 7919 % 101).cast("double")).alias("x"))
    found = {r["event_id"]: r["is_anomaly"] for r in supervised.warm_up_anomaly(df, ["x"]).collect()}
    assert not any(found[i] for i in range(500)) and found[650]


def test_user_baselines_are_ranges(spark):
    found = registry.QUERIES["m2_per_user_baseline"](spark, SF).toPandas()
    assert found["risk"].between(0, 100).all() and found.groupby("user").size().min() >= 5
    assert found.loc[found["is_anomaly"], "risk"].mean() > found.loc[~found["is_anomaly"], "risk"].mean()


def test_the_tail_is_read_from_scores_that_are_there(spark):
    """The percentile reads its rows in rounds; none of them, nor the flags, asks the forest again."""
    from tests.conftest import SF
    from vigilog.plans import model_queries

    assert "ArrowEvalPython" not in model_queries.m3_tail_threshold(spark, SF)._jdf.queryExecution().toString()
