"""Plans that Spark makes of large tables only: their rows are those of small ones."""

from __future__ import annotations

import contextlib
import random

from pyspark.sql import functions as F

from vigilog.operators import rules, sessions, timelines


@contextlib.contextmanager
def as_for_large_tables(spark):
    """Joins are planned with shuffles, are broadcast once a side is seen to be small, and small parts stay apart."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "4000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def events(spark):
    """Those of each address are spread over all parts of the table."""
    address = F.concat(F.lit("10.0.0."), F.col("id") % 4).alias("ip")
    return spark.range(0, 1000, 1, 4).select(F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("us"), address, F.lit("auth failed").alias("action"), F.lit("ann").alias("user"))


def test_a_key_of_a_rule_is_one_scan(spark):
    """Every third failure of an address raises an alert."""
    with as_for_large_tables(spark):
        found = [r["event_id"] for r in rules.brute_force(events(spark), 3, 3600).collect()]
    assert sorted(found) == [i for i in range(1000) if i // 4 % 3 == 2]


def test_a_capped_session_is_one_scan(spark):
    with as_for_large_tables(spark):
        found = sessions.capped_sessions(events(spark), "ip", "us", "event_id", 900, 7200, 5).select("event_id", "split_seq").collect()
    assert sorted(map(tuple, found)) == [(i, i // 4 // 5) for i in range(1000)]


def test_all_steps_of_an_operator_have_the_same_cuts(spark):
    """Quantiles may differ between two evaluations, as those of sketches that arrive in another order do."""
    anew = F.udf(lambda i: random.randrange(1_000_000), "long").asNondeterministic()
    cuts = timelines.timeline_cuts(spark.range(2000).select(F.lit("hot").alias("key"), anew("id").alias("us")), "key", "us", 100)
    assert cuts.select("bounds").collect() == cuts.select("bounds").collect()


def test_runs_read_no_frame_anew_for_every_row(spark):
    df = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("hot").alias("key"), F.col("id").alias("us"), (F.col("id") % 7 < 5).cast("string").alias("what"), F.lit(False).alias("flagged"))
    runs = sessions.compress_runs(df, "key", F.col("what"), F.col("flagged"), longest=2, cuts=timelines.timeline_cuts(df, "key", "us", 100))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    # only the table of a row a segment looks at the segments after each
    assert all("_min" in line for line in plan.splitlines() if "RowFrame, 1, unboundedfollowing" in line)
    assert runs.filter("is_run").count() == 286
