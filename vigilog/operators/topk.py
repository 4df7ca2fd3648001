"""Orders, limits, unions and set operations on events and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_window_filter(df: DataFrame, begin: str, end: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Rows that overlap [since, until]; plain comparisons, which reach the scan."""
    if since is not None:
        df = df.filter(F.col(end) >= since)
    if until is not None:
        df = df.filter(F.col(begin) <= until)
    return df


def order_timeline(df: DataFrame, time: str, *ties: str) -> DataFrame:
    """Rows with a time, in chronological order."""
    return df.filter(F.col(time).isNotNull()).orderBy(time, *ties)


def top_per_group(df: DataFrame, group: str, order: Column, k: int, *ties: str, rank: str = "rank") -> DataFrame:
    """The k first rows of each group in this order, with their rank. Spark keeps only k rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(order, *ties)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_n(df: DataFrame, by: str, n: int | None = 10) -> DataFrame:
    """Values by number of rows, most frequent first, ties by value."""
    counted = df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
    return counted if n is None else counted.limit(n)


def rank_sessions(df: DataFrame, score: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties)


def top_deviations(windows: DataFrame, user: str, time: str, features: list[str], k: int = 5) -> DataFrame:
    """Of each user's latest window the k features furthest from the user's mean, in sample deviations (0 counts as 1)."""
    latest = windows.withColumn("_i", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(time)))).filter("_i = 1")
    long = windows.unpivot([user], features, "feature", "value").withColumn("value", F.col("value").cast("double"))
    stats = long.groupBy(user, "feature").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    now = latest.unpivot([user], features, "feature", "value").withColumn("value", F.col("value").cast("double"))
    z = F.abs(F.col("value") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return top_per_group(now.join(stats, [user, "feature"]).withColumn("deviation", F.round(z, 6)), user, F.desc("deviation"), k, "feature").select(user, "feature", "value", "deviation", "rank")


def limit_rows(df: DataFrame, source: str, n: int, order: str) -> DataFrame:
    """The n first rows of each source, by hash of the order column and then itself: the same rows however they are stored."""
    return top_per_group(df, source, F.md5(F.col(order).cast("string")), n, order).drop("rank")


def balanced_sample(df: DataFrame, is_attack: str, order: str) -> DataFrame:
    """All attacks and as many other rows, first by hash of the order column: their ranks are compared with one count, not gathered."""
    attacks = df.filter(F.col(is_attack))
    n = attacks.agg(F.count("*").alias("_n"))
    key = F.md5(F.col(order).cast("string"))
    # ranks within 4,096 ranges of the hash, and the rows before each range, so that no task ranks all rows
    rest = df.filter(~F.col(is_attack)).withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    before = rest.groupBy("_range").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).drop("_c")
    ranked = rest.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy("_key", order)))
    chosen = ranked.join(F.broadcast(before), "_range").crossJoin(F.broadcast(n)).filter(F.col("_before") + F.col("_i") <= F.col("_n"))
    return attacks.unionByName(chosen.select(df.columns))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows under all columns; a column that a source hasn't is null there."""
    found = frames[0]
    for df in frames[1:]:
        found = found.unionByName(df, allowMissingColumns=True)
    return found


def both_and_only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, found_by): the different keys of two hit sets that both have, or a or b alone."""
    both = a.select(key).intersect(b.select(key)).withColumn("found_by", F.lit("both"))
    only_a = a.select(key).distinct().exceptAll(b.select(key).distinct()).withColumn("found_by", F.lit("a only"))
    only_b = b.select(key).distinct().exceptAll(a.select(key).distinct()).withColumn("found_by", F.lit("b only"))
    return both.union(only_a).union(only_b)
