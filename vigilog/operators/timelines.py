"""Time lines of hot keys in segments: what is scanned along a key's events is scanned a segment at a time, with what the segments before it carry in.

A key that has much of all rows would be one task of a window. Its time line is cut at quantiles of its times; each segment is a
task of its own, a table of a row a segment tells what comes in from the others, and every row is corrected by that. Other
keys are one segment each, without anything carried in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from vigilog.sources.storage import computed_once

#: Segments of a hot key, a power of two.
SEGMENTS = 64
#: A key with this part of all rows is hot: there are at most so many.
HOT_KEYS = 1000
#: Rows up to which no key is hot.
LEAST_ROWS = 100_000
#: Accuracy of the quantiles; the segments needn't be equal.
ACCURACY = 2_000

SEGMENT = "_segment"


def timeline_cuts(df: DataFrame, key: str, time: str, least_rows: int = LEAST_ROWS, segments: int = SEGMENTS) -> DataFrame:
    """(cut_key, bounds): for each hot key of df the times at which its time line is cut. At most HOT_KEYS rows.

    Rows are counted by key with map-side combining, and the quantiles of hot keys are mergeable sketches. A sketch depends on
    the order in which its parts arrive, and an operator uses the cuts several times: they are computed once, so that all its
    steps have the same segments.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).filter((F.col("_n") * HOT_KEYS >= F.col("_all")) & (F.col("_n") > least_rows)).select(F.col(key).alias("cut_key"))
    shares = [F.lit(i / segments) for i in range(1, segments)]
    own = df.select(F.col(key).alias("_k"), F.col(time).cast("bigint").alias("_t")).join(F.broadcast(hot), F.col("_k").eqNullSafe(F.col("cut_key")), "left_semi")
    return computed_once(own.groupBy(F.col("_k").alias("cut_key")).agg(F.percentile_approx("_t", F.array(*shares), F.lit(ACCURACY)).alias("bounds")))


def _segment(bounds: Column, time: Column, segments: int) -> Column:
    """The number of bounds below time, by halving; null times come first.

    A loop within one expression: filters on the segment are pushed down as copies of it, and halvings nested into each other would grow
    with the number of segments.
    """
    steps = [F.lit(segments >> i) for i in range(1, segments.bit_length())]
    return F.aggregate(F.array(*steps), F.lit(0), lambda found, step: found + F.when(time > F.get(bounds, found + step - 1), step).otherwise(0))


def in_segments(df: DataFrame, key: str, time: str, cuts: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """df with the segment of each row of a hot key, null for other keys."""
    marked = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("cut_key")), "left")
    return marked.withColumn(SEGMENT, F.when(F.col("bounds").isNotNull(), _segment(F.col("bounds"), F.col(time), segments))).drop("cut_key", "bounds")


def with_carry(rows: DataFrame, key: str, sums: dict[str, Column], carry: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """rows with the columns that carry() makes of the sums of each segment, over the segments of its key in order; null for keys that aren't hot.

    The table has at most HOT_KEYS * SEGMENTS rows and is broadcast.
    """
    of_segment = rows.filter(F.col(SEGMENT).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(SEGMENT).alias("_s")).agg(*(c.alias(n) for n, c in sums.items()))
    table = carry(of_segment, Window.partitionBy("_k").orderBy("_s")).drop(*sums)
    return rows.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_k")) & (F.col(SEGMENT) == F.col("_s")), "left").drop("_k", "_s")


def before(w: WindowSpec) -> WindowSpec:
    """The segments before a segment."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: WindowSpec) -> WindowSpec:
    """The segments after a segment."""
    return w.rowsBetween(1, Window.unboundedFollowing)


def upto(w: WindowSpec) -> WindowSpec:
    """What comes up to a row or segment, itself included."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(rows: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows (in segments) with the sum of value over their key's rows up to them, in the given order within each segment."""
    w = Window.partitionBy(key, SEGMENT).orderBy(*order)
    local = rows.withColumn("_value", value).withColumn(name, F.sum("_value").over(upto(w)))
    both = with_carry(local, key, {"_sum": F.sum("_value")}, lambda t, s: t.withColumn("_in", F.sum("_sum").over(before(s))))
    return both.withColumn(name, F.col(name) + F.coalesce("_in", F.lit(0))).drop("_in", "_value")


def last_known(rows: DataFrame, key: str, time: str, order: str, values: dict[str, Column]) -> DataFrame:
    """rows (in segments) with, for each name, the last value that isn't null of their key's rows up to them."""
    w = upto(Window.partitionBy(key, SEGMENT).orderBy(time, order))
    local = rows.withColumns({f"_own_{n}": c for n, c in values.items()}).withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()})
    sums = {f"_last_{n}": F.max(F.when(F.col(f"_own_{n}").isNotNull(), F.struct(F.col(time).isNotNull(), F.col(time), F.col(order), F.col(f"_own_{n}").alias("v"))))["v"] for n in values}
    both = with_carry(local, key, sums, lambda t, s: t.withColumns({f"_in_{n}": F.last(f"_last_{n}", ignorenulls=True).over(before(s)) for n in values}))
    return both.withColumns({n: F.coalesce(n, f"_in_{n}") for n in values}).drop(*(f"_in_{n}" for n in values), *(f"_own_{n}" for n in values))
