"""Mixing of sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import WORD

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows a range of the hash key holds on average; ranges are cut from the row count, so that they never grow.
RANGE_ROWS = 2048
#: Hex digits of the hash key that number its range.
RANGE_DIGITS = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. Targets share `share` of all words by
    weight; none exceeds `most` times its source's size, the excess is shared again by weight until none
    does. That is reached at once: by rising size / weight, the first sources are capped, up to the first
    whose share of what is left fits below its cap. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("bigint")
    placed = sizes.withColumn("_w", weight).withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_all") * F.lit(share) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    weight_left = F.sum("_w").over(Window.partitionBy()) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    placed = placed.withColumn("_level", left / weight_left)
    fits = F.col("_level") * F.col("_w") <= F.col("source_size") * most
    placed = placed.withColumn("_fits", fits)
    level = F.min(F.when(F.col("_fits"), F.struct(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"), "_level"))).over(Window.partitionBy())
    placed = placed.withColumn("_level", level["_level"])
    target = F.least(F.coalesce(F.col("_level") * F.col("_w"), F.lit(float("inf"))), (F.col("source_size") * most).cast("double"))
    return placed.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", columns: list[str] | None = None) -> DataFrame:
    """The rows of docs (or the named columns of them) with size, source_size, target, epochs and taken.

    Every row has a random key, the MD5 of seed and id, and each source is in the order of its keys (ties:
    id, then size). A source whose target is q whole passes and a rest takes each row q times, and the
    first rows of that order once more until the rest is reached; the row in which it falls is taken if
    half of it or more lies before the cut. Sums up to each row are those of the key ranges before its
    range plus those within the range: a source with most rows has as many ranges as it needs, and no
    task holds a source. Null texts have size 0; null ids count as the text "null"; null sources are one
    source; rows repeat as given. Columns of docs with the names of the new ones are replaced; other names
    don't matter.
    """
    own = [c for c in columns or docs.columns if c not in ("size", "source_size", "target", "epochs", "taken")]
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"), key.alias("key"))
    count = docs.select(F.count("*").alias("rows"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / RANGE_ROWS))
    at = F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("bigint")
    rows = rows.crossJoin(F.broadcast(count)).withColumn("range", F.floor(at * ranges / F.lit(16**RANGE_DIGITS))).drop("rows")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    offsets = offsets.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("range").alias("nth"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("size").over(within)).join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("nth")))
    whole = F.least(F.floor(F.try_divide("target", "source_size")), F.lit(MOST_EPOCHS))
    rest = F.col("target") - F.col("source_size") * whole
    more = (F.col("offset") + F.col("sum") - F.col("size") / 2 <= rest) & (rest > 0) & (whole < MOST_EPOCHS)
    epochs = F.coalesce(whole + more.cast("bigint"), F.lit(0)).cast("bigint")
    return rows.select(*(F.col(f"row.`{c}`") for c in own), "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))
