"""Exact deduplication by progressive refinement: length, then a prefix's hash, then the whole text's hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters whose hash refines the groups of equal length.
PREFIX_CHARS = 64
#: Bits of the map of shared lengths: exact up to 1 MB, longer texts share bits.
LENGTH_BITS = 1 << 20
#: Bits for each row in the map of shared (length, prefix) keys, and its bounds: 8 KB to 32 MB.
BITS_A_ROW = 8
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: A group with this part of all rows is hot: at most so many groups are.
HOT_GROUPS = 1000


def _place(slot: Column) -> tuple[Column, Column]:
    return F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)


def _bit_map(keys: DataFrame, slot: Column, name: str) -> DataFrame:
    """One row with the bits of all slots, as a map of Spark's bitmaps; its size is bounded by the number of slots."""
    bucket, bit = _place(slot)
    maps = keys.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    return maps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias(name))


def _has(name: str, slot: Column) -> Column:
    bucket, bit = _place(slot)
    byte = F.conv(F.hex(F.substring(F.col(name)[bucket], (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _hashed(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (with text) and length, prefix and sha, each null where the one before it tells that no other row has the text.

    First only lengths are counted; of rows that share their length the prefix is hashed and counted; only rows
    that share both have the whole text hashed. What is shared goes to the scan as bit maps, so no text is moved.
    They grow with the rows up to a bound: a key that falls on another's bit is hashed for nothing and changes
    no result.
    """
    sized = rows.withColumn("length", F.octet_length("text"))
    of_length = F.pmod(F.col("length"), F.lit(LENGTH_BITS)).cast("bigint")
    lengths = _bit_map(sized.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1"), of_length, "lengths")
    prefix = F.when(_has("lengths", of_length), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)))
    begun = sized.crossJoin(F.broadcast(lengths)).select(*sized.columns, prefix.alias("prefix"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * n_rows).bit_length()))
    of_key = F.pmod(F.xxhash64("length", "prefix"), F.lit(bits))
    shared = begun.filter("prefix is not null").groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = begun.crossJoin(F.broadcast(_bit_map(shared, of_key, "keys")))
    sha = F.col("text_sha") if "text_sha" in rows.columns else F.sha2("text", 256)
    return keyed.select(*begun.columns, F.when(F.col("prefix").isNotNull() & _has("keys", of_key), sha).alias("sha"))


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, sha_col: str | None = None) -> DataFrame:
    """The rows of docs (or the named columns of them) with keep_id, group_size and kept.

    Equal texts are identical after no change; null counts as empty. Of equal texts the row with the
    largest id stays (null ids are smaller than any; if all ids of a group are null, keep_id is null and
    kept is true). Rows that repeat id and text are all marked alike: drop_exact_duplicates() leaves one.
    Columns of docs named keep_id, group_size or kept are replaced; other names don't matter. sha_col names
    a column with the texts' SHA-256, for those who have it. Empty tables give empty results.

    The groups are counted with map-side combining. The join back to rows shuffles by group only rows of
    small groups: groups of at least 1 / HOT_GROUPS of all rows, of which there can't be more than
    HOT_GROUPS, are broadcast, and their rows spread over all tasks.
    """
    own = [c for c in columns or docs.columns if c not in ("keep_id", "group_size", "kept")]
    given = [F.col(f"`{sha_col}`").alias("text_sha")] if sha_col else []
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *given)
    hashed = _hashed(rows, docs.count()).select("row", "id", "length", "prefix", "sha")
    groups = hashed.filter("sha is not null").groupBy("length", "prefix", "sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = groups.crossJoin(F.broadcast(docs.agg(F.count("*").alias("rows"))))
    is_hot = F.col("group_size") * HOT_GROUPS >= F.col("rows")
    hot = groups.filter(is_hot).select("length", "sha", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cool = groups.filter(~is_hot).select("length", "prefix", "sha", "keep_id", "group_size")
    marked = hashed.join(F.broadcast(hot), ["length", "sha"], "left")
    spread = F.when(F.col("hot_size").isNotNull() | F.col("sha").isNull(), F.xxhash64("id").cast("string")).otherwise(F.col("sha"))
    marked = marked.withColumn("sha", spread).withColumn("prefix", F.coalesce("prefix", F.xxhash64("id"))).join(cool, ["length", "prefix", "sha"], "left")
    size = F.coalesce("hot_size", "group_size")
    keep_id = F.when(size.isNull(), F.col("id")).otherwise(F.coalesce("hot_id", "keep_id"))
    return marked.select(
        *(F.col(f"row.`{c}`") for c in own), keep_id.alias("keep_id"),
        F.coalesce(size, F.lit(1).cast("bigint")).alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each different text, that with the largest id; columns stay as they are, whatever their names.

    Of rows that share the largest id and the text, the one with the smallest hash of all its columns stays.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    packed = docs.select(whole.alias("own"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = mark_exact_duplicates(packed, "id", "text", columns=["own", "id"]).filter("kept")
    alone = kept.filter("group_size = 1").select("own")
    text = F.coalesce(F.col(f"own.`{text_col}`"), F.lit(""))
    rest = kept.filter("group_size > 1").groupBy("id", F.sha2(text, 256).alias("sha")).agg(F.min_by("own", F.xxhash64(F.to_json("own"))).alias("own"))
    return alone.union(rest.select("own")).select("own.*")
