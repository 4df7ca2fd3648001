"""Sessions of events: by idle gaps, with caps, over all keys at once; their features, sequences and compressed timelines.

Times are microseconds (bigint). Ties are broken by an order column, so every result is the same however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from vigilog.functions import web
from vigilog.operators import timelines
from vigilog.operators.aggregates import exact_percentile

SECOND = 1_000_000


def gap_sessions(df: DataFrame, key: str, time: str, order: str, gap_seconds: float, name: str = "session_seq", cuts: DataFrame | None = None) -> DataFrame:
    """df with the number (from 0) of each row's session within its key: a new one begins after more than gap_seconds without an event.

    With cuts (of timeline_cuts()) the time lines of hot keys are numbered a segment at a time.
    """
    gap = int(gap_seconds * SECOND)
    if cuts is not None:
        rows = timelines.in_segments(df, key, time, cuts)
        w = Window.partitionBy(key, timelines.SEGMENT).orderBy(time, order)
        rows = rows.withColumn("_starts", F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))).withColumn(name, F.sum("_starts").over(timelines.upto(w)))

        def carry(segments: DataFrame, s: WindowSpec) -> DataFrame:
            # a segment may begin a session too, and what has begun before it counts
            begins = F.coalesce((F.col("_lo") - F.max("_hi").over(timelines.before(s)) > gap).cast("int"), F.lit(0))
            return segments.withColumn("_begins", begins).withColumn("_in", F.coalesce(F.sum("_n").over(timelines.before(s)), F.lit(0)) + F.sum("_begins").over(timelines.upto(s))).drop("_begins")

        rows = timelines.with_carry(rows, key, {"_lo": F.min(time), "_hi": F.max(time), "_n": F.sum("_starts")}, carry)
        # the times that are null come before the first event, in the first segment
        return rows.withColumn(name, F.col(name) + F.coalesce("_in", F.lit(0))).drop("_in", "_starts", timelines.SEGMENT)
    w = Window.partitionBy(key).orderBy(time, order)
    starts = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    return df.withColumn("_starts", F.coalesce(starts, F.lit(0))).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def capped_sessions(df: DataFrame, key: str, time: str, order: str, gap_seconds: float = 900, max_seconds: float = 7200, max_events: int = 3000) -> DataFrame:
    """gap_sessions() that also begin anew once older than max_seconds or max_events long; adds session_seq, split_seq and parent_tracking_id.

    The parent id is the key and start of the idle session, which all its splits share. Each restart depends
    on the one before, so sessions that break a cap (and only those) are scanned in order, from batch to batch:
    the scan holds where the current split began and how many events it has, not a session's rows. All others
    keep split 0.
    """
    sessions = gap_sessions(df, key, time, order, gap_seconds)
    span = sessions.groupBy(key, "session_seq").agg(F.min(time).alias("_begin"), F.max(time).alias("_end"), F.count("*").alias("_n"))
    # a session without a key has one too
    joined = sessions.withColumnRenamed(key, "_k").withColumnRenamed("session_seq", "_s").join(span, F.col("_k").eqNullSafe(F.col(key)) & (F.col("_s") == F.col("session_seq"))).drop("_k", "_s")
    over = (F.col("_end") - F.col("_begin") > int(max_seconds * SECOND)) | (F.col("_n") > max_events)
    most = int(max_seconds * SECOND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin, count, part = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, number = batch.column(key), batch.column("session_seq").to_numpy()
            k, t = keys.dictionary_encode("encode").indices.to_numpy(), batch.column(time).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (number[1:] != number[:-1]), True])
            out = np.zeros(len(t), np.int32)
            for i, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if last != (session := (keys[i].as_py(), number[i])):
                    last, begin, count, part = session, t[i], 0, 0
                while i < e:
                    end = min(i + int(np.searchsorted(t[i:e], begin + most, side="right")), i + max_events - count)
                    end = max(end, i if count else i + 1)
                    out[i:end] = part
                    i, count = end, count + end - i
                    if i < e:
                        begin, count, part = t[i], 0, part + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "split_seq"])

    columns = [*sessions.columns, "_begin"]
    plain = joined.filter(~over).select(*columns, F.lit(0).alias("split_seq"))
    # by a hash of the session, as in rules.threshold_rule()
    dealt = joined.filter(over).select(*columns).repartition(F.xxhash64(key, "session_seq")).sortWithinPartitions(key, "session_seq", F.asc_nulls_last(time), order)
    capped = dealt.mapInArrow(scan, T.StructType([*dealt.schema, T.StructField("split_seq", T.IntegerType())]))
    both = plain.unionByName(capped)
    return both.withColumn("parent_tracking_id", F.concat_ws("_", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("_begin").cast("string"))).drop("_begin")


def keyless_sessions(df: DataFrame, time: str, gap_seconds: float, name: str = "session_id") -> DataFrame:
    """Sessions over all rows without a key, and without a task that holds all rows.

    Events in one bucket of gap_seconds are never further apart than the gap, so a break can only lie
    between neighbouring buckets that aren't empty: the first and last time of each bucket decide. Only that
    table, of a row a bucket, is put in order as a whole; its numbers go back by a join.
    """
    gap = int(gap_seconds * SECOND)
    bucketed = df.withColumn("_bucket", F.floor(F.col(time) / gap))
    ends = bucketed.groupBy("_bucket").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    w = Window.orderBy("_bucket")
    starts = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > gap).cast("int"), F.lit(0))
    numbered = ends.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return bucketed.join(numbered.select("_bucket", name), "_bucket").drop("_bucket")


def adaptive_gap(df: DataFrame, time: str, user_gap_seconds: float = 600, floor_seconds: float = 120, factor: float = 3.0, bucket_seconds: float = 3600) -> DataFrame:
    """One row gap_seconds: factor times the 95th percentile of the time between neighbouring events, kept between floor and user_gap.

    Differences within a bucket are found there, those between buckets from the buckets' ends.
    """
    bucket = int(bucket_seconds * SECOND)
    b = df.select(F.col(time).alias("t"), F.floor(F.col(time) / bucket).alias("b"))
    inner = b.select((F.col("t") - F.lag("t").over(Window.partitionBy("b").orderBy("t"))).alias("d"))
    ends = b.groupBy("b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    between = ends.select((F.col("lo") - F.lag("hi").over(Window.orderBy("b"))).alias("d"))
    p95 = exact_percentile(inner.union(between), "d", 0.95, "p95")
    gap = F.least(F.greatest(F.col("p95") * factor / SECOND, F.lit(float(floor_seconds))), F.lit(float(user_gap_seconds)))
    return p95.select(F.coalesce(gap, F.lit(float(user_gap_seconds))).alias("gap_seconds"))


def session_features(events: DataFrame, session: list[str], key: str = "source_ip", time: str = "us", order: str = "event_id") -> DataFrame:
    """The behaviour of each web session: counts, rates, diversity, pace, sizes and alerts. Durations count as a second at least."""
    w = Window.partitionBy(*session).orderBy(time, order)
    idle = (F.col(time) - F.lag(time).over(w)) / SECOND
    ext = web.extension(F.col("uri_path"))
    paced = events.withColumn("_idle", F.when(idle >= 0, idle)).withColumn("_ext", ext)
    n = F.count("*")
    rate = lambda test: F.round(F.count_if(test) / n, 4)
    seconds = (F.max(time) - F.min(time)) / SECOND
    status = F.col("status_code")
    start_hour = F.hour(F.timestamp_micros(F.min(time)))
    return paced.groupBy(*session).agg(
        F.min(time).alias("start_us"),
        F.round(seconds, 2).alias("session_duration_sec"),
        n.alias("total_requests"),
        F.round(n / (F.greatest(seconds, F.lit(1.0)) / 60), 2).alias("req_per_min"),
        F.round(F.coalesce(F.min("_idle"), F.lit(0.0)), 4).alias("min_interarrival_sec"),
        F.round(F.sum(web.uri_depth(F.col("uri_path"))) / n, 2).alias("avg_uri_depth"),
        rate(status == 404).alias("error_404_rate"),
        rate(status == 403).alias("error_403_rate"),
        rate(status >= 500).alias("error_50x_rate"),
        rate(F.col("http_method") == "POST").alias("post_rate"),
        rate(~F.col("http_method").isin(*web.STANDARD_METHODS)).alias("rare_method_rate"),
        F.round(F.count_distinct("uri_path") / n, 4).alias("unique_path_ratio"),
        rate(F.col("_ext").isin(*web.STATIC_EXTENSIONS)).alias("static_asset_ratio"),
        rate(F.col("_ext").isin(*web.SENSITIVE_EXTENSIONS)).alias("suspicious_ext_rate"),
        F.count_distinct("status_code").alias("status_diversity"),
        F.count_distinct("user_agent").alias("unique_uas"),
        F.round(F.sum(F.coalesce("bytes_sent", F.lit(0))) / n, 2).alias("avg_payload_bytes"),
        F.max(F.coalesce("bytes_sent", F.lit(0))).alias("max_resp_bytes"),
        F.count_if(F.col("flagged")).alias("l1_alert_count"),
        F.array_join(F.array_sort(F.collect_set("alert")), "|").alias("l1_alert_types"),
        ((start_hour < 6) | (start_hour > 18)).cast("int").alias("is_off_hours"),
    )


def transitions(events: DataFrame, session: list[str], time: str = "us", order: str = "event_id", state: str = "state", cuts: DataFrame | None = None) -> DataFrame:
    """(session, state, next) of neighbouring events: next is the speed of the step and the state it leads to.

    With cuts (of timeline_cuts(), by the first column of session) the last event of a hot key's segment finds the next one in
    the segments after it.
    """
    if cuts is not None:
        key, rest = session[0], session[1:]
        rows = timelines.in_segments(events, key, time, cuts)
        w = Window.partitionBy(key, timelines.SEGMENT).orderBy(time, order)
        own = F.struct(F.col(time).alias("t"), F.col(state).alias("state"), F.struct(*rest, F.lit(0)).alias("session"))
        rows = rows.withColumn("_own", own).withColumn("_next", F.lead("_own").over(w))
        first = {"_first": F.min(F.struct(F.col(time).isNotNull(), F.col(time), F.col(order), F.col("_own").alias("v")))["v"]}
        rows = timelines.with_carry(rows, key, first, lambda t, s: t.withColumn("_in", F.lead("_first").over(s)))
        rows = rows.withColumn("_next", F.coalesce("_next", "_in")).filter(F.col("_next.session").eqNullSafe(F.col("_own.session")))
        seconds, next_state = F.greatest(F.lit(0.0), (F.col("_next.t") - F.col(time)) / SECOND), F.col("_next.state")
        events = rows
    else:
        w = Window.partitionBy(*session).orderBy(time, order)
        seconds = F.greatest(F.lit(0.0), (F.lead(time).over(w) - F.col(time)) / SECOND)
        next_state = F.lead(state).over(w)
    found = events.select(*session, F.col(time), F.col(order), F.col(state).alias("state"), seconds.alias("_s"), next_state.alias("_n")).filter("_n is not null")
    return found.select(*session, time, order, "state", F.col("_n").alias("next_state"), F.concat_ws("_", web.speed_bin(F.col("_s")), "_n").alias("next"))


def _runs_in_segments(marked: DataFrame, group: str, time: str, order: str, cuts: DataFrame, longest: int) -> DataFrame:
    """compress_runs() a segment at a time: a run is from one break to the next, and its length is the difference of their places."""
    by = [F.col(time), F.col(order)]
    rows = timelines.in_segments(marked, group, time, cuts)
    rows = timelines.running_sum(rows, group, by, F.lit(1).cast("bigint"), "_i")
    w = Window.partitionBy(group, timelines.SEGMENT).orderBy(*by)
    rows = rows.withColumn("_own", F.struct(F.col("_what").alias("what"), F.col("_flag").alias("flag"))).withColumn("_last", F.lag("_own").over(w))
    end = {"_end": F.max(F.struct("_i", F.col("_own").alias("v")))["v"]}
    rows = timelines.with_carry(rows, group, end, lambda t, s: t.withColumn("_in", F.lag("_end").over(s)))
    last = F.coalesce("_last", "_in")
    breaks = last["what"].isNull() | F.col("_what").isNull() | (last["what"] != F.col("_what")) | F.col("_flag") | last["flag"]
    rows = rows.withColumn("_break", F.when(F.coalesce(breaks, F.lit(True)), F.col("_i"))).drop("_in", "_last", "_own")
    # from the last place down: a frame that ends with the last row is read anew for every row
    following = timelines.before(Window.partitionBy(group, timelines.SEGMENT).orderBy(F.desc("_i")))
    rows = rows.withColumn("_from", F.max("_break").over(timelines.upto(w))).withColumn("_to", F.min("_break").over(following))
    ends = {"_max": F.max("_break"), "_min": F.min("_break"), "_top": F.max("_i")}

    def carry(segments: DataFrame, s: WindowSpec) -> DataFrame:
        return segments.withColumn("_before", F.max("_max").over(timelines.before(s))).withColumn("_after", F.coalesce(F.min("_min").over(timelines.after(s)), F.max("_top").over(Window.partitionBy("_k")) + 1))

    rows = timelines.with_carry(rows, group, ends, carry)
    # the last run of a key that isn't hot ends with its last row
    end_of_key = F.max("_i").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
    return rows.withColumn("_island", F.coalesce("_from", "_before")).withColumn("_n", F.coalesce("_to", "_after", end_of_key) - F.col("_island"))


def compress_runs(events: DataFrame, group: str, what: Column, flagged: Column, time: str = "us", order: str = "event_id", longest: int = 5, cuts: DataFrame | None = None) -> DataFrame:
    """Runs of more than `longest` neighbouring events with equal `what` as one row (is_run, count, first and last time); others row by row.

    Flagged events and those whose `what` is null never join a run. With cuts (of timeline_cuts(), by group) hot groups are
    scanned a segment at a time.
    """
    w = Window.partitionBy(group).orderBy(time, order)
    marked = events.select(F.col(group), F.col(time), F.col(order), what.alias("_what"), flagged.alias("_flag"))
    if cuts is not None:
        return _rows_of_runs(_runs_in_segments(marked, group, time, order, cuts, longest), group, time, order, longest)
    breaks = F.lag("_what").over(w).isNull() | F.col("_what").isNull() | (F.lag("_what").over(w) != F.col("_what")) | F.col("_flag") | F.lag("_flag").over(w)
    marked = marked.withColumn("_island", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = Window.partitionBy(group, "_island")
    return _rows_of_runs(marked.withColumn("_n", F.count("*").over(islands)), group, time, order, longest)


def _rows_of_runs(sized: DataFrame, group: str, time: str, order: str, longest: int) -> DataFrame:
    runs = sized.filter(F.col("_n") > longest).groupBy(group, "_island").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("count"), F.min(order).alias(order))
    alone = sized.filter(F.col("_n") <= longest).select(group, "_island", F.col(time).alias("start_us"), F.col(time).alias("end_us"), F.lit(1).cast("bigint").alias("count"), order)
    return runs.unionByName(alone).withColumn("is_run", F.col("count") > longest).drop("_island")


def context_sample(events: DataFrame, group: str, anchor: Column, time: str = "us", order: str = "event_id", near: int = 15, most: int = 70) -> DataFrame:
    """Of groups with more than `most` events, those within `near` rows of an anchor (without any: of the first and last), the first `most` of them."""
    w = Window.partitionBy(group).orderBy(time, order)
    whole = Window.partitionBy(group)
    numbered = events.withColumn("_a", anchor.cast("int")).withColumn("_n", F.count("*").over(whole)).withColumn("_any", F.max("_a").over(whole)).withColumn("_i", F.row_number().over(w))
    is_anchor = F.when(F.col("_any") > 0, F.col("_a")).otherwise(((F.col("_i") == 1) | (F.col("_i") == F.col("_n"))).cast("int"))
    near_one = F.max("_anchor").over(w.rowsBetween(-near, near))
    kept = numbered.withColumn("_anchor", is_anchor).withColumn("_near", near_one).filter((F.col("_n") <= most) | (F.col("_near") > 0))
    return kept.withColumn("_r", F.row_number().over(w)).filter((F.col("_n") <= most) | (F.col("_r") <= most)).drop("_a", "_n", "_any", "_i", "_anchor", "_near", "_r")
