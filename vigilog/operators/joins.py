"""Joins of events, sessions, scores, labels and reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.common import ip_to_long, is_private_ip
from vigilog.operators import timelines

SECOND = 1_000_000


def merge_scores(statistical: DataFrame, sequence: DataFrame, on: tuple[str, ...] = ("session_id", "parent_tracking_id")) -> DataFrame:
    return statistical.join(sequence, list(on), "inner")


def attach_features(scores: DataFrame, features: DataFrame, on: str = "session_id") -> DataFrame:
    return scores.join(features, on, "left")


def attach_session_stats(events: DataFrame, session: str, **stats: Column) -> DataFrame:
    """events with aggregates of their session, by a window: one shuffle and no join back."""
    w = Window.partitionBy(session)
    return events.withColumns({name: c.over(w) for name, c in stats.items()})


def label_events(events: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """events with label, null where there is none. Spark broadcasts the labels where their size allows."""
    return events.join(labels, on, "left")


def label_sessions(sessions: DataFrame, labelled_events: DataFrame, session: str, label: str = "label") -> DataFrame:
    """sessions with is_attack: whether any of their events is labelled."""
    hit = labelled_events.groupBy(session).agg(F.bool_or(F.col(label).isNotNull()).alias("is_attack"))
    return sessions.join(hit, session, "left").withColumn("is_attack", F.coalesce("is_attack", F.lit(False)))


def known_users(train: DataFrame, user: str = "user") -> DataFrame:
    return train.select(user).filter(F.col(user).isNotNull()).distinct()


def flag_unknown_users(events: DataFrame, whitelist: DataFrame, user: str = "user", ignore: tuple[str, ...] = ()) -> DataFrame:
    """events with unknown_user: the user isn't on the whitelist (null and ignored ones never are unknown)."""
    marked = events.join(whitelist.select(F.col(user).alias("_known")), F.col(user) == F.col("_known"), "left")
    unknown = F.col("_known").isNull() & F.col(user).isNotNull() & ~F.coalesce(F.col(user).isin(*ignore), F.lit(False)) if ignore else F.col("_known").isNull() & F.col(user).isNotNull()
    return marked.withColumn("unknown_user", unknown).drop("_known")


def fill_logout_ip(events: DataFrame, user: str = "user", time: str = "us", order: str = "event_id", columns: tuple[str, ...] = ("rip", "lip"), cuts: DataFrame | None = None) -> DataFrame:
    """Rows without addresses get the latest ones that the user had before. With cuts (of timeline_cuts()) hot users are filled a segment at a time."""
    if cuts is not None:
        known = timelines.last_known(timelines.in_segments(events, user, time, cuts), user, time, order, {f"_known_{c}": F.col(c) for c in columns})
        return known.withColumns({c: F.coalesce(c, f"_known_{c}") for c in columns}).select(events.columns)
    w = Window.partitionBy(user).orderBy(time, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(w)) for c in columns})


def attribute_errors(events: DataFrame, host: str = "host", ip: str = "source_ip", time: str = "us", order: str = "event_id", seconds: float = 2, cuts: DataFrame | None = None) -> DataFrame:
    """Events without an address get that of the latest event of their host with one, if it is at most `seconds` earlier.

    An as-of join within one window over the host, without pairs. attributed tells whether it happened. With cuts (of
    timeline_cuts()) hot hosts are scanned a segment at a time.
    """
    located = F.when(F.col(ip).isNotNull(), F.struct(F.col(time).alias("t"), F.col(ip).alias("ip")))
    if cuts is not None:
        events = timelines.last_known(timelines.in_segments(events, host, time, cuts), host, time, order, {"_last": located}).drop(timelines.SEGMENT)
        last = F.col("_last")
    else:
        last = F.last(located, ignorenulls=True).over(Window.partitionBy(host).orderBy(time, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.when(F.col(time) - F.col("_last.t") <= int(seconds * SECOND), F.col("_last.ip"))
    found = events.withColumn("_last", last).withColumn("_near", near)
    return found.withColumn("attributed", F.col(ip).isNull() & F.col("_near").isNotNull()).withColumn(ip, F.coalesce(ip, "_near")).drop("_last", "_near")


def enrich_geo(events: DataFrame, ranges: DataFrame, ip: str = "source_ip") -> DataFrame:
    """events with geo_country and is_external: private addresses are LOCAL, others by (start_ip, end_ip, country), else UNKNOWN.

    Ranges are cut at /16 borders, so that each different address meets the few of its own /16 by an
    equi-join, whatever the sizes of both tables; addresses are looked up once each.
    """
    block = 1 << 16
    cut_ranges = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_ip") / block), F.floor(F.col("end_ip") / block))))
    addresses = events.select(F.col(ip).alias("_ip")).filter("_ip is not null").distinct().withColumn("_n", ip_to_long(F.col("_ip"))).withColumn("_block", F.floor(F.col("_n") / block))
    met = addresses.join(cut_ranges, "_block").filter("_n between start_ip and end_ip").groupBy("_ip").agg(F.min_by("country", "start_ip").alias("_country"))
    joined = events.join(met, F.col(ip) == F.col("_ip"), "left")
    local = is_private_ip(F.col(ip))
    return joined.withColumn("geo_country", F.when(local, "LOCAL").otherwise(F.coalesce("_country", F.lit("UNKNOWN")))).withColumn("is_external", (~local).cast("int")).drop("_ip", "_country")


def country_frequency(train: DataFrame, country: str = "geo_country") -> DataFrame:
    """(country, frequency) of training sessions."""
    counted = train.groupBy(country).agg(F.count("*").alias("_n"))
    return counted.withColumn("frequency", F.col("_n") / F.sum("_n").over(Window.partitionBy())).drop("_n")


def apply_country_frequency(sessions: DataFrame, frequencies: DataFrame, country: str = "geo_country", unseen: float = 0.0001) -> DataFrame:
    return sessions.join(frequencies, country, "left").withColumn("frequency", F.coalesce("frequency", F.lit(unseen)))


def enrich_reputation(items: DataFrame, indicators: DataFrame, kind: str, value: str) -> DataFrame:
    """items with engines: how many engines of the indicator table (kind, value, engines) know the item, else 0."""
    known = indicators.filter(F.col("kind") == kind).groupBy(F.col("value").alias("_value")).agg(F.max("engines").alias("engines"))
    return items.join(known, F.col(value) == F.col("_value"), "left").withColumn("engines", F.coalesce("engines", F.lit(0))).drop("_value")


def keep_reported(scores: DataFrame, incidents: DataFrame, parent: str = "parent_tracking_id", incident: str = "incident_tracking_id") -> DataFrame:
    return scores.join(incidents.select(F.col(incident).alias(parent)), parent, "left_semi")
