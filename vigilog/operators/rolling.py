"""Running measures of login events, and the order-based operators on users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.common import PRIVILEGED_ACTIONS, haversine_km
from vigilog.operators import timelines

SECOND = 1_000_000


def _hot_velocity(hot: DataFrame, key: str, time: str, order: str, seconds: int, cuts: DataFrame) -> DataFrame:
    """rolling_velocity() of hot keys: the place of a row on its time line less that of the last row before the span.

    Every row asks for the number of rows up to the time `seconds` ago by a question at that time; places of rows and
    answers are running counts by segment, and the two meet by the row's own identity.
    """
    columns = [F.struct(*(F.col(f"`{c}`") for c in hot.columns)).alias("_row"), F.col(key).alias("_key"), F.col(order).alias("_order")]
    rows = hot.select(*columns, F.col(time).alias("_t"), F.lit(0).alias("_asks"))
    asks = hot.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *columns[1:], (F.col(time) - seconds * SECOND).alias("_t"), F.lit(1).alias("_asks"))
    both = timelines.in_segments(rows.unionByName(asks), "_key", "_t", cuts)
    counted = timelines.running_sum(both, "_key", [F.col("_t"), F.col("_asks"), F.col("_order")], (1 - F.col("_asks")).cast("bigint"), "_n")
    met = counted.groupBy("_key", "_order").agg(F.max("_row").alias("_row"), F.sum(F.when(F.col("_asks") == 0, F.col("_n")).otherwise(-F.col("_n"))).alias("velocity"))
    return met.select("_row.*", "velocity")


def rolling_velocity(df: DataFrame, key: str = "rip", time: str = "us", order: str = "event_id", seconds: int = 60, cuts: DataFrame | None = None) -> DataFrame:
    """velocity: events of the key in the last `seconds` (open at the far end), those of the same time only up to the row itself.

    With cuts (of timeline_cuts()) hot keys are counted a segment at a time; order then has to tell a key's rows apart, and
    they need a time.
    """
    if cuts is not None:
        hot, cold = _by_heat(df, key, cuts)
        return _hot_velocity(hot, key, time, order, seconds, cuts).unionByName(rolling_velocity(cold, key, time, order, seconds))
    trailing = Window.partitionBy(key).orderBy(time).rangeBetween(-(seconds * SECOND - 1), 0)
    peers = Window.partitionBy(key, time)
    upto = peers.orderBy(order)
    return df.withColumn("velocity", F.count("*").over(trailing) - F.count("*").over(peers) + F.row_number().over(upto))


def _by_heat(df: DataFrame, key: str, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, and the others."""
    marked = lambda how: df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("cut_key")), how)
    return marked("left_semi"), marked("left_anti")


def _hot_users(hot: DataFrame, key: str, user: str, time: str, order: str, cuts: DataFrame) -> DataFrame:
    """cumulative_distinct_users() of hot keys: first appearances, a row a user, are put before the rows where they are and summed by segment."""
    rows = hot.select(F.struct(*(F.col(f"`{c}`") for c in hot.columns)).alias("_row"), F.col(key).alias("_key"), F.col(time).alias("_t"), F.col(order).alias("_order"), F.lit(1).alias("_is_row"))
    first = hot.filter(F.col(user).isNotNull()).groupBy(F.col(key).alias("_key"), user).agg(F.min(F.struct(F.col(time).isNotNull(), F.col(time).alias("t"), F.col(order).alias("o"))).alias("f"))
    first = first.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_key", F.col("f.t").alias("_t"), F.col("f.o").alias("_order"), F.lit(0).alias("_is_row"))
    both = timelines.in_segments(rows.unionByName(first), "_key", "_t", cuts)
    summed = timelines.running_sum(both, "_key", [F.col("_t"), F.col("_order"), F.col("_is_row")], (1 - F.col("_is_row")).cast("bigint"), "unique_users")
    return summed.filter("_is_row = 1").select("_row.*", "unique_users")


def cumulative_distinct_users(df: DataFrame, key: str = "rip", user: str = "user", time: str = "us", order: str = "event_id", cuts: DataFrame | None = None) -> DataFrame:
    """unique_users: different users of the key so far; null is no user. First appearances are marked and summed, no set is kept.

    With cuts (of timeline_cuts()) hot keys are summed a segment at a time.
    """
    if cuts is not None:
        hot, cold = _by_heat(df, key, cuts)
        return _hot_users(hot, key, user, time, order, cuts).unionByName(cumulative_distinct_users(cold, key, user, time, order))
    first = F.row_number().over(Window.partitionBy(key, user).orderBy(time, order)) == 1
    marked = df.withColumn("_first", (first & F.col(user).isNotNull()).cast("int"))
    w = Window.partitionBy(key).orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("unique_users", F.sum("_first").over(w)).drop("_first")


def session_risk(df: DataFrame, key: str = "rip", action: str = "action", user: str = "user", time: str = "us", order: str = "event_id", resets: tuple[str, ...] = ("Disconnected", "Session Closed")) -> DataFrame:
    """session_block (a reset action opens a new one) and session_risk_score: privileged actions and root users in the block so far."""
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = df.withColumn("session_block", F.sum(F.coalesce(F.col(action).isin(*resets).cast("int"), F.lit(0))).over(upto(key)))
    risk = F.coalesce(F.col(action).isin(*PRIVILEGED_ACTIONS).cast("int"), F.lit(0)) + F.coalesce((F.col(user) == "root").cast("int"), F.lit(0))
    return blocks.withColumn("session_risk_score", F.sum(risk).over(upto(key, "session_block")))


def geo_velocity(logins: DataFrame, user: str = "user", time: str = "us", order: str = "event_id", limit_kmh: float = 1000) -> DataFrame:
    """Logins whose address changed since the user's last located login, faster than limit_kmh; needs ip, lat, lon. Latitude 0 is a place."""
    located = logins.filter("lat is not null and lon is not null and ip is not null")
    w = Window.partitionBy(user).orderBy(time, order)
    last = F.lag(F.struct(F.col("ip").alias("ip"), F.col("lat").alias("lat"), F.col("lon").alias("lon"), F.col(time).alias("us"))).over(w)
    pairs = located.withColumn("_last", last).filter((F.col("_last.ip") != F.col("ip")) & (F.col(time) > F.col("_last.us")))
    km = haversine_km(F.col("_last.lat"), F.col("_last.lon"), F.col("lat"), F.col("lon"))
    hours = (F.col(time) - F.col("_last.us")) / (3600 * SECOND)
    return pairs.withColumn("distance_km", km).withColumn("speed_kmh", F.col("distance_km") / hours).filter(F.col("speed_kmh") > limit_kmh).withColumn("previous_ip", F.col("_last.ip")).drop("_last")


def first_time_ip(logins: DataFrame, user: str = "user", ip: str = "ip", time: str = "us", order: str = "event_id") -> DataFrame:
    """Logins from an address that the user hasn't used before, but for the user's first login of all."""
    of_ip = F.row_number().over(Window.partitionBy(user, ip).orderBy(time, order))
    of_user = F.row_number().over(Window.partitionBy(user).orderBy(time, order))
    return logins.withColumn("_i", of_ip).withColumn("_u", of_user).filter("_i = 1 and _u > 1").drop("_i", "_u")


def chronological_split(df: DataFrame, user: str = "user", time: str = "window_us", share: float = 0.8, least: int = 5) -> DataFrame:
    """role: of users with more than `least` rows the first share (at least `least`, never all) trains and the rest tests; with exactly `least` all do both; fewer are skipped."""
    n = F.count("*").over(Window.partitionBy(user))
    i = F.row_number().over(Window.partitionBy(user).orderBy(time))
    train = F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(least)), F.col("_n") - 1)
    role = F.when(F.col("_n") < least, "skip").when(F.col("_n") == least, "both").when(F.col("_i") <= train, "train").otherwise("test")
    return df.withColumn("_n", n).withColumn("_i", i).withColumn("role", role).drop("_n", "_i")


WINDOWS_SECONDS = (3600, 1800, 900, 300, 120, 60, 30)


def select_window(df: DataFrame, time: str = "us", least: int = 6, candidates: tuple[int, ...] = WINDOWS_SECONDS) -> DataFrame:
    """One row (span_seconds, window_seconds): the largest window of which at least `least` fit the span of the data, else the smallest."""
    span = df.agg(((F.max(time) - F.min(time)) / SECOND).alias("span_seconds"))
    chosen: Column = F.lit(candidates[-1])
    for w in reversed(candidates):
        chosen = F.when(F.floor(F.col("span_seconds") / w) >= least, w).otherwise(chosen)
    return span.withColumn("window_seconds", chosen)
