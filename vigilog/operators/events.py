"""Windows events: field routing, positional properties, window features; category breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions import windows as win

# Places of named fields in an event's property array, by event.
PROPERTY_PLACES: dict[int, dict[str, int]] = {
    4663: {"SubjectUserName": 1, "ObjectName": 6, "AccessMask": 9, "ProcessName": 11},
    5145: {"SubjectUserName": 1, "IpAddress": 5, "ShareName": 7, "RelativeTargetName": 8, "AccessMask": 9},
    4624: {"SubjectUserName": 1, "TargetUserName": 5, "LogonType": 8, "WorkstationName": 11, "ProcessName": 17, "IpAddress": 18},
    4625: {"SubjectUserName": 1, "TargetUserName": 5, "FailureReason": 7, "Status": 7, "LogonType": 10, "IpAddress": 19},
    4648: {"SubjectUserName": 1, "TargetUserName": 5, "TargetServerName": 7, "ProcessName": 9},
    4688: {"SubjectUserName": 1, "NewProcessName": 5, "ProcessName": 5, "CommandLine": 8, "ParentProcessName": 13},
    4656: {"SubjectUserName": 1, "ObjectName": 6, "AccessMask": 9, "ProcessName": 11},
    4660: {"SubjectUserName": 1, "ObjectName": 6, "ProcessName": 7},
    4658: {"SubjectUserName": 1, "ObjectName": 5},
    4698: {"SubjectUserName": 1, "TaskName": 4},
    5140: {"SubjectUserName": 1, "ShareName": 5, "IpAddress": 7, "AccessMask": 8},
    7045: {"ServiceName": 0, "ServiceFileName": 1, "SubjectUserName": 4},
    1102: {"SubjectUserName": 1, "AccountName": 1},
}
FIELDS = sorted({f for places in PROPERTY_PLACES.values() for f in places})


def map_event_properties(df: DataFrame, event_id: str = "EventID", properties: str = "properties") -> DataFrame:
    """df with a column for each named field, from an array of strings; empty where the event or the array hasn't it."""
    eid, props = F.col(event_id), F.col(properties)

    def field(name: str) -> Column:
        found: Column = F.lit("")
        for event, places in PROPERTY_PLACES.items():
            if name in places:
                found = F.when(eid == event, F.coalesce(F.get(props, places[name]), F.lit(""))).otherwise(found)
        return found

    return df.select("*", *(field(name).alias(name) for name in FIELDS))


def _first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def normalize_windows_events(df: DataFrame) -> DataFrame:
    """The events that matter, with category, user, object, mask and share by the rules of each event.

    Needs EventID and any of the named fields; those that are absent count as empty.
    """
    have = set(df.columns)
    col = lambda name: F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")
    eid = F.col("EventID")
    subject, target = col("SubjectUserName"), col("TargetUserName")
    share_target = F.when(col("ShareName") != "", F.concat(col("ShareName"), F.lit("\\"), col("RelativeTargetName"))).otherwise(col("RelativeTargetName"))
    object_name = (
        F.when(eid.isin(4663, 4656, 4658, 4660), col("ObjectName"))
        .when(eid == 5145, share_target)
        .when(eid == 5140, col("ShareName"))
        .when(eid == 4648, col("TargetServerName"))
        .when(eid == 4698, col("TaskName"))
        .when(eid == 7045, col("ServiceName"))
        .when(eid == 1102, "Audit Log Cleared")
        .otherwise("")
    )
    user = (
        F.when(eid.isin(4624, 4625), _first_filled(target, subject))
        .when(eid == 4688, _first_filled(subject, target))
        .when(eid == 1102, F.when(subject != "", subject).when(col("AccountName") != "", col("AccountName")).otherwise("SYSTEM"))
        .otherwise(subject)
    )
    keep = [c for c in df.columns if c not in ("SubjectUserName", "ObjectName", "ProcessName", "EventCategory", "AccessMask_Raw")]
    mask = F.when(eid.isin(4663, 5145, 4656, 4660, 5140), _first_filled(col("AccessMask"), F.lit("0x0"))).otherwise("0x0")
    return df.filter(eid.isin(*win.TARGET_EVENT_IDS)).select(
        *(F.col(f"`{c}`") for c in keep),
        win.event_category(eid).alias("EventCategory"),
        user.alias("SubjectUserName"),
        object_name.alias("ObjectName"),
        F.when(eid == 4688, col("NewProcessName")).otherwise(col("ProcessName")).alias("ProcessName"),
        mask.alias("AccessMask_Raw"),
    )


#: Kinds of values that windows count the different ones of, and the columns of the counts.
DIFFERENT = {"file": "distinct_files_accessed", "process": "distinct_processes_used", "ip": "distinct_logon_source_ips", "parent": "distinct_parent_processes", "share": "distinct_shares_accessed"}


def values_of_event() -> Column:
    """An event's values (kind, value), by the rules of each kind: without those that it doesn't have."""
    eid = F.col("EventID")
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    of = lambda kind, name, test: F.when(test, F.struct(F.lit(kind).alias("kind"), F.col(name).alias("value")))
    address = ~F.coalesce(F.col("IpAddress"), F.lit("")).isin("", "local", "-")
    return F.array_compact(F.array(
        of("file", "ObjectName", F.col("ObjectName").isNotNull()), of("process", "ProcessName", filled("ProcessName")), of("process", "NewProcessName", filled("NewProcessName")),
        of("ip", "IpAddress", eid.isin(4624, 4625) & address), of("parent", "ParentProcessName", (eid == 4688) & filled("ParentProcessName")), of("share", "ShareName", (eid == 5140) & filled("ShareName")),
    ))


def _different_values(rows: DataFrame) -> DataFrame:
    """(user, _w) with the number of different values of each kind, from rows of events with user and _w.

    Each value is made a row (kind, value), of which equal ones become one, map-side first; then rows are counted by
    kind. So no task holds the values of a user, and no row is expanded for kinds of value that it doesn't have.
    """
    different = rows.select("user", "_w", F.explode(values_of_event()).alias("v")).select("user", "_w", "v.kind", "v.value").distinct()
    return different.groupBy(F.col("user").alias("_user"), F.col("_w").alias("_window")).agg(*(F.count_if(F.col("kind") == kind).alias(name) for kind, name in DIFFERENT.items()))


def ueba_window_features(df: DataFrame, user: str = "SubjectUserName", time: str = "TimeCreated", window: str = "1 hour") -> DataFrame:
    """26 behaviour features of each user and tumbling window; window_start is the window's begin.

    Needs the normalised event columns and the flags is_read, is_write, is_append, is_delete, is_lolbin.
    """
    eid = F.col("EventID")
    count = lambda *ids: F.count_if(eid.isin(*ids))
    total = lambda name: F.sum(F.col(name).cast("bigint"))
    hour = F.median(F.hour(time))
    writes = total("is_write") + total("is_append")
    rows = df.withColumn("_w", F.window(time, window)["start"]).withColumn("user", F.col(user)).filter("_w is not null")
    grouped = rows.groupBy("user", "_w").agg(
        total("is_read").alias("total_read_operations"),
        writes.alias("total_write_operations"),
        total("is_delete").alias("total_delete_operations"),
        F.count("*").alias("total_events"),
        F.round(total("is_read") / (writes + 1), 4).alias("read_write_ratio"),
        F.count_if(win.is_admin_share(F.col("ObjectName"), F.col("ShareName"))).alias("admin_share_access_count"),
        total("is_lolbin").alias("lolbin_event_count"),
        F.round(F.count_if(~F.hour(time).between(8, 17)) / F.count("*"), 4).alias("off_hour_activity_ratio"),
        F.round(F.sin(2 * F.pi() * hour / 24), 4).alias("hour_sin"),
        F.round(F.cos(2 * F.pi() * hour / 24), 4).alias("hour_cos"),
        count(4624).alias("successful_logon_count"),
        count(4625).alias("failed_logon_count"),
        F.round(F.coalesce(F.try_divide(count(4625), count(4624, 4625)), F.lit(0.0)), 4).alias("failed_logon_ratio"),
        count(4648).alias("explicit_credential_count"),
        count(4688).alias("new_process_count"),
        F.count_if((eid == 4688) & F.col("is_lolbin")).alias("suspicious_process_count"),
        count(4698).alias("scheduled_task_created_count"),
        count(7045).alias("service_installed_count"),
        count(1102).alias("audit_log_cleared_count"),
        count(4660).alias("object_deleted_count"),
        count(5140).alias("share_session_count"),
    )
    different = _different_values(rows)
    names = [c for c in different.columns if c.startswith("distinct_")]
    found = grouped.join(different, F.col("user").eqNullSafe(F.col("_user")) & (F.col("_w") == F.col("_window")), "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).withColumn("window_start", F.col("_w"))
    order = ["user", *grouped.columns[2:7], *names[:2], *grouped.columns[7:]]
    return found.select(*order, *names[2:], "window_start")


def flag_events(df: DataFrame) -> DataFrame:
    """Normalised events with the seven behaviour flags and is_lolbin."""
    flags = win.behaviour_flags(F.col("EventID"), F.col("AccessMask_Raw"))
    paths = [F.col(c) for c in ("ProcessName", "NewProcessName", "ParentProcessName") if c in df.columns]
    return df.withColumns({**flags, "is_lolbin": win.is_lolbin(*paths)})


def category_breakdown(df: DataFrame) -> DataFrame:
    """Events by category, by event and in all, with percent, users and span, in one pass over grouping sets."""
    sets = df.groupingSets([[F.col("EventCategory")], [F.col("EventCategory"), F.col("EventID")], []], F.col("EventCategory"), F.col("EventID"))
    found = sets.agg(F.count("*").alias("events"), F.count_distinct("SubjectUserName").alias("users"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.grouping_id().alias("_level"))
    total = F.max(F.when(F.col("_level") == 3, F.col("events"))).over(_everything())
    return found.withColumn("percent", F.round(F.col("events") / total * 100, 2)).drop("_level")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()
