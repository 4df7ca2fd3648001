"""What reports and dashboards show: flat incidents, kinds of events, counts by several columns, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_incidents(incidents: DataFrame, context: list[str], level: str = "overall_threat_level", drop_normal: bool = True) -> DataFrame:
    """A row an incident: its id, level, scores, the named columns of its context, and its number of events."""
    rows = incidents.filter(F.col(level) != "NORMAL") if drop_normal else incidents
    return rows.select("incident_tracking_id", level, "max_statistical_score", "max_markov_score", *context, "total_raw_events")


def event_kind(is_run: Column, flagged: Column, alert: Column, status: Column) -> Column:
    """What a row of a compressed timeline is: a run, an alert with its text, an error, or normal."""
    return F.when(is_run, "bulk").when(flagged, F.concat(F.lit("alert: "), alert)).when(status >= 400, "error").otherwise("normal")


def counts_by(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """(name, metric, n): rows of each part (metric, rows, column) by the values of its column."""
    found = [rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select("name", F.lit(metric).alias("metric"), "n") for metric, rows, column in parts]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def dashboard_metrics(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Incidents by level, alerts by kind, events by address, URIs of flagged events."""
    return counts_by(("incidents", incidents, "overall_threat_level"), ("alerts", events.filter("alert is not null"), "alert"), ("events", events, "source_ip"), ("uris", events.filter("flagged"), "uri_path"))


def detection_sources(df: DataFrame, model: Column, whitelist: Column) -> DataFrame:
    """One row: how many rows the model, the whitelist, both, and the whitelist alone have found."""
    return df.agg(F.count_if(model).alias("by_model"), F.count_if(whitelist).alias("by_whitelist"), F.count_if(model & whitelist).alias("both_found"), F.count_if(whitelist & ~model).alias("whitelist_only"))


def detection_summary(df: DataFrame, severity: str = "severity", phase: str = "apt_phase") -> DataFrame:
    """Rows that aren't normal, by severity and by phase, in one pass."""
    by = [F.col(severity), F.col(phase)]
    return df.filter(F.col(severity) != "NORMAL").groupingSets([[c] for c in by], *by).agg(F.count("*").alias("n"))


def layer1_stats(df: DataFrame, flagged: str = "flagged") -> DataFrame:
    """One row: events, flagged ones and their share in percent."""
    hit = F.count_if(F.col(flagged))
    return df.agg(F.count("*").alias("processed"), hit.alias("flagged_events"), F.round(hit / F.count("*") * 100, 4).alias("flagged_percent"))


def compression_rate(compressed: DataFrame, count: str = "count") -> DataFrame:
    """One row: events before and after runs were compressed, and the part that is saved."""
    raw, left = F.sum(count), F.count("*")
    return compressed.agg(raw.alias("raw_events"), left.alias("compressed_events"), F.round((raw - left) / raw, 6).alias("rate"))
