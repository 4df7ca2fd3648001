"""Network flows: ratio features, behaviour and risk of source addresses, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators.aggregates import exact_percentile


def flow_ratio_features(df: DataFrame) -> DataFrame:
    """Log ratios and rates of a flow. byte_rate divides by the elapsed time's logarithm plus one, as its models were trained."""
    logged = F.log1p("elapsed")
    return df.withColumns({
        "byte_ratio": F.log1p("bytes_sent") - F.log1p("bytes_received"),
        "packet_ratio": F.log1p("pkts_sent") - F.log1p("pkts_received"),
        "bytes_per_packet": F.log1p(F.col("bytes") / (F.col("packets") + 1)),
        "connection_intensity": F.log1p(F.col("packets") / (F.col("elapsed") + 1)),
        "log_bytes": F.log1p("bytes"),
        "log_packets": F.log1p("packets"),
        "log_elapsed": logged,
        "byte_rate": F.log1p(F.col("bytes") / (logged + 1)),
    })


def host_behavior_summary(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per source address: flows, anomalies (score below the threshold), scores, destinations, bytes, times."""
    times = F.unix_micros(F.col("ts").cast("timestamp"))
    found = df.groupBy("source_ip").agg(
        F.count("*").alias("total_flows"),
        F.count_if(F.col("score") < threshold).alias("anomaly_flows"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
        F.count_distinct("destination_ip").alias("unique_dest"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("bytes_received").alias("bytes_received"),
        F.min(times).alias("first_seen_us"),
        F.max(times).alias("last_seen_us"),
    )
    return found.withColumns({"anomaly_ratio": F.col("anomaly_flows") / F.col("total_flows"), "active_duration": (F.col("last_seen_us") - F.col("first_seen_us")) / 1e6})


def host_risk_score(hosts: DataFrame, quantile: float = 0.9, eps: float = 1e-6) -> DataFrame:
    """hosts with risk_score (0.7 of the scaled anomaly ratio, 0.3 of the scaled anomaly count) and apt_flag for those at or above the quantile.

    The extremes and the quantile are tables of one row.
    """
    ends = hosts.agg(F.min("anomaly_ratio").alias("_lo"), F.max("anomaly_ratio").alias("_hi"), F.max("anomaly_flows").alias("_most"))
    ratio = (F.col("anomaly_ratio") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)
    risk = 0.7 * ratio + 0.3 * (F.col("anomaly_flows") / (F.col("_most") + eps))
    scored = hosts.crossJoin(F.broadcast(ends)).withColumn("risk_score", risk).drop("_lo", "_hi", "_most")
    limit = exact_percentile(scored, "risk_score", quantile, "_limit")
    return scored.crossJoin(F.broadcast(limit)).withColumn("apt_flag", (F.col("risk_score") >= F.col("_limit")).cast("int")).drop("_limit")


def anomaly_report(flows: DataFrame, hosts: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row per anomalous flow: the flow and its host's summary as structures; ground truth may be null."""
    host = F.struct("total_flows", "anomaly_flows", F.round("risk_score", 6).alias("risk_score"), "apt_flag")
    of_host = hosts.select(F.col("source_ip").alias("_ip"), host.alias("host"))
    odd = flows.filter(F.col("score") < threshold)
    flow = F.struct("source_ip", "destination_ip", "bytes", "packets", "score", "label")
    return odd.join(of_host, odd["source_ip"] == of_host["_ip"]).select("flow_id", flow.alias("flow"), "host")


def report_metadata(flows: DataFrame, hosts: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row of counts that go with a report: flows, anomalous flows, hosts, hosts with an anomaly, flagged hosts."""
    of_flows = flows.agg(F.count("*").alias("total_flows"), F.count_if(F.col("score") < threshold).alias("anomalous_flows"))
    of_hosts = hosts.agg(F.count("*").alias("hosts"), F.count_if(F.col("anomaly_flows") > 0).alias("anomalous_hosts"), F.count_if(F.col("apt_flag") == 1).alias("flagged_hosts"))
    return of_flows.crossJoin(of_hosts)
