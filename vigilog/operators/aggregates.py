"""Aggregates: kill chains, incidents, dashboards, detection quality, verdicts, scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.common import threat_level
from vigilog.functions.web import PHASE_ORDER


def timeline_session_stats(events: DataFrame, session: str = "session_id", time: str = "us") -> DataFrame:
    return events.groupBy(session).agg(
        F.count("*").alias("session_event_count"), F.count_distinct("apt_phase").alias("session_phase_count"), F.count_if(F.col("severity") != "NORMAL").alias("session_attack_count"),
        F.min(time).alias("session_start_us"), F.max(time).alias("session_end_us"), ((F.max(time) - F.min(time)) / 1e6).alias("session_duration_sec"),
    )


def kill_chain_candidates(events: DataFrame, session: str = "session_id", time: str = "us", order: str = "seq") -> DataFrame:
    """Sessions with two or more phases that move forward along the kill chain or hold a critical event.

    Phases are in the order of their first appearance, one small array a session; apt_score is the share of
    neighbouring phases that move forward.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PHASE_ORDER)), F.col("apt_phase")), F.lit(0)) - 1
    first = events.groupBy(session, "apt_phase").agg(F.min(F.struct(time, order)).alias("_at"), F.count("*").alias("_n"), F.count_if(F.col("severity") == "CRITICAL").alias("_c"), F.count_if(F.col("severity") == "WARNING").alias("_w"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    phases = first.withColumn("_rank", rank).groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct("_at", "apt_phase", "_rank"))).alias("_p"),
        F.sum("_n").alias("event_count"), F.sum("_c").alias("critical_count"), F.sum("_w").alias("warning_count"), F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"),
    )
    ranks = F.transform("_p", lambda x: x["_rank"])
    n = F.size("_p")
    forward = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0), lambda s, i: s + F.when((F.get(ranks, i - 1) >= 0) & (F.get(ranks, i) > F.get(ranks, i - 1)), 1).otherwise(0))
    scored = phases.filter(n >= 2).withColumn("apt_score", F.round(forward / (n - 1), 3))
    return scored.filter((F.col("apt_score") > 0) | (F.col("critical_count") > 0)).select(
        session, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_sec"), F.array_join(F.transform("_p", lambda x: x["apt_phase"]), " → ").alias("phases_observed"),
        n.alias("phase_count"), "apt_score", "event_count", "critical_count", "warning_count",
    )


def correlate_incidents(scored: DataFrame, parent: str, order: str, features: list[str]) -> DataFrame:
    """One row per parent: highest scores, highest of each feature (0 at least), signature hits, sequence texts in order, events, threat level."""
    worst = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))
    found = scored.groupBy(F.col(parent).alias("incident_tracking_id")).agg(
        worst("statistical_threat_score").alias("max_statistical_score"), worst("markov_threat_score").alias("max_markov_score"),
        *(worst(F.col(f).cast("double")).alias(f) for f in features),
        F.coalesce(F.bool_or("has_alert"), F.lit(False)).alias("has_alert"), F.sum("total_requests").alias("total_raw_events"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "sequence_summary"))), lambda x: x["sequence_summary"]), " | ").alias("sequence_chain"),
    )
    level = threat_level(F.col("max_statistical_score"), F.col("max_markov_score"), F.col("has_alert"))
    return found.withColumn("overall_threat_level", level).withColumn("source_ip", F.substring_index("incident_tracking_id", "_", 1))


def confusion_metrics(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """One row: tp, fp, tn, fn and the rates of both classes; a rate without rows is 0."""
    hit = lambda p, t: F.count_if((predicted == p) & (truth == t))
    c = df.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fn"))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), b), 4), F.lit(0.0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return c.select(
        "tp", "fp", "tn", "fn", share("tp", tp + fp).alias("precision"), share("tp", tp + fn).alias("recall"), F.coalesce(F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 4), F.lit(0.0)).alias("f1"),
        share("tn", tn + fn).alias("normal_precision"), share("tn", tn + fp).alias("normal_recall"), F.coalesce(F.round(F.try_divide(tp + tn, tp + tn + fp + fn), 4), F.lit(0.0)).alias("accuracy"),
        share("fp", fp + tn).alias("fpr"), share("fn", fn + tp).alias("fnr"),
    )


def score_curve(df: DataFrame, score: str, truth: str, digits: int | None = 4) -> DataFrame:
    """(score, tp, fp, positives, negatives): running counts from the highest score down, one row per different score.

    Scores are rounded, so the table that is put in order stays small whatever the input's size is.
    """
    key = F.round(score, digits) if digits is not None else F.col(score)
    grouped = df.groupBy(key.alias("score")).agg(F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) == 0).alias("_n"))
    w, everything = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    return grouped.select("score", F.sum("_p").over(w).alias("tp"), F.sum("_n").over(w).alias("fp"), F.sum("_p").over(everything).alias("positives"), F.sum("_n").over(everything).alias("negatives"))


def roc_pr_auc(curve: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve, and the average precision (a step sum)."""
    w = Window.orderBy(F.desc("score"))
    tp0, fp0 = (F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("tp", "fp"))
    steps = curve.withColumns({"_roc": (F.col("fp") - fp0) * (F.col("tp") + tp0) / 2, "_pr": (F.col("tp") - tp0) * (F.col("tp") / (F.col("tp") + F.col("fp")))})
    return steps.agg(F.round(F.sum("_roc") / F.max(F.col("positives") * F.col("negatives")), 6).alias("roc_auc"), F.round(F.sum("_pr") / F.max("positives"), 6).alias("pr_auc"))


def threshold_at_fpr(curve: DataFrame, target: float) -> DataFrame:
    """One row: the lowest score whose false-positive rate is at most the target, with its recall."""
    return curve.filter(F.col("fp") <= target * F.col("negatives")).agg(F.min("score").alias("threshold"), F.round(F.max(F.col("tp") / F.col("positives")), 6).alias("recall"))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: tuple[int, ...] = (40, 50, 60, 70, 80, 90)) -> DataFrame:
    """tp, fp, fn, recall and fpr at each threshold, in one pass over the rows."""
    counts = [F.count_if((F.col(score) >= t) & (F.col(truth) == k)).alias(f"_{k}_{t}") for t in thresholds for k in (0, 1)]
    wide = df.agg(F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) == 0).alias("_n"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_1_{t}").alias("tp"), F.col(f"_0_{t}").alias("fp")) for t in thresholds)))
    long = wide.select("_p", "_n", rows.alias("r")).select("r.*", "_p", "_n")
    return long.select("threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), F.round(F.try_divide("tp", "_p"), 6).alias("recall"), F.round(F.try_divide("fp", "_n"), 6).alias("fpr"))


#: Accuracy of the sketches that narrow an exact percentile down, and the quantiles that are taken of each.
SKETCH_ACCURACY, GRID = 10_000, 1_000
#: Values that are put in order at the end, whatever the number of rows.
MOST_SORTED = 100_000


def exact_percentile(df: DataFrame, column: str, share: float, name: str = "percentile", most: int = MOST_SORTED) -> DataFrame:
    """One row: the value below which `share` (0 to 1) of the rows lie, between neighbours by proportion; null without rows.

    Round by round the rows between two bounds are counted and a mergeable sketch of them gives the next bounds, some
    thousandth of them apart, until no more than `most` rows are left or the value is a bound itself, as where many rows are
    equal. Counts, not the sketch, tell whether the value lies between. Only what is left is put in order. Every round
    reads df; ten thousand million rows take three.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    shares = F.array(*(F.lit(i / GRID) for i in range(1, GRID)))
    lo = hi = safe_lo = safe_hi = None
    margin = 3 / SKETCH_ACCURACY
    while True:
        above = F.lit(True) if lo is None else F.col("x") > lo
        below = F.lit(True) if hi is None else F.col("x") < hi
        inside = above & below
        r = x.agg(
            F.count("*").alias("n"), F.count_if(F.lit(False) if lo is None else F.col("x") < lo).alias("lt_lo"), F.count_if(~above).alias("le_lo"), F.count_if(below).alias("lt_hi"),
            F.count_if(F.lit(True) if hi is None else F.col("x") <= hi).alias("le_hi"), F.percentile_approx(F.when(inside, F.col("x")), shares, F.lit(SKETCH_ACCURACY)).alias("grid"),
        ).first()
        n, le, lt = r["n"], r["le_lo"], r["lt_hi"]
        place = (n - 1) * share
        first, second = math.floor(place), math.ceil(place)
        if n and (r["lt_lo"] > first or r["le_hi"] <= second):
            # the sketch was further off than it should be: back to bounds that hold, and more room
            lo, hi, margin = safe_lo, safe_hi, margin * 4
            continue
        safe_lo, safe_hi, within = lo, hi, lt - le
        if within <= most or not any(le <= k < lt for k in (first, second)):
            break
        down, up = math.floor(((first - le) / within - margin) * GRID) - 1, math.ceil(((second - le) / within + margin) * GRID) - 1
        lo = r["grid"][min(down, GRID - 2)] if down >= 0 else lo
        hi = r["grid"][max(up, 0)] if up < GRID - 1 else hi
        if (lo, hi) == (safe_lo, safe_hi):
            break
    ranked = x.filter(inside).groupBy("x").agg(F.count("*").alias("m")).withColumn("upto", F.lit(le) + F.sum("m").over(Window.orderBy("x")))

    def at(k: int) -> Column:
        """The value of rank k."""
        return F.lit(lo).cast("double") if k < le else F.lit(hi).cast("double") if k >= lt else F.min(F.when(F.col("upto") > k, F.col("x")))

    found = ranked.agg(F.max("x").alias("any"), at(first).alias("a"), at(second).alias("b"))
    return found.select((F.col("a") + (F.col("b") - F.col("a")) * F.lit(place - first)).alias(name)) if n else found.select(F.lit(None).cast("double").alias(name))


def detector_benchmark(df: DataFrame, detectors: list[str], payload: str, truth: str) -> DataFrame:
    """Per detector: recall on different attack payloads and false-positive rate on different benign ones."""
    unique = df.groupBy(payload, truth).agg(*(F.max(F.col(d).cast("int")).alias(d) for d in detectors))
    long = unique.unpivot([payload, truth], detectors, "detector", "hit")
    return long.groupBy("detector").agg(
        F.count_if(F.col(truth) == 1).alias("attacks"), F.count_if((F.col(truth) == 1) & (F.col("hit") == 1)).alias("detected"), F.count_if(F.col(truth) == 0).alias("benign"),
        F.count_if((F.col(truth) == 0) & (F.col("hit") == 1)).alias("false_alarms"),
    ).withColumns({"recall": F.round(F.try_divide("detected", "attacks"), 4), "fpr": F.round(F.try_divide("false_alarms", "benign"), 4)})


def missed_payloads(df: DataFrame, detector: str, payload: str, truth: str) -> DataFrame:
    return df.groupBy(payload, truth).agg(F.max(F.col(detector).cast("int")).alias("_hit")).filter((F.col(truth) == 1) & (F.col("_hit") == 0)).select(payload)


def standard_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and deviations (population; 0 counts as 1) and extremes, named <column>_mean, _sd, _min, _max."""
    stats = [(F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")) for c in columns]
    found = train.agg(*(x for s in stats for x in s))
    return found.withColumns({f"{c}_sd": F.when(F.coalesce(f"{c}_sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"{c}_sd")) for c in columns})


def scale(df: DataFrame, scaler: DataFrame, columns: list[str], kind: str = "standard", low: float = 0.0, high: float = 100.0) -> DataFrame:
    """df with each column scaled by a one-row scaler: to z-scores, or from [min, max] to [low, high], clipped (a constant column gives low)."""
    joined = df.crossJoin(F.broadcast(scaler))
    if kind == "standard":
        made = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns}
    else:
        made = {c: F.least(F.greatest(low + F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_min"), (F.col(f"{c}_max") - F.col(f"{c}_min")).cast("double")), F.lit(0.0)) * (high - low), F.lit(low)), F.lit(high)) for c in columns}
    return joined.withColumns(made).select(df.columns)


def email_risk_score(items: DataFrame, message: str) -> DataFrame:
    """One row per message of items (kind url or attachment, engines, signature_hits, sandbox_score): final_score and action.

    A link adds 5 a knowing engine, 50 at most; an attachment adds 60 for a signature, the same for engines, and ten times its sandbox score.
    """
    from vigilog.functions.mail import verdict

    engines = F.least(F.coalesce("engines", F.lit(0)) * 5, F.lit(50))
    signature = F.when((F.col("kind") == "attachment") & (F.coalesce("signature_hits", F.lit(0)) > 0), 60).otherwise(0)
    sandbox = F.when(F.col("kind") == "attachment", F.greatest((F.coalesce("sandbox_score", F.lit(0.0)) * 10).cast("int"), F.lit(0))).otherwise(0)
    scored = items.withColumn("_add", engines + signature + sandbox)
    found = scored.groupBy(message).agg(F.sum("_add").alias("final_score"), F.count_if(F.col("_add") > 0).alias("n_reasons"))
    return found.withColumn("recommended_action", verdict(F.col("final_score")))


def rollup_summary(scored: DataFrame, user: str = "user") -> DataFrame:
    """Windows, anomalies, mean and maximal score of each user, and of all under a null user."""
    found = scored.rollup(user).agg(F.count("*").alias("windows"), F.count_if(F.col("is_anomaly")).alias("anomalies"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("max_score"))
    return found.withColumn("rate", F.round(F.col("anomalies") / F.col("windows"), 4))
