"""A Markov model of navigation: transition counts as tables, scores by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def train(transitions: DataFrame, session: list[str], cap: int = 5, previous: DataFrame | None = None) -> DataFrame:
    """(state, next, n): how often next follows state, each session counting for `cap` at most; added to previous counts if given."""
    capped = transitions.groupBy(*session, "state", "next").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    counts = capped.select("state", "next", "n")
    if previous is not None:
        counts = counts.unionByName(previous.select("state", "next", "n"))
    return counts.groupBy("state", "next").agg(F.sum("n").alias("n"))


def lookup(transitions: DataFrame, model: DataFrame) -> DataFrame:
    """transitions with p: (n + 1) / (total of the state + states), 0.00001 for a state never seen. The model has at most states squared times three rows."""
    totals = model.groupBy("state").agg(F.sum("n").alias("_total")).withColumn("_states", F.count("*").over(Window.partitionBy()))
    found = transitions.join(F.broadcast(model.withColumnRenamed("n", "_n")), ["state", "next"], "left").join(F.broadcast(totals), "state", "left")
    return found.withColumn("p", F.when(F.col("_total").isNull(), 0.00001).otherwise((F.coalesce("_n", F.lit(0)) + 1) / (F.col("_total") + F.col("_states")))).drop("_n", "_total", "_states")


def raw_scores(sessions: DataFrame, transitions: DataFrame, model: DataFrame, session: list[str], order: list[str], loop_state: str = "CLIENT_ERR", loop_over: int = 10) -> DataFrame:
    """Per session the raw score (mean negative log probability, and a penalty for loops of errors) and a summary of its first five states.

    Sessions of one event score 0 and are TOO_SHORT.
    """
    steps = lookup(transitions, model).withColumn("_i", F.row_number().over(Window.partitionBy(*session).orderBy(*order)))
    scored = steps.groupBy(*session).agg(
        F.abs(F.avg(F.log("p"))).alias("_lp"),
        F.count_if((F.col("state") == loop_state) & (F.col("next_state") == loop_state)).alias("_loops"),
        (F.count_if(F.col("next_state") == loop_state) + F.count_if((F.col("_i") == 1) & (F.col("state") == loop_state))).alias("_errors"),
        (F.count("*") + 1).alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("_i") <= 4, F.struct("_i", "state", "next_state")))).alias("_head"),
    )
    penalty = F.when(F.col("_errors") > loop_over, F.col("_loops") / F.col("_n") * 50).otherwise(0.0)
    head = F.array_distinct(F.concat(F.array(F.get("_head", 0)["state"]), F.transform("_head", lambda x: x["next_state"])))
    scored = scored.select(*session, (F.col("_lp") + penalty).alias("raw_score"), F.array_join(head, " -> ").alias("sequence_summary"))
    return sessions.select(*session).distinct().join(scored, session, "left").withColumns({"raw_score": F.coalesce("raw_score", F.lit(0.0)), "sequence_summary": F.coalesce("sequence_summary", F.lit("TOO_SHORT"))})


def normalise(scores: DataFrame, train_scores: DataFrame | None = None) -> DataFrame:
    """scores with markov_threat_score: raw scores from the range of positive training scores to 0..100, clipped."""
    ends = (scores if train_scores is None else train_scores).filter("raw_score > 0").agg(F.min("raw_score").alias("_lo"), F.max("raw_score").alias("_hi"))
    scaled = F.coalesce(F.try_divide((F.col("raw_score") - F.col("_lo")) * 100, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return scores.crossJoin(F.broadcast(ends)).withColumn("markov_threat_score", F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)), 2)).drop("_lo", "_hi")
