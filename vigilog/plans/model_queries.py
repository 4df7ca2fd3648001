"""Queries of models; SQL can't fit them, so their tests check orders and ranges, and the rules over their verdicts have SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions import common
from vigilog.models import forest, one_class, supervised
from vigilog.operators import flows, joins, rolling, sessions
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.aggregate_queries import ueba
from vigilog.plans.function_queries import _FEATURES, requests_with_features
from vigilog.plans.join_queries import _SESSION
from vigilog.plans.registry import query
from vigilog.sources.storage import computed_once
from vigilog.plans.window_queries import web_sessions

_FLOW = ["byte_ratio", "packet_ratio", "bytes_per_packet", "connection_intensity", "byte_rate", "log_bytes", "log_packets"]


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows.flow_ratio_features(adapter(spark, sf_dir, "flows"))
    return df.drop("score").withColumn("score", forest.score_column(forest.fit(df, _FLOW, n_trees=100, id_cols=("flow_id",))))


@query()
def m1_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_flows(spark, sf_dir).select("flow_id", "score")


@query()
def m2_per_user_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = rolling.chronological_split(ueba(spark, sf_dir))
    return forest.per_user_baseline(windows, "user", "window_us", ["total_events", "total_read_operations", "failed_logon_count", "new_process_count", "off_hour_activity_ratio", "distinct_files_accessed"], n_trees=50)


@query()
def m3_tail_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the percentile reads its rows several times: the forest scores them once
    scored = computed_once(scored_flows(spark, sf_dir).select("flow_id", "score"))
    return forest.flag_tail(scored, forest.tail_threshold(scored))


_BEHAVIOUR = ["total_requests", "req_per_min", "error_404_rate", "error_50x_rate", "post_rate", "unique_path_ratio", "static_asset_ratio", "avg_payload_bytes"]


_SESSION_ID = ("source_ip", "session_seq")


@query(f"""{cte("flows")}, t AS (SELECT quantile_cont(score, 0.02) AS threshold FROM flows) SELECT flow_id, CASE WHEN score < threshold THEN -1 ELSE 1 END AS y_pred FROM flows, t""")
def m3_tail_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of a column of scores."""
    scored = adapter(spark, sf_dir, "flows").select("flow_id", "score")
    return forest.flag_tail(scored, forest.tail_threshold(scored)).select("flow_id", "y_pred")


@query()
def m4_statistical_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sessions.session_features(web_sessions(spark, sf_dir), _SESSION)
    scored = df.withColumn("forest", forest.score_column(forest.fit(df, _BEHAVIOUR, id_cols=_SESSION_ID))).withColumn("one_class", one_class.score_column(one_class.fit(df, _BEHAVIOUR, id_cols=_SESSION_ID)))
    return one_class.ensemble_score(scored, scored).select("source_ip", "session_seq", "statistical_threat_score")


def _labelled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_with_features(spark, sf_dir).withColumn("label", (F.col("body") != "").cast("int"))


#: Folds of the request detector: no row is scored by a model that has seen it.
_FOLDS = 5


@query()
def m7_two_stage_http_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, each scored by the model that was trained on the other folds."""
    df = computed_once(_labelled_requests(spark, sf_dir).select("page_id", *_FEATURES, "label", F.pmod(F.xxhash64("page_id"), F.lit(_FOLDS)).alias("fold")))
    scored = []
    for fold in range(_FOLDS):
        first, model = supervised.fit_two_stage(df.filter(F.col("fold") != fold), _FEATURES, n_trees=60, depth=12, forest_trees=50, id_cols=("page_id",))
        scored.append(supervised.score_two_stage(df.filter(F.col("fold") == fold), first, model).select("page_id", "label", "score"))
    return reduce(DataFrame.union, scored)


@query()
def m8_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised.feature_importance(spark, *supervised.fit_two_stage(_labelled_requests(spark, sf_dir), _FEATURES, n_trees=60, depth=12, forest_trees=50, id_cols=("page_id",)))


_TERMS = r"""worded AS (SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+'), lambda w: length(w) >= 2) AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM worded) GROUP BY ALL)"""


@query(f"""WITH {_TERMS}, train AS (SELECT doc_id, toxic AS y FROM labels SEMI JOIN documents USING (doc_id)),
size AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS pos FROM train),
vocabulary AS (SELECT term, ln((1 + any_value(n)) / (count(*) + 1)) + 1 AS idf FROM tf JOIN train USING (doc_id), size GROUP BY term),
unit AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS x FROM tf JOIN vocabulary USING (term)),
sums AS (SELECT term, coalesce(sum(x) FILTER (y = 1), 0) AS s1, coalesce(sum(x) FILTER (y <> 1), 0) AS s0 FROM unit JOIN train USING (doc_id) GROUP BY term),
shares AS (SELECT term, ln((s0 + 1) / (sum(s0) OVER () + count(*) OVER ())) - ln((s1 + 1) / (sum(s1) OVER () + count(*) OVER ())) AS odds FROM sums),
scored AS (SELECT doc_id, sum(x * odds) AS odds FROM unit JOIN shares USING (term) GROUP BY doc_id),
found AS (SELECT d.doc_id, CASE WHEN length(text) >= 10 THEN round(100 / (1 + exp(coalesce(odds, 0) + ln((n - pos) / pos))), 2) END AS phishing_percent FROM documents d LEFT JOIN scored USING (doc_id), size)
SELECT doc_id, phishing_percent, coalesce(phishing_percent >= 60, false) AS is_suspicious FROM found""")
def m9_phishing_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    return supervised.score_phishing(docs, supervised.fit_phishing(train)).select("doc_id", "phishing_percent", "is_suspicious")


@query(f"""{cte("auth")}, k AS (SELECT DISTINCT "user" FROM auth WHERE us < 1704200000000000 AND "user" IS NOT NULL)
SELECT event_id, CASE WHEN (auth."user" IS NOT NULL AND k."user" IS NULL) OR (auth."user" = 'root' AND (hour(ts) >= 22 OR hour(ts) <= 5)) THEN -1 ELSE CASE WHEN event_id % 9 = 0 THEN -1 ELSE 1 END END AS final_verdict
FROM auth LEFT JOIN k ON auth."user" = k."user" """)
def m10_apply_hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "auth").withColumn("verdict", F.when(F.col("event_id") % 9 == 0, -1).otherwise(1))
    marked = joins.flag_unknown_users(df, joins.known_users(df.filter("us < 1704200000000000")))
    ruled = supervised.apply_hard_rules(marked, "verdict", F.col("unknown_user"), F.coalesce(F.col("user") == "root", F.lit(False)), common.is_off_hours(F.col("ts"), "mail"))
    return ruled.select("event_id", "final_verdict")


@query()
def m11_warm_up_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rolling.session_risk(rolling.cumulative_distinct_users(rolling.rolling_velocity(adapter(spark, sf_dir, "auth"), seconds=3600)))
    df = df.withColumn("hour", F.hour("ts"))
    return supervised.warm_up_anomaly(df, ["velocity", "unique_users", "session_risk_score", "hour"]).select("event_id", "score", "is_anomaly")


@query()
def s13_model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest written as a table, read again and used: its scores are those of the forest itself."""
    from vigilog.sources.storage import shared_path

    df, path = flows.flow_ratio_features(adapter(spark, sf_dir, "flows")), shared_path(spark, "forest")
    forest.save(forest.fit_table(df, _FLOW, n_trees=20, id_cols=("flow_id",)), path)
    return df.drop("score").withColumn("score", forest.score_column(forest.load(spark, path, _FLOW))).select("flow_id", "score")
