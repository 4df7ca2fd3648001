"""Queries of joins and of the Markov model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.models import markov
from vigilog.operators import joins, topk
from vigilog.plans.adapters import adapter, cte
from vigilog.plans.registry import query
from vigilog.plans.window_queries import _STEPS, web_sessions, web_transitions

_SESSION = ["source_ip", "session_seq"]
_A = "SELECT source_ip || '_' || CAST(session_seq AS STRING) AS session_id, source_ip AS parent_tracking_id, CAST(count(*) AS DOUBLE) AS statistical_threat_score FROM sess WHERE session_seq % 3 <> 1 GROUP BY ALL"
_B = "SELECT source_ip || '_' || CAST(session_seq AS STRING) AS session_id, source_ip AS parent_tracking_id, CAST(max(event_id % 101) AS DOUBLE) AS markov_threat_score FROM sess WHERE session_seq % 3 <> 2 GROUP BY ALL"
_SCORES = f"{_STEPS}, a AS ({_A}), b AS ({_B})"


def _id():
    return F.concat_ws("_", "source_ip", F.col("session_seq").cast("string")).alias("session_id")


def statistical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_sessions(spark, sf_dir).filter("session_seq % 3 <> 1").groupBy(_id(), F.col("source_ip").alias("parent_tracking_id")).agg(F.count("*").cast("double").alias("statistical_threat_score"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_sessions(spark, sf_dir).filter("session_seq % 3 <> 2").groupBy(_id(), F.col("source_ip").alias("parent_tracking_id")).agg(F.max(F.col("event_id") % 101).cast("double").alias("markov_threat_score"))


@query(f"{_SCORES} SELECT * FROM a JOIN b USING (session_id, parent_tracking_id)")
def j1_merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge_scores(statistical(spark, sf_dir), sequence(spark, sf_dir))


@query(f"{_SCORES} SELECT a.*, b.markov_threat_score FROM a LEFT JOIN b USING (session_id)")
def j2_attach_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.attach_features(statistical(spark, sf_dir), sequence(spark, sf_dir).drop("parent_tracking_id"))


@query(f"{_STEPS} SELECT event_id, count(*) OVER w AS session_events, max(us) OVER w - min(us) OVER w AS session_us FROM sess WINDOW w AS (PARTITION BY source_ip, session_seq)")
def j3_attach_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = web_sessions(spark, sf_dir).withColumn("s", F.concat_ws("_", "source_ip", F.col("session_seq").cast("string")))
    found = joins.attach_session_stats(df, "s", session_events=F.count("*"), lo=F.min("us"), hi=F.max("us"))
    return found.select("event_id", "session_events", (F.col("hi") - F.col("lo")).alias("session_us"))


_LABELS = "SELECT 'h' || CAST(doc_id % 5 AS STRING) AS host, doc_id * 7 AS event_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'odd' END AS label FROM labels"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("'h' || CAST(doc_id % 5 AS STRING) AS host", "doc_id * 7 AS event_id", "CASE WHEN toxic = 1 THEN 'toxic' ELSE 'odd' END AS label")


@query(f"{cte('web')} SELECT event_id, host, label FROM web LEFT JOIN ({_LABELS}) USING (host, event_id)")
def j4_label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.label_events(adapter(spark, sf_dir, "web"), _labels(spark, sf_dir), ["host", "event_id"]).select("event_id", "host", "label")


@query(f"""{_STEPS}, e AS (SELECT source_ip, session_seq, label FROM sess LEFT JOIN ({_LABELS}) USING (host, event_id))
SELECT source_ip || '_' || CAST(session_seq AS STRING) AS session_id, bool_or(label IS NOT NULL) AS is_attack FROM e GROUP BY ALL""")
def j5_label_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = web_sessions(spark, sf_dir).withColumn("session_id", _id())
    labelled = joins.label_events(df, _labels(spark, sf_dir), ["host", "event_id"])
    return joins.label_sessions(df.select("session_id").distinct(), labelled, "session_id")


@query(f"""{cte("auth")}, k AS (SELECT DISTINCT "user" FROM auth WHERE us < 1704400000000000 AND "user" IN ('u1', 'u2', 'u3', 'u4', 'root'))
SELECT event_id, auth."user" IS NOT NULL AND k."user" IS NULL AND auth."user" <> 'u5' AS unknown_user FROM auth LEFT JOIN k ON auth."user" = k."user" """)
def j6_flag_unknown_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "auth")
    known = joins.known_users(df.filter("us < 1704400000000000 and user in ('u1', 'u2', 'u3', 'u4', 'root')"))
    return joins.flag_unknown_users(df, known, ignore=("u5",)).select("event_id", "unknown_user")


@query(f"""{cte("mail")} SELECT event_id, "user", coalesce(rip, last_value(rip IGNORE NULLS) OVER (PARTITION BY "user" ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) AS rip FROM mail""")
def j7_fill_logout_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fill_logout_ip(adapter(spark, sf_dir, "mail"), columns=("rip",)).select("event_id", "user", "rip")


_MASKED = "CASE WHEN event_source = 'apache_error' THEN NULL ELSE source_ip END"


@query(f"""{cte("web")}, m AS (SELECT event_id, host, us, {_MASKED} AS source_ip FROM web), s AS (SELECT host, us, event_id AS eid, source_ip FROM m WHERE source_ip IS NOT NULL),
k AS (SELECT host, us * 16777216 + eid AS k, us, source_ip FROM s)
SELECT m.event_id, CASE WHEN m.source_ip IS NOT NULL THEN m.source_ip WHEN m.us - k.us <= 600000000 THEN k.source_ip END AS source_ip, m.source_ip IS NULL AND k.us IS NOT NULL AND m.us - k.us <= 600000000 AS attributed
FROM m ASOF LEFT JOIN k ON m.host = k.host AND m.us * 16777216 + m.event_id >= k.k""".replace("us * 16777216 + eid", "CAST(us AS HUGEINT) * 16777216 + eid").replace("m.us * 16777216", "CAST(m.us AS HUGEINT) * 16777216"))
def j8_attribute_errors_to_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "web").withColumn("source_ip", F.expr(_MASKED))
    return joins.attribute_errors(df, seconds=600).select("event_id", "source_ip", "attributed")


_RANGES = "SELECT 3405803776 + n_nationkey * 3 AS start_ip, 3405803776 + n_nationkey * 3 + 1 AS end_ip, n_name AS country FROM nation"


@query(f"""{cte("web")}, g AS ({_RANGES}), n AS (SELECT event_id, source_ip, 3405803776 + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS n FROM web)
SELECT event_id, CASE WHEN source_ip LIKE '10.%' THEN 'LOCAL' ELSE coalesce(country, 'UNKNOWN') END AS geo_country, CASE WHEN source_ip LIKE '10.%' THEN 0 ELSE 1 END AS is_external
FROM n LEFT JOIN g ON source_ip NOT LIKE '10.%' AND n BETWEEN start_ip AND end_ip""")
def j9_enrich_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("3405803776 + n_nationkey * 3 AS start_ip", "3405803776 + n_nationkey * 3 + 1 AS end_ip", "n_name AS country")
    return joins.enrich_geo(adapter(spark, sf_dir, "web"), ranges).select("event_id", "geo_country", "is_external")


_SEGMENT = """WITH t AS (SELECT c_mktsegment AS geo_country, count(*) / sum(count(*)) OVER () AS frequency FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1)"""


@query(f"{_SEGMENT} SELECT c_custkey, round(coalesce(frequency, 0.0001), 9) AS frequency FROM customer LEFT JOIN t ON c_mktsegment = geo_country")
def j10_country_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_mktsegment", "geo_country")
    frequencies = joins.country_frequency(df.filter("c_custkey % 3 = 0 and geo_country <> 'BUILDING'"))
    return joins.apply_country_frequency(df, frequencies).select("c_custkey", F.round("frequency", 9).alias("frequency"))


@query("""WITH i AS (SELECT md5(text) AS v, max(doc_id % 13) AS engines FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT doc_id, coalesce(engines, 0) AS engines FROM documents LEFT JOIN i ON md5(text) = v""")
def j11_enrich_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("hash"))
    indicators = df.filter("doc_id % 3 = 0").select(F.lit("hash").alias("kind"), F.col("hash").alias("value"), (F.col("doc_id") % 13).alias("engines"))
    return joins.enrich_reputation(df, indicators, "hash", "hash").select("doc_id", "engines")


_MODEL = f"""{_STEPS}, capped AS (SELECT state, next, least(count(*), 5) AS n FROM trans GROUP BY source_ip, session_seq, state, next),
model AS (SELECT state, next, CAST(sum(n) AS BIGINT) AS n FROM capped GROUP BY ALL), totals AS (SELECT state, sum(n) AS total, count(*) OVER () AS states FROM model GROUP BY state),
probs AS (SELECT trans.*, (model.n + 1) / (total + states) AS p, row_number() OVER (PARTITION BY source_ip, session_seq ORDER BY us, event_id) AS i FROM trans JOIN model USING (state, next) JOIN totals USING (state))"""


@query(f"{_MODEL} SELECT * FROM model")
def m5_markov_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.train(web_transitions(spark, sf_dir), _SESSION)


@query(f"{_MODEL} SELECT event_id, round(p, 9) AS p FROM probs")
def j12_lookup_transition_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = web_transitions(spark, sf_dir)
    return markov.lookup(steps, markov.train(steps, _SESSION)).select("event_id", F.round("p", 9).alias("p"))


_RAW = f"""{_MODEL}, raw AS (SELECT source_ip, session_seq, abs(avg(ln(p))) + CASE WHEN count(*) FILTER (next_state = 'CLIENT_ERR') + count(*) FILTER (i = 1 AND state = 'CLIENT_ERR') > 10
  THEN count(*) FILTER (state = 'CLIENT_ERR' AND next_state = 'CLIENT_ERR') / (count(*) + 1) * 50 ELSE 0 END AS raw_score FROM probs GROUP BY ALL),
alls AS (SELECT DISTINCT source_ip, session_seq FROM sess), scored AS (SELECT source_ip, session_seq, coalesce(raw_score, 0) AS raw_score FROM alls LEFT JOIN raw USING (source_ip, session_seq)),
ends AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM scored WHERE raw_score > 0)"""


def markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, steps = web_sessions(spark, sf_dir), web_transitions(spark, sf_dir)
    return markov.normalise(markov.raw_scores(events, steps, markov.train(steps, _SESSION), _SESSION, ["us", "event_id"]))


@query(f"{_RAW} SELECT source_ip, session_seq, round(raw_score, 6) AS raw_score, round(least(greatest((raw_score - lo) * 100 / (hi - lo), 0), 100), 1) AS markov_threat_score FROM scored, ends")
def m6_markov_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = markov_scores(spark, sf_dir)
    ends = scores.filter("raw_score > 0").agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))
    exact = F.round(F.least(F.greatest((F.col("raw_score") - F.col("lo")) * 100 / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(100.0)), 1)
    return scores.crossJoin(F.broadcast(ends)).select("source_ip", "session_seq", F.round("raw_score", 6).alias("raw_score"), exact.alias("markov_threat_score"))


@query(f"{_SCORES} SELECT a.* FROM a WHERE parent_tracking_id IN (SELECT parent_tracking_id FROM b WHERE markov_threat_score >= 99)")
def j13_keep_reported_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = sequence(spark, sf_dir).filter("markov_threat_score >= 99").withColumnRenamed("parent_tracking_id", "incident_tracking_id")
    return joins.keep_reported(statistical(spark, sf_dir), incidents)


@query(f"""{cte("mail", "auth")} SELECT event_id, action, "user", rip, NULL AS reason, program FROM auth UNION ALL SELECT event_id, action, "user", rip, reason, NULL FROM mail""")
def u1_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adapter(spark, sf_dir, "auth").select("event_id", "action", "user", "rip", "program")
    return topk.union_sources(a, adapter(spark, sf_dir, "mail").select("event_id", "action", "user", "rip", "reason"))


@query(f"{cte('auth')} SELECT DISTINCT \"user\" FROM auth WHERE \"user\" IS NOT NULL")
def u2_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.known_users(adapter(spark, sf_dir, "auth"))


@query(f"""{cte("scored")}, a AS (SELECT DISTINCT payload FROM scored WHERE detector_a), b AS (SELECT DISTINCT payload FROM scored WHERE detector_b)
SELECT coalesce(a.payload, b.payload) AS payload, CASE WHEN b.payload IS NULL THEN 'a only' WHEN a.payload IS NULL THEN 'b only' ELSE 'both' END AS found_by FROM a FULL JOIN b ON a.payload = b.payload""")
def u3_both_and_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapter(spark, sf_dir, "scored")
    return topk.both_and_only(df.filter("detector_a"), df.filter("detector_b"), "payload")


@query(f"{_STEPS} SELECT source_ip, session_seq, count(*) AS events FROM sess GROUP BY ALL")
def t4_rank_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = web_sessions(spark, sf_dir).groupBy(*_SESSION).agg(F.count("*").alias("events"))
    return topk.rank_sessions(counted, "events", *_SESSION)


