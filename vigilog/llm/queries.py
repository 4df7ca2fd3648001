"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.common import cut, drop_path, read, shared_path
from vigilog.llm.divergence import audit_sources
from vigilog.llm.exact_dedup import mark_exact_duplicates
from vigilog.llm.licenses import scan_licenses
from vigilog.llm.line_dedup import drop_repeated_lines
from vigilog.llm.minhash import near_duplicates
from vigilog.llm.mixing import mix_sources
from vigilog.llm.paragraph_dedup import remove_passages
from vigilog.llm.pu_classifier import classify, held_out, train
from vigilog.llm.quality_rules import judge_quality
from vigilog.llm.resampling import resample
from vigilog.llm.sentencepiece_fst import encode_pieces
from vigilog.llm.suffix_dedup import remove_repeats
from vigilog.llm.token_store import read_token_shards, shared_encoder, write_token_shards

ORACLE: dict[str, str] = {}


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE["op1_minhash"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN lowest ON doc_id = x"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, vocabulary = shared_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    write_token_shards(read(spark, sf_dir, "documents"), path, lambda: shared_encoder(vocabulary))
    found = cut(read_token_shards(spark, path))
    drop_path(spark, path)
    return found


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.select("doc_id", "n_pieces", "n_fallback", F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), "round_trip")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return mark_exact_duplicates(docs, columns=["doc_id", "text_sha256"], sha_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op8_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w,
         sum(source_size) OVER () AS everything
  FROM sources),
levels AS (
  SELECT *, row_number() OVER by_ratio AS nth,
         (everything - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lvl
  FROM weighed
  WINDOW by_ratio AS (ORDER BY source_size / w, source IS NULL, source),
         before AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(lvl, nth) AS lvl FROM levels WHERE lvl * w <= 3 * source_size),
targets AS (
  SELECT source, source_size, least(coalesce(chosen.lvl * w, CAST('inf' AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target
  FROM levels, chosen),
summed AS (
  SELECT doc_id, size, source_size, target, least(floor(target / source_size), 3) AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(coalesce(whole + CASE WHEN upto - size / 2 <= target - source_size * whole AND target - source_size * whole > 0 AND whole < 3
                                  THEN 1 ELSE 0 END, 0) * size AS BIGINT) AS taken
FROM summed"""


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_passages(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_paragraphs", "n_removed_words", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op11_line_dedup"] = r"""
WITH flat AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM flat),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (often.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.key = often.key GROUP BY doc_id"""

def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read(spark, sf_dir, "benchmark"), columns=["doc_id"])


ORACLE["op12_resample"] = r"""
WITH table_of AS (
  SELECT list(list_reduce([k] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) AS crcs
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k)),
worded AS (
  SELECT doc_id, true AS ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
flat AS (SELECT doc_id, ours, unnest(w) AS word FROM worded),
coded AS (
  SELECT word, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, strlen(word) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)),
                                           lambda c, b: xor(c // 256, crcs[1 + xor(c % 256, b)]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM flat), table_of),
counts AS (
  SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM flat JOIN coded USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM counts) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS gain
  FROM counts),
weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM flat JOIN coded USING (word) JOIN gains USING (bucket) WHERE ours GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed ON d.doc_id = weighed.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS fit
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked"""

def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
flat AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM flat GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM flat JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (coalesce(s.total, 0) + 5 * z.v) AS p,
         1 + (1000000000 * (CAST(k.n AS HUGEINT) + 5)) // (z.total + 5 * z.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN size z ON g.lang = z.lang
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_pu_classifier": op4_pu_classifier,
    "op5_token_shards": op5_token_shards,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_resample": op12_resample,
    "op13_source_divergence": op13_source_divergence,
}
