"""Line deduplication, importance resampling and the divergence audit against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from tests.llm.test_edges import OWN, PROSE, ROWS, SCHEMA
from vigilog.llm import divergence, line_dedup, queries
from vigilog.llm.divergence import audit_sources
from vigilog.llm.line_dedup import drop_repeated_lines
from vigilog.llm.resampling import bucket_gains, grams, resample

BIG = (2**53 + 1, 2**53 + 3, 2**63 - 1)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def lines_of(texts, least_docs, least_chars):
    key = lambda x: low(x).strip("\t\n\x0b\x0c\r ")
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    gone = lambda x: len(key(x)) >= least_chars and docs[key(x)] >= least_docs
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if not gone(x)]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def odd_texts():
    rng = np.random.default_rng(3)
    pool = ["", " ", "Home", "home\r", "\tHOME ", "É", "é", " home", "a b", "x" * 3000, "Ünter", "ünter", "z\x0b", "#"]
    texts = ["\n".join(str(x) for x in rng.choice(pool, rng.integers(1, 9))) for _ in range(60)]
    return [*texts, None, "", "\n", "\n\n", texts[0], texts[0], "own line\n" * 5, "home\n" * 30_000 + "end", *[f"the same text\nof many copies\n{'' if i else 'x'}" for i in range(30)]]


@pytest.mark.parametrize(("most_lines", "most_bytes", "hot"), [(1 << 18, 16 << 20, 1000), (0, 0, 2), (0, 0, 1000)])
@pytest.mark.parametrize(("least_docs", "least_chars"), [(3, 1), (10, 2), (1, 0)])
def test_lines_as_brute_force(spark, monkeypatch, most_lines, most_bytes, hot, least_docs, least_chars):
    for name, value in (("MOST_LINES", most_lines), ("MOST_BYTES", most_bytes), ("HOT_LINES", hot)):
        monkeypatch.setattr(line_dedup, name, value)
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in drop_repeated_lines(rows, least_docs=least_docs, least_chars=least_chars).collect()}
    assert got == dict(enumerate(lines_of(texts, least_docs, least_chars)))


def test_lines_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    left = drop_repeated_lines(docs, least_docs=3)
    assert left.columns == [*docs.columns, "n_lines", "n_dropped"] and left.count() == len(ROWS)
    by = {r["doc_id"]: r for r in left.collect() if r["doc_id"]}
    # five rows hold the prose: documents are rows, also those that repeat an id or have none
    assert (by[2]["text"], by[2]["n_dropped"], by[2]["a b"]) == ("", 1, "x") and by[3]["text"] == PROSE + " tail"
    assert (by[4]["text"], by[4]["n_lines"]) == ("", 1) and (by[6]["text"], by[6]["n_dropped"]) == (" \n\t ", 0)
    none = spark.createDataFrame([], SCHEMA)
    assert drop_repeated_lines(none).count() == 0
    wide = spark.createDataFrame([(i, "a\nb", *(f"{c}-{i}" for c in (*OWN, "lines", "t1", "h1", "dropped", "n_lines"))) for i in range(4)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in (*OWN, "lines", "t1", "h1", "dropped", "n_lines")))
    for r in drop_repeated_lines(wide, least_docs=4).collect():
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("", 2, 2) and all(r[c] == f"{c}-{r['doc_id']}" for c in (*OWN, "lines", "t1", "h1", "dropped"))
    assert [r["text"] for r in drop_repeated_lines(wide.select("text"), least_docs=4).collect()] == [""] * 4


def features_of(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def drawn_as(docs, target, longest, buckets, percent, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    ours, theirs = (Counter(bucket(g) for t in texts for g in features_of(t, longest)[0]) for texts in ([t for _, t in docs], target))
    big_s, big_t = sum(ours.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (big_s + buckets) / ((ours[b] + 1) * (big_t + buckets))))
    rows = []
    for i, t in docs:
        found, n = features_of(t, longest)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 97, 35, 3), (3, 1000, 100, 0)])
def test_resampling_as_brute_force(spark, longest, buckets, percent, least):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "É", "é9", "_x_", "日本", "a-b", "Beta", "\x00z", "7"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(120)]
    docs = [*enumerate(texts), (200, None), (201, ""), *((i, texts[0]) for i in BIG), (None, texts[1]), (202, "beta " * 50_000)]
    target = [" ".join(rng.choice(words[:3], 30)) for _ in range(4)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=percent, least_words=least, columns=["doc_id"])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn_as(docs, target, longest, buckets, percent, least)


def test_no_run_of_words_crosses_texts():
    owner, crc, n = grams([b"a b", b"", b"c", b"d e f"], 3)
    found = sorted(zip(owner.tolist(), crc.tolist()))
    assert n.tolist() == [2, 0, 1, 3]
    assert found == sorted((i, zlib.crc32(g)) for i, gs in enumerate([[b"a", b"b", b"a b"], [], [b"c"], [b"d", b"e", b"f", b"d e", b"e f", b"d e f"]]) for g in gs)
    assert bucket_gains(np.array([0, 5]), np.array([0, 5])).tolist() == [0, 0]


def test_resampling_of_odd_rows(spark):
    docs, none = spark.createDataFrame(ROWS, SCHEMA).repartition(3), spark.createDataFrame([], SCHEMA)
    found = resample(docs, none, percent=50)
    assert found.count() == len(ROWS) and found.columns == [*(c for c in docs.columns if c != "score"), "n_features", "weight", "score", "rank"]
    ranked = [r["rank"] for r in found.collect() if r["rank"]]
    assert sorted(ranked) == [1, 2, 3, 4]  # half of nine, rounded down; rows that repeat an id follow each other
    assert resample(none, docs).count() == 0
    wide = spark.createDataFrame([(i, PROSE, *(f"{c}-{i}" for c in OWN)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in OWN))
    for r in resample(wide, docs).collect():
        assert r["text"] == PROSE and all(r[c] == f"{c}-{r['doc_id']}" for c in OWN if c != "score")


def audited(rows, least):
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(t))
    rows = [(lang or "", source or "", words(t)) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(w for r in own for w in set(r[2]))
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = {s: Counter(w for r in own if r[1] == s for w in r[2]) for s in {r[1] for r in own}}
        total = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, w) - share(d, w)) for w in kept)) for o, d in counts.items() if o != s]
            terms = [(w, share(c, w) - share(total, w)) for w in kept if c[w] and share(c, w) > share(total, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("digests", "block", "terms", "held", "most"), [(None, 256, 4096, 1 << 19, 1 << 18), (7, 2, 3, 5, 0), (1, 3, 4096, 1, 1 << 18)])
def test_audit_as_brute_force(spark, monkeypatch, digests, block, terms, held, most):
    """Also with digests that terms share, blocks of few sources, slices of few terms, tasks that hold few terms, and nothing broadcast."""
    for name, value in (("BLOCK_SOURCES", block), ("SLICE_TERMS", terms), ("HELD_TERMS", held), ("MOST_TERMS", most)):
        monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(5)
    words = [*(f"term{c}" for c in "abcdefghijklmnop"), "É", "é", "日本", "TermA", "a1b", "x'y"]
    rows = [(["en", "de", None][rng.integers(3)], ["s1", "s2", "s3", "s4", "s5", None][rng.integers(6)], " ".join(rng.choice(words[: 4 + 3 * int(rng.integers(6))], rng.integers(0, 30)))) for _ in range(150)]
    rows += [("xx", "lonely", "few words"), ("yy", "a", None), ("yy", "b", ""), ("en", "s9", None), ("en", "s8", "terma " * 400_000), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(4)
    digest = F.xxhash64 if digests is None else lambda c: F.pmod(F.xxhash64(c), F.lit(digests))
    got = audit_sources(docs, least_docs=30, digest=digest).collect()
    assert sorted(tuple(r) for r in got) == audited(rows, 30)


def test_audit_of_odd_rows(spark):
    docs, none = spark.createDataFrame(ROWS, SCHEMA).repartition(3), spark.createDataFrame([], SCHEMA)
    assert audit_sources(none).count() == 0
    assert sorted(tuple(r) for r in audit_sources(docs, least_docs=2).collect()) == audited([(r[2], r[3], r[1]) for r in ROWS], 2)
    assert {r["value"] for r in audit_sources(docs, least_docs=99).collect()} == {0}


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_resample", "op13_source_divergence"])
def test_queries_as_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), duck.execute(queries.ORACLE[name]).df())
