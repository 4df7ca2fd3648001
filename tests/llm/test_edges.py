"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import same
from vigilog.llm import minhash, queries, suffix_dedup
from vigilog.llm.exact_dedup import drop_exact_duplicates, mark_exact_duplicates
from vigilog.llm.licenses import scan_licenses
from vigilog.llm.minhash import near_duplicates
from vigilog.llm.mixing import mix_sources
from vigilog.llm.paragraph_dedup import remove_passages
from vigilog.llm.pu_classifier import Model, SIZE, classify, held_out, train
from vigilog.llm.quality_rules import judge_quality
from vigilog.llm.sentencepiece_fst import encode_pieces
from vigilog.llm.suffix_dedup import remove_repeats
from vigilog.llm.token_store import CachedEncoder, find_token, read_token_shards, write_token_shards

PROSE = " ".join(f"word{i * 7919 % 1009}" for i in range(120))
OTHER = " ".join(f"term{i * 104729 % 2003}" for i in range(130))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, `a b` string"
ROWS = [
    (1, PROSE, "en", "a", 1, 0.5, True, "x"), (2, PROSE, "en", "b", 1, 0.5, True, "x"), (2, PROSE, "en", "b", 1, 0.5, True, "x"),
    (3, PROSE + " tail", None, None, None, None, None, None), (4, None, None, None, None, None, None, None), (5, "", "en", "a", 0, 0.1, False, ""),
    (6, " \n\t ", "en", "c", 4, 0.1, False, ""), (7, OTHER, "en", "c", 1, 0.5, True, "x"), (8, "wörd ☃ 😀 – " * 30, "de", "d", 1, 0.5, True, "x"), (9, (OTHER + "\n") * 40, "en", "d", 1, 0.5, True, "x"),
    (None, PROSE, "en", "a", 1, 0.5, True, "x"), (None, OTHER + " more", "en", "a", 1, 0.5, True, "x"), (10, "two words", "en", "a", 1, 0.5, True, "x"), (11, "Two WORDS", "en", "a", 1, 0.5, True, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def frame(docs):
    return docs.select("doc_id", "text", "source").toPandas()


def test_near_duplicates_as_sql(docs, nothing):
    known = docs.filter("doc_id is not null").distinct()
    duck = duckdb.connect()
    duck.register("documents", frame(known))
    same(near_duplicates(known).distinct(), duck.execute(queries.ORACLE["op1_minhash"]).df())
    assert near_duplicates(docs).count() == len(ROWS)
    loose = near_duplicates(docs).filter("doc_id is null").collect()
    assert {r["component_id"] for r in loose} == {1, None} and not any(r["kept"] for r in loose)
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_of_one_hot_group_as_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(146)) for t in texts]
    low = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(low))


def test_licenses(spark, docs, nothing):
    found = [r for r in scan_licenses(docs).collect() if r["doc_id"] in (4, 5)]
    assert [tuple(r)[1:8] for r in found] == [(0, 0, None, None, "", "", 0.0)] * 2
    assert scan_licenses(docs).count() == len(ROWS) and scan_licenses(nothing).count() == 0
    text = "CC-BY cc by. All rights reserved\nSPDX-License-Identifier: (MIT OR GPL-3.0-only WITH Classpath-exception-2.0) AND Apache-2.0 says more\nGNU General Public License\nSPDX-License-Identifier: AND MIT"
    got = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_base"], got["first_word"], got["last_word"]) == (4, 0, 28)
    assert got["base_labels"] == "cc-by,gpl,reserved" and set(got["labels"].split(",")) >= {"mit", "apache", "gpl", "with-classpath-exception-2.0"}
    assert got["n_tags"] == 2 and got["n_invalid"] == 1 and got["score"] == 0.1


def test_license_places_as_brute_force(spark):
    import random
    import re

    rng = random.Random(1)
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "É", "x9", "-", "\n", "CC"]
    texts = [" ".join(rng.choice(parts) for _ in range(60)) for _ in range(60)]
    got = table(scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = [k for k in range(len(words)) for p in ("cc by", "general public license", "all rights reserved") if words[k : k + len(p.split())] == p.split()]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))


def test_quality_measures_as_brute_force(docs, nothing):
    from collections import Counter

    assert judge_quality(nothing).count() == 0
    got = judge_quality(docs).collect()
    assert len(got) == len(ROWS)
    by_text = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for doc_id, text, *_ in ROWS:
        if doc_id is None:
            continue
        t = text or ""
        words = t.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = by_text[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_classifier(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = train(docs, labels)
    scored = classify(docs, model)
    assert scored.count() == len(ROWS) and scored.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert classify(nothing, model).count() == 0
    untrained = train(nothing, labels.limit(0))
    assert isinstance(untrained, Model) and len(untrained.weights) == SIZE and untrained.prior == 0.5
    import zlib

    assert {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out().alias("h")).collect() if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in ROWS if i}


def test_tokens_come_back(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    write_token_shards(docs, f"file://{tmp_path}/t", lambda: CachedEncoder(path), shard_tokens=300)
    got = read_token_shards(spark, f"file://{tmp_path}/t").toPandas().sort_values("start", ignore_index=True)
    assert len(got) == len(ROWS) and got["doc_id"].isna().sum() == 2 and got["doc_id"].iloc[2:].is_monotonic_increasing
    assert (got["start"].to_numpy() == np.r_[0, np.cumsum(got["n_tokens"])[:-1]]).all()
    plain = Tokenizer.from_file(path)
    import zlib

    for doc_id, text, *_ in ROWS:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids.tobytes()) in set(got.loc[got["doc_id"].isna() if doc_id is None else got["doc_id"] == doc_id, "ids_crc32"])
    from collections import Counter

    token = Counter(plain.encode(OTHER, add_special_tokens=False).ids).most_common(1)[0][0]
    places = Counter((r["doc_id"], r["place"]) for r in find_token(spark, f"file://{tmp_path}/t", token).collect())
    assert places == Counter((doc_id, k) for doc_id, text, *_ in ROWS for k, x in enumerate(plain.encode(text or "", add_special_tokens=False).ids) if x == token)
    write_token_shards(nothing, f"file://{tmp_path}/n", lambda: CachedEncoder(path))
    assert read_token_shards(spark, f"file://{tmp_path}/n").count() == 0


def test_sentencepiece(docs, nothing):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = encode_pieces(docs, model).toPandas()
    assert len(got) == len(ROWS) and got["round_trip"].all() and encode_pieces(nothing, model).count() == 0
    texts = {r[0]: r[1] or "" for r in ROWS if r[0]}
    for doc_id, ids in zip(got["doc_id"], got["ids"]):
        if not pd.isna(doc_id) and texts[doc_id].strip():
            assert library.decode([int(x) for x in ids]) == texts[doc_id]


def test_exact_duplicates(docs, nothing):
    known = docs.filter("doc_id is not null")
    duck = duckdb.connect()
    duck.register("documents", frame(known))
    got = mark_exact_duplicates(known.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)), columns=["doc_id", "text_sha256"])
    same(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), duck.execute(queries.ORACLE["op7_exact_dedup"]).df())
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == left.select(F.coalesce("text", F.lit(""))).distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert drop_exact_duplicates(nothing).count() == 0 and mark_exact_duplicates(nothing).count() == 0


def test_mixing_as_sql(docs, nothing):
    known = docs.filter("doc_id is not null").distinct()
    duck = duckdb.connect()
    duck.register("documents", frame(known))
    got = mix_sources(known, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
    same(got, duck.execute(queries.ORACLE["op8_mix_sources"]).df())
    whole = mix_sources(docs)
    assert whole.count() == len(ROWS) and mix_sources(nothing).count() == 0
    same(whole, mix_sources(docs.repartition(7)).toPandas())


def _passages(texts: dict[int, str]) -> dict[int, int]:
    """Removed words of each text, from all pairs of paragraphs and all windows of 50 words."""
    import re

    lines = [(i, m.start(), m.group()) for i in sorted(texts) for m in re.finditer("[^\n]+", texts[i]) if len(m.group().split()) >= 20]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.lower().split() for _, _, x in lines)]
    low = list(range(len(lines)))
    for _ in lines:
        before = list(low)
        for x in range(len(lines)):
            for y in range(x):
                if low[x] != low[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    low[x] = low[y] = min(low[x], low[y])
        if low == before:
            break
    gone = {i: set() for i in texts}
    for k, (i, at, line) in enumerate(lines):
        if low[k] != k:
            gone[i] |= {at + m.start() for m in re.finditer(r"\S+", line)}
    owner: dict[tuple, set[int]] = {}
    windows = [(i, [m.start() for m in re.finditer(r"\S+", texts[i])], texts[i].lower().split()) for i in sorted(texts)]
    for i, _, words in windows:
        for k in range(len(words) - 49):
            owner.setdefault(tuple(words[k : k + 50]), set()).add(i)
    seen = set()
    for i, at, words in windows:
        for k in range(len(words) - 49):
            w = tuple(words[k : k + 50])
            if len(owner[w]) > 1 and w in seen:
                gone[i] |= set(at[k : k + 50])
            seen.add(w)
    return {i: len(x) for i, x in gone.items()}


def test_passages_as_brute_force(spark, docs, nothing):
    assert remove_passages(nothing).count() == 0 and remove_passages(docs).count() == len(ROWS)
    rng = np.random.default_rng(3)
    prose = lambda n: [f"w{rng.integers(1 << 40)}" for _ in range(n)]
    passages = [prose(n) for n in (49, 50, 51, 120)]
    paragraphs = [prose(n) for n in (19, 20, 40)]
    texts = {}
    for i in range(60):
        parts: list[str] = []
        for _ in range(3):
            parts += prose(int(rng.integers(3, 30)))
            chosen = list(passages[int(rng.integers(4))]) if rng.integers(2) else [*paragraphs[int(rng.integers(3))], "\n"]
            if rng.integers(3) == 0:
                chosen[int(rng.integers(len(chosen) - 1))] = f"X{i}"
            parts += ["\n", *chosen] if chosen[-1] == "\n" else chosen
        width = int(rng.integers(9, 60))
        texts[i] = " ".join(parts) if i % 2 else "\n".join(" ".join(parts[k : k + width]) for k in range(0, len(parts), width)).replace("\n \n", "\n")
    texts |= {100: "", 101: texts[3], 102: texts[3].upper(), 103: " ".join(passages[3] * 900), 104: "y" * 2_000_000 + " " + " ".join(passages[1])}
    got = table(remove_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)))
    assert {i: r["n_removed_words"] for i, r in got.items()} == _passages(texts)
    for i, r in got.items():
        left, at = b"", 0
        for b, e in r["spans"]:
            left, at = left + texts[i].encode()[at:b], e
        assert r["kept"].encode() == left + texts[i].encode()[at:]


def _removed(texts: dict[int, str]) -> dict[int, tuple]:
    seen: dict[bytes, int] = {}
    out = {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        own = {raw[p : p + 50] for p in range(len(raw) - 49)}
        for p in range(len(raw) - 49):
            if raw[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        for w in own:
            seen.setdefault(w, i)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 20, 1])
def test_repeats_as_brute_force(spark, docs, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PLACES", hot)  # grams of so many places go on window by window
    assert remove_repeats(nothing).count() == 0 and remove_repeats(docs).count() == len(ROWS)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abé \n"), n))
    passages = [word(n) for n in (49, 50, 51, 90, 200)]
    texts = {i: "".join(x for _ in range(4) for x in (word(int(rng.integers(0, 60))), passages[int(rng.integers(0, 5))])) for i in range(60)}
    stock = "this phrase is in many of the texts: "
    texts |= {100: "a" * 300, 101: "a" * 300, 102: "", 103: texts[3]} | {200 + i: word(30) + stock + word(i % 7 + 10) + stock for i in range(60)} | {300: (passages[4] + "\n") * 6000}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    assert got == _removed(texts)


def test_stages_keep_the_columns(spark, docs, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns, name
            assert (out.count() == 0) == (rows is nothing), name
    assert corpus_pipeline.encode(spark, docs, "").count() == len(ROWS)


OWN = ("score", "predicted", "kept", "size", "target", "taken", "epochs", "keep_id", "group_size", "source_size", "_sha", "_prefix", "_length", "_key", "_source", "_id", "_s", "_rows", "row", "id", "key", "sha", "length", "prefix", "component_id", "node", "document", "epoch", "own", "range")


def test_values_of_clashing_columns_stay(spark, tmp_path):
    """Every stage and operator leaves the document's own columns as they are, whatever their names are."""
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, f"{PROSE} {i % 3}" if i < 6 else OTHER, "en", f"s{i % 2}", i, *(f"{c}-{i}" for c in OWN)) for i in range(1, 9)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        found = out.collect()
        # two labels of one text are too few for the classifier to keep anything by: its scores are looked at below
        assert (found or name == "quality classifier") and all(tuple(r) == rows[r["doc_id"] - 1] for r in found), name
    scored = classify(wide, train(wide.select("doc_id", "text"), spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()
    assert len(scored) == len(rows) and all(r[c] == f"{c}-{r['doc_id']}" for r in scored for c in OWN if c not in ("score", "predicted"))
    ours = {"keep_id", "group_size", "kept"}
    for r in mark_exact_duplicates(wide).collect():
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in OWN if c not in ours)
    ours = {"size", "source_size", "target", "epochs", "taken"}
    for r in mix_sources(wide).collect():
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in OWN if c not in ours)
    assert near_duplicates(wide).count() == remove_repeats(wide).count() == remove_passages(wide).count() == judge_quality(wide).count() == scan_licenses(wide).count() == len(rows)


LARGE = (2**53 + 1, 2**53 + 3, 2**63 - 1)


def test_large_ids_beside_null(spark, tmp_path):
    """Ids beyond 2 ** 53 in one partition with a null id come back as they are, and links and removals by them hold."""
    texts = [PROSE, PROSE + " more", OTHER]
    docs = spark.createDataFrame([*zip(LARGE, texts), (None, OTHER + " none")], "doc_id long, text string").coalesce(1)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    expected = sorted([*LARGE, None], key=str)
    path = public_tokenizers.path("byte_bpe_50k.json")
    write_token_shards(docs, f"file://{tmp_path}/t", lambda: CachedEncoder(path))
    for found in (near_duplicates(docs), scan_licenses(docs), judge_quality(docs), read_token_shards(spark, f"file://{tmp_path}/t"), encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")), remove_passages(docs), remove_repeats(docs), mark_exact_duplicates(docs), mix_sources(docs.withColumn("source", F.lit("s")))):
        assert ids(found) == expected
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect() if r["doc_id"]} == {LARGE[0]: LARGE[0], LARGE[1]: LARGE[0], LARGE[2]: LARGE[2]}
    assert table(remove_repeats(docs))[LARGE[1]]["n_removed"] == len(PROSE) and ids(corpus_pipeline.near(spark, docs, "")) == sorted([LARGE[0], LARGE[2], None], key=str)


def test_rows_that_share_an_id_are_linked_apart(spark):
    """Each text of a repeated id has its own links, however the rows are dealt out."""
    texts = [(5, PROSE), (5, OTHER), (2, OTHER + " tail"), (7, PROSE + " end"), (5, PROSE), (9, "seven words that nothing else in here has"), (2, "six words of quite another kind")]
    expected = sorted([(5, 5), (5, 2), (2, 2), (7, 5), (5, 5), (9, 9), (2, 2)])
    for n in (1, 3, 7):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(n)
        assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()) == expected
    left = corpus_pipeline.near(spark, docs.distinct(), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted({t for t in texts if t not in [(5, OTHER), (7, PROSE + " end")]})


@pytest.mark.parametrize("passes", [1, 3])
def test_repeats_are_found_in_turns_that_each_move_a_part_of_the_strings(spark, monkeypatch, passes):
    """Strings of all turns together are those of one, no turn has all of them, and rows don't depend on the turns."""
    rng = np.random.default_rng(3)
    shared = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(6)]
    texts = [f"{'x' * i} {shared[i % 6]} own {i * 7919} {shared[(i + i // 6) % 6][:120]}" for i in range(24)]
    stretches = suffix_dedup._stretches
    pdf = pd.DataFrame({"id": range(24), "text": texts, "places": [list(range(len(t))) for t in texts]})
    whole = sum(len(x[1]) for x in stretches(pdf))
    parts = [sum(len(x[1]) for x in stretches(pdf, turn, 3)) for turn in range(3)]
    assert sum(parts) == whole and max(parts) < 0.7 * whole
    monkeypatch.setattr(suffix_dedup, "PASSES", passes)
    found = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    starts = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            starts.setdefault(t[k : k + 50], i)
    for i, t in enumerate(texts):
        gone = {p for k in range(len(t) - 49) if starts[t[k : k + 50]] < i for p in range(k, k + 50)}
        assert found[i] == (len(gone), "".join(c for p, c in enumerate(t) if p not in gone).encode())


def test_a_bucket_of_some_hundreds_is_one_block(spark, monkeypatch):
    """Rows that go to blocks, for a bucket of 400 nodes of which 300 are one component: each goes once, and all links are found."""
    sent, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *by: (sent.append(df.count()) if by == ("key", "i", "j") else None, repartition(df, *by))[1])
    texts = [(i, " ".join(f"w{i // 2 if i >= 300 else 0}x{k}" for k in range(40))) for i in range(400)]
    docs = spark.createDataFrame(texts, "node long, text string")
    facts = minhash.cut(minhash.sign(docs, "node", "text", minhash.Banding()).withColumnRenamed("id", "node").join(docs, "node"))
    members = facts.select(F.lit(1).cast("bigint").alias("key"), "node", "n")
    labels = docs.filter("node < 300").select("node", F.lit(0).cast("bigint").alias("component"))
    info = facts.select("node", "n", "sketch", F.array(F.lit(1).cast("bigint")).alias("bands"))
    found = minhash._across(members, labels, info, docs, minhash.Banding(), True).collect()
    assert sent == [400]
    assert {(r["a"], r["b"]) for r in found if r["sure"]} == {(i, i + 1) for i in range(300, 400, 2)}
