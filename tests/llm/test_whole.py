"""Places where an operator did less than its whole job."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from vigilog.llm.minhash import near_duplicates
from vigilog.llm.token_store import CachedEncoder


def test_links_of_short_texts_at_the_least_similarity(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        # 15, 18 or 48 of 20, 24 or 64 shingles
        n = (20, 24, 64)[k % 3]
        words = [f"w{rng.getrandbits(40)}" for _ in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 3 * n // 4 + 4]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i in range(800)}


def test_added_tokens_are_encoded_as_in_whole_texts():
    coder = CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain<|endoftext|>words", "x\ny <|endoftext|>", "a <|endoftext> b", "it's plain"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert next(coder.encode(texts[:1])).dtype == np.uint32


def test_classifier_on_documents_it_has_not_seen():
    """Held-out labels of the given documents: ranking, verdicts and the estimated prior."""
    import zlib

    import pyarrow.parquet as pq

    from vigilog.llm.common import encoded
    from vigilog.llm.pu_classifier import PREDICT_AT, features, fit

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas().drop_duplicates("doc_id").set_index("doc_id")["quality"]
    label = docs["doc_id"].map(labels)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs["doc_id"]])
    row = lambda which: features(encoded(docs["text"][which])).astype(np.float16)
    model = fit(row(~held & (label == 1)), row(np.flatnonzero(~held)[::2]))
    share = (label[~held] == 1).sum() / label[~held].notna().sum()
    assert abs(model.prior - share) < 0.04
    seen = held & label.notna()
    score, good = model.score(row(seen)), label[seen].to_numpy() == 1
    assert np.subtract.outer(score[good], score[~good]).__gt__(0).mean() > 0.97 and ((score >= PREDICT_AT) == good).mean() > 0.95


def test_the_pipeline_from_end_to_end(spark, tmp_path):
    """Three small corpora: no two documents of the result are the same or near, every kept text is encoded whole, sources are near their targets."""
    import corpus_pipeline
    import sentencepiece
    from vigilog.llm.mixing import mix_sources

    decoder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for seed in range(3):
        rng = np.random.default_rng(seed)
        prose = lambda n: " ".join(f"{w} said." if k % 9 == 8 else w for k, w in enumerate(rng.choice([f"word{x}" for x in "abcdefghijklmnopqrstuvwxyz"], n)))
        base = [prose(int(rng.integers(60, 200))) for _ in range(40)]
        texts = base + base[:10] + [f"{t} tail" for t in base[10:15]] + [None, ""]
        folder = tmp_path / str(seed)
        docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        distinct = {r["doc_id"] for r in found}
        kept = [texts[i] or "" for i in distinct]
        assert len(set(kept)) == len(kept) and not {texts[i] for i in range(10, 15) if i in distinct} & {texts[i - 40][: -len(" tail")] for i in distinct if 50 <= i < 55}
        for r in found:
            assert decoder.decode([int(x) for x in r["ids"]]) == (texts[r["doc_id"]] or "") and r["n_pieces"] == len(r["ids"])
        left = docs.filter(docs["doc_id"].isin([*distinct]))
        assert found and left.count() == len(distinct) and mix_sources(left).count() == len(distinct)


def test_quality_verdicts_are_no_worse_than_the_rules(spark):
    """Labelled texts of two tables that pass the base rules: no more errors than where no rule may accuse, and the same verdict for frequent votes."""
    from pyspark.sql import functions as F

    from vigilog.llm.quality_rules import judge_quality

    verdicts: list[dict] = []
    for sf in ("sf0.01", "sf0.1"):
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("label"))
        judged = judge_quality(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).filter("not base_failed").cache()
        found = judged.join(labels.filter("label is not null"), "doc_id").withColumn("plain", ~F.col("votes").contains("-1"))
        wrong = lambda c: F.count_if(F.col(c).cast("int") != F.col("label"))  # noqa: B023, E731
        errors = found.agg(F.count("*"), wrong("kept"), wrong("plain")).first()
        assert errors[0] > 300 and errors[1] <= errors[2]
        often = judged.groupBy("votes").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")).filter("n >= 5").collect()
        verdicts.append({r["votes"]: r["kept"] for r in often})
    both = verdicts[0].keys() & verdicts[1].keys()
    assert len(both) >= 6 and all(verdicts[0][v] == verdicts[1][v] for v in both)
