"""Audit of how the sources of each language differ in their terms. Terms travel as digests; text is joined back for what is reported."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import Tables, cut

LEAST_DOCS = 30
TOP = 50
PRIOR = 5
SCALE = 1_000_000_000
#: Terms a task counts before it hands its counts on.
HELD_TERMS = 1 << 19
#: Rows in which they leave it.
ROWS = 1 << 16
#: Frequent digests up to which they are broadcast.
MOST_TERMS = 1 << 18
#: Bytes of a text whose words are taken at once.
PIECE = 1 << 20
#: Sources in a block, and terms in a slice, on average: a group of the pairwise comparison has two blocks and one slice.
BLOCK_SOURCES, SLICE_TERMS = 256, 4096

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_LOWER = bytes(range(256)).lower()


def _pieces(text: bytes) -> Iterator[bytes]:
    begin = 0
    while begin < len(text):
        gap = _GAP.search(text, begin + PIECE)
        end = gap.end() if gap else len(text)
        yield text[begin:end]
        begin = end


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences n of each term in a source, and, where source is null, its documents n_docs.

    Each task gives a row or more for each term that it has met; the rows of a term add up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict = defaultdict(Counter)
        documents: dict = defaultdict(Counter)
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in [*places.items(), *(((x, None), n) for x, n in documents.items())]:
                counts = pa.array(list(n.values()), pa.int64())
                none = pa.nulls(len(n), pa.int64())
                own = pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), pa.array(list(n), pa.binary())
                found = pa.RecordBatch.from_arrays([*own, *((none, counts) if source is None else (counts, none))], names=["lang", "source", "term", "n", "n_docs"])
                yield from (found.slice(k, ROWS) for k in range(0, len(n), ROWS))
            places.clear()
            documents.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, own = places[lang, source], set()
                before = len(n)
                for piece in _pieces(text):
                    words = _TERM.findall(piece.translate(_LOWER))
                    n.update(words)
                    own.update(words)
                documents[lang].update(own)
                held += len(n) - before
                if held >= HELD_TERMS:
                    yield from packed()
                    held = 0
        yield from packed()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term binary, n long, n_docs long").withColumn("term", F.col("term").cast("string"))


def _kept_terms(counted: DataFrame, digest: Callable[[str], Column], tables: Tables, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Terms in least_docs documents or more of their language: (lang, digest, nth, term) and (lang, source, digest, nth, n).

    Only digests are shuffled to find them and to count them by source. The smallest and largest text of each digest that
    is frequent tells whether two terms share it: such terms are counted again by their text, and numbered within the
    digest. The frequent digests are broadcast up to MOST_TERMS of them.
    """
    key = ["lang", "digest"]
    partial = counted.select("lang", "source", digest("term").alias("digest"), F.when(F.col("source").isNull(), F.col("term")).alias("term"), "n", "n_docs")
    partial = tables.keep(partial)
    of_lang, of_source = partial.filter("source is null"), partial.filter("source is not null")
    often = tables.keep(of_lang.groupBy(*key).agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= least_docs).select(*key))
    few = F.broadcast(often) if often.count() <= MOST_TERMS else often
    texts = of_lang.select(*key, "term").join(few, key, "left_semi").groupBy(*key).agg(F.min("term").alias("term"), F.max("term").alias("last"))
    texts = tables.keep(texts.withColumn("nth", F.lit(0)))
    counts = tables.keep(of_source.select("lang", "source", "digest", "n").join(few, key, "left_semi").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n")).withColumn("nth", F.lit(0)))
    shared = texts.filter("term < last").select(*key)
    if not shared.take(1):
        return texts.drop("last"), counts
    split = tables.keep(counted.withColumn("digest", digest("term")).join(shared, key, "left_semi"))
    apart = split.filter("source is null").groupBy(*key, "term").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= least_docs)
    apart = tables.keep(apart.select(*key, "term", F.row_number().over(Window.partitionBy(*key).orderBy("term")).alias("nth")))
    split = split.filter("source is not null").join(apart, [*key, "term"]).groupBy("lang", "source", "digest", "nth").agg(F.sum("n").alias("n"))
    return texts.filter("term = last").drop("last").unionByName(apart), counts.join(shared, key, "left_anti").unionByName(split)


def _share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) of integers, exactly."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    whole = ((n + PRIOR).cast("decimal(38,0)") * F.lit(SCALE)).cast("decimal(38,0)")
    return F.call_function("div", whole, (total + PRIOR * terms).cast("decimal(38,0)")) + 1


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences of shares over the terms of one slice, for the pairs of sources of two blocks (or of one)."""
    heads, rows = pdf[pdf["head"]].sort_values("no"), pdf[~pdf["head"]]
    no, block, least = heads["no"].to_numpy(), heads["block"].to_numpy(), heads["p"].to_numpy(np.int64)
    term = rows.groupby(["digest", "nth"], sort=False).ngroup().to_numpy()
    seen = int(term.max()) + 1 if len(term) else 0
    share = np.tile(least, (seen, 1))
    share[term, np.searchsorted(no, rows["no"].to_numpy())] = rows["p"].to_numpy(np.int64)
    right = np.flatnonzero(block == pdf["b"].iloc[0])
    out = []
    for g in np.flatnonzero(block == pdf["a"].iloc[0]).tolist():
        others = right[no[right] > no[g]]
        out.append(pd.DataFrame({"one": no[g], "other": no[others], "total": np.abs(share[:, others] - share[:, [g]]).sum(0)}))
    found = pd.concat(out, ignore_index=True)
    return found.assign(lang=pdf["lang"].iloc[0], seen=seen)[["lang", "one", "other", "total", "seen"]]


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): differences between each two sources of a language, summed over its terms.

    Sources are dealt to blocks and terms to slices, so that a group has a bounded number of both. Terms that
    neither block has add the difference of the shares of a count of 0.
    """
    own = groups.select("lang", "source", "no", "terms", "p0", F.ceil(F.count("*").over(Window.partitionBy("lang")) / BLOCK_SOURCES).alias("blocks"), F.ceil(F.col("terms") / SLICE_TERMS).alias("slices"))
    own = own.filter("terms > 0")
    slice_of = F.pmod(F.xxhash64("digest", "nth"), F.col("slices"))
    rows = shares.join(own, ["lang", "source"]).select("lang", "no", "blocks", "digest", "nth", "p", F.lit(False).alias("head"), slice_of.alias("slice"))
    heads = own.select("lang", "no", "blocks", F.lit(0).cast("bigint").alias("digest"), F.lit(0).alias("nth"), F.col("p0").alias("p"), F.lit(True).alias("head"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    dealt = rows.unionByName(heads).withColumn("block", F.floor(F.col("no") / BLOCK_SOURCES)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "slice", "no", "block", "digest", "nth", "p", "head")
    sums = dealt.groupBy("lang", "a", "b", "slice").applyInPandas(_compare, "lang string, one long, other long, total long, seen long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    left = groups.select("lang", "source", "no", "terms", "p0")
    right = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("no_2"), F.col("p0").alias("p0_2"))
    both = left.join(right, "lang").filter("no <> no_2").withColumn("one", F.least("no", "no_2")).withColumn("other", F.greatest("no", "no_2"))
    unseen = (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("p0") - F.col("p0_2"))
    value = F.when(F.col("terms") == 0, 0).otherwise(F.coalesce("total", F.lit(0)) + unseen)
    return both.join(sums, ["lang", "one", "other"], "left").select("lang", "source", "item", value.cast("bigint").alias("value"))


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP,
    digest: Callable[[str], Column] = F.xxhash64,
) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each (lang, source) of docs apart, in units of 1 / SCALE.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms in
    least_docs of its documents or more. A kept term's share in a group, or in the whole language, is
    1 + floor(SCALE * (count + PRIOR) / (all counts + PRIOR * kept terms)). Part "pair" has for every other source of the
    language the sum of the differences of all shares; part "term" the `top` terms that the group has and whose share is
    larger there than in the language, by difference. Ranks go by falling value, then by the item's bytes.

    Null text, lang and source are empty strings. Each row is a document, also one that repeats another. Groups without
    terms are reported too; other columns of docs play no part; an empty table gives an empty result. Rows of part
    "pair" grow with the square of a language's sources, which is what is asked for.
    """
    tables = Tables(docs.sparkSession, "divergence")
    texts, counts = map(tables.keep, _kept_terms(count_terms(docs, lang_col, source_col, text_col), digest, tables, least_docs))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(texts.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    of_lang = Window.partitionBy("lang")
    groups = groups.na.fill(0, ["total", "terms"]).withColumn("lang_total", F.sum("total").over(of_lang)).withColumn("no", F.row_number().over(of_lang.orderBy("source")).cast("bigint") - 1)
    zero = F.lit(0).cast("bigint")
    groups = tables.keep(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(zero, "total", "terms"))))
    own = counts.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    shares = own.select("lang", "source", "digest", "nth", "n", "terms", "lang_total", _share("n", "total", "terms").alias("p"))

    in_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    lang_n = counts.groupBy("lang", "digest", "nth").agg(F.sum("n").alias("lang_n"))
    terms = shares.join(lang_n, ["lang", "digest", "nth"]).withColumn("value", F.col("p") - _share("lang_n", "lang_total", "terms")).filter("value > 0")
    # ties of the last value are settled by the texts, which are joined for these rows only
    terms = terms.withColumn("r", F.rank().over(in_group)).filter(F.col("r") <= top).join(texts, ["lang", "digest", "nth"])
    terms = terms.withColumn("rank", F.row_number().over(in_group.orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = _pairs(shares.select("lang", "source", "digest", "nth", "p"), groups).withColumn("rank", F.row_number().over(in_group.orderBy(F.desc("value"), "item")))
    found = cut(terms.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")))
    tables.drop()
    return found
