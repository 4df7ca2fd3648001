"""Removal of repeated passages: MinHash banding of paragraphs, and of every window of words for passages inside paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import SHINGLE_WORDS, Tables, Words, beside, chunks, cut, encoded, mix, shingles, whole_groups
from vigilog.llm.minhash import Banding, band_keys, components_of, odd_sketches, shingle_sets
from vigilog.llm.suffix_dedup import gather_spans, meet_marks, merged_spans, pack_marks, packed, portions, range_bits, spans_by_document, unpacked, window_marks

#: A paragraph is a line with so many words or more.
MIN_WORDS = 20
#: Words of a passage that is removed wherever it is repeated.
WINDOW_WORDS = 50
#: At a similarity of 0.75, 16 bands of 3 samples miss (1 - 0.75 ** 3) ** 16 = 2 pairs in 10,000.
BANDING = Banding(bands=16, rows=3, bins=512, sketch_bits=1024)
#: Spans that a task gathers before it hands them on by document.
SPANS_AT_ONCE = 1 << 20


class Passages:
    """Paragraphs and marked windows of some texts, A-Z in lower case: places are bytes within a text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words = words = Words(texts)
        n = len(words.begin)
        self.rolling = shingles(words.hash) if n >= SHINGLE_WORDS else np.zeros(0, np.uint64)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        self.at = words.text_at[self.text_of] if n else words.begin

    def paragraphs(self) -> tuple[np.ndarray, ...]:
        """First word, end word, text, first byte and last byte of each paragraph."""
        w = self.words
        n = len(w.begin)
        line = np.cumsum(w.bytes == 10)[w.begin] if n else np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if n else np.zeros(0, np.int64)
        end = np.r_[first[1:], n] if n else first
        keep = end - first >= MIN_WORDS
        first, end = first[keep], end[keep]
        return first, end, self.text_of[first], w.begin[first] - self.at[first], w.end[end - 1] - self.at[first]

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each mark, and the mark: the smallest shingle hash of a window is its one MinHash sample.

        Neighbouring windows share it, so that there is a row for some 23 windows.
        """
        w = self.words
        last = w.first[1:][self.text_of] if len(self.text_of) else self.text_of
        begin = np.flatnonzero(np.arange(len(last)) + WINDOW_WORDS <= last)
        return window_marks(self.rolling, WINDOW_WORDS - SHINGLE_WORDS + 1, begin)

    def window_hashes(self, begin: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        for k in range(0, WINDOW_WORDS, SHINGLE_WORDS):
            out = mix(out ^ self.rolling[begin + k])
        return out

    def nodes(self, first: np.ndarray, end: np.ndarray) -> list[int]:
        """A 64-bit digest of the words of each paragraph."""
        raw, w = b"".join(t + b"\n" for t in self.texts), self.words
        return [int.from_bytes(hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=8).digest(), "little", signed=True) for a, b in zip(w.begin[first].tolist(), w.end[end - 1].tolist())]


def _runs(count: np.ndarray) -> np.ndarray:
    """0 .. count - 1 of each, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _scan(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (id, begin, end, node) of paragraphs, with n and bands where a batch has a node first; rows (range, data) of marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = [t.lower() for t in encoded(pdf["text"])], pdf["id"].to_numpy(np.int64)
            seen: set[int] = set()
            marked: list[tuple] = []
            for part in chunks(texts):
                own = Passages(texts[part])
                first, end, text, b, e = own.paragraphs()
                if len(first):
                    node = own.nodes(first, end)
                    new = np.array([x not in seen and not seen.add(x) for x in node])
                    size = (end - first - SHINGLE_WORDS + 1)[new]
                    bands = np.full(len(node), None, object)
                    if len(size):
                        flat = own.rolling[np.repeat(first[new], size) + _runs(size)]
                        for k, keys in zip(np.flatnonzero(new), band_keys(flat, np.cumsum(size) - size, BANDING)):
                            bands[k] = keys
                    n = pd.array(end - first - SHINGLE_WORDS + 1, "Int64")
                    yield pd.DataFrame({"id": pd.array(ids[part][text], "Int64"), "begin": b, "end": e, "node": node, "n": n, "bands": bands, "range": None, "data": None})
                _, _, mark = own.marks()
                marked.append((own.rolling[mark], ids[part][own.text_of[mark]], own.words.begin[mark] - own.at[mark]))
            if sum(len(x[0]) for x in marked):
                found = pack_marks(*(np.concatenate(x) for x in zip(*marked)), bits)
                yield pd.DataFrame({"id": None, "begin": None, "end": None, "node": None, "n": None, "bands": None, "range": found["range"], "data": found["data"]})

    return docs.mapInPandas(run, "id long, begin int, end int, node long, n long, bands array<long>, range long, data binary")


def _look(docs: DataFrame, bits: int) -> DataFrame:
    """Of documents with the paragraphs (lines) and marks (places) that are asked for: rows (node, n, sketch, text) of the
    paragraphs, and rows (range, data) of the windows of those marks, as spans where the batch has the window before (sure)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = dict.fromkeys(("node", "n", "sketch", "text", "range", "data", "sure"))
        for pdf in batches:
            whole, ids = encoded(pdf["text"]), pdf["id"].to_numpy(np.int64)
            rows = [(x["node"], whole[i][x["begin"] : x["end"]]) for i, lines in enumerate(pdf["lines"]) if lines is not None for x in lines]
            for part in chunks([x for _, x in rows]):
                own = [x for _, x in rows[part]]
                sets = shingle_sets([x.lower() for x in own])
                yield pd.DataFrame(nothing | {"node": [k for k, _ in rows[part]], "n": pd.array([len(x) for x in sets], "Int64"), "sketch": list(odd_sketches(sets, BANDING)[0]), "text": [x.decode("utf-8", "surrogatepass") for x in own]})
            windows: list[tuple] = []
            for part in chunks(whole):
                own = Passages([t.lower() for t in whole[part]])
                first, last, mark = own.marks()
                wanted = np.zeros(len(own.words.bytes), bool)
                for at, found in zip(own.words.text_at, pdf["places"].iloc[part]):
                    if found is not None:
                        place = np.asarray(found, np.int64) + at
                        wanted[place[place < len(wanted)]] = True
                keep = wanted[own.words.begin[mark]]
                count = (last - first + 1)[keep]
                begin = np.repeat(first[keep], count) + _runs(count)
                windows.append((own.window_hashes(begin), ids[part][own.text_of[begin]], own.words.begin[begin] - own.at[begin], own.words.end[begin + WINDOW_WORDS - 1] - own.at[begin]))
            if not sum(len(x[0]) for x in windows):
                continue
            h, doc, b, e = (np.concatenate(x) for x in zip(*windows))
            order = np.lexsort((b, doc, h))
            h, doc, b, e = (x[order] for x in (h, doc, b, e))
            lead = np.r_[True, h[1:] != h[:-1]]
            for sure, found in ((True, spans_by_document(doc[~lead], b[~lead], e[~lead], bits)), (False, packed(h[lead], [doc[lead], b[lead].astype(np.int32), e[lead].astype(np.int32)], bits))):
                yield pd.DataFrame(nothing | {"range": found["range"], "data": found["data"], "sure": sure})

    return docs.mapInPandas(run, "node long, n long, sketch array<long>, text string, range long, data binary, sure boolean")


def _repeated_windows(windows: DataFrame, bits: int) -> DataFrame:
    """Rows of spans_by_document of all windows but the first of equal ones, by document and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in portions(whole_groups(batches, ["range"])):
            h, doc, b, e, _ = unpacked(pdf["data"], ["i8", "i4", "i4"])
            order = np.lexsort((b, doc, h))
            h, doc, b, e = (x[order] for x in (h, doc, b, e))
            later = np.r_[False, h[1:] == h[:-1]]
            held.append((doc[later], b[later], e[later]))
            if sum(len(x[0]) for x in held) >= SPANS_AT_ONCE:
                yield spans_by_document(*(np.concatenate(x) for x in zip(*held)), bits)
                held = []
        if held:
            yield spans_by_document(*(np.concatenate(x) for x in zip(*held)), bits)

    return windows.repartition("range").sortWithinPartitions("range").mapInPandas(run, "range long, data binary")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_paragraphs (lines of MIN_WORDS words or more), n_removed_words, spans, kept (text).

    Paragraphs whose 5-word shingle sets have a similarity of 0.75 or more (candidates by MinHash bands,
    confirmed on the full sets) form components, in each of which the first place, by id and position,
    stays and all others are removed. Passages inside paragraphs, and over the ends of lines, are windows of
    WINDOW_WORDS words: windows that agree in their MinHash sample with one of another document are compared by the
    hash of their words, and all but the first of equal ones are removed; so every passage of so many words or
    more that another document has stays once. A-Z count as lower case. spans are the removed bytes (begin, end) of
    the UTF-8 text; kept is what is left, with the white space around it. Paragraphs and windows are
    named by 64-bit hashes of their words.

    Null texts are empty. Rows with a null id lose nothing and no other row loses by them. Rows that
    share an id are one document whose equal places stay alike. Ids must be integers. An empty table
    gives an empty result; other columns of docs play no part.
    """
    tables = Tables(docs.sparkSession, "passages")
    keep = tables.keep
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = own.filter("id is not null")
    bits = range_bits(docs.count())
    scanned = keep(_scan(known, bits))
    lines = scanned.filter("node is not null").select("id", "begin", "end", "node")
    first = keep(lines.groupBy("node").agg(F.min(F.struct("id", "begin", "end")).alias("first"), F.count("*").alias("places")))
    places = meet_marks(scanned.filter("range is not null").select("range", "data")).filter("id is not null").groupBy("id").agg(F.collect_list("place").alias("places"))
    looked: list[DataFrame] = []

    def describe(found: DataFrame) -> DataFrame:
        of_line = first.join(found, "node").groupBy("first.id").agg(F.collect_list(F.struct("first.begin", "first.end", "node")).alias("lines"))
        looked.append(keep(_look(known.join(of_line.join(places, "id", "full"), "id"), bits)))
        return looked[0].filter("node is not null").select("node", "n", "sketch", "text")

    labels = components_of(scanned.filter("bands is not null").select("node", "n", "bands"), describe, BANDING)
    labelled = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = labelled.groupBy("component").agg(F.min("first").alias("lead"), F.sum("places").alias("places")).filter("places > 1")
    of_node = keep(beside(labelled.select("node", "component"), "component", "node", lead.select("component", "lead")).select("node", F.col("lead.id").alias("lead_id"), F.col("lead.begin").alias("lead_begin")))
    gone = beside(lines, "node", "id", of_node).filter("id != lead_id or begin != lead_begin").select("id", "begin", "end")

    def to_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield spans_by_document(*(pdf[c].to_numpy(kind) for c, kind in (("id", np.int64), ("begin", np.int32), ("end", np.int32))), bits)

    windows = looked[0].filter("range is not null")
    found = gone.mapInPandas(to_documents, "range long, data binary")
    found = found.union(windows.filter("sure").select("range", "data")).union(_repeated_windows(windows.filter("not sure").select("range", "data"), bits))
    spans = cut(gather_spans(keep(found)))
    tables.drop()

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, found in zip(encoded(pdf["text"]), pdf["found"]):
                merged = merged_spans(found, len(text))
                begin, end = [0, *(e for _, e in merged)], [*(b for b, _ in merged), len(text)]
                kept = b"".join(text[b:e] for b, e in zip(begin, end)).decode("utf-8", "replace")
                rows.append((sum(len(x.split()) >= MIN_WORDS for x in text.split(b"\n")), sum(len(text[b:e].split()) for b, e in merged), merged, kept))
            out = pd.DataFrame(rows, columns=["n_paragraphs", "n_removed_words", "spans", "kept"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    out = own.join(spans, "id", "left").withColumn("id", F.col("id").cast("string"))  # pandas would make numbers beside a null floats
    out = out.mapInPandas(remove, "id string, n_paragraphs long, n_removed_words long, spans array<array<long>>, kept string")
    return out.withColumn("id", F.col("id").cast("bigint")).withColumnRenamed("id", id_col)
