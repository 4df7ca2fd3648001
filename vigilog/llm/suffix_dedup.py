"""Removal of byte strings that an earlier document has, by sorted suffixes (deep-shallow)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Tables, chunks, cut, encoded, mix, span_hashes, whole_groups

#: Bytes of a string that counts as a repeat.
LENGTH = 50
#: Bytes of the grams of which the smallest hash marks each string.
GRAM = 16
_SPAN = LENGTH - GRAM + 1
#: Bytes to which suffixes are sorted before tries take over.
SHALLOW = 16
#: Suffixes that are sorted together, whole groups of them.
SORTED_AT_ONCE = 1 << 18
#: Documents for each range of hashes that moves as one, and the fewest ranges: a range stays as small at any size of the input,
#: and what a batch has for a range stays large enough to be packed.
RANGE_DOCS = 1024
LEAST_RANGE_BITS = 12
#: What moves by document is little beside marks and strings: so many bits less for its ranges.
FEWER_BITS = 2
#: Places whose grams are hashed and compared together, so that their arrays stay in a core's cache.
BLOCK = 1 << 14
#: Characters of texts whose strings are put together before they move.
MET_AT_ONCE = 12 << 20
#: A gram is hot if it marks so many places, and one in HOT_SHARE of all at least: so no more than HOT_SHARE grams are.
HOT_PLACES = 1 << 15
HOT_SHARE = 1 << 20
#: Parts of the marks, by hash, whose strings move and are sorted one part after the other, so that the disk holds those of one.
PASSES = 2
#: Spans that a task gathers before it hands them on by document.
SPANS_AT_ONCE = 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = np.uint64((1 << 32) - 1)
#: Odd numbers for hashes of 32 bits: one for each doubling of what is hashed.
_ODD = tuple(np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1))
_IN_BLOCK = np.arange(BLOCK, dtype=np.uint32)
#: Bytes beside a mark's gram of which each window has all on one side at least.
_HALF = (LENGTH - GRAM) // 2


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes that begin at each place, as a number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))).view(f"{order}u8").ravel()


def window_marks(hashes: np.ndarray, span: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mark of each window of `span` hashes that begins at one of the places begin: windows with one mark are from first to last.

    The mark is the smallest hash of the window, the leftmost of such. The first 32 bits decide, then the place:
    the same wherever the window is, in texts of any length.
    """
    if not len(begin):
        return begin, begin, begin
    low = hashes & ~_PLACE
    low |= np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    mark = (low[begin] & _PLACE).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
    return begin[edge], begin[np.r_[edge[1:], len(begin)] - 1], mark[edge]


def _least(data: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes in at most BLOCK + GRAM - 1 bytes: its smallest hash of a gram, of which the lower bits are the place."""
    h = data.astype(np.uint32)
    size = 1
    for odd in _ODD:  # of one byte, two, four, eight and GRAM bytes
        h = h[:-size] * odd + h[size:]
        h ^= h >> np.uint32(15)
        size *= 2
    h *= _ODD[0]
    h &= np.uint32(~(BLOCK - 1) & 0xFFFFFFFF)
    h |= _IN_BLOCK[: len(h)]
    size = 1
    while size * 2 <= _SPAN:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (_SPAN - size)], h[_SPAN - size :]) if size < _SPAN else h


def gram_hashes(data: bytes, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams at these places."""
    eight = np.ndarray((len(data),), "<u8", buffer=data + bytes(8), strides=(1,))
    h = eight[at] * _A
    h += eight[at + 8] * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    h *= _A
    return h


def marks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, hash, first place, last place and own place of each mark; places are in the joined texts.

    Every string of LENGTH bytes has one mark: the gram in it with the smallest hash, the leftmost of
    such. So equal strings have equal marks at equal distances, whatever surrounds them (winnowing;
    Schleimer and others, 2003). The strings of a mark begin at its first to its last place.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found: list[tuple] = []
    step = BLOCK - _SPAN + 1
    for at in range(0, len(data) - LENGTH, step):
        low = _least(data[at : at + step + LENGTH - 1])
        edge = np.flatnonzero(low[1:] != low[:-1])
        first = np.r_[0, edge + 1]
        found.append((first + at, np.r_[edge, len(low) - 1] + at, (low[first] & np.uint32(BLOCK - 1)).astype(np.int64) + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    first, last, own = (np.concatenate(x) for x in zip(*found))
    # a mark's strings may begin in two blocks
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    first, last, own = first[edge], last[np.r_[edge[1:], len(own)] - 1], own[edge]
    text = np.searchsorted(ends, own, side="right")
    first, last = np.maximum(first, (ends - [len(t) + 1 for t in texts])[text]), np.minimum(last, ends[text] - 1 - LENGTH)
    inside = first <= last
    text, first, last, own = (x[inside] for x in (text, first, last, own))
    return text, gram_hashes(joined, own), first, last, own


def packed(key: np.ndarray, columns: list[np.ndarray], bits: int, strings: list[bytes] | None = None, places: tuple[np.ndarray, np.ndarray] | None = None) -> pd.DataFrame:
    """(range, data): rows in the order of their key, a compressed block for each range of keys.

    With strings, rows are in that order already, the last column says how many places each has, and places has them.
    """
    if strings is None:
        order = np.argsort(key, kind="stable")
        key, columns = key[order], [c[order] for c in columns]
    of = (key >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    bounds = np.r_[edge, len(key)]
    # what a block takes of each array, as bytes: from where to where
    taken = [(c, bounds * c.itemsize) for c in (key, *columns)]
    held = text = np.zeros(len(bounds), np.int64)
    if strings is not None:
        sizes = np.fromiter(map(len, strings), np.uint16, len(strings))
        held, text = (np.cumsum(np.r_[0, x], dtype=np.int64)[bounds] for x in (columns[-1], sizes))
        taken += [(sizes, bounds * 2), (np.frombuffer(b"".join(strings), np.uint8), text), *((x, held * x.itemsize) for x in places)]
    heads = np.stack([np.diff(bounds), np.diff(held), np.diff(text)], axis=1).astype(np.uint32)
    parts = [(memoryview(np.ascontiguousarray(c)).cast("B") if c.size else b"", at.tolist()) for c, at in [(heads.ravel(), np.arange(len(bounds)) * 12), *taken]]
    pack = zstandard.ZstdCompressor(level=1).compress
    return pd.DataFrame({"range": of[edge], "data": [pack(b"".join([raw[at[i] : at[i + 1]] for raw, at in parts])) for i in range(len(edge))]})


def unpacked(blocks: pd.Series, kinds: list[str], with_strings: bool = False) -> tuple:
    """Key and columns of blocks, one after the other, and their strings as bytes and sizes, with the ids and numbers of their places."""
    kinds = ["u8", *kinds]
    widths = [np.dtype(kind).itemsize for kind in kinds]
    parts: list[list[bytes]] = [[] for _ in range(len(kinds) + 4)]
    unpack, head = zstandard.ZstdDecompressor().decompress, struct.Struct("<III").unpack_from
    for block in blocks:
        raw = unpack(block)
        n, held, text = head(raw)
        at = 12
        for part, size in zip(parts, [n * w for w in widths] + ([2 * n, text, 8 * held, 4 * held] if with_strings else [])):
            part.append(raw[at : at + size])
            at += size
    found = [b"".join(p) for p in parts]
    columns = [np.frombuffer(x, kind) for x, kind in zip(found, kinds)]
    sizes, strings, doc, first = found[len(kinds) :]
    return (*columns, (strings, np.frombuffer(sizes, np.uint16)), *((np.frombuffer(doc, np.int64), np.frombuffer(first, np.int32)) if with_strings else ()))


def portions(frames: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Frames of whole ranges with about `most` bytes of blocks, to be unpacked together."""
    for pdf in frames:
        ends = np.flatnonzero(np.r_[(pdf["range"].to_numpy()[1:] != pdf["range"].to_numpy()[:-1]), True]) + 1
        sizes = np.cumsum(pdf["data"].map(len).to_numpy())[ends - 1]
        begin = done = 0
        for i, (end, size) in enumerate(zip(ends, sizes)):
            if size - done >= most or i == len(ends) - 1:
                yield pdf.iloc[begin:end]
                begin, done = end, size


def split_marks(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Hash, document and place of the marks that a batch of documents shares within itself, and (hash, document, place, n) of what the others have to meet.

    Of marks that are known here to be shared, one row of place -1 with their number tells the others. So a mark's key
    gets a row a batch and not a row a document.
    """
    order = np.argsort(h)
    h, doc, place = h[order], doc[order], place[order]
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(np.r_[edge, len(h)])
    lo = np.minimum.reduceat(doc, edge)
    known = lo != np.maximum.reduceat(doc, edge)
    each = np.repeat(known, count)
    n = np.concatenate([np.ones(len(h) - each.sum(), np.int32), count[known].astype(np.int32)])
    place_or_none = np.concatenate([place[~each], np.full(known.sum(), -1, place.dtype)])
    return (h[each], doc[each], place[each]), (np.concatenate([h[~each], h[edge][known]]), np.concatenate([doc[~each], lo[known]]), place_or_none, n)


def met_marks(data: pd.Series, kind: str) -> tuple[np.ndarray, ...]:
    """Document and place of the marks in blocks of (document, place, n) that two documents have; then the hash of each mark and its number."""
    key, doc, place, n, _ = unpacked(data, ["i8", kind, "i4"])
    order = np.argsort(key)
    key, doc, place, n = key[order], doc[order], place[order], n[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[edge, len(key)])
    shared = (np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)) | (np.bitwise_or.reduceat(place == -1, edge))
    keep = (np.repeat(shared, count) & (place >= 0)) | (place < -1)
    return doc[keep], np.where(place < -1, -2 - place, place)[keep], key[edge], np.add.reduceat(n.astype(np.int64), edge)


def pack_marks(h: np.ndarray, doc: np.ndarray, place: np.ndarray, bits: int) -> pd.DataFrame:
    """(range, data) of the marks of a batch of documents, for meet_marks: what the batch shares goes on under a key of its own."""
    (h, known, at), (key, doc, place, n) = split_marks(h, doc, place)
    key = np.concatenate([mix(h ^ mix(known.view(np.uint64) + at.astype(np.uint64))), key])
    # places from -2 on are known to be shared; -1 tells the others, with the number of the batch's
    place, n = np.concatenate([-2 - at, place]), np.concatenate([np.zeros(len(at), np.int32), n])
    return packed(key, [np.concatenate([known, doc]), place.astype(np.int32), n], bits)


def meet_marks(marked: DataFrame) -> DataFrame:
    """(id, place, gram, n) from rows of pack_marks: id and place of every mark that is in another document too; mark and number of frequent ones."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(whole_groups(batches, ["range"])):
            doc, place, gram, total = met_marks(pdf["data"], "i4")
            yield pd.DataFrame({"id": pd.array(doc, "Int64"), "place": place, "gram": None, "n": None})
            hot = total >= HOT_PLACES
            yield pd.DataFrame({"id": None, "place": None, "gram": pd.array(gram[hot].view(np.int64), "Int64"), "n": total[hot]})

    return marked.repartition("range").sortWithinPartitions("range").mapInPandas(meet, "id long, place int, gram long, n long")


def _places_by_document(doc: np.ndarray, place: np.ndarray, bits: int) -> pd.DataFrame:
    """(range, data) of places of documents, for _gather_places."""
    return packed(mix(doc.view(np.uint64)), [doc, place], bits)


def _shared_marks(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (range, data) of _places_by_document of every mark that is in another document too, and rows (gram, n) of frequent marks.

    A place is within the text; bits from 32 on have its distance from the first place of the mark's strings, bits from 40 on that of the last from the first.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(np.int64), encoded(pdf["text"])
            found: list[tuple] = []
            for part in chunks(texts):
                text, h, first, last, place = marks(texts[part])
                at = np.cumsum([0, *(len(t) + 1 for t in texts[part])])
                found.append((h, ids[part][text], (place - at[text]) | (place - first) << 32 | (last - first) << 40))
            if sum(len(x[0]) for x in found):
                (_, doc, place), rest = split_marks(*(np.concatenate(x) for x in zip(*found)))
                yield _places_by_document(doc, place, bits - FEWER_BITS).assign(sure=True)
                yield packed(rest[0], [*rest[1:]], bits).assign(sure=False)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = {"range": None, "data": None, "gram": None, "n": None}
        held: list[tuple] = []
        for pdf in portions(whole_groups(batches, ["range"])):
            known = pdf[pdf["sure"]]
            yield pd.DataFrame(nothing | {"range": known["range"], "data": known["data"]})
            if not len(known) < len(pdf):
                continue
            doc, place, gram, total = met_marks(pdf["data"][~pdf["sure"]], "i8")
            hot = total >= HOT_PLACES
            yield pd.DataFrame(nothing | {"gram": gram[hot].view(np.int64), "n": total[hot]})
            held.append((doc, place))
            if sum(len(x[0]) for x in held) >= SPANS_AT_ONCE:
                found = _places_by_document(*(np.concatenate(x) for x in zip(*held)), bits - FEWER_BITS)
                yield pd.DataFrame(nothing | {"range": found["range"], "data": found["data"]})
                held = []
        if held:
            found = _places_by_document(*(np.concatenate(x) for x in zip(*held)), bits - FEWER_BITS)
            yield pd.DataFrame(nothing | {"range": found["range"], "data": found["data"]})

    scanned = docs.filter("id is not null").mapInPandas(scan, "range long, data binary, sure boolean")
    return scanned.repartition("range").sortWithinPartitions("range").mapInPandas(meet, "range long, data binary, gram long, n long")


def _gather_places(found: DataFrame) -> DataFrame:
    """(id, places): the different places of each document in order, from rows of _places_by_document."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(whole_groups(batches, ["range"])):
            _, doc, place, _ = unpacked(pdf["data"], ["i8", "i8"])
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]
            doc, place = doc[new], place[new]
            edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            yield pd.DataFrame({"id": doc[edge], "places": [place[x:y].tobytes() for x, y in zip(edge, np.r_[edge[1:], len(doc)])]})

    return found.repartition("range").sortWithinPartitions("range").mapInPandas(gather, "id long, places binary")


def spans_by_document(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int) -> pd.DataFrame:
    """(range, data) of spans of documents, for gather_spans; spans that meet go as one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if len(doc):
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])])
        doc, begin, end = doc[new], begin[new], np.maximum.reduceat(end, new)
    return packed(mix(doc.view(np.uint64)), [doc, begin.astype(np.int32), end.astype(np.int32)], bits)


def gather_spans(found: DataFrame) -> DataFrame:
    """(id, found): the spans of each document, all begins in order and then their ends, from rows of spans_by_document."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(whole_groups(batches, ["range"])):
            _, doc, b, e, _ = unpacked(pdf["data"], ["i8", "i4", "i4"])
            order = np.lexsort((b, doc))
            doc, b, e = doc[order], b[order], e[order]
            edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            ends = np.r_[edge[1:], len(doc)]
            yield pd.DataFrame({"id": doc[edge], "found": [np.stack([b[x:y], e[x:y]]).tobytes() for x, y in zip(edge, ends)]})

    return found.repartition("range").sortWithinPartitions("range").mapInPandas(gather, "id long, found binary")


def merged_spans(found: bytes | None, length: int) -> list[list[int]]:
    """Spans of gather_spans within a text of this length, overlaps merged."""
    merged: list[list[int]] = []
    for b, e in np.frombuffer(found, np.int32).reshape(2, -1).T.tolist() if found is not None else ():
        e = min(e, length)
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        elif b < e:
            merged.append([b, e])
    return merged


def range_bits(rows: int) -> int:
    """Bits of the ranges of hashes for so many documents."""
    return max(LEAST_RANGE_BITS, (rows // RANGE_DOCS).bit_length())


def _stretches(pdf: pd.DataFrame, turn: int = 0, turns: int = 1) -> Iterator[tuple]:
    """Id, mark's hash, first place and bytes (begin, end) of each shared mark's strings and where the mark is, for chunks of documents; then the joined texts.

    Places are those of _shared_marks. Only the marks whose turn it is: equal strings have equal marks, so that they have the same turn.
    """
    texts, ids, places = encoded(pdf["text"]), pdf["id"].to_numpy(), [np.asarray(x, np.int64) for x in pdf["places"]]
    for part in chunks(texts):
        at = np.cumsum([0, *(len(t) + 1 for t in texts[part])])
        raw = b"\n".join(texts[part]) + b"\n"
        text = np.repeat(np.arange(len(at) - 1), [len(x) for x in places[part]])
        place = np.concatenate(places[part])
        mark = (place & 0xFFFFFFFF) + at[text]
        first = mark - (place >> 32 & 0xFF)
        # of rows that share an id, each has the places of all; what they have there is judged by its bytes
        last = np.minimum(first + (place >> 40), at[text + 1] - 1 - LENGTH)
        inside = (first >= at[text]) & (first <= last)
        text, mark, first, last = text[inside], mark[inside], first[inside], last[inside]
        h = gram_hashes(raw, mark)
        # the upper half of a mark's hash is small, the lower one isn't
        keep = (h & _PLACE) % np.uint64(turns) == turn
        text, h, mark, first, last = text[keep], h[keep], mark[keep], first[keep], last[keep]
        yield ids[part][text].astype(np.int64), h, first - at[text], first, last + LENGTH, mark - first, raw


def _windows(h: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray, doc: np.ndarray, raw: bytes) -> tuple[np.ndarray, ...]:
    """Each window of LENGTH bytes of some strings as a string of its own, under a key of its bytes."""
    count = end - begin - LENGTH + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h, first, begin, before, doc = (np.repeat(x, count) for x in (h, first, begin, before, doc))
    begin = begin + step
    return mix(h ^ span_hashes(raw, begin, begin + LENGTH)), first + step, begin, begin + LENGTH, before - step, doc


def equal_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, place in it and class of every window of LENGTH bytes: equal windows have equal classes.

    Deep-shallow sorting (Manzini and Ferragina, 2004) of the windows as suffixes: multikey quicksort, with
    eight bytes as a character, to SHALLOW bytes; then each group that still agrees becomes a blind trie.
    A trie takes all its suffixes at once: they branch off its first leaf where they first differ from
    it, those that branch at the same depth with the same byte are the next trie, and those that don't
    branch within LENGTH bytes are equal to the leaf.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    words = _words(data, ">").astype(np.uint64)
    sizes = np.array([len(s) for s in strings])
    at = np.cumsum([0, *sizes[:-1]])
    windows = sizes - LENGTH + 1
    string = np.repeat(np.arange(len(strings)), windows)
    place = np.arange(len(string)) - np.repeat(np.cumsum([0, *windows[:-1]]), windows)
    begin = at[string] + place

    first, second = words[begin], words[begin + 8]
    order = np.lexsort((second, first))
    differs = np.r_[True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(differs) - 1

    classes = np.full(len(begin), -1, np.int64)
    made = 0
    open_ = order
    offsets = [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]
    while len(open_):
        g = group[open_]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        count = np.diff(np.r_[edge, len(open_)])
        leaf = np.repeat(open_[edge], count)
        depth = np.full(len(open_), LENGTH)
        for offset in reversed(offsets):
            apart = words[begin[open_] + offset] ^ words[begin[leaf] + offset]
            zeros = np.zeros(len(apart), np.int64)
            for k in range(1, 8):
                zeros += apart < np.uint64(1 << (64 - 8 * k))
            depth = np.where(apart != 0, offset + zeros, depth)
        same = depth == LENGTH
        classes[open_[same]] = made + (np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1)[same]
        made += len(edge)
        rest = open_[~same]
        if not len(rest):
            break
        byte = data[begin[rest] + depth[~same]]
        branch = (g[~same], depth[~same], byte)
        by = np.lexsort(branch[::-1])
        open_ = rest[by]
        new = np.r_[True, np.any([x[by][1:] != x[by][:-1] for x in branch], axis=0)]
        group[open_] = np.cumsum(new) - 1
    return string, place, classes


def _alike(key: np.ndarray, begin: np.ndarray, size: np.ndarray, mark: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first and last window of the windows that another string with the same mark may have.

    A window has _HALF bytes or more on one side of the mark: where no other string has these, it is in no other.
    """
    eight = np.ndarray((len(raw),), "<u8", buffer=raw + bytes(8), strides=(1,))
    at, last = begin + mark, size - LENGTH

    def common(which: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
        k = np.flatnonzero(which)
        h = key[k]
        for offset in offsets:
            h = mix(h ^ eight[at[k] + offset])
        order = np.argsort(h)
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        found = np.zeros(len(key), bool)
        found[k[order[same]]] = found[k[order[same + 1]]] = True
        return found

    right = common(mark - last <= _HALF, (GRAM, GRAM + 8, GRAM + _HALF - 8))
    left = common(mark > _HALF, (-_HALF, 8 - _HALF, -8))
    first, last = np.where(left, 0, np.maximum(mark - _HALF, 0)), np.where(right, last, np.minimum(last, mark - _HALF - 1))
    k = np.flatnonzero((left | right) & (first <= last))
    return k, first[k], last[k]


def _verdicts(strings: list[bytes], low: np.ndarray) -> pd.DataFrame:
    """Runs (string, first, last, lowest) of windows that another string has, of a document lower than the string's own lowest."""
    string, place, classes = equal_windows(strings)
    order = np.argsort(classes, kind="stable")
    edge = np.flatnonzero(np.r_[True, classes[order][1:] != classes[order][:-1]])
    count = np.diff(np.r_[edge, len(order)])
    lowest = np.empty(len(order), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(low[string[order]], edge), count)
    run = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (lowest[1:] != lowest[:-1])])
    last = np.r_[run[1:], len(string)] - 1
    found = pd.DataFrame({"string": string[run], "first": place[run], "last": place[last], "lowest": lowest[run]})
    return found[found["lowest"] < low[found["string"]]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, spans (removed byte runs, array of begin and end), n_bytes, n_removed, n_spans, kept (remaining bytes).

    Removes each byte of a whole UTF-8 text that lies in a string of LENGTH bytes which also begins in a
    document with a smaller id; overlaps count, strings are judged on the input, and none crosses documents.

    Only strings whose mark is in two documents or more can repeat. Of those, equal stretches of bytes of a batch of
    documents go on as one, with its places in the batch's first document; the others are repeats already.
    Stretches with the same mark meet and their windows are sorted as suffixes; those that a document with a lower
    id has too are handed on by document. Stretches of very frequent marks go on window by window, under keys of
    their bytes, so that no task has to take all that surrounds a common phrase. Marks take PASSES turns, each with
    the texts and shuffles of its own, which are gone before the next.

    Null texts are empty. Rows with a null id lose nothing and no other row loses by them. Rows that share
    an id are one document: none loses by another. Ids must be integers. Very long texts are taken whole.
    Columns of docs other than id and text play no part; an empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "repeats")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    bits = range_bits(rows)
    of_documents = bits - FEWER_BITS
    marked = tables.keep(_shared_marks(own, bits))
    # a mark has GRAM bytes and more to itself, so that no more grams than HOT_SHARE are so frequent
    least = (size or 0) // GRAM // HOT_SHARE
    frequent = marked.filter(F.col("gram").isNotNull() & (F.col("n") >= least)).select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64)
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))
    shared = tables.keep(own.join(_gather_places(marked.filter("range is not null").select("range", "data")), "id"))
    tables.drop(marked)

    def is_hot(h: np.ndarray) -> np.ndarray:
        known = hot.value
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

    def split(found: tuple) -> Iterator[tuple]:
        """Key, class, id, first place and bytes (begin, end) of strings and where the mark is; those of hot grams window by window."""
        doc, h, first, begin, end, before, raw = found
        frequent = is_hot(h)
        for which in (False, True):
            k = np.flatnonzero(frequent == which)
            if len(k):
                own = tuple(x[k] for x in (h, first, begin, end, before, doc))
                key, at, b, e, to_mark, ids = _windows(*own, raw) if which else own
                yield key, mix(span_hashes(raw, b, e) + to_mark.astype(np.uint64)), ids, at, b, e, to_mark

    def met(pdf: pd.DataFrame, turn: int) -> list[pd.DataFrame]:
        # a function of its own, so that what one portion needs is gone before the next
        parts, raws, upto = [], [], 0
        for found in _stretches(pdf, turn, PASSES):
            parts += [(key, c, doc, first.astype(np.int32), (end - begin).astype(np.int32), begin + upto, before.astype(np.uint8)) for key, c, doc, first, begin, end, before in split(found)]
            raws.append(found[-1])
            upto += len(found[-1])
        if not parts:
            return []
        key, c, doc, first, size, begin, before = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        # one string for all its places in the batch; what isn't in the batch's first document is a repeat for sure
        order = np.lexsort((c, key))
        key, c, doc, first, size, begin, before = (x[order] for x in (key, c, doc, first, size, begin, before))
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (c[1:] != c[:-1])])
        low = np.minimum.reduceat(doc, edge)
        again = doc > np.repeat(low, np.diff(np.r_[edge, len(key)]))
        repeats = spans_by_document(doc[again], first[again], (first + size)[again], of_documents).assign(sure=True)
        count = np.add.reduceat(~again, edge, dtype=np.int32)
        raw = b"".join(raws)
        strings = [raw[a : a + n] for a, n in zip(begin[edge].tolist(), size[edge].tolist())]
        return [repeats, packed(key[edge], [c[edge], low, before[edge], count], bits, strings, (doc[~again], first[~again])).assign(sure=False)]

    def contexts(turn: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["places"] = [np.frombuffer(x, np.int64) for x in pdf["places"]]
                for part in chunks(pdf["text"].tolist(), MET_AT_ONCE):
                    yield from met(pdf.iloc[part], turn)

        return run

    def judged(data: pd.Series) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, begin and end of the repeats among the strings of whole ranges, but for those known to be ones."""
        key, c, low, mark, count, (raw, size), doc, first = unpacked(data, ["i8", "i8", "u1", "i4"], True)
        size, mark, begin = size.astype(np.int64), mark.astype(np.int64), np.cumsum(size, dtype=np.int64) - size
        order = np.lexsort((c, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (c[order][1:] != c[order][:-1])]
        edge, one = np.flatnonzero(new), np.empty(len(key), np.int64)
        one[order] = np.cumsum(new) - 1
        low, high = np.minimum.reduceat(low[order], edge), np.maximum.reduceat(low[order], edge)
        key, size, mark, begin = (x[order[edge]] for x in (key, size, mark, begin))
        # places by string
        own = np.repeat(one, count)
        by = np.argsort(own, kind="stable")
        doc, first, places = doc[by], first[by], np.searchsorted(own[by], np.arange(len(edge) + 1))

        def spans(string: np.ndarray, begin: np.ndarray, last: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, ...]:
            """The windows begin to last of strings, at all their places in documents above the lowest."""
            n = places[string + 1] - places[string]
            at = np.repeat(places[string], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            run = np.repeat(np.arange(len(string)), n)
            run, at = (x[lowest[run] < doc[at]] for x in (run, at))
            return doc[at], first[at] + begin.astype(np.int32)[run], first[at] + last.astype(np.int32)[run] + np.int32(LENGTH)

        again = np.flatnonzero(low < high)
        yield spans(again, np.zeros(len(again), np.int64), size[again] - LENGTH, low[again])
        k, b, e = _alike(key, begin, size, mark, raw)
        key, low, begin = key[k], low[k], begin[k]
        ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else []
        windows, at = np.cumsum(e - b + 1), 0
        while at < len(key):
            before = windows[at - 1] if at else 0
            fits = ends[(ends > at) & (windows[ends - 1] - before <= SORTED_AT_ONCE)]
            end = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
            found = _verdicts([raw[x:y] for x, y in zip((begin + b)[at:end].tolist(), (begin + e + LENGTH)[at:end].tolist())], low[at:end])
            string = found["string"].to_numpy() + at
            yield spans(k[string], found["first"].to_numpy() + b[string], found["last"].to_numpy() + b[string], found["lowest"].to_numpy())
            at = end

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered: list[tuple] = []
        for pdf in portions(whole_groups(batches, ["range"])):
            yield pdf.loc[pdf["sure"], ["range", "data"]]
            if not pdf["sure"].all():
                gathered += judged(pdf["data"][~pdf["sure"]])
            if sum(len(x[0]) for x in gathered) >= SPANS_AT_ONCE:
                yield spans_by_document(*(np.concatenate(x) for x in zip(*gathered)), of_documents)
                gathered = []
        if gathered:
            yield spans_by_document(*(np.concatenate(x) for x in zip(*gathered)), of_documents)

    found = []
    for turn in range(PASSES):
        strings = shared.mapInPandas(contexts(turn), "range long, data binary, sure boolean").repartition("range").sortWithinPartitions("range")
        found.append(tables.keep(strings.mapInPandas(sort, "range long, data binary")))
    spans = cut(gather_spans(reduce(DataFrame.union, found)))
    tables.drop()

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, found in zip(encoded(pdf["text"]), pdf["found"]):
                merged = merged_spans(found, len(text))
                begin = [0, *(e for _, e in merged)]
                end = [*(b for b, _ in merged), len(text)]
                rows.append((merged, len(text), sum(e - b for b, e in merged), len(merged), b"".join(text[b:e] for b, e in zip(begin, end))))
            out = pd.DataFrame(rows, columns=["spans", "n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    out = own.join(spans, "id", "left").withColumn("id", F.col("id").cast("string"))  # pandas would make numbers beside a null floats
    out = out.mapInPandas(remove, "id string, spans array<array<long>>, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("id", F.col("id").cast("bigint")).withColumnRenamed("id", id_col)
