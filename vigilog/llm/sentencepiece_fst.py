"""SentencePiece encoding as a shortest path through composed weighted transducers, and decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import chunks, encoded, map_named
from vigilog.llm.units import UnitCache, join, piece_edges

SPACE = "▁"
#: What a character of the byte fallback costs beyond the dearest piece.
FALLBACK_COST = 10.0
#: Units after which a worker's cache of shortest paths starts anew.
CACHE_UNITS = 500_000
#: Characters up to which units are composed together, a column of characters at a time; longer ones follow one by one.
TOGETHER = 48
_CODE = 1 << 21


def character_rules(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a normaliser's compiled map: a double-array trie of keys, then their replacements."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    rules: dict[str, str] = {}
    offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    open_ = [(offset(units[0]), b"")]
    while open_:
        base, key = open_.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or units[at] & 0x800000FF != label:
                continue
            unit, longer = units[at], key + bytes([label])
            if unit >> 8 & 1:
                place = units[at ^ offset(unit)] & 0x7FFFFFFF
                rules[longer.decode()] = texts[place : texts.index(b"\0", place)].decode()
            open_.append((at ^ offset(unit), longer))
    return rules


class Normaliser:
    """The first transducer: reads characters, writes normalised ones; at each place the longest rule applies.

    Then the model's settings: no spaces at the ends and single ones between, one space before the text, U+2581 for spaces.
    """

    def __init__(self, spec):
        self.rules = character_rules(spec.precompiled_charsmap)
        self.next: list[dict[str, int]] = [{}]
        self.output: dict[int, str] = {}
        for key, value in self.rules.items():
            state = 0
            for c in key:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                state = self.next[state][c]
            self.output[state] = value
        self.strip, self.prefix, self.escape = spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces

    @property
    def is_plain(self) -> bool:
        """Whether only spaces are rewritten, each by itself."""
        return not self.rules and not self.strip and self.escape

    def rewrite(self, text: str) -> str:
        if not self.rules:
            return text
        out, i = [], 0
        while i < len(text):
            state, j, found = 0, i, None
            while j < len(text) and (state := self.next[state].get(text[j], -1)) >= 0:
                j += 1
                if state in self.output:
                    found = j, self.output[state]
            i, written = found or (i + 1, text[i])
            out.append(written)
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.strip:
            text = " ".join(x for x in text.split(" ") if x)
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class Transducer:
    """Normaliser, pieces and byte fallback of a SentencePiece model, composed with each text.

    The piece transducer is a trie: its arcs read characters, and the arc that ends a piece writes its id at the
    weight of the model's score, negated. From its start a character that is no piece itself goes through the
    fallback, which writes the ids of its UTF-8 bytes and costs FALLBACK_COST more than the dearest piece. Weights
    add along a path and the smallest sum wins (the tropical semiring); of equal sums the path whose last piece is
    longer. Those are the weights and rules of the library's unigram search, also where the model's pieces were
    made by merging; there a shortest path isn't the order of merges, and pieces differ from the library's own.

    The composition with a text has a state for each place in it and each state of the trie, made as it is reached. No piece
    reads a space after another character or a line feed beside one, nor, in most models, letters beside other
    signs; so it falls apart at those places, and a unit that occurs again has its shortest path already.
    """

    def __init__(self, path: str | None = None, model: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        kinds = proto.SentencePiece
        self.normal = Normaliser(proto.normalizer_spec)
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("pieces that the user has defined come before all others, which no weight can say")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        if len(self.byte_id) < 256:
            raise ValueError("a model without byte fallback")
        self.fallback = FALLBACK_COST - min(s for _, _, s in pieces)
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for i, p, _ in pieces} | {i: bytes([b]) for b, i in self.byte_id.items()}
        self._compile(pieces)
        inner = [p.lstrip(SPACE) for _, p, _ in pieces]
        self.divides = not any(SPACE in p or "\n" in p for p in inner) and self.normal.escape
        data, starts = join(encoded(inner))
        edges = piece_edges(np.frombuffer(data, np.uint8), starts[:-1], True)
        self.divides_letters = self.divides and int(edges.sum()) == len(np.unique(starts[:-1][np.diff(starts) > 0]))
        self.cache = UnitCache(self._unit_paths, CACHE_UNITS)

    def _compile(self, pieces: list[tuple[int, str, float]]) -> None:
        """Arcs by (state, character), sorted, with the next state; id and weight of the piece that ends in a state."""
        following: dict[tuple[int, str], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for i, piece, score in pieces:
            state = 0
            for c in piece:
                state = following.setdefault((state, c), len(following) + 1)
            ends[state] = (i, -score)
        n = len(following) + 1
        keys = np.array([s * _CODE + ord(c) for s, c in following], np.int64)
        order = np.argsort(keys)
        self.arc_keys, self.arc_to = keys[order], np.array(list(following.values()), np.int64)[order]
        self.piece_of, self.weight_of = np.full(n, -1, np.int64), np.full(n, np.inf)
        self.piece_of[list(ends)] = [i for i, _ in ends.values()]
        self.weight_of[list(ends)] = [w for _, w in ends.values()]

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, -1 where no arc reads the character."""
        key = state * _CODE + code
        at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
        return np.where(self.arc_keys[at] == key, self.arc_to[at], -1)

    def shortest_paths(self, units: list[str]) -> list[tuple[float, list[int]]]:
        """Weight and ids of the shortest path of each normalised unit; the units are composed together, place by place."""
        size = np.array([len(u) for u in units])
        longest = int(size.max(initial=0))
        codes = np.full((len(units), longest + 1), _CODE - 1, np.int64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(longest + 1) < size[:, None]] = flat
        best = np.full((len(units), longest + 1), np.inf)
        best[:, 0] = 0
        back, piece = np.zeros(best.shape, np.int32), np.full(best.shape, -1, np.int32)
        for i in range(longest):
            row = np.flatnonzero(size > i)
            state = np.zeros(len(row), np.int64)
            lone = np.zeros(len(row), bool)
            which = np.arange(len(row))
            for j in range(i + 1, longest + 1):
                state = self._step(state, codes[row[which], j - 1])
                alive = state >= 0
                state, which = state[alive], which[alive]
                if not len(which):
                    break
                ended = self.piece_of[state] >= 0
                r, s = row[which[ended]], state[ended]
                if j == i + 1:
                    lone[which[ended]] = True
                total = best[r, i] + self.weight_of[s]
                better = total < best[r, j]
                r = r[better]
                best[r, j], back[r, j], piece[r, j] = total[better], i, self.piece_of[s[better]]
            r = row[~lone]
            total = best[r, i] + self.fallback
            better = total < best[r, i + 1]
            r = r[better]
            best[r, i + 1], back[r, i + 1], piece[r, i + 1] = total[better], i, -1
        out = []
        for k, unit in enumerate(units):
            at, path = len(unit), []
            while at:
                i = int(back[k, at])
                found = int(piece[k, at])
                path += [found] if found >= 0 else [self.byte_id[b] for b in reversed(unit[i].encode("utf-8", "surrogatepass"))]
                at = i
            out.append((float(best[k, len(unit)]), path[::-1]))
        return out

    def _unit_paths(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        units = [x.decode().replace(" ", SPACE) for x in raw]
        out: list[np.ndarray] = [None] * len(units)
        by_size = sorted(range(len(units)), key=lambda k: len(units[k]))
        begin = 0
        while begin < len(by_size):
            # about as long as each other, and not too many characters in all
            first = max(8, len(units[by_size[begin]]))
            end = begin + 1
            while end < len(by_size) and len(units[by_size[end]]) <= min(2 * first, TOGETHER) and (end - begin) * first < 1 << 18:
                end += 1
            for k, (_, ids) in zip(by_size[begin:end], self.shortest_paths([units[k] for k in by_size[begin:end]])):
                out[k] = np.array(ids, np.uint32)
            begin = end
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text in turn."""
        normal = self.normal
        if normal.is_plain:
            raw = [b" " + x if x and normal.prefix else x for x in encoded(texts)]
        else:
            raw = [x.replace(SPACE, " ").encode() for x in map(normal, texts)]
        for part in chunks(raw):
            joined, starts = join(raw[part])
            data = np.frombuffer(joined, np.uint8)
            edge = piece_edges(data, starts[:-1], self.divides_letters) if self.divides else np.isin(np.arange(len(data)), starts[:-1])
            ids, sizes = self.cache(joined, starts, edge) if len(data) else (np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64))
            ends = np.cumsum(sizes)
            for e, n in zip(ends.tolist(), sizes.tolist()):
                yield ids[e - n : e].astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.normal.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """One row per row of docs: id, ids (array), n_pieces, n_fallback (ids of bytes), round_trip.

    Whole texts are encoded; null and empty ones have no ids. round_trip tells whether decoding the ids
    gives the normalised text again (U+2581 in a text comes back as a space). Each worker compiles the model once
    from model_path, a file of the tokenizer's installed package. Rows are encoded one by one: repeated
    rows repeat their result, null ids stay null, an empty table gives an empty result; other columns
    play no part.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compiled(model_path)
        is_byte = np.zeros(max(fst.bytes_of, default=0) + 1, bool)
        is_byte[list(fst.byte_id.values())] = True
        plain = (lambda t: t.replace(SPACE, " ")) if fst.normal.is_plain else (lambda t: fst.normal(t).replace(SPACE, " ")[fst.normal.prefix :])
        for pdf in batches:
            for begin in range(0, len(pdf), 500):
                part = pdf.iloc[begin : begin + 500]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                ids = list(fst.encode(texts))
                same = [fst.decode(x) == plain(t) for x, t in zip(ids, texts)] if check else [None] * len(ids)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "ids": ids, "n_pieces": [len(x) for x in ids], "n_fallback": [int(is_byte[x].sum()) for x in ids], "round_trip": same})

    found = map_named(docs, id_col, text_col, run, "ids array<int>, n_pieces long, n_fallback long, round_trip boolean")
    return found.withColumnRenamed("id", id_col)
