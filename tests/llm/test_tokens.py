"""Token ids against the libraries, and shortest paths against all segmentations."""

from __future__ import annotations

import math
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from vigilog.llm.sentencepiece_fst import FALLBACK_COST, SPACE, Normaliser, Transducer
from vigilog.llm.token_store import CachedEncoder

PARTS = ["a", "bc", " ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "'", "é", "ß", "×", "÷", "«", "中", "12", "😀", " the", "\x1c", "ª", "\xa0", "—", "Ab", "'ll", " tion", "ﬁ", "Ａ"]


def texts(n: int, parts: list[str]) -> list[str]:
    rng = random.Random(0)
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)), "x" * 5000, "é" * 300 + "the" * 100, ("long word " * 60_000) + "x" * 300]


def test_byte_pairs_as_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    some = texts(10_000, PARTS + added)
    for text, got, expected in zip(some, CachedEncoder(path).encode(some), plain.encode_batch(some, add_special_tokens=False)):
        assert got.tolist() == expected.ids, text[:200]


@pytest.fixture(scope="module")
def model():
    """The pieces at weights that 32-bit sums of the library hold exactly, and marked for its unigram search."""
    found = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        found.ParseFromString(f.read())
    found.trainer_spec.model_type = found.trainer_spec.UNIGRAM
    for p in found.pieces:
        p.score = max(p.score, -40_000)
    return found


def test_shortest_paths_as_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    some = texts(5_000, PARTS)
    fst = Transducer(model=model.SerializeToString())
    for text, got in zip(some, fst.encode(some)):
        assert got.tolist() == library.encode(text), text[:200]
        assert fst.decode(got) == text


def test_normaliser_with_rules_as_the_library(model):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    own = Normaliser(spec.normalizer_spec)
    some = texts(1_000, PARTS)[:-1]
    assert len(own.rules) > 100 and [own(t) for t in some] == [library.normalize(t) for t in some]


def test_shortest_paths_as_all_segmentations(model):
    fst = Transducer(model=model.SerializeToString())
    weight = {p.piece: -p.score for p in model.pieces if p.type == p.NORMAL}

    def least(unit: str) -> float:
        """Over every way to divide the unit."""
        found = math.inf
        for cuts in range(1 << (len(unit) - 1)):
            parts, begin = [], 0
            for k in range(1, len(unit) + 1):
                if k == len(unit) or cuts >> (k - 1) & 1:
                    parts.append(unit[begin:k])
                    begin = k
            if all(p in weight or len(p) == 1 for p in parts):
                found = min(found, sum(weight.get(p, max(weight.values()) + FALLBACK_COST) for p in parts))
        return found

    units = [SPACE + w for w in ("the", "station", "é中b", "xxyzzy", "\x1c\x1d", "ination")] + [SPACE * 3, "\n", "tion"]
    for unit, (total, ids) in zip(units, fst.shortest_paths(units)):
        assert total == least(unit) and b"".join(fst.bytes_of[i] for i in ids).decode() == unit.replace(SPACE, " ")
