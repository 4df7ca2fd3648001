from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilog.llm.common import Words, connected_components, shingles
from vigilog.llm.licenses import evaluate, to_postfix
from vigilog.llm.minhash import Banding, odd_sketches
from vigilog.llm.quality_rules import fit_votes
from vigilog.llm.suffix_dedup import BLOCK, GRAM, LENGTH, _alike, equal_windows, marks, packed, range_bits, unpacked
from vigilog.llm.token_store import Shard, WaveletMatrix, pack_shard


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_wavelet_matrix(ids):
    x = np.array(ids, np.uint32)
    data = pack_shard([1], [len(x)], x)
    shard = Shard(lambda at, size: data[at : at + size])
    m = shard.matrix
    assert (shard.doc_ids, shard.lengths.tolist()) == ([1], [len(x)]) and m.decode().tolist() == ids
    for t in {*ids[:5], 3}:
        assert m.occurrences(t) == [i for i, v in enumerate(ids) if v == t] and m.count(t) == ids.count(t)
        assert m.rank(t, len(ids) // 2) == ids[: len(ids) // 2].count(t)
    assert [m.access(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        WaveletMatrix.build(x).select(3, len(ids) + 1)


def test_a_look_into_a_shard_unpacks_little_of_it():
    x = np.random.default_rng(0).integers(0, 50_000, 1_000_000).astype(np.uint32)
    data = pack_shard([1, 2], [400_000, 600_000], x)
    shard = Shard(lambda at, size: data[at : at + size])
    m, levels = shard.matrix, shard.matrix.levels
    for i in (0, 65_535, 65_536, 999_999):
        before = shard.blocks_read
        assert m.access(i) == x[i] and shard.blocks_read - before <= levels
    token = int(x[777_777])
    at = np.flatnonzero(x == token)
    before = shard.blocks_read
    assert m.rank(token, 800_000) == (at < 800_000).sum() and shard.blocks_read - before <= 2 * levels
    assert m.occurrences(token) == at.tolist() and m.rank(token, m.n) == len(at)


def test_words_of_equal_polynomials_differ():
    """Two Thue-Morse words: any polynomial of their bytes modulo a power of two is the same."""
    bits = np.array([bin(i).count("1") & 1 for i in range(2048)], np.uint8)
    one, other = bytes(97 + bits), bytes(98 - bits)
    hashes = Words([one, other, one[:100], other[:100]]).hash
    assert len(set(hashes.tolist())) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé \n\tb", max_size=30), min_size=1, max_size=8))
def test_words_are_those_of_each_text(texts):
    raw = [t.encode() for t in texts]
    w = Words(raw)
    for i, t in enumerate(raw):
        own = [bytes(w.bytes[b:e]) for b, e in zip(w.begin[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert own == t.split()
    hashes = {}
    for b, e, h in zip(w.begin, w.end, w.hash):
        assert hashes.setdefault(bytes(w.bytes[b:e]), h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_shingles_of_few_words_are_one():
    w = Words([b"a b c"]).hash
    assert len(shingles(w)) == 1 and len(shingles(w[:0])) == 0 and shingles(w)[0] != shingles(Words([b"a b c d e"]).hash)[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40), min_size=1, max_size=6), st.integers(0, 40))
def test_equal_windows(parts, shift):
    shared = bytes(range(60))
    strings = [(p + shared + p)[: 50 + shift] if len(p) + 60 > 50 else shared for p in parts]
    strings = [s if len(s) >= LENGTH else s + bytes(LENGTH) for s in strings]
    string, place, classes = equal_windows(strings)
    windows = [strings[s][p : p + LENGTH] for s, p in zip(string, place)]
    assert [windows.index(w) for w in windows] == [classes.tolist().index(c) for c in classes.tolist()]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab\n", max_size=130).map(str.encode), min_size=1, max_size=8), st.sampled_from([0, BLOCK - 90, BLOCK - 60, 2 * BLOCK]))
def test_each_string_has_one_mark(texts, before):
    """Also across blocks of places: all strings have a mark in them, and equal strings have it at the same place."""
    texts = [bytes(np.random.default_rng(0).integers(97, 123, before, np.uint8)), *texts, b"passage of which all strings are in two of the texts", *texts]
    text, h, first, last, own = marks(texts)
    raw, of, seen = b"\n".join(texts), {}, {}
    for t, key, a, b, m in zip(text.tolist(), h.tolist(), first.tolist(), last.tolist(), own.tolist()):
        for at in range(a, b + 1):
            assert at not in of and at <= m <= at + LENGTH - GRAM
            of[at] = t
            assert seen.setdefault(raw[at : at + LENGTH], (m - at, key)) == (m - at, key)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
    assert of == {begins[i] + k: i for i, t in enumerate(texts) for k in range(len(t) - LENGTH + 1)}


def test_blocks_stay_large_at_any_size():
    """What a batch of documents sends isn't cut into some rows a block, however many documents there are."""
    rng = np.random.default_rng(4)
    key, n = rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2), rng.integers(0, 99, 200_000)
    found = packed(key, [n], range_bits(3_000_000))
    assert len(found) <= 5_000 and found["range"].is_unique
    back, m, _ = unpacked(found["data"], ["i8"])
    assert sorted(zip(back.tolist(), m.tolist())) == sorted(zip(key.tolist(), n.tolist()))


def test_strings_that_share_only_their_mark_are_not_sorted():
    """Windows that another string may have: all that one has are among them, and of strings that share the gram alone there are none."""
    rng = np.random.default_rng(5)
    gram = b"0123456789abcdef"
    sides = [bytes(rng.integers(97, 123, 34, np.uint8)) for _ in range(4)]
    strings = [(a[34 - m :] + gram + b)[: 50 + int(rng.integers(0, m + 1))] for m in (0, 10, 17, 18, 25, 34) for a in sides for b in sides]
    mark = np.repeat([0, 10, 17, 18, 25, 34], 16)
    alone = [bytes(rng.integers(97, 123, 34, np.uint8)) + gram + bytes(rng.integers(97, 123, 34, np.uint8)) for _ in range(50)]
    strings, mark = strings + alone, np.r_[mark, np.full(50, 34)]
    size = np.array([len(x) for x in strings])
    k, first, last = _alike(np.zeros(len(strings), np.uint64), np.cumsum(size) - size, size, mark, b"".join(strings))
    asked = {(i, w) for i, a, b in zip(k.tolist(), first.tolist(), last.tolist()) for w in range(a, b + 1)}
    of = {}
    for i, x in enumerate(strings):
        for w in range(len(x) - LENGTH + 1):
            of.setdefault(x[w : w + LENGTH], set()).add((i, w))
    assert all(x <= asked for x in of.values() if len({i for i, _ in x}) > 1)
    assert k.max() < len(strings) - 50


def test_licence_expressions():
    assert to_postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "AND", "OR"]
    assert to_postfix("(MIT OR Apache-2.0) AND zlib more prose") == ["MIT", "Apache-2.0", "OR", "zlib", "AND"]
    assert to_postfix("(MIT OR Apache-2.0) AND x more prose") is None
    assert to_postfix("MIT AND") is None and to_postfix(")") is None and to_postfix("(MIT") is None and to_postfix("") is None
    assert evaluate("GPL-2.0-only OR MIT")[1] == 1.0 and evaluate("GPL-2.0-only AND MIT")[1] == 0.4 and evaluate("GPL-2.0+ WITH Foo-exception")[1] == 0.5


def test_licence_expressions_end_where_prose_begins():
    assert evaluate("MIT and other terms") == evaluate("MIT") and evaluate("MIT or so they say") == evaluate("MIT")
    assert evaluate("MIT and Apache-2.0")[0] == {"mit", "apache"} and evaluate("MIT or bsd")[0] == {"mit", "bsd"}
    assert evaluate("MIT WITH (A OR B)") is None and evaluate("MIT AND") is None and evaluate("AND MIT") is None
    assert evaluate("(MIT OR (Apache-2.0 AND GPL-2.0-only)) see the file")[1] == 1.0
    assert evaluate("GPL-2.0-only WITH Classpath-exception-2.0")[0] == {"gpl", "with-classpath-exception-2.0"}
    assert evaluate("MIT) in the header") == evaluate("MIT") and evaluate("(MIT") is None and evaluate("") is None


def test_odd_sketches_estimate_high_similarities():
    rng, spec = np.random.default_rng(1), Banding()
    for n in (150, 900, 6000):
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 10 : n + n // 10])
        sketch, filled = odd_sketches([a, b], spec)
        apart = int(np.bitwise_count(sketch[0].view(np.uint64) ^ sketch[1].view(np.uint64)).sum())
        shared = (filled.sum() + np.log(1 - 2 * apart / spec.sketch_bits) * spec.sketch_bits / 2) / 2
        union = spec.bins * (1 - (1 - 1 / spec.bins) ** (1.1 * n))
        assert abs(shared / union - 0.9 / 1.1) < 0.05


def _simulated(n: int, share: list[float], detect: list[float], alarm: list[float], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Votes of rules on n texts, and the class of each: good, or bad in the way of a rule; how often rules vote for texts differs by class."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(len(share), n, p=share)
    favours = np.where(np.arange(len(share))[:, None] == 0, 0.9, rng.choice([0.05, 0.5, 0.95], (len(share), len(detect))))
    votes = np.zeros((n, len(detect)), int)
    for j, (d, f) in enumerate(zip(detect, alarm)):
        favour = favours[kind, j]
        votes[:, j] = np.where(rng.random(n) < np.where(kind == j + 1, d, f), -1, np.where(rng.random(n) < favour, 1, 0))
    return votes, kind


def test_votes_recover_the_accuracies_of_rules():
    share, detect, alarm = [0.75, 0.05, 0.04, 0.05, 0.06, 0.05], [0.9, 0.7, 0.8, 0.75, 0.6], [0.02, 0.05, 0.01, 0.03, 0.02]
    votes, kind = _simulated(200_000, share, detect, alarm, seed=2)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, found, rates = fit_votes(patterns, counts.astype(float))
    assert np.abs(found - share).max() < 0.03
    assert max(abs(rates[j + 1, j, 0] - d) for j, d in enumerate(detect)) < 0.03 and max(abs(rates[0, j, 0] - f) for j, f in enumerate(alarm)) < 0.03
    assert ((good[which] >= 0.5) == (kind == 0)).mean() > 0.93


def test_the_start_fades_as_texts_come_in():
    share, detect, alarm = [0.75, 0.05, 0.04, 0.05, 0.06, 0.05], [0.9, 0.7, 0.8, 0.75, 0.6], [0.02, 0.05, 0.01, 0.03, 0.02]
    apart = []
    for n in (300, 200_000):
        patterns, counts = np.unique(_simulated(n, share, detect, alarm, seed=2)[0], axis=0, return_counts=True)
        rates = fit_votes(patterns, counts.astype(float))[2]
        apart.append(max(abs(rates[j + 1, j, 0] - d) for j, d in enumerate(detect)))
    assert apart[1] < 0.03 < apart[0]


def test_a_rule_that_accuses_nearly_all_texts_says_nothing():
    votes, _ = _simulated(20_000, [0.9, 0.1], [0.9], [0.02])
    patterns, which, counts = np.unique(np.c_[votes, np.where(np.random.default_rng(1).random(20_000) < 0.97, -1, 0)], axis=0, return_inverse=True, return_counts=True)
    alone, alone_which, alone_counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    with_it, without = fit_votes(patterns, counts.astype(float))[0][which], fit_votes(alone, alone_counts.astype(float))[0][alone_which]
    assert ((with_it >= 0.5) == (without >= 0.5)).all() and (with_it >= 0.5).mean() > 0.8


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 8), (8, 9), (9, 10), (10, 3), (20, 20)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{n: 1 for n in (1, 2, 3, 7, 8, 9, 10)}, 4: 4, 5: 4}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_prose_are_no_licences():
    for prose in ("see LICENSE file", "the MIT license", "MIT AND other terms", "none of it", "c stuff", "LICENSE"):
        assert evaluate(prose) is None
    assert evaluate("NONE") == evaluate("NOASSERTION") == (frozenset(), 0.0)


def test_licence_expressions_as_brute_force():
    """Random expressions as a recursive evaluator reads them."""
    import random

    from vigilog.llm.licenses import EXCEPTION_GAIN, FREEDOM, label_of

    rng = random.Random(3)
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "BSD-3-Clause", "MPL-2.0", "LicenseRef-x", "CC-BY-NC-4.0"]

    def make(depth):
        """Text and value (labels, freedom) of a random expression, and how tightly it binds."""
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            name = rng.choice(names)
            label = label_of(name)
            if rng.random() < 0.2:
                return f"{name} WITH Some-exception", {label, "with-some-exception"}, min(1.0, FREEDOM.get(label, 0.0) + EXCEPTION_GAIN), 3
            return name, {label}, FREEDOM.get(label, 0.0), 3
        operator, rank = rng.choice([("AND", 2), ("OR", 1)])
        left, right = make(depth - 1), make(depth - 1)
        wrapped = [f"({x[0]})" if x[3] < rank or rng.random() < 0.2 else x[0] for x in (left, right)]
        return f" {operator} ".join(wrapped), left[1] | right[1], (max if operator == "OR" else min)(left[2], right[2]), rank

    for _ in range(300):
        text, labels, freedom, _ = make(4)
        assert evaluate(text) == (frozenset(labels), freedom), text
