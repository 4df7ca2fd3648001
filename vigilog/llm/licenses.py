"""Licence scan: Aho-Corasick over words for notices and tags, shunting-yard for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from vigilog.llm.common import encoded, map_named

#: Phrases of the base scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices: phrase, label.
NOTICE_PHRASES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "bsd license": "bsd", "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl",
    "creative commons": "cc", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "public domain": "public-domain", "unlicense": "unlicense", "proprietary and confidential": "proprietary",
}
#: The words of the identifier tag; what follows it on its line is an expression.
TAG = "spdx license identifier"
#: How freely a text under a label may be used, 0 to 1.
FREEDOM = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "cc": 0.6, "mpl": 0.7, "lgpl": 0.6, "epl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.1, "proprietary": 0.0,
}
#: What stands for an expression where a text has no licence, or its author doesn't say.
NO_LICENCE = ("NONE", "NOASSERTION")
#: What an exception adds to the freedom of the licence before it.
EXCEPTION_GAIN = 0.1

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A line from where the tag stands.
_TAGGED = re.compile(r"[^0-9a-z\n]*license[^0-9a-z\n]+identifier[^\S\n]*:?([^\n]*)", re.I)
_TOKENS = re.compile(r"[()]|[0-9A-Za-z][0-9A-Za-z.+-]*")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
#: Identifiers have a version or a sign, or are the name of a family; other words are prose.
_IDENTIFIER = re.compile(r"(?=.*[0-9])[0-9A-Za-z]+([.-][0-9A-Za-z]+)+\+?|LicenseRef-[0-9A-Za-z.-]+|[0-9]*[A-Z][0-9A-Za-z]*(-[0-9A-Za-z]+)+\+?")
_FREE = {"with", "and", "or"}


def label_of(identifier: str) -> str:
    """The label of an identifier such as Apache-2.0 or GPL-3.0-or-later: its family."""
    name = identifier.lower().rstrip("+")
    for family in sorted(FREEDOM, key=len, reverse=True):
        if name == family or name.startswith(family + "-"):
            return family
    return name


def is_identifier(token: str) -> bool:
    """Whether a word after a tag names a licence: by its form, or as a family of FREEDOM."""
    return token.lower() not in _FREE and (token.lower().rstrip("+") in FREEDOM or bool(_IDENTIFIER.fullmatch(token)))


def to_postfix(expression: str) -> list[str] | None:
    """The expression's tokens, operators after their operands; None if it isn't an expression.

    Operands are identifiers; where one is due and another word stands, there is no expression. AND, OR and WITH are
    operators, in lower case where an identifier follows. What else follows an operand is prose and ends the
    expression. The right side of WITH is one identifier.
    """
    tokens = _TOKENS.findall(expression)
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for k, token in enumerate(tokens):
        operator = token.upper() if token.upper() in _RANK else None
        after = next((x for x in tokens[k + 1 :] if x != "("), "")
        if operand_next:
            if operator or token == ")" or (token == "(" and held[-1:] == ["WITH"]) or not (token == "(" or is_identifier(token)):
                return None
            (held if token == "(" else out).append(token)
            operand_next = token == "("
            continue
        if operator:
            if token != operator and not is_identifier(after):
                break  # in lower case it is a word of prose as well
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[operator]:
                out.append(held.pop())
            held.append(operator)
            operand_next = True
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break  # a bracket of the prose around
            held.pop()
        else:
            break
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


@lru_cache(maxsize=4096)
def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """Labels of the licences that the expression names, and its freedom: the best side of OR, the worst of AND.

    NONE and NOASSERTION, alone, are valid and name no licence.
    """
    if expression in NO_LICENCE:
        return frozenset(), 0.0
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[frozenset[str], float, str]] = []
    for token in postfix:
        if token in _RANK:
            (r_labels, r_free, r_name), (l_labels, l_free, _) = stack.pop(), stack.pop()
            if token == "WITH":
                stack.append((l_labels | {"with-" + r_name.lower()}, min(1.0, l_free + EXCEPTION_GAIN), ""))
            else:
                stack.append((l_labels | r_labels, max(l_free, r_free) if token == "OR" else min(l_free, r_free), ""))
        else:
            label = label_of(token)
            stack.append((frozenset([label]), FREEDOM.get(label, 0.0), token))
    return stack[0][:2]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **NOTICE_PHRASES, TAG: ""}:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 1))
    found.make_automaton()
    return found


def scan_text(text: str, raw: bytes) -> tuple:
    low = raw.lower()
    words = _WORDS.findall(low)
    joined = " " + b" ".join(words).decode("latin-1") + " "
    tags: list[int] = []
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    freedoms: list[float] = []
    upto, at = 0, 0

    def word_at(begin: int) -> int:
        # matches end in order but may begin a little earlier than the last one did
        nonlocal upto, at
        at = at + joined.count(" ", upto, begin) if begin >= upto else at - joined.count(" ", begin, upto)
        upto = begin
        return at

    for end, (phrase, back) in _automaton().iter(joined):
        begin = end - back
        if phrase == TAG:
            tags.append(word_at(begin))
            continue
        label = BASE_PHRASES.get(phrase)
        if label:
            base.append((word_at(begin), label))
        labels.add(label := label or NOTICE_PHRASES[phrase])
        freedoms.append(FREEDOM[label])
    n_tags = n_invalid = 0
    begins = [m.start() for m in _WORDS.finditer(low)] if tags else []
    for word in tags:
        # the automaton has told where the tag is: its line is parsed from there
        begin, end = begins[word] + len("spdx"), raw.find(b"\n", begins[word])
        place = _TAGGED.match(raw[begin : end if end >= 0 else len(raw)].decode("utf-8", "replace"))
        if not place:
            continue  # its three words are on different lines
        n_tags += 1
        if found := evaluate(place[1].strip()):
            labels |= found[0]
            freedoms.append(found[1])
        else:
            n_invalid += 1
    places = [p for p, _ in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), min(freedoms, default=0.0), n_tags, n_invalid,
    )


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_tags", "n_invalid"]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, words, base places with the first and last, labels, score, tags.

    A-Z are lowered; words are runs of digits, a-z and characters beyond ASCII. One automaton finds base
    phrases, further notices and the identifier tag in the words of the whole text, in one pass. The
    expression after a tag is parsed and evaluated; n_invalid counts tags whose expression can't be. The
    score is the freedom that all notices of the text leave together, that of the narrowest; without any
    it is 0. A null text is empty: no words, no places, empty labels. Rows are independent of each other,
    so repeated rows repeat their result, null ids stay null, and other columns of docs play no part.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            found = pd.DataFrame([scan_text(*x) for x in zip(texts, encoded(texts))], columns=_COLUMNS)
            found.insert(0, "id", pdf["id"].to_numpy())
            for c in ("first_word", "last_word"):
                found[c] = found[c].astype("Int64")
            yield found

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, n_invalid long"
    return map_named(docs, id_col, text_col, scan, schema).withColumnRenamed("id", id_col)
