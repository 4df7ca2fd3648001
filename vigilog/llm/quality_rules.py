"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Words, chunks, cut, encoded, map_named, shingles

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3
SYMBOLS = b"#*$%&|<>"
#: A text is kept if its posterior probability of good quality is this or more.
KEEP_AT = 0.6
#: What EM starts from, for any rule: the share of good texts, how often it votes against good ones, and against its own kind of bad ones.
FIRST_GOOD, FALSE_ALARM, DETECTION = 0.85, 0.01, 0.8
#: How many texts that start weighs as, in each class, whatever the number of texts is.
PSEUDO_TEXTS = 50.0
#: The part that may be good of the texts which a rule accuses, if it never votes for one.
MOST_WRONG = 0.15
#: A rule that votes against more texts than this is about something else than quality, where most texts are good.
MOST_AGAINST = 0.5

_SYMBOL, _UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"))
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits"]


def _repeated(words: np.ndarray) -> int:
    """Words within a window of WINDOW_WORDS words that occurs twice or more, the first included."""
    n = len(words)
    if n <= WINDOW_WORDS:
        return 0
    _, which, count = np.unique(shingles(words, WINDOW_WORDS), return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    if not len(at):
        return 0
    inside = np.zeros(n, bool)
    for i in range(WINDOW_WORDS):
        inside[at + i] = True
    return int(inside.sum())


def measure(texts: list[bytes]) -> np.ndarray:
    """The columns of _FEATURES, a row per text."""
    out = []
    for part in chunks(texts):
        own = texts[part]
        words = Words(own)
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        between = lambda mask: np.diff(upto(mask)[words.text_at])
        b = words.bytes
        inside = np.zeros(len(b) + 1, np.int8)
        inside[words.begin] += 1
        inside[words.end] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        rows = np.zeros((len(own), len(_FEATURES)), np.int64)
        rows[:, 0] = np.diff(words.first)
        for k, mask in ((1, inside & ~_CONTINUED[b]), (2, _SYMBOL[b]), (6, _UPPER[b]), (7, _LOWER[b]), (8, _DIGIT[b])):
            rows[:, k] = between(mask)
        for i, text in enumerate(own):
            lines = [x for x in text.split(b"\n") if x.strip()]
            rows[i, 5] = len(lines)
            rows[i, 3] = len(lines) - len(set(lines))
            rows[i, 4] = _repeated(words.hash[words.first[i] : words.first[i + 1]])
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, len(_FEATURES)), np.int64)


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: 1 for good, -1 for bad, 0 to abstain (also where a measure isn't defined)."""
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    words, repeats, letters = F.col("n_words"), ratio("n_repeat_words", "n_words"), ratio("word_chars", "n_words")
    return {
        "length": _vote(words < MIN_WORDS, words >= 2 * MIN_WORDS),
        "repeats": _vote(repeats > 0.3, repeats <= 0.02),
        "symbols": _vote(ratio("n_symbols", "n_words") > 0.15),
        "dup_lines": _vote(ratio("n_dup_lines", "n_lines") > 0.35),
        "word_length": _vote((letters < 2.5) | (letters > 12)),
        "upper": _vote(F.try_divide("n_upper", F.col("n_upper") + F.col("n_lower")) > 0.4),
        "digits": _vote(ratio("n_digits", "word_chars") > 0.3),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good | votes) of each pattern (rows of -1, 0, 1); the share of each class; the rate of each vote (class, rule, vote) by EM.

    A text is good, or bad in the way that one of the rules looks for: class 0, then one class for each rule. Within
    a class rules vote independently of each other. EM estimates how often each rule votes against, abstains and votes
    for the texts of each class: its detection rate is that against its own kind, its false alarms those against good
    ones. It starts where each rule finds DETECTION of its kind and accuses FALSE_ALARM of all others; that start
    stays in the estimates as PSEUDO_TEXTS texts a class, so that it fades as texts come in. A rule is better than
    chance: one that accuses its kind no more often than good texts has the rates of good texts there. Of a rule that
    never votes for a text nothing tells false alarms from detections where the other votes don't: there at most MOST_WRONG
    of the texts that it accuses are taken to be good ones, in a small table as in a large one. Rules that
    accuse more than MOST_AGAINST of all texts are taken to abstain.
    """
    n_rules = patterns.shape[1] if patterns.ndim == 2 else 0
    if not len(patterns):
        return np.zeros(0), np.zeros(n_rules + 1), np.zeros((n_rules + 1, n_rules, 3))
    n = counts.sum()
    against = np.array([counts[patterns[:, j] == -1].sum() for j in range(n_rules)]) / n
    votes = np.where(against > MOST_AGAINST, 0, patterns) + 1
    accused = np.maximum(np.array([counts[votes[:, j] == 0].sum() for j in range(n_rules)]) / n, 1e-9)
    favours = (votes == 2).any(0)
    belief = np.empty((n_rules + 1, n_rules, 3))
    for k in range(n_rules + 1):
        for j in range(n_rules):
            bad = DETECTION if k == j + 1 else FALSE_ALARM
            belief[k, j] = (bad, (1 - bad) / 2, (1 - bad) / 2) if favours[j] else (bad, 1 - bad - 1e-6, 1e-6)
    first = np.r_[FIRST_GOOD, np.full(n_rules, (1 - FIRST_GOOD) / max(n_rules, 1))]
    rates, share, last = belief.copy(), first.copy(), None
    for _ in range(rounds):
        odds = np.log(share)[:, None] + sum(np.log(rates[:, j])[:, votes[:, j]] for j in range(n_rules))
        classes = np.exp(odds - odds.max(0))
        classes /= classes.sum(0)
        if last is not None and np.abs(classes - last).max() < 1e-7:
            break
        last = classes
        weight = classes * counts
        total = weight.sum(1)
        share = (total + PSEUDO_TEXTS * first) / (n + PSEUDO_TEXTS)
        for j in range(n_rules):
            for v in range(3):
                rates[:, j, v] = (weight[:, votes[:, j] == v].sum(1) + PSEUDO_TEXTS * belief[:, j, v]) / (total + PSEUDO_TEXTS)
            if rates[j + 1, j, 0] < rates[0, j, 0]:
                rates[j + 1, j] = rates[0, j]
            most = MOST_WRONG * accused[j] / share[0]
            if not favours[j] and rates[0, j, 0] > most:
                rates[0, j] = (most, *(rates[0, j, 1:] * (1 - most) / (1 - rates[0, j, 0])))
    return classes[0], share, rates


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, measures, base_failed, votes, quality (posterior), kept.

    Measures cover the whole text; a null text has no words and fails the base rules. The votes of all
    texts are counted by pattern, of which there are at most 3 ** rules, and EM runs over those counts;
    nothing else leaves the executors. kept is false where the base rules fail, else quality >= KEEP_AT.
    Rows are measured one by one: repeated rows repeat their result and null ids stay null; an empty
    table gives an empty result. Other columns of docs play no part.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame(measure(encoded(pdf["text"])), columns=_FEATURES)
            found.insert(0, "id", pdf["id"].to_numpy())
            yield found

    measured = map_named(docs, id_col, text_col, run, ", ".join(f"{c} long" for c in _FEATURES))
    rules = votes()
    voted = cut(measured.select("id", *_FEATURES, F.concat_ws(",", *(v.cast("string") for v in rules.values())).alias("votes")))
    seen = voted.groupBy("votes").count().orderBy("votes").collect()
    patterns = np.array([[int(x) for x in r["votes"].split(",")] for r in seen]).reshape(len(seen), len(rules))
    good = fit_votes(patterns, np.array([float(r["count"]) for r in seen]))[0]
    verdicts = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, good)], "votes string, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.join(F.broadcast(verdicts), "votes", "left")
    return judged.select(
        F.col("id").alias(id_col), *_FEATURES, failed.alias("base_failed"), "votes", "quality",
        (~failed & (F.col("quality") >= KEEP_AT)).alias("kept"),
    )
