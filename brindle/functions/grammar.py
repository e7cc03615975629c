"""A small grammar: stems by suffix rules, and whether a sentence has a finite verb.

Stems come from one table of (ending, replacement, least letters before it), the first that
fits.  Tags come from a hidden Markov model whose weights are a table: words of closed classes
have their tags, other words those that their ending allows, and the best sequence of tags is
found by Viterbi's algorithm, for many sentences at a time.  A sentence is finite if a present
verb or a modal stands somewhere after a noun or a pronoun.  This is a screen of the form, by
rules of our own, not a parser.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Ending, what comes in its place, letters before it at least.
ENDINGS = (
    ("ational", "ate", 3), ("iveness", "ive", 3), ("fulness", "ful", 3), ("ousness", "ous", 3), ("ization", "ize", 3), ("ements", "", 4), ("ation", "ate", 3), ("ments", "", 4), ("nesses", "", 3),
    ("ingly", "", 3), ("edly", "", 3), ("ness", "", 3), ("ment", "", 4), ("ings", "", 3), ("sses", "ss", 1), ("ies", "y", 2), ("ied", "y", 2), ("ing", "", 3), ("est", "", 4), ("ed", "", 3), ("ly", "", 3), ("es", "e", 3), ("ss", "ss", 1), ("s", "", 3),
)

TAGS = ("noun", "pronoun", "present", "modal", "past", "base", "determiner", "adjective", "adverb", "preposition", "conjunction", "mark")
NOUN, PRONOUN, PRESENT, MODAL, PAST, BASE, DETERMINER, ADJECTIVE, ADVERB, PREPOSITION, CONJUNCTION, MARK = range(len(TAGS))
#: Words of closed classes.
CLOSED = {
    PRONOUN: "i you he she it we they him her them us me who which what something nothing everyone someone".split(),
    PRESENT: "am is are has have do does says goes means seems".split(),
    MODAL: "can could may might must shall should will would cannot".split(),
    PAST: "was were had did said went made came took gave".split(),
    DETERMINER: "the a an this that these those my your his its our their some any no each every".split(),
    PREPOSITION: "of in on at to for by with from into onto over under through between against about after before during without".split(),
    CONJUNCTION: "and or but nor so yet if because when while though although than as".split(),
    ADVERB: "not very also too then there here now never always often soon just".split(),
}
#: Ending of other words and the weights of their tags; the first that fits.
BY_ENDING = (
    ("ly", {ADVERB: 0.0, ADJECTIVE: -2.0}), ("ing", {NOUN: -0.7, BASE: -1.0, ADJECTIVE: -1.2}), ("ed", {PAST: -0.3, ADJECTIVE: -1.5}), ("ous", {ADJECTIVE: 0.0}), ("ful", {ADJECTIVE: 0.0}), ("ive", {ADJECTIVE: -0.3, NOUN: -1.5}),
    ("ss", {NOUN: -0.2, ADJECTIVE: -1.5}), ("s", {NOUN: -0.7, PRESENT: -0.9}), ("", {NOUN: -0.5, ADJECTIVE: -1.6, BASE: -1.8, PRESENT: -2.0}),
)
#: Weights of one tag after another; others have ``UNLIKELY``.
AFTER = {
    DETERMINER: {NOUN: -0.3, ADJECTIVE: -1.2}, ADJECTIVE: {NOUN: -0.3, ADJECTIVE: -2.0, CONJUNCTION: -2.0, MARK: -2.0}, PRONOUN: {PRESENT: -0.7, MODAL: -1.0, PAST: -0.8, ADVERB: -2.2, MARK: -2.0},
    NOUN: {PRESENT: -1.2, MODAL: -2.0, PAST: -1.2, PREPOSITION: -1.2, CONJUNCTION: -1.8, NOUN: -2.2, MARK: -1.2, ADVERB: -2.5}, MODAL: {BASE: -0.3, ADVERB: -1.8, PRONOUN: -2.5},
    PRESENT: {DETERMINER: -1.0, NOUN: -1.8, ADJECTIVE: -1.6, PREPOSITION: -1.5, ADVERB: -1.6, PAST: -2.0, PRONOUN: -1.8, MARK: -2.0}, PAST: {DETERMINER: -1.0, NOUN: -1.8, PREPOSITION: -1.0, ADVERB: -1.8, PRONOUN: -1.8, MARK: -1.6},
    BASE: {DETERMINER: -0.9, NOUN: -1.6, PREPOSITION: -1.4, PRONOUN: -1.6, MARK: -1.6}, ADVERB: {ADJECTIVE: -1.0, PRESENT: -1.6, PAST: -1.6, BASE: -1.8, ADVERB: -2.0, MARK: -1.8}, PREPOSITION: {DETERMINER: -0.7, NOUN: -1.0, ADJECTIVE: -1.8, PRONOUN: -1.8},
    CONJUNCTION: {NOUN: -1.4, DETERMINER: -1.2, PRONOUN: -1.4, ADJECTIVE: -1.8, PRESENT: -2.2, BASE: -2.4}, MARK: {NOUN: -1.6, DETERMINER: -1.2, PRONOUN: -1.4, CONJUNCTION: -1.6, ADVERB: -2.2},
}
UNLIKELY, NEVER = -5.0, -1e9
#: Weights of the first tag are those after a mark.
TRANSITION = np.full((len(TAGS), len(TAGS)), UNLIKELY)
for _tag, _next in AFTER.items():
    for _other, _weight in _next.items():
        TRANSITION[_tag, _other] = _weight
TOKEN = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?|[^\w\s]")
_CLOSED = {word: tag for tag, words in CLOSED.items() for word in words}
#: Cells of a table of sentences by places that is filled at once.
CELLS = 1 << 16


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    n = F.length(word)
    rules = [F.when(word.endswith(end) & (n >= len(end) + least), F.concat(F.substring(word, F.lit(1), n - len(end)), F.lit(new))) for end, new, least in ENDINGS]
    return F.coalesce(*rules, word)


def emission(token: str) -> np.ndarray:
    """The weight of each tag of a token."""
    out, word = np.full(len(TAGS), NEVER), token.lower()
    if not token[0].isalpha():
        out[MARK] = 0.0
    elif word in _CLOSED:
        out[_CLOSED[word]] = 0.0
    else:
        for tag, weight in next(tags for end, tags in BY_ENDING if word.endswith(end)).items():
            out[tag] = weight
    return out


def best_tags(weights: np.ndarray) -> np.ndarray:
    """The best tags of sentences of one length, from weights by sentence, place and tag."""
    n, size, _ = weights.shape
    came = np.zeros((n, size, len(TAGS)), np.int8)
    score = weights[:, 0] + TRANSITION[MARK]
    for t in range(1, size):
        ways = score[:, :, None] + TRANSITION
        came[:, t] = ways.argmax(axis=1)
        score = ways.max(axis=1) + weights[:, t]
    tags = np.zeros((n, size), np.int64)
    tags[:, -1] = score.argmax(axis=1)
    for t in range(size - 1, 0, -1):
        tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
    return tags


def finite(sentences: list[str]) -> np.ndarray:
    """Whether each sentence has a present verb or a modal after a noun or a pronoun."""
    tokens = [TOKEN.findall(s) for s in sentences]
    known: dict[str, int] = {}
    codes = [[known.setdefault(t, len(known)) for t in own] for own in tokens]
    table = np.array([emission(t) for t in known]).reshape(-1, len(TAGS))
    sizes, out = np.array([len(c) for c in codes], np.int64), np.zeros(len(sentences), dtype=bool)
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        for part in np.array_split(own, -(-len(own) * size // CELLS)):
            tags = best_tags(table[np.array([codes[i] for i in part])])
            subject = np.cumsum(np.isin(tags, (NOUN, PRONOUN)), axis=1)
            verb = np.isin(tags, (PRESENT, MODAL))
            out[part] = (verb[:, 1:] & (subject[:, :-1] > 0)).any(axis=1)
    return out


#: Characters of sentences whose words are held at once; a longer text is taken alone.
CHARACTERS = 1 << 20


def runs(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """First and last of runs of texts that have ``limit`` characters at most, or one text."""
    ends, out, first = np.cumsum(sizes), [], 0
    while first < len(sizes):
        begun = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, begun + limit, side="right")))
        out.append((first, last))
        first = last
    return out


@F.pandas_udf(IntegerType())
def finite_count(sentences: pd.Series) -> pd.Series:
    """How many of each row's sentences (an array) are finite; sentences are tagged some at a
    time, so that the words of few are held, whatever the rows of a batch."""
    owner = np.repeat(np.arange(len(sentences)), [0 if s is None else len(s) for s in sentences])
    flat = [x or "" for s in sentences if s is not None for x in s]
    total = np.zeros(len(sentences), np.int64)
    for first, last in runs(np.fromiter(map(len, flat), np.int64, len(flat)), CHARACTERS):
        total += np.bincount(owner[first:last][finite(flat[first:last])], minlength=len(total))
    return pd.Series(total)
