"""Text columns: identity, hash buckets, words, n-grams, lines, shares, parsers."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@cache
def changed_by_nfc() -> str:
    """A character class of what composition may change: marks, jamo and characters that
    aren't their own composed form."""
    odd = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    ranges: list[list[int]] = []
    for c in odd:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return r"[\p{M}\x{1100}-\x{11FF}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    some = text.notna()
    return text.mask(some, text[some].map(lambda t: unicodedata.normalize("NFC", t))) if some.any() else text


def nfc(text: Column) -> Column:
    """Composed form; only texts that composition may change leave the JVM (characters below
    U+0300 are their own composed form)."""
    return F.coalesce(_compose(F.when(text.rlike(r"[\x{300}-\x{10FFFF}]") & text.rlike(changed_by_nfc()), text)), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Words by any white space, one space between."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def content_key(text: Column) -> Column:
    """SHA-256 of the composed text with its white space collapsed."""
    return F.sha2(collapse(nfc(text)), 256)


def hash_mod(key: Column, digits: int, modulus: int) -> Column:
    """The first ``digits`` (8 or 16) hex digits of a key as an unsigned number, modulo."""
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    if digits == 8:
        return high % modulus
    low = F.conv(F.substring(key, 9, 8), 16, 10).cast("long")
    return ((high % modulus) * ((1 << 32) % modulus) + low) % modulus


def corpus_split(key: Column) -> Column:
    """Buckets of 10000 below 100, 200 and 300 are held back."""
    bucket = hash_mod(key, 16, 10_000)
    return F.when(bucket < 100, "final").when(bucket < 200, "validation").when(bucket < 300, "tokenizer_dev").otherwise("train")


def group_split(group: Column, salt: str, modulus: int, dev: int, test: int) -> Column:
    """Split of a group by the salted hash: the first ``dev`` buckets, then up to ``test``."""
    bucket = hash_mod(F.sha2(F.concat(F.lit(salt + ":"), group), 256), 8, modulus)
    return F.when(bucket < dev, "dev").when(bucket < test, "test").otherwise("train")


def norm(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_list(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: a lambda's variable is bound, while
    an expression that a lambda mentions would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def gram_list(words: Column, n: int) -> Column:
    """Every run of n words, joined by spaces, in order."""
    def runs(own: Column) -> Column:
        last = F.size(own) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, F.lit(n)), " "))

    return let(words, runs)


def gram_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of every run of n words, in order; each word is hashed once."""
    def runs(own: Column) -> Column:
        last = F.size(own) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(own, i, F.lit(n))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def casefolded(text: Column) -> Column:
    """Runs of letters, digits and underscores of the case-folded text, one space between
    (folding as far as lower-casing and ß go)."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(text), "ß", "ss"), F.lit(r"(?U)\w+"), F.lit(0)), " ")


def repeat_share(grams: Column) -> Column:
    """1 - distinct / all; 0 for none."""
    return let(grams, lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0))


def most_repeated(grams: Column) -> Column:
    """How often the commonest entry occurs, by the runs of the sorted array."""
    def longest(g: Column) -> Column:
        state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
        def step(s: Column, i: Column) -> Column:
            run = F.when((i > 0) & (F.get(g, i) == F.get(g, i - 1)), s["run"] + 1).otherwise(F.lit(1))
            return F.struct(run.alias("run"), F.greatest(s["most"], run).alias("most"))

        return F.when(F.size(g) > 0, F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), state, step, lambda s: s["most"])).otherwise(0)

    return let(F.array_sort(grams), longest)


#: Repetition rules: name, size of the runs, how often the commonest of them may not come.
LOOPS = (("trigram_loop", 3, 4), ("fourgram_loop", 4, 3), ("fivegram_loop", 5, 3), ("target_8gram", 8, 3), ("curriculum_5gram", 5, 2))
UNIT_LOOP = r"([A-Za-z]{2,12})\1{4,}"


def repetitions(text: Column) -> Column:
    """Whether each rule of repetition holds, as a struct: a commonest run (``LOOPS``), a share
    of repeated runs (``generated``), a short text's run (``short_4gram``), a unit of 2 to 12
    letters five times in a row (``unit_loop``).  Words are bound once and the runs of each
    size hashed and sorted once."""
    sizes = sorted({n for _, n, _ in LOOPS})
    extra = lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.greatest(F.size(g), F.lit(1))
    measure = lambda n, g: F.struct(most_repeated(g).alias("most"), (extra(g) if n == 4 else F.lit(0.0)).alias("extra"))

    def rules(words: Column) -> Column:
        of = lambda n: let(gram_hashes(words, n), lambda g: measure(n, g))
        return let(F.struct(F.size(words).alias("words"), *[of(n).alias(f"n{n}") for n in sizes]), named)

    def named(m: Column) -> Column:
        most = {name: m[f"n{n}"]["most"] >= times for name, n, times in LOOPS}
        return F.struct(*[c.alias(name) for name, c in most.items()], (m["n4"]["extra"] > 0.2).alias("generated"), ((m["words"] >= 12) & most["fourgram_loop"]).alias("short_4gram"), text.rlike(UNIT_LOOP).alias("unit_loop"))

    return let(word_list(norm(text)), rules)


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def ascii_letter_share(text: Column) -> Column:
    """ASCII letters among letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / letters)


#: Characters that Spark's ``upper`` turns into several, and the one that stands for each as a
#: capital (itself, where there is none).
_SEVERAL = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
_CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL}


def capitalised(text: Column) -> Column:
    """A text with its first character as a capital, always one character."""
    first = F.substring(text, 1, 1)
    one = F.translate(first, "".join(_CAPITALS), "".join(_CAPITALS.values()))
    return F.concat(F.when(F.length(F.upper(first)) > 1, one).otherwise(F.upper(first)), F.substring(text, F.lit(2), F.length(text)))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != ""))


def url_key(url: Column) -> Column:
    """Lower-case host without www., path without trailing slashes, and the query."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def provenance_keys(text: Column, own_id: Column | None = None, url: Column | None = None, nested_id: Column | None = None, nested_url: Column | None = None) -> Column:
    """Keys that a text shares with what it was made from: its content, and the id and URL of
    its row (else of its metadata), each hashed as content is."""
    nothing = F.lit(None).cast("string")
    first = lambda a, b: F.coalesce(*[F.when(strip(x) != "", strip(x)) for x in (a, b) if x is not None], nothing)
    page = url_key(first(url, nested_url))
    keys = [("content:", text), ("id:", first(own_id, nested_id)), ("url:", page)]
    return F.array_compact(F.array(*[F.concat(F.lit(name), content_key(value)) for name, value in keys]))


#: Articles that answers are compared without.
ARTICLES = ("a", "an", "the")


def qa_words(text: Column) -> Column:
    """The words of an answer, articles left out."""
    return filter_words(word_list(norm(text)), ARTICLES)


def filter_words(words: Column, without: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*without))


def token_f1(words: Column, reference: Column) -> Column:
    """F1 of the common words, counted as often as both have them; 0 if none is common."""
    times = lambda own, w: F.size(F.filter(own, lambda x: x == w))
    common = F.aggregate(F.array_distinct(words), F.lit(0), lambda n, w: n + F.least(times(words, w), times(reference, w)))
    return F.when(common > 0, 2.0 * common / (F.size(words) + F.size(reference))).otherwise(0.0)


def judge_score(reply: Column) -> Column:
    """The number after a final [RESULT] mark, or null."""
    found = F.regexp_extract(reply, r"\[RESULT\]\s*\(?([1-9]|10)\)?\s*$", 1)
    return F.when(found != "", found.cast("int"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(80.0), loss))
