"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is a column expression: a text is split by a pattern, the matches between the
pieces are extracted, and running lengths give each match its place in code points.
Patterns never retry inside a run that failed (possessive repeats, and a look behind for
the start of a run), running lengths are summed by doubling steps (no list grows match by
match), and context is cut from blocks of ``BLOCK`` characters, so time is linear in the text
and n log n in its spans; a cheap test comes before each pattern.

Base kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15
digits).  Added kinds: iban (mod 97) and ssn (three, two and four digits beside a context
word).  An iban's end isn't plain from its start, as capitals and digits may follow after a
space: the pattern takes the first four characters and looks ahead over at most 34, every
end of a group there is tried, and the next search starts behind the four, so a start that
fails hides none.  Each span has a score: the kind's own, raised if one of the kind's context words is
near.  Base spans stay whatever their score; an added span needs ``THRESHOLD``.

Cases: null and empty texts have no spans; very long texts are searched whole; repeated rows
are reported alike; spans of different kinds may overlap (ties stay, in the kinds' order); an
empty table has no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
RAISE = 0.35
THRESHOLD = 0.5
#: Characters of a block of text.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this isn't searched.
    hint: str
    score: float
    context: str
    base: bool = True


#: The base patterns, written so that a failed run isn't tried again.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, "ip|address|server|host|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", 0.6, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.5, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|transfer", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.2, "ssn|social|security|tax", False),
)

#: Registered lengths of account numbers; they only choose among ends that pass mod 97.
LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, join) -> Column:
    """What ``join`` (of two neighbours) makes of all values up to each place."""

    def doubled(v: Column) -> Column:
        steps = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def once(s: Column, j: Column) -> Column:
            return let(F.pow(F.lit(2), j).cast("int"), lambda far: F.transform(s, lambda x, i: F.when(i >= far, join(F.get(s, i - far), x)).otherwise(x)))

        return F.aggregate(steps, v, once)

    return let(values, doubled)


def apart(spans: Column) -> Column:
    """Spans (start, end) in order without those that start inside one that stays.

    A span that starts behind all ends before it begins a run; only runs are gone through."""

    def chosen(s: Column) -> Column:
        ends = scanned(F.transform(s, lambda x: x["end"]), F.greatest)
        first = let(ends, lambda e: F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(e, i - 1)), i).otherwise(-1)))

        def stays(g: Column, i: Column) -> Column:
            state = F.struct(F.lit(0).alias("until"), F.lit(True).alias("stays"))
            step = lambda t, k: F.when(F.get(s, k)["start"] >= t["until"], F.struct(F.get(s, k)["end"].alias("until"), F.lit(True).alias("stays"))).otherwise(F.struct(t["until"].alias("until"), F.lit(False).alias("stays")))
            return F.aggregate(F.sequence(g, i), state, step, lambda t: t["stays"])

        return let(scanned(first, F.greatest), lambda g: F.filter(s, lambda x, i: stays(F.get(g, i), i)))

    return let(spans, chosen)


def in_blocks(text: Column) -> Column:
    """A text as a list of blocks of ``BLOCK`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end``, from the blocks that hold them alone."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    few = F.transform(F.sequence(first, last), lambda i: F.get(blocks, i))
    return F.when(end > start, F.substring(F.array_join(few, ""), start - first * BLOCK + 1, end - start)).otherwise("")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number's letters and digits leave 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def account(proposal: Column) -> Column:
    """The account number that ``proposal`` starts with, or null: of its ends of groups that
    pass mod 97 the one of the country's length, else the last."""
    groups = F.split(proposal, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    plain = lambda p: F.regexp_replace(p, " ", "")
    good = F.filter(starts, lambda p: F.when(plain(p).rlike("^[A-Z0-9]{15,34}$"), mod97(p)).otherwise(False))
    known = lambda p: F.contains(F.lit(LENGTHS), F.concat(F.substring(p, 1, 2), F.length(plain(p)).cast("string")))
    return F.array_max(F.transform(good, lambda p: F.struct(known(p).alias("known"), F.length(p).alias("size"), p.alias("match"))))["match"]


def accounts(placed: Column) -> Column:
    """Proposals cut to their account numbers; one that starts inside another is dropped."""
    held = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), account(s["match"]).alias("match")))
    held = F.filter(held, lambda s: s["match"].isNotNull())
    whole = F.transform(held, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match")))
    return apart(whole)


def confirmed(kind: str, match: Column) -> Column:
    """The checksum or count that a match of this kind must pass."""
    n = F.length(digits(match))
    if kind == "ip":
        plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: an array of struct(kind, start, end, score)."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    proposed = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)) if kind.name == "iban" else matches

    pairs = F.arrays_zip(matches.alias("match"), proposed.alias("proposed"), F.slice(pieces, F.lit(1), F.size(matches)).alias("gap"))
    ends = lambda p: scanned(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["match"])), lambda x, y: x + y)
    place = lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["proposed"].alias("match"))
    placed = let(pairs, lambda p: let(ends(p), lambda e: F.transform(p, lambda x, i: place(x, F.get(e, i)))))
    good = accounts(placed) if kind.name == "iban" else F.filter(placed, lambda s: confirmed(kind.name, s["match"]))

    def scored(s: Column, blocks: Column, size: Column) -> Column:
        before = cut(blocks, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"])
        after = cut(blocks, s["end"], F.least(s["end"] + NEAR, size))
        near = F.lower(F.concat_ws(" ", before, after)).rlike(rf"(?<![a-z0-9])(?:{kind.context})")
        score = F.round(F.least(F.lit(kind.score) + F.when(near, RAISE).otherwise(0.0), F.lit(1.0)), 2)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    whole = lambda good: let(F.struct(in_blocks(text).alias("b"), F.length(text).alias("n")), lambda t: F.transform(good, lambda s: scored(s, t["b"], t["n"])))
    found = let(good, lambda g: F.when(F.size(g) > 0, whole(g)).otherwise(none))
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.hint), found).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, its array of spans (kind, start, end, score)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *[spans(F.col("text"), k).alias(k.name) for k in KINDS])


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans of these kinds, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(F.col(k), one) for k in kinds]), ",")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets; of
    overlapping spans the one that starts first (then the longer) is replaced."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = F.array_sort(F.concat(*[spans(F.col("text"), k) for k in KINDS]), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def redacted(t: Column) -> Column:
        before = lambda own, i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        shown = lambda own: F.transform(own, lambda s, i: F.concat(cut(t["b"], before(own, i), s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        return let(apart(every), lambda own: F.concat(F.array_join(shown(own), ""), cut(t["b"], before(own, F.size(own)), t["n"])))

    return rows.select("doc_id", let(F.struct(in_blocks(F.col("text")).alias("b"), F.length("text").alias("n")), redacted).alias("text"))
