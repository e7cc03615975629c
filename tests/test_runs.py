"""Shared runs of words: hashed in bulk, dropped by a bit table where they are made, told by a join."""

import re

from brindle.functions import runs
from brindle.operators import select

LONG = " ".join(f"w{i}" for i in range(400_000))
TEXTS = [
    None, "", " \n\t ", "--- !!", "one two", "One, two. THREE", "one  two\u00a0three four", "x one two thre\u00e9 four", "\u212aelvin \u0130stanbul stra\u00dfe caf\u00e9 au lait",
    "a b a b a b a b", "b a b", "end\x00of\x1fthe line", "line end of the line end of the", LONG, f"{LONG} one two three", "three four\nfive", "w399997 w399998 w399999 one two",
]
OTHERS = [None, "", "two three four", "kelvin i\u0307stanbul stra", "caf au lait", "B a B", "of the line", "w399999 one two", "w399998 w399999 x", "five three four"]


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def grams(text, n):
    own = words(text)
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}


def test_runs_are_those_of_the_texts(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(TEXTS)], "id int, kind string, text string").repartition(3)
    for n in (1, 2, 3, 13):
        got = select.grams_of(rows, "id", "text", n, "kind").collect()
        want = {i: grams(t, n) for i, t in enumerate(TEXTS)}
        assert len(got) == sum(map(len, want.values()))
        assert len({r["gram"] for r in got}) == len(set().union(*want.values()))
        assert all(r["kind"] == f"s{r['id'] % 3}" for r in got)


def test_overlaps_by_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    for others in (OTHERS, [None], [LONG]):
        frame = spark.createDataFrame(list(enumerate(others)), "item long, text string")
        wanted = set().union(*[grams(t, 3) for t in others])
        got = sorted(r["id"] for r in select.overlapping(rows, "id", frame, n=3).collect())
        assert got == [i for i, t in enumerate(TEXTS) if grams(t, 3) & wanted]


def test_runs_are_dropped_before_the_join(spark):
    """Runs that no other text has aren't rows of a generator, and never reach the join."""
    rows = spark.createDataFrame([(1, LONG), (2, "two three four")], "id long, text string")
    others = spark.createDataFrame([(1, "one two three four")], "item long, text string")
    found = select.overlapping(rows, "id", others, n=3)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    table = select.bits_of(select.grams_of(others, "item", "text", 3))
    assert table.nbytes == 2 << 20 and sum(int(x).bit_count() for x in table) == 2
    among = spark.sparkContext.broadcast(table)
    assert select.grams_of(rows, "id", "text", 3, among=among).count() < 10


def test_pieces_hold_all_rows():
    import pyarrow as pa

    texts = pa.array([None, "a" * (3 << 20), "b", None, "c" * (1 << 20), "d" * (1 << 20), "e"])
    got = list(runs.pieces(texts))
    assert [k for low, high in got for k in range(low, high)] == list(range(7)) and len(got) > 2
