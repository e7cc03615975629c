"""Cases that a cut in an operator would lose."""

import numpy as np

from brindle.llm import near_dedup, pii, quality


def test_ibans_before_capitals_and_digits(spark):
    spaced, compact = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    cases = [
        (f"IBAN {compact} The bank", [compact]), (f"IBAN {spaced} Please pay", [spaced]), (f"IBAN {spaced} BIC COBADEFF", [spaced]), (f"IBAN {spaced} 2024", [spaced]),
        (f"bank {compact} X", [compact]), (f"bank AB12 {spaced}.", [spaced]), ("bank NO9386011117947 BE68539007547034 A", ["NO9386011117947", "BE68539007547034"]),
        ("🙂 account MT84 MALT 0110 0001 2345 MTLC AST0 01S BIC", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]), (f"bank {compact}x", []), (f"bank {compact}0", []), (f"bank x{compact}", []),
        ("bank DE89370400440532013001 The", []), ("bank " + "DE89 " * 2000 + compact + " A", [compact]), ("", []), (None, []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["iban"]] for r in pii.find(docs).select("doc_id", "iban").collect()}
    for i, (text, want) in enumerate(cases):
        assert [text[a:b] for a, b in got[i]] == want, text


def test_near_copies_with_other_repeat_counts(spark):
    """Pairs of set similarity over 0.8 whose common passage stands 60 times in one text."""
    rows = []
    for k in range(80):
        passage = [f"p{k}x{i}" for i in range(20)]
        rest = [f"r{k}x{i}" for i in range(90)]
        other = [f"o{k}x{i}" for i in range(12)]
        rows.append((2 * k, " ".join(passage + rest)))
        rows.append((2 * k + 1, " ".join(passage * 60 + rest + other)))
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a[1].split(), b[1].split()))
        assert len(x & y) >= 0.8 * len(x | y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_training_steps_at_every_size(monkeypatch):
    """One row more doesn't halve the steps."""
    made, real = [], np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.own = real(seed)

        def normal(self, *args):
            return self.own.normal(*args)

        def permutation(self, n):
            made.append(-(-n // 256))
            return self.own.permutation(n)

    monkeypatch.setattr(quality.np.random, "default_rng", Counted)
    for n in (300, 3999, 4000, 8000):
        made.clear()
        quality.fit(np.arange(n) % 2.0, np.arange(n + 1), np.arange(n) % 2, np.ones(n, np.float32))
        assert 400 <= sum(made) < 400 + -(-n // 256), n
