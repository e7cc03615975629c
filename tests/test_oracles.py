"""Every query with an oracle against DuckDB on the smallest tables; the others by rules."""

import duckdb
import pytest

import __spark_entry__
from brindle.operators import evaluate
from brindle.plans import evaluation
from brindle.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


def plain(value):
    return "null" if value is None else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(names) == order
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in order) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_paired_tests(spark):
    from math import comb

    for r in QUERIES["paired_tests"](spark, SF).collect():
        n, low = r["gained"] + r["lost"], min(r["gained"], r["lost"])
        assert r["p"] == pytest.approx(min(1, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n))


def test_paired_bootstrap(spark):
    r = QUERIES["paired_bootstrap"](spark, SF).collect()[0]
    deltas = [x["delta"] for x in evaluation.changes(spark, SF).collect()]
    n, mean = len(deltas), sum(deltas) / len(deltas)
    error = (sum((d - mean) ** 2 for d in deltas) / n / n) ** 0.5
    assert (r["n"], r["delta"]) == (n, pytest.approx(mean))
    assert r["low"] == pytest.approx(mean - 1.96 * error, abs=0.5 / n + 0.3 * error)
    assert r["high"] == pytest.approx(mean + 1.96 * error, abs=0.5 / n + 0.3 * error)


def test_poisson_weights(spark):
    from math import exp, factorial

    steps = evaluate.poisson_steps()
    assert [s / 65536 for s in steps[:4]] == pytest.approx([sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(4)], abs=2e-5)
    none = evaluate.bootstrap(spark.createDataFrame([(1, None)], "id long, x double"), "x", "id")
    assert none.count() == 0
    same = evaluate.bootstrap(spark.createDataFrame([(i, 2.5) for i in range(30)], "id long, x double"), "x", "id", draws=40).collect()[0]
    assert (same["n"], same["delta"], same["low"], same["high"]) == (30, 2.5, 2.5, 2.5)
