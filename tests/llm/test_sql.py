"""The queries of the package beside their SQL, on whole tables."""

import duckdb
import pytest

from brindle.llm import queries

ORACLES = queries.oracle_sql()


def plain(value):
    return "null" if value is None else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name, sf):
    folder, db = f"/root/testdata/sf{sf}", duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got = queries.queries()[name](spark, folder)
    order = sorted(got.columns)
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == order
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in order) for r in want)
