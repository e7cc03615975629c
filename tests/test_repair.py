"""repair_plans: rows of its batches are found without placing all rows, and texts are cut once."""

from brindle.operators import packing, select
from brindle.plans import builds
from brindle.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_no_row_is_placed_that_no_batch_reaches(spark, monkeypatch):
    """Placing sorts all rows, and reads their texts once more to find the ranges."""

    def refuse(*_):
        raise AssertionError("all rows were placed")

    monkeypatch.setattr(select, "offsets", refuse)
    monkeypatch.setattr(packing, "offsets", refuse)
    assert QUERIES["repair_plans"](spark, SF).count() > 0


def test_sentences_are_cut_once_and_wordings_parsed_apart(spark):
    plan = builds.asked_rows(spark, SF).select("doc_id", "checks", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 1
    assert "Aggregate [lead" in plan


def test_replay_begins_again_and_leaves_out_what_is_not_whole(spark):
    head = lambda n, k: select.first_places(spark.createDataFrame([(i, f"{(i * 37) % 101:03d}") for i in range(n)], "id long, h string").repartition(3), ["h"], k)
    order = lambda n: sorted(range(n), key=lambda i: f"{(i * 37) % 101:03d}")
    assert [(r["id"], r["place"]) for r in head(50, 7).orderBy("place").collect()] == [(i, k) for k, i in enumerate(order(50)[:7])]
    for fresh, pool in ((50, 40), (30, 5), (3, 5), (0, 5), (9, 1)):
        got = builds.with_replay(head(fresh, 4 * 8), [(head(pool, 2 * 8), spark.range(pool).selectExpr("count(*) as n"))], 4, 2, 8)
        whole = [b for b in range(8) if 4 * b + 4 <= fresh]
        want = [(b, 0, i) for b in whole for i in order(fresh)[4 * b : 4 * b + 4]] + [(b, 1, order(pool)[(2 * b + j) % pool]) for b in whole for j in range(2)]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
