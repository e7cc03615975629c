"""Streams and states, jobs, pools and samples: what no SQL can say."""

import difflib
import hashlib
import json
import os
import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from brindle import __main__ as command
from brindle.functions import sequence, sql
from brindle.operators import graph, jobs, screens, select
from brindle.sources import files
from brindle.streaming import run, source, stateful

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def test_journals_bear_a_torn_end_alone(spark, tmp_path):
    lines = [json.dumps({"id": x}) for x in "abc"]
    for name, body, want in (("end", "\n".join(lines) + '\n{"id": "d', ["a", "b", "c"]), ("whole", "\n".join(lines) + "\n", ["a", "b", "c"]), ("inside", lines[0] + '\n{"id": \n' + lines[2] + "\n", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "j.jsonl").write_text(body)
        if want is None:
            with pytest.raises(ValueError, match="broken line"):
                files.journal(spark, f"file://{tmp_path}/{name}", "id string")
        else:
            assert sorted(r["id"] for r in files.journal(spark, f"file://{tmp_path}/{name}", "id string").collect()) == want


def test_row_ranges_cross_files(spark, tmp_path):
    for k, (low, high) in enumerate(((0, 5), (5, 5), (5, 12), (12, 30))):
        spark.range(low, high, numPartitions=1).select("id", (F.col("id") * 2).alias("twice"), F.lit("x").alias("other")).write.parquet(f"file://{tmp_path}/made/{k}")
        (tmp_path / "t").mkdir(exist_ok=True)
        for f in (tmp_path / "made" / str(k)).glob("*.parquet"):
            f.rename(tmp_path / "t" / f"part-{k}.parquet")
    for first, last in ((3, 14), (100, 110), (0, 5), (12, 13), (29, 40)):
        got = files.row_range(spark, f"file://{tmp_path}/t", ["id", "twice"], first, last).collect()
        assert sorted(tuple(r) for r in got) == [(i, 2 * i, i) for i in range(first, min(last, 30))]


def test_pinned_tables_and_streams(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    spark.range(30).repartition(3).write.parquet(folder)
    revision = files.revision_of(spark, folder)
    assert len(revision) == 40
    assert files.pinned(spark, folder, revision).count() == 30
    stream = files.pinned(spark, folder, revision, stream=True)
    assert stream.isStreaming
    assert run.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check").count() == 30
    spark.range(1).write.mode("append").parquet(folder)
    with pytest.raises(ValueError, match="is at"):
        files.pinned(spark, folder, revision)


def test_samples_that_changed_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "part string, text string")
    path = f"file://{tmp_path}/s"
    files.write_sample(rows, path, 9, "part")
    assert files.write_sample(rows, path, 9, "part").count() == 2
    rows.filter("part = 'a'").select("text").write.mode("append").json(f"{path}/rows/part=a")
    with pytest.raises(ValueError, match="isn't the one"):
        files.write_sample(rows, path, 9, "part")


def test_saved_states(spark, tmp_path):
    folder = f"file://{tmp_path}/states"
    for step in range(4):
        kept = files.save_state(spark, folder, step, {"loss": abs(step - 1.2)}, keep=2)
    assert [(r["step"], r["best"]) for r in kept.orderBy("age").collect()] == [(3, False), (2, False)]


def shuffle_by_hand(places, capacity, seed, source):
    held, out, draws = [], [], 0
    for p in [*places, *[None] * len(places)]:
        if p is not None:
            held.append(p)
        if held and (p is None or len(held) > capacity):
            at = int(hashlib.sha256(f"{seed}:{source}:{draws}".encode()).hexdigest(), 16) % len(held)
            draws += 1
            held[at], held[-1] = held[-1], held[at]
            out.append(held.pop())
    return out


def in_parts(spark, path, rows, parts, plan, tasks=2):
    """A stream of the parts, each run from the same checkpoint."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = run.run_once(plan(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/check", tasks=tasks)
    return out


def test_shuffle_buffers_drain(spark, tmp_path):
    rows = [("a", i) for i in range(50)] + [("b", i) for i in range(7)]
    want = {s: shuffle_by_hand([p for x, p in rows if x == s], 10, "seed", s) for s in "ab"}
    frame = spark.createDataFrame(rows, "source string, place long")
    end = spark.createDataFrame([(None, None)], frame.schema)
    got = in_parts(spark, tmp_path, frame, [frame.filter("place < 13"), frame.filter("place >= 13"), end], lambda s: stateful.shuffle_buffer(s, 10, "seed")).collect()
    for s in "ab":
        own = sorted((r["turn"], r["place"]) for r in got if r["source"] == s)
        assert [p for _, p in own] == want[s] and [t for t, _ in own] == list(range(len(own)))


def test_migration_keeps_positions_and_counts_what_is_dropped(spark, tmp_path):
    frame = spark.createDataFrame([("a", i) for i in range(15)] + [("b", i) for i in range(3)], "source string, place long")
    in_parts(spark, tmp_path, frame, [frame], lambda s: stateful.shuffle_buffer(s, 10, "seed"))
    begun = stateful.shuffle_positions(spark, f"{tmp_path}/check", ["a", "b", "c"])
    assert sorted(map(tuple, begun.collect())) == [("a", 14, 10), ("b", 2, 3), ("c", None, 0)]
    with pytest.raises(ValueError, match="left out"):
        stateful.shuffle_positions(spark, f"{tmp_path}/check", ["a", "c"])
    more = frame.unionByName(spark.createDataFrame([("a", i) for i in range(15, 20)] + [("c", 1), (None, None)], frame.schema))
    got = in_parts(spark, tmp_path / "b", frame, [more], lambda s: stateful.shuffle_buffer(s, 10, "seed", begun.select("source", "position"))).collect()
    assert sorted((r["source"], r["place"]) for r in got) == [*(("a", i) for i in range(15, 20)), ("c", 1)]


def keyed(spark, rows):
    return spark.createDataFrame(rows, "place long, source string, reason string, keys array<string>")


def test_seen_keys_have_a_cap(spark, tmp_path):
    rows = keyed(spark, [(0, "s", None, ["a", "x"]), (1, "s", "short", ["b"]), (2, "t", None, ["x", "c"]), (3, "s", None, ["c"]), (4, "t", None, ["q"]), (5, "s", None, ["b"]), (6, "s", None, ["b", "b"])])
    late = keyed(spark, [(7, "s", None, ["c", "d"]), (8, "s", None, ["e"]), (9, "s", None, ["f"])])
    banned = spark.createDataFrame([("q",)], "key string")
    plan = lambda s: stateful.seen_set(s, 5, banned)
    got = in_parts(spark, tmp_path, rows, [rows], plan, tasks=1)
    want = ["accepted", "short", "duplicate", "accepted", "reference_overlap", "accepted", "duplicate"]
    assert [r["verdict"] for r in got.orderBy("place").collect()] == want
    counts = {(r["source"], r["verdict"]): r["n"] for r in stateful.seen_counts(spark, f"{tmp_path}/check").collect()}
    assert counts == {("s", "accepted"): 3, ("s", "short"): 1, ("t", "duplicate"): 1, ("t", "reference_overlap"): 1, ("s", "duplicate"): 1}
    with pytest.raises(Exception, match="more than 5 keys"):
        in_parts(spark, tmp_path, rows, [late], plan, tasks=1)
    assert spark.read.schema("place long, verdict string").parquet(f"{tmp_path}/out").count() == len(want)  # nothing of the failing batch
    assert {(r["source"], r["verdict"]): r["n"] for r in stateful.seen_counts(spark, f"{tmp_path}/check").collect()} == counts


def fifo_by_hand(keys, size):
    order, kept = [], []
    for i, k in enumerate(keys):
        if k not in order:
            order = [*order, k][-size:]
            kept.append((i, k))
    return kept


@pytest.mark.parametrize("size", [1, 3, 50])
def test_fifo_window_forgets_in_order(spark, tmp_path, size):
    r = random.Random(size)
    keys = [str(r.randrange(8 if size < 10 else 90)) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(keys)), "place long, key string")
    parts = [frame.filter("place < 50"), frame.filter("place between 50 and 60"), frame.filter("place > 60")]
    got = in_parts(spark, tmp_path, frame, parts, lambda s: stateful.fifo_dedup(s, size), tasks=1)
    assert sorted((x["place"], x["key"]) for x in got.collect()) == fifo_by_hand(keys, size)


def test_fifo_window_stores_what_changed(spark, tmp_path):
    """A batch of 10 rows writes about as many entries, whether the window has 100 or 4,000."""
    written = {}
    for size in (100, 4000):
        path = f"{tmp_path}/{size}"
        spark.range(5000).selectExpr("id as place", "cast(id as string) as key").coalesce(1).write.parquet(f"{path}/in")
        stream = stateful.fifo_dedup(spark.readStream.schema("place long, key string").parquet(f"{path}/in"), size)
        run.run_once(stream, f"{path}/out", f"{path}/check", tasks=1)
        spark.range(5000, 5010).selectExpr("id as place", "cast(id as string) as key").coalesce(1).write.mode("append").parquet(f"{path}/in")
        with run._settings(spark, 1, True):
            again = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        again.awaitTermination()
        written[size] = max(s["numRowsUpdated"] for p in again.recentProgress for s in p["stateOperators"])
    assert written[100] == written[4000] <= 30


def flaky(path):
    """Opens a file that fails once in the middle of each reading until a mark is there."""
    file, mark = source.open_file(path), f"{path}.failed"
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("gone")
    return file


def never(path):
    raise OSError("never there")


def test_source_goes_on_where_it_was(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * id as square").repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 512).parquet(f"{tmp_path}/in")
    options = {"rows": 30, "task_rows": 7, "pause": 0.01}
    stream = lambda **more: source.rows_stream(spark, f"{tmp_path}/in", "square long, id long", f"{tmp_path}/check", **(options | more))
    assert source.consumed(f"{tmp_path}/check") == 0
    assert run.drain(stream(), f"{tmp_path}/out", f"{tmp_path}/check", batches=2) is False
    done = source.consumed(f"{tmp_path}/check")
    assert 60 <= done < 100
    first = spark.read.parquet(f"{tmp_path}/out").filter("_metadata.file_path is not null")
    assert sorted(r["id"] for r in first.collect())[:60] == list(range(60))
    assert run.drain(stream(opener=f"{__name__}.flaky"), f"{tmp_path}/out", f"{tmp_path}/check") is True
    assert source.consumed(f"{tmp_path}/check") == 100
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("id", "square").collect())) == [(i, i * i) for i in range(100)]
    assert run.drain(stream(), f"{tmp_path}/out", f"{tmp_path}/check") is True  # an ended source isn't begun again
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    spark.range(5).selectExpr("id", "id as square").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="aren't those that the cursor was saved for"):
        run.drain(stream(), f"{tmp_path}/out", f"{tmp_path}/check")


def test_source_gives_up(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = source.rows_stream(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/check", opener=f"{__name__}.never", pause=0.01, attempts=3)
    with pytest.raises(Exception, match="never there"):
        run.drain(stream, f"{tmp_path}/out", f"{tmp_path}/check")


def test_reader_tries_again_with_growing_pauses(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import StructType

    pq.write_table(pa.table({"id": range(40)}), f"{tmp_path}/a.parquet", row_group_size=10)
    slept = []
    monkeypatch.setattr(source.time, "sleep", slept.append)
    reader = source.RowReader(StructType.fromDDL("id long"), {"path": str(tmp_path), "checkpoint": f"{tmp_path}/none", "attempts": 6, "opener": f"{__name__}.never"})
    with pytest.raises(OSError):
        reader.latestOffset()
    assert slept == [1, 2, 4, 8, 8]
    reader = source.RowReader(StructType.fromDDL("id long"), {"path": str(tmp_path), "checkpoint": f"{tmp_path}/none", "rows": 25})
    end = reader.latestOffset()
    assert (end, reader.latestOffset()) == (reader.offset(0, 25, 25), end)
    pieces = reader.partitions(reader.initialOffset(), end)
    assert [b for p in pieces for x in reader.read(p) for b in x["id"].to_pylist()] == list(range(25))
    last = reader.latestOffset()
    assert last["rows"] == 40 and [b for p in reader.partitions(end, last) for x in reader.read(p) for b in x["id"].to_pylist()] == list(range(25, 40))
    with pytest.raises(EOFError, match="exhausted after 40 rows"):
        reader.latestOffset()
    reader.wait = True
    assert reader.latestOffset() == last


def test_ancestors_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, True) for i in range(300)] + [(1000, None, False), (1001, 1000, True), (2000, 2001, True), (2001, 2000, True), (3000, 9999, True), (4000, 299, False), (4001, 4000, True)]
    got = {r["id"]: r["depth"] for r in graph.passing_depths(spark.createDataFrame(rows, "id long, parent long, passes boolean")).collect()}
    assert got == {i: i + 1 for i in range(300)}


def test_family_exposures(spark):
    r = random.Random(9)
    data = [(i, i // 3, r.sample(["x", "y", "z"], r.randint(1, 3))) for i in range(40)]
    got = [(x["turn"], x["family"], x["id"]) for x in select.family_exposures(spark.createDataFrame(data, "id long, grp long, families array<string>"), 50, "s").orderBy("turn").collect()]
    pools = {f: sorted((i for i, _, fs in data if f in fs), key=lambda i: hashlib.sha256(f"s:{f}:{i}".encode()).hexdigest()) for f in "xyz"}
    at, want = dict.fromkeys("xyz", 0), []
    for turn in range(50):
        f = "xyz"[turn % 3]
        batch = {i // 3 for t, _, i in want if t // 4 == turn // 4}
        while True:
            i = pools[f][at[f] % len(pools[f])]
            at[f] += 1
            if i // 3 not in batch:
                break
        want.append((turn, f, i))
    assert got == want


def test_preferences(spark):
    chosen = "the quick brown fox jumps over the old dog"
    cases = [("ok", "a wholly other answer stands in this place here", 2, {"a": 4, "b": 3}), ("strength", "other words", 0, {"a": 4}), ("rating", "other words here", 1, {"a": 2}), ("same", chosen, 1, {"a": 3}), ("short", "two words", 1, {"a": 3}), ("similar", chosen.replace("old", "new"), -1, {"a": 3})]
    rows = spark.createDataFrame([(w, chosen, x, s, r) for w, x, s, r in cases], "want string, chosen string, rejected string, strength int, ratings map<string,int>")
    reason = screens.preference_reason(F.col("chosen"), F.col("rejected"), strength=F.col("strength"), ratings=F.col("ratings"))
    for r in rows.select("want", reason.alias("got")).collect():
        assert r["want"] == r["got"]


def test_sequence_ratio_is_that_of_matching_blocks(spark):
    r = random.Random(3)
    for _ in range(400):
        kinds = r.choice([2, 3, 8, 50])
        a, b = ([str(r.randrange(kinds)) for _ in range(r.randrange(0, 40))] for _ in "ab")
        if r.random() < 0.4:
            b = [x for x in a for x in ((x, "new") if r.random() < 0.1 else (x,) if r.random() > 0.1 else ())]
        assert sequence.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), abs=1e-12)
    long = [f"w{int(r.paretovariate(0.6))}" for _ in range(20_000)]
    assert sequence.ratio(long, [w if i % 500 else "new" for i, w in enumerate(long)]) == pytest.approx(0.998)
    rows = spark.createDataFrame([("a b", None), (None, "a"), ("", ""), ("a b c", "a c")], "a string, b string")
    assert [x[0] for x in rows.select(sequence.sequence_ratio("a", "b")).collect()] == [None, None, 1.0, 0.8]


def test_copies_are_compared_whole(spark):
    got = QUERIES["copy_similarity"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got
    for r in got:
        own = difflib.SequenceMatcher(None, texts[r["doc_id"]].split(), texts[r["root"]].split(), autojunk=False).ratio()
        assert r["similarity"] == pytest.approx(own, abs=1e-6)


def test_json_objects_repeat_no_key(spark):
    cases = {
        '{"a":1}': 1, '```json\n{"a":1,"b":{"a":2}}\n```': 2, " {} ": 0, '{"a":1,"a":2}': None, '{"x":{"b":1,"b":2}}': None, "[1]": None, "1": None, '"s"': None, "null": None, '{"a":1} more': None, '{"a":1}{"b":2}': None,
        '{"a":1}]': None, '{"a":1}}': None, '{"a":1},{"b":2}': None, '{"a":1},"b":2': None, '{"a":1},"b"': None, '{"a":1,}': None, '{"a":tru': None, "": None, "```{\"a\": [1, 2]}```": 1, None: None,
    }
    rows = spark.createDataFrame([(t, n) for t, n in cases.items()], "body string, n int")
    found = rows.select("body", "n", F.when(screens.json_object(F.col("body")).isNotNull(), F.size(F.map_keys(screens.json_object(F.col("body"))))).alias("got"))
    for r in found.collect():
        assert r["got"] == r["n"], r["body"]
    assert "Python" not in QUERIES["json_objects"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def rarest_by_hand(rows, n):
    left, seen, out = dict(sorted(rows)), {}, []
    while left and len(out) < n:
        best = min(left, key=lambda i: (sum(seen.get(f, 0) for f in left[i]) / max(1, len(left[i])), i))
        for f in left.pop(best):
            seen[f] = seen.get(f, 0) + 1
        out.append(best)
    return out


def test_rare_families_first(spark):
    r = random.Random(8)
    pools = {p: [(i, [f"f{int(r.paretovariate(1))}" for _ in range(r.randrange(0, 5))]) for i in range(k * 1000, k * 1000 + 300)] for k, p in enumerate("ab")}
    pools["c"] = [(9000, []), (9001, ["x", "x"])]
    frame = spark.createDataFrame([(p, i, f) for p, rows in pools.items() for i, f in rows], "pool string, id long, families array<string>")
    got = screens.rare_first(frame, "pool", "id", "families", 40, block=16).orderBy("turn").collect()
    for p, rows in pools.items():
        assert [x["id"] for x in got if x["pool"] == p] == rarest_by_hand(rows, 40)


def test_a_pool_of_a_million_rows(spark):
    families = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.lit("f"), F.pmod(F.xxhash64("id", k), F.lit(5000)).cast("string")))
    frame = spark.range(1_000_000).select(F.lit("p").alias("pool"), "id", families.alias("families"))
    got = [r["id"] for r in screens.rare_first(frame, "pool", "id", "families", 30).orderBy("turn").collect()]
    rows = [(r["id"], r["families"]) for r in frame.limit(2000).collect()]
    assert got == rarest_by_hand(rows, 30)  # 30 picks of unseen families lie among the first rows


def test_cancelling_stops_the_job(spark):
    def slow(frames):
        for frame in frames:
            time.sleep(30)
            yield frame

    asked = threading.Event()
    threading.Timer(2, asked.set).start()
    began = time.time()
    with pytest.raises(jobs.Cancelled):
        jobs.cancellable(spark, lambda: spark.range(4).mapInPandas(slow, "id long").count(), asked.is_set)
    assert time.time() - began < 25
    assert jobs.cancellable(spark, lambda: spark.range(4).count(), lambda: False) == 4
    with pytest.raises(jobs.Cancelled):
        jobs.cancellable(spark, lambda: 1, lambda: True)
    with pytest.raises(ZeroDivisionError):
        jobs.cancellable(spark, lambda: 1 // 0, lambda: False)


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["dup_cluster_sizes", "--data", SF], spark) == 0
    assert "HashAggregate" in capsys.readouterr().out
    out = f"file://{tmp_path}/rows"
    assert command.main(["dup_cluster_sizes", "--data", SF, "--run", out], spark) == 0
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, QUERIES["dup_cluster_sizes"](spark, SF).collect()))
    with pytest.raises(KeyError, match="no plan 'x'"):
        jobs.prepare({}, "x", spark, SF)


def test_constraint_completion(spark):
    from brindle.plans import builds

    rows = {r["doc_id"]: r for r in builds.asked_rows(spark, SF).collect()}
    kept = {r["doc_id"]: r["split"] for r in QUERIES["constraint_completion"](spark, SF).collect()}
    assert kept and {rows[i]["reason"] for i in kept} == {"ok"}
    topics = [set(rows[i]["topic"]) for i in kept]
    assert all(len(a & b) < 0.6 * len(a | b) for k, a in enumerate(topics) for b in topics[:k])
    for i, split in kept.items():
        bucket = int(hashlib.sha256(f"constraint:{i}".encode()).hexdigest()[:8], 16) % 20
        assert split == ("dev" if bucket < 2 else "test" if bucket < 4 else "train")


def test_sketches_merge_and_keep_their_bound():
    import numpy as np

    r = np.random.default_rng(5)
    errors = []
    for n in (0, 10, sql.SKETCH - 1, sql.SKETCH, 5000, 40_000):
        for _ in range(20):
            hashes = r.integers(0, sql.HASHES, n)
            parts = [sql.smallest(np.concatenate([hashes[k::3], hashes[::7]])) for k in range(3)]
            merged = sql.merge.func(pd.Series(parts)) if n else sql.smallest(hashes)
            assert merged == sql.smallest(hashes)
            if n < sql.SKETCH:
                assert sql.estimate(merged) == n
            else:
                errors.append(sql.estimate(merged) / n - 1)
    bound = (sql.SKETCH - 2) ** -0.5
    assert max(map(abs, errors)) < 4 * bound and abs(sum(errors) / len(errors)) < bound
    assert sql.estimate(None) == 0
