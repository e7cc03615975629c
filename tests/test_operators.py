"""Known answers and crafted rows for the operators."""

import gzip
import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import evaluate, graph, packing, quality, screens, select
from brindle.sources import files
from brindle.streaming import run, stateful


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def key(text):
    return hashlib.sha256(" ".join(unicodedata.normalize("NFC", text).split()).encode()).hexdigest()


def test_content_key(spark):
    texts = ["café", "café", " a\tb\n c d ", "", "가가", "Å Å", "x\x1cy", "　日本 語"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.content_key(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == {t: key(t) for t in texts}
    assert got[0]["k"] == got[1]["k"]


def test_split_edges(spark):
    for head, split in (("0000", "final"), ("0064", "validation"), ("00c8", "tokenizer_dev"), ("012c", "train")):
        assert one(spark, T.corpus_split(F.lit("0" * 12 + head + "f" * 48))) == split
    k = "fedcba9876543210" + "0" * 48
    assert one(spark, T.hash_mod(F.lit(k), 16, 10_000)) == int(k[:16], 16) % 10_000


def test_gate_reasons(spark):
    cases = {"ok": "word " * 60, "min_chars": "short", "max_bytes": "é" * 100_001, "nul": "a" * 300 + "\0", "replacement_chars": "�" * 3 + "a" * 300, "repeated_lines": "the same line again and again\n" * 10, "missing": None}
    rows = spark.createDataFrame(list(cases.items()), "want string, text string").select("want", quality.gate(F.col("text")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)
    nine = one(spark, quality.gate(F.lit("the same line again and again\n" * 9)))
    two = one(spark, quality.gate(F.lit("�" * 2 + "a" * 300)))
    assert (nine, two) == ("ok", "ok")


def test_prose_reasons(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    cases = [
        (good, "ok", "train", "ok"), (good, "min_chars", "train", "source_quality_or_length"), (good, "ok", "final", "reserved_partition"), (good + " python ", "ok", "train", "code_topic"), (good + " algebra ", "ok", "train", "math_topic"),
        (good + " 1 + 2", "ok", "train", "math_topic"), (good + " access denied", "ok", "train", "boilerplate_or_encoding"), ("few words", "ok", "train", "too_little_prose"), (good + " " + "é" * 40, "ok", "train", "non_english_script"), ("a b c d e f g h " * 10, "ok", "train", "repetition"),
    ]
    rows = spark.createDataFrame(cases, "text string, gate string, split string, want string")
    for r in rows.select("want", quality.prose_reason(F.col("text"), F.col("gate"), F.col("split")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_generated_reasons(spark):
    names = [f"{a}{b}" for a in ("red", "old", "cold", "wide", "dark", "soft", "late", "tall") for b in ("house", "river", "garden", "window", "street", "winter", "table", "letter")]
    long = ". ".join(" ".join(names[i : i + 4]) for i in range(0, 64, 4)) + ". "
    cases = [
        ("o", long, "length", "x", "train", "incomplete_generation"), ("o", "few.", "stop", "x", "train", "length"), ("o", long, "stop", "x", "final", "reserved_partition"),
        ("see github", long, "stop", "x", "train", "code_topic"), ("o", long + "Some c++11 code.", "stop", "x", "train", "code_topic"), ("o", long + "\\\\sqrt", "stop", "x", "train", "math_topic"),
        ("o", long + "y = 4.", "stop", "x", "train", "math_topic"), ("o", " To create: " + long, "stop", "x", "train", "boilerplate_or_encoding"), ("o", "word " * 50, "stop", "x", "train", "too_little_prose"),
        ("o", "the same words here. " * 30, "stop", "x", "train", "repetition"), ("o", long + "and", "stop", "x", "train", "incomplete_ending"), ("o", long + "Why? Because.", "stop", "faq", "train", "unanswered_faq"),
        ("o", long, "stop", "tutorial", "train", "unstructured_tutorial"), ("o", long + "\n- a\n2. b.", "stop", "tutorial", "train", "ok"), ("o", long.strip() + '"*) \n', "stop", "x", "train", "ok"),
    ]
    rows = spark.createDataFrame(cases, "original string, text string, finish string, kind string, split string, want string")
    splits = F.array(F.lit("train"), F.col("split"))
    for r in rows.select("want", "text", quality.generated_reason(F.col("original"), F.col("text"), F.col("finish"), F.col("kind"), splits).alias("got")).collect():
        assert r["want"] == r["got"], r["text"]


def test_gate_of_scored_and_formatted_sources(spark):
    text = "word " * 60
    rows = spark.createDataFrame([(text, 3, "A Wiki page"), (text, 1, "wiki"), (text, 3, "story"), ("short", 3, "wiki")], "text string, score int, form string")
    reason = quality.gate(F.col("text"), score=F.col("score"), min_score=2, form=F.col("form"), keywords=("wiki", "textbook"))
    assert [r["x"] for r in rows.select(reason.alias("x")).collect()] == ["ok", "min_score", "format", "min_chars"]
    for score, form, name in ((None, "wiki", "score"), (3, None, "format")):
        with pytest.raises(Exception, match=f"missing field {name}"):
            spark.createDataFrame([(text, score, form)], rows.schema).select(reason).collect()


def test_prose_of_titles_and_prompts(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    cases = [("a title", "a prompt", False, "ok"), ("Coding", "p", False, "code_topic"), ("t", "Solve the word problem", False, "math_topic"), ("t", "p", True, "math_topic")]
    rows = spark.createDataFrame([(good, *c) for c in cases], "text string, title string, prompt string, has_math boolean, want string")
    got = quality.prose_reason(F.col("text"), F.lit("ok"), F.lit("train"), title=F.col("title"), prompt=F.col("prompt"), has_math=F.col("has_math"))
    for r in rows.select("want", got.alias("got")).collect():
        assert r["want"] == r["got"]


def test_provenance_keys(spark):
    rows = spark.createDataFrame([("a  b", " 7 ", "http://www.A.com/x/", None, None), ("a b", None, None, "7", "https://a.com/x"), ("c", "", "nothing", None, None)], "text string, id string, url string, nid string, nurl string")
    found = [set(r["k"]) for r in rows.select(T.provenance_keys(F.col("text"), F.col("id"), F.col("url"), F.col("nid"), F.col("nurl")).alias("k")).collect()]
    assert found[0] == found[1] == {"content:" + key("a b"), "id:" + key("7"), "url:" + key("a.com/x")}
    assert found[2] == {"content:" + key("c")}


def test_capitals_are_one_character(spark):
    import duckdb

    texts = [c + "x" for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF and (c.upper() != c or ord(c) < 200)] + ["", "a", "ß"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.capitalised(F.col("t")).alias("c")).collect()
    assert one(spark, T.capitalised(F.lit("ßung"))) == "ẞung"
    want = dict(duckdb.execute("select t, upper(left(t, 1)) || substr(t, 2) from (select unnest(?) as t)", [texts]).fetchall())
    assert {r["t"]: r["c"] for r in got} == want


def test_similar_sets_of_many_meetings(spark):
    """Every similar pair is found, whatever the sizes and sketches, and few others leave the index."""
    import random

    from brindle.operators import similar

    r, sets = random.Random(5), []
    for k in range(300):
        words = r.sample(range(400 if k % 3 else 30_000), r.choice([1, 2, 3, 5, 12, 60, 200]) if k < 290 else 3500 if k % 3 == 0 else 300)
        sets.append(words)
        for _ in range(r.randrange(3)):
            n = len(words)
            sets.append(r.sample(words, n - r.randrange(n * 2 // 5 + 1)) + r.sample(range(50_000, 60_000), r.randrange(n // 3 + 1)))
    rows = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "node long, words array<string>").select("node", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    whole = [set(s) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(whole[i] & whole[j]) >= 3 * len(whole[i] | whole[j])}
    for parts in (1, 5):
        found = [(x["left"], x["right"]) for x in similar.candidates(rows, parts).collect()]
        assert len(found) == len(set(found)) and want <= set(found) and len(found) < 2 * len(want)


def test_bootstrap_by_hand(spark):
    """Weights of every draw from the hashes; a row without a key has none, as in SQL."""
    import numpy as np

    from brindle.operators import evaluate

    data = [(None if i == 7 else i, None if i == 9 else (i * 37 % 101) / 7) for i in range(3000)]
    got = evaluate.bootstrap(spark.createDataFrame(data, "id long, x double").repartition(3), "x", "id", draws=50).collect()[0]
    steps, sums = evaluate.poisson_steps(), np.zeros((2, 50))
    for i, x in data:
        if i is not None and x is not None:
            for draw in range(50):
                digest, j = divmod(draw, 16)
                w = sum(int(hashlib.sha256(f"bootstrap:{digest}:{i}".encode()).hexdigest()[4 * j : 4 * j + 4], 16) >= s for s in steps)
                sums[:, draw] += (w, w * x)
    low, high = np.quantile(sums[1] / sums[0], [0.025, 0.975])
    assert (got["n"], got["low"], got["high"]) == (2999, pytest.approx(low, abs=1e-12), pytest.approx(high, abs=1e-12))


def test_pools_shuffle_no_tokens(spark, tmp_path):
    """Texts go to their places once and tokens never do: what is shuffled stays below the tokens."""
    import random

    from brindle.plans import storage

    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcdefghijklmnop ") for _ in range(4000)) if i % 3 else f"copy {i % 7}", f"s{i % 4}") for i in range(600)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(f"file://{tmp_path}/d/documents.parquet")

    def shuffled():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._sc._gateway.jvm.double, 0), None).iterator()
        total = 0
        while stages.hasNext():
            total += stages.next().shuffleWriteBytes()
        return total

    before = shuffled()
    index = storage.write_texts(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/pool").collect()
    assert shuffled() - before < 3_000_000
    assert len(index) == len({t for _, t, _ in rows}) and sum(x["n_tokens"] for x in index) == sum(len(t) + 1 for t in {t for _, t, _ in rows})


def test_similar_sets_in_bounded_memory(spark):
    """A task holds two blocks of sketches, not all sets that its words are in."""
    import psutil

    from brindle.operators import similar

    seed = F.expr("if(id % 1000 = 1, id - 1, id)")
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.xxhash64(F.pmod(F.xxhash64(seed, k), F.lit(60_000))))
    rows = spark.range(20_000).select(F.col("id").alias("node"), F.array_distinct(words).alias("h"))
    workers = lambda: [p for p in psutil.Process().children(recursive=True) if "java" not in p.name()]
    peak = lambda p: int(re.search(r"VmHWM:\s+(\d+)", open(f"/proc/{p.pid}/status").read()).group(1)) // 1024
    before = {}
    for p in workers():
        before[p.pid] = p.memory_info().rss >> 20
        with open(f"/proc/{p.pid}/clear_refs", "w") as f:
            f.write("5")
    found = {(r["left"], r["right"]) for r in similar.candidates(rows, 1).collect()}
    assert {(k, k + 1) for k in range(0, 20_000, 1000)} <= found and len(found) < 40
    assert max(peak(p) - before.get(p.pid, 100) for p in workers()) < 200


def test_constraint_grammar(spark):
    from brindle.functions import constraints as C

    cases = [
        ("Write exactly three sentences without commas.", [("no_comma", None, None, None), ("sentences", "exactly", 3, None)]), ("Use no fewer than 20 words, all lowercase.", [("lowercase", None, None, None), ("words", "no fewer than", 20, None)]),
        ("Give twelve words.", [("words", "exactly", 12, None)]), ("Give nine paragraphs.", None), ("Use 121 words", None), ("Write 2-3 sentences.", None), ("Two sentences, then three sentences.", None), ("Two sentences per paragraph.", None),
        ('Two bullet points; finish with the exact phrase "The end."', [("ending", None, None, ["The end."]), ("bullets", "exactly", 2, None)]), ("Include keywords: [red, Blue Sky].", [("keywords", None, None, ["red", "blue sky"])]),
        ('The word "tea" should appear at least 2 times. Wrap it in double quotation marks.', [("quotation", None, None, None), ("frequency", "at least", 2, ["tea"])]), ("Tell me more.", []), ("At most two short paragraphs with a title in <<x>>.", [("title", None, None, None), ("paragraphs", "at most", 2, None)]),
        ("Answer in three sections.", [("sections", "exactly", 3, None)]),
    ]
    rows = spark.createDataFrame([(p,) for p, _ in cases], "p string").select("p", C.parse(F.col("p")).alias("c"))
    got = {r["p"]: r["c"] and [tuple(c) for c in r["c"]] if r["c"] != [] else [] for r in rows.collect()}
    assert got == dict(cases)
    checks = [
        ("no_comma", None, None, None, "a b", "a, b"), ("title", None, None, None, "<<A title>>\nx", "<< >>"), ("quotation", None, None, None, '"x"', '"x'), ("lowercase", None, None, None, "abc 1", "1 2"), ("uppercase", None, None, None, "ABC", "AbC"),
        ("ending", None, None, ["end."], "the end. ", "the end"), ("postscript", None, None, None, "x\nP.S. y", "P.S."), ("sections", "exactly", 2, None, "Section 1\na\nsection 2:\nb", "Section 2\nSection 1"),
        ("keywords", None, None, ["red", "blue sky"], "Red and blue-sky", "redder blue sky"), ("frequency", "at least", 2, ["tea"], "Tea, tea", "teas tea"), ("words", "under", 3, None, "a b", "a b c"), ("sentences", "exactly", 2, None, "A. B!", "A."),
        ("bullets", "exactly", 2, None, "- a\n* b", "** a\n- b"), ("paragraphs", "more than", 1, None, "a\n\nb", "a\nb"),
    ]
    rows = spark.createDataFrame([(f, good, bad, [(f, r, n, p)]) for f, r, n, p, good, bad in checks], f"f string, good string, bad string, c array<{C.CHECK}>")
    for r in rows.select("f", C.verify(F.col("good"), F.col("c"))[0].alias("good"), C.verify(F.col("bad"), F.col("c"))[0].alias("bad")).collect():
        assert (r["good"], r["bad"]) == (True, False), r["f"]
    assert one(spark, C.placeholders(F.lit("[a] and [b c] []"))) == 2 and one(spark, C.highlights(F.lit("*a* **b** * *"))) == 2


def test_offsets_in_strata(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i, i % 5) for i in range(200)], "s int, i int, n long").repartition(5)
    got = {r["i"]: r["start"] for r in packing.offsets(rows, "i", "n", "s").collect()}
    before = {}
    for i in range(200):
        s = i % 3 if i % 7 else None
        assert got[i] == before.get(s, 0)
        before[s] = before.get(s, 0) + i % 5


def test_conversation_reasons(spark):
    def talk(*said):
        return [{"turn": i, "role": r, "content": c} for i, (r, c) in enumerate(said)]

    u, a, s = (lambda c="q": ("user", c)), (lambda c="x": ("assistant", c)), ("system", "s")
    cases = [
        (talk(u(), a()), "ok"), (talk(s, u(), a()), "ok"), (talk(u()), "roles_or_empty"), (talk(u(), a(" ")), "roles_or_empty"), (talk(a(), u()), "roles_or_empty"), (talk(u(), a(), u()), "roles_or_empty"), (talk(s, s), "roles_or_empty"),
        (talk(u("q" * 12_001), a()), "request_limit"), (talk(u("q" * 9000), a("a" * 9000)), "oversized_candidate"), (talk(u(), a("<|im_end|>")), "foreign_role_tokens"), (talk(u(), a("one two three four five six seven eight " * 3)), "repetitive_target"),
        (talk(u(), a("```")), "unclosed_code_fence"), (talk(u(), a("![x](https://y)")), "external_image_target"),
    ]
    rows = spark.createDataFrame([(m, w) for m, w in cases], "m array<struct<turn:int,role:string,content:string>>, want string")
    for r in rows.select("want", quality.conversation_reason(F.col("m")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_url_key(spark):
    rows = [("http://WWW.A.com/x/", "a.com/x"), ("https://a.com/x?y=1#z", "a.com/x?y=1"), ("a.com/x", None), (None, None)]
    for url, want in rows:
        assert one(spark, T.url_key(F.lit(url).cast("string"))) == want


def test_quotas_and_interleave(spark):
    sources = spark.createDataFrame([("a", 55, 0), ("b", 25, 1), ("c", 10, 2), ("d", 10, 3)], "label string, weight int, ord int")
    assert [r["quota"] for r in select.quotas(sources, 100).orderBy("label").collect()] == [55, 25, 10, 10]
    assert [r["quota"] for r in select.quotas(sources, 103).orderBy("label").collect()] == [57, 26, 10, 10]
    rows = spark.createDataFrame([(s, w, i) for s, w in (("a", 70), ("b", 30)) for i in range(100)], "s string, w int, i int")
    first = select.weighted_interleave(rows, "s", "w", "s", "i").orderBy("position", "s").limit(100).collect()
    taken, want = {"a": 0, "b": 0}, []
    for _ in range(100):
        s = min(taken, key=lambda x: taken[x] / {"a": 70, "b": 30}[x])
        want.append(s)
        taken[s] += 1
    assert [r["s"] for r in first] == want


def test_sequential_holdout(spark):
    phrase = " ".join(f"p{i}" for i in range(14))
    rows = spark.createDataFrame([(1, phrase, "test"), (2, "x " + phrase, "dev"), (3, "other words", "dev"), (4, phrase + " y", "train"), (5, "fresh", "train")], "id long, text string, split string")
    kept = select.sequential_holdout(rows, "id", "split", ["test", "dev", "train"], 13)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5]


def test_components_and_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "id long, parent long")
    assert {r["id"]: r["chain"] for r in graph.ancestor_chains(nodes, 3).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3]}


def test_pack(spark):
    rows = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(10)], "id long, tokens array<int>")
    flat = [t for i in range(10) for t in range(i * 10, i * 10 + 7)]
    got = {r["row_no"]: (r["x"], r["y"]) for r in packing.pack(rows, "id", "tokens", 8).collect()}
    assert got == {k: (flat[8 * k : 8 * k + 8], flat[8 * k + 1 : 8 * k + 9]) for k in range((len(flat) - 1) // 8)}


def test_wilson_and_first_max(spark):
    low, high = evaluate.wilson(F.lit(8), F.lit(10))
    assert one(spark, low) == pytest.approx(0.4901625, abs=1e-6) and one(spark, high) == pytest.approx(0.9433178, abs=1e-6)
    assert one(spark, evaluate.first_max(F.array(F.lit(1), F.lit(3), F.lit(3)))) == 1
    assert one(spark, T.judge_score(F.lit("fine [RESULT] 4"))) == 4 and one(spark, T.judge_score(F.lit("[RESULT] 11 or so"))) is None


def test_sources(spark, tmp_path):
    lines = [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/journal.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + '\n{"id": "c", "te')
    got = files.journal(spark, f"file://{tmp_path}/j", "id string, text string")
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"]
    place = got.withColumn("place", F.when(F.col("id") == "a", 0).otherwise(1))
    expected = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "place int, id string")
    assert files.is_prefix(place, expected)
    assert not files.is_prefix(place.filter("id = 'b'"), expected)
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    assert files.json_lines(spark, f"file://{tmp_path}/z.jsonl.gz", "id string, text string", gzip=True).count() == 2
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    assert files.csv_rows(spark, f"file://{tmp_path}/c.csv", "a int, b string").first()["b"] == "x\ny"
    (tmp_path / "l.log").write_text("step 1 loss 2.5\nnoise\nstep 2 lo")
    assert [tuple(r) for r in files.log_values(spark, f"file://{tmp_path}/l.log", r"step (\d+) loss ([\d.]+)", ["step", "loss"]).collect()] == [("1", "2.5")]


def test_verified_parquet_and_receipts(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", "k1", "text", [1, 2]), ("train", "a", "k0", "more", [3]), ("dev", "b", "k2", "é", [4, 5, 6])], "split string, source string, key string, text string, tokens array<int>")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/p")
    expected = files.manifest(spark, f"file://{tmp_path}/p", "*.parquet")
    assert files.verified_parquet(spark, f"file://{tmp_path}/p", expected).count() == 3
    with pytest.raises(ValueError, match="content"):
        files.verified_parquet(spark, f"file://{tmp_path}/p", expected.withColumn("sha256", F.lit("0")))
    receipt = files.write_sample(rows.drop("tokens"), f"file://{tmp_path}/s", 10, "split", "source")
    assert {(r["split"], r["documents"], r["bytes"]) for r in receipt.collect()} == {("train", 2, 8), ("dev", 1, 2)}
    index = files.write_pool(rows.drop("text"), f"file://{tmp_path}/t")
    assert {(r["key"], r["start"], r["n_tokens"]) for r in index.collect()} == {("k0", 0, 1), ("k1", 1, 2), ("k2", 0, 3)}
    files.check_transition({"a": 1, "b": 2}, {"a": 1, "b": 3}, {"b"})
    with pytest.raises(ValueError, match="a"):
        files.check_transition({"a": 1}, {"a": 2}, {"b"})


def test_event_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"file://{tmp_path}/e/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e/in")
    done = run.run_once(stateful.event_counts(stream), f"file://{tmp_path}/e/out", f"file://{tmp_path}/e/c")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert 0 < done.count() <= batch.count()
    same = done.select("window", "event_type", F.col("n").alias("count")).exceptAll(batch)
    assert same.isEmpty()


FINE = "The river runs past the old mill and the children like to play on its banks."
#: Reason, request, answer, family, system message: written by hand, as no pattern of the library.
PLANTED = [
    ("ok", "Tell me of the river by the mill.", FINE, "conversation", ""),
    ("roles", None, FINE, "conversation", ""),
    ("prompt_length", "so " * 401, FINE, "conversation", ""),
    ("answer_length", "Tell me of the river.", "A river.", "conversation", ""),
    ("code_math_scope", "Tell me how many boats there are.", FINE, "conversation", ""),
    ("code_math_scope", "Tell me of the river.", FINE + " See https://a.b for more.", "conversation", ""),
    ("math_scope_extended", "Tell me of the median boat.", FINE, "conversation", ""),
    ("numeric_table_or_problem", "Boats: 3 in May, 4 in June, 5.5 in July, 6 in August.", FINE, "conversation", ""),
    ("roleplay_or_setup", "You are a pirate, tell me of the river.", FINE, "conversation", ""),
    ("roleplay_or_setup", "Let us role-play on the river.", FINE, "conversation", ""),
    ("persona", "You are an assistant for river guides.", FINE, "rewrite", ""),
    ("roleplay_or_setup", "Tell me of the river.", "I grew up there, and the river runs past the old mill.", "conversation", ""),
    ("roleplay_or_setup", "Tell me of the river.", "Sure! Please tell me more about which river you would like to hear of.", "conversation", ""),
    ("persona", "From now on you’re captain of the boat.", FINE, "conversation", ""),
    ("ok", "I hope that you are free to tell me of the river.", FINE, "conversation", ""),
    ("persona", "Tell me of the river.", FINE, "conversation", "Your character is gruff."),
    ("ok", "Tell me of the river.", FINE, "rewrite", "Your character is gruff."),
    ("specialist_or_live", "Tell me of the river.", FINE + " A patient walks there.", "conversation", ""),
    ("specialist_or_live", "The boat costs €9, tell me of it.", FINE, "conversation", ""),
    ("specialist_drug", "Tell me of the drug trade on the river.", FINE, "conversation", ""),
    ("unverifiable_live_context", "Is there a mill near me?", FINE, "everyday", ""),
    ("ok", "Is there a mill near me?", FINE, "conversation", ""),
    ("dedicated_rewrite_source", "Please polish my words on the river.", FINE, "conversation", ""),
    ("new_numbers", "The mill by the river.", "The mill by the river has 12 wheels, which turn by night.", "rewrite", ""),
    ("summary_unsupported_words", "The river runs by the mill.", "Trout leap beneath willows, herons wade between slippery stones.", "summary", ""),
    ("summary_new_name", "A river runs past a mill in a valley of green hills.", "The river runs past a mill in Rhoda, a valley of green hills.", "summary", ""),
    ("summary_overstated_commitment", "The miller and the mayor talk about a new wheel for the old mill.", "The miller and the mayor agreed about a new wheel for the old mill.", "summary", ""),
    ("summary_instruction", "The miller and the mayor talk of a new wheel.", "The miller and the mayor talk of their new wheel.", "summary", "Do it without using second or third person pronouns."),
    ("summary_length_instruction", "The mill is old. The river is wide. The wheel turns.", "The mill is old. The river is wide. The wheel turns.", "summary", "Answer in one very short sentence."),
    ("embedded_roles", "Tell me of the river.", FINE + "\nUser: and then it ends here.", "conversation", ""),
    ("incomplete_ending", "Tell me of the river.", FINE[:-1], "conversation", ""),
    ("ok", "Put the letter in better words.", "The river is high and the mill stands still. Come soon.\nKind regards,\nAda Miller", "rewrite", ""),
    ("incomplete_ending", "Put the letter in better words.", "The river is high and the mill stands still. Come soon.\nKind regards,\nAda Miller", "everyday", ""),
    ("language", "Tell me of the river.", "Où est la rivière? Très près, à côté du château, là où l’été règne.", "conversation", ""),
    ("repetition", "Tell me of the river.", "past the old mill it goes past the old mill it goes past the old mill.", "conversation", ""),
    ("echo", "Where does the wide river run past the old mill?", "where does the wide river run, past the old mill.", "conversation", ""),
]


def test_planted_single_turns(spark):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PLANTED)], "i int, want string, request string, answer string, family string, system string")
    reason = screens.single_turn_reason(F.col("request"), F.col("answer"), F.col("family"), F.col("system"))
    got = {r["i"]: r["reason"] for r in rows.select("i", reason.alias("reason")).collect()}
    assert [(i, got[i]) for i in got if got[i] != PLANTED[i][0]] == []


def test_first_pairs_of_conversations(spark):
    hello = [("user", "Hi there"), ("assistant", "Hello."), ("user", "Where is the mill?"), ("assistant", "Past it.")]
    cases = [("everyday", hello, ("", "Where is the mill?", "Past it.")), ("rewrite", hello, ("", "Hi there", "Hello.")), ("summary", [("system", " Be brief. "), *hello], ("Be brief.", "Hi there", "Hello.")), ("everyday", hello[:2], ("", "Hi there", "Hello.")), ("rewrite", hello[1:], None), ("rewrite", hello[:1], None), ("rewrite", [], None)]
    rows = spark.createDataFrame([(i, f, m) for i, (f, m, _) in enumerate(cases)], "i int, family string, messages array<struct<role:string,content:string>>")
    got = {r["i"]: r["pair"] for r in rows.select("i", screens.single_turn(F.col("messages"), F.col("family")).alias("pair")).collect()}
    assert [got[i] and tuple(got[i]) for i in range(len(cases))] == [w for _, _, w in cases]


def test_planted_answers(spark):
    cases = [
        ("ok", "Tell me of the river.", FINE, "conversation"), ("scope", "Tell me of the software.", FINE, "rewrite"), ("persona", "Your name is Bo.", FINE, "rewrite"), ("meta_edit", "Tell me.", FINE + " It is more concise.", "conversation"),
        ("ok", "Tell me.", FINE + " It is more concise.", "rewrite"), ("word_count", "Tell me in 9 words.", FINE, "conversation"), ("ok", "Tell me in exactly 16 words.", FINE, "conversation"), ("ok", "Tell me in 016-word style.", FINE, "conversation"),
        ("repetition", "Tell me.", "past the old mill it goes, past the old mill it comes", "conversation"), ("edit_filler", "Tell me.", "I've removed the mill.", "conversation"), ("false_self", "Tell me.", "In my experience it runs.", "conversation"),
        ("edit_request", "Rephrase this.", FINE, "followup"), ("ok", "Rephrase this.", FINE, "rewrite"), ("long_followup", "so " * 201, FINE, "followup"), ("numbers_lost", "There are 3 mills.", FINE, "rewrite"), ("ok", "There are 3 mills.", "See 3 mills.", "rewrite"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, want string, prompt string, answer string, family string")
    got = {r["i"]: r["fault"] for r in rows.select("i", screens.answer_fault(F.col("prompt"), F.col("answer"), F.col("family")).alias("fault")).collect()}
    assert [(i, got[i]) for i in got if got[i] != cases[i][0]] == []


def test_planted_topics_and_phrases(spark):
    topics = {"a command-line tool": "code_topic", "web\tscraping at night": "code_topic", "def run(": "code_topic", "two theorems": "math_topic", "3 × 4": "math_topic", "x = -2": "math_topic", "access denied": "boilerplate_or_encoding", "To create : it": "boilerplate_or_encoding", "the commandeer line": "ok"}
    rows = spark.createDataFrame([(t + " " + FINE, w) for t, w in topics.items()], "text string, want string")
    for r in rows.select("text", "want", quality.prose_reason(F.col("text"), F.lit("ok"), F.lit("train"), min_words=1).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]
    phrases = {"i made a few changes": "phrase", 'I changed "the" word': "phrase", "I can't help": "phrase", "I canXt help": "ok", "Please try again": "phrase", "regex here": "scope", "4 + 5": "scope", "plain": "ok"}
    rows = spark.createDataFrame(list(phrases.items()), "text string, want string")
    for r in rows.select("text", "want", screens.overlap_reason(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]
