"""Recipes: chains of the operators that build training sets, each beside its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import constraints as C
from brindle.functions import fixed, sql
from brindle.functions import text as T
from brindle.operators import jobs, quality, screens, select
from brindle.operators.graph import components, passing_depths, store
from brindle.plans.corpus import GATE, greedy, greedy_sql, words_sql
from brindle.plans.dialogues import group_text, messages, reply_chains
from brindle.plans.generated import ENTITIES, entities, generated_instructions, generated_preferences
from brindle.plans.recipes import EXPLAINED, NORM_OF, PAIRS, REVIEW_REJECTED, SENTENCE_LIST, SPANS, WORDS_OF, explained_rows, listed, multiple_choice, span_rows
from brindle.plans.registry import ORACLES, QUERIES, documents, query, table
from brindle.sources import synth

HEX8 = "cast(concat('0x', substr({0}, 1, 8)) as ubigint)"
GROUP_BUCKET = HEX8.format("grp") + " % 100"
#: Conversations with what recipes choose by: the request, the answer, the first fault, the
#: group, its bucket of 100, a hash.
TALKS = f"""q as ({ORACLES["conversation_quality"]}), g as ({ORACLES["conversation_groups"]}), {PAIRS}, n as (select conv_id, count(*) as n, count(*) filter (where role = 'system') as systems from conversations group by 1),
 t as (select a.conv_id, request, answer, answers, n, systems, reason, grp, {GROUP_BUCKET} as bucket, sha256('talk:' || a.conv_id) as h from a join q using (conv_id) join g using (conv_id) join n using (conv_id))"""


def talks(spark, sf_dir) -> DataFrame:
    own = messages(spark, sf_dir)
    said = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    quoted = F.concat(F.lit('"'), F.replace(group_text(F.col("messages")), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    rows = own.select(
        "conv_id", F.get(said("user"), F.lit(0)).alias("request"), F.get(said("assistant"), F.lit(0)).alias("answer"), F.size(said("assistant")).alias("answers"), F.size("messages").alias("n"),
        F.size(said("system")).alias("systems"), quality.conversation_reason(F.col("messages")).alias("reason"), F.sha2(quoted, 256).alias("grp"),
    )
    return rows.withColumn("bucket", T.hash_mod(F.col("grp"), 8, 100)).withColumn("h", select.hash_rank("talk", F.col("conv_id")))


def share(column: str, salt: str, modulus: int) -> Column:
    """The bucket of a salted group."""
    return T.hash_mod(F.sha2(F.concat(F.lit(salt + ":"), F.col(column).cast("string")), 256), 8, modulus)


def share_sql(column: str, salt: str, modulus: int) -> str:
    key = f"sha256('{salt}:' || {column})"
    return f"{HEX8.format(key)} % {modulus}"


def first_of(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows of each key by hash ``h``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("place") <= k).drop("place")


def blocks(pools: list[tuple[DataFrame, int]]) -> DataFrame:
    """Fixed-composition batches: of each pool (id, h) so many rows a batch, as long as every
    pool lasts; pool, id, batch."""
    dealt = []
    for i, (rows, quota) in enumerate(pools):
        placed = select.places(rows.select("id", "h"), ["h"]).withColumn("batch", F.floor(F.col("place") / quota).cast("long"))
        dealt.append(placed.select(F.lit(i).alias("pool"), F.col("id").cast("long").alias("id"), "batch", F.lit(quota).alias("quota")))
    every = store(reduce(DataFrame.unionByName, dealt))
    whole = every.groupBy("pool", "batch", "quota").agg(F.count("*").alias("n")).filter("n = quota").groupBy("batch").agg(F.count("*").alias("pools")).filter(F.col("pools") == len(pools))
    return every.join(whole.select("batch"), "batch", "left_semi").select("pool", "id", "batch")


def blocks_sql(pools: list[tuple[str, int]]) -> str:
    dealt = " union all ".join(f"select {i} as pool, cast(id as bigint) as id, cast((row_number() over (order by h) - 1) // {quota} as bigint) as batch, {quota} as quota from {name}" for i, (name, quota) in enumerate(pools))
    return f"""d_ as ({dealt}), w_ as (select batch from (select pool, batch from d_ group by pool, batch, quota having count(*) = quota) group by 1 having count(*) = {len(pools)})
 select cast(pool as int) as pool, id, batch from d_ where batch in (select batch from w_)"""


# ---- conversations -------------------------------------------------------------------------


def held_split(bucket: Column, dev: int, test: int) -> Column:
    return F.when(bucket < dev, "dev").when(bucket < test, "test").otherwise("train")


def held_split_sql(dev: int, test: int) -> str:
    return f"case when bucket < {dev} then 'dev' when bucket < {test} then 'test' else 'train' end"


NEAR = 5
OVERLAPS = f"""gram as (select conv_id, unnest(list_distinct({words_sql(NEAR, "w")})) as gram from (select conv_id, {WORDS_OF.format("request")} as w from t)),
 denied as (select distinct unnest(list_distinct({words_sql(NEAR, "w")})) as gram from (select {WORDS_OF.format("text")} as w from benchmark))"""


def chosen_in_turn(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """Per split, in order, the first k rows by hash that share no run of words with rows
    chosen in earlier splits; runs are those of the request."""
    grams = store(select.grams_of(rows, "conv_id", "request", NEAR))
    held, kept = None, None
    for name in order:
        own = rows.filter(F.col("split") == name)
        if held is not None:
            own = own.join(grams.join(held, "gram", "left_semi").select("conv_id").distinct(), "conv_id", "left_anti")
        own = store(first_of(own, k, "split"))
        mine = grams.join(own.select("conv_id"), "conv_id", "left_semi").select("gram").distinct()
        held, kept = mine if held is None else held.union(mine), own if kept is None else kept.unionByName(own)
    return kept


def in_turn_sql(source: str, order: list[str], k: int) -> str:
    """CTEs that do the same for rows of ``source``; the result is ``chosen``."""
    parts, before = [], []
    for i, name in enumerate(order):
        clean = "".join(f" and conv_id not in (select conv_id from gram where gram in (select gram from gram where conv_id in (select conv_id from c{j})))" for j in range(i))
        parts.append(f"c{i} as (select * from {source} where split = '{name}'{clean} qualify row_number() over (order by h) <= {k})")
        before.append(f"select * from c{i}")
    return ", ".join([*parts, f"chosen as ({' union all '.join(before)})"])


@query(f"""with {TALKS}, {OVERLAPS}, one as (select *, {held_split_sql(15, 30)} as split from t where reason = 'ok' and conv_id not in (select conv_id from gram where gram in (select gram from denied))
 qualify row_number() over (partition by grp order by h) = 1), {in_turn_sql("one", ["test", "dev", "train"], 20)}
 select c.conv_id, split, grp, cast(m.turn as bigint) as turn, cast(length(m.text) as bigint) as target from chosen c join conversations m on m.conv_id = c.conv_id and m.role = 'assistant'""")
def foundation_chats(spark, sf_dir):
    """Sound conversations, one a group, apart from the benchmark and from earlier splits;
    their supervised turns."""
    rows = store(talks(spark, sf_dir).filter("reason = 'ok'"))
    denied = select.overlapping(rows.withColumnRenamed("request", "text").select("conv_id", "text"), "conv_id", table(spark, sf_dir, "benchmark"), n=NEAR)
    rows = first_of(select.exclude(rows, denied, "conv_id"), 1, "grp").withColumn("split", held_split(F.col("bucket"), 15, 30))
    chosen = chosen_in_turn(store(rows), ["test", "dev", "train"], 20)
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("target"))
    return chosen.select("conv_id", "split", "grp").join(turns, "conv_id")


KINDS = f"""case when regexp_matches(coalesce(request, ''), {fixed.quoted(fixed.REQUESTS)}) then 'completion' when answers >= 2 then 'conversation' else 'other' end"""


@query(f"""with {TALKS}, c as (select conv_id as id, h from t where reason = 'ok' and {KINDS} in ('conversation', 'grounded')), o as (select conv_id as id, h from t where reason = 'ok' and {KINDS} = 'other'),
 {ENTITIES}, p as (select i * 2 + b as id, sha256('made:' || (i * 2 + b)) as h from e, (select unnest(range(2)) as b)), {blocks_sql([("c", 3), ("o", 2), ("p", 1)])}""")
def foundation_mix(spark, sf_dir):
    """Kinds of sound conversations mixed with generated practice in fixed batches."""
    rows = talks(spark, sf_dir).filter("reason = 'ok'")
    kind = F.coalesce(screens.behaviour(F.array("request"), F.col("answers")), F.lit("other"))
    rows = store(rows.select(F.col("conv_id").alias("id"), "h", kind.alias("kind")))
    made = synth.dialogues(entities(spark, sf_dir)).select((F.col("id") * 2 + F.when(F.col("branch") == "louder", 1).otherwise(0)).alias("id")).withColumn("h", select.hash_rank("made", F.col("id")))
    return blocks([(rows.filter("kind in ('conversation', 'grounded')"), 3), (rows.filter("kind = 'other'"), 2), (made, 1)])


@query(f"""with {TALKS} select conv_id, {held_split_sql(10, 20)} as split, cast(n as bigint) as n from t where reason = 'ok' and systems = 0 and conv_id not in {REVIEW_REJECTED}""")
def intact_conversations(spark, sf_dir):
    """Whole conversations by group, without those that a review rejected."""
    rows = talks(spark, sf_dir).filter("reason = 'ok' and systems = 0").join(listed(spark, REVIEW_REJECTED), "conv_id", "left_anti")
    return rows.select("conv_id", held_split(F.col("bucket"), 10, 20).alias("split"), F.col("n").cast("long").alias("n"))


@query(f"""with s as ({ORACLES["single_turn_reasons"]}), {TALKS}, {OVERLAPS}, one as (select t.*, {held_split_sql(20, 40)} as split from t join s using (conv_id) where s.reason = 'ok'),
 {in_turn_sql("one", ["test", "dev", "train"], 15)}, r as (select split, count(*) as n, count(distinct grp) as groups, cast(sum(length(answer)) as bigint) as targets, max(length(answer)) as longest from chosen group by 1) select * from r""")
def natural_control(spark, sf_dir):
    """Screened single turns, chosen split by split, and the receipt of each split."""
    sound = QUERIES["single_turn_reasons"](spark, sf_dir).filter("reason = 'ok'")
    rows = talks(spark, sf_dir).join(sound, "conv_id", "left_semi").withColumn("split", held_split(F.col("bucket"), 20, 40))
    chosen = chosen_in_turn(store(rows), ["test", "dev", "train"], 15)
    size = F.length("answer").cast("long")
    return chosen.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"), F.sum(size).alias("targets"), F.max(size).alias("longest"))


@query(f"""with {TALKS}, c as (select conv_id as id, h, coalesce(cast(n > 2 as int), 0) as many from t where answers > 0), d as (select id, h from c where many = 1), e as (select id, h from c where many = 0), {blocks_sql([("d", 6), ("e", 2)])}""")
def conversation_completion(spark, sf_dir):
    """Longer and short conversations in batches of three to one."""
    rows = store(talks(spark, sf_dir).filter("answers > 0").select(F.col("conv_id").alias("id"), "h", "n"))
    return blocks([(rows.filter("n > 2"), 6), (rows.filter("n <= 2"), 2)])


@query(f"""with {TALKS}, f as (select *, row_number() over (order by h) - 1 as i from t where conv_id not in (select conv_id from t where reason = 'ok' qualify row_number() over (order by h) <= 20))
 select conv_id, case when bucket < 10 then 'dev' when bucket < 20 then 'test' else 'train' end as split, cast(i % 6 as bigint) as category, cast(i // 12 as bigint) as batch from f""")
def teacher_plan(spark, sf_dir):
    """Conversations not used before, a split by group, a category by place, batches of 12."""
    rows = store(talks(spark, sf_dir).select("conv_id", "h", "reason", "bucket"))
    used = rows.filter("reason = 'ok'").orderBy("h").limit(20).select("conv_id")
    fresh = select.places(rows.join(used, "conv_id", "left_anti"), ["h"])
    return fresh.select("conv_id", held_split(F.col("bucket"), 10, 20).alias("split"), (F.col("place") % 6).alias("category"), F.floor(F.col("place") / 12).cast("long").alias("batch"))


TWICE = f"""tg as (select conv_id, turn, unnest({words_sql(8, "w")}) as gram from (select conv_id, turn, {WORDS_OF.format("text")} as w from conversations where role = 'assistant')),
 twice as (select distinct conv_id from (select conv_id, turn, gram from tg group by all having count(*) >= 2))"""


def public_repair_rows(spark, sf_dir):
    own = messages(spark, sf_dir)
    looped = F.exists(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: T.most_repeated(F.transform(T.gram_hashes(T.word_list(T.norm(m["content"])), 8), lambda g: g.cast("string"))) >= 2)
    banned = F.exists("messages", lambda m: screens.overlap_reason(m["content"]) != quality.ACCEPTED)
    return own.select("conv_id", F.when(banned, "scope").when(looped, "repetition").otherwise("ok").alias("screen"))


@query(f"""with {TALKS}, {TWICE}, b as (select conv_id, bool_or(regexp_matches(text, {fixed.quoted(fixed.REPAIR_SCOPE)}) or regexp_matches(text, {fixed.quoted(fixed.REPAIR_PHRASES)})) as banned from conversations group by 1),
 s as (select t.*, case when banned then 'scope' when conv_id in (select conv_id from twice) then 'repetition' else 'ok' end as screen from t join b using (conv_id)),
 k as (select *, row_number() over (partition by cast(n > 2 as int) order by h) as round, cast(n > 2 as int) as stratum from s where screen = 'ok' and reason = 'ok')
 select conv_id, stratum, round, row_number() over (order by round, stratum) - 1 as turn, cast((row_number() over (order by round, stratum) - 1) // 4 as bigint) as batch from k""")
def public_repair(spark, sf_dir):
    """Screened conversations, strata by turns, batches of four."""
    rows = talks(spark, sf_dir).filter("reason = 'ok'").join(public_repair_rows(spark, sf_dir).filter("screen = 'ok'"), "conv_id")
    rows = select.round_robin(rows.select("conv_id", "h", (F.col("n") > 2).cast("int").alias("stratum")), "stratum", "h")
    return rows.select("conv_id", "stratum", F.col("round").cast("long").alias("round"), "turn", F.floor(F.col("turn") / 4).cast("long").alias("batch"))


@query(f"""with {TWICE}, b as (select conv_id, bool_or(regexp_matches(text, {fixed.quoted(fixed.REPAIR_SCOPE)}) or regexp_matches(text, {fixed.quoted(fixed.REPAIR_PHRASES)})) as banned from conversations group by 1)
 select conv_id, case when banned then 'scope' when conv_id in (select conv_id from twice) then 'repetition' else 'ok' end as screen from b""")
def overlap_screen(spark, sf_dir):
    """Scope, phrases about editing or refusing, 8-word runs that an answer repeats."""
    return public_repair_rows(spark, sf_dir)


@query(f"""with {TALKS}, m as (select conv_id, turn, text from conversations where role = 'assistant'), l as (select m.*, {HEX8.format("sha256('follow:' || conv_id || ':' || turn)")} % 2 as side from m),
 f as (select conv_id, turn, side, (row_number() over (partition by side order by conv_id, turn) - 0.5) / count(*) over (partition by side) as position from l)
 select conv_id, turn, cast(side as int) as side, round(position, 9) as position, row_number() over (order by position, side) - 1 as place from f""")
def text_followup(spark, sf_dir):
    """Two pools of answers merged by fractional position."""
    own = F.concat_ws(":", F.lit("follow"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", T.hash_mod(F.sha2(own, 256), 8, 2).cast("int").alias("side"))
    mixed = select.fractional_interleave(rows, "side", "conv_id", "turn")
    return select.places(mixed, ["position", "side"]).select("conv_id", "turn", "side", F.round(F.col("position").cast("double"), 9).alias("position"), "place")


# ---- documents -----------------------------------------------------------------------------


@query(f"""with d as (select * from documents qualify row_number() over (partition by source order by doc_id) <= 30), r as (select source, doc_id, {GATE} as reason, sha256('audit:' || doc_id) as h from d),
 c as (select source, reason, count(*) as n from r group by all), s as (select source, reason, string_agg(cast(doc_id as varchar), ',' order by h) as sample from r where reason = 'ok'
 and doc_id in (select doc_id from r where reason = 'ok' qualify row_number() over (partition by source order by h) <= 8) group by all) select c.source, c.reason, n, coalesce(sample, '') as sample from c left join s using (source, reason)""")
def selection_audit(spark, sf_dir):
    """The first rows of each source, counted by reason, with a review sample of those kept."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("place <= 30")
    rows = store(docs.select("source", "doc_id", quality.gate(F.col("text")).alias("reason"), select.hash_rank("audit", F.col("doc_id")).alias("h")))
    sample = first_of(rows.filter("reason = 'ok'"), 8, "source").groupBy("source", "reason").agg(F.array_sort(F.collect_list(F.struct("h", "doc_id"))).alias("s"))
    shown = sample.select("source", "reason", F.array_join(F.transform("s", lambda x: x["doc_id"].cast("string")), ",").alias("sample"))
    return quality.counts(rows, "source", "reason").join(shown, ["source", "reason"], "left").select("source", "reason", "n", F.coalesce("sample", F.lit("")).alias("sample"))


SPLIT4 = "case when bucket < 20 then 'dev' else 'train' end"
SAMPLE_BUCKET = share_sql("doc_id", "sample", 100)


@query(f"""with d as (select doc_id, source, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) as key, strlen(text) as bytes, {SAMPLE_BUCKET} as bucket from documents where ({GATE}) = 'ok'),
 k as (select *, {SPLIT4} as split from d qualify row_number() over (partition by key order by doc_id) = 1), c as (select *, sum(bytes) over (partition by split, source order by doc_id) - bytes as start from k), z as (select * from c where start < 30000),
 g as ({select.set_digest_sql('z', 'key', 'split', 'source')}) select split, source, count(*) as documents, cast(sum(bytes) as bigint) as bytes, cast(min(30000) as bigint) as requested, any_value(digest) as digest from z join g using (split, source) group by split, source""")
def tokenizer_sample(spark, sf_dir):
    """R2 as far as data go: gated, first of its copies, whole documents up to a budget for
    each split and source, and the receipt of each sample.  (No tokenizer is trained here.)"""
    docs = table(spark, sf_dir, "documents").filter(quality.gate(F.col("text")) == quality.ACCEPTED)
    bucket = share("doc_id", "sample", 100)
    rows = docs.select("doc_id", "source", T.content_key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("bytes"), F.when(bucket < 20, "dev").otherwise("train").alias("split"))
    kept = store(select.budget_cut(select.first_by_key(rows, "key", F.col("doc_id")), "bytes", 30_000, ["doc_id"], "split", "source"))
    sizes = kept.groupBy("split", "source").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.lit(30_000).cast("long").alias("requested"))
    return sizes.join(select.set_digest(kept, "key", "split", "source").drop("n"), ["split", "source"])


CURRICULUM = f"""p as (select doc_id as id, source as grp, text, 'prose' as pool from documents union all select item_id, 'b' || cast(item_id // 2 as varchar), text, 'item' from benchmark
 union all select conv_id * 100 + turn, 'c' || cast(conv_id as varchar), text, 'answer' from conversations where role = 'assistant'),
 w as (select *, {WORDS_OF.format("text")} as w from p), x as (select distinct pool, id from (select pool, id, gram from (select pool, id, unnest({words_sql(5, "w")}) as gram from w) group by all having count(*) >= 2)),
 s as (select w.*, case when len(w) < 5 then 'short' when x.id is not null then 'repetition' when not regexp_matches(text, '[.!?]["'')]*\\s*$') then 'ending' else 'ok' end as reason from w left join x using (pool, id))"""


def curriculum(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), "text", F.lit("prose").alias("pool"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("b"), F.expr("item_id div 2").cast("string")).alias("grp"), "text", F.lit("item").alias("pool"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    turns = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("grp"), "text", F.lit("answer").alias("pool"))
    return docs.unionByName(items).unionByName(turns).withColumn("reason", screens.answer_reason(F.col("text")))


@query(f"""with {CURRICULUM} select pool, reason, count(*) as n from s group by all""")
def answer_screens(spark, sf_dir):
    """Texts that are too short, repeat a run of five words, or stop inside a sentence."""
    return quality.counts(curriculum(spark, sf_dir), "pool", "reason")


@query(f"""with {CURRICULUM}, h as (select pool, id, grp, sha256('curriculum:' || pool || ':' || id) as h from s where reason = 'ok'), k as (select * from h qualify row_number() over (partition by pool order by h) <= 200),
 o as (select * from k qualify row_number() over (partition by pool, grp order by h) = 1), a as (select id, h from o where pool = 'prose'), b as (select id, h from o where pool = 'item'), c as (select id, h from o where pool = 'answer'),
 {blocks_sql([("a", 2), ("b", 1), ("c", 3)])}""")
def base_curriculum(spark, sf_dir):
    """Three sources, screened, the first of each by hash, one a group, balanced blocks."""
    rows = curriculum(spark, sf_dir).filter("reason = 'ok'")
    rows = rows.select("pool", "id", "grp", F.sha2(F.concat_ws(":", F.lit("curriculum"), "pool", F.col("id").cast("string")), 256).alias("h"))
    one = store(first_of(first_of(rows, 200, "pool"), 1, "pool", "grp"))
    return blocks([(one.filter(F.col("pool") == name), quota) for name, quota in (("prose", 2), ("item", 1), ("answer", 3))])


@query("""with r as (select d.doc_id, lang, sha256('parent:' || d.doc_id) as h from documents d), p as (select doc_id from r qualify row_number() over (order by h) <= 100),
 n as (select doc_id, lang, sha256('fresh:' || doc_id) as h from r where doc_id not in (select doc_id from p)) select doc_id, lang, row_number() over (partition by lang order by h) as place from n qualify row_number() over (partition by lang order by h) <= 10""")
def answer_completion(spark, sf_dir):
    """Beside a parent selection made again, fresh rows of each family by another hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parent = docs.withColumn("h", select.hash_rank("parent", F.col("doc_id"))).orderBy("h").limit(100).select("doc_id")
    fresh = docs.join(parent, "doc_id", "left_anti").withColumn("h", select.hash_rank("fresh", F.col("doc_id")))
    rows = fresh.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter("place <= 10")
    return rows.select("doc_id", "lang", F.col("place").cast("long").alias("place"))


# ---- trees, scenes, choices ----------------------------------------------------------------


@query(f"""with recursive e as (select conv_id * 100 + turn as id, case when turn > 0 then conv_id * 100 + turn - 1 end as parent, role, length(text) as size, sha256('reply:' || (conv_id * 100 + turn)) as h from conversations),
 r(id, depth) as (select id, 1 from e where parent is null union all select e.id, depth + 1 from e join r on e.parent = r.id where depth < 4), k as (select id, depth, size, h from r join e using (id) where role = 'assistant' and depth in (2, 4) and size < 4000),
 a as (select id, h from k where depth = 2 and size >= 300), b as (select id, h from k where depth = 2 and size < 300), c as (select id, h from k where depth = 4), {blocks_sql([("a", 12), ("b", 3), ("c", 5)])}""")
def reply_blocks(spark, sf_dir):
    """Answers at the first and third step of a tree, in batches of 12, 3 and 5."""
    own = (F.col("conv_id") * 100 + F.col("turn")).alias("id")
    size = table(spark, sf_dir, "conversations").select(own, F.length("text").alias("size"))
    rows = store(reply_chains(spark, sf_dir).join(size, "id").filter("size < 4000").withColumn("h", select.hash_rank("reply", F.col("id"))))
    return blocks([(rows.filter("depth = 2 and size >= 300"), 12), (rows.filter("depth = 2 and size < 300"), 3), (rows.filter("depth = 4"), 5)])


@query("""with recursive e as (select conv_id as tree, conv_id * 100 + turn as id, case when turn > 0 then conv_id * 100 + turn - 1 end as parent, role, length(text) as size from conversations),
 r(tree, id, depth) as (select tree, id, 1 from e where parent is null and size < 3000 union all select e.tree, e.id, depth + 1 from e join r on e.parent = r.id where e.size < 3000),
 k as (select r.tree, r.id, depth from r join e using (id) where role = 'assistant') select tree, id, cast(depth as bigint) as depth from k qualify row_number() over (partition by tree order by depth desc, id) = 1""")
def deepest_replies(spark, sf_dir):
    """Of each tree the deepest answer all of whose ancestors pass, whatever the depth."""
    own = F.col("conv_id") * 100 + F.col("turn")
    nodes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), own.alias("id"), F.when(F.col("turn") > 0, own - 1).alias("parent"), "role", (F.length("text") < 3000).alias("passes"))
    found = passing_depths(nodes.select("id", "parent", "passes")).join(nodes.filter("role = 'assistant'").select("tree", "id"), "id")
    best = found.groupBy("tree").agg(F.max(F.struct("depth", (-F.col("id")).alias("last"))).alias("b"))
    return best.select("tree", (-F.col("b.last")).alias("id"), F.col("b.depth").cast("long").alias("depth"))


FACTS = """f as (select *, sha256('choice:' || grp || ':' || variant) as h from ({0}))"""


@query(f"""with {FACTS.format(ORACLES["multiple_choice"])}, d as (select distinct {NORM_OF.format("text")} as norm from benchmark), o as (select * from f qualify row_number() over (partition by grp order by h) = 1),
 c as (select o.*, case gold when 0 then choice0 else choice1 end as answer from o), k as (select * from c where answer not in (select norm from d) qualify row_number() over (partition by choice0 order by h) <= 10)
 select grp, cast(epoch as bigint) as epoch, case epoch when 0 then answer when 1 then '"' || answer || '"' else '- ' || answer end as shown, sha256('cycle:' || epoch || ':' || grp) as place from k, range(3) e(epoch)""")
def skill_balance(spark, sf_dir):
    """Choices, one a group, equally many of each first choice, three views in cycles."""
    rows = multiple_choice(spark, sf_dir).withColumn("h", F.sha2(F.concat_ws(":", F.lit("choice"), F.col("grp").cast("string"), F.col("variant").cast("string")), 256))
    rows = first_of(rows, 1, "grp").withColumn("answer", F.when(F.col("gold") == 0, F.col("choice0")).otherwise(F.col("choice1")))
    denied = table(spark, sf_dir, "benchmark").select(T.norm(F.col("text")).alias("answer")).distinct()
    rows = first_of(rows.join(denied, "answer", "left_anti"), 10, "choice0")
    views = select.cycle(rows, "grp", 3, "cycle")
    shown = F.when(F.col("epoch") == 0, F.col("answer")).when(F.col("epoch") == 1, F.concat(F.lit('"'), "answer", F.lit('"'))).otherwise(F.concat(F.lit("- "), "answer"))
    return views.select("grp", F.col("epoch").cast("long").alias("epoch"), shown.alias("shown"), F.col("hash").alias("place"))


CONTEXT_BUCKET = share_sql("grp", "context", 10)


@query(f"""with {FACTS.format(ORACLES["multiple_choice"])}, s as (select *, case {CONTEXT_BUCKET} when 8 then 'dev' when 9 then 'test' else 'train' end as split from f), o as (select * from s qualify row_number() over (partition by grp order by h) = 1)
 select split, grp, variant, row_number() over (partition by split order by h) as place from o qualify row_number() over (partition by split order by h) <= 30""")
def context_reasoning(spark, sf_dir):
    """Groups dealt to splits by salted hash, one of a group, so many of each split."""
    bucket = share("grp", "context", 10)
    rows = multiple_choice(spark, sf_dir).withColumn("h", F.sha2(F.concat_ws(":", F.lit("choice"), F.col("grp").cast("string"), F.col("variant").cast("string")), 256))
    rows = first_of(rows.withColumn("split", F.when(bucket == 8, "dev").when(bucket == 9, "test").otherwise("train")), 1, "grp")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("h"))).filter("place <= 30")
    return rows.select("split", "grp", "variant", F.col("place").cast("long").alias("place"))


@query(f"""with recursive {EXPLAINED}, q as (select doc_id as id, label, 'k' || cast(doc_id // 3 as varchar) as scene, array_to_string(pw, ' ') as said, array_to_string(rw, ' ') as why, prompt, answer, sha256('scene:' || doc_id) as h from r where fault = 'ok'),
 e as (select distinct scene as a, 'p' || said as b from q), n as (select a, b from e union select b, a from e), t(node, root) as (select a, a from n union select n.b, t.root from t join n on t.node = n.a), g as (select node as scene, min(root) as grp from t group by 1),
 o as (select q.*, grp from q join g using (scene) qualify row_number() over (partition by why order by h) = 1), k as (select * from o qualify row_number() over (partition by grp, label order by h) = 1), m as (select min(n) as n from (select count(*) as n from k group by label))
 select id, grp, label, row_number() over (partition by label order by h) as place, prompt, answer from k, m qualify row_number() over (partition by label order by h) <= any_value(m.n) over ()""")
def explanation_transfer(spark, sf_dir):
    """Screened explanations; scenes (documents 3k to 3k + 2) that share a description are
    one group (connected components); no explanation twice, of each group one of a label,
    equally many of each label."""
    rows = explained_rows(spark, sf_dir).filter("fault = 'ok'")
    scene = F.concat(F.lit("k"), F.expr("doc_id div 3").cast("string"))
    rows = store(rows.select(F.col("doc_id").alias("id"), "label", scene.alias("scene"), F.concat(F.lit("p"), T.norm(F.col("premise"))).alias("said"), T.norm(F.col("reason")).alias("why"), "prompt", "answer", select.hash_rank("scene", F.col("doc_id")).alias("h")))
    links = rows.select(F.col("scene").alias("a"), F.col("said").alias("b")).distinct()
    named = rows.join(components(links).withColumnRenamed("node", "scene"), "scene").withColumnRenamed("root", "grp")
    one = store(first_of(first_of(named, 1, "why"), 1, "grp", "label"))
    least = one.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    # One row: the size of the smallest label.
    placed = select.places(one, ["h"], "label").withColumn("place", F.col("place") + 1)
    return placed.join(F.broadcast(least)).filter("place <= least").select("id", "grp", "label", "place", "prompt", "answer")


@query("""with h as (select doc_id, source, lang, sha256('balance:' || doc_id) as h from documents), o as (select * from h qualify row_number() over (partition by source, lang order by h) = 1),
 c as (select lang, count(*) as n from o group by 1), r as (select o.*, row_number() over (partition by o.lang order by h) - 1 as i, n from o join c using (lang))
 select doc_id, r.lang, cast(epoch as bigint) as epoch, cast(epoch * r.n + i as bigint) as place from r, range(20) e(epoch) where epoch * r.n + i < 25""")
def balanced_transfer(spark, sf_dir):
    """One document a group, each language's pool cycled until it has 25 rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", select.hash_rank("balance", F.col("doc_id")).alias("h"))
    placed = store(select.places(first_of(rows, 1, "source", "lang"), ["h"], "lang"))
    n = placed.groupBy("lang").agg(F.count("*").alias("n"))
    each = placed.join(n, "lang").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("at", F.col("epoch") * F.col("n") + F.col("place"))
    return each.filter("at < 25").select("doc_id", "lang", F.col("epoch").cast("long").alias("epoch"), F.col("at").cast("long").alias("place"))


@query(f"""with {SPANS}, g as (select doc_id, source, lang, sha256('span:' || doc_id) as h from c where holds and fits), k as (select * from g qualify row_number() over (partition by source, lang order by h) <= 2), t as (select * from k qualify row_number() over (partition by source order by h) <= 4),
 v as (select doc_id as id, h from t where lang = 'en'), w as (select doc_id as id, h from t where lang = 'de'), x as (select doc_id as id, h from t where lang not in ('en', 'de')), {blocks_sql([("v", 4), ("w", 2), ("x", 1)])}""")
def reading_repair(spark, sf_dir):
    """Spans that stand where they say in passages of 35 to 200 words, capped by passage and
    title, in batches of 4, 2 and 1."""
    rows = span_rows(spark, sf_dir).filter("holds and fits").select(F.col("doc_id").alias("id"), "source", "lang", select.hash_rank("span", F.col("doc_id")).alias("h"))
    kept = store(screens.capped(rows, ["h"], [(["source", "lang"], 2), (["source"], 4)]))
    return blocks([(kept.filter("lang = 'en'"), 4), (kept.filter("lang = 'de'"), 2), (kept.filter("lang not in ('en', 'de')"), 1)])


@query(f"""with {FACTS.format(ORACLES["multiple_choice"])}, a as (select grp as id, row_number() over (order by h) - 1 as place from f where variant = 0), i as (select id, row_number() over (order by sha256('task:' || id)) - 1 as place from ({ORACLES["generated_instructions"]})),
 r as (select item_id as id, row_number() over (order by item_id) - 1 as place from benchmark) select cast(place as bigint) as place, unnest([0, 1, 2]) as pool, unnest([cast(a.id as bigint), cast(i.id as bigint), cast(r.id as bigint)]) as id from a join i using (place) join r using (place)""")
def grounded_rank(spark, sf_dir):
    """Choices, instructions and replay, row by row side by side."""
    choices = multiple_choice(spark, sf_dir).filter("variant = 0").select(F.col("grp").alias("id"), F.sha2(F.concat_ws(":", F.lit("choice"), F.col("grp").cast("string"), F.col("variant").cast("string")), 256).alias("h"))
    tasks = generated_instructions(spark, sf_dir).select("id", select.hash_rank("task", F.col("id")).alias("h"))
    replay = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("h"))
    pools = [select.places(rows, ["h"]).select("place", F.col("id").cast("long").alias(f"id{k}")) for k, rows in enumerate((choices, tasks, replay))]
    side = pools[0].join(pools[1], "place").join(pools[2], "place")
    return side.select("place", F.posexplode(F.array("id0", "id1", "id2")).alias("pool", "id"))


PAIR_BUCKET = share_sql("id", "pairs", 20)


@query(f"""with p as ({ORACLES["generated_preferences"]}), s as (select *, case {PAIR_BUCKET} when 0 then 'dev' when 1 then 'test' else 'train' end as split, {NORM_OF.format("prompt")} as norm from p),
 k as (select * from s where split = 'test' or (split = 'dev' and norm not in (select norm from s where split = 'test')) or (split = 'train' and norm not in (select norm from s where split = 'test' or (split = 'dev' and norm not in (select norm from s where split = 'test')))))
 select split, error, count(*) as n, count(distinct norm) as prompts from k group by all""")
def preference_sets(spark, sf_dir):
    """Verified pairs by split; later splits drop prompts that earlier ones keep."""
    bucket = share("id", "pairs", 20)
    rows = generated_preferences(spark, sf_dir).withColumn("split", F.when(bucket == 0, "dev").when(bucket == 1, "test").otherwise("train")).withColumn("norm", T.norm(F.col("prompt")))
    rows, kept = store(rows), None
    for name in ("test", "dev", "train"):
        own = rows.filter(F.col("split") == name)
        own = own if kept is None else own.join(kept.select("norm").distinct(), "norm", "left_anti")
        kept = own if kept is None else kept.unionByName(own.select(*kept.columns))
    return kept.groupBy("split", "error").agg(F.count("*").alias("n"), F.count_distinct("norm").alias("prompts"))


@query("""with p as (select conv_id * 100 + turn as id, 'reply' as pool from conversations where role = 'assistant' union all select item_id, 'replay' from benchmark), h as (select *, sha256('reply:' || pool || ':' || id) as h from p where not (pool = 'reply' and id % 9 = 4)),
 m as (select min(n) as n from (select count(*) as n from h group by pool)) select pool, id, row_number() over (partition by pool order by h) as place from h, m qualify row_number() over (partition by pool order by h) <= any_value(m.n) over ()""")
def clean_replies(spark, sf_dir):
    """Replies and replay, without reviewed ones, equally many of each."""
    replies = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit("reply").alias("pool"))
    rows = replies.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("replay").alias("pool")))
    rejected = replies.filter("id % 9 = 4")
    rows = store(rows.join(rejected, ["pool", "id"], "left_anti").withColumn("h", F.sha2(F.concat_ws(":", F.lit("reply"), "pool", F.col("id").cast("string")), 256)))
    least = rows.groupBy("pool").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    # One row: the size of the smaller pool.
    placed = select.places(rows, ["h"], "pool").withColumn("place", F.col("place") + 1)
    return placed.join(F.broadcast(least)).filter("place <= least").select("pool", "id", "place")


SENTENCES = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ([^a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"


@query(f"""with d as (select doc_id, source, {SENTENCES} as s, 2 + doc_id % 3 as k from documents), o as (select * from d where len(s) >= k qualify row_number() over (partition by source, doc_id % 3 order by sha256('view:' || doc_id)) <= 3)
 select doc_id, cast(k as bigint) as k, case doc_id % 3 when 0 then array_to_string(list_transform(s[1:k], lambda x: '- ' || x), chr(10)) when 1 then array_to_string(s[1:k], chr(10) || chr(10))
 else array_to_string(list_transform(range(1, k + 1), lambda i: i || '. ' || s[i]), chr(10)) end as shown from o""")
def complete_transfer(spark, sf_dir):
    """The first sentences of documents as bullets, paragraphs or numbers, some a source."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "source", screens.sentences(F.col("text")).alias("s"), (2 + F.col("doc_id") % 3).cast("int").alias("k"), (F.col("doc_id") % 3).cast("int").alias("form"), select.hash_rank("view", F.col("doc_id")).alias("h"))
    rows = first_of(rows.filter("size(s) >= k"), 3, "source", "form").withColumn("s", F.slice("s", F.lit(1), F.col("k")))
    shown = F.when(F.col("form") == 0, screens.render(F.col("s"), "bullets")).when(F.col("form") == 1, screens.render(F.col("s"), "paragraphs")).otherwise(screens.render(F.col("s"), "numbered"))
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), shown.alias("shown"))


@query(f"""with d as (select doc_id, {WORDS_OF.format("text")} as w, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n|\\s?\\*\\*\\*\\s?'), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) as paragraphs,
 len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) as sentences from documents)
 select doc_id, sentences, paragraphs, case when len(w) < 3 then 'words' when sentences < 2 then 'sentences' when paragraphs <> 1 then 'paragraphs' else 'ok' end as reason from d""")
def teacher_audit(spark, sf_dir):
    """Texts held to a number of sentences and paragraphs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", C.counted(F.col("text"), F.lit("words")).alias("words"), C.counted(F.col("text"), F.lit("sentences")).cast("long").alias("sentences"), C.counted(F.col("text"), F.lit("paragraphs")).cast("long").alias("paragraphs"))
    reason = quality.first_reason((F.col("words") < 3, "words"), (F.col("sentences") < 2, "sentences"), (F.col("paragraphs") != 1, "paragraphs"))
    return docs.select("doc_id", "sentences", "paragraphs", reason.alias("reason"))


#: Rows of each pool in a batch: constraints, spans, science, replay.
BREADTH = (6, 4, 2, 4)


@query(f"""with h as (select doc_id as id, lang, sha256('breadth:' || doc_id) as h from documents), a as (select id, h from h where lang = 'en'), b as (select id, h from h where lang = 'de'), c as (select id, h from h where lang = 'fr'), e as (select id, h from h where lang = 'es'),
 x as ({"with " + blocks_sql([("a", 6), ("b", 4), ("c", 2), ("e", 4)])}) select pool, batch, count(*) as n, cast(sum(id) as bigint) as ids from x group by all""")
def breadth_batches(spark, sf_dir):
    """Four pools in stable batches of 6, 4, 2 and 4."""
    rows = store(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", select.hash_rank("breadth", F.col("doc_id")).alias("h")))
    found = blocks([(rows.filter(F.col("lang") == lang), quota) for lang, quota in zip(("en", "de", "fr", "es"), BREADTH, strict=True)])
    return found.groupBy("pool", "batch").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QA_WORDS = f"list_filter({WORDS_OF}, lambda x: x not in ('a', 'an', 'the'))"

#: Requests about a document's first sentence, three of four with a rule for the rest of it.
ASKED = f"""y as (select doc_id, s[1] as task, array_to_string(s[2:], ' ') as answer, cast(1 + doc_id % 8 as int) as k from (select doc_id, {SENTENCE_LIST} as s from documents) where len(s) > 1),
 w as (select *, {WORDS_OF.format('task')} as tw, {WORDS_OF.format('answer')} as aw, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) as size, case doc_id % 4 when 0 then 'sentences' when 1 then 'no_comma' when 2 then 'words' end as family from y),
 u as (select *, case family when 'sentences' then len(list_filter(regexp_split_to_array(answer, '[.!?]+'), lambda x: trim(x) <> '')) <= k when 'no_comma' then not contains(answer, ',') when 'words' then len(aw) >= 10 * k end as passed,
 list_distinct(list_filter(tw, lambda x: not list_contains({list(screens.STOPWORDS)}, x))) as topic from w),
 v as (select doc_id, family, passed, topic, case when size not between 30 and 150 then 'answer_length' when family is null then 'unsupported_or_no_task' when not passed then 'target_rule_failure' when len(topic) < 3 then 'weak_topic'
 when len(list_filter(topic, lambda x: list_contains(aw, x))) < 2 then 'weak_relevance' else 'ok' end as reason from u)"""


def asked_rows(spark, sf_dir) -> DataFrame:
    """doc_id, what is asked about a document's first sentence, the rest of it as the answer,
    the checks that the request states, which of them hold, topic words (null, if the answer's
    length is wrong) and the first fault."""
    k = (1 + F.col("doc_id") % 8).cast("int")
    forms = (F.format_string("Write at most %d sentences on this: ", k), F.lit("Without using commas, go on: "), F.format_string("Write at least %d words on this: ", k * 10), F.lit("Go on: "))
    lead = F.get(F.array(*forms), (F.col("doc_id") % 4).cast("int"))
    # The few wordings are parsed once each, not once a document.
    leads = table(spark, sf_dir, "documents").select(lead.alias("lead")).distinct().withColumn("checks", C.parse(F.col("lead")))
    # A generator, as a filter would be pushed below the sentences and make them twice.
    parts = documents(spark, sf_dir).select("doc_id", screens.sentences(F.col("text")).alias("s"))
    told = F.when(F.size("s") > 1, F.array(F.struct(F.get("s", F.lit(0)).alias("task"), F.array_join(F.slice("s", F.lit(2), F.size("s")), " ").alias("answer"))))
    rows = parts.select("doc_id", lead.alias("lead"), F.inline(told)).join(F.broadcast(leads), "lead", "left")
    # An answer is verified only where its length is right, or where a caller asks what it holds.
    held = C.verify(F.col("answer"), F.col("checks"))
    rows = rows.withColumn("held", held).withColumn("sized", F.size(screens.spaced(F.col("answer"))).between(30, 150))
    rows = rows.withColumn("topic", F.when(F.col("sized"), screens.content_words(F.col("task"))))
    common = F.size(F.array_intersect("topic", T.word_list(T.norm(F.col("answer")))))
    reason = quality.first_reason(
        (~F.col("sized"), "answer_length"), (F.coalesce(F.size("checks"), F.lit(0)) < 1, "unsupported_or_no_task"), (F.exists(held, lambda x: ~x), "target_rule_failure"),
        (F.size("topic") < 3, "weak_topic"), (common < 2, "weak_relevance"),
    )
    return rows.withColumn("reason", reason)


@query(f"with {ASKED} select doc_id, family, reason from v")
def constraint_sources(spark, sf_dir):
    """Requests on documents parsed, answers verified against them and screened."""
    return asked_rows(spark, sf_dir).select("doc_id", F.get("checks", F.lit(0))["family"].alias("family"), "reason")


@query(f"""with k as ({greedy_sql(f"{ASKED}, eligible as (select doc_id from v where reason = 'ok'), t as (select doc_id, unnest(topic) as word from v where reason = 'ok')", "eligible")})
 select doc_id, case when {share_sql("doc_id", "constraint", 20)} < 2 then 'dev' when {share_sql("doc_id", "constraint", 20)} < 4 then 'test' else 'train' end as split from k""")
def constraint_completion(spark, sf_dir):
    """Requests parsed, answers verified and screened; of those with similar topic words the
    first in hash order; by split."""
    bucket = share("doc_id", "constraint", 20)
    rows = store(asked_rows(spark, sf_dir).filter("reason = 'ok'").select("doc_id", F.array_sort("topic").alias("words")))
    return greedy(rows).select("doc_id", F.when(bucket < 2, "dev").when(bucket < 4, "test").otherwise("train").alias("split"))


@query(f"""with {ASKED}, c as (select 'constraints' as category, family, count(*) as n, round(avg(cast(passed as int)), 6) as correct, cast(null as double) as f1 from v where family is not null group by 2),
 m as (select conv_id, turn, {QA_WORDS.format('text')} as w from conversations where role = 'assistant'), f as (select *, row_number() over (partition by conv_id order by turn) as k from m), p as (select a.conv_id, b.turn, a.w as x, b.w as y from f a join f b on a.conv_id = b.conv_id and a.k = 1 and b.k > 1),
 q as (select conv_id, turn, word from (select conv_id, turn, unnest(list_distinct(x)) as word from p)), o as (select p.conv_id, p.turn, sum(least(len(list_filter(x, lambda i: i = word)), len(list_filter(y, lambda i: i = word)))) as common from p join q using (conv_id, turn) group by all),
 b as (select p.conv_id, max(case when common > 0 then 2.0 * common / (len(x) + len(y)) else 0.0 end) as f1, bool_or(x = y) as exact from p left join o using (conv_id, turn) group by 1)
 select * from c union all select 'reading', 'reference', count(*), round(avg(cast(exact as int)), 6), round(avg(f1), 6) from b""")
def targeted_assessment(spark, sf_dir):
    """Stored texts assessed: answers by each family of constraint (H11), first replies by
    exact match and the best F1 against the other replies of their conversation (H8)."""
    each = asked_rows(spark, sf_dir).select(F.explode(F.arrays_zip("checks", "held")).alias("c")).select(F.col("c.checks.family").alias("family"), F.col("c.held").alias("held"))
    held = each.groupBy(F.lit("constraints").alias("category"), "family").agg(F.count("*").alias("n"), F.round(F.avg(F.col("held").cast("int")), 6).alias("correct"), F.lit(None).cast("double").alias("f1"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", T.qa_words(F.col("text")).alias("words"))
    first = F.min_by("words", "turn").over(Window.partitionBy("conv_id"))
    least = F.min("turn").over(Window.partitionBy("conv_id"))
    pairs = turns.select("conv_id", "turn", "words", first.alias("first"), least.alias("least")).filter("turn > least")
    best = pairs.groupBy("conv_id").agg(F.max(T.token_f1(F.col("first"), F.col("words"))).alias("f1"), F.bool_or(F.col("first") == F.col("words")).alias("exact"))
    read = best.agg(F.lit("reading").alias("category"), F.lit("reference").alias("family"), F.count("*").alias("n"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("correct"), F.round(F.avg("f1"), 6).alias("f1"))
    return held.unionByName(read)


@query(f"""with a as (select distinct 'intact_conversations' as part, cast(conv_id as bigint) as id from ({ORACLES["intact_conversations"]})), b as (select distinct 'public_repair' as part, cast(conv_id as bigint) as id from ({ORACLES["public_repair"]})),
 m as (select part, id, sha256(part || ':' || id) as h from (select * from a union all select * from b)), x as (select id, h from m where part = 'intact_conversations'), y as (select id, h from m where part = 'public_repair'), {blocks_sql([("x", 3), ("y", 1)])}""")
def mixed_plans(spark, sf_dir):
    """Two plans by their names, made first and then mixed in batches of 3 and 1."""
    rows = jobs.staged(QUERIES, {"intact_conversations": "conv_id", "public_repair": "conv_id"}, spark, sf_dir)
    rows = store(rows.withColumn("h", F.sha2(F.concat_ws(":", "part", F.col("id").cast("string")), 256)))
    return blocks([(rows.filter("part = 'intact_conversations'"), 3), (rows.filter("part = 'public_repair'"), 1)])


@query(f"""with k as (select item_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) as key, {WORDS_OF.format("text")} as w from benchmark), g as (select item_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))) as gram from k)
 select item_id, key, cast(cast(concat('0x', substr(key, 1, 16)) as ubigint) % 10000 as int) as bucket, count(gram) as grams, count(distinct gram) as different from k left join g using (item_id) group by all""")
def sql_functions(spark, sf_dir):
    """The library's functions in SQL text, a table function among them."""
    sql.register(spark)
    return spark.sql(
        """select item_id, brindle_key(text) as key, brindle_bucket(brindle_key(text), 10000) as bucket, count(gram) as grams, count(distinct gram) as different
        from {items} left join lateral brindle_grams(text, 3) group by item_id, text""", items=table(spark, sf_dir, "benchmark"),
    )


@query(f"""with h as (select distinct lang, cast(concat('0x', substr(md5(word), 1, 15)) as bigint) as h from (select lang, unnest({WORDS_OF.format("text")}) as word from documents)), r as (select *, row_number() over (partition by lang order by h) as k from h)
 select lang, cast(case when max(k) < {sql.SKETCH} then max(k) else {sql.SKETCH - 1} * cast({sql.HASHES} as hugeint) // max(h) filter (where k = {sql.SKETCH}) end as bigint) as words from r group by lang""")
def sketched_words(spark, sf_dir):
    """Different words of each language by sketches of 64 parts that are merged."""
    sql.register(spark)
    return spark.sql(
        """with w as (select lang, pmod(doc_id, 64) as part, brindle_hash(word) as h from (select lang, doc_id, explode(w) as word from (select lang, doc_id, brindle_words(text) as w from {docs}))),
        p as (select lang, part, brindle_sketch(h) as s from w group by lang, part), m as (select lang, brindle_merge(s) as s from p group by lang) select lang, brindle_distinct(s) as words from m""",
        docs=documents(spark, sf_dir),
    )


def with_replay(fresh: DataFrame, replays: list[tuple[DataFrame, DataFrame]], per_batch: int, each: int, most: int) -> DataFrame:
    """Batches of ``per_batch`` fresh rows (id, place) in their order, as long as they last and at
    most ``most``, and ``each`` rows of every replay pool, which begins again when it ends:
    batch, pool (0: fresh), id.  A pool is its first ``most`` * ``each`` rows (id, place) in order,
    as no batch reaches further, and one row with its size n."""
    own = fresh.select(F.lit(0).alias("pool"), F.col("id").cast("long").alias("id"), F.floor(F.col("place") / per_batch).cast("long").alias("batch"))
    own = store(own.filter(F.col("batch") < most))
    whole = own.groupBy("batch").agg(F.count("*").alias("n")).filter(F.col("n") == per_batch).select("batch")
    parts = [own.join(whole, "batch", "left_semi")]
    slots = whole.select("batch", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("j"))
    for k, (first, n) in enumerate(replays, 1):
        # One row: the pool's size.
        wanted = slots.join(F.broadcast(n)).withColumn("place", F.pmod(F.col("batch") * each + F.col("j"), F.col("n")))
        parts.append(wanted.join(first, "place").select(F.lit(k).alias("pool"), F.col("id").cast("long").alias("id"), "batch"))
    return reduce(DataFrame.unionByName, [p.select("batch", "pool", "id") for p in parts])


def with_replay_sql(plan: str, fresh: str, replays: list[str], per_batch: int, each: int, most: int) -> str:
    """The same of a table ``fresh`` (id, place) and pools (id, h)."""
    pools = " union all ".join(
        f"select b.batch, {k} as pool, p.id from b, (select unnest(range({each})) as j), (select id, row_number() over (order by h) - 1 as place, count(*) over () as n from {pool}) p where p.place = (b.batch * {each} + j) % p.n"
        for k, pool in enumerate(replays, 1)
    )
    return f"""select '{plan}' as plan, batch, pool, id from (with f as (select id, place, place // {per_batch} as batch from {fresh}), b as (select batch from f group by 1 having count(*) = {per_batch} and batch < {most})
 select batch, 0 as pool, id from f where batch in (select batch from b) union all {pools})"""


#: Fresh rows and rows of each replay pool in a batch, batches at most.
REPAIR = (4, 2, 8)
#: Fresh rows by place of each plan, and the pools that are replayed.
REPAIR_POOLS = f"""{ASKED}, {SPANS}, yes as (select doc_id as id, row_number() over (order by sha256('yes:' || doc_id)) - 1 as k from c where holds and fits and not unanswerable), no as (select doc_id as id, row_number() over (order by sha256('no:' || doc_id)) - 1 as k from c where fits and unanswerable),
 reading as (select cast(id as bigint) as id, cast((k // 7) * 8 + k % 7 as bigint) as place from yes union all select cast(id as bigint), cast(k * 8 + 7 as bigint) from no), reading_rows as (select id, row_number() over (order by place) - 1 as place from reading),
 constraint_rows as (select id, row_number() over (order by k, id) - 1 as place from (select doc_id as id, row_number() over (partition by family order by doc_id) as k from v where reason = 'ok')),
 familiar_rows as (select conv_id as id, row_number() over (order by sha256('familiar:' || conv_id)) - 1 as place from (select distinct conv_id from ({ORACLES["whole_prefix_cut"]}))),
 science_rows as (select doc_id as id, row_number() over (order by sha256('science:' || doc_id)) - 1 as place from ({ORACLES["choice_formats"]}) where gold is not null),
 chats as (select conv_id as id, sha256('chat:' || conv_id) as h from (select distinct conv_id from conversations)), items as (select item_id as id, sha256('item:' || item_id) as h from benchmark)"""


@query(f"with {REPAIR_POOLS} " + " union all ".join(with_replay_sql(plan, rows, ["chats", "items"], *REPAIR) for plan, rows in (("reading", "reading_rows"), ("constraints", "constraint_rows"), ("familiar", "familiar_rows"), ("science", "science_rows"))))
def repair_plans(spark, sf_dir):
    """Four plans by name, each fresh rows of its own kind beside the same replay: spans (one
    in eight without an answer), verified constraints with rare families first, whole
    prefixes of conversations, choices with a key."""
    fresh, again = REPAIR[0] * REPAIR[2], REPAIR[1] * REPAIR[2]
    hashed = lambda rows, salt: rows.select(F.col("id").cast("long").alias("id"), select.hash_rank(salt, F.col("id")).alias("h"))
    ranked = lambda rows, salt: select.first_places(hashed(rows, salt), ["h"], fresh)
    # Whether they hold is told once for each text; the rows of both kinds are taken from that.
    spans = store(span_rows(spark, sf_dir).select(F.col("doc_id").alias("id"), "unanswerable", "holds", "fits")).filter("fits")
    yes = ranked(spans.filter("holds and not unanswerable"), "yes").select("id", (F.floor(F.col("place") / 7) * 8 + F.col("place") % 7).alias("at"))
    no = ranked(spans.filter("unanswerable"), "no").select("id", (F.col("place") * 8 + 7).alias("at"))
    asked = store(asked_rows(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit(0).alias("pool"), F.array(F.get("checks", F.lit(0))["family"]).alias("families"), "reason"))
    plans = {
        "reading": select.first_places(yes.unionByName(no), ["at"], fresh),
        "constraints": screens.rare_first(asked.filter("reason = 'ok'"), "pool", "id", "families", fresh).select("id", F.col("turn").alias("place")),
        "familiar": ranked(QUERIES["whole_prefix_cut"](spark, sf_dir).select(F.col("conv_id").alias("id")).distinct(), "familiar"),
        "science": ranked(QUERIES["choice_formats"](spark, sf_dir).filter("gold is not null").select(F.col("doc_id").alias("id")), "science"),
    }
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    pools = []
    for rows, salt in ((store(chats), "chat"), (items, "item")):
        pools.append((store(select.first_places(hashed(rows, salt), ["h"], again)), store(rows.agg(F.count("*").alias("n")))))
    return reduce(DataFrame.unionByName, [with_replay(rows, pools, *REPAIR).withColumn("plan", F.lit(plan)) for plan, rows in plans.items()])
