"""Queries over conversations: structure, quality, groups, prefixes, splits, batches."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import quality, select
from brindle.operators.graph import ancestor_chains
from brindle.plans.registry import query, table

NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
#: Messages by conversation with their place in the body (after a leading system message).
PLACED = """m as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) as rn,
 first_value(role) over (partition by conv_id order by turn) = 'system' as lead_system from conversations),
 p as (select *, rn - 1 - cast(lead_system as int) as place, n - cast(lead_system as int) as body from m)"""
STRUCTURE = """case when max(n) < 2 then 'too_few' when bool_or(coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') = '') then 'blank'
 when bool_or(place >= 0 and role <> case when place % 2 = 0 then 'user' else 'assistant' end) then 'alternation' when max(body) = 0 or max(body) % 2 = 1 then 'odd_body' else 'ok' end"""


def messages(spark, sf_dir):
    return quality.conversations(table(spark, sf_dir, "conversations"))


@query(f"with {PLACED} select conv_id, {STRUCTURE} as reason from p group by conv_id")
def conversation_structure(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", quality.structure_reason(F.col("messages")).alias("reason"))


@query(f"""with {PLACED}, s as (select conv_id, {STRUCTURE} as structure, max(length(text)) as longest, sum(length(text)) as total, max(n) as n,
 bool_or(regexp_matches(text, '<\\|(im_start|im_end|endoftext)\\|>')) as marks, bool_or(role = 'assistant' and len(regexp_extract_all(text, '```')) % 2 = 1) as fence,
 bool_or(role = 'assistant' and regexp_matches(text, '!\\[[^\\]]*\\]\\(https?://')) as image from p group by conv_id),
 w as (select conv_id, turn, list_filter(string_split({NORM}, ' '), lambda x: x <> '') as w from conversations where role = 'assistant'),
 g as (select conv_id, turn, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' '))) as gram from w),
 l as (select distinct conv_id from (select conv_id, turn, gram, count(*) as k from g group by all) where k >= 3)
 select conv_id, case when structure <> 'ok' then 'roles_or_empty' when n > 32 or longest > 12000 then 'request_limit' when total > 16000 then 'oversized_candidate' when marks then 'foreign_role_tokens'
 when conv_id in (select conv_id from l) then 'repetitive_target' when fence then 'unclosed_code_fence' when image then 'external_image_target' else 'ok' end as reason from s""")
def conversation_quality(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", quality.conversation_reason(F.col("messages")).alias("reason"))


def group_text(own: Column) -> Column:
    """The first user message of five words or more, else all user messages, normalised."""
    users = F.transform(F.filter(own, lambda m: m["role"] == "user"), lambda m: T.norm(m["content"]))
    return T.let(users, lambda u: F.coalesce(F.get(F.filter(u, lambda x: F.size(F.split(x, " ")) >= 5), F.lit(0)), F.array_join(u, "\n")))


GROUPS = f"""u as (select conv_id, turn, {NORM} as norm from conversations where role = 'user'),
 f as (select c.conv_id, coalesce(min_by(norm, turn) filter (where len(string_split(norm, ' ')) >= 5), string_agg(norm, chr(10) order by turn), '') as t from (select distinct conv_id from conversations) c left join u using (conv_id) group by 1),
 k as (select conv_id, sha256('"' || replace(t, chr(10), '\\n') || '"') as grp from f)"""
GROUP_SPLIT = "case when cast(concat('0x', substr(grp, 1, 8)) as ubigint) % 100 < 5 then 'dev' when cast(concat('0x', substr(grp, 1, 8)) as ubigint) % 100 < 10 then 'test' else 'train' end"


def grouped(spark, sf_dir):
    """conv_id, grp (JSON fingerprint of the group's text) and split."""
    quoted = F.concat(F.lit('"'), F.replace(group_text(F.col("messages")), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    rows = messages(spark, sf_dir).withColumn("grp", F.sha2(quoted, 256))
    bucket = T.hash_mod(F.col("grp"), 8, 100)
    return rows.withColumn("split", F.when(bucket < 5, "dev").when(bucket < 10, "test").otherwise("train"))


@query(f"with {GROUPS} select conv_id, grp, {GROUP_SPLIT} as split from k")
def conversation_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("conv_id", "grp", "split")


@query("""with a as (select conv_id, turn from conversations where role = 'assistant')
 select a.conv_id, a.turn, string_agg('<' || c.role || '>' || c.text, chr(10) order by c.turn) || chr(10) || '<assistant>' as prefix, count(*) as n_before
 from a join conversations c on c.conv_id = a.conv_id and c.turn < a.turn group by all""")
def native_prefix(spark, sf_dir):
    """Each supervised turn with the prompt that stands before it."""
    rows = messages(spark, sf_dir).select("conv_id", "messages", F.posexplode("messages").alias("i", "m")).filter("m.role = 'assistant' and i > 0")
    shown = F.transform(F.slice("messages", F.lit(1), F.col("i")), lambda m: F.concat(F.lit("<"), m["role"], F.lit(">"), m["content"]))
    return rows.select("conv_id", F.col("m.turn").alias("turn"), F.concat(F.array_join(shown, "\n"), F.lit("\n<assistant>")).alias("prefix"), F.col("i").cast("long").alias("n_before"))


@query("""with c as (select *, max(case when role = 'assistant' and len(string_split(text, ' ')) > 192 then 1 else 0 end) over (partition by conv_id order by turn) as over from conversations),
 k as (select * from c where over = 0), l as (select conv_id, max(turn) as last from k where role = 'assistant' group by 1)
 select k.conv_id, count(*) as kept, max(k.turn) as last_turn from k join l on k.conv_id = l.conv_id and k.turn <= l.last group by 1""")
def whole_prefix_cut(spark, sf_dir):
    """Messages before the first long answer, up to a whole answer."""
    long = F.when((F.col("role") == "assistant") & (F.size(F.split("text", " ")) > 192), 1).otherwise(0)
    turns = table(spark, sf_dir, "conversations")
    turns = turns.withColumn("over", F.max(long).over(Window.partitionBy("conv_id").orderBy("turn"))).filter("over = 0")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    kept = turns.withColumn("last", last).filter("turn <= last")
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.max("turn").alias("last_turn"))


@query(f"""with {GROUPS}, s as (select c.conv_id, {GROUP_SPLIT} as split, grp, count(*) as n, sum(length(text)) filter (where role = 'assistant') as target from conversations c join k using (conv_id) group by all)
 select split, count(*) as conversations, count(*) filter (where n > 2) as multi_turn, cast(sum(coalesce(target, 0)) as bigint) as targets, max(n) as most, quantile_cont(n, 0.5) as median, count(distinct grp) as groups from s group by split""")
def split_receipt(spark, sf_dir):
    rows = grouped(spark, sf_dir)
    target = F.aggregate(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0), lambda n, m: n + F.length(m["content"]))
    rows = rows.select("split", "grp", F.size("messages").cast("long").alias("n"), target.alias("target"))
    return rows.groupBy("split").agg(
        F.count("*").alias("conversations"), F.count_if(F.col("n") > 2).alias("multi_turn"), F.sum("target").cast("long").alias("targets"), F.max("n").alias("most"),
        F.percentile("n", F.lit(0.5)).alias("median"), F.count_distinct("grp").alias("groups"),
    )


@query(f"""with s as (select conv_id, string_split({NORM}, ' ')[1] as topic, case when conv_id % 3 = 0 then 'test' else 'train' end as split from conversations where turn = 0 and role = 'user')
 select topic, count(distinct split) as splits, count(*) as n from s group by topic having count(distinct split) > 1""")
def leakage_audit(spark, sf_dir):
    """First words of requests that occur in more than one split; empty when splits are clean."""
    first = table(spark, sf_dir, "conversations").filter("turn = 0 and role = 'user'")
    first = first.select(F.split(T.norm(F.col("text")), " ")[0].alias("topic"), F.when(F.col("conv_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return select.leaks(first, "topic", "split")


@query("""with c as (select conv_id, role, turn, row_number() over (partition by role order by conv_id, turn) - 1 as i from conversations)
 select conv_id, turn, role, cast(i // case when role = 'user' then 6 when role = 'assistant' then 4 else 2 end as bigint) as batch from c""")
def batch_composition(spark, sf_dir):
    quota = F.when(F.col("role") == "user", 6).when(F.col("role") == "assistant", 4).otherwise(2)
    return select.batches(table(spark, sf_dir, "conversations"), "role", quota, "conv_id", "turn").select("conv_id", "turn", "role", "batch")


@query("""with recursive e as (select conv_id * 100 + turn as id, case when turn > 0 then conv_id * 100 + turn - 1 end as parent, role from conversations),
 r(id, depth) as (select id, 1 from e where parent is null union all select e.id, depth + 1 from e join r on e.parent = r.id where depth < 4)
 select r.id, cast(depth as int) as depth from r join e using (id) where role = 'assistant' and depth in (2, 4)""")
def reply_chains(spark, sf_dir):
    """Assistant messages whose chain of parents ends after one or three steps."""
    own = F.col("conv_id") * 100 + F.col("turn")
    nodes = table(spark, sf_dir, "conversations").select(own.alias("id"), F.when(F.col("turn") > 0, own - 1).alias("parent"), "role")
    chains = ancestor_chains(nodes.select("id", "parent"), 3).select("id", F.size("chain").alias("depth"))
    return chains.join(nodes.filter("role = 'assistant'").select("id"), "id", "left_semi").filter("depth in (2, 4)")


@query(f"""with u as (select conv_id, turn, list_filter(string_split({NORM}, ' '), lambda x: x <> '') as w from conversations),
 g as (select conv_id, turn, i, array_to_string(w[i:i+3], ' ') as gram from u, lateral (select unnest(range(1, greatest(len(w) - 2, 1))) as i)),
 r as (select *, row_number() over (partition by conv_id, turn, gram order by i) as k from g), p as (select distinct conv_id, turn, i + j as pos from r, range(4) t(j) where k > 1)
 select conv_id, turn, count(*) as masked from p group by all""")
def repetition_mask(spark, sf_dir):
    """How many words stand in the second or a later occurrence of a four-word run."""
    words = T.word_list(T.norm(F.col("text")))
    grams = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.gram_list(words, 4)).alias("i", "gram"))
    again = grams.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "turn", "gram").orderBy("i"))).filter("k > 1")
    places = again.select("conv_id", "turn", F.explode(F.sequence("i", F.col("i") + 3)).alias("pos")).distinct()
    return places.groupBy("conv_id", "turn").agg(F.count("*").alias("masked"))
