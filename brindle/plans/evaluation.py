"""Queries over labels, scores and events: metrics, comparisons, schedules, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import evaluate, quality
from brindle.plans.corpus import GATE, LINES
from brindle.plans.registry import query, table

#: A prediction to evaluate: the gate's verdict on a labelled document.
PREDICTED = f"r as (select d.doc_id, lang, source, strlen(text) as bytes, quality, toxic, case when ({GATE}) = 'ok' then 1 else 0 end as predicted from documents d join labels l using (doc_id))"
WILSON = """round((k / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) {sign}
 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n), 6)"""


def records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("bytes"), F.when(quality.gate(F.col("text")) == "ok", 1).otherwise(0).alias("predicted"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"with {PREDICTED} select lang, round(sum(quality * bytes) / sum(bytes), 6) as weighted, round(avg(quality), 6) as plain, count(*) as n from r group by lang")
def weighted_mean_by_lang(spark, sf_dir):
    weighted = F.sum(F.col("quality") * F.col("bytes")) / F.sum("bytes")
    return records(spark, sf_dir).groupBy("lang").agg(F.round(weighted, 6).alias("weighted"), F.round(F.avg("quality"), 6).alias("plain"), F.count("*").alias("n"))


@query(f"""with {PREDICTED}, s as (select lang, sum(cast(predicted = quality as int)) as k, count(*) as n, avg(predicted) filter (where quality = 1) as r1, avg(1 - predicted) filter (where quality = 0) as r0 from r group by lang)
 select lang, n, round(k / n, 6) as accuracy, {WILSON.format(sign="-")} as low, {WILSON.format(sign="+")} as high, round((r1 + r0) / 2, 6) as balanced from s""")
def accuracy_wilson(spark, sf_dir):
    right = F.sum((F.col("predicted") == F.col("quality")).cast("int"))
    recall = lambda label: F.avg(F.when(F.col("quality") == label, (F.col("predicted") == label).cast("double")))
    rows = records(spark, sf_dir).groupBy("lang").agg(right.alias("k"), F.count("*").alias("n"), ((recall(1) + recall(0)) / 2).alias("balanced"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "n", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round("balanced", 6).alias("balanced"))


@query(f"""with {PREDICTED} select coalesce(lang, '-') as lang, coalesce(source, '-') as source, count(*) as n, round(avg(cast(predicted = quality as int)), 6) as accuracy
 from r group by grouping sets ((), (lang), (source))""")
def grouping_sets_report(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("right", (F.col("predicted") == F.col("quality")).cast("int"))
    totals = rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))
    return totals.select(F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), "n", "accuracy")


@query(f"""with {PREDICTED}, s as (select lang, cast(predicted = quality as int) as before, cast(1 = quality as int) as after from r)
 select lang, count(*) filter (where after > before) as gained, count(*) filter (where after < before) as lost, count(*) filter (where after = before) as same from s group by lang""")
def paired_changes(spark, sf_dir):
    rows = changes(spark, sf_dir)
    return rows.groupBy("lang").agg(*[F.sum((F.col("delta") == v).cast("int")).alias(k) for k, v in (("gained", 1), ("lost", -1), ("same", 0))])


def changes(spark, sf_dir):
    """delta of each record: the gate against always saying good."""
    before, after = (F.col("predicted") == F.col("quality")).cast("int"), (F.col("quality") == 1).cast("int")
    return records(spark, sf_dir).select("doc_id", "lang", (after - before).alias("delta"))


@query(f"""with {PREDICTED}, s as (select lang, cast(predicted = quality as int) as before, cast(1 = quality as int) as after from r), c as (select lang, count(*) filter (where after > before) as gained, count(*) filter (where after < before) as lost from s group by 1)
 select lang, gained, lost, round(case when gained + lost = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) end, 9) as p from c""")
def paired_tests(spark, sf_dir):
    """McNemar's exact p of each language's changes."""
    rows = evaluate.mcnemar(paired_changes(spark, sf_dir).select("lang", F.col("gained").cast("long").alias("gained"), F.col("lost").cast("long").alias("lost")))
    return rows.withColumn("p", F.round("p", 9))


def bootstrap_sql(rows: str) -> str:
    """Weights, sums and points of ``rows`` (key, x)."""
    times = " + ".join(f"cast(u >= {step} as int)" for step in evaluate.poisson_steps())
    return f"""w as (select digest * {evaluate.PER_DIGEST} + j as draw, x, {times} as w from (select digest, j, x, cast(concat('0x', substr(h, j * {evaluate.DIGITS} + 1, {evaluate.DIGITS})) as int) as u
 from (select digest, x, sha256('bootstrap:' || digest || ':' || key) as h from ({rows}), (select unnest(range(63)) as digest)), (select unnest(range({evaluate.PER_DIGEST})) as j))),
 m as (select sum(w * x) / sum(w) as mean from w where draw < 1000 group by draw having sum(w) > 0), q as (select quantile_cont(mean, 0.025) as low, quantile_cont(mean, 0.975) as high from m)"""


@query(f"""with {PREDICTED}, s as (select doc_id as key, cast(cast(1 = quality as int) - cast(predicted = quality as int) as double) as x from r), {bootstrap_sql('s')}
 select count(*) as n, round(avg(x), 9) as delta, round(any_value(low), 9) as low, round(any_value(high), 9) as high from s, q""")
def paired_bootstrap(spark, sf_dir):
    """The gate against always saying good."""
    return rounded(evaluate.bootstrap(changes(spark, sf_dir), "delta", "doc_id"))


def rounded(points):
    return points.select("n", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high")])


@query(f"""with s as (select event_id as key, value as x from events where value is not null), {bootstrap_sql('s')}
 select count(*) as n, round(avg(x), 9) as delta, round(any_value(low), 9) as low, round(any_value(high), 9) as high from s, q""")
def bootstrap_of_values(spark, sf_dir):
    """D12 for real numbers."""
    return rounded(evaluate.bootstrap(table(spark, sf_dir, "events"), "value", "event_id"))


@query(f"""with {PREDICTED}, f as (select source, avg(cast(predicted = quality as int)) as acc, bool_and(predicted = quality) as all_right from r group by source)
 select round(avg(acc), 6) as macro, count(*) filter (where all_right) as perfect, count(*) as groups, bool_and(acc >= 0.5) as passes from f""")
def macro_and_gates(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("right", F.col("predicted") == F.col("quality"))
    each = rows.groupBy("source").agg(F.avg(F.col("right").cast("int")).alias("acc"), F.bool_and("right").alias("all_right"))
    return each.agg(F.round(F.avg("acc"), 6).alias("macro"), F.count_if("all_right").alias("perfect"), F.count("*").alias("groups"), F.bool_and(F.col("acc") >= 0.5).alias("passes"))


@query(f"""with d as (select doc_id, {LINES} as l from documents) select doc_id, round(avg(cast(len(l) > 5 as int)) over (), 6) as share_long,
 case when len(l) = 0 then null else round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?]$'))) / len(l), 6) end as ended from d""")
def conditional_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    total = rows.agg(F.round(F.avg((F.size("l") > 5).cast("int")), 6).alias("share_long"))
    ended = F.size(F.filter("l", lambda x: x.rlike("[.!?]$"))) / F.nullif(F.size("l"), F.lit(0))
    # One row: an aggregate of everything.
    return rows.join(F.broadcast(total)).select("doc_id", "share_long", F.round(ended, 6).alias("ended"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as best, label from embeddings")
def first_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", evaluate.first_max(F.col("embedding")).alias("best"), "label")


TOKENS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' and x not in ('a', 'an', 'the'))"


@query(f"""with t as (select item_id, unnest({TOKENS}) as w from benchmark), c as (select item_id, w, count(*) as k from t group by all), s as (select item_id, sum(k) as n from c group by 1),
 p as (select a.item_id, sum(least(a.k, b.k)) as common from c a join c b on b.item_id = a.item_id + 1 and a.w = b.w group by 1)
 select s.item_id, round(case when common is null then 0 else 2.0 * common / (s.n + o.n) end, 6) as f1 from s join s o on o.item_id = s.item_id + 1 left join p on p.item_id = s.item_id""")
def token_f1(spark, sf_dir):
    """Token F1 of each item against the next, articles left out."""
    words = F.filter(T.word_list(T.norm(F.col("text"))), lambda w: ~w.isin("a", "an", "the"))
    counts = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("k"))
    size = counts.groupBy("item_id").agg(F.sum("k").alias("n"))
    other = counts.select((F.col("item_id") - 1).alias("item_id"), "w", F.col("k").alias("other_k"))
    common = counts.join(other, ["item_id", "w"]).groupBy("item_id").agg(F.sum(F.least("k", "other_k")).alias("common"))
    pairs = size.join(size.select((F.col("item_id") - 1).alias("item_id"), F.col("n").alias("other_n")), "item_id").join(common, "item_id", "left")
    return pairs.select("item_id", F.round(F.coalesce(2.0 * F.col("common") / (F.col("n") + F.col("other_n")), F.lit(0.0)), 6).alias("f1"))


RATE = "case when p < 0.05 then p / 0.05 when p < 0.6 then 1.0 else 0.1 + 0.9 * (1 + cos(pi() * (p - 0.6) / 0.4)) / 2 end"


@query(f"""with e as (select event_id, event_id // 500 <> lag(event_id, 1, event_id) over (partition by user_id order by event_id) // 500 as due, event_id / (select max(event_id) from events) as p from events)
 select event_id, due, round(0.001 * ({RATE}), 9) as rate from e""")
def event_interval_schedule(spark, sf_dir):
    """Interval crossings along each user's events, and the scheduled rate at each."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    total = events.agg(F.max("event_id").alias("total"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events.withColumn("before", F.coalesce(before, "event_id")).join(F.broadcast(total))
    rate = evaluate.learning_rate(F.col("event_id") / F.col("total"), 0.001, 0.05, 0.6, 0.1)
    return rows.select("event_id", evaluate.event_due(F.col("before"), F.col("event_id"), 500).alias("due"), F.round(rate, 9).alias("rate"))


@query("""select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(spark, sf_dir):
    own = F.window("ts", "1 hour")
    rows = table(spark, sf_dir, "events").groupBy(own.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events),
 s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("""with recursive o as (select event_type, value as loss, row_number() over (partition by event_type order by event_id) as i from events),
 r(event_type, i, loss, cap, best, bad, cool, act) as (select event_type, 0, cast(0 as double), cast(1 as double), cast('infinity' as double), 0, 1, '' from (select distinct event_type from o)
 union all select event_type, i, loss, case when a = 'reduced' then greatest(0.1, cap * 0.5) else cap end, case when loss < best - 0.01 then loss else best end, case when a = 'monitoring' then bad + 1 else 0 end,
 case when cool > 0 then cool - 1 when a = 'reduced' then 1 else 0 end, a from (select r.event_type, o.i, o.loss, r.cap, r.best, r.bad, r.cool,
 case when r.cool > 0 then 'cooldown' when o.loss < r.best - 0.01 then 'improved' when r.cap <= 0.1 then 'at-floor' when r.bad + 1 >= 3 then 'reduced' else 'monitoring' end as a
 from r join o on o.event_type = r.event_type and o.i = r.i + 1))
 select event_type, cast(i as int) as i, loss, cap, act from r where i > 0""")
def plateau_controller(spark, sf_dir):
    """The rate cap along all of each type's values, an ordered fold."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return rows.groupBy("event_type").applyInArrow(evaluate.plateau_fold(1.0, 0.1, 0.5, 3, 1, 0.01), "event_type string, i int, loss double, cap double, act string")


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1")
def set_operations(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.filter("lang = 'en'").select("doc_id").intersect(labels.filter("quality = 1").select("doc_id")).exceptAll(labels.filter("toxic = 1").select("doc_id"))


@query("""select 'only_documents' as side, count(*) as n from (select doc_id from documents except select doc_id from labels)
 union all select 'only_labels', count(*) from (select doc_id from labels except select doc_id from documents)""")
def symmetric_difference(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    side = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side(docs.subtract(labels), "only_documents").unionByName(side(labels.subtract(docs), "only_labels"))


CHOICES = """s as (select vec_id, label, embedding[1:4] as v, [1 + vec_id % 7, 3, 2 + vec_id % 3, 5] as chars from embeddings), l as (select vec_id, label % 4 as gold, list_transform(v, lambda x: -abs(cast(x as double)) - 0.001) as score, chars from s),
 p as (select *, list_position(score, list_max(score)) - 1 as raw, list_position(list_transform(range(1, 5), lambda i: score[i] / chars[i]), list_max(list_transform(range(1, 5), lambda i: score[i] / chars[i]))) - 1 as norm from l)"""


@query(f"""with {CHOICES} select gold, count(*) as completed, cast(200 as bigint) as expected, case when count(*) >= 200 then 'complete' else 'partial' end as status, round(avg(cast(raw = gold as int)), 6) as acc, round(avg(cast(norm = gold as int)), 6) as acc_norm from p group by gold""")
def choice_accuracy(spark, sf_dir):
    """Choices by likelihood and by likelihood a character, accuracy of both by task."""
    score = F.transform(F.slice("embedding", 1, 4), lambda x: -F.abs(x.cast("double")) - 0.001)
    chars = F.array(1 + F.col("vec_id") % 7, F.lit(3).cast("long"), 2 + F.col("vec_id") % 3, F.lit(5).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("gold"), score.alias("score"), chars.alias("chars"))
    rows = rows.select("gold", evaluate.first_max(F.col("score")).alias("raw"), evaluate.first_max(evaluate.per_character(F.col("score"), F.col("chars"))).alias("norm"))
    rate = lambda c: F.round(F.avg((F.col(c) == F.col("gold")).cast("int")), 6)
    done = rows.groupBy("gold").agg(F.count("*").alias("completed"), rate("raw").alias("acc"), rate("norm").alias("acc_norm"))
    return done.select("gold", "completed", F.lit(200).cast("long").alias("expected"), F.when(F.col("completed") >= 200, "complete").otherwise("partial").alias("status"), "acc", "acc_norm")


LOOSE = """v as (select item_id, text, [text, regexp_replace(text, '^[^\\n]*\\n?', ''), regexp_replace(text, '\\n?[^\\n]*$', '')] as variants from benchmark),
 f as (select item_id, [not contains(text, ','), length(text) < 250, regexp_matches(text, 'e\\.$')] as strict, list_transform(variants, lambda t: [t <> '' and not contains(t, ','), t <> '' and length(t) < 250, t <> '' and regexp_matches(t, 'e\\.$')]) as each from v),
 g as (select item_id, strict, list_transform(range(1, 4), lambda i: list_bool_or(list_transform(each, lambda x: x[i]))) as loose from f), m as (select item_id, 'strict' as mode, strict as flags from g union all select item_id, 'loose', loose from g)"""


@query(f"""with {LOOSE} select mode, count(*) as prompts, count(*) filter (where list_bool_and(flags)) as prompts_followed, cast(sum(len(flags)) as bigint) as instructions, cast(sum(len(list_filter(flags, lambda x: x))) as bigint) as followed,
 round(avg(cast(list_bool_and(flags) as int)), 6) as prompt_accuracy, round(sum(len(list_filter(flags, lambda x: x))) / sum(len(flags)), 6) as instruction_accuracy from m group by mode""")
def instruction_following(spark, sf_dir):
    """Strict and loose, by prompt (all followed) and by instruction; loose grants what
    holds without the first or the last line."""
    def flags(t):
        return F.array((t != "") & ~F.contains(t, F.lit(",")), (t != "") & (F.length(t) < 250), (t != "") & t.rlike(r"e\.$"))

    rows = table(spark, sf_dir, "benchmark").select(flags(F.col("text")).alias("strict"), F.transform(evaluate.loosened(F.col("text")), flags).alias("each"))
    loose = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.exists("each", lambda x: F.get(x, i)))
    return evaluate.followed(rows.select("strict", loose.alias("loose")))


JUDGED = """a as (select conv_id, turn, length(text) as size from conversations where role = 'assistant'), j as (select conv_id, turn, 'x [RESULT] ' || (1 + length(text) % 5) as reply, case when conv_id % 2 = 0 then 'even' else 'odd' end as category from conversations where role = 'assistant' and conv_id % 5 <> 4),
 s as (select a.conv_id, a.turn, category, cast(nullif(regexp_extract(reply, '\\[RESULT\\]\\s*\\(?([1-9]|10)\\)?\\s*$', 1), '') as int) as score from a left join j using (conv_id, turn))"""


@query(f"""with {JUDGED} select coalesce(cast(turn as varchar), 'all') as turn, coalesce(category, 'all') as category, count(*) as answers, count(score) as judged, round(avg(score), 6) as mean, case when count(score) = count(*) then 'complete' else 'partial' end as status
 from s group by grouping sets ((), (turn), (category)) having not (turn is null and category is null and count(*) = 0)""")
def judged_report(spark, sf_dir):
    """Answers beside their judgments, where there are any; overall, by turn and by category."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    judgments = turns.filter("conv_id % 5 <> 4").select("conv_id", "turn", F.concat(F.lit("x [RESULT] "), (1 + F.length("text") % 5).cast("string")).alias("reply"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("category"))
    rows = turns.select("conv_id", "turn").join(judgments, ["conv_id", "turn"], "left").withColumn("score", T.judge_score(F.col("reply")))
    done = rows.groupingSets([[], ["turn"], ["category"]], "turn", "category").agg(F.count("*").alias("answers"), F.count("score").alias("judged"), F.round(F.avg("score"), 6).alias("mean"))
    status = F.when(F.col("judged") == F.col("answers"), "complete").otherwise("partial")
    return done.select(F.coalesce(F.col("turn").cast("string"), F.lit("all")).alias("turn"), F.coalesce("category", F.lit("all")).alias("category"), "answers", "judged", "mean", status.alias("status"))


@query(f"""with {PREDICTED}, m as (select lang, avg(cast(predicted = quality as int)) as accuracy, avg(predicted) as kept, avg(1 - toxic) as clean, avg(quality) as parent from r group by lang),
 g as (select lang, unnest(['accuracy', 'kept', 'clean']) as metric, unnest([accuracy, kept, clean]) as value, unnest([parent - 0.05, 0.5, 0.8]) as least from m)
 select lang, bool_and(value >= least) as passes, count(*) filter (where value < least) as failed, coalesce(string_agg(metric, ',' order by metric) filter (where value < least), '') as reasons from g group by lang""")
def release_gates(spark, sf_dir):
    """Every metric against its parent or floor, with tolerance; all must hold."""
    rate = lambda c: F.avg(c.cast("double"))
    own = records(spark, sf_dir).groupBy("lang").agg(rate(F.col("predicted") == F.col("quality")).alias("accuracy"), rate(F.col("predicted")).alias("kept"), rate(1 - F.col("toxic")).alias("clean"), rate(F.col("quality")).alias("parent"))
    gates = own.select("lang", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), least.alias("least")) for m, least in (("accuracy", F.col("parent") - 0.05), ("kept", F.lit(0.5)), ("clean", F.lit(0.8)))])))
    return evaluate.gated(gates, "lang")


@query("""with t as (select item_id, regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '\\b(a|an|the)\\b', ' ', 'g') as q from benchmark), n as (select item_id, trim(regexp_replace(q, '\\s+', ' ', 'g')) as q from t),
 r as (select a.item_id, b.item_id as ref, a.q, b.q as rq from n a join n b on b.item_id between a.item_id and a.item_id + 2 and (b.item_id <> a.item_id or a.item_id % 2 = 0)),
 w as (select item_id, ref, unnest(list_distinct(string_split(q, ' '))) as word from r), c as (select r.item_id, r.ref, sum(least(len(list_filter(string_split(q, ' '), lambda x: x = word)), len(list_filter(string_split(rq, ' '), lambda x: x = word)))) as common from r join w using (item_id, ref) group by all)
 select r.item_id, round(max(2.0 * common / (len(string_split(q, ' ')) + len(string_split(rq, ' ')))), 6) as f1, bool_or(q = rq) as exact from r join c using (item_id, ref) group by r.item_id""")
def best_reference(spark, sf_dir):
    """H8: token F1 and exact match of each item against the best of its references."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.qa_words(F.col("text")).alias("words"))
    each = items.select("item_id", "words", F.explode(F.array(*[F.col("item_id") + k for k in range(3)])).alias("ref")).filter("ref <> item_id or item_id % 2 = 0")
    pairs = each.join(items.select(F.col("item_id").alias("ref"), F.col("words").alias("ref_words")), "ref")
    scored = pairs.select("item_id", T.token_f1(F.col("words"), F.col("ref_words")).alias("f1"), (F.col("words") == F.col("ref_words")).alias("exact"))
    return scored.groupBy("item_id").agg(F.round(F.max("f1"), 6).alias("f1"), F.bool_or("exact").alias("exact"))


@query("""with t as (select conv_id, length(text) as size, case when regexp_matches(text, '[.!?]$') then 1.0 else 0.0 end as ended from conversations where role = 'assistant'), c as (select conv_id, avg(ended) as mean from t group by 1)
 select round(sum(size * ended) / sum(size), 6) as by_size, round((select avg(mean) from c), 6) as by_conversation, round(avg(size), 6) as mean_size, count(*) as turns from t""")
def conversation_means(spark, sf_dir):
    """A rate weighted by size, and averaged over conversations."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", F.length("text").alias("size"), F.col("text").rlike("[.!?]$").cast("double").alias("ended"))
    each = turns.groupBy("conv_id").agg(F.sum(F.col("size") * F.col("ended")).alias("held"), F.sum("size").alias("size"), F.avg("ended").alias("mean"), F.count("*").alias("n"))
    return each.agg(
        F.round(F.sum("held") / F.sum("size"), 6).alias("by_size"), F.round(F.avg("mean"), 6).alias("by_conversation"), F.round(F.sum("size") / F.sum("n"), 6).alias("mean_size"), F.sum("n").alias("turns")
    )
