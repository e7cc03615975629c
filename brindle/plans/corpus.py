"""Queries over documents, benchmark and pages: identity, gates, dedup, exclusion, choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import fixed
from brindle.functions import text as T
from brindle.operators import quality, select, similar
from brindle.operators.graph import components, store
from brindle.operators.packing import offsets, pack
from brindle.plans.registry import documents, query, table

# SQL fragments that several oracles share.
KEY = r"sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')))"
BUCKET = f"cast(cast(concat('0x', substr({KEY}, 1, 16)) as ubigint) % 10000 as int)"
SPLIT = f"case when {BUCKET} < 100 then 'final' when {BUCKET} < 200 then 'validation' when {BUCKET} < 300 then 'tokenizer_dev' else 'train' end"
LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
GATE = f"""case when text is null then 'missing' when length(text) < 200 then 'min_chars' when strlen(text) > 200000 then 'max_bytes'
 when contains(text, chr(0)) then 'nul' when length(text) - length(replace(text, '�', '')) > 2 then 'replacement_chars'
 when len({LINES}) >= 10 and len(list_distinct({LINES})) / len({LINES}) < 0.5 then 'repeated_lines' else 'ok' end"""
NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


def byte_tokens(text):
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def words_sql(n: int, words: str) -> str:
    """All n-word runs of a word list."""
    return f"list_transform(range(1, greatest(len({words}) - {n - 2}, 1)), lambda i: array_to_string({words}[i:i+{n - 1}], ' '))"


WORDS = f"list_filter(string_split({NORM}, ' '), lambda w: w <> '')"
PROSE_WORDS = r"list_transform(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda w: lower(w))"


def keyed(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("key", T.content_key(F.col("text")))
    return docs.withColumn("split", T.corpus_split(F.col("key")))


@query(f"""with d as (select *, {KEY} as key, {SPLIT} as split, {GATE} as reason from documents),
 k as (select *, row_number() over (partition by key order by doc_id) as rn from d)
 select split, source, case when rn > 1 and reason = 'ok' then 'duplicate' else reason end as reason, count(*) as n, cast(sum(strlen(text)) as bigint) as bytes from k group by all""")
def split_quality_census(spark, sf_dir):
    """One scan: rows are counted by key, source and reason; of the accepted rows of a key all
    but its first document are duplicates."""
    docs = keyed(spark, sf_dir).withColumn("reason", quality.gate(F.col("text"))).select("doc_id", "key", "split", "source", "reason", F.octet_length("text").cast("long").alias("size"))
    own = docs.groupBy("key", "split", "source", "reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("doc_id"), F.min_by("size", "doc_id").alias("size"))
    own = own.withColumn("first", F.min("doc_id").over(Window.partitionBy("key")) == F.col("doc_id"))
    row = lambda reason, n, size: F.struct(reason.alias("reason"), n.cast("long").alias("n"), size.alias("bytes"))
    first = F.array(row(F.lit("ok"), F.lit(1), F.col("size")), row(F.lit("duplicate"), F.col("n") - 1, F.col("bytes") - F.col("size")))
    told = F.when(F.col("reason") != "ok", F.array(row(F.col("reason"), F.col("n"), F.col("bytes")))).when(F.col("first"), first).otherwise(F.array(row(F.lit("duplicate"), F.col("n"), F.col("bytes"))))
    return own.select("split", "source", F.inline(told)).filter("n > 0").groupBy("split", "source", "reason").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


@query(f"select doc_id, {KEY} as key, {BUCKET} as bucket, {SPLIT} as split from documents")
def content_keys(spark, sf_dir):
    docs = keyed(spark, sf_dir)
    return docs.select("doc_id", "key", T.hash_mod(F.col("key"), 16, 10_000).cast("int").alias("bucket"), "split")


@query(f"with d as (select source, {GATE} as reason from documents) select source, reason, count(*) as n from d group by all")
def quality_gate_reasons(spark, sf_dir):
    return quality.counts(documents(spark, sf_dir).select("source", quality.gate(F.col("text")).alias("reason")), "source", "reason")


@query(f"""with d as (select doc_id, text, {GATE} as gate, {SPLIT} as split, {PROSE_WORDS} as w,
 length(regexp_replace(text, '\\P{{L}}', '', 'g')) as letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as plain from documents),
 g as (select *, {words_sql(8, "w")} as grams from d),
 r as (select case when gate <> 'ok' then 'source_quality_or_length' when split <> 'train' then 'reserved_partition'
 when regexp_matches(text, {fixed.quoted(fixed.CODE_TOPIC)}) then 'code_topic' when regexp_matches(text, {fixed.quoted(fixed.MATH_TOPIC)}) then 'math_topic'
 when contains(text, '�') or contains(text, chr(0)) or regexp_matches(text, {fixed.quoted(fixed.BOILERPLATE)}) then 'boilerplate_or_encoding' when len(w) < 35 then 'too_little_prose'
 when letters = 0 or plain / letters < 0.95 then 'non_english_script' when len(grams) > 0 and 1 - len(list_distinct(grams)) / len(grams) > 0.2 then 'repetition' else 'ok' end as reason from g)
 select reason, count(*) as n from r group by all""")
def prose_selection_reasons(spark, sf_dir):
    text = F.col("text")
    docs = documents(spark, sf_dir).select("text", quality.gate(text).alias("gate"))
    # Only what the gate lets through needs a key.
    rest = docs.filter(F.col("gate") == quality.ACCEPTED).select("text", "gate", T.corpus_split(T.content_key(text)).alias("split"))
    early = docs.filter(F.col("gate") != quality.ACCEPTED).select(F.lit("source_quality_or_length").alias("reason"))
    return quality.counts(rest.select(quality.prose_reason(text, F.col("gate"), F.col("split")).alias("reason")).unionByName(early), "reason")


@query(f"select doc_id, len({LINES}) as n_lines, round(case when len({LINES}) > 0 then len(list_distinct({LINES})) / len({LINES}) else 1 end, 6) as distinct_share from documents")
def repeated_line_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("rows"))
    n = F.size("rows")
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.round(F.when(n > 0, F.size(F.array_distinct("rows")) / n).otherwise(1.0), 6).alias("distinct_share"))


@query(f"""with d as (select doc_id, {PROSE_WORDS} as w from documents), g as (select doc_id, {words_sql(8, "w")} as grams from d)
 select doc_id, round(case when len(grams) > 0 then 1 - len(list_distinct(grams)) / len(grams) else 0 end, 6) as dup_share from g""")
def dup_8gram_share(spark, sf_dir):
    grams = T.gram_hashes(quality.prose_words(F.lower(F.col("text"))), 8)
    return documents(spark, sf_dir).select("doc_id", F.round(T.repeat_share(grams), 6).alias("dup_share"))


@query(f"""with d as (select doc_id, {WORDS} as w from documents), g as (select doc_id, unnest({words_sql(4, "w")}) as gram from d),
 c as (select doc_id, gram, count(*) as n from g group by all), m as (select doc_id, max(n) as most, cast(sum(n - 1) as double) as extra, sum(n) as total from c group by 1)
 select d.doc_id, coalesce(most, 0) as most, round(coalesce(extra / total, 0), 6) as repeated, coalesce(most, 0) >= 3 as looped from d left join m using (doc_id)""")
def fourgram_loops(spark, sf_dir):
    grams = T.gram_list(T.word_list(T.norm(F.col("text"))), 4)
    rows = table(spark, sf_dir, "documents").select("doc_id", grams.alias("grams"))
    most = T.most_repeated(F.col("grams"))
    return rows.select("doc_id", most.cast("long").alias("most"), F.round(T.repeat_share(F.col("grams")), 6).alias("repeated"), (most >= 3).alias("looped"))


@query(f"with d as (select doc_id, source, {KEY} as key from documents) select key, min(doc_id) as doc_id, min_by(source, doc_id) as source, count(*) as copies from d group by key")
def exact_dedup_keep(spark, sf_dir):
    docs = keyed(spark, sf_dir)
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("copies"))


@query(f"with d as (select {KEY} as key from documents), c as (select count(*) as copies from d group by key) select copies, count(*) as groups from c group by 1")
def dup_cluster_sizes(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("key").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("groups"))


@query(f"""with d as (select doc_id, {NORM} as norm from documents), b as (select distinct {NORM} as norm from benchmark)
 select doc_id, exists (select 1 from b where b.norm = d.norm) as excluded from d""")
def decontam_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.norm(F.col("text")).alias("norm"))
    denied = table(spark, sf_dir, "benchmark").select(T.norm(F.col("text")).alias("norm")).distinct().withColumn("hit", F.lit(True))
    return docs.join(denied, "norm", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("excluded"))


def gram_table(name: str, id_column: str, n: int) -> str:
    return f"select {id_column}, unnest(list_distinct({words_sql(n, 'w')})) as gram from (select {id_column}, {WORDS} as w from {name})"


@query(f"with g as ({gram_table('documents', 'doc_id', 13)}), b as ({gram_table('benchmark', 'item_id', 13)}) select distinct doc_id from g where gram in (select gram from b)")
def decontam_13gram(spark, sf_dir):
    return select.overlapping(documents(spark, sf_dir), "doc_id", table(spark, sf_dir, "benchmark"))


@query(f"""with g as ({gram_table('documents', 'doc_id', 13)}), b as ({gram_table('benchmark', 'item_id', 13)})
 select doc_id, item_id, count(*) as shared from g join b using (gram) group by all""")
def overlap_gram_counts(spark, sf_dir):
    docs = select.grams_of(table(spark, sf_dir, "documents"), "doc_id", "text", 13)
    items = select.grams_of(table(spark, sf_dir, "benchmark"), "item_id", "text", 13)
    return docs.join(items, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


HOLDOUT = f"""with d as (select doc_id, source, case when cast(concat('0x', substr(sha256(concat('holdout:', source)), 1, 8)) as ubigint) % 10 < 1 then 'test'
 when cast(concat('0x', substr(sha256(concat('holdout:', source)), 1, 8)) as ubigint) % 10 < 3 then 'dev' else 'train' end as split from documents),
 g as ({gram_table('documents', 'doc_id', 13)}),
 dev as (select doc_id from d where split = 'dev' and doc_id not in (select doc_id from g where gram in (select gram from g join d using (doc_id) where split = 'test'))),
 held as (select gram from g where doc_id in (select doc_id from d where split = 'test' union select doc_id from dev)),
 train as (select doc_id from d where split = 'train' and doc_id not in (select doc_id from g where gram in (select gram from held)))
 select doc_id, split from d where split = 'test' or doc_id in (select doc_id from dev) or doc_id in (select doc_id from train)"""


@query(HOLDOUT)
def heldout_phrase_exclusion(spark, sf_dir):
    docs = documents(spark, sf_dir)
    split = T.group_split(F.col("source"), "holdout", 10, 0, 1)
    dev = T.hash_mod(F.sha2(F.concat(F.lit("holdout:"), F.col("source")), 256), 8, 10).between(1, 2)
    docs = docs.withColumn("split", F.when(dev, "dev").otherwise(split)).select("doc_id", "text", "split")
    return select.sequential_holdout(docs, "doc_id", "split", ["test", "dev", "train"], 13).select("doc_id", "split")


JACCARD = f"""with t as (select item_id, unnest(list_distinct({WORDS})) as word from benchmark), s as (select item_id, count(*) as n from t group by 1),
 c as (select a.item_id as left_id, b.item_id as right_id, count(*) as common from t a join t b using (word) where a.item_id < b.item_id group by all)
 select left_id, right_id, common, round(common / (x.n + y.n - common), 6) as jaccard from c join s x on left_id = x.item_id join s y on right_id = y.item_id"""


def jaccard(spark, sf_dir):
    """Items with a common word; an inverted index of words gives the pairs."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.word_list(T.norm(F.col("text")))).alias("words"))
    each = rows.select("item_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    left = each.select("word", F.col("item_id").alias("left_id"), F.col("n").alias("left_n"))
    right = each.select("word", F.col("item_id").alias("right_id"), F.col("n").alias("right_n"))
    pairs = left.join(right, "word").filter("left_id < right_id").groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count("*").alias("common"))
    return pairs.select("left_id", "right_id", "common", F.round(F.col("common") / (F.col("left_n") + F.col("right_n") - F.col("common")), 6).alias("jaccard"))


@query(f"{JACCARD} where common / (x.n + y.n - common) >= 0.2")
def jaccard_pairs(spark, sf_dir):
    return jaccard(spark, sf_dir).filter("jaccard >= 0.2")


@query(f"""with recursive e as (select distinct left_id as a, right_id as b from ({JACCARD} where common / (x.n + y.n - common) >= 0.25)),
 b2 as (select a, b from e union select b, a from e), r(node, root) as (select item_id, item_id from benchmark union select b2.b, r.root from r join b2 on r.node = b2.a)
 select node as item_id, min(root) as root from r group by 1""")
def jaccard_components(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    links = jaccard(spark, sf_dir).filter("jaccard >= 0.25").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    found = components(links).withColumnRenamed("node", "item_id")
    return items.join(found, "item_id", "left").select("item_id", F.coalesce("root", "item_id").alias("root"))


def document_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(T.word_list(T.norm(F.col("text"))))).alias("words"))


def word_sets(rows):
    """Rows (doc_id, sorted words) with words and their classes of equal sets: (doc_id, node) and
    (node, words, first); node is a class's smallest id, first its first row in hash order."""
    rows = store(rows.filter("size(words) > 0"))
    order = F.struct(select.hash_rank("seed", F.col("doc_id")).alias("h"), "doc_id")
    nodes = store(rows.groupBy("words").agg(F.min("doc_id").alias("node"), F.min(order).alias("first")))
    return rows.join(nodes.select("words", "node"), "words").select("doc_id", "node"), nodes


def similar_sets(nodes):
    """left, right, common, total: classes whose sets have a Jaccard similarity of 0.6 or more.

    Those whose indexed words meet and whose sketches are close (``similar.candidates``) are
    counted over their words; others never meet their sets."""
    hashed = store(nodes.select("node", F.transform("words", lambda w: F.xxhash64(w)).alias("h")))
    pairs = store(similar.candidates(hashed))
    sets = lambda name: nodes.select(F.col("node").alias(name), F.col("words").alias(f"{name}_words"))
    counted = pairs.join(sets("left"), "left").join(sets("right"), "right").withColumn("common", F.size(F.array_intersect("left_words", "right_words")))
    counted = counted.select("left", "right", "common", (F.size("left_words") + F.size("right_words") - F.col("common")).alias("total"))
    return store(counted.filter("5 * common >= 3 * total"))


#: Pairs of similar sets of a table t (doc_id, word).
SIMILAR = """s as (select doc_id, count(*) as n from t group by 1), c as (select a.doc_id as left_id, b.doc_id as right_id, count(*) as common from t a join t b using (word) where a.doc_id < b.doc_id group by all),
 pairs as (select left_id, right_id, common, round(common / (x.n + y.n - common), 6) as jaccard from c join s x on left_id = x.doc_id join s y on right_id = y.doc_id where 5 * common >= 3 * (x.n + y.n - common))"""
SETS = f"t as (select doc_id, unnest(list_distinct({WORDS})) as word from documents), {SIMILAR}"


@query(f"with {SETS} select * from pairs")
def document_jaccard_pairs(spark, sf_dir):
    """Every two documents whose word sets have a Jaccard similarity of 0.6 or more."""
    members, nodes = word_sets(document_words(spark, sf_dir))
    equal = nodes.select(F.col("node").alias("left"), F.col("node").alias("right"), F.size("words").alias("common"), F.size("words").alias("total"))
    found = similar_sets(nodes).unionByName(equal)
    side = lambda name, own: members.select(F.col("node").alias(name), F.col("doc_id").alias(own))
    rows = found.join(side("left", "a"), "left").join(side("right", "b"), "right").filter("left <> right or a < b")
    return rows.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), F.col("common").cast("long").alias("common"), F.round(F.col("common") / F.col("total"), 6).alias("jaccard"))


@query(f"""with recursive {SETS}, e as (select left_id as a, right_id as b from pairs union all select right_id, left_id from pairs), r(node, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on r.node = e.a)
 select node as doc_id, min(root) as root from r group by 1""")
def dup_components(spark, sf_dir):
    """Each document and the smallest id connected to it by those pairs."""
    members, nodes = word_sets(document_words(spark, sf_dir))
    found = components(similar_sets(nodes).select(F.col("left").alias("a"), F.col("right").alias("b")))
    near = members.join(found, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    return table(spark, sf_dir, "documents").select("doc_id").join(near, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


def greedy_sql(sets: str, rows: str) -> str:
    """The rows kept, of a table with doc_id whose words ``sets`` has as t."""
    return f"""with recursive {sets}, {SIMILAR}, e as (select left_id as doc_id, right_id as other from pairs union all select right_id, left_id from pairs), near as (select doc_id, list(other) as others from e group by 1),
 o as (select doc_id, row_number() over (order by sha256('seed:' || doc_id), doc_id) as i from {rows}), r(i, kept) as (select cast(0 as bigint), cast([] as bigint[]) union all
 select o.i, case when list_has_any(coalesce(others, []), kept) then kept else list_append(kept, o.doc_id) end from r join o on o.i = r.i + 1 left join near on near.doc_id = o.doc_id) select unnest(kept) as doc_id from r where i = (select count(*) from {rows})"""


@query(greedy_sql(f"t as (select doc_id, unnest(list_distinct({WORDS})) as word from documents)", "documents"))
def greedy_keep_first(spark, sf_dir):
    """Documents of which no similar one comes before in hash order."""
    return greedy(document_words(spark, sf_dir))


def greedy(whole):
    """Rows (doc_id, words) in hash order, each kept unless its word set is similar to that of
    one kept before; one task per component, as no choice depends on another component."""
    members, nodes = word_sets(whole)
    links = similar_sets(nodes).select(F.col("left").alias("a"), F.col("right").alias("b"))
    both = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("near"))
    rows = both.join(components(links), "node").join(nodes.select("node", "first"), "node").select("root", "node", "near", F.col("first.h").alias("h"), F.col("first.doc_id").alias("doc_id"))

    def choose(frame):
        frame, kept = frame.sort_values(["h", "doc_id"]), set()
        for node, near in zip(frame["node"], frame["near"], strict=True):
            if kept.isdisjoint(near):
                kept.add(node)
        return frame.loc[frame["node"].isin(kept), ["doc_id"]]

    lone = nodes.join(both, "node", "left_anti").select(F.col("first.doc_id").alias("doc_id"))
    empty = whole.select("doc_id").join(members, "doc_id", "left_anti")
    return rows.groupBy("root").applyInPandas(choose, "doc_id long").unionByName(lone).unionByName(empty)


URL_KEY = r"""regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
 || case when regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' then '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) else '' end"""


@query(f"select page_id, {URL_KEY} as url_key, sha256({URL_KEY}) as key from pages")
def url_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"))
    return pages.withColumn("key", F.sha2("url_key", 256))


CONTENT = r"sha256(trim(regexp_replace(nfc_normalize({0}), '\s+', ' ', 'g')))"
KEY_SETS = f"""k as (select page_id, unnest(list_filter(['content:' || {CONTENT.format('html')}, 'id:' || {CONTENT.format("'page-' || (page_id // 2)")}, case when {URL_KEY} <> '' then 'url:' || {CONTENT.format(URL_KEY)} end], lambda x: x is not null)) as key from pages)"""


def page_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    own = F.concat(F.lit("page-"), F.expr("page_id div 2").cast("string"))
    return pages.select("page_id", F.explode(T.provenance_keys(F.col("html"), own, F.col("url"))).alias("key"))


@query(f"with {KEY_SETS} select page_id, key from k")
def provenance_key_sets(spark, sf_dir):
    """Content, id and URL keys of every page."""
    return page_keys(spark, sf_dir)


@query(f"with {KEY_SETS} select page_id from pages where page_id % 5 = 0 or page_id not in (select page_id from k where key in (select key from k where page_id % 5 = 0))")
def key_overlap_exclusion(spark, sf_dir):
    """Pages that share no key (content, id or URL) with the reserved fifth, and these."""
    keys, pages = store(page_keys(spark, sf_dir)), table(spark, sf_dir, "pages").select("page_id")
    reserved = store(keys.filter("page_id % 5 = 0").select("key").distinct())
    bad = keys.filter("page_id % 5 <> 0").join(reserved, "key", "left_semi").select("page_id").distinct()
    return pages.join(bad, "page_id", "left_anti")


@query("""with s as (select source as label, count(*) as weight, row_number() over (order by source) as ord from documents group by source),
 q as (select label, ord, 1000 * weight // sum(weight) over () as floor from s) select label, cast(floor + case when ord <= 1000 - sum(floor) over () then 1 else 0 end as bigint) as quota from q""")
def source_quotas(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("weight")).select(F.col("source").alias("label"), "weight", F.col("source").alias("ord"))
    return select.quotas(sources, 1000)


@query("""with d as (select doc_id, source, strlen(text) + 1 as size, sum(strlen(text) + 1) over (partition by source order by doc_id) - (strlen(text) + 1) as before from documents)
 select doc_id, source, cast(before as bigint) as start from d where before < 20000""")
def cumulative_budget_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length("text") + 1).cast("long").alias("size"))
    return select.budget_cut(docs, "size", 20_000, ["doc_id"], "source").select("doc_id", "source", F.col("before").alias("start"))


HASH = "sha256(concat('seed:', cast(doc_id as varchar)))"


@query(f"select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by {HASH}, doc_id) as rank from documents) where rank <= 3")
def hash_topk_per_source(spark, sf_dir):
    rows = select.top_by_hash(table(spark, sf_dir, "documents").select("source", "doc_id"), 3, "seed", "doc_id", "source")
    return rows.select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with k as (select doc_id, {KEY} as grp, {HASH} as h from documents), one as (select *, row_number() over (partition by grp order by h, doc_id) as rn from k)
 select doc_id, grp from one where rn = 1 order by h, doc_id limit 100""")
def group_unique_choose(spark, sf_dir):
    rows = keyed(spark, sf_dir).select("doc_id", F.col("key").alias("grp"), select.hash_rank("seed", F.col("doc_id")).alias("h"))
    return select.first_by_key(rows, "grp", F.col("h"), F.col("doc_id")).orderBy("h", "doc_id").limit(100).select("doc_id", "grp")


WEIGHTS = "case when lang = 'en' then 55 when lang = 'de' then 25 when lang = 'fr' then 10 else 10 end"


@query(f"""with d as (select doc_id, lang, {WEIGHTS} as w, row_number() over (partition by lang order by doc_id) - 1 as i from documents)
 select doc_id, lang, row_number() over (order by i / w, lang) as place from d""")
def weighted_interleave(spark, sf_dir):
    lang = F.col("lang")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(lang == "en", 55).when(lang == "de", 25).otherwise(10).alias("w"))
    rows = select.weighted_interleave(docs, "lang", "w", "lang", "doc_id").select("doc_id", "lang", "turn_key", F.lit(1).cast("long").alias("one"))
    return offsets(rows, "turn_key", "one").select("doc_id", "lang", (F.col("start") + 1).alias("place"))


@query("select doc_id, lang, round((row_number() over (partition by lang order by doc_id) - 0.5) / count(*) over (partition by lang), 9) as position from documents")
def fractional_interleave(spark, sf_dir):
    rows = select.fractional_interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return rows.select("doc_id", "lang", F.round(F.col("position").cast("double"), 9).alias("position"))


@query("""with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as round from documents)
 select *, row_number() over (order by round, source) - 1 as turn from r""")
def round_robin_strata(spark, sf_dir):
    rows = select.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return rows.select("doc_id", "source", F.col("round").cast("long").alias("round"), F.col("turn").cast("long").alias("turn"))


@query("""with e as (select item_id, epoch, sha256(concat('cycle:', epoch, ':', item_id)) as h from benchmark, range(3) r(epoch))
 select item_id, epoch, row_number() over (partition by epoch order by h) as place from e""")
def epoch_cycle(spark, sf_dir):
    rows = select.cycle(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 3, "cycle")
    place = F.row_number().over(Window.partitionBy("epoch").orderBy("hash"))
    return rows.select("item_id", F.col("epoch").cast("long").alias("epoch"), place.cast("long").alias("place"))


@query(f"""select source, lang, doc_id from (select source, lang, doc_id, row_number() over (partition by source, lang order by {HASH}) as rn from documents) where rn <= 2""")
def review_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return select.top_by_hash(rows, 2, "seed", "doc_id", "source", "lang").select("source", "lang", "doc_id")


@query("""with d as (select item_id, text, sum(strlen(text) + 1) over (order by item_id) - strlen(text) - 1 as start from benchmark),
 b as (select start + i as pos, case when i < strlen(text) then cast(concat('0x', substr(hex(encode(text)), 2 * i + 1, 2)) as int) else 256 end as token from d, lateral (select unnest(range(strlen(text) + 1)) as i)),
 w as (select cast(pos // 64 as bigint) as row_no, pos, token, lead(token) over (order by pos) as next from b), n as (select count(*) as n from b)
 select row_no, string_agg(token, ',' order by pos) as x, string_agg(next, ',' order by pos) as y from w, n where (row_no + 1) * 64 < n.n group by row_no""")
def packed_rows(spark, sf_dir):
    """Byte tokens of all items with an end mark, in windows of 65 that overlap by one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(byte_tokens(F.col("text")), F.array(F.lit(256))).alias("tokens"))
    return pack(items, "item_id", "tokens", 64).select("row_no", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query(f"""with d as (select split, lang, source, strlen(text) as bytes, len({WORDS}) as n_words from (select *, {SPLIT} as split from documents))
 select split, count(*) as n, cast(sum(n_words) as bigint) as n_words, max(n_words) as most, quantile_cont(n_words, 0.5) as median, count(distinct source) as sources,
 count(*) filter (where lang = 'en') as n_en, round(sum(bytes) / greatest(1, sum(n_words)), 6) as bytes_per_word from d group by split""")
def corpus_receipt(spark, sf_dir):
    docs = keyed(spark, sf_dir).select("split", "lang", "source", F.octet_length("text").alias("bytes"), F.size(T.word_list(T.norm(F.col("text")))).cast("long").alias("n_words"))
    return docs.groupBy("split").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("n_words"), F.max("n_words").alias("most"), F.percentile("n_words", F.lit(0.5)).alias("median"), F.count_distinct("source").alias("sources"),
        F.count_if(F.col("lang") == "en").alias("n_en"), F.round(F.sum("bytes") / F.greatest(F.lit(1), F.sum("n_words")), 6).alias("bytes_per_word"),
    )


@query(f"with k as (select lang, {KEY} as key from documents) select lang, digest as fingerprint, n from ({select.set_digest_sql('k', 'key', 'lang')})")
def table_fingerprint(spark, sf_dir):
    """An order-free identity of each language's rows."""
    return select.set_digest(keyed(spark, sf_dir).select("lang", "key"), "key", "lang").withColumnRenamed("digest", "fingerprint")


@query("select doc_id, row_number() over (order by sha256('shuffle:' || doc_id), doc_id) - 1 as place from documents")
def seeded_shuffle(spark, sf_dir):
    """Every document in the order of a seeded hash, placed without one task for all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", select.hash_rank("shuffle", F.col("doc_id")).alias("h"))
    return select.places(rows, ["h", "doc_id"]).select("doc_id", "place")


@query(f"""with d as (select doc_id, {WORDS} as w, length(regexp_replace(text, '\\P{{{{L}}}}', '', 'g')) as letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as plain, list_distinct(regexp_extract_all(text, '[0-9]+')) as numbers from documents)
 select doc_id, round(case when letters > 0 then plain / letters end, 6) as ascii_share, len(numbers) as numbers, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 as stutters from d""".replace("{{", "{").replace("}}", "}"))
def text_shares(spark, sf_dir):
    """ASCII letters among letters, different numbers, a word that follows itself."""
    words = T.word_list(T.norm(F.col("text")))
    stutters = T.let(words, lambda w: F.exists(F.transform(w, lambda x, i: x == F.get(w, i + 1)), lambda x: F.coalesce(x, F.lit(False))))
    return documents(spark, sf_dir).select("doc_id", F.round(T.ascii_letter_share(F.col("text")), 6).alias("ascii_share"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).cast("long").alias("numbers"), stutters.alias("stutters"))
