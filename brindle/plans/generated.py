"""Queries over records and requests that are made from documents: sources, checks, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import constraints as C
from brindle.functions import text as T
from brindle.plans.corpus import WORDS
from brindle.plans.registry import documents, query, table
from brindle.sources import synth


def pick_sql(options: list[str], seed: str, *parts: str) -> str:
    key = f"sha256(concat_ws(':', '{seed}', {', '.join(parts)}))"
    return f"[{', '.join(repr(x) for x in options)}][cast(cast(concat('0x', substr({key}, 1, 8)) as ubigint) % {len(options)} as int) + 1]"


#: Three entities of every document: its first words of four letters or more by the alphabet.
ENTITIES = """e0 as (select doc_id as i, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4)))[1:3] as three from documents where text is not null),
 e as (select * from e0 where len(three) = 3)"""


def entities(spark, sf_dir):
    return synth.entities(documents(spark, sf_dir), "doc_id", "text")


@query(f"""with {ENTITIES}, r as (select i as pair_id, {pick_sql(synth.PEOPLE['train'], 's', 'i', "'who'")} as who, three[1] as what, three from e)
 select pair_id, variant, answer, who || ' left the ' || what || ' at the ' || answer || '. Where is the ' || what || '?' as prompt from (select pair_id, who, what, cast(u as int) as variant, three[u + 2] as answer from r, (select unnest(range(2)) as u))""")
def generated_facts(spark, sf_dir):
    """A10: two records of each document that differ in one of its words."""
    return synth.paired_facts(entities(spark, sf_dir), "train", "s")


INSTRUCTIONS = f"""{ENTITIES}, w as (select i as id, [three[2], three[3], three[1]] as words, {pick_sql(['sort', 'reverse', 'upper', 'json'], 's', 'i', "'kind'")} as kind from e),
 a as (select id, kind, kind || ': ' || array_to_string(words, ' ') as prompt, case kind when 'sort' then array_to_string(list_sort(words), ' ') when 'reverse' then array_to_string(list_reverse(words), ' ')
 when 'upper' then upper(array_to_string(words, ' ')) else '{{"words":["' || array_to_string(words, '","') || '"]}}' end as answer from w)"""


@query(f"with {INSTRUCTIONS} select * from a")
def generated_instructions(spark, sf_dir):
    """Requests over three words of each document, with their answers."""
    return synth.instructions(entities(spark, sf_dir), "s")


@query(f"""with {INSTRUCTIONS}, x as (select *, {pick_sql(list(synth.ERRORS), 's', 'id', "'error'")} as error, regexp_extract(answer, '^(\\S+)', 1) as w from a where kind <> 'json')
 select id, kind, prompt, answer as chosen, case error when 'dropped' then regexp_replace(answer, ' \\S+$', '') when 'doubled' then answer || ' ' || regexp_extract(answer, '(\\S+)$', 1) when 'swapped' then regexp_replace(answer, '^(\\S+) (\\S+)', '\\2 \\1')
 when 'cased' then case when w = upper(w) then lower(w) else upper(w) end || substr(answer, length(w) + 1) else regexp_replace(answer, '^(\\S+) ', '\\1') end as rejected, error,
 cast(case error {' '.join(f"when '{k}' then {v}" for k, v in synth.ERRORS.items())} end as int) as difficulty from x""")
def generated_preferences(spark, sf_dir):
    """Those answers beside the same with one error."""
    return synth.preference_pairs(entities(spark, sf_dir), "s")


@query(f"""with {ENTITIES}, t as (select i as id, three[1] as thing, branch from e, (values ('shorter'), ('louder')) b(branch))
 select id, branch, 'user|Write about a ' || thing || '.#assistant|A ' || thing || ' stands by the door.#user|Make it ' || branch || '.#assistant|' || case branch when 'shorter' then 'A ' || thing || '.' else upper('A ' || thing || ' stands by the door.') end as messages from t""")
def generated_dialogues(spark, sf_dir):
    """Two-turn conversations on a word of each document, in two branches."""
    said = F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"]))
    return synth.dialogues(entities(spark, sf_dir)).select("id", "branch", F.array_join(said, "#").alias("messages"))


ASKED = {"sentences": "sentences", "words": "words", "paragraphs": "paragraphs"}
COUNTED = {
    "words": "len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))",
    "sentences": "len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> ''))",
    "paragraphs": r"len(list_filter(regexp_split_to_array(text, '\n\s*\n|\s?\*\*\*\s?'), lambda x: regexp_replace(x, '\s', '', 'g') <> ''))",
}


def passes_sql() -> str:
    return " ".join(f"when relation = '{name}' then n {sign} number" for name, sign in C.RELATIONS.items())


@query(f"""with r as (select doc_id as i, text from documents where text is not null), p as (select i as id, text, {pick_sql(list(C.RELATIONS), 'c', 'i', "'relation'")} as relation, {pick_sql(list(C.NUMBERS[1:9]), 'c', 'i', "'number'")} as said, {pick_sql(list(ASKED), 'c', 'i', "'unit'")} as family,
 {pick_sql(['plain', 'comma', 'lower'], 'c', 'i', "'also'")} as also from r), n as (select *, list_position({list(C.NUMBERS)}, said) - 1 as number from p), c as (select n.*, case family {' '.join(f"when '{k}' then {v}" for k, v in COUNTED.items())} end as n from n)
 select cast(id as bigint) as id, family, relation, cast(number as bigint) as number, also, case {passes_sql()} end as counted,
 case also when 'comma' then not contains(text, ',') when 'lower' then text = lower(text) and regexp_matches(text, '\\p{{L}}') end as also_passed from c where regexp_replace(text, '\\s', '', 'g') <> ''""")
def constraint_checks(spark, sf_dir):
    """A request for each document, read back, and the document checked against it."""
    pick = lambda options, part: synth.pick(options, "c", F.col("id"), F.lit(part))
    rows = documents(spark, sf_dir).filter(T.strip(F.col("text")) != "").select(F.col("doc_id").alias("id"), "text")
    asked = rows.select("id", "text", pick(list(C.RELATIONS), "relation").alias("r"), pick(list(C.NUMBERS[1:9]), "number").alias("n"), pick(list(ASKED), "unit").alias("u"), pick(["plain", "comma", "lower"], "also").alias("also"))
    tail = F.when(F.col("also") == "comma", " without commas").when(F.col("also") == "lower", ", all lowercase").otherwise("")
    request = F.concat(F.lit("Please write "), F.col("r"), F.lit(" "), F.col("n"), F.lit(" "), F.col("u"), tail, F.lit("."))
    rows = asked.select("id", "also", "text", C.parse(request).alias("c")).withColumn("ok", C.verify(F.col("text"), F.col("c")))
    last, first = F.size("c") - 1, F.when(F.size("c") > 1, F.get("ok", F.lit(0)))
    own = F.get("c", last)
    return rows.select("id", own["family"].alias("family"), own["relation"].alias("relation"), own["number"].cast("long").alias("number"), "also", F.get("ok", last).alias("counted"), first.alias("also_passed"))


@query(f"""with d as (select item_id, text, regexp_replace(text, '\\n', chr(10) || '- ', 'g') as listed, {WORDS} as w from benchmark)
 select item_id, len(w) as n_words, '"' || text || '"' as quoted, '- ' || text as bullet, lower(text) as quiet, json_extract_string(json_object('answer', text), '$.answer') as unpacked,
 trim(regexp_replace(regexp_replace(listed, '(?m)^\\s*[-*]\\s+', '', 'g'), '\\s+', ' ', 'g')) as corrupted,
 list_sort(w) = list_sort(list_filter(string_split(trim(regexp_replace(lower(listed), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) as kept from d""")
def answer_formats(spark, sf_dir):
    """Renderings of whole texts, the JSON one unpacked again, and a corruption that keeps the
    words but not the list."""
    rows = table(spark, sf_dir, "benchmark").withColumn("listed", F.regexp_replace("text", "\n", "\n- "))
    made = C.formats(F.col("text"))
    same = F.lit(True)
    for name in ("plain", "quote", "bullet"):
        same = same & (C.unpack(name, made[name]) == F.col("text"))
    return rows.select(
        "item_id", F.size(T.word_list(T.norm(F.col("text")))).cast("long").alias("n_words"), made["quote"].alias("quoted"), made["bullet"].alias("bullet"), made["lower"].alias("quiet"),
        F.when(same, C.unpack("json", made["json"])).alias("unpacked"), C.corrupt(F.col("listed")).alias("corrupted"), C.same_words(C.corrupt(F.col("listed")), F.col("text")).alias("kept"),
    )
