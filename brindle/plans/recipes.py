"""Queries over single examples and the chains that recipes build from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import fixed, grammar
from brindle.functions import text as T
from brindle.operators import packing, quality, screens, select
from brindle.plans import corpus
from brindle.plans.corpus import GATE, KEY, SPLIT, keyed
from brindle.plans.generated import ENTITIES, entities
from brindle.plans.registry import documents, query, table
from brindle.sources import synth

PAIRS = """a as (select conv_id, min_by(text, turn) filter (where role = 'user') as request, min_by(text, turn) filter (where role = 'assistant') as answer,
 count(*) filter (where role = 'assistant') as answers from conversations group by 1)"""
NORM_OF = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
WORDS_OF = f"list_filter(string_split({NORM_OF}, ' '), lambda x: x <> '')"


def first_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    role = lambda r: F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    return turns.groupBy("conv_id").agg(role("user").alias("request"), role("assistant").alias("answer"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query(f"""select conv_id, turn, case when regexp_matches(text, {fixed.quoted(fixed.OUT_OF_SCOPE)}) then 'topic' when contains(text, '|') then 'table' when regexp_matches(text, {fixed.quoted(fixed.SUMS)}) then 'arithmetic' else 'ok' end as reason from conversations""")
def scope_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", screens.scope_reason(F.col("text")).alias("reason"))


@query(f"""select doc_id, case when regexp_matches(text, {fixed.quoted(fixed.OUT_OF_SCOPE)}) then 'topic' when contains(text, '|') then 'table' when regexp_matches(text, {fixed.quoted(fixed.SUMS)}) then 'arithmetic' else 'ok' end as reason from documents""")
def document_scope(spark, sf_dir):
    """B6 over documents, which hold marks, tables and numbers."""
    return documents(spark, sf_dir).select("doc_id", screens.scope_reason(F.col("text")).alias("reason"))


KIND = f"""case when origin = 'self-oss-instruct' then null when origin in ('smollm-rewrite-30k', 'smol-summarize-20k') then 'writing' when passage then 'grounded' when regexp_matches(request, {fixed.quoted(fixed.REQUESTS)}) then 'completion' when answers >= 2 then 'conversation' end"""


@query(f"""with o as (select conv_id, case conv_id % 5 when 0 then 'self-oss-instruct' when 1 then 'smol-summarize-20k' else 'chat' end as origin from conversations group by 1),
 u as (select conv_id, turn, case when conv_id % 7 = 2 and turn < 2 then 'Answer based on the following text: ' || text when conv_id % 7 = 3 and turn < 2 then 'Please describe it. ' || text else text end as said from conversations where role = 'user'),
 p as (select conv_id, min_by(said, turn) as request, bool_or(len(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w <> '')) > 45 and regexp_matches(said, {fixed.quoted(fixed.EVIDENCE)})) as passage from u group by 1),
 a as (select conv_id, count(*) filter (where role = 'assistant') as answers from conversations group by 1), k as (select conv_id, origin, coalesce(request, '') as request, coalesce(passage, false) as passage, answers from a join o using (conv_id) left join p using (conv_id))
 select conv_id, origin, {KIND} as kind from k""")
def behaviour_classes(spark, sf_dir):
    """Kinds by source, by a passage to answer from, by verbs and by the number of answers."""
    turns = table(spark, sf_dir, "conversations")
    lead = (F.col("role") == "user") & (F.col("turn") < 2)
    given = F.when(lead & (F.col("conv_id") % 7 == 2), F.concat(F.lit("Answer based on the following text: "), "text")).when(lead & (F.col("conv_id") % 7 == 3), F.concat(F.lit("Please describe it. "), "text")).otherwise(F.col("text"))
    own = quality.conversations(turns.withColumn("text", given))
    said = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    origin = F.when(F.col("conv_id") % 5 == 0, "self-oss-instruct").when(F.col("conv_id") % 5 == 1, "smol-summarize-20k").otherwise("chat")
    return own.select("conv_id", origin.alias("origin"), screens.behaviour(said("user"), F.size(said("assistant")), origin).alias("kind"))


WORDS_N = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"


ENDS = [("ing", 3), ("ed", 2), ("es", 2), ("s", 1)]


def forms_sql(w: str) -> str:
    """The forms of a word, as a list."""
    parts = [f"[{w}]"]
    for end, n in ENDS:
        base = f"left({w}, length({w}) - {n})"
        parts.append(f"case when ends_with({w}, '{end}') and length({w}) > {n + 2} then [{base}, {base} || 'e'] else [] end")
        parts.append(f"case when ends_with({w}, '{end}') and length({base}) > 2 and {base}[-1:] = {base}[-2:-2] then [left({base}, -1)] else [] end")
    parts.append(f"case when ends_with({w}, 'ies') then [left({w}, -3) || 'y'] else [] end")
    return f"flatten([{', '.join(parts)}])"



FAMILIES = ("conversation", "rewrite", "summary", "everyday")
Q = fixed.quoted
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def family_sql(families) -> str:
    """A family for each conversation, by turns."""
    return f"{list(families)}[conv_id % {len(families)} + 1]"


def single_sql(families) -> str:
    """System message, request and answer of each conversation with its family."""
    ask, tell = "ms[spot + 1]", "ms[spot + 2]"
    return f"""t as (select conv_id, list({{'role': role, 'content': text}} order by turn) as ms from conversations group by 1), f as (select *, {family_sql(families)} as family, coalesce(cast(ms[1].role = 'system' as int), 0) as j from t),
 i as (select *, case when family = 'everyday' and len(ms) >= j + 4 and {WORDS_N.format('ms[j + 1].content')} < 4 then j + 2 else j end as spot from f),
 a as (select conv_id, family, case when j = 1 then {STRIP.format('ms[1].content')} else '' end as system, case when {ask}.role = 'user' and {tell}.role = 'assistant' then {STRIP.format(ask + '.content')} end as request,
 case when {ask}.role = 'user' and {tell}.role = 'assistant' then {STRIP.format(tell + '.content')} end as answer, case when system not in ('', {', '.join(Q(x) for x in fixed.PLAIN_SYSTEM)}) then system || chr(10) || chr(10) || request else request end as prompt,
 prompt || ' ' || answer as both_texts, {WORDS_OF.format('answer')} as w from i)"""


def without(text: str, pattern: str, ahead: str, allowed: str) -> str:
    """Whether a text has a pattern with a look ahead, said without one."""
    return f"regexp_matches(regexp_replace({text}, {Q(allowed)}, '\\1', 'g'), {Q(pattern.replace(ahead, ''))})"


STRAIGHT = "replace({0}, '’', chr(39))"
PERSONA = ("(?!free\\b|able\\b|welcome\\b)", r"(?i)\b(you)(?: are|'re| will be| should be) (?:free|able|welcome)\b")
UNSUPPORTED = f"""len(list_filter(target, lambda w: not list_has_any({forms_sql('w')}, known)))"""
NUMBERS_OF = "regexp_extract_all({0}, '{1}')"


@query(f"""with {single_sql(FAMILIES)}, g as (select conv_id, max(k) as most from (select conv_id, gram, count(*) as k from (select conv_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' '))) as gram from a) group by all) group by 1),
 s as (select *, list_distinct(list_filter(w, lambda x: not list_contains({list(screens.STOPWORDS)}, x))) as target, flatten(list_transform({WORDS_OF.format('request')}, lambda w: {forms_sql('w')})) as known,
 list_filter(list_transform(regexp_extract_all(answer, '\\b[A-Z][A-Za-z]+\\b'), lambda x: lower(x)), lambda x: not list_contains({WORDS_OF.format('request')}, x) and not list_contains({list(screens.STOPWORDS + fixed.KNOWN_NAMES)}, x)) as names,
 list_filter({list(fixed.COMMITMENTS)}, lambda x: list_contains(regexp_split_to_array(lower(answer), '\\s+'), x) and not list_contains(regexp_split_to_array(lower(request), '\\s+'), x)) as promised from a)
 select s.conv_id, case when request is null or answer is null then 'roles' when {WORDS_N.format('prompt')} not between 1 and 400 then 'prompt_length' when {WORDS_N.format('answer')} not between 8 and 256 then 'answer_length'
 when regexp_matches(both_texts, {Q(fixed.BLOCKED)}) or regexp_matches(prompt, {Q(fixed.QUANTITIES)}) then 'code_math_scope' when regexp_matches(both_texts, {Q(fixed.MORE_MATH)}) then 'math_scope_extended'
 when family = 'conversation' and len(regexp_extract_all(prompt, '\\b\\d+(?:\\.\\d+)?\\b')) > 3 then 'numeric_table_or_problem'
 when {without('prompt', fixed.ROLEPLAY, '(?!AI|assistant)', '(?i)\\b(you) are (?:a|an|the) (?:AI|assistant)')} or regexp_matches(answer, {Q(fixed.BAD_RESPONSE)}) or regexp_matches(answer, {Q(fixed.SETUP)}) then 'roleplay_or_setup'
 when {without(STRAIGHT.format('request'), fixed.PERSONA, *PERSONA)} or (family not in ('rewrite', 'summary') and {without(STRAIGHT.format('system'), fixed.PERSONA, *PERSONA)}) then 'persona'
 when regexp_matches(both_texts, {Q(fixed.MEDICAL)}) or regexp_matches(both_texts, {Q(fixed.LIVE)}) then 'specialist_or_live' when regexp_matches(both_texts, {Q(fixed.DRUGS)}) then 'specialist_drug'
 when family = 'everyday' and regexp_matches(both_texts, {Q(fixed.LOCAL_LIVE)}) then 'unverifiable_live_context' when family = 'conversation' and regexp_matches(request, {Q(fixed.REWRITING)}) then 'dedicated_rewrite_source'
 when family in ('rewrite', 'summary') and not list_has_all({NUMBERS_OF.format('request', '[0-9]+')}, {NUMBERS_OF.format('answer', '[0-9]+')}) then 'new_numbers'
 when family = 'summary' and {UNSUPPORTED} > greatest(1, cast(floor(len(target) * 0.06) as bigint)) then 'summary_unsupported_words' when family = 'summary' and len(names) > 0 then 'summary_new_name' when family = 'summary' and len(promised) > 0 then 'summary_overstated_commitment'
 when family = 'summary' and contains(system, {Q(fixed.NO_PRONOUNS)}) and regexp_matches(answer, {Q(fixed.PRONOUNS)}) then 'summary_instruction'
 when family = 'summary' and 1 + len(regexp_extract_all(answer, '[.!?]\\s+[A-Z]')) > case when contains(system, {Q(fixed.ONE_SENTENCE)}) then 1 else 3 end then 'summary_length_instruction'
 when regexp_matches(prompt || chr(10) || answer, {Q(fixed.ROLE_MARK)}) then 'embedded_roles' when not list_contains([{', '.join(Q(c) for c in fixed.LAST_MARKS)}], right(answer, 1)) and not (family = 'rewrite' and regexp_matches(answer, {Q(fixed.SIGNED)})) then 'incomplete_ending'
 when length(regexp_replace(prompt || answer, '[\\x00-\\x7f]', '', 'g')) / length(prompt || answer) > 0.08 then 'language' when len(w) >= 12 and coalesce(most, 0) >= 3 then 'repetition'
 when {NORM_OF.format('answer')} = {NORM_OF.format('prompt')} then 'echo' else 'ok' end as reason from s left join g using (conv_id)""")
def single_turn_reasons(spark, sf_dir):
    """The first fault of each conversation's first pair."""
    rows = single_turns(spark, sf_dir, FAMILIES)
    return rows.select("conv_id", screens.single_turn_reason(F.col("pair.request"), F.col("pair.answer"), F.col("family"), F.col("pair.system")).alias("reason"))


def single_turns(spark, sf_dir, families):
    """conv_id, family and the first pair of each conversation."""
    talks = quality.conversations(table(spark, sf_dir, "conversations"))
    rows = talks.withColumn("family", F.get(F.array(*map(F.lit, families)), (F.col("conv_id") % len(families)).cast("int")))
    return rows.select("conv_id", "family", screens.single_turn(F.col("messages"), F.col("family")).alias("pair"))


EDITORS = ("conversation", "rewrite", "followup", "explanation")


@query(f"""with {single_sql(EDITORS)}, x as (select distinct conv_id from (select conv_id, gram from (select conv_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) as gram from a) group by all having count(*) > 1))
 select a.conv_id, case when regexp_matches(request || ' ' || answer, {Q(fixed.MORE_SCOPE)}) then 'scope' when regexp_matches(request, {Q(fixed.MORE_PERSONA)}) then 'persona' when family <> 'rewrite' and regexp_matches(request || ' ' || answer, {Q(fixed.META_EDIT)}) then 'meta_edit'
 when regexp_extract(request, {Q(fixed.WORD_COUNT)}, 1) <> '' and cast({WORDS_N.format('answer')} as varchar) <> ltrim(regexp_extract(request, {Q(fixed.WORD_COUNT)}, 1), '0') then 'word_count' when x.conv_id is not null then 'repetition'
 when regexp_matches(answer, {Q(fixed.EDIT_FILLER)}) then 'edit_filler' when regexp_matches(answer, {Q(fixed.FALSE_SELF)}) then 'false_self' when family <> 'rewrite' and regexp_matches(request, {Q(fixed.EDIT_REQUEST)}) then 'edit_request'
 when family = 'followup' and {WORDS_N.format('request')} > 200 then 'long_followup' when family = 'rewrite' and not list_has_all({NUMBERS_OF.format('answer', chr(92) + 'b[0-9]+' + chr(92) + 'b')}, {NUMBERS_OF.format('request', chr(92) + 'b[0-9]+' + chr(92) + 'b')}) then 'numbers_lost'
 else 'ok' end as fault from a left join x using (conv_id) where request is not null""")
def answer_faults(spark, sf_dir):
    """The first fault of each conversation's first answer."""
    rows = single_turns(spark, sf_dir, EDITORS).filter("pair is not null")
    return rows.select("conv_id", screens.answer_fault(F.col("pair.request"), F.col("pair.answer"), F.col("family")).alias("fault"))


SENTENCE_LIST = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ([^a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"

#: The first three sentences of labelled documents: description, claim and explanation.
EXPLAINED = f"""x as (select doc_id, label, s[1] as premise, s[2] as claim, s[3] as reason from (select doc_id, quality as label, {SENTENCE_LIST} as s from documents join labels using (doc_id)) where len(s) >= 3),
 z as (select *, {WORDS_OF.format('premise')} as pw, {WORDS_OF.format('claim')} as cw, {WORDS_OF.format('reason')} as rw from x),
 r as (select *, case when len(pw) not between 6 and 40 then 'premise' when len(cw) not between 4 and 30 then 'claim' when len(rw) not between 10 and 40 then 'explanation' when label = 0 and regexp_matches(reason, {fixed.quoted(screens.HEDGED)}) then 'hedged'
 when len(list_distinct(list_transform(range(1, len(rw) - 1), lambda i: array_to_string(rw[i:i+2], ' ')))) < len(rw) - 2 then 'repetition' else 'ok' end as fault,
 {list(screens.WORDINGS)}[cast(cast(concat('0x', substr(sha256(cast(doc_id as varchar)), 1, 8)) as ubigint) % 4 as int) + 1] || chr(10) || 'Description: ' || premise || chr(10) || 'Claim: ' || claim as prompt,
 {list(screens.VERDICTS)}[label + 1] || ' ' || upper(left(reason, 1)) || substr(reason, 2) || case when regexp_matches(reason, '[.!?]$') then '' else '.' end as answer from z)"""


def explained_rows(spark, sf_dir):
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    parts = docs.select("doc_id", "label", screens.sentences(F.col("text")).alias("s")).filter("size(s) >= 3")
    rows = parts.select("doc_id", "label", *[F.get("s", F.lit(i)).alias(name) for i, name in enumerate(("premise", "claim", "reason"))])
    prompt, answer = screens.explained(F.col("doc_id"), F.col("premise"), F.col("claim"), F.col("reason"), F.col("label"))
    return rows.select("*", screens.explanation_reason(F.col("premise"), F.col("claim"), F.col("reason"), F.col("label")).alias("fault"), prompt.alias("prompt"), answer.alias("answer"))


@query(f"with {EXPLAINED} select doc_id, fault, prompt, answer from r")
def explanations(spark, sf_dir):
    """Descriptions, claims and explanations, whole sentences of labelled documents,
    screened, with their prompts and answers."""
    return explained_rows(spark, sf_dir).select("doc_id", "fault", "prompt", "answer")


@query(f"""with c as (select doc_id, {SENTENCE_LIST} as s, case when doc_id % 2 = 0 then ['A', 'B', 'C', 'D'] else ['1', '2', '3', '4'] end as labels from documents),
 k as (select *, case when doc_id % 9 = 5 then 'Z' else labels[doc_id % 4 + 1] end as key from c where len(s) >= 4) select doc_id, array_to_string(s[1:4], '|') as choices, cast(list_position(labels, key) - 1 as int) as gold,
 array_to_string(list_transform(s[2:3], lambda o: replace('_ That is all.', '_', o)), '|') as filled from k""")
def choice_formats(spark, sf_dir):
    """Whole sentences as lettered and numbered choices with a key, and in a blank."""
    labels = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, "ABCD"))).otherwise(F.array(*map(F.lit, "1234")))
    key = F.when(F.col("doc_id") % 9 == 5, "Z").otherwise(F.get(labels, (F.col("doc_id") % 4).cast("int")))
    rows = documents(spark, sf_dir).select("doc_id", screens.sentences(F.col("text")).alias("s")).filter("size(s) >= 4")
    return rows.select("doc_id", F.array_join(F.slice("s", 1, 4), "|").alias("choices"), screens.keyed_choice(labels, key).alias("gold"), F.array_join(screens.filled(F.lit("_ That is all."), F.slice("s", 2, 2)), "|").alias("filled"))


LOOP_SQL = ", ".join(f"max(most) filter (where n = {n}) >= {most} as {name}" for name, n, most in T.LOOPS)


@query(f"""with w as (select doc_id, {WORDS_OF.format('text')} as w from documents), g as (select doc_id, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i+n-1], ' '))) as gram from w, (values (3), (4), (5), (8)) s(n)),
 c as (select doc_id, n, gram, count(*) as k from g group by all), m as (select doc_id, n, max(k) as most, cast(sum(k - 1) as double) / sum(k) as again from c group by all),
 r as (select doc_id, {LOOP_SQL}, max(again) filter (where n = 4) > 0.2 as generated from m group by 1),
 l as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{{10,}}')) as run from documents where text is not null),
 b as (select doc_id, bool_or(len(list_filter(range(2, 13), lambda k: len(list_filter(range(1, length(run) - 5 * k + 2), lambda i: substr(run, i, 4 * k) = substr(run, i + k, 4 * k))) > 0)) > 0) as unit_loop from l group by 1)
 select w.doc_id, {', '.join(f'coalesce({name}, false) as {name}' for name, _, _ in T.LOOPS)}, coalesce(generated, false) as generated, len(w) >= 12 and coalesce(fourgram_loop, false) as short_4gram, coalesce(unit_loop, false) as unit_loop
 from w left join r using (doc_id) left join b using (doc_id)""")
def repetition_rules(spark, sf_dir):
    """Every rule of repetition; a unit of letters is looked for without a back reference
    by the oracle, unit by unit."""
    return documents(spark, sf_dir).select("doc_id", T.repetitions(F.col("text")).alias("rules")).select("doc_id", "rules.*")


@query("""select doc_id, array_to_string(regexp_extract_all(regexp_replace(lower(text), 'ß', 'ss', 'g'), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') as folded from documents""")
def casefolded_text(spark, sf_dir):
    """H5: case-folded words."""
    return table(spark, sf_dir, "documents").select("doc_id", T.casefolded(F.col("text")).alias("folded"))


@query("""with recursive e as (select doc_id as id, doc_id // 4 as grp, unnest([lang, 'size' || least(length(cast(n_chars as varchar)), 5)]) as family from documents),
 h as (select *, sha256('seed:' || family || ':' || id) as h from e), f as (select * from h qualify row_number() over (partition by family order by h) <= 60), p as (select family, row_number() over (order by family) - 1 as idx, list(id order by h) as ids, list(grp order by h) as grps from f group by family),
 n as (select count(*) as n from p), r(turn, ats, groups, family, id) as (select cast(-1 as bigint), list_transform(range(n), lambda x: cast(0 as bigint)), cast([] as bigint[]), cast(null as varchar), cast(null as bigint) from n union all
 select turn, list_transform(range(n), lambda i: case when i = idx then spot + k + 1 else ats[i + 1] end), list_append(own, grps[cast((spot + k) % len(ids) as bigint) + 1]), family, ids[cast((spot + k) % len(ids) as bigint) + 1] from
 (select *, list_position(list_transform(range(len(ids)), lambda j: not list_contains(own, grps[(spot + j) % len(ids) + 1])), true) - 1 as k from
 (select r.turn + 1 as turn, r.ats, case when (r.turn + 1) % 4 = 0 then [] else r.groups end as own, p.*, n.n, r.ats[p.idx + 1] as spot from r, n join p on true where p.idx = (r.turn + 1) % n.n and r.turn < 59))) select turn, family, id from r where turn >= 0""")
def family_exposure(spark, sf_dir):
    """Sources take turns; no batch of four has two rows of one language group."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr("doc_id div 4").alias("grp"), F.array(F.col("lang"), F.concat(F.lit("size"), F.least(F.length(F.col("n_chars").cast("string")), F.lit(5)).cast("string"))).alias("families"))
    return select.family_exposures(rows, 60, "seed")


@query(f"""with {PAIRS}, p as (select conv_id, list_distinct(list_filter({WORDS_OF.format('answer')}, lambda w: not list_contains({list(screens.STOPWORDS)}, w))) as target,
 flatten(list_transform({WORDS_OF.format('request')}, lambda w: {forms_sql('w')})) as known from a where request is not null and answer is not null),
 u as (select conv_id, len(target) as words, len(list_filter(target, lambda w: not list_has_any({forms_sql('w')}, known))) as unsupported from p)
 select conv_id, unsupported, words, unsupported <= greatest(1, cast(floor(words * 0.06) as bigint)) as grounded from u""")
def grounded_answers(spark, sf_dir):
    """Answer words that no form of a request's word supports."""
    pairs = first_pairs(spark, sf_dir).filter("request is not null and answer is not null")
    lost = screens.unsupported(F.col("answer"), F.col("request"))
    return pairs.select("conv_id", F.size(lost).cast("long").alias("unsupported"), F.size(screens.content_words(F.col("answer"))).cast("long").alias("words"), screens.grounded(F.col("answer"), F.col("request")).alias("grounded"))


#: The first two replies of each conversation, and the words of their matching blocks: runs of
#: equal words by diagonal, the longest of a stretch, then what lies before and after it.
REPLY_PAIRS = """a as (select conv_id, text, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'assistant'),
 p as (select x.conv_id, x.text as chosen, y.text as rejected from a x join a y on x.conv_id = y.conv_id and x.k = 1 and y.k = 2),
 ws as (select conv_id, regexp_extract_all(chosen, '\\S+') as a, regexp_extract_all(rejected, '\\S+') as b from p),
 m as (select conv_id, i, i - j as d from (select conv_id, unnest(a) as w, generate_subscripts(a, 1) as i from ws) join (select conv_id, unnest(b) as w, generate_subscripts(b, 1) as j from ws) using (conv_id, w)),
 g as (select *, i - row_number() over (partition by conv_id, d order by i) as island from m), runs as (select conv_id, d, min(i) as low, max(i) + 1 as high from g group by conv_id, d, island),
 r(conv_id, al, ah, bl, bh, size) as (select conv_id, cast(1 as bigint), len(a) + 1, cast(1 as bigint), len(b) + 1, cast(0 as bigint) from ws union all
 select conv_id, case side when 0 then al else best.s + best.n end, case side when 0 then best.s else ah end, case side when 0 then bl else best.s - best.d + best.n end, case side when 0 then best.s - best.d else bh end, case side when 0 then best.n else 0 end
 from (select conv_id, al, ah, bl, bh, arg_max({'s': lo, 'n': hi - lo, 'd': d}, (hi - lo, -lo, d - lo)) as best from (select r.conv_id, al, ah, bl, bh, d, greatest(low, al, bl + d) as lo, least(high, ah, bh + d) as hi from r join runs on r.conv_id = runs.conv_id)
 where hi > lo group by conv_id, al, ah, bl, bh), (values (0), (1)) t(side)), s as (select conv_id, cast(sum(size) as bigint) as size from r group by 1)"""


def reply_pairs(spark, sf_dir):
    """The first two replies of each conversation."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("k"))
    side = lambda k, name: turns.filter(F.col("k") == k).select("conv_id", F.col("text").alias(name))
    return side(1, "chosen").join(side(2, "rejected"), "conv_id")


@query(f"""with recursive {REPLY_PAIRS}, z as (select p.*, len(a) as na, len(b) as nb, 2.0 * size / (len(a) + len(b)) as similarity, length(regexp_replace(chosen, '[^\\p{{L}}]', '', 'g')) as letters, length(regexp_replace(chosen, '[^A-Za-z]', '', 'g')) as plain from p join ws using (conv_id) join s using (conv_id))
 select conv_id, case when chosen = rejected then 'same' when least(na, nb) < 6 then 'short' when greatest(na, nb) / least(na, nb) > 2.5 then 'length_ratio' when letters = 0 or plain / letters < 0.97 then 'script' when similarity > 0.2 then 'similar' else 'ok' end as reason,
 round(similarity, 6) as similarity from z""")
def preference_screen(spark, sf_dir):
    """Two replies of a conversation as a pair: the first fault, and how alike they are."""
    rows = reply_pairs(spark, sf_dir)
    reason = screens.preference_reason(F.col("chosen"), F.col("rejected"), min_words=6, max_similarity=0.2)
    return rows.select("conv_id", reason.alias("reason"), F.round(screens.sequence_ratio("chosen", "rejected"), 6).alias("similarity"))


@query()
def copy_similarity(spark, sf_dir):
    """Every document beside the first of its component of similar word sets, whole texts."""
    roots, docs = corpus.dup_components(spark, sf_dir).filter("root <> doc_id"), table(spark, sf_dir, "documents")
    pairs = roots.join(docs.select("doc_id", F.col("text").alias("own")), "doc_id").join(docs.select(F.col("doc_id").alias("root"), F.col("text").alias("first")), "root")
    return pairs.select("doc_id", "root", F.round(screens.sequence_ratio("own", "first"), 6).alias("similarity"))


@query(f"with {ENTITIES} select i as grp, cast(variant as int) as variant, three[2] as choice0, three[3] as choice1, cast(variant as int) as gold from e, (select unnest(range(2)) as variant)")
def multiple_choice(spark, sf_dir):
    """Facts as two-way choices; the two variants of a pair share a group."""
    facts = synth.paired_facts(entities(spark, sf_dir), "train", "s")
    choices = F.array_sort(F.collect_list(F.struct("variant", "answer")).over(Window.partitionBy("pair_id")))
    rows = facts.withColumn("choices", F.transform(choices, lambda c: c["answer"]))
    return rows.select(F.col("pair_id").alias("grp"), "variant", F.col("choices")[0].alias("choice0"), F.col("choices")[1].alias("choice1"), (F.array_position("choices", F.col("answer")) - 1).cast("int").alias("gold"))


@query("""with p as (select item_id // 2 as pair, item_id % 2 as variant, length(text) % 2 as predicted from benchmark)
 select a.pair, a.predicted = 0 and b.predicted = 1 as both_right, a.predicted = 1 and b.predicted = 0 as both_wrong, a.predicted <> b.predicted as switched from p a join p b on a.pair = b.pair and a.variant = 0 and b.variant = 1""")
def contrast_pairs(spark, sf_dir):
    """Predictions on both variants of a pair (items 2k and 2k + 1), side by side."""
    items = table(spark, sf_dir, "benchmark").select(F.expr("item_id div 2").alias("pair"), (F.col("item_id") % 2).alias("variant"), (F.length("text") % 2).alias("predicted"))
    side = items.groupBy("pair").pivot("variant", [0, 1]).agg(F.first("predicted")).toDF("pair", "a", "b").filter("a is not null and b is not null")
    return side.select("pair", ((F.col("a") == 0) & (F.col("b") == 1)).alias("both_right"), ((F.col("a") == 1) & (F.col("b") == 0)).alias("both_wrong"), (F.col("a") != F.col("b")).alias("switched"))


#: The last sentence of each document as the answer, with its place in the text.
SPANS = f"""p as (select doc_id, source, lang, text, {SENTENCE_LIST} as s from documents), a as (select *, case when len(s) > 1 then s[-1] end as answer, strpos(text, s[-1]) - 1 as start from p),
 c as (select *, answer is null as unanswerable, answer is null or (start >= 0 and substr(text, start + 1, length(answer)) = answer) as holds,
 {WORDS_N.format('text')} between 35 and 200 and (answer is null or {WORDS_N.format('answer')} between 1 and 12) as fits from a)"""


def span_rows(spark, sf_dir):
    """Documents with the span that answers them (none if they have one sentence), whether it
    stands where it says, and whether passage and answer have the sizes wanted."""
    said = F.element_at("s", -1)
    rows = documents(spark, sf_dir).withColumn("s", screens.sentences(F.col("text"))).withColumn("answer", F.when(F.size("s") > 1, said))
    rows = rows.withColumn("spans", F.when(F.col("answer").isNull(), F.array().cast("array<struct<text:string,start:int>>")).otherwise(F.array(F.struct(F.col("answer").alias("text"), (F.expr("instr(text, answer)") - 1).alias("start")))))
    holds = screens.spans_hold(F.col("text"), F.col("spans")) & F.forall("spans", lambda x: x["start"] >= 0)
    fits = F.size(screens.spaced(F.col("text"))).between(35, 200) & (F.col("answer").isNull() | F.size(screens.spaced(F.col("answer"))).between(1, 12))
    return rows.select("doc_id", "source", "lang", "answer", (F.size("spans") == 0).alias("unanswerable"), holds.alias("holds"), fits.alias("fits"))


@query(f"with {SPANS} select doc_id, coalesce(answer, '') as answer, unanswerable, holds, fits from c where text is not null")
def span_answers(spark, sf_dir):
    """Whole sentences as answers from whole texts."""
    rows = span_rows(spark, sf_dir)
    return rows.select("doc_id", F.coalesce("answer", F.lit("")).alias("answer"), "unanswerable", "holds", "fits")


@query(f"""with d as (select item_id, {SENTENCE_LIST} as s, 2 + item_id % 3 as k from benchmark) select item_id, cast(k as bigint) as k, case item_id % 3 when 0 then array_to_string(list_transform(s[1:k], lambda x: '- ' || x), chr(10))
 when 1 then array_to_string(s[1:k], chr(10) || chr(10)) else array_to_string(list_transform(range(1, k + 1), lambda i: i || '. ' || s[i]), chr(10)) end as answer from d where len(s) >= k""")
def complete_transforms(spark, sf_dir):
    """The first 2 to 4 sentences of each item as bullets, paragraphs or a numbered list."""
    items = table(spark, sf_dir, "benchmark").withColumn("parts", screens.sentences(F.col("text")))
    rows = items.withColumn("k", (2 + F.col("item_id") % 3).cast("int")).filter("size(parts) >= k").withColumn("chosen", F.slice("parts", F.lit(1), F.col("k")))
    form = F.col("item_id") % 3
    shown = F.when(form == 0, screens.render(F.col("chosen"), "bullets")).when(form == 1, screens.render(F.col("chosen"), "paragraphs")).otherwise(screens.render(F.col("chosen"), "numbered"))
    return rows.select("item_id", F.col("k").cast("long").alias("k"), shown.alias("answer"))


#: Conversations that a review rejected, and messages that it repaired.
REVIEW_REJECTED = (2, 3, 5, 8, 13, 21, 34, 55, 89)
REPAIRS = ((0, 1, "repaired."), (7, 1, "said better."), (14, 0, "asked again?"), (3, 1, "never seen."), (100_000, 1, "no such message."))


def listed(spark, ids):
    """A hand-made list as a table, small by nature."""
    return F.broadcast(spark.createDataFrame([(i,) for i in ids], "conv_id long"))


@query(f"""with {PAIRS}, t as (select conv_id, request, answer as text from a), d as (select conv_id, request, {SENTENCE_LIST} as s, 2 + conv_id % 3 as k from t) select conv_id, request, cast(k as bigint) as k,
 case conv_id % 2 when 0 then array_to_string(list_transform(s[1:k], lambda x: '- ' || x), chr(10)) else array_to_string(list_transform(range(1, k + 1), lambda i: i || '. ' || s[i]), chr(10)) end as answer from d where len(s) >= k""")
def first_replies(spark, sf_dir):
    """The first request and reply of each conversation, the reply's first sentences listed."""
    rows = first_pairs(spark, sf_dir).withColumn("s", screens.sentences(F.col("answer"))).withColumn("k", (2 + F.col("conv_id") % 3).cast("int")).filter("size(s) >= k")
    chosen = F.slice("s", F.lit(1), F.col("k"))
    shown = F.when(F.col("conv_id") % 2 == 0, screens.render(chosen, "bullets")).otherwise(screens.render(chosen, "numbered"))
    return rows.select("conv_id", "request", F.col("k").cast("long").alias("k"), shown.alias("answer"))


@query(f"""with p(conv_id, turn, patched) as (values {', '.join(map(str, REPAIRS))}) select conv_id, turn, coalesce(patched, text) as text from conversations left join p using (conv_id, turn) where conv_id not in {REVIEW_REJECTED}""")
def reviewed_patches(spark, sf_dir):
    """Conversations without the rejected ones, some messages replaced by a patch table."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    changes = spark.createDataFrame(list(REPAIRS), "conv_id long, turn long, text string")
    return screens.patch(turns.join(listed(spark, REVIEW_REJECTED), "conv_id", "left_anti"), changes, ["conv_id", "turn"], "text").select("conv_id", "turn", "text")


@query("""select d.doc_id, source, coalesce(cast(quality as varchar), 'unrated') as rating from documents d left join labels l on d.doc_id = l.doc_id""")
def rated_documents(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("quality").cast("string"), F.lit("unrated")).alias("rating"))


@query("""with a as (select doc_id, row_number() over (order by doc_id) - 1 as place from documents where lang = 'de'), b as (select doc_id as other_id, row_number() over (order by doc_id) - 1 as place from documents where lang = 'fr')
 select cast(place as bigint) as place, doc_id, other_id from a join b using (place)""")
def positional_zip(spark, sf_dir):
    """Two pools side by side; rows are numbered by ranges, not in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pool = lambda lang: packing.offsets(docs.filter(F.col("lang") == lang).select("doc_id", F.lit(1).cast("long").alias("one")), "doc_id", "one").select("doc_id", F.col("start").alias("place"))
    return pool("de").join(pool("fr").withColumnRenamed("doc_id", "other_id"), "place").select("place", "doc_id", "other_id")


@query("""with h as (select doc_id, source, lang, sha256(concat('cap:', cast(doc_id as varchar))) as h from documents), a as (select *, row_number() over (partition by source, lang order by h) as r from h),
 b as (select *, row_number() over (partition by source order by h) as r2 from a where r <= 2) select doc_id, source, lang from b where r2 <= 5""")
def capped_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", select.hash_rank("cap", F.col("doc_id")).alias("h"))
    return screens.capped(rows, ["h"], [(["source", "lang"], 2), (["source"], 5)]).select("doc_id", "source", "lang")


@query(f"""with recursive d as (select doc_id, lang, list_distinct(list_transform({WORDS_OF.format('text')}, lambda x: length(x))) as families from documents),
 r(lang, turn, picked, seen) as (select lang, cast(-1 as bigint), cast([] as bigint[]), cast([] as bigint[]) from (select distinct lang from d) union all
 select lang, turn, list_append(picked, best.doc_id), list_concat(seen, best.families) from (select r.lang, turn + 1 as turn, any_value(picked) as picked, any_value(seen) as seen,
 arg_min({{'doc_id': d.doc_id, 'families': families}}, (coalesce(list_sum(list_transform(families, lambda f: len(list_filter(seen, lambda s: s = f)))), 0) / greatest(1, len(families)), d.doc_id)) as best
 from r join d on d.lang = r.lang and not list_contains(picked, d.doc_id) where turn < 9 group by r.lang, turn)) select lang, turn, picked[-1] as doc_id from r where turn >= 0""")
def rare_family_coverage(spark, sf_dir):
    """Per language, items chosen so that rare word lengths come early."""
    words = T.word_list(T.norm(F.col("text")))
    families = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.length(w).cast("string"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce(families, F.array().cast("array<string>")).alias("families"))
    return screens.rare_first(rows, "lang", "doc_id", "families", 10)


@query("""with t as (select event_id, case event_id % 4 when 0 then props when 1 then '```json' || chr(10) || props || chr(10) || '```' when 2 then left(props, -1) else '{"a": 1, "a": ' || event_id || '}' end as body from events)
 select event_id, event_id % 4 < 2 as valid, case when event_id % 4 < 2 then len(json_keys(trim(replace(replace(body, '```json', ''), '```', '')))) end as keys from t""")
def json_objects(spark, sf_dir):
    """Objects as they are, fenced, cut short, and with a repeated key."""
    kind = F.col("event_id") % 4
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    body = F.when(kind == 0, F.col("props")).when(kind == 1, fenced).when(kind == 2, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.concat(F.lit('{"a": 1, "a": '), F.col("event_id").cast("string"), F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    found = rows.select("event_id", screens.json_object(F.col("body")).alias("fields"))
    return found.select("event_id", F.col("fields").isNotNull().alias("valid"), F.when(F.col("fields").isNotNull(), F.size(F.map_keys("fields")).cast("long")).alias("keys"))


@query(f"""with d as (select doc_id, source, {KEY} as key, {SPLIT} as split, {GATE} as reason, strlen(text) + 1 as size from documents),
 k as (select *, row_number() over (partition by key order by doc_id) as rn from d where reason = 'ok'), s as (select *, sum(size) over (partition by split, source order by doc_id) - size as start from k where rn = 1)
 select split, source, doc_id, cast(start as bigint) as start, size as n_tokens from s where start < 30000""")
def build_token_pools(spark, sf_dir):
    """Gate, identity, split, first of its copies, then whole documents up to a budget."""
    docs = keyed(spark, sf_dir).filter(quality.gate(F.col("text")) == quality.ACCEPTED)
    rows = docs.select("doc_id", "source", "key", "split", (F.octet_length("text") + 1).cast("long").alias("n_tokens"))
    first = select.first_by_key(rows, "key", F.col("doc_id"))
    return select.budget_cut(first, "n_tokens", 30_000, ["doc_id"], "split", "source").select("split", "source", "doc_id", F.col("before").alias("start"), "n_tokens")


@query()
def finite_sentences(spark, sf_dir):
    """Sentences of every document, how many have a finite verb, and different stems."""
    rows = documents(spark, sf_dir).select("doc_id", screens.sentences(F.coalesce("text", F.lit(""))).alias("s"), F.array_distinct(F.transform(T.word_list(T.norm(F.coalesce("text", F.lit("")))), grammar.stem)).alias("stems"))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), grammar.finite_count("s").cast("long").alias("finite"), F.size("stems").cast("long").alias("stems"))
