"""DuckDB SQL for the queries of this package that SQL can express.

Fitted models and merges have none: those queries are tested against brute force in
``tests/llm``.
"""

from brindle.llm import clustering, licenses, pii, ranking, urls

WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+')"""

#: Jumps of every id for 8 and 9 shards, on unsigned 64-bit numbers; checksums byte by byte.
SHARDING = """with recursive t as (select list_transform(range(256), lambda n: list_reduce([cast(n as ubigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(cast(3988292384 as ubigint), c // 2) else c // 2 end)) as crc),
 d as (select doc_id, row_number() over () as row, coalesce(text, '') as text, cast(coalesce(doc_id, -1) as hugeint) as k from documents),
 j(row, n, key, here, ahead) as (select row, n, cast(case when k < 0 then k + 18446744073709551616 else k end as uhugeint), -1::bigint, 0::bigint from d, (values (8), (9)) s(n)
 union all select row, n, next, ahead, cast(floor((ahead + 1) * (2147483648.0::double / cast(next // 8589934592 + 1 as double))) as bigint) from (select *, (key * 2862933555777941757 + 1) % 18446744073709551616 as next from j where ahead < n)),
 h as (select row, max(here) filter (where n = 8) as shard, max(here) filter (where n = 9) as grown from j where ahead >= n group by row),
 c as (select row, xor(cast(4294967295 as ubigint), list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as ubigint))), lambda a, b: xor(crc[cast(xor(a, b) % 256 + 1 as bigint)], a // 256))) as sum from d, t)
 select doc_id, cast(strlen(text) + 1 as bigint) as size, cast(sum as bigint) as text_crc32, 'key' as law, cast(shard as int) as shard, row_number() over (partition by shard order by doc_id nulls first) - 1 as slot, cast(grown as int) as grown_shard from d join h using (row) join c using (row)"""

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": "[0-9-]+", "iban": "[A-Z]{2}[0-9]{2}",
}
LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then cast(digits[length(digits) - i + 1] as int) else (cast(digits[length(digits) - i + 1] as int) * 2) // 10 + (cast(digits[length(digits) - i + 1] as int) * 2) % 10 end)) % 10 = 0"
CONFIRMED = f"""case kind when 'email' then true when 'ip' then len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || right(ltrim(x, '0'), 3) as int) > 255)) = 0
 when 'card' then length(digits) between 16 and 19 and {LUHN} when 'phone' then length(digits) between 8 and 15 when 'ssn' then regexp_full_match(match, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') else false end"""
#: An account number's prefixes by groups, with the remainder of each modulo 97.
REMAINDER = """list_reduce(list_prepend(0, list_transform(regexp_extract_all(plain[5:] || plain[:4], '.'), lambda c: case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)), lambda r, v: case when v > 9 then (r * 100 + v) % 97 else (r * 10 + v) % 97 end)"""
NAMES = [k.name for k in pii.KINDS]


def _spans() -> str:
    """Every proposal of every kind: kind, order, match, start."""
    one = "select doc_id, row, text, '{0}' as kind, {1} as place, unnest(regexp_extract_all(text, '{2}')) as match, unnest(regexp_split_to_array(text, '{2}')[:len(regexp_extract_all(text, '{2}'))]) as gap, generate_subscripts(regexp_extract_all(text, '{2}'), 1) as i from d"
    return " union all ".join(one.format(kind, NAMES.index(kind), pattern) for kind, pattern in BASE_PATTERNS.items())


PII = f"""with d as (select doc_id, row_number() over () as row, coalesce(text, '') as text from documents), p as ({_spans()}),
 q as (select *, cast(sum(length(gap) + length(match)) over (partition by row, kind order by i) as bigint) as stop, regexp_replace(match, '[^0-9]', '', 'g') as digits from p),
 b as (select doc_id, row, text, kind, place, stop - length(match) as start, stop from q where kind <> 'iban' and {CONFIRMED}),
 a as (select doc_id, row, text, place, stop - length(match) as start, regexp_extract(substr(text, stop - length(match) + 1, 80), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}[A-Za-z0-9]?') as proposal from q where kind = 'iban'
 and (stop = length(match) or not regexp_matches(substr(text, stop - length(match), 1), '[A-Za-z0-9]'))),
 g as (select *, unnest(list_transform(range(1, len(string_split(proposal, ' ')) + 1), lambda k: array_to_string(string_split(proposal, ' ')[1:k], ' '))) as own from a where proposal <> ''),
 n as (select *, replace(own, ' ', '') as plain from g), m as (select * from n where regexp_full_match(plain, '[A-Z0-9]{{15,34}}') and {REMAINDER} = 1),
 f as (select doc_id, row, text, place, start, arg_max(length(own), (case when contains('{pii.LENGTHS}', plain[:2] || length(plain)) then 1000 else 0 end) + length(own)) as size from m group by all),
 l as (select *, coalesce(max(start + size) over (partition by row order by start rows between unbounded preceding and 1 preceding), 0) as before from f),
 s as (select * from b union all select doc_id, row, text, 'iban', place, start, start + size from l where start >= before),
 r as (select *, lower(substr(text, greatest(start - {pii.NEAR}, 0) + 1, start - greatest(start - {pii.NEAR}, 0)) || ' ' || substr(text, stop + 1, {pii.NEAR})) as around from s),
 w as (select *, round(least(case kind {' '.join(f"when '{k.name}' then {k.score}" for k in pii.KINDS)} end + case when case kind {' '.join(f"when '{k.name}' then regexp_matches(around, '(?:^|[^a-z0-9])(?:{k.context})')" for k in pii.KINDS)} end then {pii.RAISE} else 0 end, 1.0), 2) as score from r),
 k as (select * from w where kind not in ('iban', 'ssn') or score >= {pii.THRESHOLD}), z as (select row, {', '.join(f"count(*) filter (where kind = '{x}') as n_{x}" for x in NAMES[:4])},
 coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by place, start) filter (where place < 4), '') as base, string_agg(kind || ':' || start || ':' || stop, ',' order by place, start) as spans,
 string_agg(cast(cast(score as double) as varchar), ',' order by place, start) as scores from k group by row)
 select doc_id, {', '.join(f"coalesce(n_{x}, 0) as n_{x}" for x in NAMES[:4])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from d left join z using (row)"""

_FITS = [(verdict, host + path, f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')") for verdict, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
#: Every rule that the labelled URLs hold, by trying all combinations of their telling tokens.
URL_RULES = f"""with u as (select page_id, row_number() over () as row, coalesce(url, '') as url from pages), v as (select *, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from u),
 w as (select page_id, row, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from v),
 x as (select page_id, row, host, path, case {' '.join(f"when {fits} then '{name}'" for _, name, fits in _FITS)} end as rule, case {' '.join(f"when {fits} then '{verdict}'" for verdict, _, fits in _FITS)} end as label,
 case when contains(url, '://') then list_distinct(flatten([list_transform(list_filter([regexp_extract(url, '^([^:/?#]*)://', 1)], lambda t: t <> ''), lambda t: 's:' || lower(t)), list_transform(list_filter(string_split(host, '.'), lambda t: t <> ''), lambda t: 'h:' || t),
 list_transform(list_filter(string_split(path, '/'), lambda t: t <> ''), lambda t: 'p:' || regexp_replace(t, '[0-9]+', '#', 'g')), list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda t: t <> ''), lambda t: 'q:' || regexp_extract(t, '^([^=]*)', 1))])) else [] end as every, list_filter(every, lambda t: not list_contains({urls.named()}, t)) as tokens from w),
 l as (select * from x where label is not null), n as (select count(*) as n, count(*) filter (where label = 'block') as b from l), e as (select row, label, unnest(tokens) as token from l),
 k as (select token, count(*) as uses, count(*) filter (where label = 'block') as blocked from e group by 1 having count(*) >= (select greatest({urls.MIN_COUNT}, {urls.MIN_SUPPORT} * n) from n)), z as (select token, round(abs(blocked - uses * (b / n)) / sqrt(uses * (b / n) * (1 - b / n) + 1), 6) as apart from k, n),
 i as (select row, label, list_sort(list(token)) as items from (select e.*, row_number() over (partition by row order by apart desc, e.token) as place from e join z using (token)) where place <= {urls.ITEMS} group by all),
 m as (select row, label, list_filter(items, lambda t, j: (mask // cast(2 ** (j - 1) as bigint)) % 2 = 1) as tokens from (select *, unnest(range(1, cast(2 ** len(items) as bigint))) as mask from i)),
 g as (select tokens, count(*) as uses from m group by 1), f as (select tokens, label, count(*) as hits from m group by all), t as (select label, count(*) as own from l group by 1),
 s as (select f.*, g.uses, round((hits + 1) / (uses + 2), 9) as confidence from f join g using (tokens) join t using (label), n where hits >= greatest({urls.MIN_COUNT}, {urls.MIN_SUPPORT} * n) and round((hits + 1) / (uses + 2), 9) >= {urls.MIN_CONFIDENCE} and hits / uses > own / n),
 c as (select s.tokens, s.label, any_value(s.hits) as hits, any_value(s.uses) as uses, any_value(confidence) as confidence, count(*) as seen from s join x on list_has_all(x.tokens, s.tokens) group by all),
 o as (select * from c where uses >= {urls.MIN_KNOWN} * seen), v2 as (select * from o where not exists (select 1 from o r where r.label = o.label and len(r.tokens) < len(o.tokens) and list_has_all(o.tokens, r.tokens) and r.confidence >= o.confidence)),
 y as (select row, arg_max(v2.label, (confidence, len(v2.tokens), hits, v2.label)) as mined from x join v2 on x.label is null and list_has_all(x.tokens, v2.tokens) group by row)
 select page_id, host, path, rule, coalesce(x.label, mined, '{urls.DEFAULT}') as verdict, mined is not null as mined from x left join y using (row)"""


def _kmeans() -> str:
    """Every round written out: all vectors against all centroids."""
    k, rounds, dims = clustering.K, clustering.ROUNDS, clustering.DIMS
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = f"""select row, vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (select x.row, x.vec_id, x.v, c.c, cast({square} as bigint) as d from x, {{of}} c) group by all"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({nearest.format(of=f'c{i}')})")
        sums = f"select c, list(cast(floor(s / n) as bigint) order by j) as v from (select c, j, sum(e)::hugeint as s, count(*) as n from (select c, unnest(v) as e, generate_subscripts(v, 1) as j from a{i}) group by 1, 2) group by 1"
        steps.append(f"m{i} as ({sums.replace('floor(s / n)', '(s - ((s % n) + n) % n) // n')}), c{i + 1} as materialized (select c, coalesce(m.v, o.v) as v from c{i} o left join m{i} m using (c))")
    return f"""with x as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda e: cast(floor(256 * e::double) as bigint)) as v from embeddings
 where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
 c0 as materialized (select row_number() over (order by sha256('{clustering.SEED}:' || vec_id), vec_id, v) - 1 as c, v from x qualify c < {k}), {', '.join(steps)},
 a as materialized ({nearest.format(of=f'c{rounds}')})
 select vec_id, cast(c as int) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(o.v, ',')) as centroid_sha256
 from a join c{rounds} o using (c)"""


def _license_scan() -> str:
    """All words against all places of all templates."""
    rows = [(i, j, w, j in t.keys) for i, t in enumerate(licenses.templates()) for j, w in enumerate(t.words)]
    known = ", ".join(f"({i}, {j}, '{w}', {key})" for i, j, w, key in rows)
    named = ", ".join(f"({i}, '{t.label}', {t.base})" for i, t in enumerate(licenses.templates()))
    return f"""with d as (select doc_id, row_number() over () as row, {WORDS} as w from documents), t(i, j, word, key) as (values {known}), l(i, label, base) as (values {named}),
 p as (select row, unnest(w) as word, generate_subscripts(w, 1) - 1 as place from d), f as (select * from p where word in (select word from t)),
 df as (select word, count(distinct row) as df from f group by 1), n as (select count(*) as n from documents),
 k as (select t.*, cast(1 + floor(1000 * ln((2 * n + 2) / (2 * coalesce(df, 0) + 1))) as bigint) as weight from t left join df using (word), n),
 o as (select i, sum(weight) as total, count(*) filter (where key) as n_keys from k group by 1),
 a as (select row, i, place - j as start, sum(weight) as weight, count(*) filter (where key) as n_keys from f join k using (word) group by all),
 m as (select row, l.label, l.base, start, cast(a.weight as double) / cast(total as double) as share from a join o using (i) join l using (i) where a.n_keys = o.n_keys and a.weight >= {licenses.SHARE} * total),
 z as (select row, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
 string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from m group by 1)
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score from d left join z using (row)"""


RANKING = f"""with d as (select doc_id, row_number() over () as row, {WORDS} as w from documents), i as (select item_id, row_number() over () as item, {WORDS} as w from benchmark),
 s as (select count(*) filter (where len(w) > 0) as n, cast(sum(len(w)) as bigint) as l from d), q as (select item, unnest(w) as term from i), tf as (select row, term, count(*) as tf from (select row, unnest(w) as term from d) group by all),
 v as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, s group by term, n),
 m as (select row, doc_id, 100 - {ranking.B} + ({ranking.B} * len(w) * n) // l as m from d, s), p as (select row, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) as impact from tf join v using (term) join m using (row)),
 r as (select item, row, cast(sum(impact) as bigint) as score from q join p using (term) group by all having sum(impact) > 0),
 o as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from r join m using (row))
 select item_id, cast(rank as int) as rank, doc_id, score from o join i using (item) where rank <= {ranking.K}"""

ORACLES = {
    "op11_ball_kmeans": _kmeans(),
    "op12_license_scan": _license_scan(),
    "op13_wand": RANKING,
    "op1_near_dedup": f"""with recursive w as (select doc_id, {WORDS} as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from w),
 n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where common >= 0.8 * (x.n + y.n - common) - 1e-9), both_ways as (select a, b from e union select b, a from e),
 r(node, root) as (select doc_id, doc_id from documents union select both_ways.b, r.root from r join both_ways on r.node = both_ways.a)
 select w.doc_id, min(root) as class_id, cast(len(any_value(w.w)) as bigint) as n_words from w join r on r.node = w.doc_id group by w.doc_id""",
    "op3_exact_dedup": """with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
 select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from t""",
    "op10_decontaminate": f"""with d as (select doc_id, {WORDS} as w from documents), i as (select item_id, {WORDS} as w from benchmark), s as (select item_id, w, least(10, len(w)) as n from i where len(w) > 0),
 g as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) as gram from s), sizes as (select distinct n from g),
 x as (select doc_id, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as k, w from d, sizes), y as (select doc_id, n, k, array_to_string(w[k:k+n-1], ' ') as gram from x),
 m as (select doc_id, k, y.n, item_id from y join g on y.gram = g.gram and y.n = g.n), h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from m) group by 1),
 f as (select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as id from m) group by 1)
 select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join f using (doc_id)""",
    "op2_pii": PII,
    "op5_url_rules": URL_RULES,
    "op9_sharding": SHARDING,
}
