"""DuckDB SQL for the corpus queries that SQL can express, over the whole tables."""

from __future__ import annotations

from .licenses import TEMPLATES
from .quality import POLICIES, RULES

_ALNUM = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SPACE = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(words: str) -> str:
    return f"list_transform({words}, lambda x: {_LOWER.format('x')})"


def _postings() -> str:
    rows = []
    for t in TEMPLATES:
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows += [f"('{t.name}', '{t.label}', {str(t.base).lower()}, {len(words)}, {len(key)}, '{w}', {i}, {str(at <= i < at + len(key)).lower()})" for i, w in enumerate(words)]
    return ", ".join(rows)


OP1 = f"""
with docs as (select doc_id, {_lower(_ALNUM)} as words from documents),
  words as (select doc_id, unnest(words) as word, unnest(range(len(words))) as at_ from docs),
  postings(template, label, base, size, key_size, word, place, in_key) as (values {_postings()}),
  aligned as (select doc_id, template, label, base, size, key_size, at_ - place as start, count(*) as matched, count(*) filter (where in_key) as key_words from words join postings using (word) group by all),
  verified as (select * from aligned where key_words = key_size),
  per_doc as (select doc_id, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
    array_to_string(list_sort(list(distinct label) filter (where base)), ',') as base_labels, array_to_string(list_sort(list(distinct label)), ',') as labels, max(matched / size) as score from verified group by 1)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from docs left join per_doc using (doc_id)"""

OP3 = f"""
with recursive docs as (select doc_id, {_lower(_SPACE)} as words from documents),
  grams as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) end) as g from docs),
  sizes as (select doc_id, count(*) as n from grams group by 1),
  pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
  links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
  reach as (select doc_id, doc_id as other from docs union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select doc_id, cast(coalesce(min(n), 0) as bigint) as n_shingles, min(other) as component_id from reach left join sizes using (doc_id) group by 1"""

OP4 = r"""
with inner_ as (select page_id, url, replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<br>', ' ') as body from pages),
  blocks as (select page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) as b from inner_),
  texts as (select page_id, url, array_to_string(list_filter(list_transform(b, lambda x: regexp_replace(x, '&amp$', '&')), lambda x: x <> ''), chr(10) || chr(10)) as text from blocks)
select page_id, url, text, cast(length(text) as bigint) as n_chars from texts"""

OP8 = f"""
with docs as (select doc_id, {_lower(_ALNUM)} as words from documents),
  items as (select cast(item_id as varchar) as item_id, {_lower(_ALNUM)} as words from benchmark),
  windows as (select distinct item_id, least(len(words), 10) as size, unnest(list_transform(range(1, greatest(1, len(words) - 9) + 1), lambda i: array_to_string(list_slice(words, i, i + 9), ' '))) as w from items where len(words) > 0),
  sizes as (select distinct size from windows),
  places as (select doc_id, size, unnest(range(1, len(words) - size + 2)) as at_, words from docs, sizes where len(words) >= size),
  keyed as (select doc_id, size, at_, array_to_string(list_slice(words, at_, at_ + size - 1), ' ') as w from places),
  hits as (select doc_id, size, at_, item_id from keyed join windows using (size, w)),
  covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(at_, at_ + size)) as p from hits) group by 1),
  found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by 1)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (doc_id) left join found using (doc_id)"""

OP9 = rf"""
with docs as (select doc_id, coalesce(text, '') as text, {_SPACE} as words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
  windows as (select doc_id, unnest(range(1, len(words) - 3)) as at_, words from docs where len(words) >= 5),
  keyed as (select doc_id, at_, array_to_string(list_slice(words, at_, at_ + 4), ' ') as w from windows),
  repeated as (select doc_id, at_ from keyed qualify count(*) over (partition by doc_id, w) > 1),
  covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(at_, at_ + 5)) as p from repeated) group by 1),
  m as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, len(list_distinct(words)) as n_distinct from docs left join covered using (doc_id)),
  f as (select *, case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end + case when n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines then 4 else 0 end
    + case when 100 * n_symbols > 30 * n_words then 8 else 0 end + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 25 * n_words then 32 else 0 end
    + case when n_words >= 50 and 100 * n_distinct < 15 * sqrt(n_words * 50) then 64 else 0 end + case when n_words > 100000 then 128 else 0 end as failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  failed & 3 <> 0 as base_failed, failed & 63 = 0 as kept, cast(failed as bigint) as failed from f"""

ABLATION = f"""
with ledger as ({OP9}),
  policies(version, mask) as (values {", ".join(f"('{v}', {m})" for v, m in POLICIES.items())}),
  rules(rule, bit) as (values {", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(RULES))})
select version, rule, count(*) as n_docs, count(*) filter (where failed & mask = 0) as n_kept, count(*) filter (where failed & (mask - bit) = 0) as n_kept_without
from ledger, policies join rules on mask & bit <> 0 group by version, rule"""

OP11 = rf"""
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row_no,
    list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as words from documents),
  words as (select lang, source, row_no, {_LOWER.format('unnest(words)')} as term from docs),
  kept as (select lang, term, count(*) as lang_n from words group by all having count(distinct row_no) >= 10),
  langs as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by 1),
  groups as (select distinct lang, source from docs),
  counts as (select lang, source, term, count(*) as n from words group by all),
  dense as (select lang, source, term, coalesce(n, 0) as n, lang_n from groups join kept using (lang) left join counts using (lang, source, term)),
  sums as (select lang, source, sum(n) as total from dense group by all),
  shares as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v) as p, 1 + (1000000000::hugeint * (lang_n + 2)) // (lang_total + 2 * v) as q
    from dense join sums using (lang, source) join langs using (lang)),
  apart as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source),
  terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q),
  ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10"""

OP13 = f"""
with docs as (select doc_id, row_number() over () as row_no, {_lower(_ALNUM)} as words from documents),
  items as (select item_id, row_number() over () as item_no, {_lower(_ALNUM)} as words from benchmark),
  stats as (select count(*) as n, sum(len(words)) as l from docs where len(words) > 0),
  postings as (select row_no, doc_id, term, count(*) as tf, any_value(size) as size from (select row_no, doc_id, len(words) as size, unnest(words) as term from docs) group by row_no, doc_id, term),
  weights as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as w from postings, stats group by term, n),
  wanted as (select item_no, item_id, term, count(*) as times from (select item_no, item_id, unnest(words) as term from items) group by all),
  scores as (select item_no, item_id, row_no, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l)))) as bigint) as score
    from wanted join weights using (term) join postings using (term), stats group by item_no, item_id, row_no, doc_id),
  ranked as (select *, row_number() over (partition by item_no order by score desc, doc_id) as rank from scores where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10"""

ORACLES = {"op1_licenses": OP1, "op3_ngram_jaccard": OP3, "op4_html_text": OP4, "op8_decontamination": OP8, "op9_quality": OP9, "quality_ablation": ABLATION, "op11_divergence": OP11, "op13_ranked_search": OP13}
