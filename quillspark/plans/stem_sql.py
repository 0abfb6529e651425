"""English stems and their rank in DuckDB SQL, for the queries whose Spark side uses functions/stemming.py."""

from __future__ import annotations

from ..operators import keyword

_STOP = ", ".join(f"'{w}'" for w in keyword.STOP_WORDS)
_VALID = "regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
_DOUBLE = "regexp_matches({0}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')"


def _step(name: str, before: str, endings: str, result: str) -> str:
    """A CTE that replaces w by `result`, an expression of w, e (its longest ending of these) and b (what is before it)."""
    return f"""{name} as (select word, r1, r2, {result} as w from (select *, left(w, length(w) - length(e)) as b from (select *, regexp_extract(w, '({endings})$', 1) as e from {before})))"""


def stems(words: str) -> str:
    """CTEs up to stems(word, stem) of the words that this SELECT gives; stop words are left out."""
    steps = [
        f"said as (select distinct word from ({words}) where word not in ({_STOP}))",
        """special(word, stem) as (values ('skis', 'ski'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'), ('idly', 'idl'), ('gently', 'gentl'), ('ugly', 'ugli'), ('early', 'earli'), ('only', 'onli'), ('singly', 'singl'),
    ('sky', 'sky'), ('news', 'news'), ('howe', 'howe'), ('atlas', 'atlas'), ('cosmos', 'cosmos'), ('bias', 'bias'), ('andes', 'andes'))""",
        r"plain as (select word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') as w from said where length(word) > 2 and not regexp_matches(word, '[^a-z]') and word not in (select word from special))",
        "one as (select word, w, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])')), 0), length(w)) as r1 from plain)",
        "two as (select word, w, r1, r1 + coalesce(nullif(length(regexp_extract(substr(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0), length(w) - r1) as r2 from one)",
        _step("step_1a", "two", "sses|ied|ies|us|ss|s", "case when e = 'sses' then b || 'ss' when e in ('ied', 'ies') then b || case when length(b) > 1 then 'i' else 'ie' end when e = 's' and regexp_matches(b, '[aeiouy].') then b else w end"),
        "ended as (select word, w as stem from step_1a where w in ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed'))",
        "going as (select * from step_1a where word not in (select word from ended))",
        _step(
            "step_1b", "going", "eedly|ingly|edly|eed|ing|ed",
            f"""case when e in ('eed', 'eedly') then case when length(b) >= r1 then b || 'ee' else w end when e = '' or not regexp_matches(b, '[aeiouy]') then w
    when regexp_matches(b, '(at|bl|iz)$') then b || 'e' when {_DOUBLE.format('b')} then left(b, length(b) - 1) when length(b) <= r1 and {_VALID.format('b')} then b || 'e' else b end""",
        ),
        r"step_1c as (select word, r1, r2, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\1i') as w from step_1b)",
        _step(
            "step_2", "step_1c", "tional|enci|anci|abli|entli|izer|ization|ational|ation|ator|alism|aliti|alli|fulness|ousli|ousness|iveness|iviti|biliti|bli|ogi|fulli|lessli|li",
            """case when e = '' or length(b) < r1 then w when e = 'tional' then b || 'tion' when e in ('enci', 'anci', 'abli') then left(w, length(w) - 1) || 'e' when e in ('entli', 'ousli', 'fulli', 'lessli') then left(w, length(w) - 2)
    when e in ('izer', 'ization') then b || 'ize' when e in ('ational', 'ation', 'ator') then b || 'ate' when e in ('alism', 'aliti', 'alli') then b || 'al' when e in ('fulness', 'ousness', 'iveness') then left(w, length(w) - 4)
    when e = 'iviti' then b || 'ive' when e in ('biliti', 'bli') then b || 'ble' when e = 'ogi' and b like '%l' then b || 'og' when e = 'li' and regexp_matches(b, '[cdeghkmnrt]$') then b else w end""",
        ),
        _step("step_3", "step_2", "tional|ational|alize|icate|iciti|ical|ful|ness|ative", "case when e = '' or length(b) < r1 then w when e = 'tional' then b || 'tion' when e = 'ational' then b || 'ate' when e = 'alize' then b || 'al' when e in ('icate', 'iciti', 'ical') then b || 'ic' when e in ('ful', 'ness') or length(b) >= r2 then b else w end"),
        _step("step_4", "step_3", "ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic", "case when e = '' or length(b) < r2 or (e = 'ion' and not regexp_matches(b, '[st]$')) then w else b end"),
        _step("step_5", "step_4", "e|l", f"case when e = 'e' and (length(b) >= r2 or (length(b) >= r1 and not {_VALID.format('b')})) then b when e = 'l' and length(b) >= r2 and b like '%l' then b else w end"),
        """stems as (select word, lower(w) as stem from step_5 union all select * from ended union all select * from special where word in (select word from said)
    union all select word, word from said where length(word) <= 2 or regexp_matches(word, '[^a-z]'))""",
    ]
    return ",\n  ".join(steps)


#: by_keyword from postings(chunk_id, stem, times) and words(query_id, stem, size).
RANKED = f"""by_keyword as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from
    (select query_id, chunk_id, round(sum({keyword.WEIGHT} * list_sum(list_transform(range(1, times + 1), lambda j: 1.0::double / (j * j))) / {keyword.LIMIT}) / any_value(size), 9) as score from postings join words using (stem) group by 1, 2)) where rank <= {keyword.ARM})"""
