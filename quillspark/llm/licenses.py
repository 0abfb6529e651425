"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are short word sequences with a label and a mandatory key phrase.

1. Every document gives its licence words (the words of all templates that it
   holds); their document frequencies over all documents give each word's IDF.
   The words of a document that holds all words of some key phrase are kept.
2. The anchors of a template are the words of its key phrase with the highest
   IDF. The rarest is the template's entry in the index: word -> (template,
   place in the template). Each place of an indexed word in a document, less its
   place in the template, is a start at which the template may stand.
3. The postings of the further anchors are intersected: a start stays if each
   stands at its place relative to it.
4. Last, the whole key phrase is verified at the starts that are left, and the
   share of the template's words that stand at their places is its score.

The anchors are part of the key phrase, so the index decides how much work there
is (`n_starts`, `n_aligned`), never what is found. Frequencies number as many as
the templates have words and go to the driver; all else stays in the rows, with
no shuffle but that of the frequencies.

Cases: a null or empty text has no words and no label. Rows with equal doc_id
are scanned each alone. An empty table gives an empty result. Phrases that
overlap are all counted, at each of their places. Words of equal IDF are taken in
the order of their places. A very long text takes time in proportion to its
words and to the places of indexed words. Columns besides doc_id and text aren't
read. Only A-Z are lower-cased: the one other character whose lower case is a
Latin letter, U+212A, never is part of a template's word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Anchors of each template: the words of its key phrase with the highest IDF.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    words: str
    key: str  # words of the mandatory phrase, a part of words
    base: bool = False


# The phrases asked for, and the notices by which licences are usually named.
TEMPLATES = (
    Template("mit", "mit", "mit license", "mit license", True),
    Template("apache", "apache", "apache license", "apache license", True),
    Template("gpl", "gpl", "general public license", "general public license", True),
    Template("mit-notice", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-notice", "apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-notice", "gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "agpl", "gnu affero general public license", "affero general public license"),
    Template("cc-by-nc", "cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("creative-commons", "creative-commons", "creative commons attribution", "creative commons"),
    Template("bsd", "bsd", "bsd license", "bsd license"),
    Template("bsd-notice", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl", "mpl", "mozilla public license", "mozilla public license"),
    Template("isc", "isc", "isc license", "isc license"),
)

# lower() would make U+212A a plain k; any other character beyond ASCII serves in its place
_WORDS = r"array_remove(split(lower(replace(coalesce(text, ''), '\u212A', '\u00B0')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')"


def _key_start(template: Template) -> int:
    words, key = template.words.split(), template.key.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def rarest_words(idf: dict[str, float], template: Template, anchors: int = ANCHORS) -> list[tuple[str, int]]:
    """The anchors of a template with their places in it, the rarest first."""
    first = _key_start(template)
    places = [(word, first + k) for k, word in enumerate(template.key.split())]
    return sorted(places, key=lambda x: (-idf[x[0]], x[1]))[: max(1, anchors)]


def _index(idf: dict[str, float], templates: tuple[Template, ...], anchors: int) -> tuple[list[str], str, str]:
    """The indexed words, and as SQL literals: word number -> starts to try, and the templates."""
    chosen = [rarest_words(idf, t, anchors) for t in templates]
    indexed = sorted({c[0][0] for c in chosen})
    postings = ["array(" + ", ".join(f"struct({k + 1} as t, {c[0][1]} as place)" for k, c in enumerate(chosen) if c[0][0] == word) + ")" for word in indexed]
    rows = []
    for t, c in zip(templates, chosen, strict=True):
        others = ", ".join(f"struct('{word}' as word, {place} as place)" for word, place in c[1:] or c)
        rows.append(
            f"struct('{t.label}' as label, {str(t.base).lower()} as base, {_strings(t.words.split())} as words, {_strings(t.key.split())} as key, {_key_start(t)} as key_start, array({others}) as others)"
        )
    return indexed, f"array({', '.join(postings)})", f"array({', '.join(rows)})"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_starts, n_aligned, matches (label, start, share of the template)."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    key_words = sorted({" ".join(sorted(set(t.key.split()))) for t in templates})
    holds_key = " or ".join(f"size(array_intersect(found, {_strings(k.split())})) = {len(k.split())}" for k in key_words)
    words = common.only(docs, "doc_id", "text").selectExpr("doc_id", f"{_WORDS} as words")
    seen = words.selectExpr("doc_id", "cast(size(words) as bigint) as n_words", "words", f"array_intersect(words, {_strings(vocabulary)}) as found")
    rows = common.stored(seen.selectExpr("doc_id", "n_words", "found", f"if({holds_key}, words, null) as words"), "licence-words")

    counted = rows.agg(F.count("*").alias("_rows"), *[F.count_if(F.array_contains("found", w)).alias(f"w{k}") for k, w in enumerate(vocabulary)]).first()
    idf = {w: math.log((counted["_rows"] + 1) / (counted[f"w{k}"] + 1)) for k, w in enumerate(vocabulary)}
    indexed, postings, table = _index(idf, templates, anchors)

    at = f"filter(transform(coalesce(words, cast(array() as array<string>)), (w, i) -> struct(array_position({_strings(indexed)}, w) as word, i as at)), x -> x.word > 0)"
    starts = f"flatten(transform(places, x -> transform({postings}[cast(x.word as int) - 1], p -> struct(p.t as t, cast(x.at - p.place as int) as start))))"
    # get() gives null outside of the document
    aligned = "filter(starts, c -> forall(templates[c.t - 1].others, a -> coalesce(get(words, c.start + a.place) = a.word, false)))"
    verified = "filter(aligned, c -> c.start + templates[c.t - 1].key_start >= 0 and slice(words, c.start + templates[c.t - 1].key_start + 1, size(templates[c.t - 1].key)) = templates[c.t - 1].key)"
    standing = "size(filter(templates[c.t - 1].words, (w, k) -> coalesce(get(words, c.start + k) = w, false)))"
    matches = f"array_sort(transform(verified, c -> struct(templates[c.t - 1].label as label, cast(c.start as bigint) as start, {standing} / size(templates[c.t - 1].words) as share, templates[c.t - 1].base as base)))"
    found = rows.selectExpr("doc_id", "n_words", "words", f"{at} as places").selectExpr("*", f"if(size(places) > 0, {table}, null) as templates", f"{starts} as starts")
    found = found.selectExpr("*", f"{aligned} as aligned").selectExpr("*", f"{verified} as verified").selectExpr("*", f"{matches} as matches")
    found = found.selectExpr("*", "filter(matches, m -> m.base) as base")
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(base) as bigint) as n_base", "array_min(transform(base, m -> m.start)) as first_word", "array_max(transform(base, m -> m.start)) as last_word",
        "array_join(array_sort(array_distinct(transform(base, m -> m.label))), ',') as base_labels", "array_join(array_sort(array_distinct(transform(matches, m -> m.label))), ',') as labels",
        "coalesce(array_max(transform(matches, m -> m.share)), 0D) as score", "cast(size(starts) as bigint) as n_starts", "cast(size(aligned) as bigint) as n_aligned", "matches",
    )
