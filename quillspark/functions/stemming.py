"""English stems as Column expressions: the public Porter2 ("english" Snowball) algorithm over words of a-z.

Words with a digit or of one or two letters are their own stems. Each step looks for its longest suffix first and does
nothing where that one's condition fails. R1 and R2 are kept as lengths that a stem must have before a suffix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1 = "^(?:gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])"
R2 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _suffix(w: Column, suffixes: object) -> Column:
    """The longest of these that the word ends with: the match that begins first."""
    return F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _without(w: Column, n: int | Column) -> Column:
    return F.left(w, F.length(w) - n)


def _plural(w: Column) -> Column:
    end = _suffix(w, ("sses", "ied", "ies", "us", "ss", "s"))
    return (
        F.when(end == "sses", _without(w, 2))
        .when(end.isin("ied", "ies"), F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1)))
        .when((end == "s") & w.rlike("[aeiouy].+s$"), _without(w, 1))
        .otherwise(w)
    )


def _past(w: Column, r1: Column) -> Column:
    end = _suffix(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))

    def mended(stem: Column) -> Column:
        is_short = (F.length(stem) <= r1) & stem.rlike(SHORT)
        return F.when(stem.rlike("(at|bl|iz)$") | (is_short & ~stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")), F.concat(stem, F.lit("e"))).when(stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(stem, 1)).otherwise(stem)

    def stripped(e: Column) -> Column:
        stem = _without(w, F.length(e))
        return (
            F.when(e.isin("eed", "eedly"), F.when(F.length(stem) >= r1, F.concat(stem, F.lit("ee"))).otherwise(w))
            .when((e != "") & stem.rlike("[aeiouy]"), let(stem, mended))
            .otherwise(w)
        )

    return let(end, stripped)


def _replaced(w: Column, values: dict[str, str], allowed: Callable[[Column, Column], Column]) -> Column:
    """The word with its longest suffix replaced if `allowed` says so of (suffix, what is before it)."""
    return let(_suffix(w, values), lambda e: let(_without(w, F.length(e)), lambda before: F.when((e != "") & allowed(e, before), F.concat(before, F.element_at(_table(values), e))).otherwise(w)))


def _last(w: Column, r1: Column, r2: Column) -> Column:
    before = _without(w, 1)
    n = F.length(before)
    drop_e = w.endswith("e") & ((n >= r2) | ((n >= r1) & ~before.rlike(SHORT)))
    return F.when(drop_e | (w.endswith("ll") & (n >= r2)), before).otherwise(w)


def _stemmed(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")

    def by_regions(w: Column) -> Column:
        to_r1 = F.length(F.regexp_extract(w, R1, 0))
        r1 = F.when(to_r1 > 0, to_r1).otherwise(F.length(w))

        def with_r1(r1: Column) -> Column:
            to_r2 = F.length(F.regexp_extract(F.substr(w, r1 + 1), R2, 0))
            r2 = F.when(to_r2 > 0, r1 + to_r2).otherwise(F.length(w))
            return let(r2, lambda r2: steps(w, r1, r2))

        return let(r1, with_r1)

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        inside = lambda before: F.length(before) >= r1
        second = lambda e, b: inside(b) & F.when(e == "ogi", b.endswith("l")).when(e == "li", b.rlike("[cdeghkmnrt]$")).otherwise(True)
        third = lambda e, b: inside(b) & ((e != "ative") | (F.length(b) >= r2))
        fourth = lambda e, b: (F.length(b) >= r2) & ((e != "ion") | b.rlike("[st]$"))
        rest = (
            lambda w: _past(w, r1),
            lambda w: F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"),
            lambda w: _replaced(w, STEP2, second),
            lambda w: _replaced(w, STEP3, third),
            lambda w: _replaced(w, dict.fromkeys(STEP4, ""), fourth),
            lambda w: _last(w, r1, r2),
        )

        def chain(w: Column, left: tuple) -> Column:
            return let(left[0](w), lambda x: chain(x, left[1:])) if left else F.translate(w, "Y", "y")

        return let(_plural(w), lambda w: F.when(w.isin(*KEPT), w).otherwise(chain(w, rest)))

    return let(marked, by_regions)


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    return F.when((F.length(word) <= 2) | word.rlike("[^a-z]"), word).when(word.isin(*WHOLE), F.element_at(_table(WHOLE), word)).otherwise(_stemmed(word))
