"""Matches in a text with their places and what stands beside them, and what that says about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .headings import RATING, RATING_WINDOW, TAG, rating_value
from .stemming import let

# What stands before or after a mark that makes it part of another label, a reference, or a listing's number.
ROOM_BEFORE, GRID_BEFORE, SHEET_AFTER = r"\d[A-Z]?-$", r"\bGRIDS?(?:\s+LINES?)?\s+$", r"^\s*/\s*[A-Z]{1,2}-?\d"
REFERENCE_BEFORE = r"\b(?:SEE|REFER(?:\s+TO)?|REF\.?|PER)\s*[-:]?\s*$"
LISTED = r"(?:[A-Z]{1,2}-?\d{2,4},?\s*(?:OR\s+|AND\s+|&\s*)?)"
LISTING_BEFORE = rf"\bDESIGNS?\s*(?:NOS?\.?|NUMBERS?|#)?\s*{LISTED}*$|\b(?:ASTM|ANSI|AASHTO|CSA|AWS|ACI|AISC|NFPA|UL|ULC|ICC|ASHRAE|SMACNA)\s*{LISTED}*$"
LISTING_AFTER = rf"^\W{{0,3}}(?:(?:OR|AND|&)\s+)?{LISTED}*SERIES\b"
# Words that say which quantity a rating is; those of one group are different quantities of one thing.
QUALIFIERS = r"\b(INPUT|OUTPUT|MIN(?:IMUM)?|MAX(?:IMUM)?|SUPPLY|EXHAUST|RETURN|OUTSIDE|SENSIBLE|TOTAL|LATENT|HEATING|COOLING|SUMMER|WINTER|PRIMARY|SECONDARY)\b"
QUANTITIES = (("INPUT", "OUTPUT"), ("MIN", "MAX"), ("SUPPLY", "EXHAUST", "RETURN", "OUTSIDE"), ("SENSIBLE", "TOTAL", "LATENT"), ("HEATING", "COOLING"), ("SUMMER", "WINTER"), ("PRIMARY", "SECONDARY"))
# Fixed value: the form of a mark in running text.
MARK_TOKEN = r"(?<![\w./-])[A-Z]{1,3}-?\d{1,4}[A-Z]?(?!\w)"
#: Characters beside a match that its context holds.
BESIDE = 60
#: Letters, digits and white space of all scripts count as such.
UNICODE = "(?U)"


def occurrences(upper: Column, pattern: str, context: bool = True) -> Column:
    """array<struct<token, start, end, before, after>> of a pattern's matches, places from 0.

    Without context, before and after are left out. The text is never split by the pattern: split would compile it anew
    for each row.
    """

    def placed(gaps: Column, tokens: Column) -> Column:
        # before each match stands a gap: their lengths add up to the places
        steps = F.zip_with(gaps, tokens, lambda p, t: F.struct(F.length(p).alias("gap"), F.length(t).alias("size"), t.alias("token")))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + x["size"]
            return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(x["token"].alias("token"), start.alias("start"), end.alias("end"))).alias("out"))

        return F.aggregate(steps, first, step, lambda s: s["out"])

    # each match starts where the last one ended, so that the search stops at the text's end
    gap_and_token = F.lit(rf"{UNICODE}\G((?s:.*?))({pattern})")
    found = placed(F.regexp_extract_all(upper, gap_and_token, 1), F.regexp_extract_all(upper, gap_and_token, 2))
    if not context:
        return found
    beside = lambda o: o.withField("before", F.substr(upper, F.greatest(o["start"] - BESIDE, F.lit(0)) + 1, F.least(o["start"], F.lit(BESIDE)))).withField("after", F.substr(upper, o["end"] + 1, F.lit(BESIDE)))
    return F.transform(found, beside)


def part_of_other_label(o: Column) -> Column:
    """Whether a match is the tail of a room's number, a grid intersection, or the detail half of a callout."""
    return F.right(o["before"], F.lit(6)).rlike(UNICODE + ROOM_BEFORE) | F.right(o["before"], F.lit(16)).rlike(UNICODE + GRID_BEFORE) | F.left(o["after"], F.lit(12)).rlike(UNICODE + SHEET_AFTER)


def referenced(o: Column) -> Column:
    return F.right(o["before"], F.lit(16)).rlike(UNICODE + REFERENCE_BEFORE)


def in_listing(o: Column) -> Column:
    """Whether a match is a number of a fire-rating listing or a published standard."""
    return o["before"].rlike(UNICODE + LISTING_BEFORE) | o["after"].rlike(UNICODE + LISTING_AFTER)


def rated_tags(c: Column) -> Column:
    """array<struct<tag, unit, value, qualifiers>>: each tag with each unit that exactly one rating after it has.

    A tag's window ends with RATING_WINDOW characters or where the next tag starts. Qualifiers are the words from the
    tag to just after its rating.
    """
    upper = F.upper(F.coalesce(c, F.lit("")))

    def of(o: Column, following: Column) -> Column:
        window = F.substr(upper, o["end"] + 1, F.greatest(F.lit(0), F.least(F.lit(RATING_WINDOW), F.coalesce(following["start"], F.length(upper)) - o["end"])))
        return let(occurrences(window, RATING, False), lambda found: let(F.transform(found, lambda r: r.withField("unit", F.regexp_replace(F.regexp_extract(r["token"], RATING, 2), "^TON$", "TONS"))), lambda found: rated(o, found)))

    def rated(o: Column, found: Column) -> Column:
        once = F.filter(found, lambda r: F.size(F.filter(found, lambda x: x["unit"] == r["unit"])) == 1)
        said = lambda r: F.substr(upper, o["start"] + 1, o["end"] + r["end"] + 12 - o["start"])
        words = lambda r: F.array_distinct(F.transform(F.regexp_extract_all(said(r), F.lit(UNICODE + QUALIFIERS), 1), lambda w: F.regexp_replace(w, "^(MIN|MAX)IMUM$", "$1")))
        row = lambda r: F.struct(o["token"].alias("tag"), r["unit"].alias("unit"), rating_value(F.regexp_extract(r["token"], RATING, 1)).alias("value"), words(r).alias("qualifiers"))
        return F.filter(F.transform(once, row), lambda x: x["value"].isNotNull())

    return let(occurrences(upper, TAG, False), lambda tags: F.flatten(F.transform(tags, lambda o, i: of(o, F.get(tags, i + 1)))))


# A schedule's title, the words that make it a pointer to one, those that name no element, and what follows a pointer.
SCHEDULE_TITLE = r"(?:[A-Z][A-Z/&-]*[ \t]+){0,4}SCHEDULE\b"
TITLE_POINTERS = ("SEE", "REFER", "REF", "FOR", "PER", "TO", "IN", "ON", "FROM", "WITH")
TITLE_FILLERS = ("AND", "OF", "THE", "&", "/", "TYPICAL", "TYP", "TYP.", "SCHEDULE", "SCHEDULES")
SEE_AFTER = r"^\W{0,3}(?:[A-Z]+\s+){0,3}(?:SEE|REFER|REF\.?)\b"
# The two halves of a callout bubble, makers and standards before a catalogue number, and what makes one a grade.
CALLOUT_SHEET = r"[A-Z]{1,2}-?\d{1,2}\.\d{2,3}(?:\.\d{2})?(?:-[A-Z]{1,2})?"
DETAIL_ID = rf"(?<![\w./-])([A-Z]\d{{1,2}})(?:\s*/\s*{CALLOUT_SHEET}|\s+{CALLOUT_SHEET}(?![\w.]))|(?<![\w./-]){CALLOUT_SHEET}\s+([A-Z]\d{{1,2}})(?![\w./])"
CATALOGUE_TOKEN = r"(?<![\w./-])[A-Z]{1,3}-?\d{1,4}[A-Z]?(?![\w/])"
MAKER_BEFORE = r"\b(?:SIMPSON|STRONG-?\s?TIE|HILTI|USP|MITEK|DEWALT|POWERS|RED\s?HEAD|HALFEN|JORDAHL|DAYTON(?:\s+SUPERIOR)?|MEADOW\s?BURKE|WILLIAMS|ITW|RAMSET)\s*(?:MODEL\s+|NO\.?\s*|#)?$|\bASTM\s*(?:[A-Z]\d{2,4}\s*(?:,|OR|AND|&|/)\s*)*$"
GRADE_AFTER = r"^\s*(?:(?:,|OR|AND|&|/)\s*[A-Z]\d{2,4}\s*)*(?:STEEL|GRADE|GR\.?\s*\d|MATERIAL|PLATES?\b|RODS?\b|REBAR|REINFORC)"
# An architectural scale as it is printed, and the inches to a foot that one may have.
SCALE = r"""(?<![\w.'"/-])(\d+(?:\s+\d+/\d+)?(?:/\d+)?)\s*(?:"|''|”|″)\s*=\s*1\s*(?:'|’|′)\s*-?\s*0\s*(?:"|''|”|″)"""
LEAST_SCALE, MOST_SCALE = 1 / 64, 3.0


def schedule_titles(c: Column) -> Column:
    """Titles of schedules in a text, in order: none with a pointer word in it, or with one right after it."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    words = lambda o: F.split(F.trim(F.regexp_replace(o["token"], r"[ \t]+", " ")), " ")
    points = lambda o: F.exists(F.slice(words(o), 1, F.greatest(F.size(words(o)) - 1, F.lit(0))), lambda w: F.regexp_replace(w, "^[.,:]+|[.,:]+$", "").isin(*TITLE_POINTERS))
    kept = F.filter(occurrences(upper, SCHEDULE_TITLE), lambda o: ~points(o) & ~o["after"].rlike(UNICODE + SEE_AFTER))
    return F.transform(kept, lambda o: F.array_join(words(o), " "))


def names_family(title: Column, family: Column) -> Column:
    """Whether a schedule's title is about a family of marks: its initials, or its letters in order in one word.

    A family of one letter must begin the word before SCHEDULE, and that must be no abbreviation.
    """
    bare = F.transform(F.split(F.trim(F.regexp_replace(F.upper(title), r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"^[.,:()]+|[.,:()]+$", ""))

    def judged(words: Column) -> Column:
        last = F.element_at(words, -1)
        initials = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
        spelled = F.concat(F.lit("^"), F.regexp_replace(family, "(.)", "$1.*"))
        several = F.contains(initials, family) | F.exists(words, lambda w: F.regexp(w, spelled))
        return F.when(F.size(words) == 0, False).when(F.length(family) == 1, (F.left(last, F.lit(1)) == family) & (F.length(last) >= 4)).otherwise(several)

    return let(F.filter(bare, lambda w: (w != "") & ~w.isin(*TITLE_FILLERS)), judged)


def detail_numbers(c: Column) -> Column:
    """Tokens that a text uses as a detail's number, beside or over a sheet's number, each once."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    either = lambda k: F.regexp_extract_all(upper, F.lit(UNICODE + DETAIL_ID), k)
    return F.array_distinct(F.filter(F.concat(either(1), either(2)), lambda x: F.coalesce(x, F.lit("")) != ""))


def catalogue_numbers(c: Column) -> Column:
    """Mark-shaped tokens that are a maker's model or a material's grade, without hyphens, each once."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    found = F.filter(occurrences(upper, CATALOGUE_TOKEN), lambda o: F.right(o["before"], F.lit(30)).rlike(UNICODE + MAKER_BEFORE) | F.left(o["after"], F.lit(40)).rlike(UNICODE + GRADE_AFTER))
    return F.array_distinct(F.transform(found, lambda o: F.regexp_replace(o["token"], "[^A-Z0-9]", "")))


def scales_in(c: Column) -> Column:
    """Architectural scales printed in a text, as points a foot (1/4" = 1'-0" is 18): distinct, sorted."""

    def inches(text: Column) -> Column:
        parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
        number = lambda p: F.when(p.contains("/"), F.try_divide(F.split_part(p, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(p, F.lit("/"), F.lit(2)).try_cast("double"))).otherwise(p.try_cast("double"))
        # a part that is no number leaves none
        return F.when(~F.exists(parts, lambda p: p.rlike("/.*/")), F.aggregate(parts, F.lit(0.0), lambda total, p: total + number(p)))

    # what is printed of a match is its first group
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SCALE), 1), inches)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: (x >= LEAST_SCALE) & (x <= MOST_SCALE)), lambda x: F.round(x * 72, 4))))
