"""Scalar text functions as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the identifier format (sheet, detail and member numbers).
IDENTIFIER = r"\b([A-Z]{1,3}[-.]?[0-9]{1,4}(?:\.[0-9]+){0,2}(?:-[A-Z]{1,3}\b)*[A-Z]?|[A-Z][0-9]{1,3}[xX][0-9]{1,3})\b"
TOKENS_PER_WORD, MAX_TOKENS, OVERLAP_TOKENS = 1.3, 800, 100


def normalize(c: Column) -> Column:
    """Upper case without anything but letters and digits."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def identifiers(c: Column) -> Column:
    """Distinct normal forms of all identifiers in a text, sorted."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), 1)
    return F.array_sort(F.array_distinct(F.transform(found, normalize)))


def words(c: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def estimated_tokens(c: Column) -> Column:
    """1.3 tokens a word, rounded half to even; 0 for a blank text, else 1 at least."""
    # a word is more than half a token: the rounding alone gives 0 for none and 1 for one
    return F.bround(F.size(words(c)) * F.lit(TOKENS_PER_WORD)).cast("int")


def approximate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(check: Column, *parts: Column) -> Column:
    """Identity of a finding: its check and the first 24 hex digits of the hash of its parts."""
    return F.concat(check, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", check, *parts), 256), 1, 24))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def plain_numbers(c: Column) -> Column:
    """Numbers without their thousands commas."""
    return F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def shape(normalized: Column) -> Column:
    """Letters, digit count and whether a letter trails, as text: `S3x`."""
    letters = F.regexp_extract(normalized, "^([A-Z]{1,3})([0-9]+)([A-Z]?)$", 1)
    digits = F.regexp_extract(normalized, "^([A-Z]{1,3})([0-9]+)([A-Z]?)$", 2)
    tail = F.regexp_extract(normalized, "^([A-Z]{1,3})([0-9]+)([A-Z]?)$", 3)
    return F.when(digits == "", None).otherwise(F.concat(letters, F.length(digits).cast("string"), F.when(tail == "", "").otherwise("x")))


def table_markdown(rows: Column, clean: bool = False) -> Column:
    """Rows of cells (array<array<string>>) as a pipe table with the first row as its head; clean: cells need no escapes."""
    cell = lambda x: x if clean else F.trim(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")


def feet_inches(c: Column) -> Column:
    """One printed length (8", 1'-4 1/2", EL. 104'-6") in inches; anything else is null."""
    pattern = r"^\s*(?:EL\.?\s*)?([+-]?)(?:([0-9]+)'\s*-?\s*)?(?:([0-9]+)?(?:\s*([0-9]+)/([0-9]+))?\s*\")?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    number = lambda k: F.coalesce(part(k).cast("double"), F.lit(0.0))
    fraction = F.when(part(4).isNotNull(), number(4) / F.nullif(number(5), F.lit(0.0))).otherwise(0.0)
    size = number(2) * 12 + number(3) + fraction
    given = part(2).isNotNull() | part(3).isNotNull() | part(4).isNotNull()
    return F.when(given, F.when(part(1) == "-", -size).otherwise(size))
