"""Checks that run from raw text: what isn't a mark, a reference or a disagreement is told apart by what stands beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contexts, headings
from . import checks, drawings


#: The words of QUANTITIES as bits, and each group's bits.
_BITS = {word: 1 << k for k, word in enumerate(word for group in contexts.QUANTITIES for word in group)}
_GROUPS = [sum(_BITS[word] for word in group) for group in contexts.QUANTITIES]


def _different_quantities() -> Column:
    """Whether the values of a tag and unit, grouped, are different quantities rather than a disagreement.

    In one group of qualifiers every occurrence of every value names exactly one member, and two values name different
    ones. some, every: the bits that one occurrence of a value has, and all of them have.
    """
    said = [(F.col("some").bitwiseAND(bits), F.col("every").bitwiseAND(bits)) for bits in _GROUPS]
    return reduce(Column.__or__, [F.bool_and((some == every) & (F.bit_count(some) == 1)) & (F.min(some) < F.max(some)) for some, every in said])


def tag_value_conflicts(chunks: DataFrame) -> DataFrame:
    """Tags that sheets rate differently, from chunks (page_id, text): what `checks.tag_value_conflicts` finds in them.

    Texts are read once, and ratings shuffled once, by tag, unit and sheet; a sheet counts where its first rating stands,
    and for a value where the first of these does.
    """
    ratings = chunks.select(F.col("page_id").alias("sheet"), F.explode(contexts.rated_tags(F.col("text"))).alias("r"))
    bits = reduce(Column.bitwiseOR, [F.when(F.array_contains("r.qualifiers", word), bit).otherwise(0) for word, bit in _BITS.items()])
    valued = ratings.select("sheet", "r.tag", "r.unit", F.round("r.value", 3).alias("value"), bits.alias("bits"))
    on_sheet = Window.partitionBy("tag", "unit", "sheet").orderBy("value")
    known, before = F.col("sheet").isNotNull(), F.lag("value").over(on_sheet)
    counted = valued.withColumns({"new_sheet": (known & before.isNull()).cast("int"), "new_value": (known & ~before.eqNullSafe(F.col("value"))).cast("int")})
    per_value = counted.groupBy("tag", "unit", "value").agg(F.sum("new_sheet").alias("new_sheets"), F.sum("new_value").alias("sheets"), F.bit_or("bits").alias("some"), F.bit_and("bits").alias("every"))
    per_tag = per_value.groupBy("tag", "unit").agg(F.count("*").alias("n_values"), F.sum("new_sheets").alias("n_sheets"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("sheets").alias("most"), _different_quantities().alias("different"))
    found = per_tag.filter("n_values >= 2 and n_sheets >= 2 and not different")
    return found.select("tag", "unit", "n_values", "n_sheets", "low", "high", F.when(F.col("most") >= 2, "high").otherwise("medium").alias("confidence"))


def drawn_marks(chunks: DataFrame) -> DataFrame:
    """page_id, mark, family of the marks that a text uses: none of a room, grid, callout, listing or reference."""
    upper = F.upper(F.coalesce("text", F.lit("")))
    found = chunks.select("page_id", F.explode(contexts.occurrences(upper, contexts.MARK_TOKEN)).alias("o"))
    o = F.col("o")
    used = found.filter(~contexts.part_of_other_label(o) & ~contexts.referenced(o) & ~contexts.in_listing(o))
    return used.select("page_id", headings.mark_of(F.col("o.token")).alias("m")).filter("m is not null").select("page_id", "m.mark", "m.family").distinct()


def unscheduled_marks(plans: DataFrame, schedules: DataFrame) -> DataFrame:
    """Marks in the text of plans that their family's schedule text lacks."""
    return checks.unscheduled_marks(drawn_marks(plans), drawn_marks(schedules).select("family", "mark"))


def dangling_references(chunks: DataFrame, issued: DataFrame) -> DataFrame:
    """References to sheets that aren't issued, from chunks (page_id, text); numbers of listings are none."""
    upper = F.upper(F.coalesce("text", F.lit("")))

    def pointed(pattern: str) -> DataFrame:
        found = chunks.select("page_id", upper.alias("u")).select("page_id", F.explode(contexts.occurrences(F.col("u"), pattern)).alias("o")).filter(~contexts.in_listing(F.col("o")))
        return found.select("page_id", F.regexp_extract("o.token", pattern, 1).alias("sheet"))

    return checks.dangling_references(pointed(drawings.CALLOUT).unionByName(pointed(drawings.POINTER)), issued)
