"""Rules over statuses, scopes, prices and lists as Column expressions. Null inputs give the defined result named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds without a sign of life after which a run, or a package, counts as dead.
STALE_SECONDS = 600
RUNNING = ("planning", "queued", "running")
#: Smallest share of a page's width and height that a saved box may have.
LEAST_BOX = 0.002
ALL = "all"


def _micros(c: Column) -> Column:
    """Microseconds; timestamps without a zone count in the session's."""
    return F.unix_micros(c.cast("timestamp"))


def shown_status(status: Column, seen: Column, now: Column, limit: int = STALE_SECONDS) -> Column:
    """The status with dead runs as failed; seen is the last sign of life."""
    dead = status.isin(*RUNNING) & (_micros(now) - _micros(seen) >= limit * 1_000_000)
    return F.when(dead, "failed").otherwise(status)


def can_resume(status: Column, total: Column) -> Column:
    return F.coalesce(status.isin("partial", "failed") & (total > 0), F.lit(False))


def can_plan_again(shown: Column, started: Column) -> Column:
    """shown: the latest run's shown status, null if there is none."""
    return shown.isNull() | shown.isin("cancelled", "stale", "ready", "partial", "planned") | ((shown == "failed") & started.isNull())


def package_is_stale(status: Column, created: Column, job_state: Column, job_started: Column, now: Column, limit: int = STALE_SECONDS) -> Column:
    """job_state null: the queue couldn't say, and age decides; gone or failed jobs are dead, active ones after the limit."""
    older = lambda since: _micros(now) - _micros(since) > limit * 1_000_000
    dead = F.when(job_state.isNull(), older(created)).when(job_state.isin("gone", "failed"), True).otherwise((job_state == "active") & job_started.isNotNull() & older(job_started))
    return F.coalesce(status.isin("queued", "running") & dead, F.lit(False))


def pair_in(side_a: Column, side_b: Column, first: Column, second: Column) -> Column:
    """Whether sheets of two disciplines (null: unknown) are a pair of the scope (a, b), either way round."""
    either = F.coalesce(first == side_a, F.lit(False)) | F.coalesce(second == side_a, F.lit(False))
    across = (first.eqNullSafe(side_a) & second.eqNullSafe(side_b)) | (first.eqNullSafe(side_b) & second.eqNullSafe(side_a))
    return F.when((side_a == ALL) & (side_b == ALL), True).when(side_b == ALL, either).otherwise(across)


def finding_in(side_a: Column, side_b: Column, disciplines: Column) -> Column:
    """Whether a finding on sheets of these disciplines (array, nulls don't count) belongs to the scope."""
    known = F.array_distinct(F.array_compact(disciplines))
    has = lambda side: F.array_contains(known, side)
    two = F.when(F.size(known) == 1, has(side_a) | has(side_b)).otherwise(has(side_a) & has(side_b))
    inside = F.when(side_b == ALL, has(side_a)).when(side_a == side_b, (F.size(known) == 1) & has(side_a)).otherwise(two)
    return F.when((side_a == ALL) & (side_b == ALL), True).when(F.size(known) == 0, False).otherwise(inside)


def is_plausible_box(width: Column, height: Column) -> Column:
    return F.coalesce((width >= LEAST_BOX) & (height >= LEAST_BOX), F.lit(False))


def chosen_after(current: Column, asked: Column, present: Column, everything: Column) -> Column:
    """Sorted union of both, and of all that is present (and what is unsorted) if everything was asked for."""
    more = F.when(everything, F.array_union(present, F.array(F.lit("unsorted")))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_union(current, asked), more))


def sheet_list(locations: Column) -> Column:
    """Distinct sheet numbers, first seen first; (page n) where there is none. locations: array of (sheet, combined, page)."""
    name = lambda x: F.coalesce(x["sheet"], F.format_string("(page %s)", F.coalesce(x["combined"], x["page"]).cast("string")))
    return F.array_join(F.array_distinct(F.transform(locations, name)), ", ")


def page_list(locations: Column) -> Column:
    """Distinct page numbers in ascending order, combined ones before a document's own."""
    pages = F.array_compact(F.transform(locations, lambda x: F.coalesce(x["combined"], x["page"])))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pages)), lambda n: n.cast("string")), ", ")


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd of a timestamp's text, empty if it is null or none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"), F.lit(""))


def date_key(c: Column) -> Column:
    """(y, m, d) of m/d/y or m-d-y, years below 100 in this century; zeros for null or empty text."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^(\d+)[/-](\d+)[/-](\d+)$", k), F.lit("")).cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    zero = F.lit(0)
    return F.struct(F.coalesce(year, zero).alias("y"), F.coalesce(part(1), zero).alias("m"), F.coalesce(part(2), zero).alias("d"))


def cost_difference(base: Column, other: Column) -> tuple[Column, Column]:
    """(difference, percent of base); percent is null unless base is above 0."""
    return other - base, F.when(base > 0, (other - base) / base * 100)


def caveats(differs: dict[str, Column]) -> Column:
    """The texts whose columns are true, in order; array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for text, c in differs.items()]))


def billable_units(provider: Column, texts: Column) -> Column:
    """One search, or a quarter of each text's characters, one at least, summed."""
    tokens = F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, t: a + F.greatest(F.lit(1), F.floor(F.length(t) / 4)).cast("bigint"))
    return F.when(provider == "search", F.lit(1).cast("bigint")).otherwise(tokens)


def priced(input_tokens: Column, output_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    """US dollars at rates per million tokens; null without rates."""
    return (input_tokens * rate_in + output_tokens * rate_out) / 1_000_000


def price_range(estimate: dict[str, Column], rate_in: Column, rate_out: Column, batch: Column) -> tuple[Column, Column]:
    """(low, high): discovery, at half price in a batch, with the least and the most verification; null without rates."""
    discovery = priced(estimate["input"], estimate["output"], rate_in, rate_out) * F.when(batch, 0.5).otherwise(1.0)
    low, high = (discovery + priced(estimate[f"verify_input_{k}"], estimate[f"verify_output_{k}"], rate_in, rate_out) for k in ("low", "high"))
    return low, high


def budget_tokens(budget: Column, input_tokens: Column, output_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    """Tokens that a budget buys at the full rate of the estimate's mix (3 : 1 without one); null without rates or budget."""
    into, out = F.greatest(F.lit(1), F.coalesce(input_tokens, F.lit(3))), F.greatest(F.lit(0), F.coalesce(output_tokens, F.lit(1)))
    each = priced(into, out, rate_in, rate_out) / (into + out)
    return F.when((budget > 0) & (each > 0), F.floor(budget / each))


def start_decision(tiles: Column, has_key: Column, high: Column, limit: Column) -> Column:
    """What becomes of a plan under a spend limit; high is its highest price, null if unknown."""
    return F.when(tiles <= 0, "nothing").when(~has_key, "no_key").when(high.isNull(), "no_price").when(high > limit, "over_limit").otherwise("started")
