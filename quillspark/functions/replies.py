"""Batches' replies read back: whatever isn't as asked for is left out, nothing is guessed. And what calls will cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domain import DISCIPLINES, discipline_of

# Choices, lengths and shares of the reply formats.
LEAST_CONFIDENT = 0.5
IMAGE, SYSTEM, WORDS, LOOK, CLOSER = 1600, 1800, 500, 700, 600
CLOSE_SHARES = {"low": 0.05, "high": 0.35}
REVIEW_SYSTEM, CHUNK_OVERHEAD, DISCOVERY, PER_CHECK, REASONING, VERIFICATION = 2500, 40, 4000, 250, 2000, 2000

SHEETS = "array<struct<index:string,sheet_number:string,prefix:string,confidence:double>>"


def sheet_answers(raw: Column, count: Column) -> Column:
    """Of a batch's reply (a list, or {"sheets": list}, fenced or not): array<struct<position, sheet, discipline>>.

    The first answer for a position counts; numbers outside the batch are left out. A position that was answered
    without a sheet of a known discipline, or with too little confidence, has nulls: it isn't asked again.
    """
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    listed = F.when(F.startswith(bare, F.lit("[")), F.from_json(bare, SHEETS)).otherwise(F.from_json(bare, f"struct<sheets:{SHEETS}>")["sheets"])
    numbered = F.filter(listed, lambda x: F.coalesce(x["index"].rlike(r"^\s*[0-9]{1,9}\s*$"), F.lit(False)))
    placed = F.transform(numbered, lambda x: F.struct((F.trim(x["index"]).cast("int") - 1).alias("position"), F.upper(F.trim(x["sheet_number"])).alias("sheet"), F.upper(F.trim(x["prefix"])).alias("prefix"), x["confidence"].alias("sure")))
    inside = F.filter(placed, lambda x: (x["position"] >= 0) & (x["position"] < count))
    first = F.filter(inside, lambda x, k: F.array_position(inside["position"], x["position"]) == k + 1)

    def read(x: Column) -> Column:
        letters = F.regexp_replace(x["sheet"], r"[^\p{L}]", "")
        known = lambda n: F.when(F.substring(letters, 1, n).isin(*[k for k in DISCIPLINES if len(k) == n]), F.substring(letters, 1, n))
        prefix = F.coalesce(F.when(x["prefix"].isin(*DISCIPLINES), x["prefix"]), known(2), known(1))
        good = (x["sure"] >= LEAST_CONFIDENT) & (x["sheet"] != "") & prefix.isNotNull()
        return F.struct(x["position"].alias("position"), F.when(good, x["sheet"]).alias("sheet"), F.when(good, discipline_of(prefix)).alias("discipline"))

    return F.transform(first, read)


def look_estimate(tiles: Column, extra: Column) -> Column:
    """Calls and tokens of looking at pairs of tiles, and of the closer looks that a share of them leads to."""
    n = tiles.cast("bigint")
    close = {k: F.ceil(n * F.lit(v)) for k, v in CLOSE_SHARES.items()}
    later = [x for k, c in close.items() for x in (c.alias(f"close_{k}"), (c * (2 * IMAGE + SYSTEM + 600)).alias(f"close_input_{k}"), (c * CLOSER).alias(f"close_output_{k}"))]
    return F.struct(n.alias("calls"), (n * 2).alias("images"), (n * (2 * IMAGE + SYSTEM + WORDS + extra)).alias("input"), (n * LOOK).alias("output"), *later)


def review_estimate(evidence: Column, chunks: Column, checks: Column, most_input: int, most_batches: int) -> Column:
    """Calls and tokens of a review: discovery in batches, one reasoning call, and a second look at half the evidence.

    evidence: tokens of all chunks (CHUNK_OVERHEAD added to each) and images.
    """
    batches = F.least(F.lit(most_batches), F.greatest(F.lit(1), F.ceil(evidence / max(1, most_input - REVIEW_SYSTEM))))
    found = (F.lit(DISCOVERY) + checks * PER_CHECK) * batches
    discovery = batches * REVIEW_SYSTEM + F.least(evidence, batches * most_input)
    reading = discovery + REVIEW_SYSTEM + found + chunks * 15 + REVIEW_SYSTEM + REASONING + F.floor(evidence / 2 + 0.5)
    return F.struct((batches + 2).cast("bigint").alias("calls"), reading.cast("bigint").alias("input"), (found + REASONING + VERIFICATION).cast("bigint").alias("output"))
