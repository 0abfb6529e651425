"""Quality rules as a bitmask ledger, in DataFrame functions only.

measure() evaluates everything once for each text. ledger() adds one long,
`failed`, in which bit k says that rule k failed. Policies are versions with a
mask of the rules they enforce; a document passes a policy when
`failed & mask = 0`, so that new versions and ablations need the ledger alone.

Repeated 5-word windows are found by their 64-bit hashes within one text:
sorted with their places, equal neighbours repeat. Only texts with repeats are
sorted.

Cases: a null or empty text has no words and fails too_few_words. Rows that
repeat are judged each alone, equal rules' bits don't depend on each other, so
there are no ties. Very long texts are measured whole (very_long fails them under
`strict` alone). Columns besides doc_id and text aren't read, so their names can't
clash. An empty table gives an empty ledger, and an ablation without rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("few_distinct_words", "n_words >= 50 and 100 * n_distinct_words < 15 * sqrt(n_words * 50)"),
    Rule("very_long", "n_words > 100000"),
)
#: Rules that fail a document whatever the policy.
BASE_MASK = 0b11
#: version -> mask of enforced rules
POLICIES = {"base": 0b00000011, "v1": 0b00001111, "v2": 0b00111111, "strict": 0b11111111}
CURRENT = "v2"

_WORDS = r"array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')"
_LINES = r"filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
_HASHES = "if(size(words) < 5, cast(array() as array<bigint>), transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])))"
# The places whose hash equals a neighbour's in sorted order, then the words they cover: each place covers
# the words up to the next place, five at most. array(...)[0] binds a value once for the inner lambda.
_REPEATED = """
case when size(array_distinct(hashes)) = size(hashes) then 0L else
  transform(array(sort_array(transform(hashes, (h, i) -> struct(h as h, i as i)))), s ->
    transform(array(sort_array(transform(filter(s, (e, j) ->
        (j > 0 and s[if(j > 0, j - 1, 0)].h = e.h) or (j < size(s) - 1 and s[if(j < size(s) - 1, j + 1, j)].h = e.h)), e -> e.i))), p ->
      aggregate(transform(p, (x, j) -> if(j < size(p) - 1, least(5, p[if(j < size(p) - 1, j + 1, j)] - x), 5)), 0L, (a, x) -> a + x))[0])[0]
end
"""


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each text."""
    words = docs.selectExpr("doc_id", "text", f"{_WORDS} as words")
    hashed = words.selectExpr("doc_id", "text", "words", f"{_LINES} as lines", f"{_HASHES} as hashes")
    return hashed.selectExpr(
        "doc_id",
        "cast(size(words) as bigint) as n_words",
        "cast(length(array_join(words, '')) as bigint) as word_chars",
        "cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '')) as bigint) as n_symbols",
        "cast(size(lines) as bigint) as n_lines",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        f"cast({_REPEATED} as bigint) as n_repeat_words",
        "cast(size(array_distinct(words)) as bigint) as n_distinct_words",
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with `failed`, the bits of the rules that failed."""
    bits = " | ".join(f"if({r.fails}, {1 << k}L, 0L)" for k, r in enumerate(rules))
    return measure(docs).withColumn("failed", F.expr(bits))


def judge(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept by this version."""
    mask = POLICIES[version] | BASE_MASK
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each version and rule: documents, those kept, and those kept without the rule.

    The ledger is first counted by its bits, at most 2 ** len(rules) groups.
    """
    groups = rows.groupBy("failed").agg(F.count("*").alias("n"))
    policies = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("bigint").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for v, m in POLICIES.items() for k, r in enumerate(rules) if m >> k & 1])
    pairs = groups.withColumn("p", F.explode(policies)).select("failed", "n", "p.*")
    passed = lambda mask: F.sum(F.when(F.col("failed").bitwiseAND(mask) == 0, F.col("n")).otherwise(0))
    return pairs.groupBy("version", "rule").agg(F.sum("n").alias("n_docs"), passed(F.col("mask")).alias("n_kept"), passed(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit")))).alias("n_kept_without"))
