"""How far the sources of each language are apart, term by term and exactly.

For each language the terms in at least LEAST_DOCS of its documents are kept. A
group (lang, source) gives each kept term the whole-number share
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and two groups are apart by the
sum of floor((p - q)^2 / (p + q)) over all kept terms. No group ever meets all V
terms of another; inclusion and exclusion over the supports gives the same sum:

1. Terms that both lack: V less both supports plus their overlap, at one constant.
2. Terms that one has are priced from its histogram of counts (a few hundred
   bins) against what the other gives an absent term, as if the other lacked all.
3. Terms that both have stand in both groups' postings: a join of the postings
   by term puts right what 1 and 2 assumed of them.

Terms are counted per Arrow batch in Python (A-Z lower-cased, all non-ASCII
characters are letters) and leave their task as sums. Counts are multiplied as
decimals, so that they can't overflow.

Scale: shuffled are sums by (lang, source, term), never words. Joins by language
alone, which the contract's list of all pairs of sources asks for, are dealt over
PARTS keys by the left side's bin or source. A posting list holds at most one row
for each source of its language.

Cases: null text, lang or source count as empty. Rows count as documents however
often their id or text repeats. A group without terms has N = 0 and still stands in
`pair`; without kept terms V = 0 and every value is 0. Ties are ranked by the
item's UTF-8 bytes. Very long texts are taken whole. Other columns aren't read, so
their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that a kept term is in at least, what shares are of, and ranks of terms that are told.
LEAST_DOCS, SCALE, TERMS = 10, 1_000_000_000, 10
#: Distinct (lang, source, term) that a task holds before it passes their sums on.
HELD_TERMS = 500_000
#: Characters of texts that are cut into terms at a time.
PART_CHARS = 4_000_000
#: Keys over which a language's rows are dealt in joins by language.
PARTS = 64

#: Bytes of terms, A-Z lowered; all others are spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, with repeats, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, source, term), passed on whenever HELD_TERMS of them have gathered."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), words, pa.array(list(n.values()), pa.int64()), pa.array([docs[w] for w in n], pa.int64())]
            if len(n):
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources, texts = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
        for a, b in common.parts([len(t or "") for t in texts], PART_CHARS):
            for lang, source, text in zip(langs[a:b], sources[a:b], texts[a:b], strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text)
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from out()
    yield from out()


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exact however large the count."""
    return F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _by_language(left: DataFrame, right: DataFrame, *dealt: str) -> DataFrame:
    """Rows of the same language, the left ones dealt over PARTS keys, the right ones (one for each source) repeated."""
    left = left.withColumn("_part", F.pmod(F.xxhash64(*dealt), F.lit(PARTS)))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return left.join(right, ["lang", "_part"]).drop("_part")


def tables(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: groups (lang, source, size, v, total, lang_total, p0), postings (lang, source, term, n, lang_n) of kept
    terms, histogram (lang, source, n, terms). size: kept terms that a group has; p0: its share of a term that it lacks."""
    common.small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), "text")
    counts = docs.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = common.stored(counts, "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs).drop("docs")
    postings = common.stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "term-postings")
    histogram = common.stored(postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "count-histogram")

    langs = postings.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = histogram.groupBy("lang", "source").agg(F.sum("terms").alias("size"), F.sum(F.col("n") * F.col("terms")).alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "total", "v", "lang_total"])
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("total") + 2 * F.col("v")))
    return common.stored(groups.withColumn("p0", p0), "term-groups"), postings, histogram


def pair_values(groups: DataFrame, postings: DataFrame, histogram: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of different sources of a language."""
    named = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"), F.col("p0").alias("item_p0"))
    ends = groups.filter("v > 0").select("lang", "source", "p0", (F.col("total") + 2 * F.col("v")).alias("of"))
    other = F.col("source") != F.col("item")
    # as if no term were in both: what both lack at one constant ...
    lacking = F.col("v") - F.col("size") - F.col("item_size")
    constant = _by_language(groups, named, "source").filter(other).select("lang", "source", "item", F.coalesce(lacking * apart(F.col("p0"), F.col("item_p0")), F.lit(0)).alias("value"))
    # ... and what one has from its histogram
    bins = histogram.join(ends, ["lang", "source"]).select("lang", "source", "n", "terms", share(F.col("n"), F.col("of")).alias("p"))
    one_sided = _by_language(bins, named, "source", "n").filter(other).select("lang", "source", "item", (F.col("terms") * apart(F.col("p"), F.col("item_p0"))).alias("value"))
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # terms in both: each was priced twice as one-sided, and taken once too often from what both lack
    priced = postings.join(ends, ["lang", "source"]).select("lang", "term", "source", "p0", share(F.col("n"), F.col("of")).alias("p"))
    again = priced.select("lang", "term", F.col("source").alias("item"), F.col("p0").alias("item_p0"), F.col("p").alias("item_p"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "item_p", "item_p0"))
    overlap = priced.join(again, ["lang", "term"]).filter(F.col("source") < F.col("item")).select("lang", "source", "item", (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value"))
    overlap = overlap.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    turned = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return constant.unionByName(turned(one_sided)).unionByName(turned(overlap)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value of each term to which a group gives a larger share than its language does."""
    v2 = 2 * F.col("v")
    ends = groups.filter("v > 0").select("lang", "source", (F.col("total") + v2).alias("of"), (F.col("lang_total") + v2).alias("lang_of"))
    both = postings.join(ends, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("of")).alias("p"), share(F.col("lang_n"), F.col("lang_of")).alias("q"))
    return both.filter("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows of all other sources, `term` rows of the first ranks."""
    groups, postings, histogram = tables(docs, least_docs)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(groups, postings, histogram).withColumn("rank", ranked)
    first = term_values(groups, postings).withColumn("rank", ranked).filter(F.col("rank") <= most_terms)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(first, "term"))
