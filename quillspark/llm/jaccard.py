"""Exact Jaccard join on word n-grams by vertical partitioning.

The n-grams of all documents have one global order; it is cut into fragments,
overlaps are counted apart in each fragment and summed.

1. Each text becomes its set of 64-bit n-gram hashes. Documents with equal sets
   are one class, known by the set's own hash: from here on classes are joined,
   so copies are never paired with each other.
2. The order by hash is cut into ranges. Each fragment gets, of every class, the
   hashes in its range, packed, and finds each hash's document frequency (over
   classes). A hash of one class alone can't be shared: only the others go on.
3. Summed over fragments, a class that shares less than 3/4 of its set links
   with nothing and is done. Most of a corpus ends here.
4. The rest is ordered by (frequency, hash). Two classes can only link if they
   have a common hash among the first n - ceil(3n/4) + 1 of each (prefix). In
   each posting list first the most central class meets the others (a star);
   linked classes are one component. Then only classes of different components
   meet: within a hash by bands of length, each class in the bands that its
   position of the hash allows, and those of the hash's most frequent component
   only with the others.
5. A pair's overlap is counted in vertical fragments of the global order (ranges
   of frequency) and summed per pair.

Nothing pairs all members of a group: a group of m near copies costs about m
pairs. Joins on keys that may be hot (a hash, a component, a star's centre) deal
the rows of keys with many rows over several tasks. All state is in shuffles and
stored tables.

Cases: a null or empty text has no n-grams and links with nothing. A text of
fewer words than n is one n-gram, the whole sequence. Rows with equal doc_id
count as documents of their own and both get a row. An empty table gives an
empty result. Hashes are 64 bits wide (40 bits and the fragment's where classes
are compared): two different n-grams of a pair coincide with a probability
below 1e-8. Very long texts are taken whole. Columns besides doc_id and text
aren't read; first_of_each() keeps them all. A null doc_id stays null; a component's id is its smallest doc_id that
isn't null, and null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 5
#: n-grams that a fragment aims at; there are at least FRAGMENTS fragments.
FRAGMENT_GRAMS = 2_000_000
FRAGMENTS = 64
#: Bits that are kept of a hash besides those that name its fragment.
LOW_BITS = 40
MEMORY_WORDS = 300_000
#: Characters of texts that are cut into n-grams at a time.
PART_CHARS = 2_000_000
#: Rows that a sample for common hashes has at most, and how often in them a hash must stand to count as common.
SAMPLE_DOCS, COMMON_SHARE, COMMON_LEAST = 20_000, 4e-4, 8
#: Common hashes that are dealt by class at most (8 bytes each are broadcast); the most frequent ones.
COMMON_GRAMS = 200_000
#: Rows of one key in a join beyond which they go to several tasks, and the number of such keys at most (broadcast).
HOT_ROWS, HOT_KEYS = 1_000, 50_000
#: Ratio of the lengths that one band spans.
BAND = 1.05
#: Rounds of label spreading after which connected() gives up; each round at least halves the longest path.
ROUNDS = 60

_MIX = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    new = set(words).difference(_words)
    if len(_words) + len(new) > MEMORY_WORDS:
        _words.clear()
        new = set(words)
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words."""
    words = common.space_words(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = _word_hashes(words)
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : len(w) - size + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _fragment_rows(bits: int, n: int, common_ids: np.ndarray, salts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and fragment one row: fragment, and packed documents, classes and hashes.

    A fragment's number has salt << bits added where it holds common hashes: 1 to salts, by class.
    """
    shift = np.uint64(64 - bits - LOW_BITS)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in common.parts([len(t or "") for t in texts], PART_CHARS):
            sets = [gram_set(t, n) for t in texts[a:b]]
            sizes = np.array([len(s) for s in sets], np.int64)
            classes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            docs = np.array([i if i is not None else 0 for i in ids[a:b]], np.int64)
            unnamed = np.array([i is None for i in ids[a:b]], np.uint8)
            # copies in this batch: the first stands for its class
            first = np.sort(np.unique(classes, return_index=True)[1])
            first = first[sizes[first] > 0]
            grams = np.concatenate([sets[i] for i in first]) if len(first) else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(first)), sizes[first])
            fragment = (grams >> np.uint64(64 - bits)).astype(np.int64)
            if len(common_ids):
                found = np.minimum(np.searchsorted(common_ids, grams >> shift), len(common_ids) - 1)
                salt = 1 + (classes[first] % np.uint64(salts)).astype(np.int64)
                fragment += np.where(common_ids[found] == grams >> shift, salt[owner] << bits, 0)
            order = np.argsort(fragment, kind="stable")
            grams, owner, fragment = grams[order], owner[order], fragment[order]
            low = (grams >> shift) & np.uint64((1 << LOW_BITS) - 1)
            # rows of documents may go anywhere: dealt evenly, whatever ids or classes repeat
            home = (((docs.view(np.uint64) + np.arange(len(docs), dtype=np.uint64)) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
            present = np.unique(np.concatenate([fragment, home]))
            cuts = np.append(np.searchsorted(fragment, present), len(fragment))
            blobs = []
            for k, f in enumerate(present.tolist()):
                mine, who = low[cuts[k] : cuts[k + 1]], owner[cuts[k] : cuts[k + 1]]
                new = np.flatnonzero(np.diff(who, prepend=-1))
                count = np.diff(np.append(new, len(who)))
                rows = first[who[new]]
                here = np.flatnonzero(home == f)
                head = np.array([len(here), len(rows), len(mine)], np.uint32)
                blobs.append(
                    b"".join(
                        x.tobytes()
                        for x in (head, docs[here], unnamed[here], classes[here], sizes[here].astype(np.uint32), classes[rows], sizes[rows].astype(np.uint32), count.astype(np.uint32), (mine >> np.uint64(8)).astype(np.uint32), mine.astype(np.uint8))
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(blobs, pa.binary())], names=["fragment", "packed"])
    _words.clear()  # the worker goes on to other stages


def _unpack(blob: bytes) -> list[np.ndarray]:
    n_docs, n_rows, n_grams = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    at, out = 12, []
    for kind, count in ((np.int64, n_docs), (np.uint8, n_docs), (np.uint64, n_docs), (np.uint32, n_docs), (np.uint64, n_rows), (np.uint32, n_rows), (np.uint32, n_rows), (np.uint32, n_grams), (np.uint8, n_grams)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    return out


_FOUND = "doc_id bigint, class bigint, n int, grams array<bigint>, df array<int>"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("grams", pa.list_(pa.int64())), ("df", pa.list_(pa.int32()))])


def _count_fragment(bits: int, table: pa.Table) -> pa.Table:
    """The documents at home in this fragment (grams null), and of each class the hashes that another class has too.

    Common hashes come with all classes of their salt and without frequencies (df null).
    """
    number = table.column("fragment")[0].as_py()
    fragment, salted = number & ((1 << bits) - 1), number >> bits > 0
    parts = [_unpack(b) for b in table.column("packed").to_pylist()]
    docs, unnamed, doc_class, doc_n, classes, sizes, counts, high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
    grams = (high.astype(np.int64) << 8) | low
    names, number = np.unique(classes, return_inverse=True)
    # batches know nothing of each other's copies: of each class the first run counts
    first = np.unique(number, return_index=True)[1]
    kept = np.zeros(len(classes), bool)
    kept[first] = True
    keep = np.repeat(kept, counts)
    grams, owner = grams[keep], np.repeat(number, counts)[keep]
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.flatnonzero(np.diff(grams, prepend=-1))
    times = np.diff(np.append(new, len(grams)))
    df = np.repeat(times, times)
    shared = (df > 1) | salted
    grams, owner, df = grams[shared] | (fragment << LOW_BITS), owner[shared], df[shared]
    back = np.argsort(owner, kind="stable")
    grams, owner, df = grams[back], owner[back], df[back]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    who = owner[start]
    offsets = pa.array(np.append(start, len(owner)).astype(np.int32))
    size_of = np.zeros(len(names), np.int32)
    size_of[number] = sizes
    segments = pa.Table.from_arrays([pa.nulls(len(who), pa.int64()), pa.array(names[who].view(np.int64)), pa.array(size_of[who]), pa.ListArray.from_arrays(offsets, pa.array(grams)), pa.nulls(len(who), pa.list_(pa.int32())) if salted else pa.ListArray.from_arrays(offsets, pa.array(df.astype(np.int32)))], schema=_FOUND_ARROW)
    own = pa.Table.from_arrays([pa.array(docs, mask=unnamed.astype(bool)), pa.array(doc_class.view(np.int64)), pa.array(doc_n.astype(np.int32)), pa.nulls(len(docs), pa.list_(pa.int64())), pa.nulls(len(docs), pa.list_(pa.int32()))], schema=_FOUND_ARROW)
    return pa.concat_tables([own, segments])


def _common_ids(docs: DataFrame, n: int, total: int, bits: int) -> np.ndarray:
    """Hashes (their upper bits) that are common in a sample of the rows, each text once; sorted."""
    sample = common.sample_below(docs, "doc_id", SAMPLE_DOCS, total).dropDuplicates(["text"])
    shift = np.uint64(64 - bits - LOW_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in common.parts([len(t or "") for t in texts], PART_CHARS):
                grams, times = np.unique(np.concatenate([gram_set(t, n) for t in texts[a:b]]) >> shift, return_counts=True)
                several = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[several].astype(np.int64)), pa.array(times[several])], names=["g", "times"])

    counts = sample.select("text").mapInArrow(count, "g bigint, times bigint").groupBy("g").agg(F.sum("times").alias("times"))
    least = max(COMMON_LEAST, int(COMMON_SHARE * min(total, SAMPLE_DOCS)))
    rows = counts.filter(F.col("times") >= least).orderBy(F.desc("times"), "g").limit(COMMON_GRAMS).collect()
    return np.sort(np.array([r["g"] for r in rows], np.uint64))


def sets(docs: DataFrame, n: int = N) -> DataFrame:
    """Rows of documents (doc_id, class, n) and of classes' shared hashes (class, n, grams, df), stored."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.only(docs, "doc_id", "text")
    total, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    bits = max(FRAGMENTS - 1, (chars or 0) // 6 // FRAGMENT_GRAMS).bit_length()
    common_ids, salts = _common_ids(docs, n, total, bits), 1 + total // FRAGMENT_GRAMS
    packed = docs.mapInArrow(lambda batches: _fragment_rows(bits, n, common_ids, salts, batches), "fragment bigint, packed binary")
    return common.stored(packed.groupBy("fragment").applyInArrow(lambda table: _count_fragment(bits, table), _FOUND), "gram-fragments")


def _with_frequencies(segments: DataFrame) -> DataFrame:
    """Segments of common hashes (df null) with the frequencies, counted over all classes; hashes of one class alone go."""
    counts = segments.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df")).toPandas().sort_values("g")
    ids, times = counts["g"].to_numpy(np.int64), counts["df"].to_numpy(np.int64)  # at most COMMON_GRAMS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            df = pa.ListArray.from_arrays(grams.offsets, pa.array(times[np.searchsorted(ids, grams.values.to_numpy())].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), grams, df], names=["class", "n", "grams", "df"])

    filled = segments.select("class", "n", "grams").mapInArrow(fill, "class bigint, n int, grams array<bigint>, df array<int>")
    keep = lambda what: F.expr(f"transform(filter(arrays_zip(grams, df), x -> x.df > 1), x -> x.{what})")
    return filled.select("class", "n", keep("grams").alias("grams"), keep("df").alias("df"))


def survivors(found: DataFrame) -> DataFrame:
    """class, n, and grams as structs (df, g) in global order, of the classes that share 3/4 of their set."""
    counted = found.filter("df is not null").select("class", "n", "grams", "df")
    segments = counted.unionByName(_with_frequencies(found.filter("grams is not null and df is null")))
    segments = segments.select("class", "n", F.arrays_zip(F.col("df"), F.col("grams").alias("g")).alias("grams"))
    classes = segments.groupBy("class").agg(F.first("n").alias("n"), F.sum(F.size("grams")).alias("k"), F.flatten(F.collect_list("grams")).alias("grams"))
    shared = classes.filter("4 * k >= 3 * n")
    return common.stored(shared.select("class", "n", F.sort_array("grams").alias("grams")), "gram-classes")


class Dealt:
    """Which keys of a stored table hold many rows, so that joins on them deal those rows over several tasks.

    There are at most HOT_KEYS such keys, whatever the table's size: a key needs that share of all rows, and HOT_ROWS.
    """

    def __init__(self, many: DataFrame, key: str):
        total = many.count()
        self.key, self.most, self.hot = key, max(HOT_ROWS, total // HOT_KEYS), {}
        if total > self.most:  # else no key can have more
            hot = many.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > self.most)
            self.hot = {r[key]: -(-r["_rows"] // self.most) for r in hot.collect()}
        if self.hot:
            # an Arrow table: a list would be read by Python workers of their own, which stay
            self.table = many.sparkSession.createDataFrame(pa.table({key: list(self.hot), "_parts": pa.array(self.hot.values(), pa.int64())}))

    def many(self, df: DataFrame) -> DataFrame:
        """Rows with a part each, by a hash of all their columns."""
        if not self.hot:
            return df.withColumn("_part", F.lit(0).cast("bigint"))
        parts = F.coalesce("_parts", F.lit(1))
        return df.join(F.broadcast(self.table), self.key, "left").withColumn("_part", F.pmod(F.xxhash64(*df.columns), parts)).drop("_parts")

    def few(self, df: DataFrame) -> DataFrame:
        """Rows repeated for each part of their key."""
        if not self.hot:
            return df.withColumn("_part", F.lit(0).cast("bigint"))
        parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)
        return df.join(F.broadcast(self.table), self.key, "left").withColumn("_part", F.explode(parts)).drop("_parts")

    def join(self, many: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
        return self.many(many).join(self.few(few), [self.key, "_part"], how).drop("_part")


def prefixes(classes: DataFrame) -> DataFrame:
    """g, class, n, pos (from 0 in the class's whole ordered set) and central, of each prefix's shared hashes."""
    # hashes of one class alone come first in the order, and are n - size(grams)
    own = F.col("n") - F.size("grams")
    length = F.col("n") - F.expr("(3 * n + 3) div 4") + 1 - own
    central = F.expr("aggregate(grams, 0D, (a, x) -> a + ln(x.df))") / F.col("n")
    cut = classes.select("class", "n", own.alias("own"), central.alias("central"), F.slice("grams", F.lit(1), length.cast("int")).alias("head"))
    return cut.select("class", "n", "own", "central", F.posexplode("head").alias("at", "x")).select(F.col("x.g").alias("g"), "class", "n", (F.col("own") + F.col("at")).alias("pos"), "central")


def overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of stored pairs (a, b): those that link. Partial overlaps per vertical fragment of the global order, summed per pair."""
    cut = classes.select("class", "n", "grams", F.explode(F.expr("array_distinct(transform(grams, x -> cast(log2(x.df) as int)))")).alias("fragment"))
    parts = cut.select("class", "n", "fragment", F.expr("transform(filter(grams, x -> cast(log2(x.df) as int) = fragment), x -> x.g)").alias("grams"))
    a = parts.select(F.col("class").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    b = parts.select(F.col("class").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    # a star's centre stands in many pairs, at either end
    with_a, at_b = Dealt(pairs, "a").join(pairs, a), Dealt(pairs, "b")
    met = at_b.many(with_a).join(at_b.few(b), ["b", "fragment", "_part"])
    partial = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("partial"))
    total = partial.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("partial").alias("overlap"))
    # overlap / (n_a + n_b - overlap) >= 3/4
    return total.filter("7 * overlap >= 3 * (n_a + n_b)").select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """v, root (the smallest of its component) for every end of links (a, b). Labels spread and jump until none changes."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v")
    edges = common.stored(both.distinct(), "links")
    ends = Dealt(edges, "u")
    edges = common.stored(ends.many(edges), "dealt-links")
    places = [common.shared_path(edges.sparkSession, "labels") for _ in range(2)]
    labels = common.stored(edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")), "labels", places[0])
    for k in range(ROUNDS):
        near = edges.join(ends.few(labels.withColumnRenamed("v", "u")), ["u", "_part"]).groupBy("v").agg(F.min("root").alias("near"))
        spread = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("next"))
        # roots hold few or many rows: those of the round before tell which
        after = Dealt(labels, "root").join(spread, jump, "left").select("v", "old", F.least(F.col("root"), F.coalesce("next", "root")).alias("root"))
        after = common.stored(after, "labels", places[(k + 1) % 2])
        labels = after.select("v", "root")
        if not after.filter("root <> old").limit(1).count():
            return labels
    raise RuntimeError("components didn't settle")


def _length_fits(a: str, b: str) -> str:
    return f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})"


def _band(n: str) -> str:
    return f"cast(floor(ln({n}) / ln({BAND}D)) as int)"


def cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different roots that have a hash g in common, by (g, class, n, pos, root).

    A pair is looked for under (g, band of the shorter, band of the longer). A class is there only where its position
    of g leaves enough hashes to link with the shortest set of the other band.
    """
    counts = rows.groupBy("g", "root").agg(F.count("*").alias("m"))
    major = counts.groupBy("g").agg(F.max(F.struct("m", "root")).alias("top")).select("g", F.col("top.root").alias("major"))
    marked = Dealt(rows, "g").join(rows, major).withColumn("is_major", F.col("root") == F.col("major")).drop("major")
    bands = marked.selectExpr("*", f"{_band('n')} as band", f"sequence({_band('3 * n / 4D')} - 1, {_band('4 * n / 3D')} + 1) as others")
    other = "greatest(floor(pow(%sD, x)), (3 * n + 3) div 4)" % BAND
    bands = bands.withColumn("others", F.expr(f"filter(others, x -> 7 * (n - pos) >= 3 * (n + {other}))"))
    dealt = common.stored(bands.select("g", "class", "n", "pos", "root", "is_major", "band", F.explode("others").alias("other")), "banded-prefixes")
    low = dealt.filter("band <= other").withColumnRenamed("band", "low").withColumnRenamed("other", "high")
    high = dealt.filter("band >= other").withColumnRenamed("band", "high").withColumnRenamed("other", "low")
    keys = ["g", "low", "high"]
    x = low.select(*keys, *(F.col(c).alias(f"{c}_x") for c in ("class", "n", "pos", "root", "is_major")))
    y = high.select(*keys, *(F.col(c).alias(f"{c}_y") for c in ("class", "n", "pos", "root", "is_major")))
    # at their first common hash, a pair has at most 1 + what follows it in either set
    fits = f"root_x <> root_y and (low < high or class_x < class_y) and {_length_fits('n_x', 'n_y')} and 7 * least(n_x - pos_x, n_y - pos_y) >= 3 * (n_x + n_y)"
    # the rows of the most frequent root meet the others only: the many side is dealt, the others are repeated
    hot = Dealt(dealt, "g")

    def meet(many: DataFrame, few: DataFrame) -> DataFrame:
        return hot.many(many).join(hot.few(few), [*keys, "_part"]).filter(fits).selectExpr("least(class_x, class_y) as a", "greatest(class_x, class_y) as b")

    return meet(y, x.filter("not is_major_x")).unionByName(meet(x.filter("is_major_x"), y.filter("not is_major_y"))).distinct()


def link_classes(classes: DataFrame) -> DataFrame:
    """class, root of all linked classes."""
    prefix = common.stored(prefixes(classes), "gram-prefixes")
    by_gram = Dealt(prefix, "g")
    lists = prefix.groupBy("g").agg(F.count("*").alias("m"), F.max(F.struct("central", "n", "class")).alias("c")).filter("m > 1")
    star = by_gram.join(prefix, lists).select(F.col("c.class").alias("a"), F.col("class").alias("b"), F.col("c.n").alias("n_a"), F.col("n").alias("n_b"))
    star = star.filter(f"a <> b and {_length_fits('n_a', 'n_b')}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = common.stored(star, "star-pairs")
    links = common.stored(overlaps(tried, classes), "star-links")
    roots = connected(links)

    # what is left: pairs of different components with a common hash in both prefixes
    # a very long text has very many prefix rows
    rows = Dealt(prefix, "class").join(prefix, roots.withColumnRenamed("v", "class"), "left").withColumn("root", F.coalesce("root", "class"))
    several = rows.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("g")
    rows = common.stored(by_gram.join(rows, several).select("g", "class", "n", "pos", "root"), "open-prefixes")
    pairs = cross_pairs(rows)
    more = overlaps(common.stored(pairs.join(tried, ["a", "b"], "left_anti"), "cross-pairs"), classes)
    more = common.stored(more, "cross-links")
    if not more.limit(1).count():
        return roots.withColumnRenamed("v", "class")
    # components of the star's components and the further links
    tree = roots.filter("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))
    return connected(tree.unionByName(more)).withColumnRenamed("v", "class")


def components(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, class_id (documents with equal sets), component_id (the smallest doc_id of those linked)."""
    found = sets(docs, n)
    rows = found.filter("grams is null").select("doc_id", "class", F.col("n").cast("bigint").alias("n_shingles"))
    roots = link_classes(survivors(found))
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    linked = common.stored(classes.join(roots, "class"), "linked-classes")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = Dealt(linked, "root").join(linked, least).select("class", "component_id")
    classes = classes.join(named, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id"))
    named = common.stored(classes, "named-classes")
    out = Dealt(rows, "class").join(rows, named, "left")
    return out.select("doc_id", "n_shingles", F.col("class").alias("class_id"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """One document of each component, with its own columns: that with the smallest doc_id, nulls last.

    Rows are told apart by a key of their own, not by doc_id, which may be null or repeated: of rows with equal doc_id
    that are linked one stays, and each that is linked with nothing stays. Texts without n-grams all stay.
    """
    key = "_row_key"
    own, restored = common.set_aside(docs, key)
    rows = common.stored(own.withColumn(key, F.monotonically_increasing_id()), "keyed-documents")
    groups = components(rows.select(F.col(key).alias("doc_id"), "text"), n).select(F.col("doc_id").alias(key), F.col("component_id").alias("_component"))
    ids = rows.select(key, F.col("doc_id").alias("_id")).join(groups, key)
    kept = ids.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col(key))).getField(key).alias(key)).select(key)
    return restored(rows.join(kept, key, "left_semi"))
