"""Pages to chunks: tables first, then clusters of text blocks, merged where small, packed with an overlap.

Rows are (page, block_id, x0, y0, x1, y1, width, height, text). Each step whose next decision depends on the one before
is a fold along sorted partitions: rows stream through it in batches and it keeps one open group or chunk, of bounded
size, in memory. Rows without any words are left out; a page without size has the least gap and no limit of area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings, text
from ..functions.stemming import let
from ..sources.tables import stored
from . import chunking

# Tokens that a chunk should have, height of a reading row, share of a page that a merged group may span.
LEAST_TOKENS, ROW_BAND, AREA_SHARE = 400, 36.0, 0.25


def folded(rows: DataFrame, keys: list[str], schema: str, new_state: Callable) -> DataFrame:
    """What a fold over each key's rows gives, which lie together, in order: keys (all named as in rows) and the columns of schema.

    new_state() makes two functions, each giving tuples of those columns: one for the next row, one for the key's end.
    """
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step, end = None, None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if end:
                        out += [(*current, *x) for x in end()]
                    current, (step, end) = key, new_state()
                out += [(*key, *x) for x in step(row)]
            yield pd.DataFrame(out, columns=names)
        if end:
            yield pd.DataFrame([(*current, *x) for x in end()], columns=names)

    named = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{named}, {schema}")


def _merging() -> Callable:
    """Whether a row's cluster begins a group: neighbouring clusters share one until it has 400 tokens.

    A group doesn't grow past a quarter of its page's area.
    """
    cluster, tokens, box = None, 0, None

    def begins(row) -> bool:
        nonlocal cluster, tokens, box
        if box is not None and row.cluster == cluster:
            return False
        own = (row.cx0, row.cy0, row.cx1, row.cy1)
        both = own if box is None else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
        wide = row.limit > 0 and (both[2] - both[0]) * (both[3] - both[1]) > row.limit
        new = box is None or tokens >= LEAST_TOKENS or wide
        if new:
            tokens, both = 0, own
        cluster, tokens, box = row.cluster, tokens + row.size, both
        return new

    return begins


def merged_clusters(blocks: DataFrame) -> DataFrame:
    """blocks with tokens, cluster and, of its cluster, size, sides, page's limit and place: (row band, x0) of its first block.

    Blocks are grouped by their places on every page, however many it has. Rows lie together by page, in the order in which block_chunks() folds them.
    """
    each = chunking.clusters(blocks, "page", box_id="block_id", whole=True).withColumn("tokens", text.estimated_tokens(F.col("text")))
    w = Window.partitionBy("page", "cluster")
    corners = {f"c{c}": f(c).over(w) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))}
    limit = F.coalesce(F.first(F.col("width") * F.col("height") * AREA_SHARE).over(w), F.lit(0.0))
    sums = each.repartition("page").withColumns({"first": F.min(F.struct("y0", "x0")).over(w), "size": F.sum("tokens").over(w), "limit": limit, **corners})
    placed = sums.withColumn("band", F.floor(F.col("first.y0") / ROW_BAND)).withColumn("left", F.col("first.x0")).drop("first", "width", "height")
    return placed.sortWithinPartitions("page", "band", "left", "cluster", "y0", "x0", "block_id")


def _closing() -> tuple[Callable, Callable]:
    """Closes a chunk before a block that would take it past its size or begins a group, and cuts blocks that are past it by themselves."""
    begins, open_ = _merging(), []

    def made() -> list[tuple]:
        if not open_:
            return []
        corners = (min(b.x0 for b in open_), min(b.y0 for b in open_), max(b.x1 for b in open_), max(b.y1 for b in open_))
        return [("\n".join(b.text.strip() for b in open_), *corners)]

    def tail() -> list:
        """What the next chunk repeats: the last blocks, about 100 tokens, never the whole chunk."""
        total, k = 0, len(open_)
        while k and total < text.OVERLAP_TOKENS and (not total or total + open_[k - 1].tokens <= text.OVERLAP_TOKENS):
            k -= 1
            total += open_[k].tokens
        return open_[k:] if k else []

    def step(row) -> list[tuple]:
        nonlocal open_
        out = []
        if begins(row):
            out, open_ = made(), []
        if row.tokens > text.MAX_TOKENS:
            words, size, out = row.text.split(), chunking.WINDOW_WORDS, out + made()
            starts = range(0, max(1, len(words) - size + chunking.STEP_WORDS), chunking.STEP_WORDS)
            open_ = []
            return out + [(" ".join(words[at : at + size]), row.x0, row.y0, row.x1, row.y1) for at in starts]
        size = sum(b.tokens for b in open_)
        if size >= LEAST_TOKENS and size + row.tokens > text.MAX_TOKENS:
            out, open_ = out + made(), tail()
        open_.append(row)
        return out

    return step, made


def _boxed(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [F.floor(y0 / ROW_BAND).alias("band"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")]


def block_chunks(grouped: DataFrame) -> DataFrame:
    """page, text, tokens and box of the chunks of merged_clusters(): closed between 400 and 800 tokens.

    A chunk repeats the end of the one before in its group. A block beyond 800 tokens is cut into word windows of its own.
    Clusters and their blocks are folded in one order, so groups and chunks take one pass.
    """
    sides = ["x0", "y0", "x1", "y1"]
    made = folded(grouped, ["page"], "text string, x0 double, y0 double, x1 double, y1 double", _closing)
    return made.select("page", "text", text.estimated_tokens(F.col("text")).alias("tokens"), *_boxed(*map(F.col, sides)))


def _pieces(rows: Column) -> Column:
    """array<struct<piece, text>> of a table's clean rows: cut at 800 tokens, its header over each piece."""
    header, lines = F.element_at(rows, 1), F.slice(rows, 2, F.size(rows) - 1)
    above = text.estimated_tokens(text.table_markdown(F.array(header), clean=True))
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))

    def starts(above: Column) -> Column:
        def step(s: Column, n: Column) -> Column:
            new = (s["at"] == 0) | (s["size"] + n > text.MAX_TOKENS)
            return F.struct((s["at"] + 1).alias("at"), (F.when(new, above).otherwise(s["size"]) + n).alias("size"), F.when(new, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"))

        return F.aggregate(F.transform(lines, lambda r: text.estimated_tokens(F.array_join(r, " "))), first, step, lambda s: s["starts"])

    def piece(starts: Column, at: Column, k: Column) -> Column:
        body = F.slice(rows, at + 2, F.coalesce(F.get(starts, k + 1), F.size(rows) - 1) - at)
        return F.struct(k.alias("piece"), text.table_markdown(F.concat(F.array(header), body), clean=True).alias("text"))

    return let(let(above, starts), lambda starts: F.transform(starts, lambda at, k: piece(starts, at, k)))


def _table_pieces(tables: DataFrame) -> DataFrame:
    """page, table_id, sides, piece and text of tables (page, table_id, x0, y0, x1, y1, rows), all worked out in the table's row."""
    cut = lambda rows: F.when(headings.is_table_like(rows) & (F.size(rows) > 1), _pieces(rows))
    sides = ["page", "table_id", "x0", "y0", "x1", "y1"]
    return tables.select(*sides, F.explode(let(headings.normal_rows(F.col("rows")), cut)).alias("p")).select(*sides, "p.piece", "p.text")


def _placed(pieces: DataFrame) -> DataFrame:
    return pieces.select("page", "table_id", "piece", "text", text.estimated_tokens(F.col("text")).alias("tokens"), *_boxed(*map(F.col, ("x0", "y0", "x1", "y1"))))


def table_chunks(tables: DataFrame) -> DataFrame:
    """page, table_id, piece, text, tokens and box of tables (page, table_id, x0, y0, x1, y1, rows).

    A table's rows are cut at 800 tokens, its header stands over each piece, and each piece has the whole table's box.
    What isn't like a table, or is a header alone, gives nothing.
    """
    return _placed(_table_pieces(tables))


def page_chunks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """All chunks of pages (page, kind, text, tokens, band, x, y, w, h); (band, x) is their reading order.

    Blocks that tables with chunks cover by half or more, or that have no area on a page with such a table, are left to those.
    """
    pieces, sides = stored(_table_pieces(tables), "table-pieces"), ("x0", "y0", "x1", "y1")
    made = _placed(pieces)
    kept = pieces.filter("piece = 0").select(F.col("page").alias("_page"), *[F.col(c).alias(f"_{c}") for c in sides])
    share = headings.covered_share({c: F.col(c) for c in sides}, {c: F.col(f"_{c}") for c in sides})
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    worded = blocks.withColumn("text", text.without_controls(F.col("text"))).filter(F.size(text.words(F.col("text"))) > 0)
    free = worded.join(kept, (F.col("page") == F.col("_page")) & (flat | (share >= 0.5)), "left_anti")
    words = block_chunks(merged_clusters(free))
    columns = ("text", "tokens", "band", "x", "y", "w", "h")
    return made.select("page", F.lit("table").alias("kind"), *columns).unionByName(words.select("page", F.lit("text").alias("kind"), *columns))
