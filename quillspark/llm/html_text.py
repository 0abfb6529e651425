"""Main text of web pages as a maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. A tag costs its weight: labelled pages,
those of a bounded sample that mark their article, tell how much more often each
tag stands outside the article than in it (a tag that they lack costs the least).
A word scores 1 or a little below 0, by the weight of its region: the element with
a boilerplate name or kind that it is in (navigation, adverts, notices, forms,
comments), or else whether the page's mark (article, main) holds it. Regions get
their weights from the same labelled pages, as the odds of their words to be in the
article; only regions that these pages lack go by the lists below. One linear scan
finds the contiguous run of tokens with the largest sum. What stands at the run's
ends is text; words of negative regions between its positive ones are left out,
and cost so little that none of them cuts a text in two.

Where a page marks its text, words outside of the mark are a region as others are,
and the tags cost less than one word together: a mark says more than any tag, and
no words in it are lost.

A form or an element with a boilerplate name may wrap the whole page. An article
or main element in it that isn't boilerplate itself ends that mark, unless it is
a teaser: fewer than a TEASER-th of the words of the page's longest text (its
unwrapped article, or else its unwrapped words, or another wrapped article).
Wrapped articles mark the page as unwrapped ones do, if there are none of these
and less words without a wrapper. Other boilerplate (nav, aside, footer, hidden
elements) stays so whatever is in it. A class or id is a boilerplate name if one
of its words is, and all others only say what or where it is ("site-footer",
"ad-slot-2", but not "has-sidebar" or "search-results").

Cases: null or empty html, and pages without words, give an empty text. Of runs
with equal sums the first counts, and of these the longest. Rows that repeat
are extracted each alone. Unclosed elements end with their parent, a closing tag
without its opening one ends nothing; an unclosed comment, script, style or tag
ends with the page. Very long pages take time and memory in proportion to their
length, however deep. Columns text and n_chars of the pages are replaced, further
ones stay. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pages that the weights are learned from at most (chosen by a hash of page_id).
TRAIN_PAGES = 5_000
LEAST, MOST = 0.05, 8.0
#: An article in a wrapper with fewer words than the page's longest text divided by this is a teaser.
TEASER = 4

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo br cite code em font i img kbd mark q s small span strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select textarea input label fieldset menu dialog title math audio video".split()
)
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that only say what or where an element with a boilerplate name is.
PLACE_NAMES = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content desktop field first fixed floating form global group header holder icon icons inline inner item items js label last left link links list lists main message mobile module next outer page pane panel post posts prev previous primary right row secondary section side site slot small sticky strip tab text title top trail unit ui view wrap wrapper zone".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
#: Regions besides those of elements: in a page's mark, outside of it, of a page without one, and of a teaser.
MARKED, UNMARKED, PLAIN, TEASING = "marked", "unmarked", "plain", "teaser"
#: What stands before a region's name among the weights.
REGION = "@"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^'\">]|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kinds text, open and close, in page order."""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            yield "text", page[at:end], ""
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or m[6] or ""
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else size
            if stop > at:
                yield "text", page[at:stop], ""
            at = stop


def _is_boilerplate_name(name: str) -> bool:
    """Whether one class or id names boilerplate."""
    if name.lower() in DROPPED_NAMES:
        return True
    words = [w.lower() for w in _NAME_WORD.findall(name) if len(w) > 1]
    return not DROPPED_NAMES.isdisjoint(words) and all(w in DROPPED_NAMES or w in PLACE_NAMES for w in words)


def _dropped(name: str, raw: str, in_main: bool) -> tuple[str, str]:
    """Whether an element holds boilerplate: "hard" for good, "soft" if it may be a wrapper of an article, "" if not; and its region."""
    if name in DROPPED and name != "form" or name == "header" and not in_main:
        return "hard", name
    kind, region = ("soft", name) if name == "form" else ("", "")
    if not raw or name in MAIN and "comment" not in raw.lower() or name in ("html", "body"):
        return kind, region
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            named = next(filter(_is_boilerplate_name, value.split()), None)
            if named is not None:
                kind, region = "soft", f".{named.lower()}"
            continue
        value = value.lower()
        if key == "role" and value in DROPPED_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return "hard", f"[{key}={value}]"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hard", "[hidden=]"
    return kind, region


class Walk:
    """The tokens of a page with what stands around them: (kind, text or tag, dropped, in main, block number, region)."""

    def __init__(self, page: str):
        self.items: list[tuple[str, str, bool, bool, int, str]] = []
        self.marked = False
        wrapped: list[int] = []  # per item the number of the article that ends a wrapper's mark, or 0
        words, plain, clean, articles = Counter(), 0, 0, 0
        stack: list[tuple[str, str, bool, int, str]] = []
        open_ = Counter()  # of each tag in the stack
        block = 0

        def add(kind: str, value: str, dropped: str, in_main: bool, article: int, region: str) -> None:
            nonlocal plain, clean
            self.items.append((kind, value, bool(dropped), in_main, block, region))
            wrapped.append(article)
            if kind == "text" and not dropped:
                n = len(value.split())
                words[article] += n if article else 0
                plain += 0 if article or in_main else n
                clean += n if in_main and not article else 0

        for kind, value, raw in tokens(page):
            dropped, in_main, article, region = stack[-1][1:] if stack else ("", False, 0, "")
            if kind == "text":
                add("text", value, dropped, in_main, article, region)
                continue
            if value in BLOCK:
                block += 1
            if kind == "open":
                own, named = _dropped(value, raw, in_main)
                inner, main, within = "hard" if "hard" in (dropped, own) else dropped or own, in_main, article
                named = named or region
                if value in MAIN and not own and dropped == "soft":
                    articles += 1
                    inner, main, within, named = "", True, articles, ""
                elif value in MAIN and not inner:
                    main = True
                self.marked |= main and not within
                add("tag", value, inner, main, within, named)
                if value not in VOID and not raw.rstrip().endswith("/"):
                    stack.append((value, inner, main, within, named))
                    open_[value] += 1
            else:
                add("tag", value, dropped, in_main, article, region)
                while open_[value]:
                    closed = stack.pop()[0]
                    open_[closed] -= 1
                    if closed == value:
                        break
            if value == "br":
                add("text", " ", dropped, in_main, article, region)
        if articles:
            longest = max(clean if self.marked else plain, *words.values(), 0)
            kept = {a for a, n in words.items() if a and n and TEASER * n >= longest}
            main = self.marked or sum(words[a] for a in kept) > plain
            self.items = [(k, v, d or a > 0 and a not in kept, m and (not a or main and a in kept), b, r or TEASING * (a > 0 and a not in kept)) for (k, v, d, m, b, r), a in zip(self.items, wrapped, strict=True)]
            self.marked |= main and bool(kept)

    def region(self, item: tuple) -> str:
        """The region that a token is in: an element with a boilerplate name or kind, or by the page's mark."""
        _, _, dropped, in_main, _, region = item
        return region if dropped else (MARKED if in_main else UNMARKED) if self.marked else PLAIN


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Cost of each tag from its numbers inside and outside of marked articles."""
    inside, outside = (sum(c[k] for c in counts.values()) + 1 for k in (0, 1))
    return {tag: min(MOST, max(LEAST, 1 + math.log((c[1] + 1) / outside) - math.log((c[0] + 1) / inside))) for tag, c in counts.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the largest positive sum: the first of equal ones, as long as it can be."""
    best = low = total = 0.0
    best_range, start = (0, 0), 0
    for i, score in enumerate(scores):
        total += score
        if total < low:
            low, start = total, i + 1
        if total - low > best or total - low == best and best_range[0] == start and best > 0:
            best, best_range = total - low, (start, i + 1)
    return best_range


def weigh_regions(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weight of each region from the words of it inside and outside of marked articles."""
    return {REGION + region: max(-MOST, min(MOST, math.log((a + 0.5) / (b + 0.5)))) for region, (a, b) in counts.items()}


def _is_text(walk: Walk, item: tuple, weights: dict[str, float]) -> bool:
    """Whether a token's region holds text: by its learned weight, or else by its name."""
    region = walk.region(item)
    return weights.get(REGION + region, -1.0 if item[2] or region == UNMARKED else 1.0) > 0


def _scores(items: list[tuple], text: list[bool], weights: dict[str, float], marked: bool) -> list[float]:
    """Words of text count 1; all others together, and in a marked page the tags of text too, less than one word."""
    words = [len(item[1].split()) if item[0] == "text" else 0 for item in items]
    costs = [weights.get(item[1], LEAST) if item[0] == "tag" and t else 0.0 for item, t in zip(items, text, strict=True)]
    little = 0.5 / (1 + sum(n for n, t in zip(words, text, strict=True) if not t))
    scale = 0.5 / (1 + sum(costs)) if marked else 1.0
    return [float(n) if t else -little * n for n, t in zip(words, text, strict=True)] if not any(costs) else [(n if t else -little * n) - scale * c for n, t, c in zip(words, text, costs, strict=True)]


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    walk = Walk(page)
    text = [_is_text(walk, item, weights) for item in walk.items]
    begin, end = best_run(_scores(walk.items, text, weights, walk.marked))
    run = [i for i in range(begin, end) if walk.items[i][0] == "text"]
    # between words of text others are left out; what the run begins and ends with is its own
    sure = [i for i in run if text[i]]
    first, last = (sure[0], sure[-1]) if sure else (end, end)
    blocks: dict[int, list[str]] = {}
    for i in run:
        if text[i] or not first < i < last:
            blocks.setdefault(walk.items[i][4], []).append(walk.items[i][1])
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def train(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights of tags and regions from the labelled pages of a bounded sample: those that mark an article.

    Of what stands in an article under a boilerplate name nothing is known: it doesn't count.
    """
    pages = common.only(pages, "page_id", "html").filter("html is not null")
    chosen = common.sample_below(pages, "page_id", max_pages, pages.select("page_id").count()).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                walk = Walk(page)
                if walk.marked:
                    sums.update((v, m) for k, v, d, m, _, _ in walk.items if k == "tag" and not d and (v in BLOCK or v in INLINE))
                    for item in walk.items:
                        if item[0] == "text" and not (item[2] and item[3]) and (n := len(item[1].split())):
                            sums[REGION + walk.region(item), item[3]] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in sums]), pa.array([m for _, m in sums]), pa.array(list(sums.values()), pa.int64())], names=["tag", "inside", "n"])

    rows = chosen.mapInArrow(count, "tag string, inside boolean, n bigint").groupBy("tag").agg(F.sum(F.expr("if(inside, n, 0)")).alias("a"), F.sum(F.expr("if(inside, 0, n)")).alias("b")).collect()
    counts = {r["tag"]: (r["a"], r["b"]) for r in rows}
    tags = weigh({t: n for t, n in counts.items() if not t.startswith(REGION)})
    return tags | weigh_regions({t.removeprefix(REGION): n for t, n in counts.items() if t.startswith(REGION)})


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """pages with text and n_chars (code points)."""
    common.small_batches(pages.sparkSession)
    weights = train(pages) if weights is None else weights
    pages = pages.drop("text", "n_chars")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(p, weights) for p in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    schema = pages.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")}).schema
    return pages.mapInArrow(common.per_batch(work), schema)
