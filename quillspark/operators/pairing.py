"""Which sheets are compared: pairs of plans with a reason for each sheet left out, their tiles, and sheets to suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headings
from ..functions.stemming import let
from ..sources.tables import stored

# What governs geometry, tolerance of scales, least enlargements, overlap of tiles, least share of a tile.
GOVERNING = ("architectural", "structural", "interiors")
SCALE_SHARE, ENLARGED, OWN_ENLARGED, OVERLAP, SLIVER = 0.02, 1.5, 2.0, 0.12, 0.25
PLANS = ("plan", "enlarged_plan")
# Why a plan is left out.
NO_LEVEL = "plan whose drawing title names no single level"
NO_SCALE = "plan with no printed drawing scale"
VIEWS = "sheet with several views (a grid label in two places)"
NO_DISCIPLINE = "plan whose sheet number gave no discipline (mark the title-block region so sheet numbers are read)"
ALONE = "plan with no plan of another discipline on the same level"
NOT_GOVERNED = "plan whose level has no architectural or structural plan to compare against (two consultants' plans share only the background each copied)"
OTHER_SCALE = "plan with no printed scale in common with the other discipline's plan of its level"
# What the words of a "compare across" entry ask for, in order.
DISCIPLINES = (
    (r"(?i)\barch", ("architectural",)), (r"(?i)\bstruct", ("structural",)), (r"(?i)\bcivil", ("civil",)), (r"(?i)\bmep\b", ("mechanical", "hvac", "plumbing", "electrical")), (r"(?i)\bplumbing", ("plumbing",)),
    (r"(?i)\belectrical", ("electrical",)), (r"(?i)\b(?:mechanical|hvac)", ("mechanical", "hvac")), (r"(?i)\blandscape", ("landscape",)), (r"(?i)\bfire protection", ("fire_protection",)), (r"(?i)\blife safety", ("architectural", "general")),
)
KINDS = (
    (r"(?i)\b(?:plans?|rcp|layout|partitions)\b", ("plan", "enlarged_plan")), (r"(?i)\bschedules?\b", ("schedule",)), (r"(?i)\bsections?\b", ("section",)), (r"(?i)\belevations?\b", ("elevation",)), (r"(?i)\bdetails?\b", ("detail",)), (r"(?i)\bnotes\b", ("notes",)),
)
# Words that say no subject in an entry and in a title, and plans that show no geometry to coordinate.
NOT_A_SUBJECT = "struct structural arch architectural civil mep plumbing electrical mechanical hvac landscape fire protection life safety plan plans schedule schedules section sections elevation elevations detail details notes rcp layout partitions and the with drilled".split()
TITLE_NOISE = "STRUCT STRUCTURAL ARCH ARCHITECTURAL CIVIL MEP MECH MECHANICAL ELEC ELECTRICAL PLUMB PLUMBING FP FIRE GEOTECH PLAN PLANS SCHEDULE SCHEDULES SECTION SECTIONS DETAIL DETAILS ELEVATION ELEVATIONS SHEET SHEETS DRAWING DRAWINGS AND OR OF THE ON IN TO FOR WITH AT BY ALL TYPICAL GENERAL".split()
NOT_COORDINATION = r"\b(?:LIFE\s+SAFETY|EGRESS|CODE|REFLECTED\s+CEILING|RCP|FINISH(?:ES)?|FURNITURE|FURNISHINGS?|SIGNAGE|ACCESSIBILITY|DEMOLITION|KEY\s+PLAN)\b"
#: Rounds of choosing after which what is chosen so far is stored.
ROUNDS = 8

SHEET = ["project", "page_id"]


# pairs ---------------------------------------------------------------------------------------------------------------


def _scale_cells(scales: str) -> Column:
    """Cells of a sheet's scales such that scales within tolerance lie in one cell or in neighbouring ones."""
    return F.array_distinct(F.transform(scales, lambda s: F.floor(F.ln(s) / F.lit(0.0203)).cast("bigint")))


def sheet_pairs(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of plans to line up (project, kind, a, b, level, ratio), and the plans left out (project, page_id, reason).

    sheets: project, page_id, label, level, discipline, kind, scales, views. Two overall plans of a level pair if their
    disciplines differ, one governs geometry and they print a common scale: governing sheets meet the others by level
    and cell of their scales. An enlarged plan pairs with each overall plan of its level that it enlarges; an overall
    plan too, with one of its own discipline at half its scale or less.
    """
    plan = F.col("kind").isin(*PLANS)
    why = F.when(F.col("level").isNull() | (F.col("level") == ""), NO_LEVEL).when(F.coalesce(F.size("scales"), F.lit(0)) < 1, NO_SCALE).when(F.coalesce("views", F.lit(False)), VIEWS)
    judged = sheets.filter(plan).withColumn("reason", why)
    open_ = judged.filter("reason is null").drop("reason")
    governs = F.coalesce(F.col("discipline").isin(*GOVERNING), F.lit(False))
    side = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in ("page_id", "label", "discipline", "kind", "scales", "views")})

    overall = open_.filter("kind = 'plan' and discipline is not null and discipline <> ''")
    left = side(overall.filter(governs).withColumn("cell", F.explode(_scale_cells("scales"))), "a")
    right = side(overall.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(_scale_cells("scales"), lambda c: F.array(c - 1, c, c + 1)))))), "b")
    met = left.join(right, ["project", "level", "cell"]).filter("discipline_a <> discipline_b")
    common = F.exists("scales_a", lambda x: F.exists("scales_b", lambda y: F.abs(x - y) <= SCALE_SHARE * F.greatest(x, y)))
    ordered = F.struct("discipline_a", "label_a", "page_id_a") < F.struct("discipline_b", "label_b", "page_id_b")
    a, b = F.when(ordered, F.col("page_id_a")).otherwise(F.col("page_id_b")), F.when(ordered, F.col("page_id_b")).otherwise(F.col("page_id_a"))
    same_level = met.filter(common).select("project", F.lit("same_level").alias("kind"), a.alias("a"), b.alias("b"), "level", F.lit(None).cast("double").alias("ratio")).distinct()

    smallest = open_.withColumn("smallest", F.array_min("scales")).withColumn("governs", governs)
    large = smallest.select("project", "level", F.col("page_id").alias("a"), F.col("discipline").alias("da"), F.col("kind").alias("ka"), F.col("smallest").alias("sa"), F.col("governs").alias("ga"))
    small = smallest.filter("kind = 'plan'").select("project", "level", F.col("page_id").alias("b"), F.col("discipline").alias("db"), F.col("smallest").alias("sb"), F.col("governs").alias("gb"))
    ratio, own = F.col("sa") / F.col("sb"), F.col("da").eqNullSafe(F.col("db"))
    fits = (F.col("a") != F.col("b")) & (ratio >= ENLARGED) & F.when(F.col("ka") == "plan", (ratio >= OWN_ENLARGED) & own).otherwise(own | F.col("ga") | F.col("gb"))
    enlarged = large.join(small, ["project", "level"]).filter(fits).select("project", F.lit("enlarged").alias("kind"), "a", "b", "level", ratio.alias("ratio"))
    pairs = same_level.unionByName(enlarged)

    paired = pairs.select("project", F.explode(F.array("a", "b")).alias("page_id")).distinct()
    # the disciplines of a level are few, however many sheets it has
    there = open_.filter("discipline is not null and discipline <> ''").groupBy("project", "level").agg(F.collect_set("discipline").alias("all"))
    others = F.filter(F.coalesce("all", F.array().cast("array<string>")), lambda d: d != F.col("discipline"))
    unpaired = (
        F.when(F.coalesce("discipline", F.lit("")) == "", NO_DISCIPLINE)
        .when(F.size(others) == 0, ALONE)
        .when(~governs & ~F.arrays_overlap(others, F.array(*map(F.lit, GOVERNING))), NOT_GOVERNED)
        .otherwise(OTHER_SCALE)
    )
    alone = open_.join(paired, SHEET, "left_anti").join(there, ["project", "level"], "left").select(*SHEET, unpaired.alias("reason"))
    return pairs, judged.filter("reason is not null").select(*SHEET, "reason").unionByName(alone)


# tiles ---------------------------------------------------------------------------------------------------------------


def _rect(*edges: Column) -> Column:
    return F.struct(*[e.alias(n) for e, n in zip(edges, ("x0", "y0", "x1", "y1"), strict=True)])


def _meet(r: Column, s: Column) -> Column:
    """What two areas share; null if that is no more than a point wide or high."""
    shared = _rect(F.greatest(r["x0"], s["x0"]), F.greatest(r["y0"], s["y0"]), F.least(r["x1"], s["x1"]), F.least(r["y1"], s["y1"]))
    return let(shared, lambda x: F.when((x["x1"] - x["x0"] > 1) & (x["y1"] - x["y0"] > 1), x))


def split(area: Column, size: float) -> Column:
    """An area cut into tiles no larger than size, evenly spaced, that overlap by OVERLAP and cover it."""
    w, h = area["x1"] - area["x0"], area["y1"] - area["y0"]
    count = lambda extent: F.greatest(F.lit(1), F.ceil(extent / (size * (1 - OVERLAP)))).cast("int")
    width, height = F.least(F.lit(size), w), F.least(F.lit(size), h)

    def tile(k: Column, nx: Column, ny: Column) -> Column:
        at = lambda i, n, low, extent, own: low + (extent - own) * F.when(n > 1, i / (n - 1)).otherwise(0.0)
        left, top = at(k % nx, nx, area["x0"], w, width), at(F.floor(k / nx), ny, area["y0"], h, height)
        return _rect(left, top, left + width, top + height)

    return let(F.struct(count(w).alias("nx"), count(h).alias("ny")), lambda n: F.transform(F.sequence(F.lit(0), n["nx"] * n["ny"] - 1), lambda k: tile(k, n["nx"], n["ny"])))


def tiles(area: Column, scale: Column, tx: Column, ty: Column, b_width: Column, b_height: Column, size: float) -> Column:
    """array<struct<a, b>>: tiles of an area of A beside the same areas of B (b = scale * a + t), cut together at B's edges.

    A tile of which less than SLIVER of the size is left shows nothing whole and goes.
    """
    to_b = lambda r: _rect(r["x0"] * scale + tx, r["y0"] * scale + ty, r["x1"] * scale + tx, r["y1"] * scale + ty)
    to_a = lambda r: _rect((r["x0"] - tx) / scale, (r["y0"] - ty) / scale, (r["x1"] - tx) / scale, (r["y1"] - ty) / scale)
    page = _rect(F.lit(0.0), F.lit(0.0), b_width, b_height)

    def both(wa: Column) -> Column:
        return let(_meet(to_b(wa), page), lambda wb: let(F.when(wb.isNotNull(), _meet(to_a(wb), wa)), lambda a: F.when((a["x1"] - a["x0"] >= SLIVER * size) & (a["y1"] - a["y0"] >= SLIVER * size), F.struct(a.alias("a"), wb.alias("b")))))

    return F.array_compact(F.transform(split(area, size), both))


def shared_tiles(a: Column, b: Column, tx: Column, ty: Column, b_width: Column, b_height: Column, size: float) -> Column:
    """Tiles of what two sheets of one scale both draw: a and b are their drawn areas, B = A + (tx, ty). Null if they share none."""
    shared = _meet(a, _rect(b["x0"] - tx, b["y0"] - ty, b["x1"] - tx, b["y1"] - ty))
    return let(shared, lambda area: F.when(area.isNotNull(), tiles(area, F.lit(1.0), tx, ty, b_width, b_height, size)))


# suggestions ---------------------------------------------------------------------------------------------------------


def _asked(entry: Column, table: tuple) -> Column:
    return F.flatten(F.array(*[F.when(entry.rlike(p), F.array(*map(F.lit, found))).otherwise(F.array().cast("array<string>")) for p, found in table]))


def needs(entries: Column) -> Column:
    """struct<needs: array<struct<entry, disciplines, kinds>>, outside: array<string>> of an element's entries.

    An entry that names a kind of sheet alone belongs to the disciplines before it; one that names neither is a
    document that is no drawing.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<entry:string,disciplines:array<string>,kinds:array<string>>>").alias("needs"), nothing.alias("outside"), nothing.alias("last"))

    def step(state: Column, entry: Column) -> Column:
        return let(F.struct(F.array_distinct(_asked(entry, DISCIPLINES)).alias("d"), _asked(entry, KINDS).alias("k")), lambda x: take(state, entry, F.when(F.size(x["d"]) > 0, x["d"]).when(F.size(x["k"]) > 0, state["last"]).otherwise(nothing), x["k"]))

    def take(state: Column, entry: Column, disciplines: Column, kinds: Column) -> Column:
        need = F.struct(entry.alias("entry"), disciplines.alias("disciplines"), kinds.alias("kinds"))
        outside = F.struct(state["needs"].alias("needs"), F.array_append(state["outside"], entry).alias("outside"), state["last"].alias("last"))
        return F.when(F.size(disciplines) == 0, outside).otherwise(F.struct(F.array_append(state["needs"], need).alias("needs"), state["outside"].alias("outside"), disciplines.alias("last")))

    return F.aggregate(entries, start, step, lambda s: s.dropFields("last"))


def _subject(text: Column) -> Column:
    """What a schedule is of: upper-case stems of the words of three letters or more that name no discipline or kind."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(*NOT_A_SUBJECT))
    return F.transform(words, lambda w: F.upper(headings.stem(w)))


def _title_words(*texts: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(F.upper(F.coalesce(t, F.lit(""))), F.lit("[A-Z]{3,}"), 0) for t in texts]))
    return F.filter(F.array_distinct(F.transform(found, headings.stem)), lambda w: ~w.isin(*TITLE_NOISE))


def suggested(elements: DataFrame, sheets: DataFrame) -> DataFrame:
    """element_id, sheets, missing, outside: for each entry that an element compares across the best sheet not taken yet.

    elements: project, element_id, entries, name, stage. sheets: project, sheet, page, discipline, kind, level, title,
    headings. A sheet whose schedule headings name the subject comes first, then the kinds asked for in their order, the
    words of its title, plans that show geometry, the level of the first sheet taken (then any level), and page order.
    The first pick's level holds for all later ones, so entries are taken in turn, one round for all elements at a time:
    a round joins sheets by project and discipline and keeps the smallest rank, which every task does for itself first.
    """
    read = elements.withColumn("n", needs(F.col("entries"))).select("project", "element_id", "name", "stage", "n.needs", "n.outside")
    rounds = read.agg(F.max(F.size("needs"))).first()[0] or 0
    none = F.array().cast("array<string>")
    state = read.select("element_id", none.alias("sheets"), none.alias("missing"), F.lit(None).cast("string").alias("picked_level"))
    for k in range(rounds):
        turn = read.filter(F.size("needs") > k).select("project", "element_id", "name", "stage", F.get("needs", F.lit(k)).alias("need")).join(state, "element_id")
        own = _subject(F.col("need.entry"))
        schedule = F.array_contains("need.kinds", "schedule")
        turn = turn.withColumn("words", F.when(schedule, F.when(F.size(own) > 0, own).otherwise(_subject(F.coalesce("name", F.lit(""))))).otherwise(none)).withColumn("every", F.size(own) > 0)
        turn = turn.withColumn("title_words", _title_words(F.col("need.entry"), F.col("name"), F.col("stage"))).withColumn("prefer", F.when(F.size("need.kinds") > 0, F.col("need.kinds")).otherwise(F.array(*map(F.lit, PLANS))))
        met = turn.withColumn("discipline", F.explode("need.disciplines")).join(sheets, ["project", "discipline"])
        named = headings.heading_score(F.col("headings"), F.col("words"), F.col("every"))
        at = F.array_position("prefer", F.col("kind"))
        kind_rank = F.when(at > 0, at - 1).when(F.col("kind").isNull(), F.size("prefer")).when(F.size("need.kinds") > 0, -1).otherwise(F.size("prefer") + 1)
        level_rank = F.when(F.col("picked_level").isNotNull() & (F.col("picked_level") != "") & F.col("level").eqNullSafe(F.col("picked_level")), 0).when(F.coalesce("level", F.lit("")) != "", 1).otherwise(2)
        title = F.upper(F.coalesce("title", F.lit("")))
        ranked = met.withColumn("named", named).withColumn("kind_rank", kind_rank)
        fits = ((F.col("kind_rank") >= 0) | (F.col("named") > 0)) & ~F.array_contains("sheets", F.col("sheet"))
        rank = F.struct((-F.col("named")).alias("r1"), F.when(F.col("named") > 0, 0).otherwise(F.col("kind_rank")).alias("r2"), (-headings.title_score(title, F.col("title_words"))).alias("r3"), F.when(title.rlike(NOT_COORDINATION), 1).otherwise(0).alias("r4"), level_rank.alias("r5"), "page", "sheet", "level")
        best = ranked.groupBy("element_id").agg(F.min(F.when(fits, rank)).alias("pick"))
        asked = turn.select("element_id", F.col("need.entry").alias("entry")).join(best.withColumn("found", F.lit(True)), "element_id", "left")
        after = state.join(asked, "element_id", "left")
        state = after.select(
            "element_id", F.when(F.col("pick").isNotNull(), F.array_append("sheets", F.col("pick.sheet"))).otherwise(F.col("sheets")).alias("sheets"),
            F.when(F.col("entry").isNotNull() & F.col("found").isNull(), F.array_append("missing", F.col("entry"))).otherwise(F.col("missing")).alias("missing"), F.coalesce("picked_level", "pick.level").alias("picked_level"),
        )
        if k % ROUNDS == ROUNDS - 1:
            state = stored(state, "suggested-sheets")
    return read.select("element_id", "outside").join(state, "element_id").select("element_id", "sheets", "missing", "outside")
