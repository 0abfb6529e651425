"""Rules over what drawings print: references, indexes, details, grid lines and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of a sheet number, of a callout, of a pointer (any of its words before a sheet makes it a reference) and of an index heading.
SHEET = r"[A-Z]{1,2}-?\d{1,4}(?:\.\d{1,3}){0,2}(?:-?[A-Z]{1,3}(?![A-Z]))?(?:-[A-Z]{1,3}(?![A-Z]))*"
CALLOUT = rf"(?<![A-Z0-9/.])(?:\d{{1,2}}|[A-Z]\d?)\s*/\s*({SHEET})(?![A-Z0-9/])"
POINTER = rf"(?<!COVER\s)(?<!TITLE\s)(?<!KEY\s)\b(?:SEE|REFER\s+TO|REF\.?|REFERENCE|ON|SHEET|SHT\.?|DWG\.?|DRAWING)\s+(?:(?:SHEET|SHT\.?|DWG\.?|DRAWING)\s+)?(?:(?:DETAIL|DET\.?|SECTION|SECT\.?)\s+[A-Z0-9]{{1,3}}\s+(?:ON\s+)?(?:SHEET\s+)?)?({SHEET})(?![A-Z0-9])"
INDEX_HEADING = r"\b(?:SHEET|DRAWING)S?\s+(?:INDEX|LIST)\b|\bINDEX\s+(?:OF|TO)\s+(?:DRAWINGS|SHEETS)\b|\bLIST\s+OF\s+(?:DRAWINGS|SHEETS)\b"
INDEX_ENTRIES = 5
CENTRED, FACE, OFFSET, UNCERTAIN, NO_GRID = "CENTRED", "FACE", "OFFSET", "UNCERTAIN", "NO_GRID"


def pointed_sheets(c: Column) -> Column:
    """Sheets that a text points at by a callout or a pointer word, as printed, each once, sorted."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(upper, F.lit(CALLOUT), 1), F.regexp_extract_all(upper, F.lit(POINTER), 1))))


def index_pages(chunks: DataFrame, least: int = INDEX_ENTRIES) -> DataFrame:
    """Pages with an index heading and at least `least` different sheet numbers."""
    upper = F.upper(F.coalesce("text", F.lit("")))
    headed = chunks.groupBy("page_id").agg(F.bool_or(upper.rlike(INDEX_HEADING)).alias("headed")).filter("headed")
    listed = chunks.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(upper, F.lit(rf"(?<![A-Z0-9/.-])({SHEET})(?![A-Z0-9/])"), 1))).alias("sheet"))
    return listed.join(headed, "page_id", "left_semi").groupBy("page_id").agg(F.countDistinct("sheet").alias("n_sheets")).filter(F.col("n_sheets") >= least)


def without_index_entries(c: Column) -> Column:
    """A text without the lines that start with a sheet number, and the title line under a bare one."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    entry = lambda x: F.upper(x).rlike(rf"^\s*\|?\s*{SHEET}(?:\s|\||$)")
    bare = lambda x: F.upper(F.trim(x)).rlike(rf"^{SHEET}$")
    under = lambda i: F.coalesce(F.when(i > 0, bare(F.get(lines, i - 1))), F.lit(False))
    return F.array_join(F.filter(lines, lambda x, i: ~entry(x) & ~under(i)), "\n")


def missing_details(links: DataFrame, details: DataFrame, titled: int = 3) -> DataFrame:
    """links (page_id, sheet, detail) to details that their sheet lacks; only sheets with enough titled details are judged."""
    have = details.select(F.upper("sheet").alias("sheet"), F.upper("detail").alias("detail")).distinct()
    judged = have.groupBy("sheet").agg(F.count("*").alias("n_details")).filter(F.col("n_details") >= titled)
    asked = links.select("page_id", F.upper("sheet").alias("sheet"), F.upper("detail").alias("detail"))
    lost = asked.join(judged, "sheet").join(have, ["sheet", "detail"], "left_anti")
    return lost.groupBy("sheet", "detail").agg(F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"), F.first("n_details").alias("n_details"))


def axis_states(bodies: DataFrame, lines: DataFrame, reach: float, centred: float, off: float) -> DataFrame:
    """bodies (page, body_id, centre, half) against the nearest line (page, label, position) within reach.

    CENTRED, else FACE where the body's face is on the line, else OFFSET, else UNCERTAIN; NO_GRID without a line. A page
    has tens of lines.
    """
    distance = F.abs(F.col("centre") - F.col("position"))
    near = bodies.join(lines, "page").filter(distance <= reach).groupBy("page", "body_id").agg(F.min(F.struct(distance.alias("d"), "label", "position")).alias("n"))
    joined = bodies.join(near, ["page", "body_id"], "left")
    d = F.col("n.d")
    state = F.when(d.isNull(), NO_GRID).when(d <= centred, CENTRED).when(F.abs(d - F.col("half")) <= centred, FACE).when(d >= off, OFFSET).otherwise(UNCERTAIN)
    return joined.select("page", "body_id", F.col("n.label").alias("label"), F.round(F.col("centre") - F.col("n.position"), 6).alias("offset"), state.alias("state"))


def settled(x: Column, y: Column, dimension_near: Column) -> Column:
    """LOCATED only if both axes are centred; OFF_GRID if one is off and no printed dimension is near; else UNKNOWN."""
    return F.when((x == CENTRED) & (y == CENTRED), "LOCATED").when(((x == OFFSET) | (y == OFFSET)) & ~dimension_near, "OFF_GRID").otherwise("UNKNOWN")


def associated(candidates: DataFrame, ratio: float = 1.5, points: float = 4.0) -> DataFrame:
    """candidates (label_id, body_id, distance, agrees) to one body per label, or why not.

    agrees says whether a body fits the printed size, null where no size is printed. A second body about as near makes
    the label ambiguous; a nearest body of the wrong size isn't swapped for the next.
    """
    w = Window.partitionBy("label_id").orderBy("distance", "body_id")
    two = candidates.withColumn("place", F.row_number().over(w)).filter("place <= 2")
    pick = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    rows = two.groupBy("label_id").agg(pick(1, "body_id").alias("body"), pick(1, "distance").alias("d0"), pick(2, "distance").alias("d1"), pick(1, "agrees").alias("fits"), pick(2, "agrees").alias("next_fits"))
    ambiguous = F.coalesce((F.col("d1") <= F.greatest(F.col("d0") * ratio, F.col("d0") + points)) & F.coalesce("next_fits", F.lit(True)), F.lit(False))
    outcome = F.when(ambiguous, "ambiguous").when(~F.coalesce("fits", F.lit(True)), "size_mismatch").otherwise("associated")
    return rows.select("label_id", outcome.alias("outcome"), F.when(outcome == "associated", F.col("body")).alias("body_id"))


def intersections(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Every crossing of a page's column and row lines (tens of each)."""
    c, r = columns.select("page", F.col("label").alias("column"), F.col("position").alias("x")), rows.select("page", F.col("label").alias("row"), F.col("position").alias("y"))
    return c.join(r, "page").select("page", F.concat_ws("/", "column", "row").alias("crossing"), "x", "y")


def shared_lines(lines: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Labels of one axis that stand at the same position, as one list per place."""
    w = Window.partitionBy("page").orderBy("position", "label")
    new = (F.coalesce(F.col("position") - F.lag("position").over(w), F.lit(tolerance + 1)) > tolerance).cast("int")
    groups = lines.withColumn("new", new).withColumn("place", F.sum("new").over(w))
    return groups.groupBy("page", "place").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"), F.min("position").alias("position"), F.count("*").alias("n")).filter("n > 1").drop("place", "n")


def schedule_rows(marks: DataFrame, gap: float, least: int = 3) -> DataFrame:
    """Marks that are rows of a table, not labels: a left-aligned chain of one family with bounded vertical gaps and
    at least `least` different texts."""
    w = Window.partitionBy("page", "family", "left").orderBy("y", "mark_id")
    new = (F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(gap + 1)) > gap).cast("int")
    chains = marks.withColumn("new", new).withColumn("chain", F.sum("new").over(w)).drop("new")
    texts = F.size(F.collect_set("text").over(Window.partitionBy("page", "family", "left", "chain")))
    return chains.withColumn("n", texts).filter(F.col("n") >= least).drop("chain", "n")


def spacing_differences(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Bays (page pair, label, next label) whose width differs between two sheets by more than tolerance."""
    def bays(rows: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("pair").orderBy("position")
        return rows.select("pair", F.col("label").alias("start"), F.lead("label").over(w).alias("end"), (F.lead("position").over(w) - F.col("position")).alias(name)).filter("end is not null")

    both = bays(a, "width_a").join(bays(b, "width_b"), ["pair", "start", "end"])
    return both.withColumn("difference", F.round(F.col("width_b") - F.col("width_a"), 6)).filter(F.abs("difference") > tolerance)


def schedule_loops(schedule: DataFrame, plan: DataFrame) -> DataFrame:
    """Marks whose schedule says SEE PLAN while the plan says SEE SCHEDULE."""
    a = schedule.filter(F.upper("note").rlike(r"\bSEE\s+PLANS?\b")).select("mark", F.col("page_id").alias("schedule_page"))
    b = plan.filter(F.upper("note").rlike(r"\bSEE\s+SCHEDULES?\b")).select("mark", F.col("page_id").alias("plan_page"))
    first = lambda df, c: df.groupBy("mark").agg(F.min(c).alias(c))
    return first(a, "schedule_page").join(first(b, "plan_page"), "mark")


def line_aliases(lines: DataFrame) -> DataFrame:
    """Lines of a project that carry two names or more at one rounded place: names and disciplines."""
    grouped = lines.groupBy("project", F.round("position", 0).alias("place")).agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.countDistinct("label").alias("n_labels"), F.countDistinct("discipline").alias("n_disciplines"))
    return grouped.filter("n_labels > 1")
