"""Matches with their context against plain regular expressions; the checks that run from raw text."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import contexts, headings
from quillspark.operators import text_checks


def texts():
    rng = random.Random(6)
    words = ["EF-3", "RTU-12", "80", "MBH", "100 MBH", "2-1/2 HP", "1/2 HP", "5 TON", "7 TONS", "INPUT", "OUTPUT", "MINIMUM", "MAX", "SUPPLY", "SEE", "REFER TO", "PER", "ASTM", "A307 OR A36", "DESIGN NO.", "U300, U400", "SERIES", "GRID", "GRID LINE", "C3", "100-EL1", "D6/A2.75", "PC-4", "PC4,", "\n", "  ", "é", "1/0 HP", "12.5CFM", "AND"]
    return [None, "", "EF-3", "EF-3EF-4 80 MBH"] + [rng.choice([" ", " ", "", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(400)]


def test_occurrences_and_guards(spark):
    rows = list(enumerate(texts()))
    o = contexts.occurrences(F.upper(F.coalesce("t", F.lit(""))), contexts.MARK_TOKEN)
    row = lambda x: F.struct(x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end"), contexts.part_of_other_label(x).alias("label"), contexts.referenced(x).alias("referenced"), contexts.in_listing(x).alias("listed"))
    got = {r["k"]: [tuple(x) for x in r["o"]] for r in spark.createDataFrame(rows, "k int, t string").select("k", F.transform(o, row).alias("o")).collect()}
    seen = [0, 0, 0]
    for k, t in rows:
        upper, want = (t or "").upper(), []
        for m in re.finditer(contexts.MARK_TOKEN, upper):
            s, e = m.span()
            flags = (
                bool(re.search(contexts.ROOM_BEFORE, upper[max(0, s - 6) : s]) or re.search(contexts.GRID_BEFORE, upper[max(0, s - 16) : s]) or re.match(contexts.SHEET_AFTER, upper[e : e + 12])),
                bool(re.search(contexts.REFERENCE_BEFORE, upper[max(0, s - 16) : s])), bool(re.search(contexts.LISTING_BEFORE, upper[max(0, s - 60) : s]) or re.match(contexts.LISTING_AFTER, upper[e : e + 60])),
            )
            want.append((m[0], s, e, *flags))
            seen = [a + b for a, b in zip(seen, flags, strict=True)]
        assert got[k] == want, t
    assert min(seen) > 20


def value(text):
    parts = text.replace(" ", "-").split("-")
    total = 0.0
    for p in parts:
        a, _, b = p.partition("/")
        if b and not int(b):
            return None
        total += float(a) / float(b) if b else float(a)
    return total


def plain_ratings(t):
    upper, out = (t or "").upper(), []
    tags = list(re.finditer(headings.TAG, upper))
    for i, m in enumerate(tags):
        window = upper[m.end() : min(m.end() + 40, tags[i + 1].start() if i + 1 < len(tags) else len(upper))]
        found = [(r, "TONS" if r[2] == "TON" else r[2]) for r in re.finditer(headings.RATING, window)]
        for r, unit in found:
            if sum(u == unit for _, u in found) == 1 and (v := value(r[1])) is not None:
                words = {w.removesuffix("IMUM") if w.startswith("M") else w for w in re.findall(contexts.QUALIFIERS, upper[m.start() : m.end() + r.end() + 12])}
                out.append((m[1], unit, round(v, 6), tuple(sorted(words))))
    return sorted(out)


def test_rated_tags(spark):
    rows = list(enumerate(texts()))
    got = {r["k"]: sorted((x["tag"], x["unit"], round(x["value"], 6), tuple(sorted(x["qualifiers"]))) for x in r["r"]) for r in spark.createDataFrame(rows, "k int, t string").select("k", contexts.rated_tags(F.col("t")).alias("r")).collect()}
    want = {k: plain_ratings(t) for k, t in rows}
    assert got == want and sum(map(len, want.values())) > 60 and any(q for v in want.values() for *_, q in v)


def chunks(spark, *rows):
    return spark.createDataFrame(rows, "page_id int, text string")


def test_conflicts_from_text(spark):
    got = {(r["tag"], r["unit"]): (r["n_values"], r["n_sheets"], r["confidence"]) for r in text_checks.tag_value_conflicts(chunks(
        spark, (1, "RTU-3 HEATING INPUT 100 MBH"), (2, "rtu-3 heating output 80 mbh"), (1, "EF-1 100 CFM"), (2, "EF-1 100 CFM"), (3, "EF-1 120 CFM"),
        (1, "EF-2 SUPPLY 10 CFM"), (2, "EF-2 20 CFM"), (1, "EF-3 MIN 5 GPM"), (2, "EF-3 MINIMUM 6 GPM"), (1, "EF-4 5 GPM 7 GPM"), (2, "EF-4 6 GPM"), (3, None),
    )).collect()}
    assert got == {("EF-1", "CFM"): (2, 3, "high"), ("EF-2", "CFM"): (2, 2, "medium"), ("EF-3", "GPM"): (2, 2, "medium")}


def test_marks_and_references_from_text(spark):
    plans = chunks(spark, (1, "PC4 AND PC-9, ROOM 100-PC7, SEE PC8, GRID C3, PC5/A2.75, ASTM PC300"), (2, "PC9 X1"), (3, None))
    schedule = chunks(spark, (9, "PILE CAP SCHEDULE PC4 PC1"))
    assert [(r["mark"], r["n_pages"], r["first_page"]) for r in text_checks.unscheduled_marks(plans, schedule).collect()] == [("PC9", 2, 1)]
    issued = spark.createDataFrame([("S-501",), ("S-502",)], "sheet string")
    found = text_checks.dangling_references(chunks(spark, (1, "SEE S-503 AND 4/S-501, DESIGN NO. U300, ON S-777 SERIES"), (2, "see sheet s-503")), issued)
    assert [(r["sheet"], r["n_pages"]) for r in found.collect()] == [("S503", 2)]


def more_texts():
    rng = random.Random(12)
    words = ["PILE CAP", "SCHEDULE", "SCHEDULES", "SEE", "REFER TO", "FOR", "COLUMN", "STUD RAIL", "DECON STUDRAIL", "DOOR", "AND", "D6/A3.11", "A2.87 D6", "D6 A2.91", "E1", "SIMPSON A34", "HILTI NO. X12", "A307 OR A36 STEEL", "ASTM A615, A706", "B12 GRADE", "K9", "1/4\" = 1'-0\"", "1 1/2” = 1’-0”", "3\"=1'0\"", "27 1/4\" = 1'-0\"", "0/0\" = 1'-0\"", "5\" = 1'-0\"", "12/3/4\" = 1'-0\"", "3/32 '' = 1' - 0''", "\n", ",", "."]
    return [None, "", "SCHEDULE"] + [rng.choice([" ", " ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(300)]


def plain_titles(t):
    upper, out = (t or "").upper(), []
    for m in re.finditer(contexts.SCHEDULE_TITLE, upper):
        words = m[0].split()
        if not any(w.strip(".,:") in contexts.TITLE_POINTERS for w in words[:-1]) and not re.match(contexts.SEE_AFTER, upper[m.end() : m.end() + 60]):
            out.append(" ".join(words))
    return out


def plain_scales(t):
    out = set()
    for m in re.finditer(contexts.SCALE, t or ""):
        total = 0.0
        for part in m[1].split():
            a, _, b = part.partition("/")
            if "/" in b or b and not int(b):
                total = float("nan")
            else:
                total += int(a) / int(b) if b else int(a)
        if 1 / 64 <= total <= 3:
            out.add(round(total * 72, 4))
    return sorted(out)


def plain_catalogue(t):
    upper = (t or "").upper()
    return {re.sub("[^A-Z0-9]", "", m[0]) for m in re.finditer(contexts.CATALOGUE_TOKEN, upper) if re.search(contexts.MAKER_BEFORE, upper[max(0, m.start() - 30) : m.start()]) or re.match(contexts.GRADE_AFTER, upper[m.end() : m.end() + 40])}


def test_titles_details_catalogue_and_scales(spark):
    rows = list(enumerate(more_texts()))
    c = F.col("t")
    found = spark.createDataFrame(rows, "k int, t string").select("k", contexts.schedule_titles(c).alias("titles"), contexts.detail_numbers(c).alias("details"), contexts.catalogue_numbers(c).alias("catalogue"), contexts.scales_in(c).alias("scales"))
    got = {r["k"]: r for r in found.collect()}
    some = [0] * 4
    for k, t in rows:
        details = {m[1] or m[2] for m in re.finditer(contexts.DETAIL_ID, (t or "").upper())}
        want = (plain_titles(t), details, plain_catalogue(t), plain_scales(t))
        assert (got[k]["titles"], set(got[k]["details"]), set(got[k]["catalogue"]), got[k]["scales"]) == want, t
        some = [a + bool(b) for a, b in zip(some, want, strict=True)]
    assert min(some) > 20


def test_titles_name_families(spark):
    cases = [("PILE CAP SCHEDULE", "PC", True), ("DECON STUDRAIL SCHEDULE", "SR", True), ("STUD RAIL SCHEDULE", "SR", True), ("LEVEL SCHEDULE", "SR", False), ("CONCRETE COLUMN SCHEDULE", "C", True), ("CMU SCHEDULE", "C", False), ("CLASS B TENSION SPLICE SCHEDULE", "C", False), ("DOOR SCHEDULE", "D", True), ("SCHEDULE", "D", False), ("SHEAR AND WALL SCHEDULE", "SW", True), ("", "A", False)]
    df = spark.createDataFrame(cases, "title string, family string, want boolean")
    assert df.filter(contexts.names_family(F.col("title"), F.col("family")) != F.col("want")).collect() == []
