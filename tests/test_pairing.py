"""Pairs, tiles and suggestions against plain versions."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import pairing as p


def plain_pairs(sheets):
    reasons, plans = {}, []
    for s in sheets:
        if s["kind"] in p.PLANS:
            why = p.NO_LEVEL if not s["level"] else p.NO_SCALE if not s["scales"] else p.VIEWS if s["views"] else None
            if why:
                reasons[s["page_id"]] = why
            else:
                plans.append(s)
    governs = lambda a, b: a["discipline"] == b["discipline"] or a["discipline"] in p.GOVERNING or b["discipline"] in p.GOVERNING
    pairs = set()
    for a in plans:
        for b in plans:
            if (a["project"], a["level"]) != (b["project"], b["level"]) or a is b:
                continue
            first = (a["discipline"] or "", a["label"], a["page_id"]) < (b["discipline"] or "", b["label"], b["page_id"])
            if a["kind"] == b["kind"] == "plan" and first and a["discipline"] and b["discipline"] and a["discipline"] != b["discipline"] and governs(a, b) and any(abs(x - y) <= 0.02 * max(x, y) for x in a["scales"] for y in b["scales"]):
                pairs.add(("same_level", a["page_id"], b["page_id"]))
            ratio = min(a["scales"]) / min(b["scales"])
            if b["kind"] == "plan" and ratio >= 1.5 and governs(a, b) and not (a["kind"] == "plan" and (ratio < 2 or a["discipline"] != b["discipline"])):
                pairs.add(("enlarged", a["page_id"], b["page_id"]))
    paired = {x for _, *ids in pairs for x in ids}
    for f in plans:
        if f["page_id"] not in paired:
            others = [g for g in plans if g is not f and (g["project"], g["level"]) == (f["project"], f["level"]) and g["discipline"] and g["discipline"] != f["discipline"]]
            reasons[f["page_id"]] = p.NO_DISCIPLINE if not f["discipline"] else p.ALONE if not others else p.NOT_GOVERNED if not any(governs(f, g) for g in others) else p.OTHER_SCALE
    return pairs, reasons


def test_pairs_and_reasons(spark):
    rng = random.Random(7)
    sheets = [
        dict(project=rng.randint(1, 6), page_id=k, label=f"S{rng.randint(1, 99)}", level=rng.choice(["L1", "L2", "L3", "L4", None, ""]), discipline=rng.choice(["architectural", "structural", "plumbing", "electrical", None, ""]), kind=rng.choice(["plan", "plan", "plan", "enlarged_plan", "section", None]), scales=rng.choice([[9.0], [9.1, 18.0], [18.0], [4.5], [9.3], [36.0, 9.0], [], None]), views=rng.choice([False] * 8 + [True, None]))
        for k in range(260)
    ]
    df = spark.createDataFrame([tuple(s.values()) for s in sheets], "project int, page_id int, label string, level string, discipline string, kind string, scales array<double>, views boolean")
    pairs, left = p.sheet_pairs(df)
    want, reasons = plain_pairs(sheets)
    got = [(r["kind"], r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r["page_id"]: r["reason"] for r in left.collect()} == reasons
    assert {k for k, *_ in want} == {"same_level", "enlarged"} and set(reasons.values()) >= {p.NO_LEVEL, p.NO_SCALE, p.VIEWS, p.NO_DISCIPLINE, p.ALONE, p.OTHER_SCALE}


def plain_tiles(area, scale, tx, ty, bw, bh, size):
    meet = lambda r, s: (lambda o: o if o[2] - o[0] > 1 and o[3] - o[1] > 1 else None)((max(r[0], s[0]), max(r[1], s[1]), min(r[2], s[2]), min(r[3], s[3])))
    x0, y0, x1, y1 = area
    nx, ny = (max(1, math.ceil(e / (size * 0.88))) for e in (x1 - x0, y1 - y0))
    w, h = min(size, x1 - x0), min(size, y1 - y0)
    out = []
    for j in range(ny):
        for i in range(nx):
            left, top = x0 + (x1 - x0 - w) * (i / (nx - 1) if nx > 1 else 0), y0 + (y1 - y0 - h) * (j / (ny - 1) if ny > 1 else 0)
            wa = (left, top, left + w, top + h)
            wb = meet(tuple(v * scale + t for v, t in zip(wa, (tx, ty, tx, ty), strict=True)), (0, 0, bw, bh))
            a = wb and meet(tuple((v - t) / scale for v, t in zip(wb, (tx, ty, tx, ty), strict=True)), wa)
            if a and a[2] - a[0] >= 0.25 * size and a[3] - a[1] >= 0.25 * size:
                out.append((a, wb))
    return out


def test_tiles(spark):
    rng = random.Random(1)
    rows = [(k, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(150, 1500), rng.uniform(150, 1500), rng.choice([1.0, 0.5, 0.25]), rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(200, 900), rng.uniform(200, 900)) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double, scale double, tx double, ty double, bw double, bh double")
    c = F.col
    got = {r["k"]: [(tuple(t["a"]), tuple(t["b"])) for t in r["t"]] for r in df.select("k", p.tiles(F.struct("x0", "y0", "x1", "y1"), c("scale"), c("tx"), c("ty"), c("bw"), c("bh"), 240.0).alias("t")).collect()}
    for k, x0, y0, x1, y1, *rest in rows:
        want = plain_tiles((x0, y0, x1, y1), *rest, 240.0)
        assert len(got[k]) == len(want) and all(a == pytest.approx(b) for g, w in zip(got[k], want, strict=True) for a, b in zip(g, w, strict=True))
    shared = df.select(p.shared_tiles(F.struct("x0", "y0", "x1", "y1"), F.struct(*[(c(e) + 9000).alias(e) for e in ("x0", "y0", "x1", "y1")]), c("tx"), c("ty"), c("bw"), c("bh"), 240.0).alias("t"))
    assert shared.filter("t is not null").count() == 0


def stem(w):
    return re.sub("(?<![sS])[sS]$", "", w)


def plain_needs(entries):
    out, outside, last = [], [], None
    for e in entries:
        named = list(dict.fromkeys(d for pattern, ds in p.DISCIPLINES if re.search(pattern, e) for d in ds))
        kinds = [k for pattern, ks in p.KINDS if re.search(pattern, e) for k in ks]
        disciplines = named or (last if kinds and last else None)
        if not disciplines:
            outside.append(e)
        else:
            last = disciplines
            out.append((e, disciplines, kinds))
    return out, outside


def plain_suggest(element, sheets):
    _, _, entries, name, stage = element
    listed, outside = plain_needs(entries)
    picked, missing, level = [], [], None
    subject = lambda t: [stem(w).upper() for w in re.findall("[a-z]+", t.lower()) if len(w) >= 3 and w not in p.NOT_A_SUBJECT]
    for entry, disciplines, kinds in listed:
        of = [s for s in sheets if s["discipline"] in disciplines]
        if not of:
            missing.append(entry)
            continue
        prefer = kinds or list(p.PLANS)
        words, every = ((subject(entry), True) if subject(entry) else (subject(name or ""), False)) if "schedule" in kinds else ([], True)

        def named(s, words=words, every=every):
            best = 0
            for h in s["headings"] or []:
                tokens = [stem(t) for t in re.findall("[A-Z]+", h)]
                has = lambda w, tokens=tokens: w in tokens or len(words) > 1 and w == "PILE" and "PIER" in tokens
                if words and (all(map(has, words)) if every else any(w in tokens for w in words)):
                    best = max(best, 3 if "CONCRETE" in tokens else 2)
            return best

        def kind_rank(s, prefer=prefer, kinds=kinds):
            return prefer.index(s["kind"]) if s["kind"] in prefer else len(prefer) if s["kind"] is None else -1 if kinds else len(prefer) + 1

        title_words = [w for w in dict.fromkeys(stem(t) for x in (entry, name or "", stage or "") for t in re.findall("[A-Z]{3,}", x.upper())) if w not in p.TITLE_NOISE]
        score = lambda s, ws=title_words: sum(w in {stem(t) for t in re.findall("[A-Z]+", (s["title"] or "").upper())} for w in ws)
        rank = lambda s, level=level: (-named(s), 0 if named(s) else kind_rank(s), -score(s), bool(re.search(p.NOT_COORDINATION, (s["title"] or "").upper())), 0 if level and s["level"] == level else 1 if s["level"] else 2, s["page"])
        options = sorted((s for s in of if (kind_rank(s) >= 0 or named(s)) and s["sheet"] not in picked), key=rank)
        if options:
            picked.append(options[0]["sheet"])
            level = level if level is not None else options[0]["level"]
    return picked, missing, outside


def test_suggestions(spark):
    rng = random.Random(3)
    entries = ["Arch plans", "Struct", "pile cap schedule", "Geotech", "Struct foundation plan", "footing schedule", "MEP", "elevations", "Civil plans", "Life safety", "details", "Plumbing sections", "column schedule", "RCP"]
    elements = [(rng.randint(1, 2), k, rng.sample(entries, rng.randint(0, 6)), rng.choice(["Drilled piers / caissons", "Columns", None]), rng.choice(["Deep Foundations", None])) for k in range(40)]
    sheets = [
        dict(project=rng.randint(1, 2), sheet=f"S{k}", page=k, discipline=rng.choice(["architectural", "structural", "structural", "plumbing", "general", None]), kind=rng.choice(["plan", "enlarged_plan", "schedule", "section", "detail", None]), level=rng.choice(["L1", "L2", None]), title=rng.choice(["FOUNDATION PLAN", "LIFE SAFETY PLAN", "COLUMNS LEVEL 2", "FINISH PLAN", None]), headings=rng.choice([[], ["CONCRETE COLUMN SCHEDULE"], ["PIER CAPS SCHEDULE"], ["CAISSON SCHEDULE", "FOOTINGS SCHEDULE"], None]))
        for k in range(50)
    ]
    got = p.suggested(spark.createDataFrame(elements, "project int, element_id int, entries array<string>, name string, stage string"), spark.createDataFrame([tuple(s.values()) for s in sheets], "project int, sheet string, page int, discipline string, kind string, level string, title string, headings array<string>"))
    have = {r["element_id"]: (r["sheets"], r["missing"], r["outside"]) for r in got.collect()}
    want = {e[1]: plain_suggest(e, [s for s in sheets if s["project"] == e[0]]) for e in elements}
    assert have == want and any(m for _, m, _ in want.values()) and max(len(s) for s, _, _ in want.values()) >= 5
