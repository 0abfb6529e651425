"""Registered queries that read text: headings, titles, levels, marks, ratings, tables and replies.

Each puts its values into text as drawings print them and parses them out again; the SQL takes them from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain, headings, text
from ..operators import merge, numbering, retrieval
from ..sources.tables import table, tasks_for
from ..streaming import jobs
from .queries import query

ASCII = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
MESSAGES = (
    "OSError: [Errno 28] No space left on device", "MemoryError while reading", "getaddrinfo ENOTFOUND host", "NoSuchKey: the key is gone", "search is turned off now", "429 exceeded your current quota", "Error 401: who are you", "HTTP 503 from the model",
    "the worker stopped", "no page summaries", "reply was not valid JSON", "cannot open broken document", "connection reset by peer, timed out", "validation failed: x", "Not found", "page not found here", "",
)
KINDS = ("disk", "memory", "offline", "storage", "disabled", "ai_credits", "ai_key", "ai_busy", "worker_stopped", "nothing_to_read", "ai_reply", "pdf_damaged", "connection", "invalid_input", "not_found", "unknown", "unknown")


@query(f"select event_id, ({list(KINDS)})[event_id % 17 + 1] as kind from events")
def problem_kinds(spark, d):
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 17 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", headings.problem_kind(message).alias("kind"))


@query(rf"select doc_id, regexp_matches(t, '(^|[^A-Z0-9])IN([^A-Z0-9]|$)') as has_in, regexp_matches(t, '(^|[^A-Z0-9])DIE([^A-Z0-9]|$)') as has_die, contains(t, '(555)') as has_code from (select doc_id, translate(coalesce(text, ''), {ASCII}) as t from documents)")
def keyword_mentions(spark, d):
    upper = F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, d, "documents").select("doc_id", *(headings.mentions(upper, k).alias(n) for k, n in (("IN", "has_in"), ("DIE", "has_die"), ("(555)", "has_code"))))


@query("select p_partkey, case p_size % 3 when 0 then concat('Level B', p_size) when 1 then 'Upper Level ' || p_size else 'Roof-Deck' end as label from part")
def level_labels(spark, d):
    level = F.expr("case p_size % 3 when 0 then concat('LEVEL B', p_size) when 1 then concat('UPPER LEVEL ', p_size) else 'ROOF-DECK' end")
    return table(spark, d, "part").select("p_partkey", headings.level_label(level).alias("label"))


@query("with s as (select l_orderkey, list_sort(list(distinct l_linenumber)) as ns, bool_or(l_orderkey % 7 = 0) as odd from lineitem group by 1) select l_orderkey, case when len(ns) = 1 and not odd then concat('LEVEL ', ns[1]) when not odd and ns[len(ns)] - ns[1] = len(ns) - 1 then concat('LEVEL ', ns[1], '-', ns[len(ns)]) end as level from s")
def summary_levels(spark, d):
    # an order's lines, a handful; every seventh order has a qualified level too
    levels = F.concat(F.collect_set(F.concat(F.lit("LEVEL "), F.col("l_linenumber").cast("string"))), F.when(F.max(F.col("l_orderkey") % 7) == 0, F.array(F.lit("UPPER LEVEL 2"), F.lit("ROOF"))).otherwise(F.array().cast("array<string>")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(levels.alias("levels")).select("l_orderkey", headings.summary_level(F.col("levels")).alias("level"))


@query("""select p_partkey, case when p_size % 4 = 0 then 1 when p_partkey % 40 between 1 and 30 then p_partkey % 40 + 1 else 1 end + 1 as n,
  case when p_size % 4 = 0 then 'LEVEL 3' when p_partkey % 40 between 1 and 30 then concat('LEVEL ', case when p_size % 2 = 0 then 'B' else '' end, p_size + p_partkey % 40) else concat('LEVEL ', case when p_size % 2 = 0 then 'B' else '' end, p_size, '-', p_size + p_partkey % 40) end as last from part""")
def floors_of_levels(spark, d):
    level = F.expr("if(p_size % 4 = 0, 'LEVEL 3', concat('LEVEL ', if(p_size % 2 = 0, 'B', ''), p_size, '-', p_size + p_partkey % 40))")
    floors = domain.expanded_levels(F.array(F.lit("ROOF"), level, F.lit("ROOF")))
    return table(spark, d, "part").select("p_partkey", floors.alias("floors")).select("p_partkey", F.size("floors").alias("n"), F.element_at("floors", -1).alias("last"))


@query("""select p_partkey, case p_size % 4 when 0 then concat('COLUMN ', upper(p_type), ' SCHEDULE - AREA ', p_size) when 1 then concat('PILE CAP SCHEDULE|COLUMN ', upper(p_type), ' SCHEDULE - AREA ', p_size)
  when 2 then concat('PILE CAP SCHEDULE|', upper(p_type), ' SCHEDULE') else '' end as found from part""")
def schedule_headings(spark, d):
    raw = F.expr(r"""case p_size % 4 when 0 then concat('general notes\n  Column   ', p_type, '\nSchedule - Area ', p_size, '\nSEE BEAM SCHEDULE')
      when 1 then concat('Pile cap schedule\nCOLUMN ', p_type, ' SCHEDULE - AREA ', p_size, '\nSCHEDULE') when 2 then concat('PILE CAP SCHEDULE\npile cap schedule\n', p_type, ' schedule\nBARS FOR SLAB SCHEDULE')
      else concat('REFER TO DOOR SCHEDULE ', p_name, '\n', repeat('LONG ', 20), 'SCHEDULE') end""")
    return table(spark, d, "part").select("p_partkey", F.array_join(headings.schedule_headings(raw), "|").alias("found"))


@query("select p_partkey, case p_size % 5 when 0 then 3 when 1 then 2 when 2 then 2 else 0 end as score, case when p_size % 5 in (2, 4) then 2 else 0 end as any_word from part")
def heading_scores(spark, d):
    found = F.expr("case p_size % 5 when 0 then array('BEAM SCHEDULE', 'CONCRETE PILE CAPS SCHEDULE') when 1 then array('PILES CAP SCHEDULE') when 2 then array('PIER CAP SCHEDULE') when 3 then array('CAP SCHEDULE') else array('DRILLED CAISSONS SCHEDULE') end")
    strings = lambda *xs: F.array(*map(F.lit, xs))
    every, some = headings.heading_score(found, strings("PILE", "CAP"), F.lit(True)), headings.heading_score(found, strings("PIER", "CAISSON"), F.lit(False))
    return table(spark, d, "part").select("p_partkey", every.alias("score"), some.alias("any_word"))


@query("select p_partkey, concat('FOUNDATION PLANS ', upper(p_name), ' AREA') as title, 1 + case when upper(p_name) like '%WIDGET%' then 1 else 0 end as score from part")
def sheet_titles(spark, d):
    # a file of few bytes is one task, but its rows are much work
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    part = part.repartition(tasks_for(part, 200_000))
    block = F.expr("concat('ACME  SHEET NO A', p_size, '\\n sheet title FOUNDATION PLANS ', upper(p_name), ' S-', p_partkey, ' AREA © 2020 ACME')")
    title = headings.sheet_title(block, F.expr("concat('S-', p_partkey)"))
    return part.select("p_partkey", title.alias("title")).select("p_partkey", "title", headings.title_score(F.col("title"), F.array(F.lit("PLAN"), F.lit("WIDGET"), F.lit("ROOF"))).alias("score"))


@query("""select p_partkey, concat('EF-', p_size) as tag, 'CFM' as unit, round(p_size + 0.5, 6) as value from part where p_partkey % 3 < 2 union all
  select p_partkey, concat('RTU-', p_size), 'TONS', round(2 + 1 / 2, 6) from part where p_partkey % 3 > 0""")
def tag_ratings(spark, d):
    raw = F.expr(r"""case p_partkey % 3 when 0 then concat('fan ef-', p_size, ' rated\n', p_size, '.5 cfm, 10 KW or 12 KW') when 1 then concat('EF-', p_size, ' ', p_size, '.5CFM RTU-', p_size, ' COOLING 2-1/2 TON 1/0 HP')
      else concat('RTU-', p_size, ': 2 1/2 tons, and much further on in this sentence about fans: 77 CFM') end""")
    return table(spark, d, "part").select("p_partkey", F.explode(headings.tag_ratings(raw)).alias("r")).select("p_partkey", "r.tag", "r.unit", F.round("r.value", 6).alias("value"))


@query("select p_partkey, case when p_size % 4 < 3 then concat(case p_size % 4 when 1 then '2' else '' end, 'PC', p_size) end as mark, case when p_size % 4 < 3 then 'PC' end as family from part")
def schedule_marks(spark, d):
    token = F.expr("case p_size % 4 when 0 then concat('pc-', p_size, ',') when 1 then concat('2PC', p_size) when 2 then concat(':PC', p_size, '.') else concat('PC/', p_size) end")
    return table(spark, d, "part").select("p_partkey", headings.mark_of(token).alias("m")).select("p_partkey", "m.mark", "m.family")


@query("""with r as (select l_orderkey, list([l_returnflag || '\\|' || l_linenumber, case when l_linenumber % 2 = 0 then 'a b' else '' end] order by l_linenumber, l_returnflag) as xs from lineitem group by 1)
  select l_orderkey, list_reduce(list_prepend(case when l_orderkey % 10 = 0 then repeat('x', 301) else 'MARK' end || ',SIZE', list_transform(xs, lambda x: x[1] || ',' || x[2])), lambda a, b: a || ';' || b) as cells, l_orderkey % 10 <> 0 as is_table from r""")
def clean_tables(spark, d):
    row = F.expr(r"if(l_linenumber % 2 = 0, array(concat(' ', l_returnflag, '|', l_linenumber), 'a\nb'), array(concat(l_returnflag, '|', l_linenumber, '\n')))")
    head = F.expr("array(array(if(l_orderkey % 10 = 0, repeat('x', 301), 'MARK'), 'SIZE'), array(' ', ''))")
    # an order's lines, a handful; the row of blanks goes
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", row.alias("r")))).alias("xs"))
    clean = listed.select("l_orderkey", headings.normal_rows(F.concat(head, F.transform("xs", lambda x: x["r"]))).alias("rows"))
    return clean.select("l_orderkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"), headings.is_table_like(F.col("rows")).alias("is_table"))


BOXES = """boxes as (select l_orderkey as page, l_partkey as box, l_linenumber, l_quantity as x0, l_quantity + l_linenumber * 4 as x1, l_discount * 400 as y0, l_discount * 400 + l_tax * 100 as y1 from lineitem), tables_ as (select o_orderkey as page, 10.0 as tx0, 30.0 as tx1, 5.0 as ty0, 25.0 as ty1 from orders where o_orderkey % 2 = 0)"""


def _boxes(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as page", "l_partkey as box", "l_linenumber", "l_quantity as x0", "l_quantity + l_linenumber * 4 as x1", "l_discount * 400 as y0", "l_discount * 400 + l_tax * 100 as y1")


@query(f"""with {BOXES} select page, box, l_linenumber, coalesce(bool_or(case when (x1 - x0) * (y1 - y0) <= 0 then true else greatest(0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0, least(y1, ty1) - greatest(y0, ty0)) / ((x1 - x0) * (y1 - y0)) >= 0.5 end), false) as covered
  from boxes left join tables_ using (page) group by 1, 2, 3""")
def covered_blocks(spark, d):
    tables = table(spark, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_orderkey as page", "10D as tx0", "30D as tx1", "5D as ty0", "25D as ty1")
    box, other = {k: F.col(k) for k in ("x0", "x1", "y0", "y1")}, {k: F.col(f"t{k}") for k in ("x0", "x1", "y0", "y1")}
    # a page's boxes are grouped where they met its tables: as many tasks as the boxes need
    boxes, tasks = _boxes(spark, d), tasks_for(table(spark, d, "lineitem"))
    joined = boxes.repartition(tasks, "page").join(tables.repartition(tasks, "page"), "page", "left").withColumn("share", headings.covered_share(box, other))
    return joined.groupBy("page", "box", "l_linenumber").agg((F.max("share") >= 0.5).alias("covered"))


@query(f"with {BOXES} select page, round(min(x0), 6) as x0, round(min(y0), 6) as y0, round(max(x1), 6) as x1, round(max(y1), 6) as y1, count(*) as n, round(max(greatest(0, 10 - x1, x0 - 30, 5 - y1, y0 - 25)), 6) as furthest from boxes group by 1")
def page_extents(spark, d):
    gap = headings.axis_gap({k: F.col(k) for k in ("x0", "x1", "y0", "y1")}, {"x0": F.lit(10.0), "x1": F.lit(30.0), "y0": F.lit(5.0), "y1": F.lit(25.0)})
    ends = [F.round(f(c), 6).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return _boxes(spark, d).groupBy("page").agg(*ends, F.count("*").alias("n"), F.round(F.max(gap), 6).alias("furthest"))


@query("select p_partkey, case p_size % 3 when 0 then 'FORMING PLAN' when 1 then 'SLAB REINFORCING PLAN' end as series, case p_size % 3 when 0 then p_size when 1 then p_size end as low, case p_size % 3 when 0 then p_size + p_partkey % 9 when 1 then p_size end as high from part")
def plan_titles(spark, d):
    line = F.expr("case p_size % 3 when 0 then concat(' forming  plans - levels ', p_size, '-', p_size + p_partkey % 9) when 1 then concat('SLAB REINFORCING PLAN - LEVEL ', p_size) else concat(p_name, ' LEVEL') end")
    return table(spark, d, "part").select("p_partkey", domain.plan_title(line).alias("t")).select("p_partkey", "t.series", "t.low", "t.high")


@query("select p_partkey, case p_size % 7 when 0 then 'pile_cap' when 1 then 'wall_footing' when 2 then 'column' when 3 then 'beam' when 4 then 'slab' when 5 then 'wall' end as family, case when p_partkey % 2 = 0 then concat('S', length(cast(p_partkey as varchar)), 'x') end as shape from part")
def element_families(spark, d):
    mark = F.expr("case p_size % 7 when 0 then concat('pc-', p_size) when 1 then concat(' WF', p_size) when 2 then concat('C ', p_size) when 3 then concat('GB', p_size) when 4 then concat('SLAB-', p_size) when 5 then concat('W', p_size) else concat('Q', p_size) end")
    sheet = F.expr("if(p_partkey % 2 = 0, concat('S', p_partkey, 'B'), concat('ABCD', p_partkey))")
    return table(spark, d, "part").select("p_partkey", domain.element_family(mark).alias("family"), text.shape(sheet).alias("shape"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 3 = 0 then concat('file', l_suppkey, '.pdf') else concat('S-', l_suppkey) end || ', page ' || l_linenumber as label, l_returnflag <> 'N' as confident from lineitem")
def source_labels(spark, d):
    sheet = F.expr("case l_suppkey % 3 when 0 then if(l_suppkey % 2 = 0, null, '  ') else concat(' S-', l_suppkey) end")
    level = F.expr("case l_returnflag when 'A' then 'high' when 'R' then 'medium' else 'low' end")
    label = domain.source_label(sheet, F.expr("concat('file', l_suppkey, '.pdf')"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", label.alias("label"), domain.meets_confidence(level, "medium").alias("confident"))


@query("select doc_id, length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) as removed, concat('a', 4500 + doc_id, ' and 1,2') as numbers from (select doc_id, coalesce(text, '') as t from documents)")
def clean_texts(spark, d):
    whole = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", (F.length(whole) - F.length(text.without_controls(whole))).alias("removed"), text.plain_numbers(F.expr("concat('a', format_number(4500 + doc_id, 0), ' and 1,2')")).alias("numbers"))


@query("select p_partkey, p_size % 3 = 0 as is_grounded from part")
def grounded_wordings(spark, d):
    wording = F.expr("concat('Sheet S-', 500 + p_size, ' shows ', case p_size % 3 when 1 then '12' else '4500' end, ' and ', if(p_size % 3 = 2, 'PC9', 'the cap'))")
    evidence = F.expr("concat('s-', 500 + p_size, ' PILE CAP 4,500 psi PC8')")
    return table(spark, d, "part").select("p_partkey", domain.grounded(wording, evidence).alias("is_grounded"))


@query("with t as (select distinct text from documents where text is not null), c as (select distinct text from documents where doc_id % 5 = 0) select 'cached' as state, count(*) as n from t where text in (select text from c where text is not null) union all select 'missing', count(*) from t where text not in (select text from c where text is not null)")
def cached_vectors(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    cache = docs.filter("doc_id % 5 = 0").select(text.text_hash(F.col("text")).alias("text_hash")).distinct().withColumn("vector", F.array(F.lit(1.0)))
    known, missing = retrieval.cached_or_missing(docs.select("text"), cache)
    count = lambda rows, state: rows.agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "n")
    return count(known, "cached").unionByName(count(missing, "missing"))


@query("select p_partkey, coalesce(nullif(p_brand, 'Brand#13'), case when p_partkey % 3 = 0 then p_type end) as title, case when p_partkey % 3 = 0 and p_size % 2 = 0 then p_size + 1 else p_size end as level from part")
def filled_page_info(spark, d):
    parts = table(spark, d, "part")
    stored = parts.selectExpr("p_partkey", "nullif(p_brand, 'Brand#13') as title", "p_size as level")
    read = parts.filter("p_partkey % 3 = 0").selectExpr("p_partkey", "p_type as title", "if(p_size % 2 = 0, p_size + 1, null) as level")
    return merge.filled_gaps(merge.filled_gaps(stored, read, "p_partkey", ["title"]), read, "p_partkey", ["level"], replace=True)


@query("with s as (select l_suppkey as project, l_returnflag as discipline, min(l_orderkey) as portion_id, count(*) as n from lineitem where l_linestatus = 'F' group by 1, 2), w as (select l_suppkey as project, l_returnflag as discipline, 1000000 + l_suppkey as portion_id, count(*) as n from lineitem where l_quantity > 40 group by 1, 2) select project, discipline, coalesce(s.portion_id, w.portion_id) as portion_id, w.n from w left join s using (project, discipline)")
def upserted_portions(spark, d):
    lines = table(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "project", "l_returnflag": "discipline"})
    stored = lines.filter("l_linestatus = 'F'").groupBy("project", "discipline").agg(F.min("l_orderkey").alias("portion_id"), F.count("*").alias("n"))
    new = lines.filter("l_quantity > 40").groupBy("project", "discipline").agg(F.count("*").alias("n")).withColumn("portion_id", F.col("project") + 1_000_000)
    return merge.upsert_keeping(stored, new.select(*stored.columns), ["project", "discipline"], "portion_id")


@query("select check_type, rank, key, place from (select l_suppkey % 40 as check_type, l_linenumber as rank, l_orderkey * 1000000 + l_partkey as key, row_number() over (partition by l_suppkey % 40 order by l_linenumber, l_orderkey * 1000000 + l_partkey) as place from lineitem) where place <= 100")
def capped_findings(spark, d):
    found = table(spark, d, "lineitem").selectExpr("l_suppkey % 40 as check_type", "l_linenumber as rank", "l_orderkey * 1000000 + l_partkey as key")
    return numbering.capped(found, "check_type", "rank", "key")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_counts(spark, d):
    found = jobs.per_window(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", "event_type")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
