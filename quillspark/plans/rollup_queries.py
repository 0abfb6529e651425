"""Registered queries of rollups, rules and prices, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import rollups, tiers
from ..sources.tables import shared_path, table
from .queries import query

NOW = "timestamp '2024-02-01 00:00:00'"

# Lines as pages of a supplier's project, orders as their documents.
PAGES = """pages_ as (select l_suppkey as project, l_orderkey * 10 + l_linenumber as page_id, l_orderkey as combined_page, nullif(l_returnflag, 'R') as discipline, l_linestatus = 'F' as processed,
  case when l_tax > 0.06 then null when l_tax > 0.03 then 'plan' when l_tax > 0.01 then 'enlarged_plan' else 'detail' end as sheet_kind, case when l_discount > 0.08 then l_shipdate end as superseded_at from lineitem)"""
USAGE = """usage as (select user_id % 10 as project, case when event_type = 'error' then 'chat' else concat('process:', case event_id % 3 when 0 then 'A' when 1 then 'N' else 'unsorted' end) end as stage,
  event_id % 1000 as tokens, case when event_id % 7 = 0 then null else event_id % 100 / 8.0 end as cost from events)"""
PORTIONS = "portions as (select s_suppkey * 2 + k as portion_id, s_suppkey as project, case k when 0 then 'A' else 'N' end as discipline from supplier, (values (0), (1)) t(k) where s_suppkey % 5 <> 0 or k = 0)"
CHUNKS = "chunks as (select l_orderkey * 10 + l_linenumber as page_id, l_partkey as chunk_id, case when l_quantity > 25 then 1 end as embedding_id, case when l_quantity < 10 then l_suppkey * 2 end as portion_id from lineitem)"
RUNS = f"""runs as (select event_id, case event_id % 9 when 0 then 'planning' when 1 then 'queued' when 2 then 'running' when 3 then 'cancelled' when 4 then 'stale' when 5 then 'ready' when 6 then 'partial' when 7 then 'planned' else 'failed' end as status,
  case when event_id % 4 = 0 then ts + interval '25 days' end as heartbeat, case when event_id % 3 = 0 then ts end as started, ts as created, event_id % 5 as total from events)"""


def pages(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_suppkey as project", "l_orderkey * 10 + l_linenumber as page_id", "l_orderkey as combined_page", "nullif(l_returnflag, 'R') as discipline", "l_linestatus = 'F' as processed",
        "case when l_tax > 0.06 then null when l_tax > 0.03 then 'plan' when l_tax > 0.01 then 'enlarged_plan' else 'detail' end as sheet_kind", "if(l_discount > 0.08, l_shipdate, null) as superseded_at",
    )


def usage(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id % 10 as project", "if(event_type = 'error', 'chat', concat('process:', case event_id % 3 when 0 then 'A' when 1 then 'N' else 'unsorted' end)) as stage", "event_id % 1000 as tokens", "if(event_id % 7 = 0, null, event_id % 100 / 8D) as cost",
    )


def portions(spark, d) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.explode(F.expr("if(s_suppkey % 5 <> 0, array(0, 1), array(0))")).alias("k"))
    return rows.selectExpr("project * 2 + k as portion_id", "project", "if(k = 0, 'A', 'N') as discipline")


def chunks(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as page_id", "l_partkey as chunk_id", "if(l_quantity > 25, 1, null) as embedding_id", "if(l_quantity < 10, l_suppkey * 2, null) as portion_id")


def runs(spark, d) -> DataFrame:
    status = "element_at(array('planning', 'queued', 'running', 'cancelled', 'stale', 'ready', 'partial', 'planned', 'failed'), cast(event_id % 9 as int) + 1) as status"
    return table(spark, d, "events").selectExpr("event_id", status, "if(event_id % 4 = 0, ts + interval 25 days, null) as heartbeat", "if(event_id % 3 = 0, ts, null) as started", "ts as created", "event_id % 5 as total")


@query(f"with {USAGE} select project, substr(stage, 9) as discipline, coalesce(sum(cost), 0) as cost_usd, sum(tokens) as tokens from usage where starts_with(stage, 'process:') group by 1, 2")
def processing_spend(spark, d):
    return rollups.processing_spend(usage(spark, d))


@query(f"""with {PAGES}, {USAGE}, spend as (select project, substr(stage, 9) as discipline, coalesce(sum(cost), 0) as cost_usd, sum(tokens) as tokens from usage where starts_with(stage, 'process:') group by 1, 2),
  counts as (select project, coalesce(discipline, 'unsorted') as discipline, count(*) as n_pages, count(*) filter (where processed) as n_processed from pages_ group by 1, 2)
  select c.project, c.discipline, n_pages, n_processed, coalesce(s_suppkey % 5 = 0 or c.discipline in ('A', 'unsorted'), false) as is_chosen, coalesce(cost_usd, 0) as cost_usd, coalesce(tokens, 0) as tokens
  from counts c left join supplier on s_suppkey = c.project left join spend s on s.project = c.project and s.discipline = c.discipline""")
def processing_state(spark, d):
    projects = table(spark, d, "supplier").selectExpr("s_suppkey as project", "s_suppkey % 5 = 0 as process_all", "array('A', 'unsorted') as chosen")
    return rollups.processing_state(pages(spark, d), projects, rollups.processing_spend(usage(spark, d)))


@query(f"with {PAGES} select project, discipline, count(*) as sheets, case when count(sheet_kind) > 0 then count(*) filter (where sheet_kind in ('plan', 'enlarged_plan')) end as plans from pages_ where discipline is not null group by 1, 2")
def project_disciplines(spark, d):
    return rollups.project_disciplines(pages(spark, d))


@query("select user_id as run_id, count(*) as n from events group by 1")
def candidate_counts(spark, d):
    return rollups.counts_by(table(spark, d, "events").selectExpr("user_id as run_id"), "run_id")


@query(f"with {RUNS} select status, total as level, count(*) as n from runs group by 1, 2")
def summary_status_counts(spark, d):
    return rollups.counts_by(runs(spark, d).selectExpr("status", "total as level"), "status", "level")


@query("select l_orderkey as page_id, sum(len(p_name) // 4) as tokens from lineitem join part on p_partkey = l_partkey group by 1")
def tokens_per_page(spark, d):
    texts = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return texts.selectExpr("l_orderkey as page_id", "length(p_name) div 4 as n").groupBy("page_id").agg(F.sum("n").alias("tokens"))


@query(f"with {PAGES}, {PORTIONS} select portion_id, page_id from portions join pages_ using (project, discipline) where superseded_at is null")
def portion_page_ids(spark, d):
    return rollups.portion_pages(portions(spark, d), pages(spark, d))


@query(f"with {PAGES}, {PORTIONS}, {CHUNKS} select c.page_id, c.chunk_id, c.embedding_id, coalesce(po.portion_id, c.portion_id) as portion_id from chunks c left join (select distinct page_id, po.portion_id from pages_ join portions po using (project, discipline)) po using (page_id)")
def chunk_portions(spark, d):
    one = pages(spark, d).select("project", "page_id", "discipline").distinct()
    return rollups.assigned_portions(chunks(spark, d), one, portions(spark, d))


@query(f"with {PAGES}, {PORTIONS}, {CHUNKS} select chunk_id, page_id, combined_page, c.portion_id, po.discipline as portion_discipline, p.discipline as page_discipline from chunks c join pages_ p using (page_id) left join portions po on po.portion_id = c.portion_id where embedding_id is null")
def chunks_to_embed(spark, d):
    return rollups.waiting_chunks(chunks(spark, d), pages(spark, d), portions(spark, d))


@query("with e as (select l_suppkey as set_id, case when l_orderkey % 97 = 0 then null else l_extendedprice end as low, case when l_partkey % 89 = 0 then null else l_extendedprice * 2 end as high from lineitem) select set_id, case when count(low + high) = count(*) then sum(low) end as low, case when count(low + high) = count(*) then sum(high) end as high from e group by 1")
def set_costs(spark, d):
    return rollups.set_cost(table(spark, d, "lineitem").selectExpr("l_suppkey as set_id", "if(l_orderkey % 97 = 0, null, l_extendedprice) as low", "if(l_partkey % 89 = 0, null, l_extendedprice * 2) as high"), "set_id")


@query("""with s as (select l_suppkey as sheet, l_linenumber as family, l_partkey % 11 as strokes, l_quantity as width, l_tax * 500 as height from lineitem),
  r as (select sheet, family, list_sort(list(strokes)) as st, list_sort(list(greatest(width, height))) as lo, list_sort(list(least(width, height))) as sh, count(*) as n from s where strokes >= 4 group by 1, 2)
  select sheet, family, st[1 + floor(0.1 * (n - 1))::int]::double as fewest, 2.5 * st[1 + floor(0.9 * (n - 1))::int]::double as most, 0.8 * lo[1 + floor(0.1 * (n - 1))::int] as shortest_long,
    1.4 * lo[1 + floor(0.9 * (n - 1))::int] as longest_long, greatest(2.0, 0.8 * sh[1 + floor(0.1 * (n - 1))::int]) as shortest_short from r where n >= 8 and lo[1 + floor(0.1 * (n - 1))::int] >= 6""")
def symbol_ranges(spark, d):
    symbols = table(spark, d, "lineitem").selectExpr("l_suppkey as sheet", "l_linenumber as family", "l_partkey % 11 as strokes", "l_quantity as width", "l_tax * 500 as height")
    return rollups.symbol_range(symbols, "sheet", "family")


SHOWN = f"case when status in ('planning', 'queued', 'running') and epoch_us({NOW}) - epoch_us(coalesce(heartbeat, started, created)) >= 600000000 then 'failed' else status end"


@query(f"with {RUNS}, s as (select *, {SHOWN} as shown from runs) select event_id, shown, coalesce(shown in ('partial', 'failed') and total > 0, false) as resumable, shown in ('cancelled', 'stale', 'ready', 'partial', 'planned') or (shown = 'failed' and started is null) as plannable from s")
def shown_statuses(spark, d):
    seen = F.coalesce("heartbeat", "started", "created")
    shown = runs(spark, d).withColumn("shown", rules.shown_status(F.col("status"), seen, F.expr(NOW)))
    return shown.select("event_id", "shown", rules.can_resume(F.col("shown"), F.col("total")).alias("resumable"), rules.can_plan_again(F.col("shown"), F.col("started")).alias("plannable"))


@query(f"""with j as (select event_id, case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'done' end as status, ts, case event_id % 5 when 0 then null when 1 then 'gone' when 2 then 'failed' when 3 then 'active' else 'waiting' end as job, case when event_id % 3 > 0 then ts + interval '20 days' end as started from events)
  select event_id, coalesce(status in ('queued', 'running') and case when job is null then epoch_us({NOW}) - epoch_us(ts) > 600000000 when job in ('gone', 'failed') then true else job = 'active' and started is not null and epoch_us({NOW}) - epoch_us(started) > 600000000 end, false) as stale from j""")
def stale_packages(spark, d):
    jobs = table(spark, d, "events").selectExpr(
        "event_id", "ts", "element_at(array('queued', 'running', 'done', null), cast(event_id % 4 as int) + 1) as status", "element_at(array(null, 'gone', 'failed', 'active', 'waiting'), cast(event_id % 5 as int) + 1) as job", "if(event_id % 3 > 0, ts + interval 20 days, null) as started",
    )
    return jobs.select("event_id", rules.package_is_stale(F.col("status"), F.col("ts"), F.col("job"), F.col("started"), F.expr(NOW)).alias("stale"))


SCOPES = "(values ('all', 'all'), ('A', 'all'), ('A', 'A'), ('A', 'N')) s(a, b)"


@query(f"""select distinct a, b, l_returnflag as first, nullif(l_linestatus, 'F') as second,
  case when a = 'all' and b = 'all' then true when b = 'all' then coalesce(l_returnflag = a, false) or coalesce(nullif(l_linestatus, 'F') = a, false)
    else (l_returnflag is not distinct from a and nullif(l_linestatus, 'F') is not distinct from b) or (l_returnflag is not distinct from b and nullif(l_linestatus, 'F') is not distinct from a) end as compared from (select l_returnflag, case when l_tax > 0.04 then 'A' when l_tax > 0.02 then 'N' else l_linestatus end as l_linestatus from lineitem), {SCOPES}""")
def scope_pairs(spark, d):
    scopes = spark.createDataFrame([("all", "all"), ("A", "all"), ("A", "A"), ("A", "N")], "a string, b string")
    pairs = table(spark, d, "lineitem").selectExpr("l_returnflag as first", "nullif(case when l_tax > 0.04 then 'A' when l_tax > 0.02 then 'N' else l_linestatus end, 'F') as second").distinct()
    rows = pairs.join(F.broadcast(scopes), F.lit(True))  # four scopes
    return rows.select("a", "b", "first", "second", rules.pair_in(F.col("a"), F.col("b"), F.col("first"), F.col("second")).alias("compared"))


@query("""with f as (select event_id, list_distinct(list_filter([case when event_id % 3 = 0 then 'A' end, case when event_id % 4 = 0 then 'N' end, case when event_id % 5 = 0 then 'S' end], lambda x: x is not null)) as known, case event_id % 7 when 0 then 'all' else 'A' end as a, case event_id % 7 when 0 then 'all' when 1 then 'all' when 2 then 'A' when 3 then 'A' else 'N' end as b from events)
  select event_id, case when a = 'all' and b = 'all' then true when len(known) = 0 then false when b = 'all' then list_contains(known, a) when a = b then len(known) = 1 and list_contains(known, a)
    when len(known) = 1 then list_contains(known, a) or list_contains(known, b) else list_contains(known, a) and list_contains(known, b) end as inside from f""")
def scope_findings(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "array(if(event_id % 3 = 0, 'A', null), if(event_id % 4 = 0, 'N', null), if(event_id % 5 = 0, 'S', null)) as disciplines", "if(event_id % 7 = 0, 'all', 'A') as a", "element_at(array('all', 'all', 'A', 'A', 'N', 'N', 'N'), cast(event_id % 7 as int) + 1) as b",
    )
    return rows.select("event_id", rules.finding_in(F.col("a"), F.col("b"), F.col("disciplines")).alias("inside"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(l_discount / 10 >= 0.002 and l_tax / 20 >= 0.002, false) as plausible from lineitem")
def plausible_boxes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.is_plausible_box(F.col("l_discount") / 10, F.col("l_tax") / 20).alias("plausible"))


@query("""with l as (select l_orderkey, l_partkey, l_linenumber, case when l_suppkey % 3 = 0 then null else concat('A-', l_suppkey) end as sheet, case when l_suppkey % 2 = 0 then l_suppkey end as combined from lineitem),
  f as (select l_orderkey, coalesce(sheet, concat('(page ', coalesce(combined, l_linenumber), ')')) as name, coalesce(combined, l_linenumber) as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, sheet nulls first, combined nulls first) as k from l),
  n as (select l_orderkey, name, min(k) as k from f group by 1, 2), g as (select l_orderkey, string_agg(name, ', ' order by k) as sheets from n group by 1)
  select l_orderkey, sheets, array_to_string(list_sort(list(distinct page)), ', ') as pages from f join g using (l_orderkey) group by 1, 2""")
def location_lists(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber as k, l_partkey as p, if(l_suppkey % 3 = 0, null, concat('A-', l_suppkey)) as sheet, if(l_suppkey % 2 = 0, l_suppkey, null) as combined, cast(l_linenumber as bigint) as page) as x")
    # an order's lines, a handful
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select("l_orderkey", rules.sheet_list(F.col("xs")).alias("sheets"), rules.page_list(F.col("xs")).alias("pages"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as due from orders")
def iso_dates(spark, d):
    texts = F.expr("case o_orderkey % 8 when 0 then null when 4 then 'soon' else date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") end")
    return table(spark, d, "orders").select("o_orderkey", rules.iso_date(texts).alias("due"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 0 else year(o_orderdate) end as y, case when o_orderkey % 5 = 0 then 0 else month(o_orderdate) end as m, case when o_orderkey % 5 = 0 then 0 else day(o_orderdate) end as d from (select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 then o_orderdate + interval '20 years' else o_orderdate end as o_orderdate from orders)")
def date_keys(spark, d):
    date = "if(o_orderkey % 3 = 0, o_orderdate + interval 20 years, o_orderdate)"
    text = F.expr(f"case when o_orderkey % 5 = 0 then '' when o_orderkey % 3 = 0 then date_format({date}, 'M/d/yy') else date_format({date}, 'MM-dd-yyyy') end")
    return table(spark, d, "orders").select("o_orderkey", rules.date_key(text).alias("k")).select("o_orderkey", "k.*")


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 4 = 0 then null else l_quantity - 1 end as base, l_quantity * l_discount as other, l_returnflag = 'A' as a, l_linestatus = 'F' as b from lineitem)
  select l_orderkey, l_linenumber, l_partkey, round(other - base, 6) as usd, round(case when base > 0 then (other - base) / base * 100 end, 6) as percent, array_to_string(list_filter([case when a then 'other target' end, case when b then 'other checks' end, case when not a and not b then 'same work' end], lambda x: x is not null), '; ') as notes from r""")
def run_costs_compared(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "if(l_suppkey % 4 = 0, null, l_quantity - 1) as base", "l_quantity * l_discount as other", "l_returnflag = 'A' as a", "l_linestatus = 'F' as b")
    usd, percent = rules.cost_difference(F.col("base"), F.col("other"))
    notes = rules.caveats({"other target": F.col("a"), "other checks": F.col("b"), "same work": ~F.col("a") & ~F.col("b")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(usd, 6).alias("usd"), F.round(percent, 6).alias("percent"), F.array_join(notes, "; ").alias("notes"))


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_concat(['A', p_brand], case when p_size % 2 = 0 then [p_type, 'A'] else [] end, case when p_size % 5 = 0 then ['S', p_brand, 'unsorted'] else [] end))), ',') as chosen from part")
def chosen_disciplines(spark, d):
    empty = "cast(array() as array<string>)"
    chosen = rules.chosen_after(F.expr("array('A', p_brand)"), F.expr(f"if(p_size % 2 = 0, array(p_type, 'A'), {empty})"), F.expr("array('S', p_brand)"), F.expr("p_size % 5 = 0"))
    return table(spark, d, "part").select("p_partkey", F.array_join(chosen, ",").alias("chosen"))


@query("select doc_id, case when doc_id % 3 = 0 then 1 else greatest(1, length(coalesce(text, '')) // 4) + greatest(1, length(source) // 4) end as units from documents")
def billable_units(spark, d):
    texts = F.array(F.coalesce("text", F.lit("")), F.col("source"))
    return table(spark, d, "documents").select("doc_id", rules.billable_units(F.expr("if(doc_id % 3 = 0, 'search', 'tokens')"), texts).alias("units"))


PLANS = """plans as (select l_orderkey, l_linenumber, l_partkey, l_partkey * 100 as input, l_suppkey * 10 as output, l_linenumber * 1000 as v_in, l_linenumber * 50 as v_out, case l_suppkey % 3 when 0 then 3.0 when 1 then 1.0 end as rate_in, case l_suppkey % 3 when 0 then 15.0 when 1 then 5.0 end as rate_out, l_returnflag = 'R' as batch, l_quantity as limit_, l_orderkey % 6 as tiles, l_tax > 0.01 as has_key from lineitem)"""


@query(f"""with {PLANS}, p as (select *, (input * rate_in + output * rate_out) / 1e6 as disc, (v_in * rate_in + v_out * rate_out) / 1e6 as ver from plans),
  q as (select *, disc * case when batch then 0.5 else 1 end + ver as low, disc * case when batch then 0.5 else 1 end + 3 * ver as high from p)
  select l_orderkey, l_linenumber, l_partkey, round(low, 8) as low, round(high, 8) as high, floor(case when limit_ > 0 then limit_ / ((greatest(1, input) * rate_in + output * rate_out) / 1e6 / (greatest(1, input) + output)) end)::bigint as ceiling,
    case when tiles <= 0 then 'nothing' when not has_key then 'no_key' when high is null then 'no_price' when high > limit_ / 20 then 'over_limit' else 'started' end as decision from q""")
def plan_prices(spark, d):
    plans = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_partkey * 100 as input", "l_suppkey * 10 as output", "l_linenumber * 1000 as v_in", "l_linenumber * 50 as v_out", "element_at(array(3D, 1D, null), cast(l_suppkey % 3 as int) + 1) as rate_in",
        "element_at(array(15D, 5D, null), cast(l_suppkey % 3 as int) + 1) as rate_out", "l_returnflag = 'R' as batch", "l_quantity as budget", "l_orderkey % 6 as tiles", "l_tax > 0.01 as has_key",
    )
    estimate = {"input": F.col("input"), "output": F.col("output"), "verify_input_low": F.col("v_in"), "verify_output_low": F.col("v_out"), "verify_input_high": F.col("v_in") * 3, "verify_output_high": F.col("v_out") * 3}
    low, high = rules.price_range(estimate, F.col("rate_in"), F.col("rate_out"), F.col("batch"))
    ceiling = rules.budget_tokens(F.col("budget"), F.col("input"), F.col("output"), F.col("rate_in"), F.col("rate_out"))
    decision = rules.start_decision(F.col("tiles"), F.col("has_key"), high, F.col("budget") / 20)
    return plans.select("l_orderkey", "l_linenumber", "l_partkey", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"), ceiling.alias("ceiling"), decision.alias("decision"))


TIERED = """base as (select case when conv_id % 3 = 0 then 0 else conv_id % 7 + 1 end as project, role as portion, conv_id * 100 + turn as page, trim(substr(text, 1, 60)) as overview, substr(text, 1, 12) as item from conversations),
  portions as (select project, portion, min(page) as start_page, max(page) as end_page, left(trim(string_agg(overview, ' ' order by page) filter (where overview <> '')), 1500) as overview, array_to_string((list(item order by page))[1:8], '|') as items from base group by 1, 2)"""


def _tiered(spark, d):
    """Turns as pages of three projects' portions by role; a third of all turns are in one project."""
    turns = table(spark, d, "conversations").select(
        F.expr("if(conv_id % 3 = 0, 0L, conv_id % 7 + 1)").alias("project"), F.col("role").alias("portion"), F.expr("conv_id * 100 + turn").alias("page"), F.expr("trim(substr(text, 1, 60))").alias("overview"),
        F.expr("array(struct(substr(text, 1, 12) as text, array(cast(conv_id as string)) as chunk_ids, cast(conv_id * 100 + turn as bigint) as page))").alias("items"),
    )
    return tiers.rolled_up(turns, shared_path(spark, "tiers"))


@query(f"with {TIERED} select project, portion, start_page, end_page, overview, items from portions")
def tiered_portions(spark, d):
    return _tiered(spark, d)[0].withColumn("items", F.array_join(F.transform("items", lambda i: i["text"]), "|"))


@query(f"with {TIERED} select project, min(start_page) as start_page, max(end_page) as end_page, left(trim(string_agg(overview, ' ' order by portion) filter (where overview <> '')), 1500) as overview from portions group by 1")
def tiered_projects(spark, d):
    return _tiered(spark, d)[1].drop("items")
