"""Registered queries of the domain rules and scopes, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain
from ..operators import scope
from ..sources.tables import table
from .queries import query


@query("with t as (select p_partkey, case p_partkey % 6 when 0 then concat('plan level 0', p_size % 10) when 1 then concat('BASEMENT LEVEL ', p_size) when 2 then concat('lower level ', p_size) when 3 then concat('Level B', p_size % 10) when 4 then 'ROOF' else concat('LEVEL ', p_size) end as title from part) select p_partkey, case p_partkey % 6 when 0 then concat('LEVEL ', right(title, 1)) when 1 then concat('LEVEL B', split_part(title, ' ', 3)) when 2 then upper(title) when 3 then upper(title) when 4 then null else title end as level from t")
def levels_of_titles(spark, d):
    titles = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 6 when 0 then concat('plan level 0', p_size % 10) when 1 then concat('BASEMENT LEVEL ', p_size) when 2 then concat('lower level ', p_size) when 3 then concat('Level B', p_size % 10) when 4 then 'ROOF' else concat('LEVEL ', p_size) end as title")
    return titles.select("p_partkey", domain.level_of(F.col("title")).alias("level"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'structural' when 1 then 'architectural' when 2 then 'mechanical' else null end as discipline from part")
def disciplines_by_rules(spark, d):
    pages = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then concat('LICENSE NO. F-1105\\nSEE A-', 100 + p_size, ' FOR NOTES\\nS-', 200 + p_size) when 1 then concat('job no G-', 1000 + p_size, '\\ntype A-', 10 + p_size, ' here') when 2 then 'TYPE E2\\nM1' else p_name end as text")
    return pages.select("p_partkey", domain.discipline_by_rules(F.col("text")).alias("discipline"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'architectural' when p_partkey % 3 = 1 then 'fire_alarm' end as discipline from part")
def disciplines_by_filename(spark, d):
    names = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then concat(' a', 10 + p_size, '-11 plans.pdf') when 1 then concat('_FA-', 100 + p_size, '.pdf') else concat('notes ', p_size, '.pdf') end as filename")
    return names.select("p_partkey", domain.discipline_by_filename(F.col("filename")).alias("discipline"))


STATUS = "case o_orderkey % 5 when 0 then 'draft' when 1 then 'open' when 2 then 'answered' when 3 then 'closed' else 'voided' end"


@query(f"with r as (select o_orderkey, o_custkey, o_orderdate, {STATUS} as status from orders) select o_orderkey, status, case when status in ('draft', 'answered') then o_custkey when status = 'open' then o_orderkey % 100 end as court, status in ('open', 'draft') and o_orderdate < timestamp '1998-01-01' as overdue from r")
def issue_log(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate", f"{STATUS} as status")
    court = domain.ball_in_court(F.col("status"), F.col("o_custkey"), F.col("o_orderkey") % 100)
    return rows.select("o_orderkey", "status", court.alias("court"), domain.is_overdue(F.col("status"), F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("overdue"))


@query(f"with r as (select o_orderkey, {STATUS} as a, case o_orderkey % 3 when 0 then 'open' when 1 then 'closed' else 'voided' end as b from orders) select o_orderkey, (a = 'draft' and b in ('open', 'voided')) or (a = 'open' and b = 'voided') or (a = 'answered') as allowed from r")
def status_transitions(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{STATUS} as a", "case o_orderkey % 3 when 0 then 'open' when 1 then 'closed' else 'voided' end as b")
    return rows.select("o_orderkey", domain.can_transition(F.col("a"), F.col("b")).alias("allowed"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(case l_linenumber % 3 when 0 then 5 + 75 * least(1, l_quantity / 40) when 1 then 85 + 13 * least(1, l_quantity / 40) else 0 end + 0.5) as int) as percent from lineitem")
def stage_percents(spark, d):
    stage = F.expr("case l_linenumber % 3 when 0 then 'extract' when 1 then 'embed' else 'other' end")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", domain.stage_percent(stage, F.col("l_quantity"), F.lit(40)).alias("percent"))


def _uuid(c: str) -> str:
    return f"concat('00000000-0000-4000-8000-', lpad(cast({c} as string), 12, '0'))"


@query("with e as (select event_id, lpad(cast(event_id % 97 as varchar), 12, '0') as a, lpad(cast(event_id % 89 as varchar), 12, '0') as b from events) select event_id, case when a = b then concat('00000000-0000-4000-8000-', a) else concat('00000000-0000-4000-8000-', a, ',00000000-0000-4000-8000-', b) end as cited from e")
def cited_sources(spark, d):
    answers = table(spark, d, "events").selectExpr("event_id", f"concat('As shown [chunk:', {_uuid('event_id % 97')}, ', chunk: ', {_uuid('event_id % 89')}, '] and [CHUNK:', {_uuid('event_id % 97')}, '], not ', {_uuid('event_id')}) as answer")
    return answers.select("event_id", F.array_join(domain.cited_ids(F.col("answer")), ",").alias("cited"))


@query("select event_id, case when event_id % 4 = 3 then null else concat('k', event_id % 7) end as sources, case when event_id % 4 = 3 then null else 1 end as n_items from events")
def parsed_summaries(spark, d):
    raw = "case when event_id % 4 = 3 then 'not json' else concat('{\"overview\": \"o\", \"items\": [{\"text\": \"a\", \"chunkIds\": [\"k', event_id % 7, '\", \"zz\"]}, {\"text\": \"b\", \"chunkIds\": [\"zz\"]}, {\"text\": \" \", \"chunkIds\": [\"k1\"]}]}') end as raw"
    allowed = F.array(*[F.lit(f"k{i}") for i in range(7)])
    parsed = table(spark, d, "events").selectExpr("event_id", raw).select("event_id", domain.summary(F.col("raw"), allowed).alias("s"))
    return parsed.select("event_id", F.array_join(domain.sources_of(F.col("s")), ",").alias("sources"), F.when(F.col("s").isNotNull(), F.size("s.items")).alias("n_items"))


@query("select doc_id, doc_id % 2 = 0 as by_name, doc_id % 3 = 0 as by_text from documents")
def request_forms(spark, d):
    names = F.expr("if(doc_id % 2 = 0, concat('site_RFI-', doc_id, '.pdf'), concat('surfing ', doc_id, '.pdf'))")
    planted = F.expr("if(doc_id % 3 = 0, 'REQUEST FOR  INFORMATION\\nQuestion: x\\nResponse: y\\n', 'QUESTION and question: send an RFI\\n')")
    # a planted form or the document's own; apart, so that planted words are no field of the document's. The SQL knows the planted ones alone
    by_text = domain.is_request_text(F.col("text")) | domain.is_request_text(planted)
    return table(spark, d, "documents").select("doc_id", domain.is_request_name(names).alias("by_name"), by_text.alias("by_text"))


@query("with p as (select l_suppkey as review, l_orderkey * 10 + l_linenumber as page_id, l_returnflag = 'R' and l_quantity > 45 as must, sum(l_extendedprice) as score from lineitem group by all), r as (select review, page_id, row_number() over (partition by review order by must desc, round(score, 2) desc, page_id, must) as place from p) select review, page_id, place, place <= 50 as kept from r")
def review_scope(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("review"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"), F.expr("l_returnflag = 'R' and l_quantity > 45").alias("must")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return scope.ranked_scope(pages, "review", 50).select("review", "page_id", "place", "kept")


@query("with e as (select l_partkey as finding, l_returnflag as side, l_suppkey % 4 as sheet, l_orderkey * 10 + l_linenumber as evidence_id from lineitem group by all), a as (select *, row_number() over (partition by finding, side, sheet order by evidence_id) as again from e), t as (select *, row_number() over (partition by finding, side order by again, evidence_id) as turn from a), p as (select *, row_number() over (partition by finding order by turn, side, evidence_id) as place from t) select finding, side, sheet, evidence_id, place from p where place <= 5")
def picked_evidence(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_partkey as finding", "l_returnflag as side", "l_suppkey % 4 as sheet", "l_orderkey * 10 + l_linenumber as evidence_id").distinct()
    return scope.picked_evidence(rows, "finding")


@query("with a as (select c_custkey as ask_id, case when c_custkey % 2 = 0 then concat('S-', c_custkey) else concat('s', c_custkey) end as sheet from customer), p as (select p_partkey as page_id, concat('S-', p_partkey) as sheet from part) select ask_id, page_id, case when ask_id % 2 = 0 then 1 else 2 end as tier from a join p on upper(replace(a.sheet, '-', '')) = replace(p.sheet, '-', '')")
def resolved_sheets(spark, d):
    asked = table(spark, d, "customer").selectExpr("c_custkey as ask_id", "if(c_custkey % 2 = 0, concat('S-', c_custkey), concat('s', c_custkey)) as sheet")
    return scope.resolved_sheets(asked, table(spark, d, "part").selectExpr("p_partkey as page_id", "concat('S-', p_partkey) as sheet"))


@query("with o as (select o_orderkey as project, o_custkey as user_id, 'owner' as role from orders where o_orderkey % 4 <> 0 and o_custkey in (select c_custkey from customer)), m as (select distinct l_orderkey as project, l_suppkey as user_id, 'member' as role from lineitem where l_suppkey in (select c_custkey from customer)) select * from o union select m.* from m where not exists (select 1 from o where o.project = m.project and o.user_id = m.user_id)")
def project_access(spark, d):
    projects = table(spark, d, "orders").selectExpr("o_orderkey as project", "if(o_orderkey % 4 = 0, null, o_custkey) as owner")
    members = table(spark, d, "lineitem").selectExpr("l_orderkey as project", "l_suppkey as user_id")
    return scope.accessible(projects, members, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")))


@query("with s as (select o_custkey as project, o_orderkey as session_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as at_ from orders), l as (select l_orderkey as session_id, max(l_shipdate) as last_at from lineitem group by 1), r as (select project, session_id, last_at, row_number() over (partition by project order by last_at desc, session_id desc) as place from s join l using (session_id) where at_ <= 300 and last_at >= timestamp '1998-01-01') select project, session_id, place from r where place <= 50")
def recent_sessions(spark, d):
    sessions = table(spark, d, "orders").selectExpr("o_custkey as project", "o_orderkey as session_id", "o_orderdate as created_at")
    messages = table(spark, d, "lineitem").selectExpr("l_orderkey as session_id", "l_shipdate as sent_at")
    return scope.recent_sessions(sessions, messages, "project", F.lit("1998-01-01").cast("timestamp")).select("project", "session_id", "place")


@query("with a as (select p_brand as question, case p_size % 5 when 0 then 'agree' when 1 then 'issues' when 2 then 'not_shown' else 'unclear' end as answer from part) select question, count(*) filter (where answer = 'agree') as agree, count(*) filter (where answer = 'issues') as issues, count(*) filter (where answer = 'not_shown') as not_shown, count(*) filter (where answer = 'unclear') as unclear from a group by 1")
def question_results(spark, d):
    return scope.question_results(table(spark, d, "part").selectExpr("p_brand as question", "case p_size % 5 when 0 then 'agree' when 1 then 'issues' when 2 then 'not_shown' else 'unclear' end as answer"))


@query("select l_orderkey as set_id, substr(sha256(string_agg(concat_ws('|', l_returnflag, l_partkey, l_suppkey), '\n' order by concat_ws('|', l_returnflag, l_partkey, l_suppkey))), 1, 16) as fingerprint from lineitem group by 1")
def set_fingerprints(spark, d):
    cases = table(spark, d, "lineitem").selectExpr("l_orderkey as set_id", "l_returnflag as tag", "cast(l_partkey as string) as question", "cast(l_suppkey as string) as expected")
    return scope.set_fingerprint(cases, "set_id")


@query("with r as (select o_custkey as project, o_orderkey as run_id, case when o_orderkey % 9 = 0 then null else o_totalprice end as cost from orders), l as (select *, lag(cost) over (partition by project order by run_id) as before from r) select run_id, round(cost - before, 6) as difference, round(100 * (cost - before) / before, 6) as percent from l")
def run_differences(spark, d):
    runs = table(spark, d, "orders").selectExpr("o_custkey as project", "o_orderkey as run_id", "if(o_orderkey % 9 = 0, null, o_totalprice) as cost")
    return scope.run_differences(runs, "project").select("run_id", "difference", "percent")
