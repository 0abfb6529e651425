"""Registered queries of models' replies: objects in prose, fenced, cut off, mended or wrongly typed, read by their parsers.

The replies are made of the tables' own texts and numbers; the SQL takes the values from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import reply_objects as ro
from ..sources.tables import table
from .queries import query

#: A text as the parsers clip it, in SQL: single spaces between words, cut with an ellipsis.
_CLIP = r"(select case when length(w) <= {n} then w else left(w, {n} - 1) || '…' end from (select trim(regexp_replace(coalesce({c}, ''), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) as w))"


def clip(column: str, most: int) -> str:
    return _CLIP.format(c=column, n=most)


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def _said(body: Column, turn: Column) -> Column:
    """Around an object: nothing, a fence and prose, prose alone, or only its first half."""
    half = F.left(body, F.floor(F.length(body) / 2).cast("int"))
    return F.when(turn % 4 == 0, body).when(turn % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(turn % 4 == 2, F.concat(F.lit("As asked, "), body, F.lit(" and that is all"))).otherwise(F.concat(half, F.lit(" ...")))


@query(f"""with d as (select *, {clip("text", 600)} as statement, {clip("source", 120)} as element from documents where doc_id % 4 < 3)
  select doc_id, 'C' || doc_id % 2 as check_id, element, statement, 2 as n_evidence, case when doc_id % 3 = 0 then 'high' else 'medium' end as confidence, 2 as dropped from d where statement <> '' and doc_id % 5 > 0
  union all select doc_id, null, null, null, 0, null, case when doc_id % 5 = 0 or statement = '' then 3 else 2 end from d""")
def discovery_replies(spark, d):
    """What a reading of each document observed, and how much of it cited nothing."""
    ok = F.struct(F.expr("if(doc_id % 5 = 0, 'C9', concat('C', doc_id % 2))").alias("checkId"), F.col("source").alias("element"), F.col("text").alias("statement"), _strings("e1", "e7", "e2", "e1").alias("evidenceIds"), F.expr("if(doc_id % 3 = 0, 'high', 'High')").alias("confidence"))
    body = F.to_json(F.struct(F.array(ok).alias("observations"), F.array(F.lit(1)).alias("gaps")))
    # one observation without evidence, one that is no object
    body = F.regexp_replace(body, r"\],\"gaps\"", ', {"checkId": "C0", "statement": "s", "evidenceIds": "e1"}, 7],"gaps"')
    found = ro.objects(table(spark, d, "documents").select("doc_id", _said(body, F.col("doc_id")).alias("raw")), "raw", "reply")
    read = found.select("doc_id", ro.discovery(F.col("reply"), _strings("e1", "e2"), _strings("C0", "C1")).alias("r"))
    nothing = F.lit(None).cast("string")
    row = lambda o: F.struct(o["check_id"].alias("check_id"), o["element"].alias("element"), o["statement"].alias("statement"), F.size(o["evidence"]).alias("n_evidence"), o["confidence"].alias("confidence"))
    total = F.struct(nothing.alias("check_id"), nothing.alias("element"), nothing.alias("statement"), F.lit(0).alias("n_evidence"), nothing.alias("confidence"))
    # a reply that has to be asked for again is null and gives no rows
    rows = read.select("doc_id", "r.dropped", F.explode(F.concat(F.transform("r.observations", row), F.array(total))).alias("o"))
    return rows.select("doc_id", "o.*", "dropped")


@query(f"""select p_partkey, name, case when state = 'supported' and p_size % 2 = 0 then value end as value, case when state = 'supported' and p_size % 2 = 1 then 'unknown' else state end as state, state = 'supported' and p_size % 2 = 0 and p_partkey % 3 = 0 as derived
  from part, (values (1, 'size'), (2, 'brand'), (3, 'type')) as n(k, name), lateral (select case k when 1 then cast(p_size as varchar) || '''-0"' when 2 then {clip("p_brand", 160)} else p_type end as value, case k when 3 then 'not_applicable' else 'supported' end as state)""")
def inventory_replies(spark, d):
    """Fields of inventoried parts: what no evidence supports is unknown. The inch marks aren't escaped."""
    evidence = "if(p_size % 2 = 0, '[\"e1\"]', '[\"e9\"]')"
    one = lambda name, value, state: f"concat('{{\"name\": \"{name}\", \"value\": \"', {value}, '\", \"state\": \"{state}\", \"derived\": ', if(p_partkey % 3 = 0, '1', '0'), ', \"evidenceIds\": ', {evidence}, '}}')"
    fields = ", ', ', ".join((one("size", "concat(p_size, '\\'-0\"')", "supported"), one("brand", "p_brand", "supported"), one("type", "p_type", "not_applicable")))
    raw = F.expr(f"concat('{{\"inventory\": [{{\"checkId\": \"C1\", \"entity\": \"', p_name, '\", \"fields\": [', {fields}, ']}}, {{\"entity\": \"no check\"}}]}}')")
    found = ro.objects(table(spark, d, "part").select("p_partkey", "p_size", raw.alias("raw")), "raw", "reply")
    rows = found.select("p_partkey", F.explode(ro.inventory(F.col("reply"), _strings("e1"), _strings("C1"))).alias("i")).select("p_partkey", F.explode("i.fields").alias("f"))
    return rows.select("p_partkey", "f.name", "f.value", "f.state", "f.derived")


@query(f"""with d as (select *, {clip("text", 600)} as issue from documents where doc_id % 4 < 3)
  select doc_id, (['conflict', 'missing', 'inconsistency', 'ambiguity'])[doc_id % 4 + 1] as kind, case when doc_id % 2 = 0 then 'needs_evidence' else 'rfi' end as disposition, issue, case when doc_id % 2 = 0 then {clip("lang", 160)} else '' end as search_for, 1 as dropped from d where issue <> ''""")
def candidate_replies(spark, d):
    """Problems that replies propose about documents; one of two has no evidence that is known."""
    candidate = lambda evidence: F.struct(F.lit("C1").alias("checkId"), F.element_at(_strings(*ro.KINDS), (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"), F.lit("needs_evidence").alias("disposition"), F.expr("if(doc_id % 2 = 0, lang, '  ')").alias("searchFor"), F.col("text").alias("issue"), evidence.alias("evidenceIds"))
    body = F.to_json(F.struct(F.array(candidate(_strings("e1")), candidate(_strings("e3"))).alias("candidates")))
    found = ro.objects(table(spark, d, "documents").select("doc_id", _said(body, F.col("doc_id")).alias("raw")), "raw", "reply")
    rows = found.select("doc_id", ro.candidates(F.col("reply"), _strings("e1"), _strings("C1")).alias("r")).select("doc_id", "r.dropped", F.explode("r.kept").alias("c"))
    return rows.select("doc_id", "c.kind", "c.disposition", "c.issue", "c.search_for", "dropped")


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 100 as x0, l_discount as y0, l_quantity / 100 + 0.1 as x1, l_discount + l_tax as y1, l_suppkey % 3 as shape from lineitem)
  select l_orderkey, l_linenumber, l_partkey, round(x0, 6) as x0, round(y0, 6) as y0, case when shape = 2 then 'mixed' when y1 <= y0 then 'no area' end as refused,
    case when shape = 2 or y1 <= y0 then 'invalid_location' else 'issues' end as outcome, case when shape = 2 or y1 <= y0 then 'unclear' else 'issues' end as answer from l""")
def first_looks(spark, d):
    """Looks at areas: boxes by edges, in thousandths, or in mixed units, which are refused."""
    edges = "l_quantity / 100 as x0, l_discount as y0, l_quantity / 100 + 0.1 as x1, l_discount + l_tax as y1".split(", ")
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey % 3 as shape", *edges)
    listed = "concat('[', if(shape = 2, x0, x0 * 1000), ', ', y0 * 1000, ', ', x1 * 1000, ', ', y1 * 1000, ']')"
    named = "concat('{\"left\": ', x0, ', \"top\": ', y0, ', \"right\": ', x1, ', \"bottom\": ', y1, '}')"
    place = f"if(shape = 0, {named}, {listed})"
    raw = F.expr(f"concat('{{\"status\": \"agree\", \"answers\": {{\"C1\": \"issues\", \"C2\": 3}}, \"issues\": [{{\"checkId\": \"C1\", \"kind\": \"odd\", \"element\": \"P', l_partkey, '\", \"whatA\": \"a\", \"whatB\": \"b\", \"boxA\": ', {place}, ', \"boxB\": ', {place}, '}}, \"chatter\"]}}')")
    # thousandths of shares below a thousandth would read as shares: those are given by edges
    looks = ro.objects(lines.withColumn("raw", raw), "raw", "reply").withColumn("r", ro.first_look(F.col("reply"), _strings("C1", "C2")))
    detail = F.get("r.dropped", 0)["detail"]
    why = F.when(detail.contains("mixes"), "mixed").when(detail.contains("no area"), "no area")
    return looks.select("l_orderkey", "l_linenumber", "l_partkey", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"), why.alias("refused"), "r.outcome", F.element_at("r.answers", "C1").alias("answer"))


@query("""select o_orderkey, case o_orderstatus when 'F' then 'keep' when 'O' then 'reject' else 'unclear' end as decision, 'Order ' || o_orderkey || ': 4''-0" slab' as subject, o_orderpriority as reason, case when o_orderkey % 2 = 0 then 'high' else 'medium' end as confidence, 'normal' as priority from orders where o_orderkey % 7 > 0""")
def look_verdicts(spark, d):
    """Verdicts on closer looks: every seventh has none, some are bare words, the inch mark in each is plain."""
    decision = "case when o_orderkey % 7 = 0 then 'perhaps' when o_orderstatus = 'F' then 'keep' when o_orderstatus = 'O' then 'reject' else 'unclear' end"
    raw = F.expr(f"""concat('{{"decision": ', if(o_orderkey % 3 = 0, {decision}, concat('"', {decision}, '"')), ', "subject": " Order\\t', o_orderkey, ': 4\\'-0" slab ", "reason": "', o_orderpriority, '", "confidence": ', if(o_orderkey % 2 = 0, '"high"', 'true'), '}}')""")
    found = ro.objects(table(spark, d, "orders").select("o_orderkey", F.regexp_replace(raw, "\t", r"\\t").alias("raw")), "raw", "reply")
    # a filter would work the verdict out twice
    return found.select("o_orderkey", F.explode(F.array_compact(F.array(ro.verdict(F.col("reply"))))).alias("r")).select("o_orderkey", "r.decision", "r.subject", "r.reason", "r.confidence", "r.priority")


@query("""with i as (select event_id, event_id % 4 as index, 'keep' as decision, 'high' as priority, event_type as subject, 'not_visible' as basis, 'e' || user_id as answered_by from events
    union all select event_id, 1, case when event_id % 3 = 0 then 'reject' else 'keep' end, 'normal', '', 'other', '' from events union all select event_id, event_id % 2, 'reject', 'normal', '', 'other', '' from events where event_id % 5 > 0)
  select event_id, index, decision, priority, subject, basis, answered_by, case when basis = 'not_visible' then 'S-' || event_id % 300 else '' end as look_for from i where index < 3 qualify count(*) over (partition by event_id, index) = 1""")
def review_decisions(spark, d):
    """Decisions of a batch of three: one whole, one without its verdict, one whose number may be a text."""
    first = "concat('{\"index\": ', event_id % 4, ', \"decision\": \"keep\", \"priority\": \"high\", \"subject\": \"', event_type, '\", \"basis\": \"not_visible\", \"lookFor\": \" S-', event_id % 300, '\", \"answeredBy\": [\"e', user_id, '\", 4, null]}')"
    second = "concat('{\"index\": 1, \"question\": \" Which? \", \"basis\": \"', if(event_id % 3 = 0, 'printed', ''), '\"}')"
    third = "concat('{\"index\": ', if(event_id % 5 = 0, concat('\"', event_id % 2, '\"'), cast(event_id % 2 as string)), ', \"decision\": \"maybe\", \"priority\": 7}')"
    raw = F.expr(f"concat('Here it is: {{\"decisions\": [', {first}, ', ', {second}, ', ', {third}, ']}} as asked')")
    found = ro.objects(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", "reply")
    answers = found.select("event_id", F.explode(ro.decisions(F.col("reply"), F.lit(3))).alias("x"))
    return answers.select("event_id", "x.index", "x.decision", "x.priority", "x.subject", "x.basis", F.array_join("x.answered_by", ",").alias("answered_by"), "x.look_for")
