"""Registered queries of what changes of several tables write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import changes
from ..sources.tables import table
from .queries import query


@query("""with stored as (select p_partkey as fingerprint, case p_size % 3 when 0 then 'accepted' else 'pending' end as status, case when p_size % 2 = 0 then 'targeted_review' else 'deterministic_scan' end as origin, p_brand as subject from part where p_partkey % 4 > 0),
  found as (select distinct p_partkey as fingerprint, p_type as subject from part where p_partkey % 3 > 0)
  select fingerprint, coalesce(status, 'pending') as status, case when f.subject is not null and (status is null or (status = 'pending' and origin = 'targeted_review')) then f.subject else s.subject end as subject,
    f.subject is not null and (status is null or (status = 'pending' and origin = 'targeted_review')) as mine from stored s full join found f using (fingerprint)""")
def saved_candidates(spark, d):
    """Parts as findings of a run against those of earlier ones: decisions and a scan's findings stand."""
    parts = table(spark, d, "part")
    stored = parts.filter("p_partkey % 4 > 0").selectExpr("p_partkey as fingerprint", "if(p_size % 3 = 0, 'accepted', 'pending') as status", "if(p_size % 2 = 0, 'targeted_review', 'deterministic_scan') as origin", "'r0' as run", "'low' as confidence", "p_brand as subject", "'e' as evidence")
    found = parts.filter("p_partkey % 3 > 0").selectExpr("p_partkey as fingerprint", "'r1' as run", "'high' as confidence", "p_type as subject", "'e' as evidence")
    return changes.saved_candidates(stored, found).select("fingerprint", "status", "subject", "mine")


@query("""select l_orderkey * 10 + l_linenumber as chunk_id, l_partkey as text_id from lineitem where not (l_suppkey = 7 and l_returnflag = 'R') union all select -l_orderkey * 10 - l_linenumber, l_partkey from lineitem where l_suppkey = 7 and l_linestatus = 'F'""")
def replaced_kind(spark, d):
    """Lines as chunks of their supplier's page by kind: one kind of one page replaced, all others keep their ids."""
    lines = table(spark, d, "lineitem")
    chunks = lines.selectExpr("l_orderkey * 10 + l_linenumber as chunk_id", "l_suppkey as page_id", "l_returnflag as kind", "l_partkey as text_id")
    new = lines.filter("l_suppkey = 7 and l_linestatus = 'F'").selectExpr("-l_orderkey * 10 - l_linenumber as chunk_id", "l_suppkey as page_id", "'R' as kind", "l_partkey as text_id")
    identifiers = chunks.select("chunk_id", F.lit("S1").alias("identifier"))
    return changes.replaced_kind(chunks, identifiers, new, 7, "R")[0].select("chunk_id", "text_id")
