"""Registered queries of the document operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, chunking, evaluation, geometry, ledger, merge, numbering, portions, retrieval
from ..sources.tables import table
from ..streaming import jobs
from . import stem_sql, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query by its name, with its SQL where SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# What orders of documents and events never fall along, for two-level windows.
MONTH = "date_trunc('month', created_at)"
DAY = "date_trunc('day', ts)"

# The views of views.py in SQL, put in front of the queries that use them.
DOCUMENTS = """documents_ as (select o_custkey as project, o_orderkey as document_id, o_orderdate as created_at,
  case when o_orderstatus = 'F' then o_orderdate end as superseded_at, pages
  from orders join (select l_orderkey, count(*) as pages from lineitem group by 1) on l_orderkey = o_orderkey)"""
OFFSETS = f"""{DOCUMENTS}, offsets as (select *, cast(coalesce(sum(pages) over (partition by project order by created_at, document_id
  rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from documents_ where superseded_at is null)"""
USAGE = """usage as (select event_id, event_type as kind, case event_id % 4 when 0 then 'alpha' when 1 then 'beta' when 2 then 'beta-batch' else 'gamma' end as model,
  user_id % 10 as project, cast(ts as date) as day, ts, event_id % 1000 as input_tokens, event_id % 300 as output_tokens, event_id % 50 as cache_read,
  event_id % 20 as cache_write, event_id % 1000 + event_id % 300 as tokens from events)"""
COSTS = f"""{USAGE}, costs as (select *, case model when 'alpha' then 3.0 when 'beta' then 1.0 when 'beta-batch' then 0.5 end as rate_in,
  case model when 'alpha' then 15.0 when 'beta' then 5.0 when 'beta-batch' then 2.5 end as rate_out from usage),
  priced as (select *, ((input_tokens + cache_read * 0.1 + cache_write * 1.25) * rate_in + output_tokens * rate_out) / 1e6 as cost from costs)"""
CHUNKS = """chunks as (select p_partkey as chunk_id, p_partkey % 50 as page_id, concat('SEE ', upper(substr(p_type, 1, 1)), '-', 100 + p_partkey % 400,
  ' AND DETAIL ', p_partkey % 9 + 1, '/S-', 500 + p_partkey % 50, ' FOR ', p_name) as text from part)"""
IDENTIFIERS = f"""{CHUNKS}, index_ as (select chunk_id, page_id, unnest(list_distinct(list_transform(regexp_extract_all(text,
  '\\b([A-Z]{{1,3}}[-.]?[0-9]{{1,4}}(?:\\.[0-9]+){{0,2}}(?:-[A-Z]{{1,3}}\\b)*[A-Z]?|[A-Z][0-9]{{1,3}}[xX][0-9]{{1,3}})\\b', 1),
  lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')))) as identifier from chunks)"""
PAGES = """pages_ as (select l_suppkey as project, l_orderkey * 10 + l_linenumber as page_id, l_orderkey * 10 + l_linenumber as combined_page,
  concat(l_returnflag, l_linestatus) as discipline from lineitem)"""


# numbering -----------------------------------------------------------------------------------------------------------


@query(f'with {OFFSETS} select project, document_id, "offset" as page_offset, pages from offsets')
def combined_offset(spark, d):
    return numbering.offsets(views.documents(spark, d), "project", F.expr(MONTH), ["created_at", "document_id"]).select("project", "document_id", F.col("offset").alias("page_offset"), "pages")


@query(f'with {OFFSETS} select project, document_id, cast(n as int) as page_number, "offset" + n as combined_page from (select *, unnest(range(1, pages + 1)) as n from offsets)')
def page_manifest(spark, d):
    return numbering.manifest(views.documents(spark, d), "project", "document_id", F.expr(MONTH), ["created_at", "document_id"])


@query(f'with {OFFSETS} select project, combined_page, document_id, cast(combined_page - "offset" as int) as page_number from offsets join (select c_custkey as project, c_custkey % 20 + 1 as combined_page from customer) using (project) where combined_page > "offset" and combined_page <= "offset" + pages')
def manifest_lookup(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), (F.col("c_custkey") % 20 + 1).alias("combined_page"))
    return numbering.lookup(views.documents(spark, d), wanted, "project", "document_id", F.expr(MONTH), ["created_at", "document_id"])


@query(f'with {OFFSETS}, rule as (select project, document_id, "offset" + 1 as expected from offsets), stored as (select project, document_id, case when document_id % 3 = 0 then 0 else expected end as combined_page from rule) select document_id, combined_page as stored, expected from stored join rule using (project, document_id) where combined_page is distinct from expected')
def numbering_disagreements(spark, d):
    rule = numbering.offsets(views.documents(spark, d), "project", F.expr(MONTH), ["created_at", "document_id"]).select("document_id", (F.col("offset") + 1).alias("combined_page"))
    stored = rule.select("document_id", F.expr("if(document_id % 3 = 0, 0L, combined_page)").alias("combined_page"))
    return numbering.disagreements(stored, rule, ["document_id"])


@query("with d as (select distinct p_brand, p_size from part), i as (select *, p_size - row_number() over (partition by p_brand order by p_size) as island from d) select p_brand, min(p_size) as first, max(p_size) as last, count(*) as n from i group by p_brand, island")
def page_ranges(spark, d):
    return numbering.ranges(table(spark, d, "part"), "p_brand", "p_size")


@query("with p as (select concat(p_brand, ' ', p_name) as series, p_size from part), s as (select series, min(p_size) as low, max(p_size) as high, count(distinct p_size) as n from p group by 1), g as (select series, unnest(range(low + 1, high)) as missing from s where n >= 3) select series, cast(missing as int) as missing from g where not exists (select 1 from p where p.series = g.series and p_size = missing)")
def series_gaps(spark, d):
    return numbering.gaps(table(spark, d, "part").selectExpr("concat(p_brand, ' ', p_name) as series", "p_size"), "series", "p_size")


@query("with e as (select event_id, user_id, ts, case when event_id % 3 = 0 then event_type end as discipline from events) select event_id, coalesce(last_value(discipline ignore nulls) over w, first_value(discipline ignore nulls) over v, 'unclassified') as filled from e window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row), v as (partition by user_id order by ts, event_id rows between current row and unbounded following)")
def fill_unresolved(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.expr("if(event_id % 3 = 0, event_type, null)").alias("discipline"))
    return numbering.filled(rows, "user_id", F.expr(DAY), ["ts", "event_id"], "discipline").select("event_id", "filled")


@query("select o_orderkey, cast(floor((row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1) / 10) as bigint) as section from orders")
def section_batches(spark, d):
    return numbering.batches(table(spark, d, "orders"), "o_custkey", F.date_trunc("month", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("section").cast("bigint").alias("section"))


@query("with r as (select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as k, greatest(1, count(*) over (partition by user_id) // 5) as step from events) select event_id from r where k % step = 0 and k / step < 5")
def stride_sample(spark, d):
    return numbering.stride_sample(table(spark, d, "events"), "user_id", F.expr(DAY), ["ts", "event_id"], 5).select("event_id")


@query("select event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as ahead from events")
def queue_place(spark, d):
    return numbering.queue_place(table(spark, d, "events"), "event_type", F.expr(DAY), ["ts", "event_id"]).select("event_id", F.col("ahead").cast("bigint").alias("ahead"))


@query("with d as (select distinct p_brand, p_retailprice from part), g as (select p_brand, lead(p_retailprice) over (partition by p_brand order by p_retailprice) - p_retailprice as gap from d) select p_brand, round(coalesce(median(gap), 0), 6) as spacing from g group by 1")
def line_spacing(spark, d):
    return numbering.spacing(table(spark, d, "part"), "p_brand", "p_retailprice").select("p_brand", F.round("spacing", 6).alias("spacing"))


# ledger --------------------------------------------------------------------------------------------------------------


@query(f"with {COSTS} select model, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_read) as bigint) as cache_read, cast(sum(cache_write) as bigint) as cache_write, round(sum(cost), 6) as cost from priced group by 1")
def usage_by_model(spark, d):
    return ledger.by_model(ledger.rated(views.usage(spark, d), views.rates(spark)).withColumn("cost", ledger.cost()))


@query(f"with {USAGE} select kind, model, project, day, cast(sum(tokens) as bigint) as tokens, count(*) as n from usage group by grouping sets ((), (kind), (model), (project), (day))")
def usage_rollup(spark, d):
    return ledger.rollup(views.usage(spark, d))


@query(f"with {USAGE}, c as (select cast(date '2023-12-15' + cast(i as int) as date) as day from range(90) t(i)) select c.day, cast(coalesce(sum(tokens), 0) as bigint) as tokens, count(event_id) as n from c left join usage u on u.day = c.day group by 1")
def dense_day_series(spark, d):
    return ledger.dense_days(views.usage(spark, d), "2023-12-15", 90)


@query(f"with {COSTS} select project, case when count(cost) = count(*) then round(sum(cost), 6) end as cost, count(*) as n, count(*) filter (where cost is null) as n_unpriced from priced where model <> 'gamma' or project <> 3 group by 1")
def spent_or_unknown(spark, d):
    rows = ledger.rated(views.usage(spark, d), views.rates(spark)).withColumn("cost", ledger.cost())
    return ledger.spent(rows.filter("model <> 'gamma' or project <> 3"), "project")


@query("with p as (select l_orderkey as portion, count(*) as pages from lineitem group by 1) select portion, pages, cast(case when pages > 10 then ceil(pages / 10) else 0 end as bigint) as section_calls, cast(case when pages >= 4 then pages * 0.5 else pages end as double) as page_units, cast(pages + case when pages > 10 then ceil(pages / 10) else 0 end + 1 as bigint) as calls from p")
def summary_estimate(spark, d):
    return ledger.summary_estimate(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("portion")).agg(F.count("*").alias("pages")))


# scalar functions ----------------------------------------------------------------------------------------------------


@query("with w as (select doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as n from documents) select doc_id, cast(case when n = 0 then 0 else greatest(1, round_even(n * 1.3, 0)) end as int) as tokens, cast(greatest(1, length(text) // 4) as int) as approximate, sha256(text) as text_hash from w")
def token_estimates(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(c).alias("tokens"), text.approximate_tokens(c).alias("approximate"), text.text_hash(c).alias("text_hash"))


@query("select p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as normal, concat('brand:', substr(sha256(concat_ws('|', 'brand', p_brand, p_name)), 1, 24)) as fingerprint from part")
def normal_forms(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize(F.col("p_brand")).alias("normal"), text.fingerprint(F.lit("brand"), F.col("p_brand"), F.col("p_name")).alias("fingerprint"))


@query("select p_partkey, cast(p_size // 12 * 12 + p_size % 12 + 0.5 as double) as inches from part")
def printed_lengths(spark, d):
    printed = F.expr("concat(p_size div 12, '''-', p_size % 12, ' 1/2\"')")
    return table(spark, d, "part").select("p_partkey", text.feet_inches(printed).alias("inches"))


@query("select l_orderkey, concat('| line | part |\n| --- | --- |\n', string_agg(concat('| ', l_linenumber, ' | ', l_partkey, ' |'), '\n' order by l_linenumber, l_partkey)) as markdown from lineitem group by 1")
def table_markdown(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("line"), F.lit("part"))), F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))))
    return rows.select("l_orderkey", text.table_markdown(cells).alias("markdown"))


# retrieval -----------------------------------------------------------------------------------------------------------


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set: every 50th chunk asks for its own sheet."""
    return views.chunks(spark, d).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.expr("concat('where is ', substr(text, 5, 5), ' with the ', substring_index(text, ' FOR ', -1))").alias("question"))


ASKED = f"""{IDENTIFIERS}, questions as (select chunk_id as query_id, concat('where is ', substr(text, 5, 5), ' with the ', split_part(text, ' FOR ', 2)) as question from chunks where chunk_id % 50 = 0),
  asked as (select distinct query_id, unnest(list_transform(regexp_extract_all(upper(question), '\\b([A-Z]{{1,3}}[-.]?[0-9]{{1,4}})\\b', 1), lambda x: replace(x, '-', ''))) as identifier from questions),
  by_identifier as (select * from (select *, row_number() over (partition by query_id order by hits desc, chunk_id) as rank from (select query_id, chunk_id, count(*) as hits from index_ join asked using (identifier) group by 1, 2)) where rank <= 40)"""
KEYWORDS = f"""spoken as (select chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from chunks),
  wanted as (select query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as word from questions),
  {stem_sql.stems("select word from spoken union select word from wanted")},
  postings as (select chunk_id, stem, count(*) as times from spoken join stems using (word) group by 1, 2),
  words as (select *, count(*) over (partition by query_id) as size from (select distinct query_id, stem from wanted join stems using (word))),
  {stem_sql.RANKED}"""


@query(f"with {IDENTIFIERS} select chunk_id, identifier from index_")
def identifier_index(spark, d):
    return retrieval.identifier_index(views.chunks(spark, d))


@query(f"with {ASKED} select query_id, chunk_id, hits, rank from by_identifier")
def identifier_search(spark, d):
    return retrieval.by_identifier(retrieval.identifier_index(views.chunks(spark, d)), _questions(spark, d))


@query(f"with {ASKED}, {KEYWORDS} select query_id, chunk_id, score, rank from by_keyword")
def keyword_search(spark, d):
    return retrieval.by_keyword(views.chunks(spark, d), _questions(spark, d))


VECTORS = """scored as (select q.vec_id as query_id, p.vec_id as chunk_id, round(list_cosine_similarity(p.embedding::double[], q.embedding::double[]), 6) as score from embeddings p join embeddings q on q.vec_id % 50 = 0),
  by_vector as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored) where rank <= 40)"""


@query(f"with {VECTORS} select * from by_vector")
def vector_search(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieval.by_vector(points, points.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"))


FUSED = f"""{ASKED}, {KEYWORDS}, fused as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, chunk_id, round(sum(part), 9) as score from
  (select query_id, chunk_id, 3.0 / (60 + rank) as part from by_identifier union all select query_id, chunk_id, 1.0 / (60 + rank) from by_keyword) group by 1, 2)) where rank <= 18)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    chunks, questions = views.chunks(spark, d), _questions(spark, d)
    return retrieval.fuse([(retrieval.by_identifier(retrieval.identifier_index(chunks), questions), 3.0), (retrieval.by_keyword(chunks, questions), 1.0)])


@query(f"with {FUSED} select query_id, chunk_id, score, rank from fused")
def fused_search(spark, d):
    return _fused(spark, d)


@query(f"with {FUSED}, truth as (select chunk_id as query_id, chunk_id, case when chunk_id % 100 = 0 then 'even' else 'odd' end as tag from chunks where chunk_id % 50 = 0), r as (select t.query_id, tag, min(f.rank) as rank from truth t left join fused f using (query_id, chunk_id) group by 1, 2) select tag, count(*) as cases, round(avg(case when rank is null then 0.0 else 1.0 end), 6) as recall, round(avg(coalesce(1.0 / rank, 0.0)), 6) as mrr from r group by grouping sets ((), (tag))")
def retrieval_measures(spark, d):
    truth = _questions(spark, d).select("query_id", F.col("query_id").alias("chunk_id"), F.expr("if(query_id % 100 = 0, 'even', 'odd')").alias("tag"))
    return retrieval.measures(_fused(spark, d), truth)


@query("with n as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 0), o as (select sha256(text) as h, min(doc_id) as previous_id from documents where doc_id % 2 = 1 group by 1) select doc_id, previous_id from n left join o using (h)")
def reused_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))
    new, old = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "chunk_id")
    return retrieval.reused(new, old).select("doc_id", "previous_id")


# chunking ------------------------------------------------------------------------------------------------------------


@query("with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as words from documents), p as (select doc_id, words, unnest(range(0, cast(greatest(0, ceil((len(words) - 615) / 539)) as bigint) + 1)) as piece from w where len(words) > 0), s as (select doc_id, piece, list_slice(words, piece * 539 + 1, piece * 539 + 615) as part from p) select doc_id, cast(piece as int) as piece, array_to_string(part, ' ') as text, cast(len(part) as int) as n_words, cast(greatest(1, round_even(len(part) * 1.3, 0)) as int) as tokens from s")
def word_windows(spark, d):
    return chunking.word_windows(table(spark, d, "documents"), "doc_id")


@query("""with recursive b as (select l_suppkey, l_orderkey * 10 + l_linenumber as block, cast(sum(cast(l_quantity * 5 as int)) as int) as tokens from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by block) as k from b),
  f as (select l_suppkey, block, tokens, k, 0 as chunk, tokens as size from r where k = 1
    union all select r.l_suppkey, r.block, r.tokens, r.k, f.chunk + case when f.size + r.tokens > 800 and f.size >= 400 then 1 else 0 end, r.tokens + case when f.size + r.tokens > 800 and f.size >= 400 then 0 else f.size end from f join r on r.l_suppkey = f.l_suppkey and r.k = f.k + 1)
  select l_suppkey, block, tokens, chunk from f""")
def packed_chunks(spark, d):
    blocks = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey * 10 + l_linenumber as block", "cast(l_quantity * 5 as int) as tokens", "l_partkey")
    return chunking.packed(blocks.groupBy("l_suppkey", "block").agg(F.sum("tokens").cast("int").alias("tokens")), "l_suppkey", "block")


@query("""with recursive b as (select p_partkey // 50 as page, p_partkey as box_id, p_partkey * 37 % 1000 as x0, p_partkey * 91 % 700 as y0, p_partkey * 37 % 1000 + p_size as x1, p_partkey * 91 % 700 + 12 as y1 from part),
  e as (select a.page, a.box_id as u, c.box_id as v from b a join b c on a.page = c.page and greatest(a.x0 - c.x1, c.x0 - a.x1, a.y0 - c.y1, c.y0 - a.y1) <= 18),
  r as (select page, u, v from e union select r.page, r.u, e.v from r join e on e.page = r.page and e.u = r.v)
  select page, u as box_id, min(v) as cluster from r group by 1, 2""")
def block_clusters(spark, d):
    boxes = table(spark, d, "part").selectExpr(
        "p_partkey div 50 as page", "p_partkey as box_id", "cast(p_partkey * 37 % 1000 as double) as x0", "cast(p_partkey * 91 % 700 as double) as y0", "cast(p_partkey * 37 % 1000 + p_size as double) as x1", "cast(p_partkey * 91 % 700 + 12 as double) as y1", "1100D as width", "800D as height"
    )
    return chunking.clusters(boxes, "page").select("page", "box_id", "cluster")


# portions and sheet maps ---------------------------------------------------------------------------------------------


@query(f"with {PAGES} select project, discipline, min(combined_page) as start_page, max(combined_page) as end_page, count(*) as page_count from pages_ group by 1, 2")
def portion_groups(spark, d):
    return portions.portions(views.pages(spark, d))


@query(f"with {PAGES}, p as (select distinct project, discipline, page_id from pages_), b as (select project, discipline, list(page_id order by page_id) as ids, count(*) as n from p group by 1, 2), a as (select project, discipline, list(page_id order by page_id) as ids, count(*) as n from p where page_id % 997 <> 0 group by 1, 2) select project, discipline, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after from b full join a using (project, discipline) where b.ids is distinct from a.ids")
def stale_portions(spark, d):
    pages = views.pages(spark, d)
    return portions.stale(pages, pages.filter("page_id % 997 <> 0"))


@query("with s as (select user_id as project, case when event_type = 'error' then 'failed' when value < 2 then 'processing' else 'completed' end as status from events) select project, case when bool_or(status = 'failed') then 'failed' when bool_or(status = 'processing') then 'processing' when bool_or(status = 'completed') then 'completed' else 'empty' end as status, count(*) as n from s group by 1")
def worst_status(spark, d):
    return portions.worst_status(table(spark, d, "events").selectExpr("user_id as project", "case when event_type = 'error' then 'failed' when value < 2 then 'processing' else 'completed' end as status"))


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey % 20 as project", "p_partkey as page_id", "concat('S-', p_partkey div 20) as sheet", "array(concat('S', p_size), concat('s-', p_size + 60), 'X-1') as refs")


SHEETS = "nodes as (select p_partkey % 20 as project, concat('S', p_partkey // 20) as key, min(p_partkey) as target from part group by 1, 2), refs as (select distinct p_partkey % 20 as project, p_partkey as source, concat('S', p_partkey // 20) as own, unnest([concat('S', p_size), concat('S', p_size + 60), 'X1']) as key from part), edges as (select r.project, source, key, target, target is null as missing from refs r left join nodes using (project, key) where own <> key)"


@query(f"with {SHEETS} select * from edges")
def sheet_map(spark, d):
    return portions.sheet_map(_sheets(spark, d))


@query(f"with {SHEETS} select project, target as page_id, count(distinct source) as n_references from edges where target is not null group by 1, 2")
def sheet_referenced_by(spark, d):
    return portions.referenced_by(portions.sheet_map(_sheets(spark, d)))


@query("with r as (select conv_id as portion, turn, substr(text, 1, 40) as overview from conversations) select portion, substr(string_agg(overview, ' ' order by turn), 1, 1500) as overview, array_to_string(list_slice(list(cast(turn as varchar) order by turn), 1, 20), ',') as items from r group by 1")
def merged_summaries(spark, d):
    lower = table(spark, d, "conversations").selectExpr("conv_id as portion", "turn as at", "substr(text, 1, 40) as overview", "array(cast(turn as string)) as items")
    return portions.merged_summaries(lower, ["portion"]).withColumn("items", F.array_join("items", ","))


@query("with r as (select conv_id as portion, turn, text as overview from conversations) select portion, substr(string_agg(overview, ' ' order by turn), 1, 1500) as overview, array_to_string(list_slice(list(cast(turn as varchar) order by turn), 1, 20), ',') as items from r group by 1")
def merged_whole_summaries(spark, d):
    lower = table(spark, d, "conversations").selectExpr("conv_id as portion", "turn as at", "text as overview", "array(cast(turn as string)) as items")
    return portions.merged_summaries(lower, ["portion"]).withColumn("items", F.array_join("items", ","))


# checks --------------------------------------------------------------------------------------------------------------


@query(f"with {IDENTIFIERS}, issued as (select distinct concat(upper(substr(p_type, 1, 1)), 100 + p_partkey % 300) as sheet from part), shapes as (select regexp_extract(sheet, '^([A-Z]+)', 1) as l, length(sheet) as k, count(*) as n_shape from issued group by 1, 2), missing as (select distinct page_id, identifier as sheet, n_shape from index_ join shapes on regexp_extract(identifier, '^([A-Z]+)[0-9]+$', 1) = l and length(identifier) = k where identifier not in (select sheet from issued)) select sheet, count(*) as n_pages, min(page_id) as first_page, case when max(n_shape) >= 2 then 'high' else 'low' end as confidence, concat('dangling_reference:', substr(sha256(concat_ws('|', 'dangling_reference', sheet)), 1, 24)) as fingerprint from missing group by sheet")
def dangling_references(spark, d):
    chunks = views.chunks(spark, d)
    references = chunks.select("page_id", F.explode(text.identifiers(F.col("text"))).alias("sheet"))
    issued = table(spark, d, "part").selectExpr("concat(upper(substr(p_type, 1, 1)), '-', 100 + p_partkey % 300) as sheet")
    return checks.dangling_references(references, issued)


@query("with r as (select concat(p_brand, ' ', p_name) as tag, p_type as unit, p_size % 3 as value, p_partkey % 10 as sheet from part), v as (select tag, unit, value, count(distinct sheet) as sheets from r group by all), t as (select tag, unit, count(*) as n_values, min(value) as low, max(value) as high, max(sheets) as most from v group by all), s as (select tag, unit, count(distinct sheet) as n_sheets from r group by all) select tag, unit, n_values, n_sheets, cast(low as double) as low, cast(high as double) as high, case when most >= 2 then 'high' else 'medium' end as confidence from t join s using (tag, unit) where n_values >= 2 and n_sheets >= 2")
def tag_value_conflicts(spark, d):
    ratings = table(spark, d, "part").selectExpr("concat(p_brand, ' ', p_name) as tag", "p_type as unit", "cast(p_size % 3 as double) as value", "p_partkey % 10 as sheet")
    return checks.tag_value_conflicts(ratings)


NOTES = "notes as (select p_partkey % 50 as page_id, case p_partkey % 5 when 0 then concat(p_name, ' tbd') when 1 then concat('verify  ', p_name) when 2 then concat(p_name, ' ??') else p_name end as text from part)"


@query(f"with {NOTES}, m as (select page_id, trim(regexp_replace(upper(text), '\\s+', ' ', 'g')) as quote, case when regexp_matches(upper(text), '\\bTBD\\b') then 1 when regexp_matches(text, '\\?\\?') then 2 when regexp_matches(upper(text), '\\bVERIFY\\b') then 3 end as strength from notes) select quote, count(distinct page_id) as n_pages, min(page_id) as first_page, case min(strength) when 1 then 'high' when 2 then 'medium' else 'low' end as confidence from m where strength is not null group by 1")
def open_item_notes(spark, d):
    notes = table(spark, d, "part").selectExpr("p_partkey % 50 as page_id", "case p_partkey % 5 when 0 then concat(p_name, ' tbd') when 1 then concat('verify  ', p_name) when 2 then concat(p_name, ' ??') else p_name end as text")
    return checks.open_items(notes)


@query("with m as (select substr(p_type, 1, 1) as family, concat(substr(p_type, 1, 1), p_size) as mark, p_partkey as page_id from part), s as (select family, mark from m where page_id % 90 = 0) select family, mark, count(distinct page_id) as n_pages, min(page_id) as first_page from m where family in (select family from s) and not exists (select 1 from s where s.family = m.family and s.mark = m.mark) group by 1, 2")
def unscheduled_marks(spark, d):
    marks = table(spark, d, "part").selectExpr("substr(p_type, 1, 1) as family", "concat(substr(p_type, 1, 1), p_size) as mark", "p_partkey as page_id")
    return checks.unscheduled_marks(marks, marks.filter("page_id % 90 = 0"))


@query("with p as (select distinct p_type as discipline, concat(p_brand, ' ', p_name) as series, p_size as level from part), s as (select discipline, series, min(level) as low, max(level) as high, count(*) as n from p group by all), g as (select discipline, series, unnest(range(low + 1, high)) as level from s where n >= 3), h as (select g.* from g left join p using (discipline, series, level) where p.level is null), c as (select p.discipline, p.level, count(*) as n_siblings from p join s using (discipline, series) where s.n >= 3 group by all) select h.discipline, h.series, cast(h.level as int) as level, n_siblings, case when n_siblings >= 2 then 'high' else 'medium' end as confidence from h join c on c.discipline = h.discipline and c.level = h.level")
def missing_plan_levels(spark, d):
    return checks.missing_levels(table(spark, d, "part").selectExpr("p_type as discipline", "concat(p_brand, ' ', p_name) as series", "p_size as level"))


@query("select l_partkey as element, l_returnflag as field, count(distinct l_quantity) as n_values, count(distinct l_suppkey) as n_sources, min(l_quantity) as low, max(l_quantity) as high from lineitem group by 1, 2 having count(distinct l_quantity) >= 2 and count(distinct l_suppkey) >= 2")
def value_conflicts(spark, d):
    return checks.value_conflicts(table(spark, d, "lineitem").selectExpr("l_partkey as element", "l_returnflag as field", "l_quantity as value", "l_suppkey as source"))


@query("select p_partkey as finding, p_type as check_type, concat(upper(substr(p_name, 1, 2)), p_size) as key from part where not (p_size % 7 = 0 and p_type = 'ECONOMY') and not (upper(substr(p_name, 1, 2)) = 'RE')")
def dismissed_findings(spark, d):
    found = table(spark, d, "part").selectExpr("p_partkey as finding", "p_type as check_type", "concat(upper(substr(p_name, 1, 2)), p_size) as key")
    items = table(spark, d, "part").filter("p_size % 7 = 0 and p_type = 'ECONOMY'").selectExpr("p_type as check_type", "concat(upper(substr(p_name, 1, 2)), p_size) as key", "cast(null as string) as family")
    families = found.select("check_type", F.lit(None).cast("string").alias("key"), F.lit("RE").alias("family"))
    return checks.without_dismissed(found, items.unionByName(families)).select("finding", "check_type", "key")


@query("select n_nationkey as question, case when count(s_suppkey) filter (where s_acctbal < 0) > 0 then 'issue' when count(s_suppkey) > 0 then 'clear' else 'not_run' end as outcome, count(s_suppkey) filter (where s_acctbal < 0) as n from nation left join supplier on s_nationkey = n_nationkey group by 1")
def check_outcomes(spark, d):
    ran = table(spark, d, "supplier").select(F.col("s_nationkey").alias("question"), "s_acctbal")
    return checks.outcomes(table(spark, d, "nation").select(F.col("n_nationkey").alias("question")), ran.filter("s_acctbal < 0"), ran)


# merges --------------------------------------------------------------------------------------------------------------


@query("select coalesce(n.k, s.k) as k, case when n.k is not null then n.name else s.name end as name, case when n.k is not null then n.balance else s.balance end as balance from (select c_custkey as k, c_name as name, c_acctbal as balance from customer where c_custkey % 3 <> 0) s full join (select c_custkey as k, upper(c_name) as name, -c_acctbal as balance from customer where c_custkey % 2 = 0) n on n.k = s.k")
def keyed_upsert(spark, d):
    c = table(spark, d, "customer")
    stored = c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey as k", "c_name as name", "c_acctbal as balance")
    return merge.upsert(stored, c.filter("c_custkey % 2 = 0").selectExpr("c_custkey as k", "upper(c_name) as name", "-c_acctbal as balance"), ["k"])


CANDIDATES = "s as (select c_custkey as f, case when c_custkey % 5 = 0 then 'accepted' else 'pending' end as status, case when c_custkey % 4 = 0 then 'high' else 'low' end as confidence, c_name as wording, c_custkey % 4 = 0 as corroborated from customer where c_custkey % 3 <> 0), n as (select c_custkey as f, 'medium' as confidence, case when c_custkey % 7 = 0 then null else concat('new ', c_name) end as wording from customer where c_custkey % 2 = 0)"


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    stored = c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey as fingerprint", "if(c_custkey % 5 = 0, 'accepted', 'pending') as status", "if(c_custkey % 4 = 0, 'high', 'low') as confidence", "c_name as wording", "c_custkey % 4 = 0 as corroborated", "c_mktsegment as check_type")
    return stored, c.filter("c_custkey % 2 = 0").selectExpr("c_custkey as fingerprint", "'medium' as confidence", "if(c_custkey % 7 = 0, null, concat('new ', c_name)) as wording")


@query(f"with {CANDIDATES} select coalesce(s.f, n.f) as fingerprint, coalesce(s.status, 'pending') as status, case when s.f is null then n.confidence when s.status = 'pending' and n.f is not null and not s.corroborated then n.confidence else s.confidence end as confidence, case when s.f is null then n.wording when s.status = 'pending' and n.f is not null then coalesce(n.wording, s.wording) else s.wording end as wording, coalesce(s.corroborated, false) as corroborated from s full join n on s.f = n.f")
def candidate_merge(spark, d):
    return merge.merge_candidates(*_candidates(spark, d))


@query("select c_custkey as fingerprint, case when c_custkey % 5 = 0 then 'accepted' else 'pending' end as status from customer where c_custkey % 3 <> 0 and not (c_custkey % 5 <> 0 and c_custkey % 2 <> 0 and c_mktsegment in ('BUILDING', 'MACHINERY'))")
def resolved_findings(spark, d):
    stored, found = _candidates(spark, d)
    ran = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "check_type string")
    return merge.unresolved(stored, found, ran).select("fingerprint", "status")


@query("select c_custkey as finding, c_nationkey as project, 100 * (c_nationkey % 2) + row_number() over (partition by c_nationkey order by c_custkey) as number from customer")
def issue_numbers(spark, d):
    counters = table(spark, d, "nation").filter("n_nationkey % 2 = 1").selectExpr("n_nationkey as project", "100L as counter")
    out = merge.numbered(table(spark, d, "customer").selectExpr("c_custkey as finding", "c_nationkey as project"), counters, "project", ["finding"])
    return out.select("finding", "project", F.col("number").cast("bigint").alias("number"))


@query("select o_orderkey as document_id, case when o_orderkey % 10 = 0 then case when o_orderstatus = 'F' then o_orderdate else timestamp '2030-01-01' end when o_orderstatus = 'F' then o_orderdate end as superseded_at from orders where o_orderkey in (select l_orderkey from lineitem)")
def superseded_documents(spark, d):
    docs = views.documents(spark, d).select("document_id", "superseded_at")
    return merge.superseded(docs, docs.filter("document_id % 10 = 0").select("document_id"), "2030-01-01")


# evaluation ----------------------------------------------------------------------------------------------------------


@query("with a as (select p_partkey, case when p_partkey % 6 = 0 then '' when p_partkey % 6 = 1 then concat(p_brand, ' or ', p_type) when p_partkey % 6 = 2 then p_type when p_partkey % 6 = 3 then 'none' else p_brand end as answer, p_brand as expected, p_type as distractor from part) select p_partkey, case when trim(answer) = '' then 'abstained' when contains(upper(answer), upper(expected)) and contains(upper(answer), upper(distractor)) then 'hedged' when contains(upper(answer), upper(expected)) then 'correct' when contains(upper(answer), upper(distractor)) then 'wrong' else 'off_target' end as outcome from a")
def answer_outcomes(spark, d):
    answers = table(spark, d, "part").selectExpr("p_partkey", "case when p_partkey % 6 = 0 then '' when p_partkey % 6 = 1 then concat(p_brand, ' or ', p_type) when p_partkey % 6 = 2 then p_type when p_partkey % 6 = 3 then 'none' else p_brand end as answer", "p_brand as expected", "p_type as distractor")
    return evaluation.answer_outcomes(answers).select("p_partkey", "outcome")


@query("with c as (select p_type as tag, p_brand as label, count(*) as n from part group by 1, 2) select tag, cast(sum(n) as bigint) as cases, max(n) as majority, round(max(n) / sum(n), 6) as share from c group by 1")
def majority_baseline(spark, d):
    return evaluation.majority_baseline(table(spark, d, "part").selectExpr("p_type as tag", "p_brand as label"))


@query("with a as (select p_type as tag, p_name as answer, count(*) as n from part group by 1, 2), l as (select p_type as tag, p_brand as label, count(*) as n from part group by 1, 2), x as (select tag, round(max(n) / sum(n), 6) as answer_share from a group by 1), y as (select tag, round(max(n) / sum(n), 6) as label_share from l group by 1) select tag, answer_share, label_share, round(answer_share - label_share, 6) as gap from x join y using (tag)")
def answer_concentration(spark, d):
    return evaluation.concentration(table(spark, d, "part").selectExpr("p_type as tag", "p_name as answer", "p_brand as label"))


@query("with e as (select distinct l_suppkey as case_id, l_partkey as key from lineitem where l_returnflag = 'A'), f as (select distinct l_suppkey as case_id, l_partkey as key from lineitem where l_linestatus = 'F') select coalesce(e.case_id, f.case_id) as case_id, count(*) filter (where e.key is not null and f.key is not null) as hit, count(*) filter (where f.key is null) as missed, count(*) filter (where e.key is null) as extra from e full join f on e.case_id = f.case_id and e.key = f.key group by 1")
def finding_scores(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey as case_id", "l_partkey as key", "l_returnflag", "l_linestatus")
    return evaluation.finding_scores(rows.filter("l_returnflag = 'A'"), rows.filter("l_linestatus = 'F'")).select("case_id", *[F.col(c).cast("bigint").alias(c) for c in ("hit", "missed", "extra")])


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, count(*) as n from events group by 1")
def latency_percentiles(spark, d):
    return numbering.percentiles(table(spark, d, "events"), "event_type", "value", F.floor("value"))


# geometry ------------------------------------------------------------------------------------------------------------


@query("with m as (select p_partkey as mark_id, p_brand as page, cast(p_size * 10 + p_partkey % 3 as double) as y from part), l as (select *, case when coalesce(y - lag(y) over w, 5) > 4 then 1 else 0 end as new from m window w as (partition by page order by y, mark_id)), a as (select *, sum(new) over (partition by page order by y, mark_id rows unbounded preceding) as axis from l), n as (select *, count(*) over (partition by page, axis) as n from a) select mark_id, page, cast(axis as bigint) as axis, n from n where n >= 3")
def mark_axes(spark, d):
    marks = table(spark, d, "part").selectExpr("p_partkey as mark_id", "p_brand as page", "cast(p_size * 10 + p_partkey % 3 as double) as y")
    return geometry.axes(marks, "page", "y", 4.0, 3).select("mark_id", "page", F.col("axis").cast("bigint").alias("axis"), "n")


@query("with p as (select p_partkey // 6 as pair, count(*) as n from part group by 1) select pair, cast(7 + pair % 50 as double) as shift, n as votes from p where n >= 3")
def shift_votes(spark, d):
    # six parts a pair, at six places whose distances all differ
    lines = table(spark, d, "part").selectExpr("p_partkey div 6 as pair", "element_at(array(0D, 110D, 230D, 370D, 530D, 710D), cast(p_partkey % 6 as int) + 1) as position")
    return geometry.vote_shift(lines, lines.selectExpr("pair", "position + 7 + pair % 50 as position"), "pair", 2.0).select("pair", "shift", "votes")


NEAREST = "p as (select p_partkey % 10 as page, p_partkey as id, cast(p_partkey * 37 % 400 as double) as x, cast(p_partkey * 91 % 300 as double) as y, p_partkey // 10 % 2 as side from part), j as (select a.id, b.id as target_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance from p a join p b on a.page = b.page and a.side = 0 and b.side = 1), best as (select id, min(struct_pack(distance, target_id)) as b from j where distance <= 25 group by 1)"


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "part").selectExpr("p_partkey % 10 as page", "p_partkey as id", "cast(p_partkey * 37 % 400 as double) as x", "cast(p_partkey * 91 % 300 as double) as y", "p_partkey div 10 % 2 as side")
    return rows.filter("side = 0").select("page", F.col("id").alias("point_id"), "x", "y"), rows.filter("side = 1").select("page", F.col("id").alias("target_id"), "x", "y")


@query(f"with {NEAREST} select p.id as point_id, b.target_id as target_id, round(b.distance, 6) as distance from p left join best using (id) where side = 0")
def nearest_marks(spark, d):
    return geometry.nearest(*_points(spark, d), "page", 25.0).select("point_id", "target_id", "distance")


@query(f"with {NEAREST} select p.id as point_id from p left join best using (id) where side = 0 and b is null")
def untagged_symbols(spark, d):
    return geometry.unmatched(*_points(spark, d), "page", 25.0).select("point_id")


@query("with a as (select p_partkey, cast(p_size * 25 as double) as extent from part), n as (select *, cast(case when extent <= 300 then 1 else ceil(extent / 240) end as int) as n from a), k as (select *, unnest(range(0, n)) as k from n) select p_partkey, extent, cast(k as int) as k, round(k * case when n > 1 then (extent - 300) / (n - 1) else 0 end, 6) as low, round(least(extent, k * case when n > 1 then (extent - 300) / (n - 1) else 0 end + 300), 6) as high from k")
def tiling(spark, d):
    return geometry.windows(table(spark, d, "part").selectExpr("p_partkey", "cast(p_size * 25 as double) as extent"), 300.0, 0.2)


@query("with b as (select p_partkey, p_partkey % 4 * 90 as r, p_size * 1.0 as x, p_size * 2.0 as y from part) select p_partkey, cast(case r when 90 then 800 - y - 5 when 180 then 1000 - x - 10 when 270 then y else x end as double) as dx, cast(case r when 90 then x when 180 then 800 - y - 5 when 270 then 1000 - x - 10 else y end as double) as dy from b")
def display_boxes(spark, d):
    boxes = table(spark, d, "part").selectExpr("p_partkey", "cast(p_partkey % 4 * 90 as int) as rotation", "cast(p_size as double) as x", "p_size * 2D as y", "10D as w", "5D as h", "1000D as page_w", "800D as page_h")
    return geometry.rotated(boxes).select("p_partkey", "dx", "dy")


# queues --------------------------------------------------------------------------------------------------------------


@query("""with recursive h as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
  f as (select event_id, user_id, k, t as started, 1 as n from h where k = 1
    union all select h.event_id, h.user_id, h.k, case when h.t >= f.started + 3600000000 then h.t else f.started end, case when h.t >= f.started + 3600000000 then 1 else f.n + 1 end from f join h on h.user_id = f.user_id and h.k = f.k + 1)
  select event_id, n <= 3 as allowed from f""")
def rate_limit(spark, d):
    hits = table(spark, d, "events").select("event_id", "user_id", "ts")
    return jobs.limited_batch(hits, "user_id", "ts", 3600, 3, "event_id").select("event_id", "allowed")


@query("select event_id, event_type in ('click', 'view') and epoch(timestamp '2024-01-02' ) - epoch(ts) <= 3600 as alive from events")
def live_runs(spark, d):
    runs = table(spark, d, "events").selectExpr("event_id", "if(event_type in ('click', 'view'), 'running', 'done') as status", "ts as heartbeat")
    return jobs.alive(runs, "2024-01-02", 3600).select("event_id", "alive")


@query("with m as (select conv_id, max(turn) as last_turn, count(*) as n, min_by(text, turn) filter (where role = 'user') as first_question from conversations group by 1) select conv_id, last_turn, n, substr(trim(regexp_replace(first_question, '\\s+', ' ', 'g')), 1, 140) as preview from m")
def session_previews(spark, d):
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"), first.alias("q"))
    return grouped.select("conv_id", "last_turn", "n", F.substring(F.trim(F.regexp_replace("q", r"\s+", " ")), 1, 140).alias("preview"))
