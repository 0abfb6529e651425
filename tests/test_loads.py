"""What a task holds or shuffles at once, on small inputs."""

from __future__ import annotations

import pyarrow.parquet as pq

from quillspark.llm import common, ranked_search
from quillspark.operators import alignment


def test_segments_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ROW_GROUP", 1 << 16)
    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 300), x -> concat('w', id * 300 + x)), ' ') as text")
    index = ranked_search.build(docs, segment_docs=10)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.segments.inputFiles()]
    assert sum(m.num_rows for m in files) == 40 and max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) < 40
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    with common.batches_of(spark, ranked_search.SEGMENT_BATCH):
        assert int(spark.conf.get(name)) <= ranked_search.SEGMENT_BATCH
    assert spark.conf.get(name) == before
    asked = spark.createDataFrame([(1, "w299 w7")], "item long, text string")
    assert sorted(r["doc_id"] for r in ranked_search.search(index, asked, "item").collect()) == [0]


def _exchanges(spark, df) -> int:
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        return df()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_votes_of_plans_are_shuffled_once(spark, tmp_path):
    elements, pairs = f"file://{tmp_path}/e", f"file://{tmp_path}/p"
    spark.range(60).selectExpr("if(id < 30, 'A', 'B') as sheet", "cast(id % 30 as int) as element_id", "1 as detail", "id % 30 * 50D as cx", "id % 30 * 13 % 100 * 7D as cy", "5D + id % 30 * 4 as w", "6D as h").write.parquet(elements)
    spark.sql("select 1L as pair, 'A' as a_sheet, 'B' as b_sheet, 1D as scale, 4.5D as tolerance").write.parquet(pairs)
    found = lambda: alignment.align_plans(spark.read.parquet(pairs), spark.read.parquet(elements))
    n = _exchanges(spark, found)
    row = found().first()
    assert (row["tx"], row["ty"]) == (0, 0) and len(row["inliers"]) == 30
    assert n <= 12, n
