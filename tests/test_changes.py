"""Changes of several tables: all or nothing, one writer wins, only what changed is written."""

from __future__ import annotations

import pytest

from quillspark.sources import changes

SCHEMAS = {
    "pages": "page_id int, title string", "chunks": "chunk_id int, page_id int, kind string, text string", "identifiers": "chunk_id int, identifier string",
    "candidates": "fingerprint string, status string, origin string, run string, confidence string, subject string, evidence string", "runs": "run string, saved long",
}


@pytest.fixture
def store(spark, tmp_path):
    s = changes.Store(spark, f"file://{tmp_path}/store", SCHEMAS)
    change = s.change()
    for project in ("p", "q"):
        change.put("pages", project, spark.createDataFrame([(1, "a"), (2, "b")], SCHEMAS["pages"]))
        change.put("chunks", project, spark.createDataFrame([(1, 1, "text", "x"), (2, 1, "gridmarks", "y"), (3, 2, "gridmarks", "z"), (4, 1, None, "n")], SCHEMAS["chunks"]))
        change.put("identifiers", project, spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], SCHEMAS["identifiers"]))
        change.put("candidates", project, spark.createDataFrame([("a", "pending", "targeted_review", "r0", "low", "s", "e"), ("b", "accepted", "targeted_review", "r0", "low", "s", "e"), ("c", "pending", "deterministic_scan", None, "low", "s", "e")], SCHEMAS["candidates"]))
    assert s.manifest() == (0, {}) and change.commit() == 1
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_page_kind(spark, store):
    new = spark.createDataFrame([(9, 1, "gridmarks", "new")], SCHEMAS["chunks"])
    assert changes.replace_page_kind(store, "p", 1, "gridmarks", new) == 2
    assert rows(store.table("chunks", "p")) == [(1, 1, "text", "x"), (3, 2, "gridmarks", "z"), (4, 1, None, "n"), (9, 1, "gridmarks", "new")]
    assert rows(store.table("identifiers", "p")) == [(1, "S1"), (3, "S3")]
    assert rows(store.table("identifiers", "q")) == [(1, "S1"), (2, "S2"), (3, "S3")]
    assert changes.replace_page_kind(store, "p", 77, "gridmarks", new) == 2


def test_failure_between_tables_leaves_the_old_state(spark, store, monkeypatch):
    before, put = rows(store.table("chunks")), changes.Change.put

    def failing(self, name, partition, df):
        if name == "identifiers":
            raise OSError("the disk is full")
        put(self, name, partition, df)

    monkeypatch.setattr(changes.Change, "put", failing)
    with pytest.raises(OSError, match="full"):
        changes.replace_page_kind(store, "p", 1, "gridmarks", spark.createDataFrame([], SCHEMAS["chunks"]))
    assert store.manifest()[0] == 1 and rows(store.table("chunks")) == before


def test_of_two_writers_one_wins(spark, store):
    one, two = store.change(), store.change()
    one.drop("pages", "p")
    two.put("pages", "p", spark.createDataFrame([(5, "z")], SCHEMAS["pages"]))
    assert one.commit() == 2
    with pytest.raises(changes.Conflict):
        two.commit()
    assert rows(store.table("pages", "p")) == [] and len(rows(store.table("pages"))) == 2


def test_purge_and_open_readers(spark, store):
    reading = store.table("chunks", "p")
    _, before = store.manifest()
    assert changes.purge(store, "p") == 2
    assert all(store.table(t, "p").count() == 0 for t in SCHEMAS) and store.table("chunks", "q").count() == 4
    assert reading.count() == 4  # who began before still reads what was there
    assert store.manifest()[1] == {t: {"q": f["q"]} for t, f in before.items()}


def test_save_run(spark, store):
    found = spark.createDataFrame([("a", "high", "n", "e2"), ("b", "high", "n", "e2"), ("c", "high", "n", "e2"), ("d", "low", "n", "e3"), ("d", "low", "n", "e3")], "fingerprint string, confidence string, subject string, evidence string")
    assert changes.save_run(store, "p", "r1", found) == 2
    assert rows(store.table("candidates", "p")) == [("a", "pending", "targeted_review", "r1", "high", "n", "e2"), ("b", "accepted", "targeted_review", "r0", "low", "s", "e"), ("c", "pending", "deterministic_scan", None, "low", "s", "e"), ("d", "pending", "targeted_review", "r1", "low", "n", "e3")]
    assert rows(store.table("runs", "p")) == [("r1", 2)]
    changes.save_run(store, "p", "r1", found.filter("fingerprint = 'a'"))
    assert rows(store.table("runs", "p")) == [("r1", 1)]
