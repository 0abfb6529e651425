"""Changes of several tables that become visible together or not at all.

A store is a folder. The data of a table's partition lies in a folder of its own that is never written again; which
folders count is said by one manifest, a small JSON file with a number. A change stages new folders and commits the next
manifest, which exactly one writer can create: readers see all of a change or nothing of it, and of two changes based
on the same manifest the second one is refused. Only partitions that change are written, whatever the tables' size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Somebody committed since this change began."""


class Store:
    """Tables by name and partition (a project, say) under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str) -> object:
        return self._hadoop.Path("/".join((self.root, *names)))

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """Number and content (table -> partition -> folder) of the last manifest; 0 and nothing at first."""
        folder = self._path(MANIFESTS)
        numbers = [int(x.getPath().getName()) for x in self._files.listStatus(folder) if x.getPath().getName().isdigit()] if self._files.exists(folder) else []
        if not numbers:
            return 0, {}
        lines = self.spark.read.text(f"{self.root}/{MANIFESTS}/{max(numbers):012d}", wholetext=True).first()[0]
        return max(numbers), json.loads(lines)

    def table(self, name: str, *partitions: str) -> DataFrame:
        """The rows of some partitions, or of all, as the last manifest has them."""
        folders = self.manifest()[1].get(name, {})
        chosen = sorted(f for p, f in folders.items() if not partitions or p in partitions)
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/{f}" for f in chosen]) if chosen else self.spark.createDataFrame([], self.schemas[name])

    def change(self) -> Change:
        return Change(self)


class Change:
    """Staged partitions of any number of tables, committed once."""

    def __init__(self, store: Store):
        self.store, (self.number, self.before) = store, store.manifest()
        self.staged: dict[tuple[str, str], str | None] = {}

    def table(self, name: str, *partitions: str) -> DataFrame:
        """Rows as they were when this change began."""
        folders = self.before.get(name, {})
        chosen = sorted(f for p, f in folders.items() if not partitions or p in partitions)
        root, spark = self.store.root, self.store.spark
        return spark.read.schema(self.store.schemas[name]).parquet(*[f"{root}/{f}" for f in chosen]) if chosen else spark.createDataFrame([], self.store.schemas[name])

    def put(self, name: str, partition: str, rows: DataFrame) -> None:
        """Writes what a partition will hold; nobody sees it before commit()."""
        folder = f"{name}/{uuid.uuid4().hex}"
        empty = self.store.spark.createDataFrame([], self.store.schemas[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty]).write.parquet(f"{self.store.root}/{folder}")
        self.staged[name, partition] = folder

    def drop(self, name: str, partition: str) -> None:
        self.staged[name, partition] = None

    def commit(self) -> int:
        """Makes all that was staged visible at once."""
        after = {name: dict(folders) for name, folders in self.before.items()}
        for (name, partition), folder in self.staged.items():
            if folder is None:
                after.get(name, {}).pop(partition, None)
            else:
                after.setdefault(name, {})[partition] = folder
        store, number = self.store, self.number + 1
        store._files.mkdirs(store._path(MANIFESTS))
        # written aside and renamed: renaming onto a manifest that exists fails, so one writer wins
        draft, final = store._path(MANIFESTS, f".draft-{uuid.uuid4().hex}"), store._path(MANIFESTS, f"{number:012d}")
        out = store._files.create(draft, False)
        out.write(bytearray(json.dumps(after, sort_keys=True).encode()))
        out.close()
        if store._files.exists(final) or not store._files.rename(draft, final):
            store._files.delete(draft, False)
            raise Conflict(f"manifest {number} is taken")
        return number


def purge(store: Store, project: str) -> int:
    """Removes a project from every table, in one change. Folders are left to whoever cleans up after the last reader."""
    change = store.change()
    for name, folders in change.before.items():
        if project in folders:
            change.drop(name, project)
    return change.commit()


def replaced_kind(chunks: DataFrame, identifiers: DataFrame, new: DataFrame, page_id: object, kind: str) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, page_id, kind, ...) with one kind of a page replaced, and identifiers without those of chunks that went.

    The other chunks of the page keep their ids, which summaries and citations hang off.
    """
    goes = (F.col("page_id") == page_id) & (F.col("kind") == kind)
    kept = chunks.filter(~F.coalesce(goes, F.lit(False)))
    gone = chunks.filter(goes).select("chunk_id")
    return kept.unionByName(new.select(*chunks.columns)), identifiers.join(gone, "chunk_id", "left_anti")


def replace_page_kind(store: Store, project: str, page_id: object, kind: str, new: DataFrame) -> int:
    """One change of chunks and identifiers; a page that isn't there changes nothing and gives the number as it was."""
    change = store.change()
    if not change.table("pages", project).filter(F.col("page_id") == page_id).limit(1).count():
        return change.number
    chunks, identifiers = replaced_kind(change.table("chunks", project), change.table("identifiers", project), new, page_id, kind)
    change.put("chunks", project, chunks)
    change.put("identifiers", project, identifiers)
    return change.commit()


def saved_candidates(stored: DataFrame, found: DataFrame) -> DataFrame:
    """stored with what a run found, by fingerprint, and `mine`: whether the run now owns the row.

    A new fingerprint is pending and of this run. A pending one of an earlier review takes the run, confidence, subject
    and evidence over; a person's decision and a scan's finding stand as they are. Of repeated findings the last by
    confidence, subject and evidence counts.
    """
    taken = ("run", "confidence", "subject", "evidence")
    n = found.groupBy("fingerprint").agg(F.max(F.struct("confidence", "subject", "evidence", "run")).alias("n"))
    s = stored.select("fingerprint", F.struct("status", "origin", *taken).alias("s"))
    j = s.join(n, "fingerprint", "full_outer")
    ours = F.col("n").isNotNull() & (F.col("s").isNull() | ((F.col("s.status") == "pending") & (F.col("s.origin") == "targeted_review")))
    return j.select("fingerprint", F.coalesce("s.status", F.lit("pending")).alias("status"), F.coalesce("s.origin", F.lit("targeted_review")).alias("origin"), *[F.when(ours, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in taken], ours.alias("mine"))


def save_run(store: Store, project: str, run: str, found: DataFrame) -> int:
    """A run's findings and its own row (how many it owns), in one change."""
    change = store.change()
    rows = saved_candidates(change.table("candidates", project), found.withColumn("run", F.lit(run)))
    change.put("candidates", project, rows)
    owned = rows.filter("mine").agg(F.count("*").alias("saved"))
    runs = change.table("runs", project).filter(F.col("run") != run)
    change.put("runs", project, runs.unionByName(owned.select(F.lit(run).alias("run"), "saved")))
    return change.commit()
