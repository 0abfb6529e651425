"""What the corpus operators share: table access, shared storage and batch helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow batch may hold. Texts may be long, so batches stay small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of each Arrow batch sent to Python for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the rows of each Arrow batch, and of each batch read from Parquet, of what runs inside, and puts the session's own bounds back afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(min(rows, int(before[names[1]])) if name == names[1] else rows))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir).

    All paths of an application lie in one folder there, named by its id: release() removes it, or whoever cleans up
    after the application. Without the setting only a local master has a folder, a temporary one.
    """
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/quillspark-shared"
    return f"{base.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes this application's stored tables: for when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, path: str | None = None, row_group: int | None = None) -> DataFrame:
    """Writes df once to shared storage and reads it back, which cuts the lineage there.

    Later uses read the files again, so neither a lost executor nor a second
    use computes df anew. A path given replaces what it held, for tables of rounds.
    row_group: bytes that a task holds before it writes them, for rows of some MB
    each, of which Parquet would otherwise hold a hundred before it looks.
    """
    path = path or shared_path(df.sparkSession, name)
    sizes = {} if row_group is None else {"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    df.write.mode("overwrite").options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: further columns, clashing names too, don't matter."""
    return df.select(*[F.col(n) for n in names])


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its own columns of these names renamed, and what gives df's columns back in the end.

    An operator that filters rows may then add columns of these names without touching the rows' own.
    """
    own = df.columns
    taken = {c for c in own if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed({c: f"_own_{c}" for c in taken}), lambda out: out.select(*[F.col(f"_own_{c}").alias(c) if c in taken else F.col(c) for c in own])


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the decimal doc_id leaves this remainder."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_below(df: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """About bound of total rows, chosen by a hash of key: the same rows on every run."""
    if total <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * bound / total))


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that applies work to each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return run


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most `most`, or hold one item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


ASCII_LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Words of letters, digits and all non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER_WORDS).split()



def space_words(text: str) -> list[bytes]:
    """Words between the six ASCII spaces, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
