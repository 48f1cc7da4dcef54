"""Shared folder, materialisation and row hygiene used by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests, single machine) gets a temporary folder.
    """
    return shared_folder(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return that table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what a Python worker has freed to the system: it stays alive and serves other tasks next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, after which memory is given back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts_of(batch: pa.RecordBatch, column: int, rows: int = 512) -> Iterator[tuple[int, list]]:
    """Values of a column in lists of some ``rows``, each with the number of its first row."""
    for at in range(0, batch.num_rows, rows):
        yield at, batch.column(column).slice(at, rows).to_pylist()


#: Bytes of rows, as JSON, that may be broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, as JSON text, take at most ``limit`` bytes. Pass what is materialised."""
    rows = df.limit(limit // 16 + 1).count()
    if rows > limit // 16:
        return False
    return (df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0) <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is. Pass what is materialised."""
    return F.broadcast(df) if small(df, limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts; Spark's default is for narrow rows.
TEXT_BATCH = "1000"


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after its session has been told to send whole texts to Python in smaller batches.

    A batch is held by the JVM and by the worker, for each task. A session that has a setting of its
    own keeps it.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, TEXT_BATCH)
    return docs


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text counts as empty.

    Rows without an id cannot be told apart and are left out. Further columns are ignored.
    """
    docs = text_batches(docs)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
