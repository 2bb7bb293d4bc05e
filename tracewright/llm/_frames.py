"""Small helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ship

#: Rows of output are handed to the JVM in pieces of about this many bytes.
BATCH_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; whatever else the input has is left behind."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_documents(
    df: DataFrame, schema: str, make: Callable[[], Callable[[int | None, str | None], list[tuple] | tuple]], arrow: pa.Schema
) -> DataFrame:
    """Runs ``make()(doc_id, text)`` for each row of a (doc_id, text) frame, Arrow batch by batch.

    ``make`` is called once a task, so that caches and models are built there.  The callable gives the
    output row, or a list of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            rows: list[tuple] = []
            used = 0
            for doc_id, text in ((i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)):
                got = each(doc_id, text)
                if isinstance(got, list):
                    rows += got
                else:
                    rows.append(got)
                used += len(text or "") + 64
                if used >= BATCH_BYTES:
                    yield to_batch(rows, arrow)
                    rows, used = [], 0
            if rows:
                yield to_batch(rows, arrow)

    return df.mapInArrow(releasing(run), schema)


def release() -> None:
    """Gives a Python worker's freed memory back to the system: idle workers stay beside the JVM for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries trim by themselves
        pass


def releasing(run: Callable) -> Callable:
    """``run`` over a task's batches, followed by ``release``."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that few of its texts are Python strings at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; one for tests is set where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(folder)
        return folder
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no other folder")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    ship(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of frames that nothing refers to any more.

    By itself it does so when the driver's heap happens to be collected, so files of all steps would lie beside each other.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
