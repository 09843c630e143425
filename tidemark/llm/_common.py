"""What the operators of this subpackage share: reading tables, labelled samples, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, shared_folder  # noqa: F401  cut is for the operators

#: Bounds of every fitting sample: rows, and characters of a text. Scoring has no bound.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls into no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def held_out(key: str, parts: int, which: int) -> Column:
    return F.coalesce(fold(key, parts) == which, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` training rows (text, label), outside the held-out fold 0 of 5, each class with at most half.

    Rows are taken in the order of a hash of the id, so the choice is repeatable and does not
    follow the order of the table. Texts longer than ``chars`` are left out of the *sample*
    (they are scored whole like all others). Conflicting labels or texts of one id: the smallest.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .where(fold("_id", 5) != 0)
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"))
        .withColumn("_rank", F.xxhash64("_id"))
    )
    half = [known.where(F.col("_y") == y).orderBy("_rank", "_id").limit(rows // 2) for y in (0, 1)]
    chosen = half[0].unionAll(half[1])
    return (
        docs.select(F.col("doc_id").alias("_id"), "text")
        .where(F.length("text") <= chars)
        .join(F.broadcast(chosen), "_id")  # bounded by ``rows``
        .groupBy("_id", "_rank", F.col("_y").alias("label"))
        .agg(F.min("text").alias("text"))  # one text of an id, however often the id repeats
    )


#: Bytes of an Arrow batch beyond which Spark starts the next.
BATCH_BYTES = 32 << 20


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table in the checkpoint's folder: a third of the disk; ``discard`` removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more; others stay untouched."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bind_batches(spark: SparkSession, rows: int = 500) -> None:
    """Small Arrow batches: a batch of long texts must fit beside the JVM on an executor.

    The settings stay: the plans that need them run after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]
#: Seconds of work after which a Python worker gives freed memory back, and does so again at the end of each task.
RELEASE_S = 1.0


def release() -> None:
    """Gives memory that this process has freed back to the system; allocators would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _released(run: Callable[[Batches], Batches], batches: Batches) -> Batches:
    last = time.monotonic()
    try:
        for batch in run(batches):
            yield batch
            del batch
            if time.monotonic() - last > RELEASE_S:
                release()
                last = time.monotonic()
    finally:
        release()


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, giving back what it frees: Python workers live on between tasks, stages and queries, beside the JVM of an executor."""
    return functools.partial(_released, run)


#: Rows of a small table that one shuffle partition takes inside ``small_plans``.
ROWS_A_PARTITION = 50_000


@contextlib.contextmanager
def small_plans(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Runs many small plans without compiling each into classes of its own, over partitions to suit ``rows``.

    Iterative operators make hundreds of plans; the compiled code and the task records of each
    would stay in the driver's memory and cost more than they save.
    """
    now = {"spark.sql.codegen.wholeStage": "false"}
    if rows is not None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        now["spark.sql.shuffle.partitions"] = str(max(4, -(-rows // ROWS_A_PARTITION)) if rows < most * ROWS_A_PARTITION else most)
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
