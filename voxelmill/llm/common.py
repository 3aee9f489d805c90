"""Helpers shared by the operators: shared folders, hold-out folds, bounded batches."""

import ctypes
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.session import ensure_checkpoint_dir

FOLDS = 5
#: Bytes of text handled at once inside a task; a longer single text is a batch of its own.
BATCH_BYTES = 1 << 20


def shared_path(spark, name) -> str:
    """A new folder in the shared folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id) -> Column:
    """crc32 of the id as text modulo 5; a null id falls in fold 2, which no contract holds out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(2))


def text_batches(batches, column="text", limit=BATCH_BYTES):
    """Record batches cut so that the texts of each have at most ``limit`` bytes (or are one row)."""
    yield from _cut(batches, lambda b: pc.binary_length(b.column(column)), limit)


def list_batches(batches, column, limit=1 << 15):
    """Record batches cut so that the lists of each have at most ``limit`` entries (or are one row)."""
    yield from _cut(batches, lambda b: pc.list_value_length(b.column(column)), limit)


def _cut(batches, length, limit):
    try:
        for batch in batches:
            sizes = pc.fill_null(length(batch), 0).to_numpy(zero_copy_only=False)
            start, held = 0, 0
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > limit:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n
            if start < batch.num_rows:
                yield batch.slice(start)
    finally:
        hand_back()


def hand_back():
    """Returns free memory to the system: workers outlive their tasks and share the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def without(df: DataFrame, *names) -> DataFrame:
    """``df`` without columns that an operator is about to add: its own take their place."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c)
                                       for c in columns.values()], names=list(columns))


def small_batches(spark, size=8 << 20):
    """Arrow batches of at most ``size`` between Spark and its Python workers, unless the session says less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):  # Spark's own default
        spark.conf.set(key, str(size))


def pin_scans(spark):
    """From now on a scan of stored files is dealt out alike each time.

    Spark cuts files by the number of cores alive, which changes when executors come and go. Row
    numbers of a scan (monotonically_increasing_id) mean the same rows later only if it does not.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
