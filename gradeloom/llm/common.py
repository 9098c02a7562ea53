"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
WS_CLASS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WS_CLASS))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of one column stay near `limit` bytes, to bound memory."""
    at, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column).cast(pa.binary())).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= limit:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def releasing(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system when it ends.

    A worker serves tasks of several stages; what one of them needed would else be held beside the next.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one is made only where there is none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")

        folder = tempfile.mkdtemp(prefix="checkpoint")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which takes less room than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table that written() made, once nothing will read it again."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:  # an empty table has files too
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
