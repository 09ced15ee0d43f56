"""Pieces that several training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_dir

#: ASCII white space, which parts words; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns it as read from there: lineage ends here, and an executor that is
    lost later costs a reread, not a recomputation."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, by whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A materialize(df, name) whose tables are deleted at the end of the block; nothing read later may depend on them."""
    top = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, name: _written(df, f"{top}/{name}-{uuid.uuid4().hex}")
    finally:
        remove(spark, top)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. A plain expression inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null and for blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def window_hashes(ws: Column, width: int) -> Column:
    """A 64-bit hash for each run of `width` words, in order; ws must be a column or a lambda's variable."""
    return F.when(F.size(ws) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
    )


def tidy(batches: Iterator) -> Iterator:
    """The batches, and then what the task has freed goes back to the system: an idle worker should hold little."""
    import ctypes
    import gc

    import pyarrow as pa

    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))
