"""Pieces that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that are handled at once inside one Python worker.
SLICE_BYTES = 2 << 20
#: Bytes of rows that Spark hands to a Python worker at once, beyond which it adds no row.
BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder.  Where it is unset, a single machine (a
    ``local[n]`` master, as in tests) gets a temporary folder, set for the session;
    a cluster raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="searchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, plain: bool = False) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage: what follows survives a lost executor without the
    stages before it being run again.  ``plain``: columns of hashes, which no
    dictionary makes smaller.
    """
    path = scratch(df.sparkSession, tag)
    write = df.write.option("parquet.enable.dictionary", "false") if plain else df.write
    write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches between executors and Python workers are cut by
    bytes too: by rows alone 10,000 long texts are one batch, which both sides hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of a column, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) as UTF-8 bytes, of bounded size (``most`` bytes).

    Yields (index of the first row, texts); one text may exceed the bound.
    """
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary())
    start, size, texts = 0, 0, []
    for i in range(len(column)):
        value = column[i].as_py() or b""
        texts.append(value)
        size += len(value)
        if size >= most:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts


def trim() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    """``trim`` after the garbage is collected."""
    gc.collect()
    trim()


_resident: dict = {}


def resident(key: tuple, make: Callable):
    """What a worker process keeps from task to task under ``key``.

    A worker serves one operator after another; only what the last one keeps stays, so
    the memory of a long job is that of its largest operator.
    """
    if key not in _resident:
        _resident.clear()
        give_back()
        _resident[key] = make()
    return _resident[key]


class BoundedCache(dict):
    """A dict that is emptied when it would exceed ``limit`` entries.

    It only saves repeated work; what it forgets is computed again.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def fill(self, keys: set, compute: Callable[[list], list]) -> None:
        missing = [k for k in keys if k not in self]
        if not missing:
            return
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(keys)
        self.update(zip(missing, compute(missing), strict=True))
