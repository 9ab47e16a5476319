"""Tables written between the steps of an operator, in storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_default: list[str] = []
_ended: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one of this machine, which only
    a session with a local master can share; any other raises ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _default:
        _default.append(tempfile.mkdtemp(prefix="pulsegrid-"))
    return "file://" + _default[0]


def release() -> None:
    """Give memory that has been freed back to the system: after fitting, and after each partition, whose worker may idle."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


#: Bytes that a partition must have read for ``releasing`` to be worth its collection, about 0.1 s of CPU.
RELEASE_BYTES = 1_000_000


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's Arrow batches, and ``release`` after it unless the partition was small."""

    def whole(batches: Iterator) -> Iterator:
        read = [0]

        def counted() -> Iterator:
            for batch in batches:
                read[0] += batch.nbytes
                yield batch

        yield from run(counted())
        if read[0] >= RELEASE_BYTES:
            release()

    return whole


#: Rows of an Arrow batch of whole texts at most: some MB, where the default of 10,000 rows takes a hundred.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``TEXT_ROWS`` rows from now on; workers' memory follows the batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit() -> None:
    for spark, path in _ended:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, S110  the session is gone, and its folder with it
            pass


atexit.register(_at_exit)


class Scratch:
    """Writes tables and rereads them: lineage ends there, so a lost executor costs one step, not all.

    ``close`` removes all tables but those kept, whose files last as long as the session since results
    are read lazily.
    """

    def __init__(self, spark: SparkSession, what: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        _ended.append((spark, self.root))

    def path(self, name: str) -> str:
        where = self.paths[name] = f"{self.root}/{name}-{len(self.paths)}"
        return where

    def put(self, df: DataFrame, name: str) -> DataFrame:
        old = self.paths.get(name)
        where = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(where)
        self.paths[name] = where
        if old:
            self.paths[f"{name}-{uuid.uuid4().hex[:8]}"] = old
        return self.spark.read.schema(df.schema).parquet(where)  # named, else a job looks for it

    def close(self, *keep: str) -> None:
        for name in [x for x in self.paths if x not in keep]:
            remove(self.spark, self.paths.pop(name))
