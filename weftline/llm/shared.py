"""What the operators of this subpackage share: the folder every executor sees, tables written
there to cut lineage, files opened by URI, and reading of input tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOT: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Where that is unset, a folder of our own
    below the warehouse (cluster) or a temporary folder (local master, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="weftline-")
        return _LOCAL_ROOT[app]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weftline"


class Scratch:
    """One operator run's own folder in the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write ``df`` there and read it back, so that later work starts from files. The shuffle files of the write go with it."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path, compression=codec)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_CACHES: dict[str, Callable] = {}


def claim(owner: str, clear: Callable | None = None) -> None:
    """A Python worker outlives tasks, and may run those of several operators: it keeps the caches of one at a time. Whatever others
    hold is cleared, and memory that is free goes back to the machine; ``clear`` is how this one's caches go when their turn comes."""
    import ctypes

    import pyarrow as pa

    for other in [x for x in _CACHES if x != owner]:
        _CACHES.pop(other)()
    if clear is not None:
        _CACHES[owner] = clear
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def filesystem(path: str):
    """A pyarrow filesystem and the path in it, for a URI or plain path of the shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def publish(path: str, write) -> None:
    """Write a file under a name of this attempt, then move it into place, so that a retried or
    speculative task never leaves half a file under the final name. ``write`` gets the open stream."""
    fs, p = filesystem(path)
    folder, _, name = p.rpartition("/")
    fs.create_dir(folder, recursive=True)
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp, compression=None) as out:
        write(out)
    if fs.get_file_info(p).type.name != "NotFound":
        fs.delete_file(p)
    fs.move(tmp, p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch, as whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
