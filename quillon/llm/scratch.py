"""Intermediate tables in the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is unset, as in
tests, a folder of our own is made. Tables written here survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_made: list[str] = []


def base(spark: SparkSession) -> str:
    """Shared folder as a URI."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    path = f"{base(spark)}/quillon-{tag}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def written(spark: SparkSession, frame: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: lineage ends at the files.

    Shuffle files that the write needed are removed when it is done.
    """
    path = folder(spark, tag)
    with _cleaned(spark):
        frame.write.option("compression", codec).parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back._quillon_path = path
    return back


def bucketed(spark: SparkSession, frame: DataFrame, tag: str, column: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """As ``written``, in buckets by ``column``; the catalog has the table only until it is read back."""
    path = folder(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _cleaned(spark):
        frame.write.format("parquet").option("compression", codec).option("path", path).bucketBy(buckets, column).saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # a table with a path of its own: the files stay
    back._quillon_path = path
    return back


def forget(spark: SparkSession, frame: DataFrame) -> None:
    """Delete the table that ``written`` gave as ``frame``; nothing may read it any more."""
    path = frame._quillon_path
    drop(spark, path)
    _made.remove(path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Results read lazily from them must be written before."""
    while _made:
        drop(spark, _made.pop())
