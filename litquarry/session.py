"""Session helpers: table access and the shared folder for materialised intermediates."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table; naming the columns keeps the scan schema narrow and visible in the plan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer partitions than there are cores.

    For work that is heavy by row. That happens only to small inputs (one file, one row group); a scan of a large
    table has more partitions than the cluster cores and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, notebooks) is a local
    temporary folder made, and only for a local master: on a cluster a machine-local folder would be unreadable
    elsewhere, so that case is an error.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="litquarry-")
        spark.conf.set(CHECKPOINT_KEY, folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone: the operating system's temp cleaner has the folder
        pass


_WRITTEN: list[str] = []
_LOCK = threading.Lock()
_WRITERS: dict[int, tuple[int, str | None]] = {}  # session -> writers at work, the setting before them


def table_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/litquarry-{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete a path when the driver's JVM ends, however Python ends before it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def release(spark: SparkSession) -> None:
    """Delete every table this session has materialised. For long sessions, once the results read from them are stored."""
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cut lineage with a written table in the shared folder, deleted at the latest when the driver ends.

    ``by`` names the last column, if readers will take one value of it at a time: it then partitions the table.

    Parquet rather than ``checkpoint()``: columnar and compressed, so smaller on disk and prunable when read back.
    The files outlive any executor. Once the table is written, the shuffle files behind it serve nothing, so Spark is
    told to remove them with the write.
    """
    spark = df.sparkSession
    path = table_path(spark, label)
    with _shuffles_removed(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The setting for the writes inside, whatever the number of threads: set by the first, put back by the last.

    A result that a user collects twice keeps its shuffle files: it is planned outside.
    """
    with _LOCK:
        count, before = _WRITERS.get(id(spark), (0, None))
        if not count:
            before = spark.conf.get(CLEANUP_KEY, None)
            spark.conf.set(CLEANUP_KEY, "true")
        _WRITERS[id(spark)] = count + 1, before
    try:
        yield
    finally:
        with _LOCK:
            count, before = _WRITERS.pop(id(spark))
            if count > 1:
                _WRITERS[id(spark)] = count - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP_KEY)
            else:
                spark.conf.set(CLEANUP_KEY, before)


def materialise_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(the written table, its number of rows), counted while it is written."""
    seen = Observation()
    table = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return table, int(seen.get["rows"] or 0)


def release_driver(spark: SparkSession) -> None:
    """Free what finished jobs left with the driver: Python's handles first, then plans, broadcast tables and shuffle records.

    Spark lets go of them when the driver happens to collect its garbage. Many small jobs in turn fill the heap before that, up to its
    limit, which the process then keeps; so this belongs between the turns.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one materialised table."""
    _remove(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver imported it from. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_litquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="litquarry-code-")) / "litquarry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._litquarry_shipped = True
