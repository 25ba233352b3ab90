"""Session helpers: a test session, the shared folder, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import platform
import resource
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where a local session names none, as in tests, a temporary folder is set; on a cluster that would be another folder
    on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def partitions(spark: SparkSession) -> int:
    """How many partitions work of few bytes and much time is spread over; adaptive execution would merge them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what lies before, and keeps a result that
    several branches read from being computed more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkweave/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cleanup(since: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote in this process, from the ``since``-th on; results that read them end with it."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            pass


@contextmanager
def released() -> Iterator[None]:
    """Within it tables may be written; at its end, when results have been taken, they are deleted."""
    since = len(_written)
    try:
        yield
    finally:
        cleanup(since)


def diagnosed(spark: SparkSession, step: Callable[[], Any]) -> tuple[Any, dict[str, Any]]:
    """What ``step`` gives, with its seconds, the peak memory of this process, the JVM's heap in use, and versions.

    What the cluster did is in Spark's event log; plans are shown by ``DataFrame.explain("formatted")``.
    """
    start = time.time()
    result = step()
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    return result, {
        "seconds": round(time.time() - start, 3), "python_peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024,
        "jvm_used_mb": (heap.totalMemory() - heap.freeMemory()) >> 20, "spark": spark.version, "python": platform.python_version(),
        "master": spark.sparkContext.master, "shuffle_partitions": partitions(spark), "adaptive": spark.conf.get("spark.sql.adaptive.enabled"),
    }


atexit.register(cleanup)
