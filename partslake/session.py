"""Session settings and lineage cutting shared by tests, bench and operators."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

PREFIX = "partslake-"

# Settings the operators are written for. Sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", name: str = "partslake") -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.partslake.spread", "8")  # single-file tables over all cores
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="partslake-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


# Folders made inside `leased`, by the innermost one.
_lease: ContextVar[list[str] | None] = ContextVar("lease", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, marked with the application that made it."""
    path = f"{checkpoint_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    if (made := _lease.get()) is not None:
        made.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def leased(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end, also after a failure.

    Write or collect the result inside: a DataFrame that leaves has lost its tables.
    """
    token = _lease.set([])
    try:
        yield
    finally:
        made = _lease.get()
        _lease.reset(token)
        for path in made:
            _remove(spark, path)


def sweep(spark: SparkSession, idle_hours: float = 168.0) -> list[str]:
    """Remove what applications that ended without cleaning up left in the shared folder.

    Spark gives each application a folder of its own in the one that ``spark.checkpoint.dir``
    names. In these, only folders named by :func:`scratch` go, of other applications, in which no
    file or folder is younger than ``idle_hours``: it must exceed the longest run of an application.
    """
    shared = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark)).getParent()
    fs = shared.getFileSystem(spark._jsc.hadoopConfiguration())
    own = f"{PREFIX}{spark.sparkContext.applicationId}-"
    before = (time.time() - idle_hours * 3600) * 1000
    gone = []
    for application in fs.listStatus(shared):
        for folder in fs.listStatus(application.getPath()) if application.isDirectory() else ():
            name = folder.getPath().getName()
            if not (folder.isDirectory() and name.startswith(PREFIX)) or name.startswith(own):
                continue
            newest, files = folder.getModificationTime(), fs.listFiles(folder.getPath(), True)
            while files.hasNext():
                newest = max(newest, files.next().getModificationTime())
            if newest < before:
                fs.delete(folder.getPath(), True)
                gone.append(name)
    return gone


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query started inside go when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, release: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them from there.

    Survives the loss of executors, and gives every consumer the same rows even if the
    plan above samples (range partitioning). A Parquet table rather than a checkpointed
    RDD, so that each consumer reads only its columns. With ``release`` the shuffle files
    of the write do not wait for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    with _releasing(spark) if release else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
