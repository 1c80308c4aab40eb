"""Session settings and the scratch location shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; each can be overridden by the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, readable from every executor.

    Only a local session may fall back to a temporary folder: on a cluster such a
    folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_RECORDS: list[list[str]] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths :func:`fresh_dir` gives out meanwhile, for a caller that knows when they are of no more use."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not record]


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "stage", *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Unlike a local checkpoint the files outlive any executor, so a lost machine
    costs a re-read and not the whole history of an iterative job. Columns named as
    ``folders`` partition the files.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give a scan that has fewer splits than the cluster has cores enough partitions.

    A table in one row group would otherwise keep one core busy with all its text. Only
    such small inputs are shuffled: a scan with at least one split per core is returned
    as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    Done once per Spark context; not needed when the package is installed on every
    machine or given with ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "shelfmark.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    context._shelfmark_shipped = True
