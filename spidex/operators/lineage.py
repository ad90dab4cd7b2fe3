"""Where intermediate results live: cut lineage and scratch tables, in a folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    One is made only where the session has none and runs in one process (tests); on a cluster that is an error, since each machine would
    write to a disk of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spidex-checkpoint-"))
    return (configured or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder: lineage ends there and a lost executor loses nothing.

    Its files go once no plan refers to them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], str]]:
    """Paths for tables that a job needs between its own steps; they are removed at the end of the block."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/spidex-{uuid.uuid4().hex}")
    try:
        yield lambda name: f"{base.toString()}/{name}"
    finally:
        base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(base, True)
