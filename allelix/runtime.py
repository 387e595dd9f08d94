"""What a session needs before it runs this package's Python functions."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So that Python workers, which Spark keeps from task to task, give large blocks back once they are freed.
ALLOCATION = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver did (clusters install it instead).

    Arrow batches are bounded by bytes, unless the session says otherwise: very long texts then need no more memory than short ones. The same holds for how
    the workers allocate memory.
    """
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    for name, value in ALLOCATION.items():
        environment.setdefault(name, value)
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


#: Lookup tables of so many rows are broadcast: some tens of megabytes at most. Larger ones are joined by a shuffle.
MOST_BROADCAST = 500_000


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, to be joined; instead of literals in a plan, whose number would grow with it."""
    found = spark.createDataFrame(rows, schema)
    return F.broadcast(found) if len(rows) <= MOST_BROADCAST else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="allelix-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_place(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there goes when the driver's Python ends."""
    to = f"{shared_dir(spark)}/allelix-{re.sub(r'[^A-Za-z0-9]+', '-', label)}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, to)
    return to


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: it is computed once, and its lineage is cut. It goes when the driver's Python ends."""
    spark = df.sparkSession
    to = shared_place(spark, label)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared ones, if the session still runs."""
    if not running(spark):
        return
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def running(spark: SparkSession) -> bool:
    """Whether the session's machine is there and its context not stopped; at the end of Python it may be neither."""
    try:
        return spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped()
    except Py4JError:
        return False
