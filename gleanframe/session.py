"""Makes this package importable on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    at, name = tempfile.mkdtemp(), os.path.basename(here)
    atexit.register(shutil.rmtree, at, ignore_errors=True)  # the driver serves the file until it ends
    shutil.copytree(here, f"{at}/src/{name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{at}/{name}", "zip", f"{at}/src"))


#: The most that a batch of rows between Spark and a Python worker takes, but for a single longer row.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches by bytes, whatever the length of the texts; a bound that the session names stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, without its plan, and not lost with an executor."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local sessions without one, a folder of this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), f"gleanframe-{os.getuid()}"))
    return context.getCheckpointDir()
