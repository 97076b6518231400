"""Tables in the shared folder: written to cut lineage, read back, deleted when nothing reads them any more."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; on a cluster that names none an error.

    Only a local session without one (tests) gets a temporary folder, which goes at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _FOLDERS[app], ignore_errors=True)
        named = _FOLDERS[app]
    return named.rstrip("/")


BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """For an application: send texts to Python workers a thousand at a time, as Arrow's buffers lie outside the heap.

    A setting that is smaller already stays. Operators leave the session's settings as they are.
    """
    now = int(spark.conf.get(_BATCH_KEY))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)


@contextlib.contextmanager
def batch_rows(spark: SparkSession):
    """small_batches() for what runs inside, then the session's setting again."""
    before = spark.conf.get(_BATCH_KEY)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder when the driver's program ends."""

    def delete():
        with contextlib.suppress(Exception):  # the session's JVM may be gone by then
            _delete(spark, path)

    atexit.register(delete)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage and survives lost executors, since Spark's commit protocol only shows whole task outputs. The
    table goes with discard() or when the driver's program ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with batch_rows(spark):
        df.write.parquet(path)
    discard_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_at)
