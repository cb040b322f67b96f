"""Tables written between the steps of a job.

``cut`` writes a frame to the folder that all executors share and reads it
back.  What follows then depends on files that outlive any executor, not on
shuffle output or cached blocks, and the plan above the cut is planned once.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}
_WRITTEN: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` as the cluster set it.

    Only a local-mode session without that setting gets a folder of its own;
    on a cluster a machine-local folder would not be seen by the executors, so
    a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN_ROOTS[app]


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed when the application ends."""
    top = f"{shared_root(spark)}/millrace-{spark.sparkContext.applicationId}"
    if top not in _WRITTEN:
        _WRITTEN.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it.

    The files stay until the application ends (later frames read them lazily),
    then they are removed.  The finished job's shuffle files are released now.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    gc.collect()  # frames in reference cycles still hold their plans, and so their shuffle files
    spark.sparkContext._jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(staged: DataFrame) -> None:
    """Remove the files of a frame that ``cut`` returned, once nothing reads them any more."""
    _remove(staged.sparkSession, staged._staged_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass
