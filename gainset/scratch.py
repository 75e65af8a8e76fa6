"""Written tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  A table written there
cuts lineage and survives the loss of any executor, and columnar files are both
smaller than checkpointed rows and readable column by column.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode and only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gainset-")
    return _LOCAL[app]


def stored(df: DataFrame, name: str, free: bool = True, options: dict | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What was shuffled for it isn't needed any longer.  Spark deletes such files when
    the driver's JVM finds their handles unused, so with ``free`` it is asked to look.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gainset/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.append((spark, path))
    if free:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _clear() -> None:
    """Best effort at the end of the driver; a table must outlive lazy plans that read it."""
    for spark, path in _WRITTEN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
