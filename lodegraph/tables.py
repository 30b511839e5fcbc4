"""Tables that a step leaves in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table to the folder that spark.checkpoint.dir names (a temporary one where a
    session on one machine has none, as in tests): lineage ends there, and executors may be lost after that.  The tables of a
    process are removed when it ends."""
    spark = df.sparkSession
    if (top := _folders.get(spark.sparkContext.applicationId)) is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = where or tempfile.mkdtemp()
        top = _folders[spark.sparkContext.applicationId] = f"{where}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, top)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders: dict[str, str] = {}


def _remove(spark, path: str) -> None:
    if spark.sparkContext._jsc and spark.sparkContext._gateway:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass
