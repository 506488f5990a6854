"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local tests, where it is unset.

    On a cluster a temporary folder would lie on each machine's own disk and
    lose rows, so the setting is demanded there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="attestra-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        named = "file://" + path
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def spool(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a scan of it.

    Plans that use an intermediate more than once read it back column-pruned
    instead of running its lineage again; nothing is kept on one executor.
    ``clear`` removes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the intermediates of this application; results that still read them must be written before."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/attestra/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
