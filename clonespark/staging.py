"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset in local mode a temporary
    folder, which is then set.  Executors of a cluster share no such folder, so
    there it must be given."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="clonespark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed: its folder
    goes on their path.  On a cluster, install it or send it by --py-files."""
    folder = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in paths:
        env["PYTHONPATH"] = os.pathsep.join([folder, *paths])


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which :func:`clean` deletes."""
    return f"{_own_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _own_tables(spark: SparkSession) -> str:
    """Several applications may share the folder."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it again.

    That cuts lineage: a lost executor costs a re-read, never a recomputation,
    and what was computed once is planned once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clonespark_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_clonespark_path", None)
        if path:
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` left in this application; for the end
    of a job, once its results have been written."""
    _delete(spark, _own_tables(spark))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
