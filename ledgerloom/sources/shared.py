"""Tables between the steps of a job: in the folder that the cluster names, so that every executor sees them and a lost one costs no more
than its own tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir; a temporary one in a local session without it; None on a cluster without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        return None
    if not getattr(sc, "_ledgerloom_tables", None):
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc._ledgerloom_tables = f"file://{folder}"
    return sc._ledgerloom_tables


def new_path(spark: SparkSession, name: str) -> str:
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back, so that plans of rounds stay short."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def deleted(spark: SparkSession, path: str | None) -> None:
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Deletes what written() made for `df`, if nothing will read it again."""
    deleted(df.sparkSession, getattr(df, "written_path", None))
