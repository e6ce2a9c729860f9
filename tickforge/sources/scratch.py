"""Written tables between steps: they cut the lineage, and a lost executor loses none of them.

They stay in the folder that the cluster names: a lazily read result needs them, so whoever owns the folder clears it after the job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local master gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_dir(spark: SparkSession, name: str = "candles") -> str:
    """A fresh folder in the shared one."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in path that begin so."""
    files, place = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith(prefix))


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a written table stands there, complete."""
    return exists(spark, f"{path}/_SUCCESS")


def once(df: DataFrame, path: str) -> DataFrame:
    """df, written to path unless an earlier try has done so: what a replayed micro-batch reads is what its first try wrote."""
    if not is_whole(df.sparkSession, path):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
