"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where there is none and the master is local."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="annalist-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder, without their lineage; Spark removes the files with the DataFrame."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which goes when the session ends; for larger tables than cut()."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch_path = at
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing reads any more.

    Spark does so when the JVM's collector finds them gone, which on a driver with little to do is late.
    """
    gc.collect()  # what Python holds of finished queries
    spark._jvm.System.gc()


def forget(*dfs: DataFrame) -> None:
    """Deletes tables of scratch() that nothing reads any more, and such shuffles' files; see tidy()."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for df in dfs[:1]:
        tidy(df.sparkSession)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under column names that nothing else has, and the new name of each old one; see put_back()."""
    names = {c: f"own {i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of set_aside() under their old names."""
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))
