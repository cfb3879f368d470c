"""Where the engine keeps what it has to write: staged results, and stored files moved into place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; a local session without that setting gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="quaymaster-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is evaluated once however often it is used, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/quaymaster/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = folder(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, source: str, target: str) -> None:
    """``source`` becomes ``target``, replacing what is there."""
    fs, old = folder(spark, source)
    _, new = folder(spark, target)
    fs.mkdirs(new.getParent())
    if fs.exists(new):
        fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"{source} can't become {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = folder(spark, path)
    fs.delete(at, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false if it is there already."""
    fs, at = folder(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:  # the gateway wraps what the file system raises
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True
