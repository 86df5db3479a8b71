"""What the operators share: the shared folder, lineage cuts and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in every operator here.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a one-JVM session may go without: there the driver's temp folder is everybody's.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/terravane-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Scratch paths made within each open swept().
_made: list[list[str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless kept, it goes with the swept() in which it was made."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made and not keep:
        _made[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Scratch that is made within goes at the end; what reads it must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: computed once, readable after any executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder; for wide rows, which Parquet packs and prunes."""
    path = scratch(df.sparkSession, name, keep)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
