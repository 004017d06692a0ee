"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where that is unset and everything runs in this process, as in tests, a folder is made and
    set; a cluster without the setting is refused, as a folder of one machine would lose data.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if held:
        return held
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not before.isDefined():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="steps-"))
        before = spark.sparkContext._jsc.sc().getCheckpointDir()
    return before.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of all tables that this process has written, in the order of their making.
made: list[str] = []


def written_at(df: DataFrame, path: str) -> DataFrame:
    made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and lost executors lose nothing."""
    return written_at(df, fresh_path(df.sparkSession, name))


def _found(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _found(spark, path)
    return store.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    store, where = _found(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def removed(spark: SparkSession, path: str) -> None:
    store, where = _found(spark, path)
    store.delete(where, True)


def remove_made(spark: SparkSession, since: int, keep: str | None = None) -> None:
    """Removes the tables that were written since ``made`` had so many entries, but for one."""
    for path in made[since:]:
        if path != keep:
            removed(spark, path)
    made[since:] = [keep] if keep else []
