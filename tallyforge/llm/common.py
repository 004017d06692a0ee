"""What the operators of this subpackage share: words, Arrow helpers, shared storage."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship
from ..storage import fresh_path, made, remove_made, removed as remove_path, written as stored, written_at as stored_at

__all__ = ["fresh_path", "made", "remove_made", "remove_path", "stored", "stored_at"]

#: A word is a run of characters other than space and the five ASCII controls 09-0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows per Arrow batch: whole texts may be long, so batches stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer parts than there are cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` splits at exactly the six space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small in the given session, and gives executors the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_disk(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished queries now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key of more than this part of all rows is hot; there can be no more hot keys than ``HOT_PART``.
HOT_PART = 4096
#: Keys of fewer rows are never hot.
HOT_LEAST = 64
#: Tasks over which a hot key's rows are dealt.
DEALT = 32


def dealt_join(rows: DataFrame, keys: DataFrame, on: list[str], by: str) -> DataFrame:
    """Inner join of ``rows`` with a table of unique ``keys`` that has in ``n`` how many of ``rows`` each key has.

    The rows of hot keys are dealt over ``DEALT`` tasks by the hash of column ``by``, and their entries of
    ``keys`` are repeated for each. Only the hot keys are broadcast, at most ``HOT_PART`` of them as
    each has more than that part of the rows. ``keys`` is read twice, so it is best a stored table.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(total // HOT_PART, HOT_LEAST)
    deal, mark = free_name(rows.join(keys.limit(0), on), "deal"), free_name(rows, "mark")
    marked = rows.join(F.broadcast(keys.where(hot).select(*on, F.lit(True).alias(mark))), on, "left")
    dealt = marked.withColumn(deal, F.when(F.col(mark), F.pmod(F.xxhash64(F.lit(deal), by), F.lit(DEALT))).otherwise(0).cast("int")).drop(mark)
    each = keys.withColumn(deal, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(each, [*on, deal]).drop(deal, "n")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod5(column) -> "F.Column":
    """crc32 of the value as decimal text, modulo 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5

