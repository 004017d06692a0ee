"""Streams over event journals: latest state per unit, progress, spend, ordered stages, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..storage import exists, listed, removed

# Stages of a slot in their order.
STAGES = ["payload", "materialization", "test_materialization", "source_census", "semantic_census", "assessment_identity", "qualification", "test_recipe", "identical_tests", "ready_for_review"]


def latest_state(state: DataFrame | None, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """State after a micro-batch: of each key the row of the largest sequence number."""
    rows = batch if state is None else state.unionByName(batch)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")).select("r.*")


class LatestTable:
    """A table of latest rows that a stream maintains by ``foreachBatch`` below ``path``, one table for each batch id.

    A batch starts from the table of the batch before it, so a stream that starts again from its checkpoint goes on with
    all keys, and a batch that comes again gives the same table again. The last two tables are kept.
    """

    def __init__(self, key: str, seq: str, path: str):
        self.key, self.seq, self.path = key, seq, path.rstrip("/")

    def _at(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        at = f"{self.path}/{batch_id}"
        return spark.read.parquet(at) if exists(spark, f"{at}/_SUCCESS") else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._at(spark, batch_id - 1)
        if before is None and batch_id:
            raise ValueError(f"the table of batch {batch_id - 1} is missing below {self.path}")
        latest_state(before, batch, self.key, self.seq).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        removed(spark, f"{self.path}/{batch_id - 2}")

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows after the last whole batch."""
        ids = sorted((int(name) for name in listed(spark, self.path) if name.isdigit() and exists(spark, f"{self.path}/{name}/_SUCCESS")), reverse=True)
        if not ids:
            raise ValueError(f"no batch has ended below {self.path}")
        return self._at(spark, ids[0])

    def attach(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.merge).outputMode("append")


def windowed_counts(events: DataFrame, time: str, by: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per window and group with a watermark for late events; the same on streams and tables."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def progress(events: DataFrame) -> DataFrame:
    """Expected, settled and retryable units per stage, with the spend of all events: exact counts, each unit by its last event of ``seq``."""
    manifest = F.coalesce(F.col("is_manifest"), F.lit(False))
    units = events.where(~manifest).groupBy("stage", "unit_id").agg(F.max_by(F.coalesce("retry_on_resume", F.lit(False)), "seq").alias("retry"), F.sum("estimated_cost_usd").alias("spent"))
    done = units.groupBy("stage").agg(F.count_if(~F.col("retry")).alias("settled"), F.count_if("retry").alias("retryable"), F.sum("spent").alias("spent"))
    expected = events.groupBy("stage").agg(F.max("expected_units").alias("expected"))
    return expected.join(done, "stage", "left").select("stage", "expected", F.coalesce("settled", F.lit(0)).alias("settled"), F.coalesce("retryable", F.lit(0)).alias("retryable"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


def stage_errors(checkpoints: DataFrame) -> DataFrame:
    """Breaks in slots' chains ``(slot, seq, stage, sha, previous_sha, terminal)``: order, hash links, events after an end."""
    from pyspark.sql import Window

    w = Window.partitionBy("slot").orderBy("seq")
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    before = F.lag(place).over(w)
    out = checkpoints.select(
        "slot",
        "seq",
        F.when(place == 0, "unknown stage")
        .when(F.row_number().over(w) != F.col("seq"), "sequence is not contiguous")
        .when(~F.lag("sha").over(w).eqNullSafe(F.col("previous_sha")), "previous hash differs")
        .when(F.coalesce(F.lag("terminal").over(w), F.lit(False)), "event after the end")
        .when(place != F.coalesce(before, F.lit(0)) + 1, "stage out of order")
        .alias("error"),
    )
    return out.where("error is not null")
