"""The event ledger and the edit feed as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..runtime import work_dir


def is_test_run(command: Column) -> Column:
    return command.rlike(fixed.TEST_RUNNERS)


def test_runs(commands: DataFrame) -> DataFrame:
    """commands(timestamp, command) that run tests, as ledger events; batch or stream."""
    return commands.where(is_test_run(F.col("command"))).select("timestamp", F.lit("test_run").alias("event"), F.to_json(F.struct("command")).alias("data"))


def test_gate(events: DataFrame, *keys: str) -> DataFrame:
    """Per key the largest ids of edits and test runs, and whether a test came last; for complete or update mode."""
    at = lambda e: F.max(F.when(F.col("event") == e, F.col("id")))
    out = events.groupBy(*keys).agg(at("edit").alias("last_edit"), at("test_run").alias("last_test"))
    return out.withColumn("tested", F.col("last_edit").isNull() | F.coalesce(F.col("last_test") > F.col("last_edit"), F.lit(False)))


def recent_edits(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Edits in each window of event time `ts`, late ones up to `delay`."""
    return events.where("event = 'edit'").withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("edits"))


def apply_edits(edits: DataFrame, load, save, checkpoint: str, **trigger):
    """Each micro-batch of edits(path, language, hash, content, ts) goes through the batch update.

    load() gives the current graph, save(graph, batch_id) writes a new version and must be
    idempotent for a batch id. The last edit of a path in a batch counts.
    """
    from ..operators.changes import update

    def one(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("language", "hash", "content"), "ts").alias("r"), F.max("ts").alias("ts"))
        now = batch.agg(F.coalesce(F.max(F.unix_millis("ts")), F.lit(0))).first()[0]
        save(update(load(), last.select("path", "r.*"), now), batch_id)

    return edits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reindex_due(dirty: DataFrame, threshold: int = 5) -> DataFrame:
    """One row: whether as many files are dirty as start an index run."""
    return dirty.agg((F.count("*") >= threshold).alias("due"), F.count("*").alias("n_dirty"))


def drain(rows: DataFrame, mode: str = "complete") -> DataFrame:
    """What a streaming aggregate holds once its source is read up; batches go to the shared folder."""
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession, "stream")
    rows.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/{n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    last = 0
    while True:  # batches are numbered from 0; complete mode repeats the whole in the last one
        try:
            out = spark.read.schema(rows.schema).parquet(f"{folder}/out/{last}")
        except AnalysisException:
            return spark.createDataFrame([], rows.schema) if not last else out
        last += 1
