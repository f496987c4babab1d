"""A growing checkpoint log merged into a table while another process appends to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.sources.io import parse_checkpoint

KEYS = ["id", "type", "model", "sent_idx", "percentage", "text"]


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the log's files as they come, in long form."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_checkpoint(lines).where("status = 'ok'").select(*KEYS, "rewritten")


def merge_log(spark: SparkSession, folder: str, target: str, state: str, seed: DataFrame | None = None) -> StreamingQuery:
    """Append each batch's new keys to ``target`` (fill-missing: what is there wins, a null counts as there).

    Keys that earlier batches had are known from the stream's own state (by key, on the executors), so no batch
    reads the target; ``seed`` holds keys that are there already from elsewhere, and is read by each. A batch goes to
    a folder of its own number, so one that is run again after a failure replaces itself.
    """
    fill = lambda df: df.withColumn("__k", F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in KEYS])))
    fresh = fill(read_log(spark, folder))
    if seed is not None:
        fresh = fresh.join(fill(seed).select("__k").distinct(), "__k", "left_anti")
    fresh = fresh.dropDuplicates(["__k"]).drop("__k")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
