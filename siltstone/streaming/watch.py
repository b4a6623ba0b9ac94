"""A stream of sightings in front of the watermark ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .ledger import WatermarkLedger


def follow(
    spark: SparkSession,
    path: str,
    schema: str,
    ledger: WatermarkLedger,
    baseline: DataFrame,
    checkpoint: str,
    version: tuple[str, ...] = ("found_at", "obs_id"),
    value: str = "mtime",
) -> StreamingQuery:
    """Commit every micro-batch of new files under `path` as a run of the ledger.

    The commit sequence is the number of the batch a row came with, so a row
    is never behind the watermark, however late it is. A batch that is delivered again after a failure is recognised by its
    number and not committed twice. The query ends when all files are read;
    start it again with the same checkpoint to go on.
    """

    def commit(batch: DataFrame, number: int) -> None:
        last = ledger.last()
        if (last and number in last["runs"]) or batch.isEmpty():
            return
        arrived = batch.withColumn("_arrived", F.timestamp_micros(F.lit(number + 1)))
        ledger.run(number, arrived, "_arrived", number + 1, list(version), value, baseline)

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
