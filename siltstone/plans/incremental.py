"""Replays recorded sync runs through the watermark ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import scratch
from ..streaming.ledger import WatermarkLedger

KEYS = ["collection", "relative_path"]


def replay_sync_runs(runs: DataFrame, sightings: DataFrame, metadata: DataFrame, root: str | None = None) -> DataFrame:
    """Files each successful run takes: run_id, collection, relative_path, mtime.

    Runs go in order of started_at (then run_id); only state `ok` commits, so
    whatever a failed run would have read is still ahead of the watermark for
    the next one. A run sees rows delivered at or before its start. Rows
    without mtime, delivery time, collection or path tell nothing. No ok run
    or no sighting gives an empty result.
    """
    spark = runs.sparkSession
    ledger = WatermarkLedger(spark, root or scratch(spark, "ledger"), KEYS)
    # one row per run of the schedule, read in order by the driver that starts them
    todo = (
        runs.where((F.col("state") == "ok") & F.col("started_at").isNotNull())
        .select("run_id", F.unix_micros("started_at").alias("started"))
        .distinct()
        .orderBy("started", "run_id")
        .toLocalIterator()
    )
    rows = sightings.select(*KEYS, "delivered_at", "found_at", "obs_id", "mtime").where("collection IS NOT NULL AND relative_path IS NOT NULL")
    base = metadata.select(*KEYS, "mtime").where("collection IS NOT NULL AND relative_path IS NOT NULL")
    for r in todo:
        ledger.run(r["run_id"], rows, "delivered_at", r["started"], ["found_at", "obs_id"], "mtime", base)
    found = ledger.changes()
    if found is None:
        return rows.where("false").select(F.lit(0).alias("run_id"), *KEYS, "mtime")
    return found.select("run_id", *KEYS, "mtime")
