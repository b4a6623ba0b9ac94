"""Incremental runs under a high watermark.

Every run reads the rows whose commit sequence lies in (watermark, upper],
where `upper` is fixed when the run starts, and writes what it found into a
fresh part of the table. The run exists from the moment its manifest, which
names that part and the new watermark together, appears in the log under a
number that can be given once, so either both are visible or neither, and of
two runs that start from one watermark one fails. A run that dies before
leaves an unreferenced part, and the next one starts from the old watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import ManifestLog, delete_path, folders

COMPACT_EVERY = 8


class WatermarkLedger:
    """Committed runs over one source, kept in a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.log = ManifestLog(spark, f"{self.root}/log")

    def last(self) -> dict | None:
        """The manifest of the last run; it names all that later runs and readers need."""
        return self.log.last()[1]

    def commits(self) -> list[dict]:
        """Manifests in commit order."""
        return [self.log.read(n) for n in self.log.numbers()]

    def _read(self, parts: list[str]) -> DataFrame:
        """Parts of the table in one scan; the part is a partition column, so others aren't opened."""
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/part={p}" for p in parts])

    def state(self, last: dict | None = None) -> DataFrame | None:
        """State rows as committed, newest last compaction onwards; several per key."""
        last = last or self.last()
        return self._read(last["state"]) if last else None

    def run(
        self,
        run_id: int,
        rows: DataFrame,
        seq_col: str,
        upper: int,
        version: list[str],
        value: str,
        baseline: DataFrame,
        fail_before_commit: bool = False,
    ) -> dict:
        """Process the rows in (watermark, upper] and commit.

        rows: keys, the timestamp `seq_col`, the `version` columns that order
        sightings of a key, and `value`. upper: microseconds since the epoch. baseline: keys and `value` before the first run.
        Committed are the keys whose newest version moved; `changed` marks
        those whose value differs from the one processed before.
        """
        number, done = self.log.last()
        lower = done["watermark"] if done else None
        seen = rows.where(F.col(value).isNotNull()).where(F.col(seq_col) <= F.timestamp_micros(F.lit(upper)))
        if lower is not None:
            seen = seen.where(F.col(seq_col) > F.timestamp_micros(F.lit(lower)))
        newest = F.max(F.struct(*version, F.col(value))).alias("newest")
        fresh = seen.groupBy(*self.keys).agg(newest).withColumn("side", F.lit(1))
        null_version = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in version]
        if done:
            old = self.state(done).select(*self.keys, F.struct(*version, F.col(value)).alias("newest"))
        else:
            old = baseline.where(F.col(value).isNotNull()).select(*self.keys, F.struct(*null_version, F.col(value)).alias("newest"))
        full = not done or len(done["state"]) >= COMPACT_EVERY
        merged = (
            fresh.unionByName(old.withColumn("side", F.lit(0)))
            .groupBy(*self.keys)
            .agg(
                F.max(F.when(F.col("side") == 1, F.col("newest"))).alias("now"),
                F.max(F.when(F.col("side") == 0, F.col("newest"))).alias("was"),
            )
            .select(
                *self.keys,
                F.expr("now IS NOT NULL AND (was IS NULL OR now > was)").alias("moved"),
                F.expr(f"now.{value} <> was.{value} OR was IS NULL").alias("differs"),
                F.expr("CASE WHEN was IS NULL OR now > was THEN now ELSE was END").alias("kept"),
            )
            .select(*self.keys, "kept.*", "moved", F.expr("moved AND differs").alias("changed"))
        )
        if not full:
            merged = merged.where("moved")
        part = f"r{uuid.uuid4().hex}"
        merged.drop("moved").withColumn("run_id", F.lit(run_id)).write.option("compression", "zstd").parquet(f"{self.root}/data/part={part}")
        if fail_before_commit:
            raise RuntimeError("run failed before its commit")
        manifest = {
            "run_id": run_id, "watermark": upper, "part": part,
            "state": [part] if full else [*done["state"], part],
            "runs": [*(done["runs"] if done else []), run_id], "parts": [*(done["parts"] if done else []), part],
        }
        self.log.publish(number + 1, manifest)
        return manifest

    def changes(self) -> DataFrame | None:
        """What every committed run took: run_id, keys, value columns; all parts are read in one scan."""
        last = self.last()
        if last is None:
            return None
        return self._read(last["parts"]).where("changed").drop("changed", "part")

    def vacuum(self) -> int:
        """Delete the parts of runs that died; call it while no run is under way. Returns how many there were."""
        last = self.last()
        known = set(last["parts"]) if last else set()
        dead = [f for f in folders(self.spark, f"{self.root}/data") if f.removeprefix("part=") not in known]
        for f in dead:
            delete_path(self.spark, f"{self.root}/data/{f}")
        return len(dead)
