"""Token matrices by chunk: a content-addressed store that is never pruned with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.upsert import upsert

SCHEMA = "chunk string, num_tokens int, dimension int, data array<float>"


class EmbeddingStore:
    """Matrices in a Parquet folder; each write adds a generation, the newest wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self) -> DataFrame:
        try:
            rows = self.spark.read.option("recursiveFileLookup", "true").schema(SCHEMA + ", generation bigint").parquet(self.root)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)
        newest = rows.groupBy("chunk").agg(F.max_by(F.struct("num_tokens", "dimension", "data"), "generation").alias("m"))
        return newest.select("chunk", "m.*")

    def store(self, matrices: DataFrame, generation: int) -> None:
        """Add matrices; those whose data doesn't fit their shape are refused."""
        good = matrices.where("size(data) = num_tokens * dimension")
        kinds = [F.col(c).cast(k).alias(c) for c, k in (x.split() for x in SCHEMA.split(", "))]
        good.select(*kinds, F.lit(generation).cast("bigint").alias("generation")).write.mode("append").parquet(
            f"{self.root}/generation={generation:08d}-part"
        )

    def batch_load(self, wanted: DataFrame) -> DataFrame:
        """wanted (pos, chunk) in its order with matrices, null where one is missing."""
        return wanted.join(self.load(), "chunk", "left").orderBy("pos")

    def shapes(self) -> DataFrame:
        return self.load().where("size(data) = num_tokens * dimension").select("chunk", "num_tokens", "dimension")


def one_dimension(matrices: DataFrame) -> int:
    """The dimension all matrices share; an error if they don't."""
    low, high = matrices.agg(F.min("dimension"), F.max("dimension")).first()
    if low is None or low != high:
        raise ValueError(f"embeddings of different dimensions: {low} and {high}")
    return low


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["chunk"])
