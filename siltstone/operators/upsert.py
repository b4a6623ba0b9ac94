"""Set operations that keep tables in step: upserts, deletions, orphans and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of `new` replace those of `old` with the same keys; of repeats in `new` the last by `order` counts."""
    if order:
        w = W.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def update(old: DataFrame, new: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Deletions, then upserts; a deletion of a key that is also upserted or unknown does nothing."""
    return upsert(delete(old, gone, keys), new, keys)


def chunk_owners(manifest: DataFrame) -> DataFrame:
    """chunk, owners: the sorted distinct documents of each chunk."""
    return manifest.groupBy("chunk").agg(F.array_sort(F.collect_set("doc")).alias("owners"))


def orphan_chunks(indexed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Indexed chunks that no document holds any more."""
    return indexed.select("chunk").distinct().join(manifest.select("chunk"), "chunk", "left_anti")


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Chunks without an embedding, each once."""
    return wanted.select("chunk").distinct().join(cached.select("chunk"), "chunk", "left_anti")


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
