"""A compressed vector index as Parquet tables: parameters, centroids, buckets and codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.vectors import Codec

VERSION = 2


def save(codes: DataFrame, codec: Codec, path: str) -> None:
    """codes: doc, cid, code (and further columns), laid out by centroid; the inverted file is derived when loaded."""
    spark = codes.sparkSession
    codes.repartition("cid").sortWithinPartitions("cid", "doc").write.mode("overwrite").parquet(f"{path}/codes")
    cents = [(i, [float(x) for x in c]) for i, c in enumerate(codec.centroids)]
    spark.createDataFrame(cents, "cid int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    params = [(VERSION, codec.nbits, codec.dim, len(cents), [float(x) for x in codec.cutoffs], [float(x) for x in codec.weights])]
    kind = "version int, nbits int, dim int, n_centroids int, cutoffs array<double>, weights array<double>"
    spark.createDataFrame(params, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/params")  # last: an index without it is none


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Codec]:
    """(codes, codec); an index of another version or with parts that don't fit is refused."""
    p = spark.read.parquet(f"{path}/params").first()
    if p is None or p["version"] != VERSION:
        raise ValueError(f"not an index of version {VERSION}: {path}")
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()  # as many as the codec may have
    cents = np.array([r["vec"] for r in rows], dtype=np.float64)
    if cents.shape != (p["n_centroids"], p["dim"]):
        raise ValueError("centroids don't fit the parameters")
    codec = Codec(p["nbits"], cents, np.array(p["cutoffs"]), np.array(p["weights"]))
    codes = spark.read.parquet(f"{path}/codes")
    width = -(-p["dim"] // (8 // p["nbits"]))
    if not codes.where((F.octet_length("code") != width) | (F.col("cid") < 0) | (F.col("cid") >= len(cents))).isEmpty():
        raise ValueError("codes don't fit the codec")
    return codes, codec
