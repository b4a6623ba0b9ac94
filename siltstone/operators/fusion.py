"""Reciprocal rank fusion and collapsing of chunk hits to documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

RRF_K = 60
LEG_LIMIT = 100


def ranked(scored: DataFrame, doc: str = "doc", limit: int = LEG_LIMIT) -> DataFrame:
    """doc, rank: the best `limit` rows numbered from 1 (a bounded list)."""
    best = scored.orderBy(F.desc("score"), doc).limit(limit)
    return best.select(F.col(doc).alias("doc"), F.row_number().over(W.orderBy(F.desc("score"), doc)).alias("rank"))


def reciprocal_rank_fusion(*legs: DataFrame) -> DataFrame:
    """doc, score of ranked lists (doc, rank): the sum of 1 / (60 + rank)."""
    rows = reduce(DataFrame.unionByName, [x.select("doc", "rank") for x in legs])
    return rows.groupBy("doc").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def collapse(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """doc, score, best_chunk: chunk hits fanned out to owning documents, the best chunk of each kept.

    Of equal scores the chunk that ranks first (smallest id) wins.
    """
    return (
        hits.join(owners, "chunk")
        .groupBy("doc")
        .agg(F.max("score").alias("score"), F.min_by("chunk", F.struct(-F.col("score"), "chunk")).alias("best_chunk"))
    )


def match_chunk(results: DataFrame, manifest: DataFrame, text_bytes: DataFrame) -> DataFrame:
    """doc, best_chunk, start_byte, end_byte: where the best chunk first stands in its document."""
    first = manifest.groupBy("doc", "chunk").agg(F.min_by(F.struct("start_byte", "byte_len"), "pos").alias("at"))
    return (
        results.join(first, (results.doc == first.doc) & (results.best_chunk == first.chunk), "left")
        .select(results.doc, "best_chunk", "at")
        .join(text_bytes, "doc")
        .select(
            "doc", "best_chunk",
            F.col("at.start_byte").alias("start_byte"),
            F.least(F.col("at.start_byte") + F.col("at.byte_len") - 1, F.col("n_bytes") - 1).alias("end_byte"),
        )
    )
