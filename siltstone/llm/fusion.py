"""One ranking from scores of several scales: leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.ranking import count_below


def leximin_vectors(results: DataFrame, legs: DataFrame) -> DataFrame:
    """query_id, doc_num_id, standing: the ascending standings of a document in all legs.

    The standing in a leg is the number of the query's documents that are
    worse there (its percentile times the number of documents, which is the
    same in all legs). Null and NaN scores don't count, of several the best
    does, documents without a usable score stand with the worst. Scores of
    legs that `legs` doesn't name and rows without query or document are
    ignored; a leg named twice counts once.
    """
    legs = legs.where("leg IS NOT NULL").groupBy("leg").agg(F.max("higher_is_better").alias("up"))
    rows = results.where("query_id IS NOT NULL AND doc_num_id IS NOT NULL").select("query_id", "doc_num_id", "leg", "score")
    rows = rows.join(legs, "leg").withColumn(
        "s", F.when(F.col("score").isNull() | F.isnan("score"), None).when(F.col("up"), F.col("score")).otherwise(-F.col("score"))
    )
    best = rows.groupBy("query_id", "doc_num_id", "leg").agg(F.max("s").alias("s"))
    per_query = best.groupBy("query_id", "doc_num_id").agg(F.lit(1).alias("one")).groupBy("query_id").agg(F.count("one").alias("docs"))
    usable = best.where("s IS NOT NULL")
    values = usable.groupBy("query_id", "leg", "s").agg(F.count(F.lit(1)).alias("n"))
    held = values.groupBy("query_id", "leg").agg(F.sum("n").alias("used"), F.min("s").alias("worst"))
    placed = (
        count_below(values, ["query_id", "leg"], "s", "n")
        .join(held, ["query_id", "leg"])
        .join(per_query, "query_id")
        .withColumn("standing", F.expr("if(s = worst, 0L, docs - used + below)"))
        .select("query_id", "leg", "s", "standing")
    )
    joined = best.join(placed, ["query_id", "leg", "s"], "left").select("query_id", "doc_num_id", "standing")
    # as many entries as legs, whatever legs a document is absent from
    n_legs = legs.agg(F.count(F.lit(1)).cast("int").alias("n_legs"))
    return (
        joined.groupBy("query_id", "doc_num_id")
        .agg(F.collect_list("standing").alias("got"))
        .join(F.broadcast(n_legs), how="inner")  # a single row
        .select(
            "query_id", "doc_num_id",
            F.expr("array_sort(concat(got, array_repeat(0L, n_legs - size(got))))").alias("standing"),
        )
    )


def leximin_top(results: DataFrame, legs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_num_id, place: the first k documents of each query.

    The worst standings are compared first, then the second worst and so on;
    full ties go to the smaller doc_num_id.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("standing"), "doc_num_id")
    return (
        leximin_vectors(results, legs)
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= k)
        .select("query_id", "doc_num_id", "place")
    )
