"""Cumulative counts within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import materialize


def count_below(values: DataFrame, group: list[str], value: str, n: str, parts: int | None = None) -> DataFrame:
    """Add `below`: the sum of `n` over the rows of the group with a smaller `value`.

    `values` holds each (group, value) once. Rows are range-partitioned by
    group and value, so a group of any size is spread over many tasks; each
    part is summed by itself and shifted by the parts before it. No group is
    ever held by one task.
    """
    spark = values.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        values.repartitionByRange(parts, *group, value).withColumn("part", F.spark_partition_id()), "ranged"
    )
    inner = W.partitionBy("part", *group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = ranged.groupBy("part", *group).agg(F.sum(n).alias("held")).withColumn("shift", F.coalesce(F.sum("held").over(outer), F.lit(0)))
    return (
        ranged.withColumn("inner_below", F.coalesce(F.sum(n).over(inner), F.lit(0)))
        .join(shift.drop("held"), ["part", *group])
        .withColumn("below", F.col("inner_below") + F.col("shift"))
        .drop("inner_below", "shift", "part")
    )
