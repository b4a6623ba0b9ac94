"""Queries of the core and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import catalog_data, catalog_search, catalog_text  # noqa: F401  (they register their queries)
from .operators.merkle import merkle_diff
from .plans.incremental import replay_sync_runs
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .runtime import table

FLAGSHIP = "p1_found"


@query(
    """
WITH usable AS (
  SELECT collection, snapshot_no, max(delivery_no) AS delivery_no FROM snapshots
  WHERE state = 'complete' GROUP BY 1, 2),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY collection ORDER BY snapshot_no) AS o,
         count(*) OVER (PARTITION BY collection) AS n FROM usable),
files AS (
  SELECT f.collection, o, n, relative_path, max(lower(content_hash)) AS h
  FROM snapshot_files f JOIN numbered USING (collection, snapshot_no, delivery_no)
  WHERE relative_path IS NOT NULL GROUP BY 1, 2, 3, 4),
stays AS (
  SELECT *, o - row_number() OVER (PARTITION BY collection, relative_path ORDER BY o) AS stay FROM files),
known AS (
  SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY collection, relative_path, stay ORDER BY o
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept,
         row_number() OVER (PARTITION BY collection, relative_path, stay ORDER BY o) AS first_of_stay,
         row_number() OVER (PARTITION BY collection, relative_path, stay ORDER BY o DESC) AS last_of_stay
  FROM stays),
changes AS (
  SELECT collection, o, relative_path, 'new' AS change_kind FROM known WHERE first_of_stay = 1 AND o > 1
  UNION ALL SELECT collection, o, relative_path, 'changed' FROM known WHERE first_of_stay > 1 AND h <> kept
  UNION ALL SELECT collection, o + 1, relative_path, 'deleted' FROM known WHERE last_of_stay = 1 AND o < n)
SELECT c.collection, snapshot_no, relative_path, change_kind
FROM changes c JOIN numbered u ON u.collection = c.collection AND u.o = c.o
"""
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_diff(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "snapshot_files"))


@query(
    f"""SELECT collection, snapshot_no, count(*) FILTER (change_kind = 'new') AS new_paths, count(*) FILTER (change_kind = 'changed') AS changed_paths,
  count(*) FILTER (change_kind = 'deleted') AS deleted_paths FROM ({ORACLES["p1_found"]}) GROUP BY 1, 2"""
)
def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.count(F.when(F.col("change_kind") == k, 1)).alias(f"{k}_paths") for k in ("new", "changed", "deleted")]
    return p1_found(spark, sf_dir).groupBy("collection", "snapshot_no").agg(*kinds)


@query(
    """
WITH ok AS (
  SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS k FROM sync_runs WHERE state = 'ok'),
seen AS (
  SELECT k, collection, relative_path, arg_max(mtime, (found_at, obs_id)) AS mtime
  FROM ok JOIN discovered_files ON delivered_at <= started_at
  WHERE mtime IS NOT NULL GROUP BY 1, 2, 3),
base AS (SELECT DISTINCT collection, relative_path, mtime FROM document_metadata WHERE mtime IS NOT NULL),
steps AS (
  SELECT s.*, coalesce(lag(s.mtime) OVER (PARTITION BY s.collection, s.relative_path ORDER BY k), b.mtime) AS was
  FROM seen s LEFT JOIN base b USING (collection, relative_path))
SELECT run_id, collection, relative_path, mtime FROM steps JOIN ok USING (k) WHERE was IS DISTINCT FROM mtime
"""
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_sync_runs(
        table(spark, sf_dir, "sync_runs"), table(spark, sf_dir, "discovered_files"), table(spark, sf_dir, "document_metadata")
    )
