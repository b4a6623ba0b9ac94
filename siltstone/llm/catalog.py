"""Queries over training data and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import table
from .abuse import abuse_scores, abusive, rates
from .documented_functions import documented_functions
from .encoding import encode_texts
from .fusion import leximin_top
from .markup import structure
from .mixture import reached_shares, short_sources, sized_documents
from .near_duplicates import groups, similar_pairs
from .neighbours import nearest_pairs, recall
from .templates import equivalence_classes, page_tokens, slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = documented_functions(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "rust_items"))
    return pairs.select("crate_name", "crate_version", "qualified_path").distinct()


@query()
def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "rust_items"))


_SETS = r"""
raw AS (SELECT DISTINCT doc_num_id AS id, list_transform(regexp_extract_all(content, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM document_responses
  WHERE doc_num_id IS NOT NULL AND content IS NOT NULL),
sets AS (SELECT id, t, len(t) AS n, md5(array_to_string(t, '|')) AS c FROM (
  SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS t FROM raw) WHERE len(t) >= 30),
classes AS (SELECT DISTINCT c, t, n FROM sets),
words AS (SELECT c, n, unnest(t) AS w FROM classes),
edges AS (SELECT a.c AS a, b.c AS b FROM words a JOIN words b ON a.w = b.w AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 10 * count(*) >= 6 * (a.n + b.n - count(*)))
"""


@query(
    f"""WITH {_SETS}, linked AS (SELECT a, b FROM edges UNION ALL SELECT c, c FROM classes)
SELECT DISTINCT x.id AS doc_a, y.id AS doc_b FROM linked JOIN sets x ON x.c = a JOIN sets y ON y.c = b WHERE x.id < y.id"""
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "document_responses"), "doc_num_id", "content")


@query(
    f"""WITH RECURSIVE {_SETS}, reach AS (SELECT c, c AS m FROM classes UNION SELECT e.b, r.m FROM reach r JOIN edges e ON e.a = r.c),
firsts AS (SELECT r.c, min(s.id) AS group_id FROM reach r JOIN sets s ON s.c = r.m GROUP BY 1),
degrees AS (SELECT a AS c, count(*) AS links FROM edges GROUP BY 1)
SELECT DISTINCT id, group_id, coalesce(links, 0) AS links FROM sets JOIN firsts USING (c) LEFT JOIN degrees USING (c)"""
)
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "document_responses"), "doc_num_id", "content")


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_pairs(table(spark, sf_dir, "embedding_matrices"))


@query()
def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(table(spark, sf_dir, "embedding_matrices"))


@query(
    """
WITH legs AS (SELECT leg, bool_or(higher_is_better) AS up FROM score_legs GROUP BY 1),
best AS (
  SELECT query_id, doc_num_id, leg,
         max(CASE WHEN score IS NULL OR isnan(score) THEN NULL WHEN up THEN score ELSE -score END) AS s
  FROM search_results JOIN legs USING (leg)
  WHERE query_id IS NOT NULL AND doc_num_id IS NOT NULL GROUP BY 1, 2, 3),
docs AS (SELECT DISTINCT query_id, doc_num_id FROM best),
cells AS (
  SELECT d.query_id, d.doc_num_id, l.leg,
         coalesce(s, min(s) OVER (PARTITION BY d.query_id, l.leg)) AS s
  FROM docs d CROSS JOIN legs l LEFT JOIN best b
    ON b.query_id = d.query_id AND b.doc_num_id = d.doc_num_id AND b.leg = l.leg),
placed AS (
  SELECT query_id, doc_num_id,
         rank() OVER (PARTITION BY query_id, leg ORDER BY s) - 1 AS standing FROM cells),
vectors AS (SELECT query_id, doc_num_id, list(standing ORDER BY standing) AS v FROM placed GROUP BY 1, 2)
SELECT query_id, doc_num_id FROM vectors
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_num_id) <= 3
"""
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin_top(table(spark, sf_dir, "search_results"), table(spark, sf_dir, "score_legs"), 3).drop("place")


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = structure(table(spark, sf_dir, "document_responses"), "document_responses", "doc_num_id", "content")
    items = structure(table(spark, sf_dir, "rust_items"), "rust_items", "item_id", "doc_markdown")
    return docs.unionByName(items)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_responses").select(F.col("collection").alias("host"), F.col("doc_num_id").alias("page"), F.col("content").alias("html"))


@query()
def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence_classes(page_tokens(pages(spark, sf_dir)))


@query()
def p7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(pages(spark, sf_dir))


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sources(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


@query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


@query()
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


@query()
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))
