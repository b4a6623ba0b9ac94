"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import fusion, upsert
from .registry import query
from .runtime import table

ASKED = "team"  # a word of the test texts
_LINES = r"CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\r?\n\z', ''), '\r?\n') END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    r"""
SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: strlen(x) < 40) AS tokens FROM documents
"""
)
def q_tokenize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tokens"))


@query(
    rf"""
SELECT doc_id, array_to_string(list_transform({_LINES}, lambda x, i: i || ': ' || x), chr(10)) AS numbered
FROM documents WHERE text IS NOT NULL
"""
)
def q_line_numbers(spark, sf_dir):
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.number_lines("text").alias("numbered"))


@query(
    r"""
SELECT doc_id, regexp_replace(text, '\A---\r?\n(?:(?s:.*?)\n)??(?:---|\.\.\.)\r*(?:\n|\z)', '') AS body FROM documents
"""
)
def q_front_matter(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.strip_front_matter("text").alias("body"))


@query(
    r"""
SELECT doc_id, coalesce(nullif(rtrim(regexp_extract(text, '(?m)^[ \t]*# [ \t]*(\S[^\r\n]*)', 1)), ''),
  nullif(regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\.[^.]*$', '\1'), ''), 'untitled') AS title
FROM documents
"""
)
def q_title(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.title("text", "path").alias("title"))


@query(
    rf"""
WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: contains(lower(x), '{ASKED}')), true), 0) AS hit FROM l),
s AS (SELECT doc_id, ls, CASE WHEN hit > 0 THEN greatest(hit - 2, 1) ELSE 1 END AS a,
             CASE WHEN hit > 0 THEN least(hit + 2, len(ls)) ELSE least(6, len(ls)) END AS b FROM m WHERE len(ls) > 0),
t AS (SELECT doc_id, a::INT AS start_line, array_to_string(ls[a:b], chr(10)) AS s FROM s)
SELECT doc_id, start_line, CASE WHEN strlen(s) <= 400 THEN s
  ELSE left(s, list_max(list_filter(range(0, 401), lambda n: strlen(left(s, n)) <= 400))) END AS snippet
FROM t
"""
)
def q_snippet(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.snippet("text", ASKED).alias("s")).where("s IS NOT NULL")
    return rows.select("doc_id", "s.start_line", F.col("s.text").alias("snippet"))


@query(
    rf"""
WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, len(ls) AS n, unnest(list_filter(range(1, len(ls) + 1), lambda i: contains(lower(ls[i]), '{ASKED}'))) AS i FROM l),
spans AS (SELECT doc_id, greatest(i - 2, 1) AS a, least(i + 2, n) AS b FROM hits
  UNION ALL SELECT doc_id, 1, least(6, len(ls)) FROM l WHERE len(ls) > 0 AND NOT list_bool_or(list_transform(ls, lambda x: contains(lower(x), '{ASKED}')))),
marked AS (SELECT *, CASE WHEN a - 1 <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM marked)
SELECT doc_id, min(a)::INT AS start_line, max(b)::INT AS end_line FROM islands GROUP BY doc_id, g
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(a)) <= 3
"""
)
def q_excerpts(spark, sf_dir):
    rows = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.explode(T.excerpts("text", ASKED, 3)).alias("e"))
    return rows.select("doc_id", "e.start_line", "e.end_line")


@query(
    rf"""
WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(ls) < 3 THEN '' ELSE array_to_string(ls[3:5], chr(10)) ||
  CASE WHEN len(ls) > 6 THEN chr(10) || chr(10) || '[... ' || (len(ls) - 5) || ' more lines remaining]'
       WHEN len(ls) = 6 THEN chr(10) || chr(10) || '[... 1 more line remaining]' ELSE '' END END AS part
FROM l
"""
)
def q_line_range(spark, sf_dir):
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.line_range("text", 3, 5).alias("part"))


@query(
    r"""
WITH spots AS (SELECT doc_id, text,
  list_max(list_filter(range(1, 12), lambda i: strlen(left(text, i - 1)) <= 10)) AS a,
  CASE WHEN strlen(text) <= 60 THEN length(text) + 1 ELSE list_max(list_filter(range(1, 62), lambda i: strlen(left(text, i - 1)) <= 60)) END AS b
  FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, strlen(text) AS n, substring(text, a, b - a) AS part, strlen(text) - strlen(left(text, b - 1)) AS more FROM spots)
SELECT doc_id, CASE WHEN n <= 10 THEN '' ELSE part || CASE WHEN more > 1 THEN chr(10) || chr(10) || '[... ' || more || ' more bytes remaining]'
  WHEN more = 1 THEN chr(10) || chr(10) || '[... 1 more byte remaining]' ELSE '' END END AS part FROM parts
"""
)
def q_byte_range(spark, sf_dir):
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.byte_range("text", 10, 59).alias("part"))


def chunked(spark: SparkSession, sf_dir: str, size: int = T.CHUNK_CHARS) -> DataFrame:
    """doc, pos, chunk, start_byte, byte_len, text: the manifest of all documents with its texts."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.explode(T.chunks("text", size)).alias("c"))
    return rows.select(
        "doc", F.col("c.idx").alias("pos"), T.chunk_hex("c.text").alias("chunk"), "c.start_byte", F.octet_length("c.text").cast("bigint").alias("byte_len"), "c.text"
    )


@query()
def q_chunks(spark, sf_dir):
    return chunked(spark, sf_dir).select("doc", "pos", "chunk", "start_byte", "byte_len")


_WHOLE = "SELECT doc_id, sha256('chunk' || chr(0) || '' || chr(0) || text)[1:16] AS chunk FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) <> ''"


def whole_chunks(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).where("trim(BOTH concat(' ', char(9), char(10), char(13), '﻿') FROM text) <> ''")
    return rows.select(F.col("doc_id").alias("doc"), T.chunk_hex("text").alias("chunk"))


@query(f"SELECT doc_id AS doc, chunk FROM ({_WHOLE})")
def q_chunk_ids(spark, sf_dir):
    return whole_chunks(spark, sf_dir)


@query(f"SELECT chunk, list_sort(list(DISTINCT doc_id)) AS owners FROM ({_WHOLE}) GROUP BY chunk")
def q_chunk_owners(spark, sf_dir):
    return upsert.chunk_owners(whole_chunks(spark, sf_dir))


@query(f"SELECT chunk, min(doc_id) AS doc FROM ({_WHOLE}) GROUP BY chunk")
def q_dedup(spark, sf_dir):
    return upsert.first_occurrence(whole_chunks(spark, sf_dir), ["chunk"], ["doc"])


@query(
    r"""
SELECT doc_id, sha256(coalesce(collection, '') || chr(0) || path) AS full_hex, sha256(coalesce(collection, '') || chr(0) || path)[1:6] AS short_id
FROM documents WHERE path IS NOT NULL
"""
)
def q_doc_ids(spark, sf_dir):
    full = T.document_hex(F.coalesce("collection", F.lit("")), "path")
    return documents(spark, sf_dir).where("path IS NOT NULL").select("doc_id", full.alias("full_hex"), T.short_id(full).alias("short_id"))


@query(
    r"""
SELECT doc_id, CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') OR trim(path) = '' THEN NULL
  ELSE array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') END AS clean FROM documents WHERE path IS NOT NULL
"""
)
def q_safe_path(spark, sf_dir):
    return documents(spark, sf_dir).where("path IS NOT NULL").select("doc_id", T.safe_path("path").alias("clean"))


@query("SELECT doc_id, collection, path FROM documents WHERE collection IS NOT NULL AND path IS NOT NULL")
def q_uri_round_trip(spark, sf_dir):
    rows = documents(spark, sf_dir).where("collection IS NOT NULL AND path IS NOT NULL")
    return rows.select("doc_id", T.uri_parts(T.document_uri("collection", "path")).alias("u")).select("doc_id", "u.collection", "u.path")


@query(
    r"""
SELECT lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, count(*) AS n FROM documents WHERE path IS NOT NULL
  AND lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('md', 'txt', 'pdf') GROUP BY 1
"""
)
def q_extension_filter(spark, sf_dir):
    rows = documents(spark, sf_dir).where(T.extension("path").isin("md", "txt", "pdf"))
    return rows.groupBy(T.extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""
SELECT doc_num_id, len(regexp_extract_all(content, '\[\[[^\[\]\n]+\]\]')) AS n_links
FROM (SELECT DISTINCT doc_num_id, content FROM document_responses WHERE content IS NOT NULL)
"""
)
def q_wiki_links(spark, sf_dir):
    rows = table(spark, sf_dir, "document_responses").where("content IS NOT NULL").select("doc_num_id", "content").distinct()
    return rows.select("doc_num_id", F.size(T.wiki_links("content")).cast("bigint").alias("n_links"))


@query()
def q_front_matter_map(spark, sf_dir):
    rows = documents(spark, sf_dir).where("startswith(text, '---')")
    return rows.select("doc_id", F.explode(T.front_matter_map("text")).alias("key", "value"))


@query(
    r"""
SELECT doc_num_id, metadata IS NOT NULL AND json_valid(metadata) AS valid,
  CASE WHEN json_valid(metadata) THEN json_type(metadata) = 'OBJECT' ELSE false END AS is_object
FROM (SELECT DISTINCT doc_num_id, metadata FROM document_responses)
"""
)
def q_metadata_json(spark, sf_dir):
    rows = table(spark, sf_dir, "document_responses").select("doc_num_id", "metadata").distinct()
    v = F.try_parse_json("metadata")
    return rows.select("doc_num_id", v.isNotNull().alias("valid"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))


@query(
    f"""
WITH c AS ({_WHOLE})
SELECT doc_id AS doc, chunk, 0::BIGINT AS start_byte, strlen(text) - 1 AS end_byte FROM c JOIN documents USING (doc_id)
"""
)
def q_match_chunk(spark, sf_dir):
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    manifest = whole_chunks(spark, sf_dir).join(docs, "doc").select("doc", "chunk", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("start_byte"), F.col("n_bytes").alias("byte_len"))
    hits = whole_chunks(spark, sf_dir).withColumnRenamed("chunk", "best_chunk")
    return fusion.match_chunk(hits, manifest, docs).withColumnRenamed("best_chunk", "chunk")
