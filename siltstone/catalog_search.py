"""Queries of lexical, vector and hybrid search."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import title
from .operators import fusion, late_interaction as L, lexical, vectors as V
from .registry import query
from .runtime import scratch, table
from .sources import index_store

QUERY = "stubborn iterator team replaces folder"
TYPO = "stuborn iteratro team"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "collection", title("text", "path").alias("title"), F.col("text").alias("body"))


_TOKENS = r"""
toks AS (SELECT doc_id AS doc, 'body' AS field, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: strlen(x) < 40)) AS term FROM documents
  UNION ALL SELECT doc_id, 'title', unnest(list_filter(regexp_extract_all(lower(coalesce(nullif(rtrim(regexp_extract(text, '(?m)^[ \t]*# [ \t]*(\S[^\r\n]*)', 1)), ''),
    nullif(regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\.[^.]*$', '\1'), ''), 'untitled')), '[\p{L}\p{N}]+'), lambda x: strlen(x) < 40)) FROM documents),
post AS (SELECT field, term, doc, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT field, doc, sum(tf) AS len FROM post GROUP BY ALL),
terms AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
n AS (SELECT count(*) AS n_docs FROM documents),
flds AS (SELECT field, n_docs, sum(len) / n_docs AS avg_len FROM lens, n GROUP BY field, n_docs)
"""
_SCORE = "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"


def _bm25_sql(terms: list[str], boost: str = "1", where: str = "true") -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return (
        f"scored AS (SELECT doc, sum({boost} * {_SCORE}) AS score FROM (VALUES {values}) q(term) JOIN post USING (term) JOIN terms USING (field, term) "
        f"JOIN lens USING (field, doc) JOIN flds USING (field) WHERE {where} GROUP BY doc)"
    )


@query(f"WITH {_TOKENS} SELECT term, df FROM terms WHERE field = 'body'")
def q_term_stats(spark, sf_dir):
    return lexical.build(corpus(spark, sf_dir), "doc_id", ["body"]).terms.select("term", "df")


@query(f"WITH {_TOKENS} SELECT doc, len FROM lens WHERE field = 'body'")
def q_doc_stats(spark, sf_dir):
    return lexical.build(corpus(spark, sf_dir), "doc_id", ["body"]).lengths.select("doc", "len")


@query(f"WITH {_TOKENS} SELECT field, term, doc, tf FROM post")
def q_postings(spark, sf_dir):
    return lexical.postings(corpus(spark, sf_dir), "doc_id", ["body", "title"])


@query(f"WITH {_TOKENS}, {_bm25_sql(QUERY.split(), where="field = 'body'")} SELECT doc, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc LIMIT 10")
def q_bm25_topk(spark, sf_dir):
    idx = lexical.build(corpus(spark, sf_dir), "doc_id", ["body"])
    return lexical.top(lexical.bm25(idx, QUERY), 10).select("doc", F.round("score", 6).alias("score"))


@query(
    f"WITH {_TOKENS}, {_bm25_sql(QUERY.split(), boost="CASE field WHEN 'title' THEN 2 ELSE 1 END")} "
    "SELECT doc, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc LIMIT 10"
)
def q_bm25_title_boost(spark, sf_dir):
    idx = lexical.build(corpus(spark, sf_dir), "doc_id", ["title", "body"])
    return lexical.top(lexical.bm25(idx, QUERY, {"title": lexical.TITLE_BOOST}), 10).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH {_TOKENS}, {_bm25_sql(QUERY.split(), where="field = 'body'")} SELECT doc, round(score, 6) AS score FROM scored WHERE score >= 4")
def q_bm25_min_score(spark, sf_dir):
    idx = lexical.build(corpus(spark, sf_dir), "doc_id", ["body"])
    return lexical.bm25(idx, QUERY).where("score >= 4").select("doc", F.round("score", 6).alias("score"))


@query(
    f"WITH {_TOKENS}, {_bm25_sql(QUERY.split(), where="field = 'body'")} SELECT doc, round(score, 6) AS score FROM scored JOIN documents ON doc = doc_id "
    "WHERE collection = 'handbook' ORDER BY scored.score DESC, doc LIMIT 10"
)
def q_bm25_collection(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    idx = lexical.build(docs, "doc_id", ["body"])
    own = docs.where("collection = 'handbook'").select(F.col("doc_id").alias("doc"))
    return lexical.top(lexical.bm25(idx, QUERY, only=own), 10).select("doc", F.round("score", 6).alias("score"))


_NEAR = ", ".join(f"('{t}')" for t in TYPO.split())
_NEAR_SQL = f"near AS (SELECT DISTINCT asked, term FROM (VALUES {_NEAR}) q(asked) JOIN terms ON damerau_levenshtein(asked, term) <= 1 WHERE field = 'body')"


@query(f"WITH {_TOKENS}, {_NEAR_SQL} SELECT asked, term FROM near")
def q_fuzzy_terms(spark, sf_dir):
    return lexical.fuzzy_terms(lexical.build(corpus(spark, sf_dir), "doc_id", ["body"]), TYPO.split())


@query(
    f"WITH {_TOKENS}, {_NEAR_SQL}, {_bm25_sql(TYPO.split(), where="field = 'body'")}, "
    "fuzzy AS (SELECT DISTINCT doc, asked FROM post JOIN near USING (term) WHERE field = 'body'), "
    "both_ AS (SELECT doc, score FROM scored UNION ALL SELECT doc, 1 FROM fuzzy) "
    "SELECT doc, round(sum(score), 6) AS score FROM both_ GROUP BY doc ORDER BY sum(both_.score) DESC, doc LIMIT 20"
)
def q_bm25_fuzzy(spark, sf_dir):
    idx = lexical.build(corpus(spark, sf_dir), "doc_id", ["body"])
    return lexical.top(lexical.bm25(idx, TYPO, fuzzy=True), 20).select("doc", F.round("score", 6).alias("score"))


@query()
def q_bm25_stemmed(spark, sf_dir):
    idx = lexical.build(corpus(spark, sf_dir), "doc_id", ["title", "body"], stemming=True)
    return lexical.top(lexical.bm25(idx, QUERY, {"title": lexical.TITLE_BOOST}), 10).select("doc", F.round("score", 6).alias("score"))


@query(
    f"WITH {_TOKENS}, {_bm25_sql(QUERY.split(), boost="CASE field WHEN 'title' THEN 2 ELSE 1 END")} "
    "SELECT doc::VARCHAR AS doc, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc::VARCHAR LIMIT 10"
)
def q_index_roundtrip(spark, sf_dir):
    """A stored index, read back and searched."""
    at = scratch(spark, "index")
    lexical.save(corpus(spark, sf_dir), "doc_id", ["title", "body"], at)
    found = lexical.bm25(lexical.load(spark, at), QUERY, {"title": lexical.TITLE_BOOST})
    return lexical.top(found, 10).select("doc", F.round("score", 6).alias("score"))


_KEPT = "(SELECT * FROM documents WHERE collection IS NULL OR collection <> 'handbook')"


@query(
    f"WITH {_TOKENS.replace('FROM documents', f'FROM {_KEPT}')}, numbers AS (SELECT 'df' AS what, field, term, df::DOUBLE AS n FROM terms UNION ALL SELECT 'mean', field, NULL, avg_len FROM flds) "
    "SELECT what, field, term, round(n, 6) AS n FROM numbers"
)
def q_index_update(spark, sf_dir):
    """An index of half the documents, brought up to date: a collection goes, the other half and new versions come."""
    docs, old, new = corpus(spark, sf_dir), scratch(spark, "index"), scratch(spark, "index")
    first = docs.where("doc_id % 2 = 0 OR collection = 'handbook'")
    lexical.save(first.withColumn("body", F.when(F.col("doc_id") % 6 == 0, "words of an older version").otherwise(F.col("body"))), "doc_id", ["title", "body"], old)
    gone = docs.where("collection = 'handbook'").select(F.col("doc_id").alias("doc"))
    changed = docs.where("(doc_id % 2 = 1 OR doc_id % 6 = 0) AND (collection IS NULL OR collection <> 'handbook')")
    lexical.update(spark, old, new, changed, "doc_id", gone)
    idx = lexical.load(spark, new)
    df = idx.terms.select(F.lit("df").alias("what"), "field", "term", F.col("df").cast("double").alias("n"))
    mean = idx.fields.select(F.lit("mean").alias("what"), "field", F.lit(None).cast("string").alias("term"), F.col("avg_len").alias("n"))
    return df.unionByName(mean).select("what", "field", "term", F.round("n", 6).alias("n"))


# --- vectors ------------------------------------------------------------------------------------

QUERY_VEC = [round(np.cos(i * 0.7) / np.sqrt(32), 6) for i in range(64)]
_Q = "[" + ", ".join(f"{x}" for x in QUERY_VEC) + "]::DOUBLE[]"
_DOT = f"list_inner_product(embedding::DOUBLE[], {_Q})"


def vecs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def q_vec_topk(spark, sf_dir):
    return V.nearest(vecs(spark, sf_dir), QUERY_VEC, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def q_cosine_topk(spark, sf_dir):
    rows = vecs(spark, sf_dir).select("vec_id", V.cosine(F.col("embedding"), V.literal(QUERY_VEC)).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))


_FIRST = "SELECT vec_id, embedding::DOUBLE[] AS c FROM embeddings ORDER BY vec_id LIMIT 8"
_NEAREST = f"""
cents AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cid, c FROM ({_FIRST})),
d AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, cid, c, list_distance(e.embedding::DOUBLE[], c) AS dist FROM embeddings e, cents),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), cid) = 1)
"""


def first_eight(spark, sf_dir) -> np.ndarray:
    rows = vecs(spark, sf_dir).orderBy("vec_id").limit(8).collect()  # eight start points
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


@query(f"WITH {_NEAREST} SELECT vec_id, cid FROM near")
def q_nearest_centroid(spark, sf_dir):
    return V.assign(vecs(spark, sf_dir), first_eight(spark, sf_dir)).select("vec_id", "cid")


@query(
    f"""WITH {_NEAREST}, parts AS (SELECT cid, unnest(range(64)) AS dim, unnest(v) AS x FROM near)
SELECT cid, dim, round(avg(x), 6) AS x FROM parts GROUP BY ALL"""
)
def q_kmeans_step(spark, sf_dir):
    start = first_eight(spark, sf_dir)
    prev = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(start)], "cid int, vec array<double>")
    moved = V.centroid_means(V.assign(vecs(spark, sf_dir), start), prev)
    return moved.select("cid", F.posexplode("vec").alias("dim", "x")).select("cid", "dim", F.round("x", 6).alias("x"))


CUTS = (-0.06, 0.0, 0.06)
WEIGHTS = (-0.1, -0.03, 0.03, 0.1)


@lru_cache(maxsize=8)
def _codec(key) -> V.Codec:
    return V.Codec(2, np.array(key), np.array(CUTS), np.array(WEIGHTS))


def fixed_codec(spark, sf_dir) -> V.Codec:
    return _codec(tuple(map(tuple, first_eight(spark, sf_dir).tolist())))


_CODE = f"""{_NEAREST},
buckets AS (SELECT vec_id, cid, list_transform(range(1, 65), lambda i: CASE WHEN v[i] - c[i] >= 0.06 THEN 3 WHEN v[i] - c[i] >= 0.0 THEN 2 WHEN v[i] - c[i] >= -0.06 THEN 1 ELSE 0 END) AS b, c FROM near)
"""


@query(f"WITH {_CODE} SELECT vec_id, cid, list_transform(range(0, 16), lambda j: b[4*j+1] + 4*b[4*j+2] + 16*b[4*j+3] + 64*b[4*j+4]) AS bytes FROM buckets")
def q_residual_encode(spark, sf_dir):
    rows = V.encode(vecs(spark, sf_dir).select("vec_id", "embedding"), fixed_codec(spark, sf_dir))
    byte = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.conv(F.substr(F.hex("code"), 2 * j + 1, F.lit(2)), 16, 10).cast("bigint"))
    return rows.select("vec_id", "cid", byte.alias("bytes"))


@query(f"WITH {_CODE}, back AS (SELECT vec_id, list_transform(range(1, 65), lambda i: c[i] + [-0.1, -0.03, 0.03, 0.1][b[i] + 1]) AS r FROM buckets) SELECT vec_id, round(list_sum(r), 6) AS total, round(list_distance(r, embedding::DOUBLE[]) ** 2, 6) AS error FROM back JOIN embeddings USING (vec_id)")
def q_residual_decode(spark, sf_dir):
    codec = fixed_codec(spark, sf_dir)
    raw = vecs(spark, sf_dir).select("vec_id", "embedding", F.col("embedding").alias("was"))
    back = V.decode(V.encode(raw, codec), codec)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", F.round(total, 6).alias("total"), F.round(V.squared_l2(F.col("vec"), F.col("was")), 6).alias("error"))


@query(f"WITH {_NEAREST} SELECT DISTINCT cid, label AS doc FROM near JOIN embeddings USING (vec_id)")
def q_inverted_file(spark, sf_dir):
    codes = V.assign(vecs(spark, sf_dir), first_eight(spark, sf_dir)).select("cid", F.col("label").alias("doc"))
    return V.inverted_file(codes)


QUERY_ROWS = [QUERY_VEC, QUERY_VEC[::-1], [round(np.sin(i) / np.sqrt(32), 6) for i in range(64)]]
_ROWS = ", ".join(f"({n}, [{', '.join(map(str, r))}]::DOUBLE[])" for n, r in enumerate(QUERY_ROWS))
_SIMS = f"q AS (SELECT * FROM (VALUES {_ROWS}) q(qi, qv))"


@query(f"WITH {_SIMS}, s AS (SELECT label AS doc, qi, max(list_inner_product(embedding::DOUBLE[], qv)) AS m FROM embeddings, q GROUP BY ALL) SELECT doc, round(sum(m), 6) AS score FROM s GROUP BY doc")
def q_maxsim(spark, sf_dir):
    toks = vecs(spark, sf_dir).select(F.col("label").alias("doc"), F.col("embedding").alias("vec"))
    return L.maxsim(toks, np.array(QUERY_ROWS)).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH {_SIMS}, s AS (SELECT label AS doc, qi, max(list_inner_product(embedding::DOUBLE[], qv)) AS m FROM embeddings, q GROUP BY ALL) SELECT doc, round(sum(m), 6) AS score FROM s GROUP BY doc")
def q_batched_maxsim(spark, sf_dir):
    toks = vecs(spark, sf_dir).select(F.col("label").alias("doc"), F.col("embedding").alias("vec"))
    return L.batched_maxsim(toks, np.array(QUERY_ROWS)).select("doc", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_NEAREST}, {_SIMS}, qc AS (SELECT qi, cid, list_inner_product(c, qv) AS s FROM cents, q),
t AS (SELECT label AS doc, qi, max(s) AS m FROM near JOIN embeddings USING (vec_id) JOIN qc USING (cid) GROUP BY ALL)
SELECT doc, round(sum(m), 6) AS score FROM t GROUP BY doc"""
)
def q_approximate_maxsim(spark, sf_dir):
    codec = fixed_codec(spark, sf_dir)
    codes = V.assign(vecs(spark, sf_dir), codec.centroids).select(F.col("label").alias("doc"), "cid")
    return L.approximate_maxsim(codes, L.centroid_scores(codec, np.array(QUERY_ROWS))).select("doc", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_NEAREST}, {_SIMS}, qc AS (SELECT qi, cid, list_inner_product(c, qv) AS s FROM cents, q),
best AS (SELECT qi, cid FROM qc QUALIFY row_number() OVER (PARTITION BY qi ORDER BY s DESC, cid) <= 2),
mask AS (SELECT cid FROM qc GROUP BY cid HAVING max(s) >= 0.02)
SELECT DISTINCT cid FROM best WHERE cid IN (SELECT cid FROM mask)"""
)
def q_probe(spark, sf_dir):
    scores = L.centroid_scores(fixed_codec(spark, sf_dir), np.array(QUERY_ROWS))
    return spark.createDataFrame([(c,) for c in L.probed(scores, 2, 0.02)], "cid bigint")


@query()
def q_index_search(spark, sf_dir):
    rows = vecs(spark, sf_dir).select(F.col("label").alias("doc"), "vec_id", "embedding")
    codec = V.fit_codec(rows, V.centroid_count(rows.count()), nbits=4)
    codes = V.encode(rows.select("doc", "embedding"), codec)
    found = L.search(codes, codec, np.array(QUERY_ROWS), L.SearchParams(10, 8, None, 256))
    return found.select("doc", F.round("score", 4).alias("score"))


_GOOD = """g AS (SELECT DISTINCT ON (chunk_id) chunk_id, num_tokens AS n, dimension AS d, data FROM embedding_matrices WHERE chunk_id IS NOT NULL AND num_tokens > 0 AND dimension > 0
  AND len(data) = num_tokens * dimension AND NOT list_bool_or(list_transform(data, lambda x: x IS NULL OR isnan(x))))"""


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embedding_matrices").where("chunk_id IS NOT NULL AND size(data) = num_tokens * dimension")
    return rows.dropDuplicates(["chunk_id"])


@query(
    f"""WITH {_GOOD}, cells AS (SELECT chunk_id, d, n, unnest(range(0, d)) AS dim, data FROM g WHERE n <= 64)
SELECT chunk_id, dim, round(list_avg(list_transform(range(0, n), lambda t: data[t * d + dim + 1]::DOUBLE)), 5) AS x FROM cells"""
)
def q_token_pool(spark, sf_dir):
    """With a factor above their length matrices pool to the mean of their tokens."""
    rows = L.pool_matrices(matrices(spark, sf_dir).where("num_tokens <= 64"), 64).where("tok = 0")
    means = rows.where("tok = 0").select("chunk_id", F.posexplode("vec").alias("dim", "x"))
    return means.select("chunk_id", "dim", F.round("x", 5).alias("x"))


@query(f"WITH {_GOOD} SELECT chunk_id, CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 1 ELSE least(n, (n + 1) // 2 + 1) END::BIGINT AS tokens FROM g")
def q_token_pool_counts(spark, sf_dir):
    """Half as many vectors and one more; vectors that are all different."""
    rows = L.pool_matrices(matrices(spark, sf_dir))
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("tokens"))


@query(f"WITH {_GOOD} SELECT chunk_id, round(data[1]::DOUBLE, 5) AS first, (CASE WHEN n <= 2 THEN n ELSE 1 + least(n - 1, greatest((n - 1) // 2, 1)) END)::BIGINT AS tokens FROM g")
def q_token_pool_protected(spark, sf_dir):
    """The first vector stays as it is, the others pool to half their number."""
    rows = L.pool_matrices(matrices(spark, sf_dir), 2, protected=1)
    first = F.round(F.max(F.when(F.col("tok") == 0, F.col("vec")[0])), 5)
    return rows.groupBy("chunk_id").agg(first.alias("first"), F.count(F.lit(1)).alias("tokens"))


@query(f"WITH {_SIMS} SELECT vec_id AS tok, qi, round(list_inner_product(embedding::DOUBLE[], qv), 6) AS s FROM embeddings, q")
def q_token_scores(spark, sf_dir):
    toks = vecs(spark, sf_dir).select(F.col("label").alias("doc"), F.col("vec_id").alias("tok"), F.col("embedding").alias("vec"))
    rows = L.token_scores(toks, np.array(QUERY_ROWS)).select("tok", F.posexplode("scores").alias("qi", "s"))
    return rows.select("tok", "qi", F.round("s", 6).alias("s"))


@query(f"WITH {_CODE} SELECT vec_id, cid, b[1] + 4 * b[2] + 16 * b[3] + 64 * b[4] AS head FROM buckets")
def q_vector_index_roundtrip(spark, sf_dir):
    """Codes and codec saved and loaded again."""
    at = scratch(spark, "vectors")
    rows = vecs(spark, sf_dir).select("vec_id", F.col("label").alias("doc"), "embedding")
    index_store.save(V.encode(rows, fixed_codec(spark, sf_dir)), fixed_codec(spark, sf_dir), at)
    codes, codec = index_store.load(spark, at)
    assert codec.nbits == 2 and np.allclose(codec.centroids, fixed_codec(spark, sf_dir).centroids)
    return codes.select("vec_id", "cid", F.conv(F.substr(F.hex("code"), F.lit(1), F.lit(2)), 16, 10).cast("bigint").alias("head"))


# --- fusion -----------------------------------------------------------------------------------------


@query(
    f"""WITH {_TOKENS}, {_bm25_sql(QUERY.split(), where="field = 'body'")},
lex AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM scored QUALIFY r <= 100),
sem AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY {_DOT} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 100),
u AS (SELECT * FROM lex UNION ALL SELECT * FROM sem)
SELECT doc, round(sum(1.0 / (60 + r)), 6) AS score FROM u GROUP BY doc ORDER BY sum(1.0 / (60 + u.r)) DESC, doc LIMIT 20"""
)
def q_hybrid(spark, sf_dir):
    idx = lexical.build(corpus(spark, sf_dir), "doc_id", ["body"])
    lex = fusion.ranked(lexical.bm25(idx, QUERY))
    sem = fusion.ranked(vecs(spark, sf_dir).select(F.col("vec_id").alias("doc"), V.dot(F.col("embedding"), V.literal(QUERY_VEC)).alias("score")))
    return lexical.top(fusion.reciprocal_rank_fusion(lex, sem), 20).select("doc", F.round("score", 6).alias("score"))


@query(
    """WITH best AS (SELECT query_id, leg, doc_num_id, min(rank_no) AS r FROM search_results WHERE rank_no IS NOT NULL GROUP BY ALL)
SELECT query_id, doc_num_id, round(sum(1.0 / (60 + r)), 6) AS score FROM best GROUP BY ALL"""
)
def q_rrf(spark, sf_dir):
    rows = table(spark, sf_dir, "search_results").where("rank_no IS NOT NULL").groupBy("query_id", "leg", "doc_num_id").agg(F.min("rank_no").alias("rank"))
    lists = rows.select(F.struct("query_id", "doc_num_id").alias("doc"), "rank")
    return fusion.reciprocal_rank_fusion(lists).select("doc.query_id", "doc.doc_num_id", F.round("score", 6).alias("score"))


@query(
    """WITH h AS (SELECT DISTINCT best_chunk_doc_id AS chunk, doc_num_id AS doc, score FROM search_results WHERE leg = 'maxsim' AND best_chunk_doc_id IS NOT NULL AND NOT isnan(score)),
hits AS (SELECT chunk, max(score) AS score FROM h GROUP BY chunk), owners AS (SELECT DISTINCT chunk, doc FROM h)
SELECT doc, score, chunk AS best_chunk FROM hits JOIN owners USING (chunk) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, chunk) = 1"""
)
def q_collapse_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "search_results").where("leg = 'maxsim' AND best_chunk_doc_id IS NOT NULL AND NOT isnan(score)")
    hits = rows.groupBy(F.col("best_chunk_doc_id").alias("chunk")).agg(F.max("score").alias("score"))
    owners = rows.select(F.col("best_chunk_doc_id").alias("chunk"), F.col("doc_num_id").alias("doc")).distinct()
    return fusion.collapse(hits, owners)
