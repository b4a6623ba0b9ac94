"""Queries of lookup, maintenance and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.rust import source_items
from .functions.text import glob_pattern
from .operators import lookup, packages, upsert
from .registry import query
from .runtime import scratch, table
from .sources.embeddings import EmbeddingStore


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "document_metadata").select("collection", F.col("relative_path").alias("path"), "mtime")
    return rows.where("collection IS NOT NULL AND path IS NOT NULL")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_ids(metadata(spark, sf_dir).select("collection", "path").distinct())


_KNOWN = "known AS (SELECT DISTINCT collection, relative_path AS path, sha256(collection || chr(0) || relative_path) AS full_hex FROM document_metadata WHERE collection IS NOT NULL AND relative_path IS NOT NULL)"


@query(
    f"""WITH {_KNOWN}, pairs AS (SELECT a.full_hex, max(list_max([0] || list_filter(range(1, 65), lambda i: a.full_hex[1:i] = b.full_hex[1:i]))) AS n
  FROM known a JOIN known b ON a.full_hex[1:2] = b.full_hex[1:2] AND a.full_hex <> b.full_hex GROUP BY 1)
SELECT collection, path, k.full_hex[1:greatest(6, coalesce(n, 0) + 1)] AS short_id FROM known k LEFT JOIN pairs USING (full_hex)"""
)
def q_short_ids(spark, sf_dir):
    return lookup.short_ids(known(spark, sf_dir)).select("collection", "path", "short_id")


@query(f"WITH {_KNOWN}, p AS (SELECT min(full_hex) AS h FROM known) SELECT collection, path FROM known, p WHERE full_hex = h")
def q_short_id_lookup(spark, sf_dir):
    docs = known(spark, sf_dir)
    ref = docs.agg(F.min("full_hex")).first()[0]
    return lookup.resolve(docs, "#" + ref[:16])


@query(f"WITH {_KNOWN}, one AS (SELECT path FROM known GROUP BY path HAVING count(*) = 1 ORDER BY path LIMIT 1) SELECT collection, path FROM known JOIN one USING (path)")
def q_resolve_path(spark, sf_dir):
    docs = known(spark, sf_dir)
    path = docs.groupBy("path").count().where("count = 1").agg(F.min("path")).first()[0]
    return lookup.resolve(docs, path)


@query(f"WITH {_KNOWN} SELECT collection, path FROM known WHERE path LIKE 'notes/%.md'")
def q_glob(spark, sf_dir):
    return lookup.matching(known(spark, sf_dir), "notes/*.md").select("collection", "path")


@query(
    """WITH c AS (SELECT DISTINCT collection FROM snapshots)
SELECT collection, count(path) AS documents FROM c LEFT JOIN (SELECT DISTINCT collection, relative_path AS path FROM document_metadata) USING (collection) GROUP BY 1"""
)
def q_status(spark, sf_dir):
    return lookup.status(table(spark, sf_dir, "snapshots").where("collection IS NOT NULL"), metadata(spark, sf_dir).select("collection", "path").distinct())


@query(
    """WITH f AS (SELECT DISTINCT collection, string_split(relative_path, '/') AS p FROM document_metadata WHERE relative_path IS NOT NULL AND collection IS NOT NULL),
x AS (SELECT collection, p, unnest(range(1, len(p) + 1)) AS i FROM f)
SELECT collection, array_to_string(p[1:i-1], '/') AS parent, p[i] AS name, i < len(p) AS is_dir, count(*) AS n_files FROM x GROUP BY ALL"""
)
def q_document_tree(spark, sf_dir):
    return lookup.document_tree(metadata(spark, sf_dir).select("collection", "path").distinct())


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf hashes of every delivery; a delivery is a tree of its own."""
    tree = F.concat_ws(":", "collection", F.col("snapshot_no").cast("string"), F.col("delivery_no").cast("string"))
    rows = table(spark, sf_dir, "snapshot_files").where("relative_path IS NOT NULL AND leaf_hash IS NOT NULL")
    return rows.groupBy(tree.alias("collection"), F.col("relative_path").alias("path")).agg(F.max(F.lower("leaf_hash")).alias("leaf_hash"))


_DEPTHS = 8
_LEVELS = ", ".join(
    f"""d{d} AS (SELECT collection, array_to_string(string_split(path, '/')[1:{d}], '/') AS path, sha256(string_agg(string_split(path, '/')[-1] || ':' || kind || ':' || h, chr(10)
  ORDER BY (string_split(path, '/')[-1] || ':' || kind || ':' || h))) AS h, 'd' AS kind, {d} AS depth FROM n{d + 1} WHERE depth = {d + 1} GROUP BY 1, 2),
n{d} AS (SELECT collection, path, h, kind, depth FROM n{d + 1} UNION ALL SELECT collection, path, h, kind, depth FROM d{d})"""
    for d in range(_DEPTHS - 1, -1, -1)
)


@query(
    f"""WITH n{_DEPTHS} AS (SELECT concat_ws(':', collection, snapshot_no, delivery_no) AS collection, relative_path AS path, max(lower(leaf_hash)) AS h, 'f' AS kind, len(string_split(relative_path, '/')) AS depth
  FROM snapshot_files WHERE relative_path IS NOT NULL AND leaf_hash IS NOT NULL GROUP BY 1, 2), {_LEVELS}
SELECT collection, path AS dir, h AS dir_hash FROM n0 WHERE kind = 'd'"""
)
def q_directory_hashes(spark, sf_dir):
    return lookup.directory_hashes(leaves(spark, sf_dir))


@query(
    """WITH old AS (SELECT DISTINCT collection, relative_path AS path, mtime FROM document_metadata WHERE mtime IS NOT NULL),
new AS (SELECT collection, relative_path AS path, max(mtime) AS mtime FROM discovered_files WHERE mtime IS NOT NULL GROUP BY 1, 2)
SELECT * FROM old ANTI JOIN new USING (collection, path) UNION ALL SELECT * FROM new"""
)
def q_upsert(spark, sf_dir):
    old = metadata(spark, sf_dir).where("mtime IS NOT NULL").distinct()
    new = table(spark, sf_dir, "discovered_files").where("mtime IS NOT NULL").select("collection", F.col("relative_path").alias("path"), "mtime")
    return upsert.upsert(old, new, ["collection", "path"], "mtime")


@query("SELECT DISTINCT collection, relative_path AS path, mtime FROM document_metadata WHERE collection <> 'handbook' AND relative_path IS NOT NULL")
def q_delete_collection(spark, sf_dir):
    gone = spark.createDataFrame([("handbook",)], "collection string")
    return upsert.delete(metadata(spark, sf_dir).distinct(), gone, ["collection"])


@query(
    """SELECT DISTINCT chunk_id AS chunk FROM embedding_matrices WHERE chunk_id NOT IN
  (SELECT best_chunk_doc_id FROM search_results WHERE best_chunk_doc_id IS NOT NULL)"""
)
def q_orphan_chunks(spark, sf_dir):
    held = table(spark, sf_dir, "search_results").where("best_chunk_doc_id IS NOT NULL").select(F.col("best_chunk_doc_id").alias("chunk"))
    return upsert.orphan_chunks(table(spark, sf_dir, "embedding_matrices").select(F.col("chunk_id").alias("chunk")), held)


@query(
    """SELECT DISTINCT best_chunk_doc_id AS chunk FROM search_results WHERE best_chunk_doc_id IS NOT NULL
  AND best_chunk_doc_id NOT IN (SELECT chunk_id FROM embedding_matrices WHERE chunk_id IS NOT NULL)"""
)
def q_cache_misses(spark, sf_dir):
    wanted = table(spark, sf_dir, "search_results").where("best_chunk_doc_id IS NOT NULL").select(F.col("best_chunk_doc_id").alias("chunk"))
    return upsert.cache_misses(wanted, table(spark, sf_dir, "embedding_matrices").select(F.col("chunk_id").alias("chunk")))


def stored(spark: SparkSession, sf_dir: str) -> EmbeddingStore:
    """A store that got the matrices in two generations, the first with other data for every third chunk."""
    store = EmbeddingStore(spark, scratch(spark, "embeddings"))
    rows = table(spark, sf_dir, "embedding_matrices").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    rows = rows.select(F.col("chunk_id").cast("string").alias("chunk"), "num_tokens", "dimension", "data")
    third = F.pmod(F.col("chunk").cast("bigint"), F.lit(3)) == 0
    store.store(rows.withColumn("data", F.when(third, F.transform("data", lambda x: x * 2)).otherwise(F.col("data"))), 1)
    store.store(rows.where(third), 2)
    return store


_WHOLE = "(SELECT DISTINCT chunk_id, num_tokens, dimension, data FROM embedding_matrices WHERE chunk_id IS NOT NULL AND len(data) = num_tokens * dimension)"


@query(f"SELECT dimension, count(*) AS matrices, sum(num_tokens)::BIGINT AS tokens FROM {_WHOLE} GROUP BY 1")
def q_embedding_shapes(spark, sf_dir):
    return stored(spark, sf_dir).shapes().groupBy("dimension").agg(F.count(F.lit(1)).alias("matrices"), F.sum("num_tokens").alias("tokens"))


@query(
    f"""WITH w AS (SELECT DISTINCT best_chunk_doc_id AS pos FROM search_results WHERE best_chunk_doc_id IS NOT NULL)
SELECT pos, pos::VARCHAR AS chunk, num_tokens, round(data[1]::DOUBLE, 5) AS head FROM w LEFT JOIN {_WHOLE} ON chunk_id = pos"""
)
def q_embedding_batch(spark, sf_dir):
    wanted = table(spark, sf_dir, "search_results").where("best_chunk_doc_id IS NOT NULL").select(F.col("best_chunk_doc_id").alias("pos")).distinct()
    got = stored(spark, sf_dir).batch_load(wanted.withColumn("chunk", F.col("pos").cast("string")))
    return got.select("pos", "chunk", "num_tokens", F.round(F.try_element_at("data", F.lit(1)).cast("double"), 5).alias("head"))


@query("SELECT DISTINCT ON (item_id) item_id, item_kind, qualified_path FROM rust_items WHERE item_kind = 'trait' AND (qualified_path LIKE 'tessellate::%')")
def q_items_list(spark, sf_dir):
    return packages.items(table(spark, sf_dir, "rust_items"), "trait", "tessellate").select("item_id", "item_kind", "qualified_path")


@query(
    r"""WITH v AS (SELECT DISTINCT crate_name AS name, crate_version AS num FROM rust_items WHERE regexp_full_match(crate_version, '\d+\.\d+\.\d+'))
SELECT name, num FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY list_transform(string_split(num, '.'), lambda x: x::INT) DESC) = 1"""
)
def q_semver_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "rust_items").select(F.col("crate_name").alias("name"), F.col("crate_version").alias("num"), F.lit(False).alias("yanked")).distinct()
    return packages.latest(rows)


@query(
    r"""WITH v AS (SELECT DISTINCT crate_name AS name, crate_version AS num, list_transform(string_split(crate_version, '.'), lambda x: x::INT) AS k FROM rust_items
  WHERE regexp_full_match(crate_version, '\d+\.\d+\.\d+'))
SELECT name, num FROM v WHERE k[1] = 0 AND k[2] = 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1"""
)
def q_semver_requirement(spark, sf_dir):
    rows = table(spark, sf_dir, "rust_items").select(F.col("crate_name").alias("name"), F.col("crate_version").alias("num"), F.lit(False).alias("yanked")).distinct()
    return packages.satisfying(rows, "^0.3")


@query(
    """WITH t AS (SELECT DISTINCT qualified_path AS trait_path, split_part(qualified_path, '::', -1) AS seg FROM rust_items WHERE item_kind = 'trait'),
i AS (SELECT DISTINCT signature AS impl_signature, regexp_extract(signature, '^impl(?:<[^>]*>)? ([A-Za-z_]+) for ', 1) AS seg FROM rust_items WHERE item_kind = 'impl')
SELECT trait_path, impl_signature FROM t JOIN i USING (seg) WHERE seg <> ''"""
)
def q_implementors(spark, sf_dir):
    rows = table(spark, sf_dir, "rust_items")
    traits = rows.where("item_kind = 'trait'").select(F.col("qualified_path").alias("trait_path")).where("trait_path IS NOT NULL").distinct()
    name = F.regexp_extract("signature", r"^impl(?:<[^>]*>)? ([A-Za-z_]+) for ", 1)
    impls = rows.where("item_kind = 'impl'").select(name.alias("trait_path"), F.col("signature").alias("impl_signature")).where("trait_path <> ''").distinct()
    return packages.implementors(traits, impls)


@query(
    """SELECT DISTINCT item_id, item_kind || ' ' || qualified_path || chr(10) || 'crate: ' || crate_name || '@' || crate_version || chr(10)
  || CASE WHEN coalesce(array_to_string(module_path, '::'), '') <> '' THEN 'module: ' || array_to_string(module_path, '::') || chr(10) ELSE '' END
  || 'source: ' || source_file || ':' || line_start || '-' || line_end || chr(10) || chr(10) || coalesce(signature, '')
  || CASE WHEN coalesce(doc_markdown, '') <> '' THEN chr(10) || chr(10) || doc_markdown ELSE '' END
  || CASE WHEN coalesce(body, '') <> '' AND body IS DISTINCT FROM signature THEN chr(10) || chr(10) || body ELSE '' END AS body
FROM rust_items WHERE item_kind IS NOT NULL AND qualified_path IS NOT NULL AND crate_name IS NOT NULL AND crate_version IS NOT NULL
  AND source_file IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL"""
)
def q_lower_items(spark, sf_dir):
    whole = table(spark, sf_dir, "rust_items").dropna(subset=["item_kind", "qualified_path", "crate_name", "crate_version", "source_file", "line_start", "line_end"])
    return packages.lower_items(whole).select("item_id", "body").distinct()


@query("SELECT DISTINCT crate_name AS name, crate_version AS version, CASE WHEN crate_name LIKE 'ember%' THEN 'excluded' WHEN crate_version = '1.0.0' THEN 'cached' ELSE 'queued' END AS action FROM rust_items")
def q_sync_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "rust_items").select(F.col("crate_name").alias("name"), F.col("crate_version").alias("version")).distinct()
    return packages.sync_plan(rows, rows.where("version = '1.0.0'"), ["ember*"])


@query("SELECT relative_path AS path, collection FROM discovered_files WHERE regexp_full_match(relative_path, '(?s:.*\\.(md|txt))') GROUP BY ALL")
def q_glob_braces(spark, sf_dir):
    rows = table(spark, sf_dir, "discovered_files").select(F.col("relative_path").alias("path"), "collection").distinct()
    return rows.where(F.col("path").rlike(glob_pattern("*.{md,txt}")))


_ITEMS = "(SELECT DISTINCT ON (item_id) * FROM rust_items WHERE item_id IS NOT NULL ORDER BY item_id)"


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rust_items").where("item_id IS NOT NULL").dropDuplicates(["item_id"])


@query(f"SELECT item_id, qualified_path FROM {_ITEMS} WHERE item_kind = 'fn' AND visibility = 'pub'")
def q_items_visible(spark, sf_dir):
    return packages.items(table(spark, sf_dir, "rust_items").where("item_id IS NOT NULL"), "fn", visible=True).select("item_id", "qualified_path")


@query(
    f"""WITH d AS (SELECT qualified_path, max(signature) AS doc FROM rust_items WHERE item_kind = 'fn' AND coalesce(signature, '') <> '' AND qualified_path IS NOT NULL GROUP BY 1)
SELECT item_id, coalesce(doc, doc_markdown) AS doc_markdown FROM {_ITEMS} LEFT JOIN d USING (qualified_path)"""
)
def q_merge_docs(spark, sf_dir):
    """Items documented from another source: here the signatures of the functions of the same path."""
    rows = table(spark, sf_dir, "rust_items").where("item_kind = 'fn' AND coalesce(signature, '') <> '' AND qualified_path IS NOT NULL")
    docs = rows.groupBy("qualified_path").agg(F.max("signature").alias("doc"))
    return packages.merge_docs(once(spark, sf_dir), docs).select("item_id", "doc_markdown")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of packages; of some names the highest release is yanked, and each has a pre-release above all."""
    rows = table(spark, sf_dir, "rust_items").where("crate_name IS NOT NULL AND crate_version IS NOT NULL")
    rows = rows.select(F.col("crate_name").alias("name"), F.col("crate_version").alias("num")).distinct()
    top = rows.where(packages.version_key("num")["stable"] == 1).groupBy("name").agg(F.max_by("num", packages.version_key("num")).alias("top"))
    marked = rows.join(top, "name", "left").select("name", "num", (F.col("num").eqNullSafe(F.col("top")) & (F.length("name") % 3 == 0)).alias("yanked"))
    pre = rows.select("name").distinct().select("name", F.lit("99.0.0-beta.2").alias("num"), F.lit(False).alias("yanked"))
    return marked.unionByName(pre)


_VERSIONS = r"""v AS (SELECT DISTINCT crate_name AS name, crate_version AS num, list_transform(string_split(crate_version, '.'), lambda x: x::INT) AS k FROM rust_items
  WHERE regexp_full_match(crate_version, '\d+\.\d+\.\d+') AND crate_name IS NOT NULL),
m AS (SELECT *, length(name) % 3 = 0 AND k = max(k) OVER (PARTITION BY name) AS yanked FROM v)"""


@query(f"WITH {_VERSIONS} SELECT name, num FROM m WHERE NOT yanked QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1")
def q_semver_yanked(spark, sf_dir):
    return packages.latest(versions(spark, sf_dir))


@query(f"WITH {_VERSIONS} SELECT DISTINCT name, num FROM m WHERE num = '1.0.0' UNION SELECT crate_name, '99.0.0-beta.2' FROM rust_items WHERE crate_name IS NOT NULL AND crate_version IS NOT NULL")
def q_semver_exact(spark, sf_dir):
    rows = versions(spark, sf_dir)
    return packages.exact(rows, "1.0.0").unionByName(packages.exact(rows, "99.0.0-beta.2"))


@query(f"WITH {_VERSIONS} SELECT DISTINCT crate_name AS name, crate_version AS version FROM rust_items WHERE crate_name IS NOT NULL AND crate_version IS NOT NULL AND NOT (crate_name = 'tessellate' AND crate_version LIKE '0.3.%')")
def q_evict(spark, sf_dir):
    cached = versions(spark, sf_dir).where("num <> '99.0.0-beta.2'").select("name", F.col("num").alias("version"))
    return packages.evict(cached, "tessellate", "^0.3").select("name", "version")


@query(
    """WITH r AS (SELECT DISTINCT crate_name AS name, crate_version AS version, floor(epoch(fetched_at))::BIGINT AS resolved_at FROM source_files WHERE fetched_at IS NOT NULL AND crate_name IS NOT NULL),
n AS (SELECT max(resolved_at) AS now FROM r) SELECT name, version, resolved_at FROM r, n WHERE now - resolved_at > 86400"""
)
def q_stale(spark, sf_dir):
    rows = table(spark, sf_dir, "source_files").where("fetched_at IS NOT NULL AND crate_name IS NOT NULL")
    rows = rows.select(F.col("crate_name").alias("name"), F.col("crate_version").alias("version"), F.unix_timestamp("fetched_at").alias("resolved_at")).distinct()
    now = rows.agg(F.max("resolved_at")).first()[0] or 0
    return packages.stale(rows.withColumn("spec", F.lit("latest")), now, 86_400).select("name", "version", "resolved_at")


@query(
    """WITH r AS (SELECT DISTINCT query_id, doc_num_id, rank_no, score FROM search_results WHERE leg = 'bm25' AND score IS NOT NULL AND NOT isnan(score) AND rank_no IS NOT NULL AND query_id IS NOT NULL AND doc_num_id IS NOT NULL)
SELECT '{"query_id":' || query_id || ',"doc_num_id":' || doc_num_id || ',"rank_no":' || rank_no || ',"score":"' || printf('%.6f', score) || '"}' AS json FROM r"""
)
def q_result_json(spark, sf_dir):
    rows = table(spark, sf_dir, "search_results").where("leg = 'bm25' AND NOT isnan(score)").select("query_id", "doc_num_id", "rank_no", "score").dropna()
    return lookup.result_json(rows.distinct())


@query(
    r"""WITH docs AS (SELECT DISTINCT collection, path FROM document_responses WHERE collection IS NOT NULL AND path IS NOT NULL),
links AS (SELECT DISTINCT collection, trim(string_split(string_split(unnest(regexp_extract_all(content, '\[\[([^\[\]\n]+)\]\]', 1)), '|')[1], '#')[1]) AS target
  FROM document_responses WHERE collection IS NOT NULL AND content IS NOT NULL),
l AS (SELECT *, CASE WHEN regexp_matches(target, '\.[A-Za-z0-9]+$') THEN target ELSE target || '.md' END AS p,
  lower(regexp_replace(string_split(target, '/')[-1], '(.)\.[^.]*$', '\1')) AS stem FROM links WHERE target <> ''),
one AS (SELECT collection, lower(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1')) AS stem, min(path) AS only_path FROM docs GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l.collection, l.target, coalesce(d.path, one.only_path) AS path FROM l LEFT JOIN docs d ON d.collection = l.collection AND d.path = l.p LEFT JOIN one ON one.collection = l.collection AND one.stem = l.stem"""
)
def q_link_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "document_responses").where("collection IS NOT NULL")
    found = rows.where("content IS NOT NULL").select("collection", F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))).alias("raw"))
    target = F.trim(F.split_part(F.split_part("raw", F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))
    links = found.select("collection", target.alias("target")).where("target <> ''").distinct()
    return lookup.link_targets(links, rows.where("path IS NOT NULL")).select("collection", "target", "path")


@query(
    """WITH d AS (SELECT DISTINCT collection, relative_path AS path, mtime FROM document_metadata WHERE mtime IS NOT NULL AND collection IS NOT NULL AND relative_path IS NOT NULL),
n AS (SELECT collection, relative_path AS path, max(mtime) AS mtime FROM discovered_files WHERE mtime IS NOT NULL AND collection <> 'handbook' AND relative_path IS NOT NULL GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM d WHERE collection <> 'handbook' AND (collection, path) NOT IN (SELECT (collection, path) FROM n)"""
)
def q_update(spark, sf_dir):
    """One collection goes, files of the others are put in place."""
    old = metadata(spark, sf_dir).where("mtime IS NOT NULL").distinct()
    rows = table(spark, sf_dir, "discovered_files").where("mtime IS NOT NULL AND collection <> 'handbook' AND relative_path IS NOT NULL")
    new = rows.groupBy("collection", F.col("relative_path").alias("path")).agg(F.max("mtime").alias("mtime"))
    return upsert.update(old, new, old.where("collection = 'handbook'").select("collection", "path"), ["collection", "path"])


@query()
def q_parse_items(spark, sf_dir):
    """Items that the Rust files declare."""
    files = table(spark, sf_dir, "source_files").where("endswith(source_file, '.rs')").dropDuplicates(["file_id"])
    return source_items(files).select("file_id", "item_kind", "path", "visibility", "line_start", "line_end")
