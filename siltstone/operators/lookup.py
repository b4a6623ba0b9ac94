"""Finding documents by id, path, reference or glob, and what a catalogue says about them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import document_hex, glob_pattern
from ..runtime import materialize

LEAST_ID = 6


def with_ids(docs: DataFrame) -> DataFrame:
    """Add full_hex to collection and path."""
    return docs.withColumn("full_hex", document_hex("collection", "path"))


def short_ids(docs: DataFrame) -> DataFrame:
    """Add short_id: as many leading digits, six at least, as tell a document from all others.

    In the order of the ids only neighbours can share the longest prefix, so
    two neighbours are looked at instead of all pairs. Ids are spread evenly,
    so their first LEAST_ID - 1 digits split the work into up to a million
    parts; across such a split fewer than LEAST_ID digits are shared.
    """
    w = W.partitionBy(F.substring("full_hex", 1, LEAST_ID - 1)).orderBy("full_hex")
    ids = docs.select("full_hex").distinct()

    def common(other: str):
        n = F.expr(f"aggregate(sequence(1, 64), 0, (acc, i) -> if(acc = i - 1 AND substr(full_hex, i, 1) = substr({other}, i, 1), i, acc))")
        return F.when(F.col(other).isNull(), 0).otherwise(n)

    ids = ids.withColumn("up", F.lag("full_hex").over(w)).withColumn("down", F.lead("full_hex").over(w))
    ids = ids.withColumn("n", F.least(F.greatest(common("up"), common("down")) + 1, F.lit(64)))
    return docs.join(ids.select("full_hex", F.substring("full_hex", F.lit(1), F.greatest("n", F.lit(LEAST_ID))).alias("short_id")), "full_hex")


def _only(found: DataFrame) -> DataFrame:
    """The row found, or none if there are several."""
    two = found.limit(2)
    return two.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))).where("n = 1").drop("n")


def by_short_id(docs: DataFrame, ref: str) -> DataFrame:
    """The document whose id begins with a reference (with or without `#`), if it is the only one."""
    return _only(docs.where(F.col("full_hex").startswith(ref.removeprefix("#"))).select("collection", "path"))


def by_path(docs: DataFrame, path: str) -> DataFrame:
    return _only(docs.where(F.col("path") == path).select("collection", "path"))


def clean_path(path: str) -> str | None:
    """A reference's path without `.` parts, None if it is empty, absolute or leads upwards."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return None if not path.strip() or path.startswith("/") or ".." in parts or not parts else "/".join(parts)


def resolve(docs: DataFrame, ref: str) -> DataFrame:
    """collection, path of a reference: `#id`, `collection:path`, six hex digits, or a path that is unique.

    `collection:path` isn't looked up.
    """
    spark = docs.sparkSession
    if ref.startswith("#"):
        return by_short_id(docs, ref)
    if ":" in ref:
        coll, _, path = ref.partition(":")
        good = clean_path(path)
        return spark.createDataFrame([(coll, good)] if good else [], "collection string, path string")
    if re.fullmatch(r"[0-9A-Fa-f]{6}", ref):
        found = by_short_id(docs, ref)
        return found.unionByName(by_path(docs, ref)).limit(1) if not found.isEmpty() else by_path(docs, ref)
    return by_path(docs, ref)


def matching(docs: DataFrame, glob: str, collection: str | None = None) -> DataFrame:
    """Documents whose path matches a glob, by collection and path."""
    rows = docs if collection is None else docs.where(F.col("collection") == collection)
    return rows.where(F.col("path").rlike(glob_pattern(glob))).orderBy("collection", "path")


def status(collections: DataFrame, docs: DataFrame) -> DataFrame:
    """collection, documents: the number of documents of each collection, zero included."""
    n = docs.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
    return collections.select("collection").distinct().join(n, "collection", "left").select("collection", F.coalesce("documents", F.lit(0)).alias("documents"))


def document_tree(docs: DataFrame) -> DataFrame:
    """collection, parent, name, is_dir, n_files of every directory and file."""
    parts = F.split("path", "/")
    rows = docs.select("collection", "path", F.posexplode(parts).alias("at", "name"), F.size(parts).alias("n"))
    parent = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("at")), "/")
    return (
        rows.select("collection", parent.alias("parent"), "name", (F.col("at") < F.col("n") - 1).alias("is_dir"))
        .groupBy("collection", "parent", "name", "is_dir")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def directory_hashes(files: DataFrame) -> DataFrame:
    """collection, dir, dir_hash: hashes of directories rolled up from leaf hashes, the root's dir is ''.

    One grouping per level of depth, from the deepest up; each sorts the
    children of a directory only.
    """
    leaves = files.select("collection", "path", F.col("leaf_hash").alias("h"))
    deepest = leaves.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    name = F.element_at(F.split("path", "/"), -1)
    up = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "/")
    nodes = leaves.select("collection", "path", "h", F.lit("f").alias("kind"), F.size(F.split("path", "/")).alias("depth"))
    done = None
    for depth in range(deepest, 0, -1):
        dirs = (
            nodes.where(F.col("depth") == depth)
            .select("collection", up.alias("path"), F.concat_ws(":", name, "kind", "h").alias("child"))
            .groupBy("collection", "path")
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("child")), "\n"), 256).alias("h"))
            .withColumn("kind", F.lit("d"))
            .withColumn("depth", F.lit(depth - 1))
        )
        dirs = materialize(dirs, "level")  # read by its own result and by every level above
        done = dirs if done is None else done.unionByName(dirs)
        nodes = nodes.where(F.col("depth") < depth).unionByName(dirs)
    if done is None:
        return leaves.where("false").select("collection", F.col("path").alias("dir"), F.col("h").alias("dir_hash"))
    return done.select("collection", F.col("path").alias("dir"), F.col("h").alias("dir_hash"))


def link_targets(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (collection, target, ...) with the path they lead to: by path, else by a stem that is unique in the collection.

    `.md` may be left out; a target that fits nothing or several files gets null.
    """
    links = links.withColumn("_path", F.when(F.col("target").rlike(r"\.[A-Za-z0-9]+$"), F.col("target")).otherwise(F.concat("target", F.lit(".md"))))
    own = docs.select("collection", "path").distinct()
    exact = own.select("collection", F.col("path").alias("_path"), F.col("path").alias("_exact"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    by_stem = own.groupBy("collection", F.lower(stem).alias("_stem")).agg(F.min("path").alias("_one"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    name = F.lower(F.regexp_replace(F.element_at(F.split("target", "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return (
        links.withColumn("_stem", name)
        .join(exact, ["collection", "_path"], "left")
        .join(by_stem, ["collection", "_stem"], "left")
        .withColumn("path", F.coalesce("_exact", "_one"))
        .drop("_path", "_stem", "_exact", "_one")
    )


def conversation_summary(turns: DataFrame) -> DataFrame:
    """id, title, updated_at, messages of conversations (id, title, updated_at, messages array), the newest first."""
    return turns.select("id", "title", "updated_at", F.size("messages").alias("n_messages")).orderBy(F.desc("updated_at"), "id")


def result_json(results: DataFrame) -> DataFrame:
    """json: each result as an object, its score with six decimals."""
    cols = [F.format_string("%.6f", "score").alias("score") if c == "score" else F.col(c) for c in results.columns]
    return results.select(F.to_json(F.struct(*cols)).alias("json"))
