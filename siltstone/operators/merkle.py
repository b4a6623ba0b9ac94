"""Snapshot comparison by Merkle digests over hash ranges.

Paths are bucketed into hash ranges (leaves); 64 neighbouring leaves form an
inner node, all inner nodes of a snapshot its root. Digests are compared from
the root down: children are looked at only below nodes that differ, and rows
are read only in leaves that differ. A leaf digest is the multiset sum of its
row hashes in two 32-bit halves, so it is order-free, combines map-side and
cannot overflow; an inner digest hashes its children's digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import materialize

HASH_BITS = 24
FANOUT_BITS = 6
ROWS_PER_LEAF = 8


def usable_snapshots(snapshots: DataFrame) -> DataFrame:
    """Usable snapshots of each collection with their ordinal.

    Usable: at least one `complete` delivery; the last such delivery counts.
    Columns: collection, snapshot_no, delivery_no, ordinal (from 1), n_usable.
    """
    w = W.partitionBy("collection")
    return (
        snapshots.where(F.lower(F.trim("state")) == "complete")
        .where("collection IS NOT NULL AND snapshot_no IS NOT NULL AND delivery_no IS NOT NULL")
        .groupBy("collection", "snapshot_no")
        .agg(F.max("delivery_no").alias("delivery_no"))
        .withColumn("ordinal", F.row_number().over(w.orderBy("snapshot_no")))
        .withColumn("n_usable", F.count(F.lit(1)).over(w))
    )


def _content_key(h: Column) -> Column:
    """Case-free content hash as bytes: hex packed, anything else marked and kept."""
    low = F.lower(h)
    return F.when(
        low.rlike("^([0-9a-f]{2})+$"), F.unhex(low)
    ).otherwise(F.encode(F.concat(F.lit("\u0000"), low), "UTF-8"))


def _halves(h: Column) -> list[Column]:
    return [
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("s1"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("s2"),
    ]


def _differing(nodes: DataFrame, keys: list[str], parents: DataFrame | None, parent_key: list[str]) -> DataFrame:
    """(keys, pair): nodes whose digest differs between snapshots pair-1 and pair.

    Each digest enters pair `ordinal` with its value and pair `ordinal + 1`
    with its negative; equal neighbours cancel to zero, a node missing on one
    side leaves the other side's digest. `parents` restricts to differing
    parents before anything is grouped.
    """
    signed = nodes.select(
        *keys,
        *[c for c in parent_key if c not in keys],
        "n_usable",
        F.explode(
            F.array(
                F.struct(F.col("ordinal").alias("pair"), F.col("s1"), F.col("s2")),
                F.struct((F.col("ordinal") + 1).alias("pair"), (-F.col("s1")).alias("s1"), (-F.col("s2")).alias("s2")),
            )
        ).alias("x"),
    ).select(*keys, *[c for c in parent_key if c not in keys], "n_usable", "x.*")
    signed = signed.where((F.col("pair") >= 2) & (F.col("pair") <= F.col("n_usable")))
    if parents is not None:
        signed = signed.join(parents, [*parent_key, "pair"], "left_semi")
    return (
        signed.groupBy(*keys, "pair")
        .agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
        .where("s1 <> 0 OR s2 <> 0")
        .drop("s1", "s2")
    )


def merkle_diff(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """New, changed and deleted paths of every usable snapshot against the one before.

    Output: collection, snapshot_no (the later one), relative_path,
    change_kind. Rows without collection, path or numbers are no files;
    repeats count once; a usable snapshot without files deletes everything.
    A null hash says the file is there with its last known content, so it
    never reports a change. Empty inputs give an empty result; extra columns
    are ignored.
    """
    usable = usable_snapshots(snapshots.select("collection", "snapshot_no", "delivery_no", "state"))
    sizes = files.groupBy("collection").agg(F.count(F.lit(1)).alias("n_rows"))
    per_leaf = F.greatest(F.col("n_rows") / F.col("n_usable") / ROWS_PER_LEAF, F.lit(1.0))
    bits = F.least(F.ceil(F.log2(per_leaf)).cast("int"), F.lit(HASH_BITS))
    # a row per delivery; written once so that the planner sees its true size
    usable = materialize(
        usable.join(sizes, "collection", "left").withColumn("bits", F.coalesce(bits, F.lit(0))).drop("n_rows"), "usable"
    )
    rows = (
        files.where("relative_path IS NOT NULL")
        .select("collection", "snapshot_no", "delivery_no", "relative_path", _content_key(F.col("content_hash")).alias("content"))
        .join(usable, ["collection", "snapshot_no", "delivery_no"])
        .select(
            "collection", "ordinal", "n_usable", "relative_path", "content",
            F.expr(f"shiftright(pmod(xxhash64(relative_path), {1 << HASH_BITS}), {HASH_BITS} - bits)").cast("int").alias("leaf"),
        )
    )
    node = F.shiftright("leaf", FANOUT_BITS)
    leaves = materialize(
        rows.groupBy("collection", "leaf", "ordinal", "n_usable")
        .agg(*_halves(F.xxhash64("relative_path", "content")), F.sum(F.col("content").isNull().cast("int")).alias("nulls"))
        .withColumn("node", node),
        "leaves",
    )
    nodes = leaves.groupBy("collection", "node", "ordinal", "n_usable").agg(*_halves(F.xxhash64("leaf", "s1", "s2")))
    roots = nodes.groupBy("collection", "ordinal", "n_usable").agg(*_halves(F.xxhash64("node", "s1", "s2")))

    root_diff = _differing(roots, ["collection"], None, [])
    node_diff = _differing(nodes, ["collection", "node"], root_diff, ["collection"])
    leaf_diff = _differing(leaves, ["collection", "leaf"], node_diff, ["collection", "node"])

    # Content behind a null hash is found in earlier snapshots of the same leaf:
    # from pair-1 back to the nearest snapshot in which the leaf has no null.
    unknown = leaves.where("nulls > 0").groupBy("collection", "leaf").agg(F.collect_set("ordinal").alias("unknown"))
    wanted = (
        leaf_diff.groupBy("collection", "leaf")
        .agg(F.collect_set("pair").alias("pairs"))
        .join(unknown, ["collection", "leaf"], "left")
        .select(
            "collection", "leaf", "pairs",
            F.expr(
                """transform(pairs, p -> struct(
                     aggregate(reverse(array_sort(coalesce(unknown, array()))), p - 1,
                               (acc, x) -> if(x = acc, acc - 1, acc)) AS lo, p AS hi))"""
            ).alias("spans"),
        )
    )
    held = (
        rows.join(wanted, ["collection", "leaf"])
        .where(F.expr("exists(spans, s -> ordinal BETWEEN s.lo AND s.hi)"))
        .groupBy("collection", "leaf", "relative_path", "ordinal")
        .agg(
            F.max("content").alias("content"),
            F.max(F.array_contains("pairs", F.col("ordinal"))).alias("as_later"),
            F.max(F.array_contains("pairs", F.col("ordinal") + 1)).alias("as_earlier"),
        )
    )
    path = W.partitionBy("collection", "leaf", "relative_path")
    run = W.partitionBy("collection", "leaf", "relative_path", "stay").orderBy("ordinal")
    held = (
        held.withColumn("before", F.lag("ordinal").over(path.orderBy("ordinal")))
        .withColumn("after", F.lead("ordinal").over(path.orderBy("ordinal")))
        .withColumn("starts", F.coalesce(F.col("before") != F.col("ordinal") - 1, F.lit(True)))
        .withColumn("stay", F.sum(F.col("starts").cast("int")).over(path.orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("known", F.last("content", True).over(run.rowsBetween(W.unboundedPreceding, -1)))
    )
    changes = held.select(
        "collection",
        "relative_path",
        F.explode(
            F.array(
                F.struct(
                    F.col("ordinal").alias("ordinal"),
                    F.expr("CASE WHEN NOT as_later THEN NULL WHEN starts THEN 'new' WHEN content <> known THEN 'changed' END").alias("change_kind"),
                ),
                F.struct(
                    (F.col("ordinal") + 1).alias("ordinal"),
                    F.expr("CASE WHEN as_earlier AND (after IS NULL OR after <> ordinal + 1) THEN 'deleted' END").alias("change_kind"),
                ),
            )
        ).alias("c"),
    ).select("collection", "relative_path", "c.*").where("change_kind IS NOT NULL")
    return changes.join(usable.select("collection", "ordinal", "snapshot_no"), ["collection", "ordinal"]).select(
        "collection", "snapshot_no", "relative_path", "change_kind"
    )
