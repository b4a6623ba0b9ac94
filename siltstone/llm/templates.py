"""Deducing the template of a host's pages from tokens that always occur together.

Tokens (tags and words) of one host's pages are grouped by their occurrence
vectors, how often they stand on each page; a large group that is on most
pages is an equivalence class. A class is valid if its tokens come in the same
order wherever it occurs, as often as it is repeated. Valid classes nest by
the spans they cover. What stands between the tokens of valid classes are the
slots, the pages' own content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import materialize

LEAST_TOKENS = 3
LEAST_PAGES = 3
LEAST_SHARE = 0.5


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page, pos, token: tags with their attributes, and words, of whole HTML pages."""
    whole = pages.where(F.col("html").rlike(r"(?i)\A[\s﻿]*<(!doctype|html)\b")).where("host IS NOT NULL AND page IS NOT NULL").select("host", "page", "html").distinct()
    found = F.regexp_extract_all("html", F.lit(r"(<[^<>]*>|[^\s<>]+)"), F.lit(1))
    return whole.select("host", "page", F.posexplode(found).alias("pos", "token"))


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """host, class, token, rank, support, parent: the valid classes of every host.

    rank orders the tokens of a class; parent is the class whose span on every
    page is the closest around it, null at the top. Occurrence vectors are
    compared by an order-free hash, so no vector is ever gathered.
    """
    n_pages = tokens.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("pages"))
    per_page = tokens.groupBy("host", "page", "token").agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64("page", "n")
    vectors = per_page.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("v1"), F.sum(F.shiftrightunsigned(h, 32)).alias("v2")
    )
    frequent = vectors.join(n_pages, "host").where((F.col("support") >= LEAST_PAGES) & (F.col("support") >= LEAST_SHARE * F.col("pages")))
    named = frequent.withColumn("class", F.xxhash64("host", "support", "v1", "v2"))
    large = named.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where(f"size >= {LEAST_TOKENS}")
    members = materialize(named.join(large, ["host", "class"]).select("host", "class", "token", "support", "size"), "classes")
    seen = tokens.join(members, ["host", "token"])
    # a page's share of a class is as long as the class's tokens on it, so it is gathered whole
    runs = seen.groupBy("host", "class", "page", "size", "support").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("run"), F.min("pos").alias("a"), F.max("pos").alias("b")
    )
    runs = runs.withColumn("pattern", F.slice("run", F.lit(1), F.col("size").cast("int")))
    runs = runs.withColumn("whole", F.expr("run = flatten(array_repeat(pattern, cast(size(run) / size AS int)))"))
    runs = materialize(runs.select("host", "class", "page", "support", "pattern", "whole", "a", "b"), "runs")
    valid = runs.groupBy("host", "class", "support").agg(
        F.bool_and("whole").alias("whole"), F.min(F.xxhash64("pattern")).alias("low"), F.max(F.xxhash64("pattern")).alias("high"), F.min("pattern").alias("pattern")
    )
    valid = valid.where("whole AND low = high AND size(array_distinct(pattern)) = size(pattern)")
    spans = runs.join(valid.select("host", "class"), ["host", "class"]).select("host", "class", "page", "a", "b")
    # the closest span around a class: on each page, the last one opened on the level above
    opens = spans.select("host", "page", "class", F.col("a").alias("at"), F.lit(1).alias("step"))
    closes = spans.select("host", "page", "class", F.col("b").alias("at"), F.lit(-1).alias("step"))
    run = W.partitionBy("host", "page").orderBy("at", F.desc("step"), "class").rowsBetween(W.unboundedPreceding, 0)
    level = opens.unionByName(closes).withColumn("level", F.sum("step").over(run)).where("step = 1")
    near = level.select("host", "page", "level", "at", F.col("class").alias("opened"), F.lit(None).cast("bigint").alias("asks")).unionByName(
        level.where("level > 1").select("host", "page", (F.col("level") - 1).alias("level"), "at", F.lit(None).cast("bigint").alias("opened"), F.col("class").alias("asks"))
    )
    last = W.partitionBy("host", "page", "level").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    parents = (
        near.withColumn("parent", F.last("opened", True).over(last))
        .where("asks IS NOT NULL")
        .groupBy("host", F.col("asks").alias("class"))
        .agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
        .select("host", "class", F.when(F.col("parent") == F.col("other"), F.col("parent")).alias("parent"))
    )
    return (
        valid.join(parents, ["host", "class"], "left")
        .select("host", "class", "support", "parent", F.posexplode("pattern").alias("rank", "token"))
        .select("host", "class", "token", "rank", "support", "parent")
    )


def slots(pages: DataFrame) -> DataFrame:
    """host, page, slot, content: what stands between template tokens; slots are numbered from 0 by the template tokens before them.

    Pages of hosts without a valid class are one slot. Null hosts, pages and
    texts and anything but whole HTML pages give no rows; repeats count once.
    """
    tokens = materialize(page_tokens(pages), "tokens")
    template = equivalence_classes(tokens).select("host", "token", F.lit(1).alias("fixed")).distinct()
    run = W.partitionBy("host", "page").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    marked = tokens.join(template, ["host", "token"], "left").withColumn("slot", F.sum(F.coalesce("fixed", F.lit(0))).over(run))
    return (
        marked.where("fixed IS NULL AND token NOT RLIKE '^<'")
        .groupBy("host", "page", "slot")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("content"))
    )
