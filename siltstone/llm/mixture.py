"""Mixing sources to target shares by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize
from .encoding import text_sizes

FAN_IN = 16


def _name(c: str) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, name (folded source), n_tokens of all documents."""
    return text_sizes(docs.select("doc_id", _name("source").alias("name"), "text"), ["doc_id", "name"])


def mixing_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target: source, name, target_share, max_repeats, size, total, wanted, rate, reachable.

    total is the size of all documents, also those of other or null sources.
    rate is the mean number of copies of a document of the source: what the
    share wants, at most max_repeats. A source without documents reaches only
    a share of zero. Null shares and repeats count as zero.
    """
    # a row per source, written once so that the texts are encoded once
    sizes = materialize(sized.groupBy("name").agg(F.sum("n_tokens").alias("size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    return (
        targets.select("source", _name("source").alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
        .distinct()
        .join(sizes.where("name IS NOT NULL"), "name", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
        .join(F.broadcast(total), how="inner")  # a single row
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("reachable", F.col("wanted") <= F.col("max_repeats") * F.col("size"))
        .withColumn("rate", F.when(F.col("size") > 0, F.least(F.col("wanted") / F.greatest("size", F.lit(1)), F.col("max_repeats").cast("double"))).otherwise(0.0))
    )


def _pivot(ids: np.ndarray, group: np.ndarray, p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Pivotal rounding weighted by size: 0 or 1 for all but at most one document of each group.

    In every round neighbours of a group are paired; token mass moves from one
    to the other, either way with the chance that keeps both expectations,
    until one of them is 0 or 1. The mass of a group, p times size, stays as
    it is. Documents without tokens carry no mass and are drawn on their own.
    """
    p = p.astype(float).copy()
    empty = size <= 0
    p[empty] = _uniform(ids[empty], seed) < p[empty]
    round_ = 0
    while True:
        p[p < 1e-9] = 0.0
        p[p > 1 - 1e-9] = 1.0
        at = np.flatnonzero((p > 0) & (p < 1))
        g = group[at]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        right = np.flatnonzero(rank % 2 == 1)
        if not len(right):
            return p
        a, b = at[right - 1], at[right]
        up = np.minimum((1 - p[a]) * size[a], p[b] * size[b])
        down = np.minimum(p[a] * size[a], (1 - p[b]) * size[b])
        round_ += 1
        move = np.where(_uniform(ids[a], seed + 1000 * round_) < down / (up + down), up, -down)
        p[a] += move / size[a]
        p[b] -= move / size[b]


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the document and the round only."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
        for s in (30, 27, 31):
            x ^= x >> np.uint64(s)
            x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def copies(sized: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, name, n_tokens, copies: how often each document of a target is used.

    Every document gets the whole part of its source's rate; the fractions are
    rounded pivotally, neighbours in size against each other, weighted by
    their tokens: first within every partition, then the one open document of
    each partition and source through a reduction tree of fixed fan-in. Copies
    never exceed max_repeats, and each source's tokens differ from its rate
    times its size by one document at most.
    """
    rates = plan.where("rate > 0").groupBy("name").agg(F.max("rate").alias("rate"))
    at = sized.join(rates, "name").select("doc_id", "name", "n_tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"))
    schema = "part int, doc_id bigint, name string, n_tokens bigint, whole int, p double, up int"

    def decide(pdf: pd.DataFrame, level: int, part: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["name", "n_tokens", "doc_id"], kind="stable").reset_index(drop=True)
        name = pd.factorize(pdf["name"])[0]
        p = _pivot(pdf["doc_id"].to_numpy(), name, pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(dtype=float), seed + level)
        up = np.where(p == 0, 0, np.where(p == 1, 1, -1)).astype(np.int32)
        return pdf.assign(part=part, p=p, up=up)[["part", "doc_id", "name", "n_tokens", "whole", "p", "up"]]

    def at_level(n: int):
        def combine(key, pdf):
            return decide(pdf, n, int(key[1]))

        return combine

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: pd.DataFrame | None = None
        for n, b in enumerate(batches):
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            done = decide(b, 1_000_000 * n, part)  # draws of their own for a document held over
            held = done[done.up < 0][["doc_id", "name", "n_tokens", "whole", "p"]]
            yield done[done.up >= 0]
        if held is not None and len(held):
            yield held.assign(part=part, up=-1)[["part", "doc_id", "name", "n_tokens", "whole", "p", "up"]]

    level = materialize(at.mapInPandas(first, schema), "pivot")
    settled = [level.where("up >= 0")]
    open_ = level.where("up < 0")
    width = (level.agg(F.max("part")).first()[0] or 0) + 1
    n = 1
    while width > 1:
        width = -(-width // FAN_IN)

        next_part = F.floor(F.col("part") / FAN_IN).cast("int")
        level = materialize(open_.withColumn("part", next_part).groupBy("name", "part").applyInPandas(at_level(n), schema), "pivot")
        settled.append(level.where("up >= 0"))
        open_ = level.where("up < 0")
        n += 1

    def last(batches):
        for b in batches:
            b["up"] = (_uniform(b["doc_id"].to_numpy(), seed + 99) < b["p"].to_numpy()).astype(np.int32)
            yield b

    out = open_.mapInPandas(last, schema)
    for s in settled:
        out = out.unionByName(s)
    return out.select("doc_id", "name", "n_tokens", (F.col("whole") + F.col("up")).alias("copies"))


def _reached(sized: DataFrame, targets: DataFrame) -> DataFrame:
    sized = materialize(sized, "sized")
    plan = materialize(mixing_plan(sized, targets), "plan")
    used = copies(sized, plan).groupBy("name").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    return plan.join(used, "name", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))


def reached_shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, size, used_tokens, actual_share, reachable of every target."""
    reached = materialize(_reached(sized, targets), "reached")  # a row per target
    whole = reached.agg(F.sum("used_tokens").alias("all_used"))
    share = F.when(F.col("all_used") > 0, F.col("used_tokens") / F.col("all_used")).otherwise(0.0)
    return reached.join(F.broadcast(whole), how="inner").select("source", "target_share", "size", "used_tokens", F.round(share, 6).alias("actual_share"), "reachable")


def short_sources(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source of the targets that fall short: those whose mixture holds less than wanted, and not only by rounding."""
    return _reached(sized, targets).where("used_tokens < wanted AND NOT reachable").select("source").distinct()
