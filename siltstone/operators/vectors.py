"""Vector operators, k-means and the residual codec."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

POINTS_PER_CENTROID = 256
RESIDUAL_SAMPLE = 65_536
MAX_CENTROIDS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def nearest(vectors: DataFrame, query, k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, score: the k vectors with the largest dot product with one query vector."""
    return vectors.where(F.col(vec).isNotNull()).select(key, dot(F.col(vec), literal(query)).alias("score")).orderBy(F.desc("score"), key).limit(k)


# --- k-means -----------------------------------------------------------------------------------


def first_points(vectors: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """cid, vec: the k points first in the order of their hash, the start of k-means."""
    order = F.struct(F.xxhash64(key), F.col(key))
    first = vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(key), key).limit(k)
    return first.select((F.row_number().over(W.orderBy(order)) - 1).alias("cid"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("vec"))


def _matrix(rows: DataFrame, vec: str) -> np.ndarray:
    """A bounded set of vectors (centroids or a sample) on the driver."""
    return np.array([r[0] for r in rows.select(vec).toLocalIterator()], dtype=np.float64)


def assign(vectors: DataFrame, centroids: np.ndarray, vec: str = "embedding") -> DataFrame:
    """Add cid: the nearest centroid by squared distance, the smaller number of equal ones.

    The centroids (MAX_CENTROIDS at most) are broadcast, points go by in Arrow batches.
    """
    if len(centroids) > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} centroids are broadcast")
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))

    @F.pandas_udf("int")
    def near(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int32")
        x, c = np.stack(v.to_numpy()).astype(np.float64), shared.value
        d = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        return pd.Series(np.argmin(d, axis=1).astype(np.int32))

    return vectors.where(F.col(vec).isNotNull()).withColumn("cid", near(vec))


def centroid_means(assigned: DataFrame, previous: DataFrame, vec: str = "embedding") -> DataFrame:
    """cid, vec: the mean of each cluster; an empty cluster keeps its centroid."""


    def sums(batches):
        """One row per centroid and Arrow batch is shuffled, not one per vector and dimension."""
        total: dict[int, list] = {}
        for b in batches:
            for cid, at in b.groupby("cid").indices.items():
                x = np.stack(b[vec].to_numpy()[at]).astype(np.float64)
                have = total.setdefault(int(cid), [np.zeros(x.shape[1]), 0])
                have[0] += x.sum(axis=0)
                have[1] += len(x)
        yield pd.DataFrame([(c, s, n) for c, (s, n) in total.items()], columns=["cid", "total", "n"])

    part = assigned.where(F.col(vec).isNotNull()).select("cid", vec).mapInPandas(sums, "cid int, total array<double>, n bigint")
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    # a row per centroid and task: bounded by the centroids and the number of tasks
    both = part.groupBy("cid").agg(F.sum("n").alias("n"), F.aggregate(F.collect_list("total"), F.array().cast("array<double>"), add).alias("total"))
    means = both.select("cid", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    return previous.join(means, "cid", "left").select("cid", F.coalesce("mean", "vec").alias("vec"))


def kmeans(vectors: DataFrame, k: int, iterations: int, vec: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """Lloyd's algorithm on at most POINTS_PER_CENTROID * k points, stopped when no point moves.

    The sample is bounded by the parameters, so it is fitted where the driver
    is; empty clusters keep their centroid.
    """
    x = _matrix(vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(key), key).limit(POINTS_PER_CENTROID * k), vec)
    c = x[:k].copy()
    before = None
    for _ in range(iterations if len(c) else 0):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
        if before is not None and (near == before).all():
            break
        before = near
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


# --- residual codec ---------------------------------------------------------------------------


@dataclass
class Codec:
    """Centroids and the buckets of their residuals."""

    nbits: int
    centroids: np.ndarray
    cutoffs: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        if self.nbits not in (1, 2, 4, 8):
            raise ValueError("nbits is 1, 2, 4 or 8")
        if len(self.cutoffs) != (1 << self.nbits) - 1 or len(self.weights) != 1 << self.nbits:
            raise ValueError("there must be 2^nbits weights and one cutoff fewer")
        if not np.isfinite(self.cutoffs).all() or (np.diff(self.cutoffs) < 0).any():
            raise ValueError("cutoffs must be finite and in order")
        if self.centroids.ndim != 2 or not np.isfinite(self.centroids).all():
            raise ValueError("centroids must be finite vectors of one dimension")

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Codes of rows as bytes, the first code in the lowest bits."""
        per = 8 // self.nbits
        pad = -codes.shape[1] % per
        c = np.pad(codes.astype(np.uint8), ((0, 0), (0, pad))).reshape(len(codes), -1, per)
        return (c << (np.arange(per, dtype=np.uint8) * self.nbits)).sum(axis=2).astype(np.uint8)

    def unpack(self, raw: np.ndarray) -> np.ndarray:
        per = 8 // self.nbits
        table = (np.arange(256)[:, None] >> (np.arange(per) * self.nbits)) & ((1 << self.nbits) - 1)
        return table[raw].reshape(len(raw), -1)[:, : self.dim]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.centroids
        cid = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
        return cid.astype(np.int32), self.pack(np.searchsorted(self.cutoffs, x - c[cid], side="right"))

    def decode(self, cid: np.ndarray, raw: np.ndarray) -> np.ndarray:
        return self.centroids[cid] + self.weights[self.unpack(raw)]


def quantizer(residuals: np.ndarray, nbits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cutoffs at the quantiles of the residuals and the mean of each bucket."""
    r = np.sort(np.asarray(residuals, dtype=np.float64).ravel())
    if not len(r) or np.isnan(r).any():
        raise ValueError("residuals must be numbers and not none")
    edge = np.arange((1 << nbits) + 1) * len(r) // (1 << nbits)
    weights = [r[a:b].mean() if b > a else r[min(a, len(r) - 1)] for a, b in zip(edge, edge[1:])]
    return r[edge[1:-1]], np.array(weights)


def fit_codec(vectors: DataFrame, k: int, nbits: int = 2, iterations: int = 20, vec: str = "embedding", key: str = "vec_id") -> Codec:
    """A codec from a bounded sample: k-means, then quantiles of at most RESIDUAL_SAMPLE residual vectors."""
    c = kmeans(vectors, k, iterations, vec, key)
    x = _matrix(vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(key), key).limit(RESIDUAL_SAMPLE), vec)
    near = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
    return Codec(nbits, c, *quantizer(x - c[near], nbits))


def centroid_count(n_tokens: int) -> int:
    """How many centroids a collection of token vectors gets."""
    return max(1, min(MAX_CENTROIDS, n_tokens, math.ceil(math.sqrt(n_tokens))))


def encode(vectors: DataFrame, codec: Codec, vec: str = "embedding") -> DataFrame:
    """Replace the vector by cid and code (packed bytes)."""
    shared = vectors.sparkSession.sparkContext.broadcast(codec)
    keep = [f for f in vectors.schema.fields if f.name != vec]

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            cid, raw = shared.value.encode(np.stack(b[vec].to_numpy()).astype(np.float64))
            yield b.drop(columns=[vec]).assign(cid=cid, code=[r.tobytes() for r in raw])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["cid int", "code binary"])
    return vectors.where(F.col(vec).isNotNull()).mapInPandas(run, schema)


def decode(codes: DataFrame, codec: Codec) -> DataFrame:
    """Add vec: the vector a code stands for."""
    shared = codes.sparkSession.sparkContext.broadcast(codec)

    @F.pandas_udf("array<double>")
    def one(cid: pd.Series, code: pd.Series) -> pd.Series:
        if not len(cid):
            return pd.Series([], dtype=object)
        raw = np.frombuffer(b"".join(code), np.uint8).reshape(len(cid), -1)
        return pd.Series(list(shared.value.decode(cid.to_numpy(), raw)))

    return codes.withColumn("vec", one("cid", "code"))


def inverted_file(codes: DataFrame, doc: str = "doc") -> DataFrame:
    """cid, doc: the documents with a token near each centroid."""
    return codes.select("cid", doc).distinct()
