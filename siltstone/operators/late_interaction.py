"""Late interaction: MaxSim scores and the candidate cascade over a compressed index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .vectors import Codec, dot, inverted_file


@dataclass(frozen=True)
class SearchParams:
    """top_k results; n_probe lists per query token; centroids below `threshold` pruned; n_docs kept by the shortlist."""

    top_k: int
    n_probe: int
    threshold: float | None
    n_docs: int | None

    @staticmethod
    def for_k(k: int) -> "SearchParams":
        """Settings by the number of results asked for."""
        probe, t, docs = (1, 0.5, 256) if k <= 10 else (2, 0.45, 1024) if k <= 100 else (4, 0.4, 4096)
        return SearchParams(k, probe, t, max(docs, 4 * k))


def maxsim(tokens: DataFrame, query: np.ndarray, doc: str = "doc", vec: str = "vec") -> DataFrame:
    """doc, score: for each query vector the best token of the document, summed.

    Query vectors are literals of the plan, so every token meets all of them
    in one pass: maxima combine map-side, one row per document is shuffled.
    """
    parts = [F.max(dot(F.col(vec), F.array(*[F.lit(float(x)) for x in q]))) for q in np.atleast_2d(query)]
    best = tokens.where(F.col(vec).isNotNull()).groupBy(doc).agg(*[p.alias(f"m{i}") for i, p in enumerate(parts)])
    total = sum((F.col(f"m{i}") for i in range(1, len(parts))), F.col("m0"))
    return best.select(F.col(doc).alias("doc"), total.alias("score"))


def batched_maxsim(tokens: DataFrame, query: np.ndarray, doc: str = "doc", vec: str = "vec") -> DataFrame:
    """The same scores with a matrix product per Arrow batch, for many query vectors."""
    q = np.atleast_2d(np.asarray(query, dtype=np.float64))
    shared = tokens.sparkSession.sparkContext.broadcast(q)
    kind = tokens.schema[doc].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            s = np.stack(b[vec].to_numpy()).astype(np.float64) @ shared.value.T
            best = pd.DataFrame(s).groupby(b[doc].to_numpy()).max()
            yield pd.DataFrame({"doc": best.index, "m": list(best.to_numpy())})

    part = tokens.where(F.col(vec).isNotNull()).select(doc, vec).mapInPandas(run, f"doc {kind}, m array<double>")
    cols = [F.max(F.col("m")[i]) for i in range(len(q))]
    return part.groupBy("doc").agg(sum(cols[1:], cols[0]).alias("score"))


def token_scores(tokens: DataFrame, query: np.ndarray, doc: str = "doc", vec: str = "vec") -> DataFrame:
    """doc, tok, scores: every token's product with every query vector, unreduced."""
    cols = [dot(F.col(vec), F.array(*[F.lit(float(x)) for x in q])) for q in np.atleast_2d(query)]
    return tokens.where(F.col(vec).isNotNull()).select(F.col(doc).alias("doc"), "tok", F.array(*cols).alias("scores"))


def centroid_scores(codec: Codec, query: np.ndarray) -> np.ndarray:
    """Query token by centroid dot products (a few rows by MAX_CENTROIDS)."""
    return np.atleast_2d(query) @ codec.centroids.T


def probed(scores: np.ndarray, n_probe: int, threshold: float | None = None) -> list[int]:
    """Centroids whose lists are read: the best of each query token, unless pruned."""
    out: set[int] = set()
    for row in scores:
        out.update(np.lexsort((np.arange(len(row)), -row))[:n_probe].tolist())
    if threshold is not None:
        out &= set(np.flatnonzero(scores.max(axis=0) >= threshold).tolist())
    return sorted(out)


def approximate_maxsim(codes: DataFrame, scores: np.ndarray, kept: np.ndarray | None = None, doc: str = "doc") -> DataFrame:
    """doc, score with every token taken for its centroid; pruned centroids don't count.

    A document all of whose centroids are pruned scores minus infinity.
    """
    n_q = scores.shape[0]
    table = np.where(np.ones(scores.shape[1], bool) if kept is None else kept, scores, -np.inf).T
    shared = codes.sparkSession.sparkContext.broadcast(table)  # MAX_CENTROIDS rows, a column per query token
    kind = codes.schema[doc].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b):
                best = pd.DataFrame(shared.value[b["cid"].to_numpy()]).groupby(b[doc].to_numpy()).max()
                yield pd.DataFrame({"doc": best.index, "m": list(best.to_numpy())})

    part = codes.where(F.col(doc).isNotNull()).select(doc, "cid").mapInPandas(run, f"doc {kind}, m array<double>")
    cols = [F.max(F.col("m")[i]) for i in range(n_q)]
    return part.groupBy("doc").agg(sum(cols[1:], cols[0]).alias("score"))


def _shortlist(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc").limit(n).select("doc")


def search(codes: DataFrame, codec: Codec, query: np.ndarray, params: SearchParams, decoded: DataFrame | None = None) -> DataFrame:
    """doc, score: the cascade from probed lists over two shortlists to exact scores.

    codes: doc, cid, code of every token. Decoded vectors are scaled to unit
    length before they are compared.
    """
    from .vectors import decode, normalized

    query = np.atleast_2d(query)
    scores = centroid_scores(codec, query)
    lists = probed(scores, min(params.n_probe, scores.shape[1]), params.threshold)
    kept = scores.max(axis=0) >= params.threshold if params.threshold is not None else None
    docs = inverted_file(codes).where(F.col("cid").isin(lists)).select("doc").distinct()
    held = codes.join(docs, "doc", "left_semi")
    if params.n_docs is not None:
        docs = _shortlist(approximate_maxsim(held, scores, kept), params.n_docs)
        held = codes.join(docs, "doc", "left_semi")
        docs = _shortlist(approximate_maxsim(held, scores), max(1, -(-params.n_docs // 4)))
        held = codes.join(docs, "doc", "left_semi")
    vecs = decode(held, codec).select("doc", normalized(F.col("vec")).alias("vec"))
    return batched_maxsim(vecs, query).orderBy(F.desc("score"), "doc").limit(params.top_k)


# --- token pooling --------------------------------------------------------------------------------


def ward_clusters(x: np.ndarray, n: int) -> np.ndarray:
    """Cluster numbers of rows after Ward merging down to n, by clamped cosine distance."""
    m = len(x)
    d = np.clip(1 - x.astype(np.float64) @ x.T.astype(np.float64), 0, 2)
    np.fill_diagonal(d, np.inf)
    size = np.ones(m)
    # every cluster knows its nearest one; a merge asks anew only where that is no longer right
    near = d.argmin(axis=1)
    far = d[np.arange(m), near]
    label = np.arange(m)
    for _ in range(m - n):
        i = int(far.argmin())
        i, j = sorted((i, int(near[i])))
        s = size[i] + size[j] + size
        with np.errstate(invalid="ignore"):
            new = np.sqrt(np.maximum(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * d[i, j] ** 2) / s, 0))
        new[~np.isfinite(d[i])] = np.inf  # clusters that are gone
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        far[j] = np.inf
        again = (near == i) | (near == j)
        again[i] = True
        again[j] = False
        for k in np.flatnonzero(again & np.isfinite(far)):
            near[k] = d[k].argmin()
            far[k] = d[k, near[k]]
        closer = new < far
        near[closer], far[closer] = i, new[closer]
    return np.unique(label, return_inverse=True)[1]


def pool(x: np.ndarray, factor: int = 2, protected: int = 0) -> np.ndarray:
    """Token vectors merged to about 1/factor of their number.

    Factor 1 and single tokens stay; fewer tokens than the factor become their
    mean; else at most ceil(n / factor) + 1 clusters are averaged. protected
    tokens at the front are kept apart, the rest then goes to
    max((n - 1) // factor, 1) clusters.
    """
    n = len(x)
    if factor <= 1 or n <= 1:
        return x
    if protected:
        rest = x[protected:]
        if len(rest) <= 1:
            return x
        own = ward_clusters(rest, min(len(rest), max((n - 1) // factor, 1)))
        return np.vstack([x[:protected], _means(rest, own)])
    if n <= factor:
        return x.mean(axis=0, keepdims=True)
    return _means(x, ward_clusters(x, min(n, -(-n // factor) + 1)))


def _means(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.zeros((own.max() + 1, x.shape[1]))
    np.add.at(out, own, x)
    return out / np.bincount(own)[:, None]


def pool_matrices(matrices: DataFrame, factor: int = 2, protected: int = 0) -> DataFrame:
    """chunk_id, tok, vec: pooled tokens of flat row-major matrices (chunk_id, num_tokens, dimension, data)."""

    def run(batches):
        for b in batches:
            out = []
            for cid, n, d, flat in zip(b["chunk_id"], b["num_tokens"], b["dimension"], b["data"]):
                x = pool(np.asarray(flat, dtype=np.float64).reshape(int(n), int(d)), factor, protected)
                out += [(cid, i, v) for i, v in enumerate(x)]
            yield pd.DataFrame(out, columns=["chunk_id", "tok", "vec"])

    good = matrices.where("num_tokens > 0 AND dimension > 0 AND size(data) = num_tokens * dimension AND NOT exists(data, x -> x IS NULL OR isnan(x))")
    return good.select("chunk_id", "num_tokens", "dimension", "data").mapInPandas(run, "chunk_id bigint, tok int, vec array<double>")
