"""Nearest vectors of every vector through balanced posting lists.

Centroids come from a two-level k-means on a bounded sample. Every vector is
compared with all centroids; it joins its two nearest lists and every further
one whose centroid is hardly farther (distance ratio), so vectors near a
boundary are in several lists. A short list is compared at once, a longer one
within its task in small cells around centroids of its own, which overlap more
than lists do. Lists grow with the table before their number does. Where
MAX_LISTS lists would leave more than ROUTE_ABOVE members in each, the rows are
routed again through centroids of every list, as often as needed.
Copies of a vector are one
member that carries the smallest of its ids; vectors count as copies if their
directions differ by less than 1e-8 in cosine, less than the step (1e-6) in
which cosines are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize

DIM = 64
K_NEAREST = 5
#: Vectors the centroids are fitted on, at most; every vector is indexed.
MAX_SAMPLE = 131_072
MAX_LISTS = 16_384
#: Lists are as small as this until there are FIRST_LISTS of them; then they grow up to ROUTE_ABOVE, since vectors
#: near each other part the more often the more lists there are.
VECTORS_PER_LIST, FIRST_LISTS = 800, 256
SAMPLE_PER_LIST = 64
#: A list with more members is split by routing its rows, a smaller one within its task.
ROUTE_ABOVE = 65_536
#: Bytes that a task of a shuffle reads, about.
TASK_BYTES = 64 << 20
#: Lists that a vector is in, at most, and on average about.
MAX_REPLICAS, REPLICAS = 6, 3
#: A vector that is nearly its own centroid would be in no other list by the ratio.
LEAST_LISTS = 2
RATIO = 1.035
#: Lists longer than this are compared in cells within their task, of about so many members before they overlap.
SPLIT_ABOVE, VECTORS_PER_CELL, SAMPLE_PER_CELL = 6_144, 256, 16
#: As MAX_REPLICAS and RATIO for cells, which take no shuffle.
CELL_REPLICAS, CELL_RATIO = 12, 1.07
#: Scores of rows and centroids that are held at once.
SCORES_AT_ONCE = 1 << 21
SCALE = (1 << 23) - 1  # vectors travel as 24-bit fixed-point numbers
COARSE = 1 << 8  # copies are told by the upper 16 bits, so rounding doesn't part them
STEPS = 1_000_000  # scores are compared in steps of 1e-6


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, unit vectors) of the usable matrices of a batch."""
    chunk = batch.column("chunk_id")
    tokens = batch.column("num_tokens")
    dim = batch.column("dimension")
    data = batch.column("data")
    if len(chunk) == 0:
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
    size = np.asarray(data.value_lengths().fill_null(-1))
    n = np.asarray(tokens.fill_null(-1), dtype=np.int64)
    good = (np.asarray(dim.fill_null(-1)) == DIM) & (n > 0) & (size == n * DIM) & np.asarray(chunk.is_valid())
    if not good.any():
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
    kept = data.filter(pa.array(good))
    flat = kept.flatten()
    x = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float32).reshape(-1, DIM)
    n = n[good]
    base = np.repeat(np.asarray(chunk.fill_null(0), dtype=np.int64)[good], n)
    pos = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return (base * DIM + pos)[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def _quantize(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(np.float64) * SCALE).astype(np.int32)


def _pack(q: np.ndarray) -> bytes:
    return np.ascontiguousarray(q.astype("<i4").view(np.uint8).reshape(-1, DIM, 4)[:, :, :3]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, DIM, 3)
    q = np.zeros((len(b), DIM, 4), np.uint8)
    q[:, :, 1:] = b
    return q.view("<i4")[:, :, 0] >> 8  # the sign comes along


def _key(q: np.ndarray) -> np.ndarray:
    """64-bit key of quantized vectors: equal for copies, whatever their length."""
    a = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, DIM, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        h = (((q.astype(np.int64) + COARSE // 2) // COARSE) * a).sum(axis=1)
        h ^= (h >> 29) & 0x7FFFFFFFF
        return h * np.int64(-4658895280553007687)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.flatnonzero(count))
        c[count > 0] = np.add.reduceat(x[order], starts, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids: coarse cells first, then cells of like size within them."""
    rng = np.random.default_rng(11)
    if len(x) == 0:
        return np.zeros((0, DIM), np.float32)
    coarse = _kmeans(x, max(1, int(np.sqrt(k))), 6, rng)
    near = np.argmax(x @ coarse.T, axis=1)
    out = []
    for j in range(len(coarse)):
        own = x[near == j]
        if len(own):
            out.append(_kmeans(own, max(1, round(k * len(own) / len(x))), 6, rng))
    return np.concatenate(out).astype(np.float32)


class Centroids:
    """Unit centroids and an exact search for the nearest ones.

    All centroids are compared: in 64 dimensions a search through a graph of
    them finds fewer of the nearest the more there are.
    """

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        # scores are read in groups: what is among the `want` best is in one of the `want` groups with the best maxima
        self.group = max(1, int(np.sqrt(k)))
        pad = -k % self.group
        self.t = np.ascontiguousarray(np.concatenate([centroids, np.zeros((pad, DIM), np.float32)]).T)

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The `want` nearest centroids of each row and their cosines, best first."""
        k, g = len(self.c), self.group
        want = min(want, k)
        out_ids, out_sc = [], []
        step = max(64, SCORES_AT_ONCE // k)
        for at in range(0, len(x), step):
            s = x[at : at + step] @ self.t
            s[:, k:] = -9.0
            rows = np.arange(len(s))[:, None]
            if want * g < k:
                cells = s.reshape(len(s), -1, g)
                best = np.argpartition(-cells.max(axis=2), want - 1, axis=1)[:, :want]
                ids = (best[:, :, None] * g + np.arange(g)).reshape(len(s), -1)
                sc = cells[rows, best].reshape(len(s), -1)
            else:
                ids, sc = np.broadcast_to(np.arange(s.shape[1]), s.shape), s
            top = np.argpartition(-sc, want - 1, axis=1)[:, :want]
            top = np.take_along_axis(top, np.argsort(-sc[rows, top], axis=1, kind="stable"), 1)
            out_ids.append(ids[rows, top])
            out_sc.append(sc[rows, top])
        if not out_ids:
            return np.zeros((0, want), np.int64), np.zeros((0, want), np.float32)
        return np.concatenate(out_ids), np.concatenate(out_sc)


#: The name under which the tests know it.
CentroidGraph = Centroids


def choose_lists(centroids: Centroids, x: np.ndarray, most: int | None = None, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the two nearest lists and those within the distance ratio, `most` at most."""
    ids, sc = centroids.search(x, most or MAX_REPLICAS)
    dist = np.sqrt(np.maximum(2 - 2 * sc, 0))
    keep = dist <= np.maximum(dist[:, :1], 0.05) * (ratio or RATIO)
    keep[:, :LEAST_LISTS] = True
    row, col = np.nonzero(keep)
    return row, ids[row, col]


def _smallest(keys: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and for each the `keep` smallest distinct ids (flat, with offsets)."""
    o = np.lexsort((ids, keys))
    k, i = keys[o], ids[o]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    k, i = k[fresh], i[fresh]
    u, first = np.unique(k, return_index=True)
    rank = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
    i, rank, k = i[rank < keep], rank[rank < keep], k[rank < keep]
    return u, i, np.append(np.flatnonzero(rank == 0), len(i)).astype(np.int32)


def _compare(keys: np.ndarray, q: np.ndarray, ids: np.ndarray, offs: np.ndarray):
    """For each member its best foreign ids: flat ids, steps below 1, and offsets."""
    m = len(keys)
    x = q.astype(np.float32) / SCALE
    exact = q.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", exact, exact))
    take = min(K_NEAREST + 3, m - 1)
    width = np.diff(offs)
    out_ids, out_neg, out_n = [], [], []
    for at in range(0, m if take else 0, 1024):
        s = x[at : at + 1024] @ x.T
        r = np.arange(len(s))
        s[r, at + r] = -9
        cand = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < m - 1 else np.argsort(-s, axis=1)[:, :take]
        dots = np.einsum("bkd,bd->bk", exact[cand], exact[at : at + 1024])
        neg = -np.rint(STEPS * dots / (norm[cand] * norm[at : at + 1024, None])).astype(np.int64)
        if (width == 1).all():
            who = ids[cand]
            o = np.lexsort((who, neg), axis=1)[:, :K_NEAREST]
            out_ids.append(np.take_along_axis(who, o, 1).ravel())
            out_neg.append(np.take_along_axis(neg, o, 1).ravel())
            out_n.append(np.full(len(s), o.shape[1]))
        else:
            w = width[cand].ravel()
            who = ids[np.repeat(offs[:-1][cand].ravel() - (np.cumsum(w) - w), w) + np.arange(w.sum())]
            row = np.repeat(np.repeat(r, take), w)
            ng = np.repeat(neg.ravel(), w)
            o = np.lexsort((who, ng, row))
            who, ng, row = who[o], ng[o], row[o]
            n = np.bincount(row, minlength=len(s))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = rank < K_NEAREST
            out_ids.append(who[keep])
            out_neg.append(ng[keep])
            out_n.append(np.minimum(n, K_NEAREST))
    if not out_ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(m, np.int64)
    return np.concatenate(out_ids), np.concatenate(out_neg), np.concatenate(out_n)


def _list_members(keys, q, ids, offs):
    """Compare a list; an oversized one in cells around its own centroids.

    Cells overlap as lists do, but cost no shuffle, so they are small and a
    member is in more of them. What its cells find is one row again.
    """
    if len(keys) > SPLIT_ABOVE:
        found = _in_cells(q, ids, offs)
        if found is not None:
            yield (keys, *found)
            return
    yield (keys, *_compare(keys, q, ids, offs))


def _in_cells(q, ids, offs):
    """As _compare, by cells; None if a list cannot be split."""
    m = len(q)
    rng = np.random.default_rng(13)
    cells = max(2, m // VECTORS_PER_CELL)
    fit = q[np.sort(rng.choice(m, min(m, MAX_SAMPLE, cells * SAMPLE_PER_CELL), replace=False))].astype(np.float32) / SCALE
    centroids = Centroids(fit_centroids(fit, cells))
    chosen = []
    for at in range(0, m, MEMBERS_PER_BIN):
        row, cell = choose_lists(centroids, q[at : at + MEMBERS_PER_BIN].astype(np.float32) / SCALE, CELL_REPLICAS, CELL_RATIO)
        chosen.append(np.stack([row + at, cell]).astype(np.int32))
    row, cell = np.concatenate(chosen, axis=1)
    row = row[np.argsort(cell, kind="stable")]
    ends = np.cumsum(np.bincount(cell, minlength=len(centroids.c)))
    if np.diff(ends, prepend=0).max() >= m:  # all but equal vectors
        return None
    who, what, how = [], [], []
    for a, b in zip(np.append(0, ends[:-1]), ends):
        r = row[a:b]
        if len(r) < 2:
            continue
        w = np.diff(offs)[r]
        at = np.repeat(offs[:-1][r] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        own = np.append(0, np.cumsum(w)).astype(np.int32)
        inner = _in_cells(q[r], ids[at], own) if len(r) > SPLIT_ABOVE else None
        flat, neg, n = inner or _compare(r, q[r], ids[at], own)
        who.append(np.repeat(r, n))
        what.append(flat)
        how.append(neg.astype(np.int32))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(m, np.int64)
    who, what, how = np.concatenate(who), np.concatenate(what), np.concatenate(how)
    o = np.lexsort((what, how, who))
    who, what, how = who[o], what[o], how[o]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (how[1:] != how[:-1]) | (what[1:] != what[:-1])
    who, what, how = who[fresh], what[fresh], how[fresh]
    n = np.bincount(who, minlength=m)
    keep = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) < K_NEAREST
    return what[keep], how[keep].astype(np.int64), np.minimum(n, K_NEAREST)


def _list_count(n: int) -> int:
    return int(min(MAX_LISTS, max(1, min(FIRST_LISTS, n // VECTORS_PER_LIST), -(-REPLICAS * n // ROUTE_ABOVE))))


def _rows_of(arr: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    n = np.asarray(a.value_lengths(), dtype=np.int64)
    return np.asarray(a.flatten(), dtype=np.int64), n


LISTED = pa.schema([("bin", pa.int64()), ("list", pa.int64()), ("key", pa.int64()), ("q", pa.binary()), ("ids", pa.list_(pa.int64()))])
FOUND = pa.schema([("key", pa.int64()), ("own", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("negs", pa.list_(pa.int32()))])
#: Members that a task compares in one call, about; a bin holds one list at least.
MEMBERS_PER_BIN = 8_192
_LISTED = "bin bigint, list bigint, key bigint, q binary, ids array<bigint>"


def _parts(df: DataFrame, n_bytes: float, key: str) -> DataFrame:
    """Rows by key in partitions of about TASK_BYTES, where the session's number would leave larger ones."""
    n = int(n_bytes // TASK_BYTES) + 1
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _packed(q: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(0, 3 * DIM * (len(q) + 1), 3 * DIM, dtype=np.int32)), pa.py_buffer(_pack(q))])


def _routed(listed: DataFrame, per_list: int) -> DataFrame:
    """Listed rows on the lists of the next level.

    Each list gets centroids of its own from a sample of its rows; its rows
    meet them in pieces of bounded size, so no task holds a whole list.
    """
    listed = materialize(listed, "level")
    every = max(1, per_list // (SAMPLE_PER_LIST * 1024))

    def fit(tbl: pa.Table) -> pa.Table:
        x = _unpack(b"".join(tbl.column("q").combine_chunks().to_pylist())).astype(np.float32) / SCALE
        c = fit_centroids(x[:MAX_SAMPLE], max(2, _list_count(len(x) * every)))
        return pa.table({"list": tbl.column("list").slice(0, 1), "cents": pa.array([c.tobytes()], pa.binary())})

    fits = listed.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(every)) == 0).select("list", "q").groupBy("list").applyInArrow(fit, "list bigint, cents binary")
    pieces = max(1, per_list // ROUTE_ABOVE)
    rows = listed.withColumn("piece", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(pieces)))
    fits = fits.select("list", "cents", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))).alias("piece"))

    def route(tbl: pa.Table, cents: pa.Table) -> pa.Table:
        if not tbl.num_rows:
            return LISTED.empty_table()
        if not cents.num_rows:  # a list too short for the sample stays one
            return tbl.select(LISTED.names)
        centroids = Centroids(np.frombuffer(cents.column("cents")[0].as_py(), np.float32).reshape(-1, DIM))
        x = _unpack(b"".join(tbl.column("q").combine_chunks().to_pylist())).astype(np.float32) / SCALE
        row, lst = choose_lists(centroids, x)
        out = tbl.take(pa.array(row))
        new = np.asarray(out.column("list").combine_chunks()) * MAX_LISTS + lst
        return pa.table([pa.array(new), pa.array(new), out.column("key"), out.column("q"), out.column("ids")], schema=LISTED)

    return rows.groupBy("list", "piece").cogroup(fits.groupBy("list", "piece")).applyInArrow(route, _LISTED)


def nearest_pairs(matrices: DataFrame) -> DataFrame:
    """vec_a, vec_b: pairs of which one is among the five nearest of the other.

    Matrices of another dimension, with data of another length, and vectors
    with NaN, infinities or only zeros take no part. Repeated matrices count
    once; ties go to the smaller id. Fewer than two vectors give no row.
    """
    spark = matrices.sparkSession
    src = matrices.select("chunk_id", "num_tokens", "dimension", "data").where(f"dimension = {DIM} AND num_tokens > 0 AND size(data) = num_tokens * {DIM}")
    total = src.agg(F.sum(F.col("num_tokens").cast("bigint"))).first()[0] or 0
    lists = _list_count(total)
    per_bin = max(1, min(16, MEMBERS_PER_BIN * lists // max(1, REPLICAS * total)))
    share = min(1.0, min(MAX_SAMPLE, lists * SAMPLE_PER_LIST) / max(total, 1))
    cut = int(share * (1 << 20))
    sample = src.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < cut).select("chunk_id", "num_tokens", "dimension", "data").toArrow()
    xs = [_vectors(b)[1] for b in sample.to_batches()]
    fit = np.concatenate(xs)[:MAX_SAMPLE] if xs else np.zeros((0, DIM), np.float32)
    if len(fit) == 0:
        fit = np.eye(1, DIM, dtype=np.float32)
    shared = spark.sparkContext.broadcast(Centroids(fit_centroids(fit, lists)))

    def assign(batches):
        centroids = shared.value
        for b in batches:
            ids, x = _vectors(b)
            if len(ids) == 0:
                continue
            q = _quantize(x)
            keys = _key(q)
            u, flat, offs = _smallest(keys, ids, K_NEAREST + 1)
            first = np.unique(keys, return_index=True)[1]
            q, x = np.ascontiguousarray(q[first]), x[first]
            for at in range(0, len(u), 2048):
                row, lst = choose_lists(centroids, x[at : at + 2048])
                row = row + at
                w = np.diff(offs)[row]
                pick = np.repeat(offs[:-1][row] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((lst // per_bin).astype(np.int64)),
                        pa.array(lst.astype(np.int64)),
                        pa.array(u[row]),
                        _packed(q[row]),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(w)).astype(np.int32)), pa.array(flat[pick])),
                    ],
                    schema=LISTED,
                )

    def search(tbl: pa.Table) -> pa.Table:
        lst = np.asarray(tbl.column("list").combine_chunks())
        keys = np.asarray(tbl.column("key").combine_chunks())
        q = _unpack(b"".join(tbl.column("q").combine_chunks().to_pylist()))
        flat, n = _rows_of(tbl.column("ids"))
        owner = np.repeat(np.arange(len(keys)), n)
        parts = []
        for one in np.unique(lst):
            at = np.flatnonzero(lst == one)
            mine = lst[owner] == one
            u, ids, offs = _smallest(keys[owner[mine]], flat[mine], K_NEAREST + 1)
            first = at[np.unique(keys[at], return_index=True)[1]]
            for k, who, neg, cnt in _list_members(u, q[first], ids, offs):
                sel = np.searchsorted(u, k)
                w = np.diff(offs)[sel]
                own = ids[np.repeat(offs[:-1][sel] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
                ends = pa.array(np.append(0, np.cumsum(cnt)).astype(np.int32))
                parts.append(
                    pa.RecordBatch.from_arrays(
                        [
                            pa.array(k),
                            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(w)).astype(np.int32)), pa.array(own)),
                            pa.ListArray.from_arrays(ends, pa.array(who)),
                            pa.ListArray.from_arrays(ends, pa.array(neg.astype(np.int32))),
                        ],
                        schema=FOUND,
                    )
                )
        return pa.Table.from_batches(parts, FOUND)

    listed = src.mapInArrow(assign, _LISTED)
    per_list = REPLICAS * total // lists
    while per_list > max(ROUTE_ABOVE, 8 * VECTORS_PER_LIST):
        listed = _routed(listed, per_list)
        per_list = REPLICAS * per_list // max(2, _list_count(per_list))
    found = _parts(listed, 220.0 * REPLICAS * total, "bin").groupBy("bin").applyInArrow(search, "key bigint, own array<bigint>, ids array<bigint>, negs array<int>")
    best = (
        _parts(found, 120.0 * REPLICAS * total, "key").groupBy("key")
        .agg(
            F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(own)))), 1, {K_NEAREST + 1})").alias("own"),
            F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(arrays_zip(negs, ids))))), 1, {K_NEAREST})").alias("near"),
        )
    )
    best = materialize(best, "nearest")
    crowd = f"size(own) > {K_NEAREST}"
    few = best.where(f"NOT ({crowd})").select(F.explode("own").alias("vec"), "own", "near")

    def members(batches):
        for b in batches:
            ids, x = _vectors(b)
            yield pa.RecordBatch.from_arrays([pa.array(_key(_quantize(x))), pa.array(ids)], ["key", "vec"])

    many = best.where(crowd)
    if many.limit(1).count():
        many = src.mapInArrow(members, "key bigint, vec bigint").join(many, "key").select("vec", "own", "near")
        few = few.unionByName(many)
    pairs = few.select(
        "vec",
        F.explode(
            F.expr(
                f"""slice(array_sort(concat(
                      transform(filter(own, o -> o <> vec), o -> named_struct('negs', {-STEPS}, 'ids', o)),
                      near)), 1, {K_NEAREST})"""
            )
        ).alias("n"),
    ).select(F.least("vec", "n.ids").alias("vec_a"), F.greatest("vec", "n.ids").alias("vec_b"))
    return pairs.distinct()


def exact_nearest(matrices: DataFrame, every: int = 100) -> DataFrame:
    """vec, near: the nearest ids, best first, of every vector whose id is divisible by `every`, by comparing it with all.

    The asked vectors meet all others in blocks of about ROUTE_ABOVE. The same
    rows take part as in nearest_pairs.
    """
    src = matrices.select("chunk_id", "num_tokens", "dimension", "data").where(f"dimension = {DIM} AND num_tokens > 0 AND size(data) = num_tokens * {DIM}")
    total = src.agg(F.sum(F.col("num_tokens").cast("bigint"))).first()[0] or 0

    def read(batches):
        for b in batches:
            ids, x = _vectors(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _packed(_quantize(x))], ["vec", "q"])

    rows = src.mapInArrow(read, "vec bigint, q binary")
    blocks = int(total // ROUTE_ABOVE) + 1
    db = rows.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(blocks)))
    asked = rows.where(F.col("vec") % every == 0).distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def compare(a: pa.Table, d: pa.Table) -> pa.Table:
        kind = pa.schema([("vec", pa.int64()), ("negs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
        if not a.num_rows or not d.num_rows:
            return kind.empty_table()
        ask, ids = np.asarray(a.column("vec").combine_chunks()), np.asarray(d.column("vec").combine_chunks())
        ids, first = np.unique(ids, return_index=True)
        load = lambda t: _unpack(b"".join(t.column("q").combine_chunks().to_pylist())).astype(np.float64)
        q, x = load(a), load(d)[first]
        q, x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (q, x))
        take, out_n, out_i = min(K_NEAREST + 4, len(ids)), [], []
        for at in range(0, len(q), 256):
            s = np.rint(STEPS * (q[at : at + 256] @ x.T)).astype(np.int32)
            s[ask[at : at + 256, None] == ids[None, :]] = -2 * STEPS
            edge = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
            for r in range(len(s)):  # all that reach the edge, so ties go to the smaller id
                c = np.flatnonzero(s[r] >= edge[r])
                c = c[np.lexsort((ids[c], -s[r, c]))][:K_NEAREST]
                c = c[s[r, c] > -2 * STEPS]
                out_n.append(-s[r, c])
                out_i.append(ids[c])
        return pa.table([pa.array(ask), pa.array(out_n, kind[1].type), pa.array(out_i, kind[2].type)], schema=kind)

    found = asked.groupBy("block").cogroup(db.groupBy("block")).applyInArrow(compare, "vec bigint, negs array<int>, ids array<bigint>")
    near = F.expr(f"transform(slice(array_sort(flatten(collect_list(arrays_zip(negs, ids)))), 1, {K_NEAREST}), x -> x.ids)")
    return found.groupBy("vec").agg(near.alias("near"))


def recall(matrices: DataFrame, every: int = 100) -> DataFrame:
    """asked, wanted, found, recall: how many of the exact neighbours of every hundredth vector nearest_pairs gives."""
    true = exact_nearest(matrices, every).select("vec", F.explode("near").alias("other"))
    true = true.select("vec", F.least("vec", "other").alias("vec_a"), F.greatest("vec", "other").alias("vec_b"))
    got = nearest_pairs(matrices).withColumn("hit", F.lit(1))
    rows = true.join(got, ["vec_a", "vec_b"], "left")
    return rows.agg(
        F.count_distinct("vec").alias("asked"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"),
        F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1)), 4).alias("recall"),
    )
