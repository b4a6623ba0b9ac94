"""Records that share most of their content: a signature-tree similarity join.

Every distinct content is a set of hashed word triples. The tree's upper level
routes a set to its rare triples: in a global order by rarity, two sets with
the wanted similarity have one of their first triples in common, so subtrees
under different triples need not meet. Below, nodes hold the OR of their
members' bitmaps and the range of their sizes; pairs of nodes are walked down
together and dropped once the greatest overlap that bitmaps and sizes allow is
too small. Pairs that are left are compared exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize

#: Similarity at least NUM / DEN, of sets with at least LEAST members.
NUM, DEN = 6, 10
LEAST = 30
#: Rarity is counted in a sketch and shared triples are marked in a bit set; both widths follow the corpus between
#: these bounds. They only tell apart what is worth sending: any sketch gives the same pairs.
CELLS = (1 << 16, 1 << 24)
BITS = (1 << 20, 1 << 29)
WORDS = 8  # 64-bit words of a bitmap
NODE = 8
#: A triple that more sets share is split into blocks of about this many; blocks get longer if more than MOST_HOT
#: triples were to be split, as the split ones are sent to every task.
BLOCK = 2_048
MOST_HOT = 1 << 20
#: Members of a class that meet in one task; of larger classes blocks meet.
COPIES = 1_024
ENTRIES_PER_BIN = 100_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")


class _Words(dict):
    """Hashes of the words seen so far."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_seen_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def triples(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of three successive words of a text."""
    if len(_seen_words) > 500_000:
        _seen_words.clear()
    words = _PLAIN_WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]
    h = list(map(_seen_words.__getitem__, words))
    if len(h) < 3:
        return np.zeros(0, np.uint64)
    a = np.array(h, np.uint64)
    with np.errstate(over="ignore"):
        return np.unique(_mix(_mix(_mix(a[:-2]) + a[1:-1]) + a[2:]))


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _sets(batches):
    for b in batches:
        ids, sigs, sizes, toks = [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = triples(text)
            if len(t) >= LEAST:
                raw = t.tobytes()
                ids.append(i)
                sigs.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                sizes.append(len(t))
                toks.append(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), _binary(toks)], ["id", "sig", "n", "toks"]
        )


def _width(n: int, bounds: tuple[int, int]) -> int:
    """The power of two from n on, within bounds."""
    return min(max(1 << max(0, int(n - 1).bit_length()), bounds[0]), bounds[1])


def _cells(toks: np.ndarray, cells: int) -> np.ndarray:
    return (toks >> np.uint64(36)).astype(np.int64) & (cells - 1)


def _prefix(toks: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest triples of a set, enough for any partner, and their counts' bounds."""
    f = often[_cells(toks, len(often))]
    o = np.argsort(f, kind="stable")  # triples are in order, so ties stay so
    n = len(toks)
    o = o[: n - (NUM * n + DEN - 1) // DEN + 1]
    return toks[o], f[o]


def _bitmap(toks: np.ndarray) -> np.ndarray:
    pos = (toks >> np.uint64(20)).astype(np.int64) & (64 * WORDS - 1)
    out = np.zeros(64 * WORDS, np.uint8)
    out[pos] = 1
    return np.packbits(out).view(np.uint64)


def _needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Common members that sets of these sizes must have."""
    return -((-NUM * (na.astype(np.int64) + nb)) // (NUM + DEN))


class SignatureTree:
    """Members in order of (group, size); nodes of NODE neighbours, level by level."""

    def __init__(self, group: np.ndarray, n: np.ndarray, maps: np.ndarray):
        excess = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, excess)]
        self.child: list[np.ndarray] = []
        self.group = [group]
        while True:
            g = self.group[-1]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(first, len(g)))
            if len(self.child) and size.max() <= NODE:
                break
            rank = np.arange(len(g)) - np.repeat(first, size)
            start = np.flatnonzero(rank % NODE == 0)
            m, lo, hi, ex = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(m, start), np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start), np.maximum.reduceat(ex, start)))
            self.child.append(np.append(start, len(g)))
            self.group.append(g[start])
            if size.max() <= NODE:
                break

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        maps, lo, hi, ex = self.levels[level]
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 17):
            i, j = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            most = np.bitwise_count(maps[i] & maps[j]).sum(axis=1).astype(np.int64) + np.minimum(ex[i], ex[j])
            most = np.minimum(most, np.minimum(hi[i], hi[j]))
            out[at : at + (1 << 17)] = (most >= _needed(lo[i], lo[j])) & (DEN * hi[i] >= NUM * lo[j]) & (DEN * hi[j] >= NUM * lo[i])
        return out

    def pairs(self, cross: np.ndarray | None = None):
        """Member pairs (i < j) of one group that may be similar.

        cross: the side of each member where two blocks of a group meet; such
        groups give only pairs across (side 0 means one block against itself).
        Yields pieces of bounded length.
        """
        top = len(self.levels) - 1
        g = self.group[top]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(g)))
        a, b = _own_pairs(first, size)
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 1 << 16:
                for at in range(0, len(a), 1 << 16):
                    stack.append((level, a[at : at + (1 << 16)], b[at : at + (1 << 16)]))
                continue
            ok = self._possible(level, a, b)
            a, b = a[ok], b[ok]
            if level == 0:
                ok = a != b
                if cross is not None:
                    ok &= (cross[a] != cross[b]) | (cross[a] == 0)
                yield a[ok], b[ok]
                continue
            if len(a):
                c = self.child[level - 1]
                stack.append((level - 1, *_child_pairs(c[a], c[a + 1], c[b], c[b + 1], a == b)))


def _own_pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i <= j within each run of nodes (at most NODE long)."""
    u, v = np.triu_indices(int(size.max()) if len(size) else 0)
    keep = v[None, :] < size[:, None]
    return (first[:, None] + u)[keep], (first[:, None] + v)[keep]


def _child_pairs(a0, a1, b0, b1, same):
    u, v = (x.ravel() for x in np.meshgrid(np.arange(NODE), np.arange(NODE), indexing="ij"))
    i, j = a0[:, None] + u, b0[:, None] + v
    keep = (i < a1[:, None]) & (j < b1[:, None]) & (~same[:, None] | (i <= j))
    return i[keep], j[keep]


ENTRY = pa.schema(
    [("bin", pa.int32()), ("tok", pa.int64()), ("part", pa.int64()), ("side", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("map", pa.binary())]
)


def _candidates(tbl: pa.Table) -> pa.Table:
    col = lambda c: np.asarray(tbl.column(c).combine_chunks())
    tok, part, n, pos, sig, side = (col(c) for c in ("tok", "part", "n", "pos", "sig", "side"))
    raw = tbl.column("map").combine_chunks()
    maps = np.frombuffer(raw.buffers()[2], np.uint64, len(raw) * WORDS, offset=raw.offset * WORDS * 8).reshape(-1, WORDS)
    o = np.lexsort((sig, n, part, tok))
    tok, part, n, pos, sig, side, maps = tok[o], part[o], n[o].astype(np.int64), pos[o].astype(np.int64), sig[o], side[o], maps[o]
    new = np.append(True, (tok[1:] != tok[:-1]) | (part[1:] != part[:-1]))
    group = np.cumsum(new)
    many = np.bincount(group)[group] > 1
    group, n, pos, sig, side, maps = group[many], n[many], pos[many], sig[many], side[many], maps[many]
    xs, ys = [], []
    if len(group):
        for a, b in SignatureTree(group, n, maps).pairs(side):
            # what can still be common from the shared triple onwards
            ok = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= _needed(n[a], n[b])
            a, b = a[ok], b[ok]
            x, y = np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])
            xs.append(x[x != y])
            ys.append(y[x != y])
    if xs:
        both = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], axis=1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})
    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _exact(batches):
    for t in batches:
        keep = []
        for x, y in zip(t.column("ta").to_pylist(), t.column("tb").to_pylist()):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(v, u)
            common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            keep.append((NUM + DEN) * common >= NUM * (len(u) + len(v)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([t.column("a").filter(mask), t.column("b").filter(mask)], ["a", "b"])


def _bit_set(keys: DataFrame, n: int) -> np.ndarray:
    """A bit set of a width that suits n keys, within BITS."""
    k, bits = keys.columns[0], _width(16 * n, BITS)
    words = (
        keys.select(F.expr(f"`{k}` & {bits - 1}L").alias("bit"))
        .groupBy(F.expr("shiftright(bit, 6)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("mask"))
    return out


def _has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (len(bits) * 64 - 1)
    return ((bits[at >> 6] >> (at & 63)) & 1) == 1


def _with_bit(shared, key: str, wanted: bool):
    """Rows whose key has its bit set (or not); some have it by chance."""

    def run(batches):
        for b in batches:
            mask = _has_bit(shared.value, np.asarray(b.column(key), dtype=np.int64)) == wanted
            yield b.filter(pa.array(mask))

    return run


def similar_contents(records: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, links): members maps `id` to the class `sig` of equal triple sets,
    links pairs similar classes (a < b).

    Records without key or text, or with fewer than LEAST triples, take no
    part. Repeats count once.
    """
    spark = records.sparkSession
    src = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text)
    sets = materialize(src.mapInArrow(_sets, "id bigint, sig bigint, n int, toks binary"), "sets")
    members = sets.select("id", "sig").distinct()
    total = sets.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_sets, n_triples = int(total[0]), int(total[1] or 0)
    # most sets occur once and stay where they are; only those that may have copies are brought together
    copied = materialize(members.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copied")
    may = spark.sparkContext.broadcast(_bit_set(copied.select("sig"), copied.count()))
    schema = "sig bigint, n int, toks binary"
    once = sets.select("sig", "n", "toks").mapInArrow(_with_bit(may, "sig", False), schema)
    again = sets.select("sig", "n", "toks").mapInArrow(_with_bit(may, "sig", True), schema).groupBy("sig").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
    classes = once.unionByName(materialize(again, "copies"))
    cells = _width(n_triples // 8, CELLS)

    def tally(batches):
        out = np.zeros(cells, np.int64)
        for b in batches:
            raw = [r for r in b.column("toks").to_pylist()]
            out += np.bincount(_cells(np.frombuffer(b"".join(raw), np.uint64), cells), minlength=cells)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["cell", "n"])

    counts = classes.select("toks").mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(cells, np.int32)
    often[np.asarray(counts.column("cell"))] = np.minimum(np.asarray(counts.column("n")), np.iinfo(np.int32).max)
    often_b = spark.sparkContext.broadcast(often)  # at most CELLS[1] numbers, whatever the corpus

    def heads(batches):
        for b in batches:
            toks = [_prefix(np.frombuffer(raw, np.uint64), often_b.value) for raw in b.column("toks").to_pylist()]
            t = np.concatenate([x[f > 1] for x, f in toks]) if toks else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64))], ["tok"])

    shared = classes.select("toks").mapInArrow(heads, "tok bigint").groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared, "shared")  # triples with the number of sets that truly share them
    n_shared = shared.count()
    filled_b = spark.sparkContext.broadcast(_bit_set(shared.select("tok"), n_shared))
    block = BLOCK
    while (n_hot := shared.where(F.col("n") > block).count()) > MOST_HOT:
        block *= 4
    hot = shared.where(F.col("n") > block).toArrow() if n_hot else shared.limit(0).toArrow()  # at most MOST_HOT rows
    order = np.argsort(np.asarray(hot.column("tok")))
    hot_b = spark.sparkContext.broadcast((np.asarray(hot.column("tok"))[order], np.asarray(hot.column("n"))[order]))
    sent = F.when(F.col("n") > block, F.col("n") * 3 * F.ceil(F.col("n") / block)).otherwise(F.col("n"))
    bins = max(1, int(shared.agg(F.sum(sent)).first()[0] or 0) // ENTRIES_PER_BIN)

    def entries(batches):
        often, filled, (hot_toks, hot_n) = often_b.value, filled_b.value, hot_b.value
        for b in batches:
            sigs, sizes = np.asarray(b.column("sig"), dtype=np.int64), np.asarray(b.column("n"), dtype=np.int32)
            doc, tok, pos, part, side, maps = [], [], [], [], [], np.zeros((len(sigs), WORDS), np.uint64)
            for i, raw in enumerate(b.column("toks").to_pylist()):
                toks = np.frombuffer(raw, np.uint64)
                head, f = _prefix(toks, often)
                at = np.flatnonzero((f > 1) & _has_bit(filled, head.view(np.int64)))
                if not len(at):
                    continue
                maps[i] = _bitmap(toks)
                where = None
                if len(hot_toks):
                    key = head[at].view(np.int64)
                    near = np.minimum(np.searchsorted(hot_toks, key), len(hot_toks) - 1)
                    many = np.where(hot_toks[near] == key, hot_n[near], 0)
                    if many.any():
                        where = [_blocks(int(sigs[i]), int(sizes[i]), int(m), block) for m in many]
                n = np.array([len(w) for w in where]) if where else np.ones(len(at), np.int64)
                doc.append(np.full(n.sum(), i))
                tok.append(np.repeat(head[at].view(np.int64), n))
                pos.append(np.repeat(at, n))
                both = np.array([x for w in where for x in w], np.int64).reshape(-1, 2) if where else np.zeros((len(at), 2), np.int64)
                part.append(both[:, 0])
                side.append(both[:, 1])
            if not doc:
                continue
            d, t, p = np.concatenate(doc), np.concatenate(tok), np.concatenate(part)
            spread = (_mix(t.view(np.uint64) ^ _mix(p.view(np.uint64))) % np.uint64(bins)).astype(np.int32)
            ends = pa.py_buffer(np.arange(0, 8 * WORDS * (len(d) + 1), 8 * WORDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(spread), pa.array(t), pa.array(p), pa.array(np.concatenate(side).astype(np.int32)), pa.array(sigs[d]), pa.array(sizes[d]),
                    pa.array(np.concatenate(pos).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(d), [None, ends, pa.py_buffer(maps[d].tobytes())]),
                ],
                schema=ENTRY,
            )

    listed = classes.mapInArrow(entries, "bin int, tok bigint, part bigint, side int, sig bigint, n int, pos int, map binary")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bins > 16 * session:  # a partition of a few bins at most
        listed = listed.repartition(bins // 16, "bin")
    pairs = listed.groupBy("bin").applyInArrow(_candidates, "a bigint, b bigint").distinct()
    pairs = materialize(pairs, "candidates")
    # only sets that are in a pair travel to be compared
    paired = spark.sparkContext.broadcast(_bit_set(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), min(n_sets, 2 * pairs.count())))
    asked = classes.mapInArrow(_with_bit(paired, "sig", True), schema)
    left = asked.select(F.col("sig").alias("a"), F.col("toks").alias("ta"))
    right = asked.select(F.col("sig").alias("b"), F.col("toks").alias("tb"))
    links = materialize(pairs.join(left, "a").join(right, "b").mapInArrow(_exact, "a bigint, b bigint"), "links")
    return members, links


def _blocks(sig: int, n: int, most: int, block: int | None = None) -> list[tuple[int, int]]:
    """Where a member of a triple goes: (part, side) pairs.

    A triple that few sets share is one part. Others are split by size band
    and hash into blocks; each pair of blocks whose sizes can match is a part,
    so a hot triple is met by many tasks and loses no pair.
    """
    block = block or BLOCK
    if most <= block:
        return [(0, 0)]
    out = []
    per_band = -(-most // block)
    band = int(np.log(n) / np.log(DEN / NUM))
    own = (sig & 0x7FFFFFFF) % per_band
    for other_band in (band - 1, band, band + 1):
        for other in range(per_band):
            x, y = (band, own), (other_band, other)
            lo, hi = min(x, y), max(x, y)
            part = ((lo[0] * per_band + lo[1]) * 4_000_037 + hi[0] * per_band + hi[1]) * 2 + 1
            out.append((part, 0 if x == y else (1 if x == lo else 2)))
    return out


def similar_pairs(records: DataFrame, key: str, text: str) -> DataFrame:
    """doc_a < doc_b: keys of all pairs of records that share most of their text."""
    members, links = similar_contents(records, key, text)
    members = materialize(members, "members")
    # a class of many members is met in pieces: one side is split, the other goes to every piece
    pieces = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("pieces"))
    pieces = materialize(pieces.where("pieces > 1"), "pieces")
    cut = members.join(pieces, "sig", "left").select("sig", "id", F.coalesce("pieces", F.lit(1)).alias("pieces"))
    every = cut.select("sig", "id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    one = cut.select("sig", "id", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    within = one.select("sig", "piece", F.col("id").alias("ia")).join(every.select("sig", "piece", F.col("id").alias("ib")), ["sig", "piece"]).where("ia < ib")
    a = links.join(members.select(F.col("sig").alias("a"), F.col("id").alias("ia")), "a").join(pieces.select(F.col("sig").alias("b"), "pieces"), "b", "left")
    a = a.select("ia", F.col("b").alias("sig"), F.pmod(F.xxhash64("ia"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"))
    across = a.join(every.select("sig", "piece", F.col("id").alias("ib")), ["sig", "piece"]).where("ia <> ib")
    both = across.select("ia", "ib").unionByName(within.select("ia", "ib"))
    return both.select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b")).distinct()


def groups(records: DataFrame, key: str, text: str) -> DataFrame:
    """id, group_id, links: a row per record that has triples enough.

    group_id is the least id of the records linked with it, directly or
    through others; links counts the classes similar to its own. Labels spread
    over links by minimum with pointer jumping until none changes.
    """
    members, links = similar_contents(records, key, text)
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(label.select(F.col("a").alias("b"), F.col("label").alias("other")), "b")
        step = (
            label.join(seen.groupBy("a").agg(F.min("other").alias("other")), "a")
            .select("a", F.least("label", "other").alias("next"), "label")
        )
        jump = label.select(F.col("a").alias("next"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "next", "left").select("a", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("was")), "labels")
        moved = new.where("label <> was").limit(1).count()
        label = new.drop("was")
        if not moved:
            break
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    placed = (
        members.withColumnRenamed("sig", "a")
        .join(label, "a", "left")
        .join(degree, "a", "left")
        .select("id", F.coalesce("label", "a").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    placed = materialize(placed, "placed")
    first = placed.groupBy("label").agg(F.min("id").alias("group_id"))
    return placed.join(first, "label").select("id", "group_id", "links")
