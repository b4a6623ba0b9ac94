import random

import numpy as np
import pyarrow as pa

from siltstone.llm import near_duplicates as N
from tests.conftest import rows

KIND = "doc_num_id bigint, content string, sig string, n int, a int"


def brute(data):
    import regex

    sets = {}
    for i, t, *_ in data:
        if i is not None and t is not None:
            w = [x.lower() for x in regex.findall(r"[\p{L}\p{N}]+", t)]
            s = set(zip(w, w[1:], w[2:]))
            if len(s) >= 30:
                sets.setdefault(i, set()).add(frozenset(s))
    keys = sorted(sets)
    out = set()
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if any(len(s & t) * 10 >= 6 * len(s | t) for s in sets[a] for t in sets[b]):
                out.add((a, b))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "ÉTÉ", "x1"]
    phrases = [[rng.choice(words) for _ in range(9)] for _ in range(12)]
    data, i = [], 0
    for _ in range(14):
        base = [w for _ in range(rng.randrange(4, 30)) for w in (rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(words) for _ in range(8)])]
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, len(t) // 6 + 1)):
                p = rng.randrange(len(t))
                r = rng.random()
                if r < 0.4:
                    t[p] = rng.choice(words)
                elif r < 0.7:
                    t.insert(p, rng.choice(words))
                else:
                    del t[p]
            i += 1
            data.append((i, rng.choice([" ", "\n", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in t), "c", 1, 2))
    return data


def test_against_brute_force(spark):
    data = corpus(1)
    data += data[:5] + [(500, data[0][1], "c", 1, 2), (501, None, "", 1, 1), (502, "", "", 1, 1), (503, "few words", "", 1, 1), (None, data[0][1], "", 1, 1), (504, "long " * 5, "", 1, 1), (505, " ".join(f"v{k}" for k in range(60_000)), "", 0, 0)]
    df = spark.createDataFrame(data, KIND).repartition(3)
    want = brute([d for d in data if d[0] != 505])
    assert rows(N.similar_pairs(df, "doc_num_id", "content"), "doc_a", "doc_b") == want and len(want) > 20
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[find(a)] = find(b)
    got = {r.id: r.group_id for r in N.groups(df, "doc_num_id", "content").collect()}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert N.similar_pairs(df, "doc_num_id", "content").count() == 0 and N.groups(df, "doc_num_id", "content").count() == 0


def test_tree_finds_all_pairs_of_large_groups():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = []
    for k in range(150):
        size = int(rng.integers(100, 300))
        own = base[:size].copy()
        own[rng.choice(size, size // 8, replace=False)] = rng.integers(0, 1 << 62, size // 8)
        sets.append(np.unique(own))
    n = np.array([len(s) for s in sets])
    o = np.argsort(n, kind="stable")
    tree = N.SignatureTree(np.ones(len(o), int), n[o], np.stack([N._bitmap(sets[i]) for i in o]))
    got = {(min(o[a], o[b]), max(o[a], o[b])) for x, y in tree.pairs() for a, b in zip(x, y)}
    for i in range(150):
        for j in range(i + 1, 150):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 16 * c >= 6 * (n[i] + n[j]):
                assert (i, j) in got
    assert len(got) < 150 * 149 // 2


def test_blocks_of_a_hot_triple_lose_no_pair(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 10)
    rng = np.random.default_rng(3)
    members = [(int(s), int(n)) for s, n in zip(rng.integers(1, 1 << 40, 60), rng.integers(30, 200, 60))]
    at = [dict(N._blocks(s, n, 60)) for s, n in members]
    for i, (_, a) in enumerate(members):
        for j, (_, b) in enumerate(members):
            if i != j and min(a, b) * 10 >= 6 * max(a, b):
                met = [p for p in at[i].keys() & at[j].keys() if at[i][p] != at[j][p] or at[i][p] == 0]
                assert met


def test_candidates_of_split_groups(monkeypatch):
    rows_ = [(0, 7, part, side, s, 40, 0, N._bitmap(np.arange(40, dtype=np.uint64) * 977).tobytes()) for s in (1, 2, 3) for part, side in ((5, 1 if s < 3 else 2),)]
    tbl = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_), N.ENTRY)], schema=N.ENTRY)
    got = N._candidates(tbl).to_pydict()
    assert sorted(zip(got["a"], got["b"])) == [(1, 3), (2, 3)]


def test_small_sketch_and_blocks(spark, monkeypatch):
    """With nearly no cells, hot triples split at four sets and classes cut at three, no pair is lost and little more is sent."""
    data = corpus(4)
    common = " ".join(f"boiler{k} plate{k} text{k}" for k in range(4))
    data = [(i, f"{t} {common}", *rest) for i, t, *rest in data]
    data += [(1000 + k, data[0][1], "c", 1, 2) for k in range(11)]
    df = spark.createDataFrame(data, KIND).repartition(4)
    want = brute(data)
    real = N._candidates
    monkeypatch.setattr(N, "CELLS", (64, 64))
    monkeypatch.setattr(N, "BITS", (1 << 10, 1 << 10))
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "MOST_HOT", 50)
    monkeypatch.setattr(N, "COPIES", 3)
    monkeypatch.setattr(N, "ENTRIES_PER_BIN", 300)
    acc = spark.sparkContext.accumulator(0)

    def counted(tbl):
        acc.add(tbl.num_rows)
        return real(tbl)

    monkeypatch.setattr(N, "_candidates", counted)
    assert rows(N.similar_pairs(df, "doc_num_id", "content"), "doc_a", "doc_b") == want and len(want) > 60
    triples = sum(len(N.triples(d[1])) for d in data)
    assert 0 < acc.value < 3 * triples


def test_many_copies_meet_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 7)
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(i, text + (" and more" if i % 5 == 0 else ""), "c", 1, 2) for i in range(40)], KIND)
    assert N.similar_pairs(df, "doc_num_id", "content").count() == 40 * 39 // 2
    got = N.groups(df, "doc_num_id", "content").collect()
    assert {(r.group_id, r.links) for r in got} == {(0, 1)} and len(got) == 40
