import numpy as np

from siltstone.llm import neighbours as M
from tests.conftest import rows

KIND = "chunk_id bigint, num_tokens int, dimension int, data array<float>, key bigint, ids int"


def brute(ids, x):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x.astype(np.float64) @ x.T.astype(np.float64), 6)
    out = set()
    for i in range(len(ids)):
        o = [j for j in np.lexsort((ids, -s[i])) if j != i][:5]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in o}
    return out


def clustered(rng, n, spread=0.06):
    c = rng.standard_normal((n // 9 + 1, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return (c[rng.integers(0, len(c), n)] + spread * rng.standard_normal((n, 64))).astype(np.float32)


def table(spark, x, tokens=3):
    data = [(i, tokens, 64, x[i * tokens : (i + 1) * tokens].ravel().tolist(), 1, 2) for i in range(len(x) // tokens)]
    return data, np.array([i * 64 + t for i in range(len(x) // tokens) for t in range(tokens)])


def test_recall_and_dirt(spark):
    x = clustered(np.random.default_rng(1), 3000)
    data, ids = table(spark, x)
    dirt = data[:7] + [(9000, 1, 32, [1.0] * 32, 0, 0), (9001, 2, 64, [1.0] * 64, 0, 0), (9002, 1, 64, None, 0, 0), (9003, 1, 64, [0.0] * 64, 0, 0), (9004, 1, 64, [float("nan")] * 64, 0, 0), (None, 1, 64, [1.0] * 64, 0, 0), (9005, None, None, [1.0] * 64, 0, 0), (9006, 0, 64, [], 0, 0)]
    got = set(rows(M.nearest_pairs(spark.createDataFrame(data + dirt, KIND).repartition(5)), "vec_a", "vec_b"))
    want = brute(ids, x)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    x = clustered(rng, 60)
    x[10:40] = x[10]  # thirty copies, some of another length
    x[20:30] *= 3
    x[50] = x[51]
    data, ids = table(spark, x, 1)
    got = set(rows(M.nearest_pairs(spark.createDataFrame(data, KIND)), "vec_a", "vec_b"))
    assert got == brute(ids, x)


def test_few_vectors(spark):
    assert M.nearest_pairs(spark.createDataFrame([], KIND)).count() == 0
    assert M.nearest_pairs(spark.createDataFrame([(1, 1, 64, [1.0] * 64, 0, 0)], KIND)).count() == 0
    two = spark.createDataFrame([(1, 1, 64, [1.0] * 64, 0, 0), (2, 1, 64, [-1.0] * 64, 0, 0)], KIND)
    assert rows(M.nearest_pairs(two), "vec_a", "vec_b") == [(64, 128)]


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(4)
    x = clustered(rng, 6000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = M.CentroidGraph(M.fit_centroids(x, 300))
    ids, _ = g.search(x[:1000], 3)
    best = np.argmax(x[:1000] @ g.c.T, axis=1)
    assert (ids[:, 0] == best).mean() > 0.96


def test_oversized_list_is_split(monkeypatch):
    monkeypatch.setattr(M, "SPLIT_ABOVE", 400)
    x = clustered(np.random.default_rng(5), 2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = M._quantize(x)
    ids = np.arange(2000)
    near = {}
    for k, who, neg, n in M._list_members(ids.copy(), q, ids, np.arange(2001, dtype=np.int32)):
        ends = np.append(0, np.cumsum(n))
        for i, key in enumerate(k):
            near.setdefault(int(key), set()).update(zip(neg[ends[i] : ends[i + 1]].tolist(), who[ends[i] : ends[i + 1]].tolist()))
    got = {(min(a, b), max(a, b)) for a, v in near.items() for _, b in sorted(v)[:5]}
    want = brute(ids, x)
    assert len(got & want) / len(want) > 0.93
    same = np.tile(q[:1], (900, 1))
    assert sum(len(k) for k, *_ in M._list_members(np.arange(900), same, np.arange(900), np.arange(901, dtype=np.int32))) == 900


def test_a_centroid_itself_is_in_two_lists():
    rng = np.random.default_rng(6)
    c = rng.standard_normal((50, 64)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    row, _ = M.choose_lists(M.CentroidGraph(c), c)
    assert (np.bincount(row, minlength=50) >= 2).all()
    assert len(M.choose_lists(M.CentroidGraph(c[:1]), c[:3])[0]) == 3


def test_rows_are_routed_to_further_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_LISTS", 6)
    monkeypatch.setattr(M, "VECTORS_PER_LIST", 120)
    monkeypatch.setattr(M, "ROUTE_ABOVE", 500)
    monkeypatch.setattr(M, "TASK_BYTES", 1 << 16)
    x = clustered(np.random.default_rng(8), 3000)
    data, ids = table(spark, x)
    got = set(rows(M.nearest_pairs(spark.createDataFrame(data, KIND).repartition(3)), "vec_a", "vec_b"))
    want = brute(ids, x)
    assert len(got & want) / len(want) >= 0.95


def test_exact_search_and_recall(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUTE_ABOVE", 300)
    x = clustered(np.random.default_rng(9), 900)
    x[200:212] = x[200]
    data, ids = table(spark, x)
    df = spark.createDataFrame(data + data[:4] + [(None, 1, 64, [1.0] * 64, 0, 0)], KIND)
    got = {r.vec: r.near for r in M.exact_nearest(df, 2).collect()}
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(y @ y.T, 6)
    want = {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i])) if j != i][:5] for i in range(len(ids)) if ids[i] % 2 == 0}
    assert sum(got[k] == v for k, v in want.items()) / len(want) > 0.99 and got.keys() == want.keys()
    assert M.recall(df, 2).first()["recall"] >= 0.97
    assert M.exact_nearest(spark.createDataFrame([], KIND)).count() == 0


def test_vectors_meet_their_nearest_in_a_list_however_many_lists_there_are():
    rng = np.random.default_rng(12)
    c = rng.standard_normal((4000, 64)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = rng.standard_normal((400, 1, 64)) + 0.22 * rng.standard_normal((400, 2, 64))  # pairs near each other
    x = (x / np.linalg.norm(x, axis=2, keepdims=True)).astype(np.float32).reshape(-1, 64)
    ids, sc = M.CentroidGraph(c).search(x, 3)
    assert (ids == np.argsort(-(x @ c.T), axis=1)[:, :3]).all() and (np.diff(sc) <= 0).all()
    row, lst = M.choose_lists(M.CentroidGraph(c), x)
    of = [set(lst[row == i].tolist()) for i in range(len(x))]
    assert np.mean([bool(a & b) for a, b in zip(of[::2], of[1::2])]) > 0.95


def test_a_split_list_gives_one_row_a_member_with_the_nearest_of_all_its_cells():
    x = clustered(np.random.default_rng(13), 9000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(9000)
    ((keys, who, neg, n),) = M._list_members(ids.copy(), M._quantize(x), ids, np.arange(9001, dtype=np.int32))
    own = np.repeat(keys, n)
    got = {(min(a, b), max(a, b)) for a, b in zip(own.tolist(), who.tolist())}
    assert (n == 5).all() and len(set(zip(own.tolist(), who.tolist()))) == len(own)
    assert len(got & brute(ids, x)) / len(got) > 0.98
