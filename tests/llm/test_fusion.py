import random

from siltstone.llm.fusion import leximin_top
from tests.conftest import rows

RES = "query_id bigint, leg string, score double, doc_num_id bigint, s int, n int, docs string"
LEG = "leg string, higher_is_better boolean, up int"


def brute(res, legs, k):
    up = {leg: u for leg, u, _ in legs}
    cell, docs = {}, {}
    for q, leg, s, d, *_ in res:
        if q is None or d is None or leg not in up:
            continue
        docs.setdefault(q, set()).add(d)
        if s is not None and s == s:
            v = s if up[leg] else -s
            cell[q, d, leg] = max(v, cell.get((q, d, leg), v))
    out = []
    for q, ds in docs.items():
        vec = {d: [] for d in ds}
        for leg in up:
            known = [cell[q, d, leg] for d in ds if (q, d, leg) in cell]
            worst = min(known, default=0)
            val = {d: cell.get((q, d, leg), worst) for d in ds}
            for d in ds:
                vec[d].append(sum(v < val[d] for v in val.values()))
        order = sorted(ds, key=lambda d: ([-x for x in sorted(vec[d])], d))
        out += [(q, d, i + 1) for i, d in enumerate(order[:k])]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(8)
    legs = [("a", True, 1), ("b", False, 1), ("c", True, 1), ("c", True, 1)]
    res = []
    for q in range(25):
        for d in rng.sample(range(60), rng.randrange(1, 30)):
            for leg in "abcx":
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    s = rng.choice([None, float("nan"), rng.randrange(5) * 1.0, rng.gauss(0, 100)])
                    res.append((q, leg, s, d, 1, 2, "x"))
    res += [(99, "a", float(i % 700), i, 0, 0, "") for i in range(1500)]  # a query with most of the rows
    res += res[:40] + [(None, "a", 1.0, 5, 0, 0, ""), (1, "a", 1.0, None, 0, 0, ""), (1, None, 1.0, 5, 0, 0, "")]
    got = leximin_top(spark.createDataFrame(res, RES), spark.createDataFrame(legs, LEG), 3)
    assert rows(got, "query_id", "doc_num_id", "place") == brute(res, list(dict.fromkeys(legs)), 3)


def test_a_good_score_hides_no_bad_one(spark):
    res = [(1, leg, s, d, 0, 0, "") for d, row in {1: (1000.0, 0.1), 2: (5.0, 0.6), 3: (4.0, 0.7), 4: (1.0, 0.2)}.items() for leg, s in zip("ab", row)]
    got = leximin_top(spark.createDataFrame(res, RES), spark.createDataFrame([("a", True, 0), ("b", True, 0)], LEG), 4)
    assert [r[0] for r in sorted(rows(got, "doc_num_id", "place"), key=lambda r: r[1])] == [2, 3, 1, 4]


def test_empty(spark):
    assert leximin_top(spark.createDataFrame([], RES), spark.createDataFrame([], LEG), 3).count() == 0
    assert leximin_top(spark.createDataFrame([], RES), spark.createDataFrame([("a", True, 0)], LEG), 3).count() == 0
