import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from siltstone.llm import encoding as E
from siltstone.llm.mixture import copies, mixing_plan, reached_shares, sized_documents
from siltstone.runtime import tokenizer_dir


@pytest.fixture(scope="module")
def enc():
    return E.FragmentEncoder(f"{tokenizer_dir()}/{E.VOCABULARY}")


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sd re  \n\t\r!?,.0123éß中　  🙂<|>"), st.characters(codec="utf-8")), max_size=80), max_size=5))
@settings(max_examples=200, deadline=None)
def test_fragments_give_the_ids_of_the_whole(enc, texts):
    ids, n = enc.encode(texts)
    ends = np.append(0, np.cumsum(n))
    for i, t in enumerate(texts):
        want = enc.plain.encode_ordinary(t)
        assert ids[ends[i] : ends[i + 1]].tolist() == want
        assert enc.plain.decode_bytes(want) == t.encode()


def test_long_texts_and_forgetting(enc, monkeypatch):
    monkeypatch.setattr(E, "MEMO_BYTES", 500)
    for t in ("a" * 200_000, " " * 100_000, "word " * 100_000, "<|endoftext|>" * 100, " ".join(map(str, range(500)))):
        ids, n = enc.encode([t, None, ""])
        assert ids.tolist() == enc.plain.encode_ordinary(t) and n.tolist() == [len(ids), 0, 0]


def test_texts_without_blanks_are_cut(enc):
    rng = random.Random(3)
    for t in ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000)), "a,b;c(d)" * 300, "xkq7Zw#!pQ" * 200, "жщюэ中文字" * 90):
        frags = enc.fragments(t.encode())
        assert b"".join(frags) == t.encode() and max(map(len, frags)) < 64 and len(frags) > 100
        ids, _ = enc.encode([t])
        assert ids.tolist() == enc.plain.encode_ordinary(t)
    assert (enc.cut & ~enc.certain).sum() == 0 and enc.cut.sum() > 10_000


DOCS = "doc_id bigint, text string, source string, n_tokens int, name string, ids int"


def test_tables(spark, enc):
    data = [(1, "Hello world", "a", 1, "x", 0), (2, "", "a", 1, "x", 0), (3, None, None, 1, "x", 0), (4, "Hello world", "b", 1, "x", 0)]
    got = {r.doc_id: r.ids for r in E.encode_texts(spark.createDataFrame(data, DOCS)).collect()}
    want = enc.plain.encode_ordinary("Hello world")
    assert got == {1: want, 2: [], 3: [], 4: want}
    assert E.encode_texts(spark.createDataFrame([], DOCS)).count() == 0


TARGETS = "source string, target_share double, max_repeats int, size int"


def test_mixing(spark):
    rng = random.Random(4)
    data = [(i, "tok " * rng.randrange(1, 40), rng.choice(["big", "BIG ", "big", "small", None, "other"]) if i % 20 else "tiny", 0, "", 0) for i in range(3000)]
    docs = spark.createDataFrame(data, DOCS).repartition(20)
    targets = spark.createDataFrame([("Big", 0.3, 2, 1), ("small", 0.4, 3, 1), ("tiny", 0.2, 2, 1), ("absent", 0.1, 5, 1), ("absent", 0.1, 5, 1)], TARGETS)
    sized = sized_documents(docs).cache()
    plan = mixing_plan(sized, targets)
    assert {r.source for r in plan.where("NOT reachable").collect()} == {"tiny", "absent"}
    p = {r.name: r for r in plan.collect()}
    got = copies(sized, plan)
    assert got.where("copies < 0").count() == 0 and got.select("doc_id").distinct().count() == got.count()
    used = {r["name"]: (r["n"], r["m"], r["c"]) for r in got.groupBy("name").agg({"*": "count"}).selectExpr("name", "`count(1)` AS n", "0 AS m", "0 AS c").collect()}
    assert set(used) == {"big", "small", "tiny"}
    for name in used:
        rows = got.where(got.name == name).collect()
        assert max(r.copies for r in rows) <= p[name].max_repeats
        assert {r.copies for r in rows} <= {int(p[name].rate), int(p[name].rate) + 1}
        # token mass is kept but for the one document left at the end
        assert abs(sum(r.copies * r.n_tokens for r in rows) - p[name].rate * p[name].size) <= max(r.n_tokens for r in rows) + 1e-6 * p[name].size
    shares = {r.source: r for r in reached_shares(sized, targets).collect()}
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-5 and shares["absent"].used_tokens == 0


def test_pivotal_rounding_keeps_mass_and_chances():
    from siltstone.llm.mixture import _pivot

    rng = np.random.default_rng(5)
    size = np.concatenate([rng.integers(1, 2000, 40), [0, 0, 0, 50_000]]).astype(float)
    group = np.repeat([0, 1], [30, 14])
    ids = np.arange(44)
    mean = np.zeros(44)
    for seed in range(3000):
        p = _pivot(ids, group, np.where(group == 0, 0.3, 0.7), size, seed)
        for g in (0, 1):
            assert abs((p * size)[group == g].sum() - (0.3, 0.7)[g] * size[group == g].sum()) < 1e-3
            assert ((p > 0) & (p < 1) & (group == g)).sum() <= 1
        mean += p
    assert np.abs(mean / 3000 - np.where(group == 0, 0.3, 0.7)).max() < 0.05


def test_mixing_of_nothing(spark):
    none = sized_documents(spark.createDataFrame([], DOCS))
    targets = spark.createDataFrame([("a", 0.5, 2, 1), ("b", None, None, 1)], TARGETS)
    assert mixing_plan(none, targets).where("NOT reachable").count() == 0
    assert reached_shares(none, targets).count() == 2
    assert mixing_plan(none, spark.createDataFrame([], TARGETS)).count() == 0
