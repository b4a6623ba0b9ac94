import io
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.stemmer import stem
from siltstone.operators import late_interaction as L, lexical, lookup, packages, upsert, vectors as V
from siltstone.sources import files as S, index_store
from siltstone.sources.embeddings import EmbeddingStore, one_dimension
from tests.conftest import rows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "word, want",
    [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("skies", "sky"), ("flying", "fli"), ("happily", "happili"), ("agreed", "agre"), ("conditional", "condit"), ("by", "by"), ("say", "say"), ("rust", "rust"), ("größe", "größe")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_text_edges(spark):
    assert one(spark, "", T.lines) == [] and one(spark, "a\r\nb\n", T.lines) == ["a", "b"] and one(spark, None, T.lines) is None
    text = "\n".join(f"l{i}" for i in range(1, 9))
    got = one(spark, text.replace("l5", "hit"), lambda c: T.excerpts(c, "HIT"))
    assert [(e.start_line, e.end_line) for e in got] == [(3, 7)]
    got = one(spark, text.replace("l3", "hit").replace("l5", "hit"), lambda c: T.excerpts(c, "hit"))
    assert [(e.start_line, e.end_line) for e in got] == [(1, 7)]
    assert [(e.start_line, e.end_line) for e in one(spark, text, lambda c: T.excerpts(c, "none"))] == [(1, 6)]
    assert one(spark, "ä" * 300, lambda c: T.snippet(c, "q")).text == "ä" * 200
    assert one(spark, "aäb", lambda c: T.byte_range(c, 0, 1)) == "a\n\n[... 3 more bytes remaining]"
    assert one(spark, "aäb", lambda c: T.byte_range(c, 2, 9)) == "äb"
    assert one(spark, "---\na: 1\nb: x y\na: 2\n---\nbody", T.front_matter_map) == {"b": "x y", "a": "2"}
    assert one(spark, "---\nopen", T.strip_front_matter) == "---\nopen"
    assert one(spark, "x [[a/b#s|c]] [[d]]", T.wiki_links)[0].asDict() == {"target": "a/b", "fragment": "s", "label": "c"}
    assert one(spark, "doc://c/a%20b", T.uri_parts).asDict() == {"collection": "c", "path": "a b"}


@pytest.mark.parametrize("text, kept", [("a" + "ä" * 300, 200), ("€" * 200, 133), ("a" + "😀" * 120, 100), ("ab" + "😀" * 120, 101), ("abc" + "😀" * 120, 102), ("\ufffd" * 200, 133), ("a" * 500, 400)])
def test_excerpts_are_cut_at_a_character(spark, text, kept):
    assert [(e.text, e.start_line, e.end_line) for e in one(spark, text, lambda c: T.excerpts(c, "q"))] == [(text[:kept], 1, 1)]
    got = one(spark, f"{text}\nq\n{text}", lambda c: T.excerpts(c, "q"))
    assert [(e.text, e.start_line, e.end_line) for e in got] == [(text[:kept], 1, 3)]


@pytest.mark.parametrize("text, kept", [("a" + "ä" * 300, 200), ("€" * 200, 133), ("ab" + "😀" * 120, 101), ("\ufffd" * 200, 133), ("a" * 400 + "ä", 400), ("a" * 399 + "ä", 399)])
def test_snippets_are_cut_at_a_character(spark, text, kept):
    assert tuple(one(spark, text, lambda c: T.snippet(c, "q"))) == (text[:kept], 1)
    assert tuple(one(spark, f"1\n2\n3\nQ{text}\n5", lambda c: T.snippet(c, "q")))[1] == 2


def test_snippets_of_null_and_empty_texts(spark):
    assert one(spark, None, lambda c: T.snippet(c, "q")) is None and one(spark, "", lambda c: T.snippet(c, "q")) is None
    assert one(spark, "", lambda c: T.excerpts(c, "q")) == []


def test_first_excerpts_of_many(spark):
    text = "\n".join("hit" if i % 7 == 0 else "l" for i in range(1, 40))
    assert [(e.start_line, e.end_line) for e in one(spark, text, lambda c: T.excerpts(c, "hit"))] == [(5, 9), (12, 16), (19, 23)]
    text = "\n".join("hit" if i % 5 == 0 else "l" for i in range(1, 40))
    assert [(e.start_line, e.end_line) for e in one(spark, text, lambda c: T.excerpts(c, "hit"))] == [(3, 37)]


@given(st.text(alphabet="ab \nä🙂", max_size=400), st.integers(20, 80), st.integers(0, 15))
@settings(max_examples=150, deadline=None)
def test_chunks(text, size, overlap):
    out = T.chunk(text, size, overlap)
    raw = text.encode()
    assert [i for _, i, _ in out] == list(range(len(out)))
    for part, _, start in out:
        assert part and len(part) <= size and raw[start : start + len(part.encode())] == part.encode()
    whole = T.chunk(text, size, 0, contiguous=True)
    if text.strip() and whole:
        assert "".join(p for p, _, _ in whole).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_chunk_examples():
    assert T.chunk("  \n") == [] and T.chunk("Hello, world!") == [("Hello, world!", 0, 0)]
    assert len(T.chunk("word " * 1000, 1000, 200)) == 6


@pytest.mark.parametrize("nbits", [1, 2, 4, 8])
def test_codec_round_trip(nbits):
    rng = np.random.default_rng(nbits)
    x = rng.standard_normal((300, 12))
    c = x[:9]
    near = np.argmin(((x[:, None] - c[None]) ** 2).sum(-1), axis=1)
    codec = V.Codec(nbits, c, *V.quantizer(x - c[near], nbits))
    codes = rng.integers(0, 1 << nbits, (40, 12))
    assert (codec.unpack(codec.pack(codes)) == codes).all()
    cid, raw = codec.encode(x)
    assert (cid == near).all() and (np.diff(codec.cutoffs) >= 0).all()
    err = ((codec.decode(cid, raw) - x) ** 2).mean()
    assert err <= {1: 0.7, 2: 0.35, 4: 0.05, 8: 0.01}[nbits]
    with pytest.raises(ValueError):
        V.Codec(nbits, c, codec.cutoffs[:-1] if nbits > 1 else np.zeros(3), codec.weights)


def test_search_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((150, 12, 16))
    x /= np.linalg.norm(x, axis=-1, keepdims=True)
    toks = spark.createDataFrame([(d, d * 12 + t, x[d, t].tolist()) for d in range(150) for t in range(12)], "doc int, key int, vec array<double>")
    codec = V.fit_codec(toks, 24, 4, vec="vec", key="key")
    codes = V.encode(toks.select("doc", "vec"), codec, "vec").cache()
    hits = 0
    for _ in range(3):
        q = rng.standard_normal((6, 16))
        q /= np.linalg.norm(q, axis=-1, keepdims=True)
        exact = np.argsort(-np.einsum("qe,dte->dqt", q, x).max(-1).sum(-1))[:10]
        got = L.search(codes, codec, q, L.SearchParams(10, 8, None, None)).collect()
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and len(got) == 10
        assert max(r.score for r in got) <= 6.5
        hits += len({r.doc for r in got} & set(exact.tolist()))
        few = L.search(codes, codec, q, L.SearchParams(10, 8, 9.0, None))
        assert few.count() == 0
    assert hits >= 0.7 * 30
    assert L.SearchParams.for_k(800) == L.SearchParams(800, 4, 0.4, 4096) and L.SearchParams.for_k(80).n_probe == 2


def test_pooling():
    x = np.array([[1.0, 2], [3, 4]])
    assert (L.pool(x, 2) == [[2, 3]]).all() and L.pool(x, 1) is x and L.pool(x[:1], 2) is not None
    rng = np.random.default_rng(1)
    for n in (5, 16, 33):
        y = rng.standard_normal((n, 8))
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        assert len(L.pool(y, 2)) <= -(-n // 2) + 1
        kept = L.pool(y, 3, protected=1)
        assert (kept[0] == y[0]).all() and len(kept) == 1 + max((n - 1) // 3, 1)


def test_lexical_edges(spark):
    docs = spark.createDataFrame([(1, "rust rust", None), (2, "go", "rust"), (3, None, None)], "id int, title string, body string")
    idx = lexical.build(docs, "id", ["title", "body"])
    assert [r.doc for r in lexical.top(lexical.bm25(idx, "rust", {"title": 2.0}), 5).collect()] == [1, 2]
    assert lexical.bm25(idx, "?!").count() == 0 and lexical.bm25(idx, "zzz").count() == 0
    pairs = spark.createDataFrame([("abc", "acb", True), ("abc", "abd", True), ("abc", "xyz", False), ("ab", "ba", True), ("a", "b", True), ("abcd", "badc", False)], "a string, b string, w boolean")
    assert pairs.select(lexical.within_one_edit(F.col("a"), F.col("b")).alias("g"), "w").where("g <> w").count() == 0


def test_references(spark):
    docs = lookup.with_ids(spark.createDataFrame([("a", "x.md"), ("b", "x.md"), ("b", "y.md")], "collection string, path string"))
    assert lookup.resolve(docs, "x.md").count() == 0 and rows(lookup.resolve(docs, "y.md")) == [("b", "y.md")]
    assert rows(lookup.resolve(docs, "zz:./q/p.md")) == [("zz", "q/p.md")] and lookup.resolve(docs, "zz:../p").count() == 0
    hexed = docs.where("path = 'y.md'").first()["full_hex"]
    assert rows(lookup.resolve(docs, hexed[:6])) == [("b", "y.md")]


def test_versions(spark):
    v = spark.createDataFrame([("a", n, y) for n, y in [("1.2.3", False), ("1.10.0", False), ("1.11.0", True), ("2.0.0-rc.1", False), ("0.3.9", False), ("bad", False)]], "name string, num string, yanked boolean")
    got = lambda df: [r.num for r in df.collect()]
    assert got(packages.latest(v)) == ["1.10.0"]
    assert got(packages.satisfying(v, "~1.2")) == ["1.2.3"] and got(packages.satisfying(v, "^0.3")) == ["0.3.9"] and got(packages.satisfying(v, ">=1, <1.10")) == ["1.2.3"]
    assert got(packages.resolve(v, packages.PackageRef.parse("a@1.11.0"))) == ["1.11.0"] and got(packages.resolve(v, packages.PackageRef.parse("a"))) == ["1.10.0"]
    for bad in ("", "a@1@2", "a@", "a b"):
        with pytest.raises(ValueError):
            packages.PackageRef.parse(bad)
    order = v.where("num <> 'bad'").orderBy(packages.version_key("num"))
    assert got(order) == ["0.3.9", "1.2.3", "1.10.0", "1.11.0", "2.0.0-rc.1"]
    items = spark.createDataFrame([("t", "old"), ("u", "keep")], "qualified_path string, doc_markdown string")
    docs = spark.createDataFrame([("t", "new"), ("u", "")], "qualified_path string, doc string")
    assert rows(packages.merge_docs(items, docs), "qualified_path", "doc_markdown") == [("t", "new"), ("u", "keep")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    gone = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    assert rows(upsert.update(old, new, gone, ["k"])) == [(2, "c"), (3, "d")]
    assert rows(upsert.upsert(old, new.where("false"), ["k"])) == [(1, "a"), (2, "b")]


def test_archives_and_modules(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for n, body in members.items():
                info = tarfile.TarInfo(n)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return str(tmp_path / name)

    good = archive("a.tar.gz", {"a-1/src/lib.rs": b"pub mod x;\nmod y;\nmod gone;", "a-1/src/x.rs": b"mod z;", "a-1/src/x/z.rs": b"", "a-1/src/y/mod.rs": b"", "a-1/src/lost.rs": b""})
    files = S.read_archives(spark, [good])
    got = S.module_files(files, "src/lib.rs").select("path", F.array_join("module", "::").alias("z"))
    assert rows(got) == [("src/lib.rs", ""), ("src/x.rs", "x"), ("src/x/z.rs", "x::z"), ("src/y/mod.rs", "y")]
    for bad in (archive("b.tar.gz", {"b/../../x": b"1"}), archive("c.tar.gz", {})):
        with pytest.raises(Exception, match="unsafe|no files"):
            S.read_archives(spark, [bad]).count()
    lock = '[[package]]\nname="a"\nversion="1.0.0"\nsource="registry+https://x"\n[[package]]\nname="own"\nversion="0.1.0"\n'
    assert rows(S.lock_packages(spark, lock)) == [("a", "1.0.0")]
    assert S.pdf_to_markdown(["First line\nmore", " "]) == "# First line\nmore"


def test_embedding_store(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "emb"))
    kind = "chunk string, num_tokens int, dimension int, data array<float>"
    assert store.load().count() == 0
    store.store(spark.createDataFrame([("a", 1, 2, [1.0, 2.0]), ("bad", 2, 2, [1.0])], kind), 1)
    store.store(spark.createDataFrame([("a", 1, 2, [3.0, 4.0])], kind), 2)
    wanted = spark.createDataFrame([(0, "z"), (1, "a")], "pos int, chunk string")
    assert [r.data for r in store.batch_load(wanted).collect()] == [None, [3.0, 4.0]]
    assert one_dimension(store.load()) == 2
    with pytest.raises(ValueError):
        one_dimension(store.load().where("false"))


def test_index_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6))
    toks = spark.createDataFrame([(i // 4, i, v.tolist()) for i, v in enumerate(x)], "doc int, key int, vec array<double>")
    codec = V.fit_codec(toks, 4, 4, vec="vec", key="key")
    codes = V.encode(toks.select("doc", "vec"), codec, "vec")
    index_store.save(codes, codec, str(tmp_path / "ix"))
    back, again = index_store.load(spark, str(tmp_path / "ix"))
    q = x[:2]
    p = L.SearchParams(3, 4, None, None)
    assert rows(L.search(back, again, q, p)) == rows(L.search(codes, codec, q, p))
    index_store.save(codes.withColumn("cid", F.lit(99)), codec, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        index_store.load(spark, str(tmp_path / "bad"))
    full = L.token_scores(toks.withColumnRenamed("key", "tok"), q).collect()
    assert np.allclose([r.scores for r in sorted(full, key=lambda r: r.tok)], x @ q.T)


def test_links_and_small_reports(spark):
    docs = spark.createDataFrame([("c", "a/One.md"), ("c", "b/two.md"), ("c", "x/two.md"), ("d", "one.md")], "collection string, path string")
    links = spark.createDataFrame([("c", "a/One"), ("c", "one"), ("c", "two"), ("c", "b/two.md"), ("c", "none")], "collection string, target string")
    assert rows(lookup.link_targets(links, docs), "target", "path") == [("a/One", "a/One.md"), ("b/two.md", "b/two.md"), ("none", None), ("one", "a/One.md"), ("two", None)]
    talks = spark.createDataFrame([("x", "t", 5, ["m"]), ("y", "u", 9, [])], "id string, title string, updated_at bigint, messages array<string>")
    assert [tuple(r) for r in lookup.conversation_summary(talks).collect()] == [("y", "u", 9, 0), ("x", "t", 5, 1)]
    assert rows(lookup.result_json(spark.createDataFrame([(1, 0.5)], "rank int, score double"))) == [('{"rank":1,"score":"0.500000"}',)]
    cached = spark.createDataFrame([("a", "1.0.0"), ("a", "2.1.0"), ("b", "1.0.0")], "name string, version string")
    assert rows(packages.evict(cached, "a", "^1")) == [("a", "2.1.0"), ("b", "1.0.0")] and packages.evict(cached, "a").count() == 1
    asked = spark.createDataFrame([("a", "latest", 10), ("b", "1.0", 10), ("c", "latest", 95)], "name string, spec string, resolved_at bigint")
    assert rows(packages.stale(asked, 100, 50), "name") == [("a",)]
    impls = spark.createDataFrame([("t", "impl t for B"), ("t", "impl t for A")], "trait_path string, impl_signature string")
    assert packages.implementors_block(impls).first().block == "# Implementors\n\n- `impl t for A`\n- `impl t for B`\n"


def test_cleanup_deletes_only_own_tables(spark, monkeypatch, tmp_path):
    from siltstone import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    kept = tmp_path / "other"
    kept.mkdir()
    assert runtime.materialize(spark.range(3)).count() == 3 and (tmp_path / "siltstone").exists()
    runtime.cleanup(spark)
    assert not (tmp_path / "siltstone").exists() and kept.exists()
