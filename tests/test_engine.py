import os

import pytest

from siltstone.engine import Engine, SearchOptions
from siltstone.runtime import scratch
from tests.conftest import rows


@pytest.fixture()
def folder(tmp_path):
    files = {
        "rust-guide.md": "---\ntags: x\n---\n# Rust guide\n\nOwnership and borrowing make Rust safe.\nThe borrow checker helps.\n",
        "python.md": "# Python intro\n\nPython is a friendly language for scripts.\n",
        "deep/pasta.txt": "Boil water, add salt and cook the pasta.\n",
        ".hidden/secret.md": "# hidden rust\n",
        "image.png": "no text",
        "broken.md": None,
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xfe\xfa" if text is None else text.encode())
    return tmp_path


def test_life_of_a_collection(spark, folder):
    e = Engine(spark, scratch(spark, "engine"))
    e.add_collection("notes", str(folder))
    with pytest.raises(ValueError):
        e.add_collection("notes", str(folder))
    assert rows(e.sync(), "path", "change") == [("deep/pasta.txt", "new"), ("python.md", "new"), ("rust-guide.md", "new")]
    assert e.sync().count() == 0
    assert [tuple(r) for r in e.status().collect()] == [("notes", 3)]

    for mode in ("bm25", "semantic", "hybrid"):
        got = e.search("rust borrowing", SearchOptions(mode=mode, count=2)).orderBy("rank").collect()
        assert got[0]["path"] == "rust-guide.md" and got[0]["title"] == "Rust guide" and [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert got[0]["excerpts"][0]["start_line"] == 1
    assert e.search("rust", SearchOptions(mode="bm25", collection="other")).count() == 0
    assert e.search("rsut", SearchOptions(mode="bm25")).first()["path"] == "rust-guide.md"
    assert e.search("rsut", SearchOptions(mode="bm25", fuzzy=False)).count() == 0

    e.set_context("doc://notes", "all notes")
    assert e.search("pasta", SearchOptions(mode="bm25")).first()["context"] == "all notes"
    assert e.get("notes:python.md", 1, 1).first()["text"] == "# Python intro\n\n[... 2 more lines remaining]"
    assert e.get("python.md", numbers=True).first()["text"].startswith("1: # Python intro")
    assert e.get("notes:../python.md").count() == 0
    assert rows(e.multi_get("*.md"), "path") == [("python.md",), ("rust-guide.md",)]

    (folder / "python.md").write_text("# Python intro\n\nGenerators and iterators.\n")
    os.remove(folder / "deep/pasta.txt")
    assert rows(e.sync(), "path", "change") == [("deep/pasta.txt", "deleted"), ("python.md", "changed")]
    assert e.search("pasta", SearchOptions(mode="bm25")).count() == 0
    assert e.search("generators", SearchOptions(mode="hybrid", count=1)).first()["path"] == "python.md"

    e.ingest("notes", "./new.md", "# Fresh\n\nkangaroo", {"kind": "memo"})
    hit = e.search("kangaroo", SearchOptions(mode="bm25")).first()
    assert hit["path"] == "new.md" and hit["metadata"] == '{"kind": "memo"}'
    e.delete("notes:new.md")
    assert e.search("kangaroo", SearchOptions(mode="bm25")).count() == 0
    other = Engine(spark, e.root, model="another")
    with pytest.raises(ValueError):
        other.sync()
    e.remove_collection("notes")
    assert e.collections().count() == 0 and e.table("documents").count() == 0 and e.table("tokens").count() > 0


def test_commits_are_whole(spark, folder, monkeypatch):
    """Whatever step of a write fails, all tables stay as they were; a rollback takes back the last commit."""
    from siltstone import engine as M

    e = Engine(spark, scratch(spark, "engine"))
    e.add_collection("notes", str(folder))
    e.sync()
    before, commits = rows(e.table("documents"), "path"), e.log.numbers()
    writes = len(e.TABLES)
    real = M.lexical.laid_out
    (folder / "python.md").write_text("# Python intro\n\nwombat\n")

    def broken(rows_):
        raise OSError("disk lost")

    monkeypatch.setattr(M.lexical, "laid_out", broken)
    with pytest.raises(OSError):
        e.sync()
    monkeypatch.setattr(M.lexical, "laid_out", real)
    other = Engine(spark, e.root)
    real_publish = M.ManifestLog.publish
    stolen = []

    def late(log, number, manifest):
        if not stolen:
            stolen.append(1)
            other.set_context("doc://notes", "by another writer")
        real_publish(log, number, manifest)

    monkeypatch.setattr(M.ManifestLog, "publish", late)
    with pytest.raises(RuntimeError):
        e.sync()
    monkeypatch.setattr(M.ManifestLog, "publish", real_publish)
    assert rows(e.table("documents"), "path") == before and len(e.log.numbers()) == len(commits) + 1
    assert e.search("wombat", SearchOptions(mode="bm25")).count() == 0 and e.table("contexts").count() == 1
    e.sync()
    assert e.search("wombat", SearchOptions(mode="bm25")).count() == 1
    e.rollback()
    assert e.search("wombat", SearchOptions(mode="bm25")).count() == 0 and rows(e.table("documents"), "path") == before
    e.sync()
    assert e.vacuum(keep=1) > 0 and len(e.log.numbers()) == 1 and e.search("wombat", SearchOptions(mode="hybrid", count=1)).first()["path"] == "python.md" and writes > 10


def test_search_reads_the_stored_index(spark, folder):
    e = Engine(spark, scratch(spark, "engine"))
    e.add_collection("notes", str(folder))
    e.sync()
    plan = e._bm25("rust borrowing", SearchOptions())._jdf.queryExecution().toString()
    assert "postings-" in plan or "hits" in plan
    assert "documents-" not in plan  # no text is read to score
    first = e.table("codec").first()
    e.ingest("notes", "long.md", "# Long\n\n" + "filler " * 900 + "platypus " + "filler " * 400)
    assert e.table("codec").first() == first  # the codec stays, new codes join
    hit = e.search("platypus", SearchOptions(mode="semantic", count=1)).first()
    assert hit["path"] == "long.md"
    for what in ("index", "embeddings"):
        e.rebuild(what)
        assert e.search("platypus", SearchOptions(mode="bm25", count=1)).first()["path"] == "long.md"
    with pytest.raises(ValueError):
        e.rebuild("nothing")
