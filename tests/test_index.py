import json
import os

import pytest
from pyspark.sql import functions as F

from vellum.operators import changes, chunks, events, search, sinks
from vellum.plans import index, registry
from vellum.sources import catalog, tree
from vellum.streaming import event_log, reindex

FILES = {
    "Welcome.md": "# Hi\n\ntext\n",
    "Inbox/SHOUTING.MD": "# Loud\n",
    "Inbox/bad.md": "---\ntitle: open\n# no end\n",
    "Inbox/dup.md": "---\na: 1\na: 2\n---\nx\n",
    "Projects/p.md": "---\ntitle: p\narchived: false\ntags: [project, go]\ncreated: 2026-09-01\n---\n# P\n```\n# code\n```\n## Q\ntail\n",
    "a/b.md": "",
    "a.md": "x",
    ".dot.md": "x",
    "_draft.md": "x",
    ".hid/n.md": "x",
    ".md": "only a suffix",
    "notes.txt": "x",
    "x/map.canvas": "{}",
    ".obsidian/app.md": "x",
    "deep/er/.obsidian/w.md": "x",
}


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    os.symlink(root / "Welcome.md", root / "link.md")
    os.symlink(root / "nowhere", root / "broken.md")
    os.symlink(root / "Projects", root / "folder.md")
    os.symlink(root / "Projects", root / "folder")
    return root


@pytest.fixture
def repo(vault):
    return catalog.Repo("v", "obsidian", str(vault))


@pytest.fixture
def found(spark, repo):
    result = index.index_directory(spark, repo, with_chunks=True)
    yield result
    result.close()


PREPARED = ["Welcome.md", "Inbox/SHOUTING.MD", "Inbox/bad.md", "Inbox/dup.md", "Projects/p.md", "a/b.md", "a.md", ".dot.md", "_draft.md", ".hid/n.md", ".md", "link.md"]


def test_documents(found, vault):
    rows = {r.rel_path: r for r in found.documents.drop("properties").collect()}
    assert set(rows) == set(PREPARED)
    r = rows["Projects/p.md"]
    stat = (vault / "Projects/p.md").stat()
    assert (r.app_type, r.extension, r.mime_type, r.name, r.size) == ("obsidian", ".md", "text/markdown; charset=utf-8", "p.md", stat.st_size)
    assert int(r.mod_time.timestamp() * 1e6) == pytest.approx(stat.st_mtime_ns // 1000, abs=2)
    assert json.loads(r.properties_json) == {"title": "p", "archived": False, "tags": ["project", "go"], "created": "2026-09-01T00:00:00Z"}
    assert r.path == str(vault / "Projects/p.md") and r.repo.name == "v" and r.uri is None and r.parse_error is None
    assert rows["Inbox/bad.md"].properties_json is None and rows["Inbox/bad.md"].parse_error == "unterminated front matter"
    assert "already defined" in rows["Inbox/dup.md"].parse_error
    assert rows["Inbox/SHOUTING.MD"].extension == ".md"
    assert found.documents.select(F.variant_get("properties", "$.created", "timestamp").cast("string").alias("t")).where("t is not null").first().t == "2026-09-01 00:00:00"


def test_stats(found):
    assert found.stats.first().asDict() == {"dirs_skipped": 2, "docs_skipped": 3, "docs_prepared": 12, "docs_failed": 2}


def test_events(found):
    rows = events.in_order(found.events).collect()
    ends = [(r.rel_path, r.kind) for r in rows if r.kind in ("file-indexed", "file-error", "file-skipped", "dir-skipped")]
    assert len(ends) == len(set(p for p, _ in ends)) == 12 + 2 + 3 + 2
    assert {p for p, k in ends if k == "file-error"} == {"broken.md", "folder.md"}
    assert [r.kind for r in rows if r.rel_path == "Projects/p.md"] == ["file-indexing", "file-parsing", "file-parsed", "file-indexed"]
    assert [r.kind for r in rows if r.rel_path == "Inbox/bad.md"] == ["file-indexing", "file-parsing", "file-indexed"]
    got = []
    events.deliver(found.events, lambda r: got.append(r.kind))
    assert set(got) == {"dir-skipped", "file-skipped"} and len(got) == 5


def test_chunks(found):
    rows = chunks.exploded(found.documents, "rel_path").where("rel_path = 'Projects/p.md'").orderBy("chunk_no").collect()
    assert [(r.heading_path, r.start_line, r.end_line) for r in rows] == [(["P"], 7, 10), (["P", "Q"], 11, 12)]
    assert rows[0].text == "# P\n```\n# code\n```"


def test_single_files(spark, repo, vault, tmp_path):
    (tmp_path / "out.md").write_text("x")
    result = index.index_files(spark, repo, [str(vault / ".obsidian/app.md"), str(tmp_path / "out.md"), str(vault / "notes.txt")])
    assert [r.rel_path for r in result.documents.collect()] == [".obsidian/app.md"]
    assert [r.error for r in result.events.where("kind = 'file-error'").collect()] == ["file not under repo path"]
    result.close()


def test_roots(spark, vault, tmp_path):
    os.symlink(vault, tmp_path / "way")
    assert [r.rel_path for r in tree.entries(spark, str(tmp_path / "way")).collect()] == ["."]
    (tmp_path / ".obsidian/sub").mkdir(parents=True)
    (tmp_path / ".obsidian/n.md").write_text("x")
    skip = registry.strategy("obsidian").skip_directories
    assert [r.rel_path for r in tree.entries(spark, str(tmp_path / ".obsidian"), skip).collect()] == ["n.md"]
    with pytest.raises(Exception):
        tree.entries(spark, str(tmp_path / "missing")).collect()


def test_document_json(found):
    row = json.loads(found.documents.where("rel_path = 'Projects/p.md'").select(sinks.document_json(found.documents).alias("j")).first().j)
    assert list(row) == [name for name, _ in sinks.DOCUMENT_FIELDS]
    assert row["properties"]["tags"] == ["project", "go"] and row["uri"] is None


def test_chunk_rules(spark):
    body = "\n\nlead\n# A\n####### not\n#no\n## B  \n```\n# x\n## y\n```\n# C\n### D\n"
    df = spark.createDataFrame([(body,), (None,), ("",), ("\n \n# H",)], "b string")
    out = [r.c for r in df.select(chunks.chunks(F.col("b"), F.lit(2)).alias("c")).collect()]
    assert [(c.heading_path, c.start_line, c.end_line) for c in out[0]] == [([], 3, 5), (["A"], 6, 8), (["A", "B"], 9, 13), (["C"], 14, 14), (["C", "D"], 15, 15)]
    assert out[1] is None and out[2] == [] and [c.start_line for c in out[3]] == [5]


def test_store_and_search(spark, found, tmp_path):
    cut = chunks.exploded(found.documents.withColumn("repo", F.col("repo.name")), "repo", "rel_path")
    vectors = cut.withColumn("vector", search.embed(chunks.embedding_input(F.col("heading_path"), F.col("text"))))
    path = str(tmp_path / "store")
    for _ in range(2):
        sinks.store_chunks(vectors, path)
    stored = spark.read.parquet(path).withColumn("id", F.xxhash64("rel_path", "chunk_no"))
    assert stored.count() == cut.count()
    best = search.top_k(stored, stored, k=1, key="id", vector="vector")
    assert best.count() == stored.count()


def test_changes_and_reindex(spark, repo, vault, tmp_path):
    snap = str(tmp_path / "snap")
    for _ in range(2):  # without a commit the same is found again
        run = reindex.reindex(spark, repo, snap)
        assert run.documents.count() == 12 and {r.change for r in run.changes.collect()} == {"added"}
    run.commit()
    (vault / "a.md").write_text("longer")
    (vault / "new.md").write_text("x")
    (vault / "_draft.md").unlink()
    run = reindex.reindex(spark, repo, snap)
    assert {r.path: r.change for r in run.changes.where("change <> 'same'").collect()} == {str(vault / "a.md"): "modified", str(vault / "new.md"): "added", str(vault / "_draft.md"): "removed"}
    assert {r.rel_path for r in run.documents.select("rel_path").collect()} == {"a.md", "new.md"}


def test_wide_directories_are_listed_in_shares(spark, tmp_path, monkeypatch):
    for k in range(60):
        (tmp_path / f"f{k}.md").write_text("x")
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}/in.md").write_text("x")
    (tmp_path / ".obsidian").mkdir()
    monkeypatch.setattr(tree, "WIDE", 20)
    reader = tree.TreeReader({"path": str(tmp_path), "skip": ".obsidian", "partitions": "5"})
    shares = reader.partitions()
    assert len(shares) == 5 and not any(s.settled for s in shares)
    rows = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(r["rel_path"] for r in rows) == sorted([f"f{k}.md" for k in range(60)] + [f"d{k}/in.md" for k in range(60)] + [".obsidian"])


def test_event_stream(spark, found, tmp_path):
    log = str(tmp_path / "log")
    event_log.append(found.events, log)
    got = []
    event_log.each(event_log.follow(spark, log), lambda r: got.append(r.kind), str(tmp_path / "cp")).awaitTermination(60)
    assert len(got) == found.events.count()
    query = event_log.counts(event_log.follow(spark, log)).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == len(got)


def test_changes_of_empty_listings(spark):
    none = spark.createDataFrame([], reindex.SNAPSHOT)
    assert changes.changes(none, none).count() == 0
