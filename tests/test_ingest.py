"""Sources, snapshots, ingestion, engine, command line and stream, on folders of small files."""

import pytest

from lodestone import cli
from lodestone.config import PathsConfig, Settings
from lodestone.operators import store
from lodestone.operators.models import LexicalEmbedder
from lodestone.plans import ingest
from lodestone.plans.engine import Engine
from lodestone.sources import markdown
from lodestone.streaming.ingest import ingest_available


@pytest.fixture
def folder(tmp_path):
    kb = tmp_path / "kb"
    (kb / "sub").mkdir(parents=True)
    (kb / "a.md").write_text("---\ndomain: defines_list\nversion: 1.10\nconcept:\n---\n# T\n## Red apple\nsweet\n## Green pear\nsour")
    (kb / "sub" / "b.md").write_text("## Blue plum\nmild")
    (kb / "README.md").write_text("## no")
    (kb / "sub" / "ReadMe.md").write_text("## no")
    (kb / "notes.txt").write_text("## no")
    (kb / "00_overview.md").write_text("## Over\nview")
    (kb / "master_index.json").write_text('{"domains": {"one": {"path": "/"}, "two": {}}}')
    return kb


def test_sources(spark, folder):
    rows = {r.path: r for r in markdown.read_documents(spark, str(folder)).collect()}
    assert set(rows) == {f"{folder}/a.md", f"{folder}/sub/b.md", f"{folder}/00_overview.md"}
    a = rows[f"{folder}/a.md"]
    assert (a.domain, a.version, a.concept) == ("defines_list", "1.1", "None") and a.content.startswith("# T")
    assert {r.path for r in markdown.read_documents(spark, str(folder), recursive=False).collect()} == {f"{folder}/a.md", f"{folder}/00_overview.md"}
    assert markdown.read_document(spark, f"{folder}/a.md").count() == 1
    with pytest.raises(markdown.ChunkingError):
        markdown.read_document(spark, f"{folder}/none.md")
    (folder / "bad.md").write_text("---\n: [\n---\nx")
    with pytest.raises(Exception, match="Failed to parse front matter"):
        markdown.read_documents(spark, str(folder)).collect()
    with pytest.raises(Exception, match="Failed to parse front matter"):
        markdown.read_document(spark, f"{folder}/bad.md").collect()


def test_catalogue(spark, folder):
    assert sorted(map(tuple, markdown.list_domains(spark, str(folder)).collect())) == [("one", "/"), ("two", "")]
    assert markdown.domain_overview(spark, str(folder), "one") == "## Over\nview"
    assert markdown.domain_overview(spark, str(folder), "three") is None
    (folder / "master_index.json").write_text("{nope")
    with pytest.raises(ValueError, match="Failed"):
        markdown.list_domains(spark, str(folder))
    with pytest.raises(ValueError, match="not found"):
        markdown.list_domains(spark, str(folder / "sub"))


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "id string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "id string, content_hash string")
    assert dict(map(tuple, store.snapshot_diff(old, new).collect())) == {"a": "unchanged", "b": "updated", "c": "unchanged", "d": "deleted", "e": "created"}
    assert sorted(r.id for r in store.changed(old, new).collect()) == ["b", "e"]
    assert store.changed(old, new, force=True).count() == 4


def counters(s):
    return (s.documents_processed, s.chunks_created, s.chunks_updated, s.chunks_deleted)


def test_ingestion(spark, folder, tmp_path):
    kept = ingest.open_store(spark, str(tmp_path / "db"))
    run = lambda **k: counters(ingest.ingest_full(spark, kept, str(folder), LexicalEmbedder(8), **k))
    assert ingest.table_stats(kept).first()[0] == 0
    assert run() == (3, 4, 0, 0)
    assert run() == (3, 0, 0, 0) and kept.version == 1
    (folder / "sub" / "b.md").write_text("## Blue plum\nvery mild\n## New\none")
    assert run() == (3, 1, 1, 0)
    (folder / "00_overview.md").unlink()
    assert run() == (2, 0, 0, 1)
    assert {r.chunk_id for r in kept.read("indexed").collect()} == {r.id for r in kept.read("chunks").collect()} == {r.chunk_id for r in kept.read("colbert").collect()}
    assert run(force=True) == (2, 0, 4, 0)
    for f in ("a.md", "sub/b.md"):
        (folder / f).unlink()
    with pytest.raises(ingest.IngestionError):
        run()
    assert run(allow_empty=True) == (0, 0, 0, 4)
    assert kept.read("postings").count() == 0
    assert kept.clear() > 0 and kept.read("chunks").count() == 0


def test_engine_and_cli(spark, folder, tmp_path, capsys, monkeypatch):
    engine = Engine(spark, Settings(paths=PathsConfig(str(folder), str(tmp_path / "db"))), LexicalEmbedder(16))
    engine.ingest()
    assert engine.search_documentation("green pear", top_k=1).first()["chunk_id"].endswith("a.md#green-pear")
    assert engine.search_code_examples("plum", top_k=1).first()["chunk_id"].endswith("b.md#blue-plum")
    assert engine.search("apple", 2, use_colbert_rerank=True).count() == 2
    assert engine.lookup_define("apple", "red").first()["metadata"]["domain"] == "defines_list"
    assert engine.lookup_modifier("apple").count() > 0
    assert engine.diagnose_error("plum", "blue", 1).count() == 1
    section, siblings = engine.get_document_section(f"{folder}/a.md#red-apple", True)
    assert section.first()["text"] == "## Red apple\n\nsweet" and siblings.count() == 2
    assert engine.get_document_section("no")[0].count() == 0
    assert engine.list_domains().count() == 2 and engine.domain_overview("one").startswith("## Over")
    assert engine.score_pair("a b", "b c") == 0.5
    monkeypatch.setenv("KNOWLEDGE_BASE_PATH", str(folder))
    monkeypatch.setenv("VECTORDB_PATH", str(tmp_path / "db2"))
    assert cli.main(["validate"], spark) == 1
    assert cli.main(["ingest"], spark) == 0 and cli.main(["validate"], spark) == 0 and cli.main(["stats"], spark) == 0 and cli.main(["status"]) == 0
    assert "4 chunks" in capsys.readouterr().out


def test_settings(monkeypatch):
    monkeypatch.setenv("RETRIEVAL_TOP_K_DENSE", "7")
    monkeypatch.setenv("EMBEDDING_USE_FP16", "no")
    s = Settings.from_env()
    assert s.retrieval.top_k_dense == 7 and s.embedding.use_fp16 is False and s.retrieval.rrf_k == 60


def test_stream(spark, folder, tmp_path):
    kept = ingest.open_store(spark, str(tmp_path / "db"))
    go = lambda: ingest_available(spark, kept, str(folder), LexicalEmbedder(8), str(tmp_path / "ck")).awaitTermination()
    go()
    assert kept.read("chunks").count() == 4
    (folder / "c.md").write_text("## Late\nfile")
    go()
    assert kept.read("chunks").count() == 5


def test_stream_and_batch_name_chunks_alike(spark, folder, tmp_path):
    kept = ingest.open_store(spark, str(tmp_path / "db"))
    ingest.ingest_full(spark, kept, str(folder), LexicalEmbedder(8))
    before = {r.id for r in kept.read("chunks").collect()}
    (folder / "a.md").write_text("---\ndomain: defines_list\n---\n# T\n## Red apple\nsweet")  # one section less
    ingest_available(spark, kept, str(folder), LexicalEmbedder(8), str(tmp_path / "ck")).awaitTermination()
    after = {r.id for r in kept.read("chunks").collect()}
    assert after == before - {f"{folder}/a.md#green-pear"}
    assert {r.chunk_id for r in kept.read("indexed").collect()} == after
    (folder / "bad.md").write_text("---\n: [\n---\nx")
    with pytest.raises(Exception, match="front matter"):
        ingest_available(spark, kept, str(folder), LexicalEmbedder(8), str(tmp_path / "ck")).awaitTermination()


def test_an_index_has_one_version(spark, folder, tmp_path):
    kept = ingest.open_store(spark, str(tmp_path / "db"))
    ingest.ingest_full(spark, kept, str(folder), LexicalEmbedder(8))
    version, n = kept.version, kept.read("chunks").count()
    kept.clear()
    assert kept.read("chunks").count() == 0 and kept.read("chunks", version).count() == n


def test_tools_use_the_settings(spark, folder, tmp_path):
    from lodestone.config import RetrievalConfig

    engine = Engine(spark, Settings(paths=PathsConfig(str(folder), str(tmp_path / "db")), retrieval=RetrievalConfig(top_k_dense=1, top_k_sparse=0)), LexicalEmbedder(16))
    engine.ingest()
    assert engine.search_documentation("plum", top_k=5).count() == engine.search_code_examples("plum", top_k=5).count() == engine.diagnose_error("plum").count() == 1


def test_texts_and_vectors_are_staged_and_not_cached(spark, folder, tmp_path, monkeypatch):
    from lodestone.streaming import ingest as streaming

    seen = []

    def commit(opened, version, work, gone, files=None):
        seen.append((work.storageLevel.useMemory, work.columns, (tmp_path / name / "staged").exists()))
        return ingest_commit(opened, version, work, gone, files)

    ingest_commit = ingest.commit_changes
    monkeypatch.setattr(ingest, "commit_changes", commit)
    monkeypatch.setattr(streaming, "commit_changes", commit)
    embedder = LexicalEmbedder(8)
    runs = (lambda s: ingest.ingest_full(spark, s, str(folder), embedder), lambda s: ingest.ingest_folder(spark, s, str(folder), embedder), lambda s: ingest_available(spark, s, str(folder), embedder, str(tmp_path / "marks")).awaitTermination())
    found = []
    for i, run in enumerate(runs):
        name = f"store{i}"
        kept = ingest.open_store(spark, str(tmp_path / name))
        run(kept)
        assert not (tmp_path / name / "staged").exists()
        found.append([sorted(map(str, kept.read(t).drop("ingestion_timestamp").collect())) for t in ("chunks", "postings", "colbert")])
    assert [(cached, staged) for cached, _, staged in seen] == [(False, True)] * 3
    assert found[0] == found[1] == found[2] and all(found[0])


def test_unchanged_chunks_keep_their_texts_and_a_model_is_asked_once(spark, tmp_path):
    from lodestone.operators.models import ModelEmbedder

    told = str(tmp_path / "told")

    class Model:
        def encode(self, texts, **_):
            with open(told, "a") as out:
                out.writelines(f"{t!r}\n" for t in texts)
            return {"dense": [[1.0]] * len(texts), "sparse": [{"n": 1.0}] * len(texts), "colbert": [[[2.0]]] * len(texts)}

    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("## One\nfirst\n## Two\nsecond")
    kept = ingest.open_store(spark, str(tmp_path / "store"))
    assert ingest.ingest_full(spark, kept, str(tmp_path / "kb"), ModelEmbedder(Model)).chunks_created == 2
    (tmp_path / "kb" / "a.md").write_text("## One\nfirst\n## Two\nagain\n## Three\nthird")
    stats = ingest.ingest_full(spark, kept, str(tmp_path / "kb"), ModelEmbedder(Model))
    assert (stats.chunks_created, stats.chunks_updated, stats.chunks_deleted) == (1, 1, 0)
    assert sorted(r.text for r in kept.read("chunks").collect()) == ["## One\n\nfirst", "## Three\n\nthird", "## Two\n\nagain"]
    assert len(open(told).readlines()) == 4 and kept.read("colbert").count() == 3 and kept.read("postings").count() == 3


def test_words_are_found_once_for_postings(spark):
    from lodestone.operators.sparse import exploded

    texts = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "id string, text string")
    rows = exploded(LexicalEmbedder(8).attached(texts, "text"), "id")
    assert sorted(map(tuple, rows.collect())) == [("a", "one", 1.0), ("a", "two", 2.0)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1
