"""Ingestion of a folder by what changed in it."""

import os

import pytest

from lodestone.operators.models import LexicalEmbedder
from lodestone.plans import ingest

EMBEDDER = LexicalEmbedder(8)


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "kb"
    (root / "sub").mkdir(parents=True)
    for i in range(6):
        (root / ("sub" if i % 2 else "") / f"f{i}.md").write_text(f"---\ndomain: d{i}\n---\n## One\ntext {i}\n## Two\nmore {i}")
    (root / "README.md").write_text("## skipped")
    return root


def chunks(store):
    return sorted((r.id, r.content_hash) for r in store.read("chunks").collect())


def same_as_whole(spark, store, folder, tmp_path_factory):
    """The store as an ingestion of the whole folder into a new one would leave it."""
    other = ingest.open_store(spark, str(tmp_path_factory.mktemp("whole")))
    ingest.ingest_full(spark, other, str(folder), EMBEDDER)
    assert chunks(store) == chunks(other)
    for name, key in (("postings", "chunk_id"), ("indexed", "chunk_id"), ("colbert", "chunk_id")):
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, other.read(name).collect()))


def hide(path, text):
    """Another content of the same length and time: who reads it fails, or has other chunks."""
    before = path.stat()
    path.write_text(text.ljust(before.st_size)[: before.st_size])
    os.utime(path, ns=(before.st_atime_ns, before.st_mtime_ns))


def test_only_changed_files_are_opened(spark, folder, tmp_path, tmp_path_factory):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    run = lambda: ingest.ingest_folder(spark, store, str(folder), EMBEDDER)
    assert run() == ingest.FolderStats(6, 6, 0, 12, 0, 0)
    same_as_whole(spark, store, folder, tmp_path_factory)
    version, before = store.version, chunks(store)

    # A file that can't be parsed, under the old time and length: a run that opened it would fail.
    text = (folder / "f0.md").read_text()
    hide(folder / "f0.md", "---\n: [\n---\n")
    assert run() == ingest.FolderStats(6, 0, 0, 0, 0, 0) and store.version == version and chunks(store) == before

    # One new, one rewritten, one of fewer sections, one gone; the broken one is still closed.
    (folder / "new.md").write_text("## New\nn")
    (folder / "f2.md").write_text("## One\nrewritten\n## Two\nmore 2")
    (folder / "sub" / "f3.md").write_text("---\ndomain: d3\n---\n## One\ntext 3\n")
    (folder / "sub" / "f5.md").unlink()
    for name in ("new.md", "f2.md", "sub/f3.md"):
        os.utime(folder / name, (4_000_000_000, 4_000_000_000))
    stats = run()
    assert stats == ingest.FolderStats(6, 3, 1, 1, 1, 3)
    hide(folder / "f0.md", text)
    same_as_whole(spark, store, folder, tmp_path_factory)

    # A file that comes with an old time is seen as well.
    (folder / "old.md").write_text("## Old\no")
    os.utime(folder / "old.md", (1_000_000, 1_000_000))
    assert run() == ingest.FolderStats(7, 1, 0, 1, 0, 0)
    same_as_whole(spark, store, folder, tmp_path_factory)


def test_an_empty_folder_is_refused(spark, folder, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    ingest.ingest_folder(spark, store, str(folder), EMBEDDER)
    for path in folder.rglob("*.md"):
        path.unlink()
    with pytest.raises(ingest.IngestionError):
        ingest.ingest_folder(spark, store, str(folder), EMBEDDER)
    assert len(chunks(store)) == 12
    assert ingest.ingest_folder(spark, store, str(folder), EMBEDDER, allow_empty=True) == ingest.FolderStats(0, 0, 6, 0, 0, 12)
    assert chunks(store) == []


def test_a_bad_header_changes_nothing(spark, folder, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    ingest.ingest_folder(spark, store, str(folder), EMBEDDER)
    before, version = chunks(store), store.version
    (folder / "bad.md").write_text("---\n: [\n---\n")
    with pytest.raises(Exception, match="front matter"):
        ingest.ingest_folder(spark, store, str(folder), EMBEDDER)
    assert chunks(store) == before and store.version == version


def test_small_files_share_tasks_and_the_setting_is_restored(spark, tmp_path):
    from lodestone.sources import markdown

    for i in range(200):
        (tmp_path / f"{i}.md").write_text("## a\nb")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with markdown.small_files(spark):
        assert markdown.markdown_files(spark, str(tmp_path)).rdd.getNumPartitions() <= 4
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_a_folder_of_small_files_is_read_by_few_tasks(spark, tmp_path, monkeypatch):
    from lodestone.sources import markdown

    for i in range(200):
        header = f"domain: d{i % 3}\nversion: 1.{i % 2}0" if i % 4 else f"domain: {'x' * 5000}{i % 8}"
        (tmp_path / f"{i}.md").write_text(f"---\n{header}\n---\n## a{i}\nb")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    read = markdown.read_documents(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 4
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    want = [(f"{tmp_path}/{i}.md", f"## a{i}\nb", *((f"d{i % 3}", f"1.{i % 2}") if i % 4 else ("x" * 5000 + str(i % 8), ""))) for i in range(200)]
    for kept in (1024, 1):
        monkeypatch.setattr(markdown, "HEADERS", kept)
        read = markdown.read_documents(spark, str(tmp_path))
        assert sorted((r.path, r.content, r.domain, r.version) for r in read.collect()) == sorted(want)
    # Files that are large beside the cost of opening one are dealt as ever.
    (tmp_path / "large").mkdir()
    for i in range(4):
        (tmp_path / "large" / f"{i}.md").write_text("x" * 300_000)
    assert markdown.read_documents(spark, str(tmp_path / "large")).rdd.getNumPartitions() == 4
    (tmp_path / "empty").mkdir()
    assert markdown.read_documents(spark, str(tmp_path / "empty")).collect() == []


def test_white_space_at_a_texts_end_and_null_texts_match_the_sql(spark, tmp_path):
    import duckdb

    from lodestone.plans import queries

    texts = ["plain", "ends with a line\n", "", None, " ", "two ends\n\n", "a\n# ", "a\n##", "a\nb\nc\nd\n"]
    rows = [(10 * i + j, text, lang, "src0") for i, text in enumerate(texts) for j, lang in enumerate(("en", "de", "fr", "es"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("folder_chunks", "folder_stats"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.sql(queries.ORACLES[name]).fetchall())


def test_all_ingestions_of_files_keep_a_heading_at_the_end(spark, tmp_path):
    from lodestone.streaming.ingest import ingest_available

    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("---\ndomain: d\n---\n\n# One\ntext\n## ")
    (tmp_path / "kb" / "b.md").write_text("\n# Two\ntext\n## \n")
    found = []
    for run in (lambda s: ingest.ingest_folder(spark, s, f"{tmp_path}/kb", EMBEDDER), lambda s: ingest.ingest_full(spark, s, f"{tmp_path}/kb", EMBEDDER), lambda s: ingest_available(spark, s, f"{tmp_path}/kb", EMBEDDER, f"{tmp_path}/marks").awaitTermination()):
        store = ingest.open_store(spark, f"{tmp_path}/store{len(found)}")
        run(store)
        found.append(sorted((r.id, r.text) for r in store.read("chunks").collect()))
    assert found[0] == [(f"{tmp_path}/kb/a.md#", "##"), (f"{tmp_path}/kb/b.md#", "##")] and found[1] == found[0] and found[2] == found[0]


def test_tasks_list_a_folder_as_sparks_reader_does(spark, tmp_path):
    from lodestone.sources import markdown

    for name in ("a.md", "README.md", "x.MD", "n.txt", ".h.md", "_s.md", "_k=1.md", "é ü%20.md", "sub/b.md", "sub/deep/er/c.md", "sub/ReadMe.md", ".git/d.md", "_tmp/e.md", "f.md/g.md", "sub/_x/h.md", "y=1/i.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"---\ndomain: {len(name)}\n---\n## {name}\ntext\n")
    (tmp_path / "empty").mkdir()
    for folder in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}", f"file:{tmp_path}/sub"):
        root = markdown.local_root(spark, folder)
        listed = markdown.list_local(spark, folder, root)
        want = markdown.list_markdown(spark, folder)
        assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, want.collect())) and listed.count() > 1
        since = listed.agg({"modification_time": "min"}).first()[0]
        read = [sorted(map(tuple, df.collect())) for df in (markdown.read_local(spark, folder, root, listed), markdown.read_listed(spark, folder, want, since))]
        assert read[0] == read[1]
    assert markdown.list_local(spark, f"{tmp_path}/empty", f"{tmp_path}/empty").collect() == []
    assert markdown.local_root(spark, f"{tmp_path}/none") is None and markdown.local_root(spark, f"{tmp_path}/a.md") is None


def test_the_driver_lists_no_local_file(spark, folder, tmp_path, monkeypatch):
    def listing(*_):
        raise AssertionError("listed by the driver")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "markdown_files", listing)
        store = ingest.open_store(spark, str(tmp_path / "store"))
        assert ingest.ingest_folder(spark, store, str(folder), EMBEDDER) == ingest.FolderStats(6, 6, 0, 12, 0, 0)
    # Another store's folder is listed by Spark's reader, and told to be unchanged.
    monkeypatch.setattr(ingest, "local_root", lambda *_: None)
    assert ingest.ingest_folder(spark, store, str(folder), EMBEDDER) == ingest.FolderStats(6, 0, 0, 0, 0, 0)
    (folder / "sub" / "f5.md").unlink()
    (folder / "f0.md").write_text("## Other\nand longer than it was before")
    assert ingest.ingest_folder(spark, store, str(folder), EMBEDDER) == ingest.FolderStats(5, 1, 1, 1, 0, 4)
