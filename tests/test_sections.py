"""Lines, code blocks, sections of many ids, JSON maps, catalogues, and settings that reach models."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.config import EmbeddingConfig, RerankerConfig, Settings
from lodestone.functions import text as fn
from lodestone.operators import chunker, models
from lodestone.plans import retrieval
from lodestone.plans.engine import Engine
from lodestone.sources import markdown


def docs(spark, texts):
    rows = [(f"d{i}.md", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, content string").select("*", *[F.lit("x").alias(c) for c in ("domain", "concept", "version")])


def test_lines_as_python_splits_them(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\r\n", "a\x0bb\x0cc\x1cd\x85e f ", "\r\n\n\r", " \n ", None]
    got = {}
    for r in chunker.lines(docs(spark, texts)).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.line)
    assert got == {f"d{i}.md": t.splitlines() for i, t in enumerate(texts) if t}


def test_white_space_is_stripped_in_linear_time(spark):
    space = " \t　\x1c" * 250_000
    texts = {0: f"a{space}b", 1: f"{space}a b{space}", 2: space, 3: ""}
    df = spark.createDataFrame(list(texts.items()), "i long, text string")
    start = time.perf_counter()
    got = {r.i: (r.s, r.a) for r in df.select("i", fn.stripped(F.col("text")).alias("s"), fn.anchor(F.col("text")).alias("a")).collect()}
    assert {i: s for i, (s, _) in got.items()} == {i: t.strip() for i, t in texts.items()}
    assert [got[i][1] for i in texts] == ["a-b", "a-b", "", ""]
    inside = " \t\u3000" * 350_000
    (chunk,) = chunker.chunk_documents(docs(spark, [f"## x{inside}y\nbody{inside}y{inside}\n"])).collect()
    assert len(chunk.text) > 2_000_000 and chunk.section_anchor == "x-y"
    assert time.perf_counter() - start < 30


def test_code_blocks(spark):
    texts = ["a\n```py title\nx = 1\n# no heading\n```\n## h\n  ```\n\n```\n```sql\nopen", "```\n```", "none", "````C++ \na\n````\n\n# t\n``` `q`\n```", None, ""]
    got = sorted(tuple(r) for r in chunker.code_blocks(docs(spark, texts)).collect())
    assert got == [
        ("d0.md", -1, 1, "py", "```py title\nx = 1\n# no heading\n```"),
        ("d0.md", 5, 2, "", "  ```\n\n```"),
        ("d1.md", -1, 1, "", "```\n```"),
        ("d3.md", -1, 1, "C++", "````C++ \na\n````"),
        ("d3.md", 4, 2, "", "``` `q`\n```"),
    ]


def test_sections_of_many_ids(spark, tmp_path):
    rows = [(f"f{i // 4}#{i}", f"f{i // 4}" if i else None, f"t{i}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, file_path string, text string")
    asked = spark.createDataFrame([("f1#5",), ("f1#5",), ("f9#39",), ("f0#0",), ("nowhere",), (None,)], "id string")
    assert sorted(r.id for r in retrieval.get_sections(chunks.unionByName(chunks.where("id = 'f1#5'")), asked, "id").collect()) == ["f0#0", "f1#5", "f9#39"]
    got = sorted((r.asked_id, r.id) for r in retrieval.sections_with_context(chunks, asked, "id").collect())
    assert got == sorted([("f1#5", f"f1#{i}") for i in range(4, 8)] + [("f9#39", f"f9#{i}") for i in range(36, 40)])
    assert retrieval.get_sections(chunks, asked.where("false"), "id").count() == 0


def test_json_entries(spark):
    texts = ['{"a": 1, "b": {"c": [2]}}', "{}", None, "", "[1]", '"x"', '{"a": ', '{"n": null, "": "é"}', "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, props string").withColumn("key", F.lit("clash"))
    entries, broken = markdown.json_entries(df, "props", ["i"])
    assert sorted(((r.i, r.key, r.value) for r in entries.collect()), key=str) == sorted([(0, "a", "1"), (0, "b", '{"c":[2]}'), (7, "n", None), (7, "", "é")], key=str)
    assert {r.i for r in broken.collect()} == {i for i, t in enumerate(texts) if t is not None and not isinstance(parsed(t), dict)}


def parsed(text):
    try:
        return json.loads(text)
    except ValueError:
        return None


def test_catalogue_of_a_table_and_empty_domains(spark, tmp_path):
    domains = spark.createDataFrame([("b", "/b/"), ("a", "x/a"), ("b", "/b/"), (None, "/n/")], "name string, path string")
    (row,) = markdown.catalogue_of(domains).collect()
    assert json.loads(row.json) == {"domains": {"a": {"path": "x/a"}, "b": {"path": "/b/"}}}
    assert sorted(map(tuple, markdown.catalogue_rows(markdown.catalogue_of(domains)).collect())) == [("a", "x/a"), ("b", "/b/")]
    (tmp_path / "master_index.json").write_text('{"domains": {"empty": {}, "root": {"path": ""}, "told": {"note": "n"}, "a": {"path": "/x/a/"}}}')
    (tmp_path / "00_overview.md").write_text("root")
    (tmp_path / "x" / "a").mkdir(parents=True)
    (tmp_path / "x" / "a" / "00_overview.md").write_text("of a")
    said = {n: markdown.domain_overview(spark, str(tmp_path), n) for n in ("empty", "root", "told", "a", "none")}
    assert said == {"empty": None, "root": "root", "told": "root", "a": "of a", "none": None}


class Model:
    def __init__(self, config):
        self.config = config

    def encode(self, texts, batch_size, max_length, **_):
        assert batch_size == len(texts) <= self.config.batch_size
        return {"dense_vecs": [[float(max_length), float(self.config.use_fp16), float(len(self.config.model_name))] for _ in texts]}

    def compute_score(self, pairs, normalize):
        return [float(len(self.config.model_name)) for _ in pairs]


def test_settings_reach_models(spark, monkeypatch, tmp_path):
    texts = spark.createDataFrame([(i, "a b") for i in range(7)], "id long, text string")
    assert len(models.embedder_of(EmbeddingConfig(dimension=12)).embed(texts, "id", "text").first().dense) == 12
    config = EmbeddingConfig(model_name="big", use_fp16=False, max_length=77, batch_size=3)
    got = models.embedder_of(config, Model).embed(texts, "id", "text").collect()
    assert len(got) == 7 and all(r.dense == [77.0, 0.0, 3.0] for r in got)
    pairs = spark.createDataFrame([(1, "q", "c", "t")], "qid long, query string, chunk_id string, text string")
    assert models.scorer_of(RerankerConfig(model_name="name"), Model).score(pairs).first().rerank_score == 4.0
    for name, value in {"EMBEDDING_DIMENSION": "20", "VECTORDB_PATH": str(tmp_path / "db")}.items():
        monkeypatch.setenv(name, value)
    engine = Engine(spark, Settings.from_env())
    assert isinstance(engine.embedder, models.LexicalEmbedder) and engine.embedder.dimension == 20
    monkeypatch.setenv("EMBEDDING_MODEL_NAME", "some/model")
    assert isinstance(Engine(spark, Settings.from_env()).embedder, models.ModelEmbedder)


def test_a_missing_model_library_is_told(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="FlagEmbedding"):
        models.embedder_of(EmbeddingConfig(model_name="some/model")).embed(texts, "id", "text").collect()
