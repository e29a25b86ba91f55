"""The stages of the corpus pipeline against plain versions of them."""

import corpus_pipeline
import public_tokenizers

from lodestone.llm import decontamination, quality_rules

from . import test_pseudonyms_plain
from .test_brute_force import SF, brute_components
from .test_pseudonyms_plain import plain


def test_stages(spark, monkeypatch):
    monkeypatch.setattr(test_pseudonyms_plain, "KEY", corpus_pipeline.PII_KEY)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "private", "packed"]
    kept = {r.doc_id: r for r in docs.collect()}
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality_rules.ledger(docs).collect() if r.fail_bits == 0}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, rows, SF), "test")
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and len(got) == out.count()
        if name == "quality":
            assert set(got) == good and len(got) < len(kept)
        elif name == "near_duplicates":
            assert set(got) == {i for i, x in brute_components({i: r.text for i, r in kept.items()}, 5, 80).items() if x[2]} and len(got) < len(kept)
        elif name == "benchmark":
            lost = {i for i, r in kept.items() if any(x in decontamination.normal(r.text) for x in items)}
            assert lost and set(got) == set(kept) - lost
        else:
            assert set(got) == set(kept)
            for i, r in kept.items():
                new = plain(r.text)
                assert got[i].text == new and got[i].n_chars == len(new)
            assert any(got[i].text != r.text for i, r in kept.items())
        if name != "private":
            assert all(got[i] == kept[i] for i in got)
        kept, rows = got, out
    run = corpus_pipeline.run(spark, SF).collect()
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {(r.doc_id, r.doc_tokens) for r in run} == {(i, len(bpe.encode(r.text, add_special_tokens=False).ids) + 1) for i, r in kept.items()}
