"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, lm_scoring, near_dedup, packing, periodic_runs, pii, quality_rules, secret_scan, sharding, token_counts, token_files

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [
    (1, "The cat sat on the mat. " * 30, "en", "a"), (1, "The cat sat on the mat. " * 30, "en", "a"), (2, None, None, None), (3, "", "en", ""), (None, "short", "en", "a"),
    (None, None, None, None), (4, "x" * 300_000, "en", "b"), (5, " \n\t\x0b\x0c\r ", "en", "b"), (6, "Ünïcödé \U0001f642 \x00 text " * 20, "de", "c"), (-7, "word " * 40_000, "en", "a"), (8, "\x85\xa0  ", "en", "a"),
]
CLASHES = ["n_tokens", "row", "key", "node", "label", "text_hash", "words", "hashes", "_row", "_at", "_key", "shard", "batch", "held", "new", "place", "d0", "c0", "part", "fail_bits", "hits", "runs", "collapsed", "w", "n", "a", "p", "h"]
#: Each operator as (function of a table, whether it returns a row for each row).
OPERATORS = {
    "lm": (lambda d: lm_scoring.score(d, F.expr("doc_id % 2 = 0")), True),
    "secrets": (secret_scan.scan_secrets, True),
    "shards": (lambda d: sharding.hilbert_shards(d, {"source": F.col("source"), "lang": F.col("lang"), "size": F.octet_length("text")}, carry={"n": F.length("text")}), True),
    "leaks": (lambda d: decontamination.contaminated(d, d.selectExpr("doc_id AS item_id", "text")), False),
    "clean": (lambda d: decontamination.decontaminate(d, d.where("doc_id = 1").selectExpr("doc_id AS item_id", "text")), False),
    "near": (near_dedup.near_duplicates, True),
    "deduplicated": (near_dedup.deduplicated, False),
    "counts": (lambda d: token_counts.count_tokens(d, PIECES), True),
    "rules": (quality_rules.ledger, True),
    "kept": (lambda d: quality_rules.kept_rows(d, "base-1"), False),
    "pack": (lambda d: packing.pack(d, BPE), False),
    "files": (lambda d: token_files.read_token_files(token_files.write_token_files(d, BPE)), True),
    "runs": (periodic_runs.periodic_runs, True),
    "pii": (lambda d: pii.pseudonymise(d, "k"), True),
    "pii_rows": (lambda d: pii.pseudonymised_rows(d, "k"), True),
}


@pytest.fixture(scope="module")
def tricky(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_tricky_and_empty_tables(spark, tricky, name):
    run, each = OPERATORS[name]
    got = run(tricky).collect()
    if each:
        assert len(got) == len(ROWS)
        key = lambda x: (x is None, x)
        assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)
    assert run(tricky.where("false")).count() == 0


def test_columns_stay(tricky):
    for name in ("clean", "deduplicated", "kept", "pii_rows"):
        assert OPERATORS[name][0](tricky).columns == tricky.columns


def test_dedup_keeps_one_of_each(tricky):
    ids = [r.doc_id for r in near_dedup.deduplicated(tricky).select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, None, None, 4, 5, 6, -7, 8]))


def test_texts_without_words(tricky):
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(tricky).collect()}
    assert near[3, 0] == (3, True) and near[5, 0] == (5, True) and near[2, 0] == (2, True)
    rules = {r.doc_id: r for r in quality_rules.ledger(tricky).collect()}
    assert rules[2].n_words == rules[5].n_words == 0 and rules[-7].n_repeat_words == rules[-7].n_words == 40_000
    leaks = {(r.doc_id, r.item_id) for r in OPERATORS["leaks"][0](tricky).collect()}
    assert (1, 1) in leaks and not any(3 in x or 5 in x for x in leaks)
