"""Very long runs of one character through the operators that make token ids, against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import packing, token_files
from lodestone.llm.tokens import LONG, byte_bpe

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


RUNS = [
    "a" + " " * 1_000_000 + "b", "\n" * 1_000_000 + "x", "x" * 1_000_000, " " * 3_000_000, "y" + "\n" * 3_000_000 + " z", "x" * 3_000_000,
]
SHORTER = [
    "a" + " \n" * LONG + "<|endoftext|>b", " " * LONG + "<|endoftext|>" + "\t" * 9000, "z" + "\x85" * LONG + "y", " " * (LONG - 1) + "'s", "\n" * LONG + " a" + "　" * LONG + "é", "\x1c" * LONG + "a", " " * LONG,
]


@pytest.mark.parametrize("i", range(len(RUNS) + len(SHORTER)))
def test_ids(library, i):
    text = [*RUNS, *SHORTER][i]
    assert byte_bpe(BPE).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_operators(spark, library):
    table = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string").repartition(3)
    whole = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in RUNS]
    files = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(table, BPE)).collect()}
    start = 0
    for i, ids in enumerate(whole):
        ended = np.append(ids, np.uint32(0))
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ended), zlib.crc32(ended.tobytes()))
        start += len(ended)
    pieces = packing.pack(table, BPE).select("doc_id", "start", "length", "ids_crc32").collect()
    for i, ids in enumerate(whole):
        ended = np.append(ids, np.uint32(1))
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ended)
        assert all(p.ids_crc32 == zlib.crc32(ended[p.start : p.start + p.length].tobytes()) for p in mine)


def test_one_id_does_not_fill_a_part(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text {i % 50}") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as parts of a large table
    try:
        check_one_id(spark, tmp_path, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_one_id(spark, tmp_path, rows):
    images = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), BPE, image_ids=500)
    got = token_files.read_token_files(images).collect()
    assert len(got) == 3000 and sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == 3000
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None] * 2000 + [i for i in range(3000) if i % 3 == 0]
    assert sum(1 for _ in images.where("n_ids > 0").select("part").distinct().collect()) >= 3
    token_files.export_token_files(images, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == images.count()
    assert sum(token_files.Image(f.read_bytes()).n for f in files) == sum(r.n_tokens for r in got)
