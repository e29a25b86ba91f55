"""Each operator against a plain version of it, on the small tables."""

import base64
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontamination, lm_scoring, near_dedup, packing, pii, quality_rules, queries, secret_scan, sharding, token_counts, token_files
from lodestone.llm.ngram_trie import EliasFano, Trie, code, mapped
from lodestone.llm.tokens import byte_bpe

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=" \n\tab.é▁c中🙂<s>|ﬁ'0\x00\x85", max_size=60)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 1: language model


@pytest.mark.parametrize(("order", "small"), [(2, False), (3, True)])
def test_lm(spark, docs, order, small, monkeypatch):
    if small:  # several batches and shards, some words hot
        monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 3000)
        monkeypatch.setattr(lm_scoring, "SHARD_NODES", 2000)
    held = F.expr("crc32(CAST(CAST(doc_id AS string) AS binary)) % 7 = 2")
    got = {r.doc_id: r for r in lm_scoring.score(spark.read.parquet(f"{SF}/documents.parquet"), held, order).collect()}
    texts = {i: ([b"<S>", *t.encode().lower().split(), b"</s>"], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in docs.items()}
    count = Counter()
    for t, out in texts.values():
        if not out:
            count[t[0],] += 1
            count.update(tuple(t[i - k : i + 1]) for i in range(1, len(t)) for k in range(order) if k <= i)
    n = sum(len(t) - 1 for t, out in texts.values() if not out)
    total = n + sum(len(g) == 1 for g in count)  # N + V + 1: the start mark stands for the one

    def p(t, i):
        out = (count[t[i],] + 1) / total
        for k in range(1, min(order, i + 1)):
            c = count[tuple(t[i - k : i])]
            out = (count[tuple(t[i - k : i + 1])] + 20 * out) / (c + 20)
        return out

    gain = 0.0
    for i, (t, out) in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (out, len(t) - 1, n, sum(count[w,] > 0 for w in t[1:]))
        assert r.base_score == pytest.approx(sum(math.log10((count[w,] + 1) / total) for w in t[1:]), rel=1e-12)
        assert r.score == pytest.approx(sum(math.log10(p(t, j)) for j in range(1, len(t))), abs=1e-3 * len(t))
        gain += (r.score - r.base_score) * out
    assert gain > 0  # held-out texts are likelier than by words alone


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = np.cumsum(np.array(values, dtype=np.int64))
    assert (EliasFano(*EliasFano.parts(values)).get(np.arange(len(values))) == values).all()


def test_trie_search():
    rng = np.random.default_rng(1)
    roots = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    kids = [np.unique(rng.integers(0, 1 << 48, rng.integers(0, 40), dtype=np.uint64)) for _ in roots]
    first = np.concatenate([[0], np.cumsum([len(k) for k in kids])])
    zero = lambda n: code(np.zeros(n))
    trie = mapped(Trie.packed([(roots, zero(len(roots)), zero(len(roots)), first), (np.concatenate(kids), zero(first[-1]), zero(first[-1]), None)]))
    assert isinstance(trie, Trie) and (trie.roots(roots) == np.arange(len(roots))).all() and (trie.roots(roots + np.uint64(1)) == -1).all()
    for i, have in enumerate(kids):
        parents = np.full(len(have), i)
        assert (trie.children(1, parents, have) == first[i] + np.arange(len(have))).all()
        missing = have + np.uint64(1)
        assert (trie.children(1, parents, missing)[~np.isin(missing, have)] == -1).all()


# 2: secrets


def plain_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets_of_the_table(spark, docs):
    for r in queries.op2(spark, SF).collect():
        want = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) if want else True
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


@given(st.text(alphabet="tokensecrTOKAI=: '\"_ſK0123456789abcdef\nAKIA", max_size=120))
@settings(max_examples=200, deadline=None)
def test_secrets_in_the_clear(text):
    assert [f"{k}:{a}:{b}" for k, a, b, via, _ in secret_scan.scan(text)[0] if not via] == plain_spans(text)


SECRET = "password=hunter2xyz"
B64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize(
    ("wrapped", "via"),
    [
        ("".join(f"%{b:02x}" for b in SECRET.encode()), "url"),
        (urllib.parse.quote("".join(f"%{b:02X}" for b in SECRET.encode())), "url>url"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode"),
        (B64(SECRET.encode()), "base64"),
        (B64(B64(SECRET.encode()).encode()), "base64>base64"),
        (B64(gzip.compress(SECRET.encode(), mtime=0)), "base64>gzip"),
        (B64(zlib.compress(SECRET.encode())), "base64>zlib"),
        (B64("".join(f"%{b:02x}" for b in SECRET.encode()).encode()), "base64>url"),
    ],
)
def test_wrapped_secrets(wrapped, via):
    found, layers = secret_scan.scan(f"see é {wrapped} there")
    assert ("assign", SECRET, via) in [(k, s, v) for k, _, _, v, s in found] and layers > 1
    for kind, a, b, v, _ in found:
        assert 6 <= a < b <= 6 + len(wrapped)


def test_half_wrapped_and_endless_layers():
    assert [f[:4] for f in secret_scan.scan("secret%3Dabc%64efgh x")[0]] == [("assign", 0, 19, "url")]
    assert secret_scan.scan("%25" * 50 + "41")[0] == []
    text = "AKIA" + "A" * 16
    for _ in range(12):
        text = B64(text.encode())
    assert [f[0] for f in secret_scan.scan(text)[0]] == ["access"]


# 3: sharding


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(n, bits):
    points = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij")])
    place = sharding.hilbert_index(list(points), bits)
    order = np.argsort(place)
    assert sorted(place.tolist()) == list(range(2 ** (bits * n)))
    assert (np.abs(np.diff(points[:, order], axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, docs, tmp_path):
    rows = queries.op3(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows"
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(24))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.place for r in order] == sorted(r.place for r in rows)
    sharding.write_shards(queries.op3(spark, SF).drop("grown_shard"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


# 4: decontamination


def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@given(st.text(alphabet="abc ", min_size=1, max_size=80), st.text(alphabet="abc ", max_size=120))
@settings(max_examples=150, deadline=None)
def test_myers(item, text):
    assert decontamination.Pattern(item).best(text)[0] == nearest(item, text)


def test_pigeonhole_misses_nothing():
    rng = random.Random(2)
    items = tuple((i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 150))).strip() or "a") for i in range(25))
    finder = decontamination.Finder(items, 0.1)
    for _ in range(60):
        _, item = rng.choice(items)
        chars = list(item)
        for _ in range(rng.randrange(0, 14)):
            k = rng.randrange(len(chars) + 1)
            chars[k : k + rng.randrange(2)] = rng.choice(["", "z", "a"])
        text = decontamination.normal("".join(rng.choice("abcdefgh ") for _ in range(80)) + "".join(chars) + "zz")
        want = {(i, d) for i, x in items if (d := nearest(x, text)) <= decontamination.budget(len(x), 0.1)}
        assert {(i, d) for i, d, *_ in finder.find(text)} == want


def test_contaminated_table(spark, docs):
    items = {r.item_id: decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = queries.op4(spark, SF).collect()
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in decontamination.normal(t)}
    assert whole and whole == {(r.doc_id, r.item_id) for r in found if r.distance == 0}
    for r in found:
        assert r.distance <= r.error_budget
        words = docs[r.doc_id].lower().split()[r.first_word : r.last_word + 1]
        assert nearest(items[r.item_id], " ".join(words)) == r.distance
    table = spark.read.parquet(f"{SF}/documents.parquet")
    left = decontamination.decontaminate(table, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in left.collect()} == set(docs) - {r.doc_id for r in found}


# 5: near-duplicates


def brute_components(texts, width, percent):
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, width, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # buckets of several blocks
    rng = random.Random(width)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    texts = dict(docs)
    texts |= {10_000 + i: edited(rng, base, rng.randrange(8)) for i in range(120)}  # around the threshold
    texts |= {20_000 + i: "the very same short text" for i in range(50)}
    texts |= {30_000 + i: f"own{i} " + " ".join(base[:60]) + " " + " ".join(f"o{i}x{j}" for j in range(150)) for i in range(40)}  # one passage
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    spec = near_dedup.Spec(width, percent)
    want = brute_components(texts, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, spec).collect()} == want
    kept = [r.doc_id for r in near_dedup.deduplicated(table, spec).collect()]
    assert sorted(kept) == sorted(i for i, x in want.items() if x[2])


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for same in (0.5, 0.8, 0.95):
        k = int(2000 * same)
        a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[:k], pool[2000 : 4000 - k]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        d = near_dedup.packed(near_dedup.minima(a)) ^ near_dedup.packed(near_dedup.minima(b))
        agree = 1 - np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum() / near_dedup.MINIMA
        assert abs((agree - 0.25) / 0.75 - j) < 0.2


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


# 6: token counts


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_of_the_table(spark, docs, pieces):
    for r in queries.op6(spark, SF).collect():
        n = len(pieces.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_counts_of_odd_texts(pieces):
    counter = token_counts.piece_counter(PIECES)

    @given(ODD)
    @settings(max_examples=400, deadline=None)
    def check(text):
        assert counter.count(text) == len(pieces.encode(text))

    check()


# 7: quality rules


def test_rules_of_odd_texts(spark):
    rng = random.Random(7)
    texts = ["", None, "a b c a b c", "a a a a", "x\nx\n \nx", "A" * 60, "#$% " * 60, "é\x0bß\x0cç"]
    texts += ["".join(rng.choice("ab \n\tA#|é") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40, 120))) for _ in range(100)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = quality_rules.ledger(table)
    got = {r.doc_id: r.asDict() for r in ledger.collect()}
    import pandas as pd

    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "fail_bits")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    for row in con.sql(queries.OP7_SQL).df().to_dict("records"):
        mine = got[row["doc_id"]]
        measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "fail_bits")
        assert {c: mine[c] for c in measured} == {c: row[c] for c in measured}, texts[row["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[row["doc_id"]] or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert mine["n_repeat_words"] == len(inside)
    bits = [r["fail_bits"] for r in got.values()]
    for r in quality_rules.ablations(ledger, "web-1").collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.n_failed, r.n_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert {r.doc_id for r in quality_rules.kept_rows(table, "web-1").collect()} == {i for i, r in got.items() if not r["fail_bits"]}


# 8 and 9: ids, packing, files


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_ids_are_those_of_the_tokenizers_library(docs, bpe):
    odd = ["a<|endoftext|>b", "<|endoftext|>", "don't  \n x'LL", "\x85  a", " lead", "trail  ", "１２3 ½", "  x"]

    @given(ODD)
    @settings(max_examples=300, deadline=None)
    def check(text):
        assert byte_bpe(BPE).ids(text).tolist() == bpe.encode(text, add_special_tokens=False).ids

    check()
    for text in [*odd, *docs.values()]:
        assert byte_bpe(BPE).ids(text).tolist() == bpe.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, bpe, tmp_path):
    rows = defaultdict(list)
    for r in packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), BPE).collect():
        rows[r.doc_id].append(r)
    assert set(rows) == set(docs)
    assert len({r.sequence_id for x in rows.values() for r in x}) == sum(map(len, rows.values()))
    for doc, found in rows.items():
        ids = np.array([*bpe.encode(docs[doc], add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length == 1 << r.bucket <= 2048 and r.offset == 0 and r.doc_tokens == len(ids)
            assert bytes(r.ids) == ids[at : at + r.length].tobytes() and r.ids_crc32 == zlib.crc32(bytes(r.ids))
            at += r.length
        assert at == len(ids)
        assert sum(r.length < 2048 for r in found) == (len(ids) % 2048).bit_count()
    packing.write_buckets(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), BPE), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {f"bucket={r.bucket}" for x in rows.values() for r in x}


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=400))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    image = token_files.Image(token_files.encode_image(np.array([5]), np.array([True]), np.array([len(ids)]), ids))
    assert (image.ids() == ids).all()


def test_simple8b_blocks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 239, 240, 241, token_files.BLOCK - 1, token_files.BLOCK, token_files.BLOCK + 1):
        for top in (1, 2, 700, 50_257, 1 << 61):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            image = token_files.Image(token_files.encode_image(np.array([5]), np.array([True]), np.array([n]), ids))
            assert (image.ids() == ids).all()
            if image.blocks > 1:
                assert (image.block(1) == ids[token_files.BLOCK :]).all()


def test_token_files(spark, docs, bpe):
    rows = {r.doc_id: r for r in queries.op9(spark, SF).collect()}
    at = 0
    for doc in sorted(docs):
        ids = np.array([*bpe.encode(docs[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# 10: pseudonyms


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def replaced(spark, values, key="k"):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_formats(spark):
    rng = random.Random(4)
    cards = ["4" + "".join(rng.choice("0123456789") for _ in range(14)) for _ in range(40)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in cards]
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(days=k) for k in rng.sample(range(73_049), 40)] + [datetime.date(2099, 12, 31), datetime.date(2000, 2, 29)]
    kinds = {
        "card": (cards, lambda x: luhn(x) and re.fullmatch(r"\d{16}", x)),
        "phone": ([f"+1 ({rng.randrange(200, 1000)}) 555-{rng.randrange(10_000):04}" for _ in range(40)], lambda x: re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x)),
        "ip": ([".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(40)], lambda x: all(0 <= int(p) < 256 for p in x.split("."))),
        "ssn": ([f"{rng.choice([*range(1, 666), *range(667, 900)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10_000):04}" for _ in range(40)], lambda x: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x)),
        "date": ([d.isoformat() for d in days], lambda x: datetime.date.fromisoformat(x)),
        "email": ([f"{n}.{rng.randrange(100)}@mail.example.com" for n in ("anna", "Bob", "c_d", "eve-f")], lambda x: re.fullmatch(r"[\w.-]+@mail\.example\.com", x)),
    }
    for kind, (values, valid) in kinds.items():
        out = replaced(spark, [f"see {v} and {v}." for v in values])
        new = [re.fullmatch(r"see (.*) and \1\.", t).group(1) for t in out]  # the same twice
        assert all(valid(x) for x in new) and [len(x) for x in new] == [len(x) for x in values] or kind == "ip"
        assert len(set(new)) == len(set(values)) and all(a != b for a, b in zip(values, new)), kind
        assert replaced(spark, values, "other")[:4] != new[:4]


def test_pseudonyms_are_permutations(spark):
    """Whole small domains: the late days of the calendar, one-digit mail names, and the last octets of an address."""
    late = [f"2099-11-{d:02}" for d in range(14, 31)] + [f"2099-12-{d:02}" for d in range(1, 32)] + ["2099-11-13"]
    assert len(late) == 49 and sorted(replaced(spark, late)) == sorted(late)
    names = [f"{a}{b}@x.org" for a in "0123456789" for b in "0123456789"]
    assert sorted(replaced(spark, names)) == sorted(names)


def test_other_numbers_stay(spark):
    same = ["4207051279108085", "999.1.1.1", "1.2.3", "000-11-2222", "666-11-2222", "2023-02-30", "31.02.2020", "1899-12-31", "version 1.2.3.4.5", "abc4207051279108084", "(112) 555-0000", "v4207051279108084x", "user@", "@host.com", "12:30:45"]
    assert replaced(spark, same) == same


def test_long_texts_and_order(spark):
    text = "x 28.125.121.88 " * 2000
    out = replaced(spark, [text, "28.125.121.88 at start", "end 28.125.121.88"])
    one = out[1].split(" ")[0]
    assert out[0] == text.replace("28.125.121.88", one) and out[2] == f"end {one}"


def test_shared_numbers_link_documents(spark):
    rows = pii.pseudonymise(spark.read.parquet(f"{SF}/documents.parquet"), "k").collect()
    seen = defaultdict(set)
    for r in rows:
        assert r.n_replaced == len(r.hits)
        for h in r.hits:
            seen[h["was"]].add(h["now"])
            assert h["was"] not in r.text
    assert seen and all(len(x) == 1 for x in seen.values())
