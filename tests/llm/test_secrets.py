"""Secrets in base64 beside other text and over lines, and in compressed layers of many secrets, members and bytes."""

import base64
import bz2
import gzip
import textwrap
import zlib

import pytest

from lodestone.llm import secret_scan

SECRET = "password=hunter2xyz"
ENV = "".join(f"token={i:06}abc\n" for i in range(10))
B64 = lambda b: base64.b64encode(b).decode()


def secrets(text, **options):
    return [f[4] for f in secret_scan.scan(text, **options)[0]]


@pytest.mark.parametrize("before", ["https://h.example/r/", "auth-", "key_", "a/", "ab-", "abc_", "x", "xy", "xyz", "see "])
@pytest.mark.parametrize("after", ["", "/more/of/it", "-v2", "_x", "."])
def test_base64_beside_text(before, after):
    text = f"see {before}{B64(SECRET.encode()).rstrip('=')}{after}"
    found = [f for f in secret_scan.scan(text)[0] if f[3] == "base64"]
    assert any(f[4].startswith(SECRET) for f in found)
    for _, a, b, _, _ in found:
        assert 4 + len(before) - 4 < a < b <= len(text)
    packed = f"see {before}{B64(gzip.compress(SECRET.encode(), mtime=0)).rstrip('=')}{after}"
    assert SECRET in [f[4] for f in secret_scan.scan(packed)[0] if f[3] == "base64>gzip"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    "])
def test_base64_over_lines(end):
    raw = b"x" * 40 + SECRET.encode() + b" " * 60
    for width in (64, 76):
        text = "see " + end.join(textwrap.wrap(B64(raw), width)) + "\nend"
        (found,) = [f for f in secret_scan.scan(text)[0] if f[4] == SECRET]
        assert text[found[1] :].startswith(B64(raw)[found[1] - 4 :][:4]) and found[2] <= len(text)
    raw = gzip.compress(bytes(i * 7 % 251 for i in range(300)) + b"\n" + ENV.encode(), mtime=0)
    assert set(ENV.split()) <= set(secrets("see " + end.join(textwrap.wrap(B64(raw), 64))))


def zstd(raw):
    import zstandard

    return zstandard.ZstdCompressor().compress(raw)


@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress, zstd])
def test_all_secrets_of_a_compressed_layer(pack):
    assert sorted(secrets("see " + B64(pack(ENV.encode())))) == ENV.split()
    half = len(ENV) // 20 * 10
    half = ENV.index("\n", half) + 1
    assert sorted(secrets("see " + B64(pack(ENV[:half].encode()) + pack(ENV[half:].encode())))) == ENV.split()
    assert sorted(secrets("see " + B64(pack(pack(ENV.encode()))))) == ENV.split()
    # Beyond max_layer, with characters of more bytes at every cut, and among bytes that are no text.
    lines = ["é" * 50 + "\n"] * 400 + ["secret=first123\n"] + ["ü" * 30 + "\n"] * 400 + ["secret=last4567\n"]
    assert secrets("see " + B64(pack("".join(lines).encode())), max_layer=999) == ["secret=first123", "secret=last4567"]
    assert secrets("see " + B64(pack(("é" * 9000 + " secret=last4567").encode())), max_layer=999) == ["secret=last4567"]
    assert secrets("see " + B64(pack(b"\0\xff" * 500 + b" secret=last4567 " + b"\0" * 500))) == ["secret=last4567"]


def test_long_runs_end():
    assert secret_scan.scan("x" * 300_000)[0] == [] and secret_scan.scan("ab/cd-ef_" * 20_000)[0] == []
    assert secret_scan.scan("abcdefghijklmnopqrst\n" * 10_000)[0] == []
    assert secret_scan.scan("https://h.example/a secret=abcdef%67h secret=ijklmnop")[0] == [
        ("assign", 20, 33, "", "secret=abcdef"), ("assign", 20, 37, "url", "secret=abcdefgh"), ("assign", 38, 53, "", "secret=ijklmnop"),
    ]
