"""Recall of secrets under random nestings of wrappings, escapes that aren't UTF-8, and compressed bytes under escapes."""

import base64
import bz2
import gzip
import random
import urllib.parse
import zlib

import pytest

from lodestone.llm import secret_scan


def compressed(rng, raw):
    return rng.choice([lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress])(raw)


def percent(rng, raw):
    return "".join(f"%{b:02X}" for b in raw) if rng.random() < 0.5 else urllib.parse.quote_from_bytes(raw, safe="")


def escaped(rng, raw):
    return "".join(f"\\x{b:02x}" if rng.random() < 0.5 else f"\\u{b:04x}" for b in raw)


def encoded(rng, raw):
    run = base64.b64encode(raw).decode()
    return run.rstrip("=") if rng.random() < 0.3 else run


def wrapped(rng, secret):
    """A text that shows the secret only after one to four rounds of unwrapping."""
    text = f"see {secret} here"
    for _ in range(rng.randrange(1, 5)):
        raw = text.encode()
        if rng.random() < 0.35:
            raw = compressed(rng, raw)
        run = rng.choice([percent, escaped, encoded])(rng, raw)
        text = rng.choice(["", "x=", "at: ", "é "]) + run + rng.choice(["", " end", "\n", "&b"])
    return text


def test_recall_of_nested_wrappings():
    rng, found = random.Random(11), 0
    for i in range(400):
        secret = rng.choice([f"password=hunter{i:04}xyz", f"AKIA{i:016}", f"{i:024x}"])
        text = "before " + wrapped(rng, secret) + " after"
        hits = secret_scan.scan(text)[0]
        found += any(secret in f[4] for f in hits)
        assert all(0 <= a < b <= len(text) for _, a, b, _, _ in hits)
    assert found >= 0.97 * 400, found


@pytest.mark.parametrize("bad", ["%ff", "%c3%28", "%80%81"])
def test_bytes_that_are_no_text(bad):
    run = "".join(f"%{b:02x}" for b in b"password=hunter2xyz")
    for text in (f"q={bad}{run}&c", f"q={run}{bad}&c", f"q=%20{bad}%20{run}"):
        assert "password=hunter2xyz" in [f[4] for f in secret_scan.scan(text)[0]]


def test_spans_of_escaped_streams():
    raw = gzip.compress(b"token=abcdef123", mtime=0)
    text = "see " + "".join(f"%{b:02x}" for b in raw) + " and more"
    (hit,) = [f for f in secret_scan.scan(text)[0] if f[4] == "token=abcdef123"]
    assert hit[1:4] == (4, 4 + 3 * len(raw), "url>gzip")
    text = "b'" + "".join(f"\\x{b:02x}" for b in raw) + "'"
    (hit,) = [f for f in secret_scan.scan(text)[0] if f[4] == "token=abcdef123"]
    assert hit[1:4] == (2, 2 + 4 * len(raw), "unicode>gzip")
