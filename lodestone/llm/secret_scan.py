"""Secret scans with a recursive decoding worklist: nested URL, Unicode, base64 and compressed layers, to a fixpoint."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import key_and_text

#: Fixed patterns of the three kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these stands in the lower-cased text of every assignment.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
UNICODE_ONE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, indented or not; and the parts of a run that are text before or after base64 otherwise.
WRAPPED_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r\n?|\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
NO_BASE64 = re.compile(r"[^A-Za-z0-9+/_-]+")
PART = re.compile(r"[A-Za-z0-9+]{16,}")
LEAST_RUN = 16
STANDARD = str.maketrans("-_", "+/")
#: Characters (and bytes that are no UTF-8, as surrogates) that text doesn't have; no secret is shorter than a stretch.
NO_TEXT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]")
STRETCH = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]{12,}")
#: Characters that may stand for bytes.
BYTES = re.compile("[\x00-\xff]+")
#: The first bytes of gzip, zlib, bzip2 and zstd.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\x28\xb5\x2f\xfd", re.S)
CHUNK = 1 << 20
FINDINGS = "doc_id long, findings array<struct<kind: string, start: long, end: long, via: string, secret: string>>, n_layers long"


class Layer(NamedTuple):
    """A text and, for each of its characters, where it came from in the original (None: from its own place)."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    via: str

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every secret in the clear, leftmost and without overlap in each kind."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _utf8(raw: bytes) -> tuple[str, list[int]]:
    """The text and each character's count of bytes; a byte that isn't UTF-8 is a surrogate, which stands for it."""
    text = raw.decode("utf-8", "surrogateescape")
    return text, _sizes(text).tolist()


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character; a surrogate that stands for a byte is one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return sizes


def _substituted(layer: Layer, runs: re.Pattern[str], decode, name: str) -> Layer | None:
    """The layer with every run decoded in place, so that secrets half in the clear are seen whole."""
    parts: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at = 0

    def clear(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        starts.append(np.arange(a, b) if layer.starts is None else layer.starts[a:b])
        ends.append(np.arange(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    for m in runs.finditer(layer.text):
        if (found := decode(m.group())) is None:
            continue
        text, cuts = found  # cuts: each character's end within the run
        places = [layer.span(m.start() + a, m.start() + b) for a, b in zip([0, *cuts[:-1]], cuts)]
        clear(at, m.start())
        parts.append(text)
        starts.append(np.array([p[0] for p in places], dtype=np.int64))
        ends.append(np.array([p[1] for p in places], dtype=np.int64))
        at = m.end()
    if not at:
        return None
    clear(at, len(layer.text))
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), f"{layer.via}>{name}")


def _url(run: str) -> tuple[str, list[int]]:
    text, sizes = _utf8(binascii.unhexlify(run.replace("%", "")))
    return text, np.cumsum([3 * n for n in sizes]).tolist()


def _unicode(run: str) -> tuple[str, list[int]] | None:
    text, cuts, high = "", [], 0
    for m in UNICODE_ONE.finditer(run):
        code = int(m.group(1), 16)
        if 0xD800 <= code < 0xDC00:
            high = code
            continue
        if 0xDC00 <= code < 0xE000:
            code = 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00 if high else 0xFFFD
        high = 0
        text += chr(code) if code <= 0x10FFFF else "\ufffd"
        cuts.append(m.end())
    return (text, cuts) if text else None


def _opener(head: bytes) -> tuple[str, Callable] | None:
    """The name of a compressed stream and what makes its decompressor."""
    if not (m := MAGIC.match(head)):
        return None
    if m.group()[:1] == b"\x1f":
        return "gzip", lambda: zlib.decompressobj(31)
    if m.group()[:1] == b"\x78":
        return "zlib", zlib.decompressobj
    if m.group()[:1] == b"B":
        return "bzip2", bz2.BZ2Decompressor
    import zstandard

    return "zstd", lambda: zstandard.ZstdDecompressor().decompressobj()


def _fed(unit, name: str, data: bytes) -> Iterator[bytes]:
    """What `data` unpacks to, about CHUNK bytes at a time."""
    if name == "zstd":
        yield unit.decompress(data)
        return
    while True:
        out = unit.decompress(data, CHUNK)
        yield out
        data = unit.unconsumed_tail if name != "bzip2" else b""
        if unit.eof or (unit.needs_input if name == "bzip2" else len(out) < CHUNK):
            return


def _inflated(source: Iterable[bytes], name: str, make: Callable, used: list[int]) -> Iterator[bytes]:
    """The content of all members of a stream, up to its end or where it is broken; `used` gets the bytes of its whole members."""
    unit, step, at = make(), 256 if name == "zstd" else 1 << 16, 0
    try:
        for chunk in source:
            for k in range(0, len(chunk), step):
                data = chunk[k : k + step]
                at += len(data)
                while data:
                    yield from _fed(unit, name, data)
                    data = b""
                    if unit.eof:
                        data, unit = unit.unused_data, make()
                        used[:] = [at - len(data)]
                        data = data.lstrip(b"\0") if name == "gzip" else data  # padding
    except (zlib.error, OSError, EOFError, ValueError, RuntimeError):
        pass
    except Exception as e:
        if type(e).__name__ != "ZstdError":
            raise


def _unpacked(raw: bytes, used: list[int]) -> tuple[str, Iterator[bytes]] | None:
    """The names (>gzip...) of all the compressed layers that `raw` begins with and the content of the innermost."""
    names, source, heads = "", iter([raw]), set()
    while (head := next(source, None)) is not None:
        source = chain([head], source)
        mark = hashlib.sha256(head).digest()
        if not (opener := _opener(head)) or mark in heads:  # the latter unpacks to itself
            break
        heads.add(mark)
        kept: list[bytes] | None = []

        def recorded(outer=source):
            for chunk in outer:
                if kept is not None:
                    kept.append(chunk)
                yield chunk

        inner = (x for x in _inflated(recorded(), *opener, [] if names else used) if x)
        first = next(inner, None)
        if first is None:
            source = chain(kept, source)
            break
        kept = None
        names, source = f"{names}>{opener[0]}", chain([first], inner)
    return (names, source) if names else None


def _pieces(source: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The content in pieces of up to `most` bytes, cut at line ends near by; each begins in its predecessor's last quarter."""
    rest = bytearray()
    for chunk in source:
        rest += chunk
        while len(rest) > most:
            cut = rest.rfind(b"\n", most - most // 8, most) + 1 or most
            yield bytes(rest[:cut])
            back = cut - most // 4
            del rest[: rest.find(b"\n", back, back + most // 8) + 1 or back]
    if rest:
        yield bytes(rest)


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The text of the bytes, if nearly all of them are text, or else its stretches, with each character's first and last byte."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(NO_TEXT.findall(text)) <= 0.05 * len(text):
        cuts = [(0, len(text))] if text else []
    else:
        cuts = [m.span() for m in STRETCH.finditer(text)]
    if cuts:
        sizes = _sizes(text)
        last = np.cumsum(sizes)
        for a, b in cuts:
            yield text[a:b], last[a:b] - sizes[a:b], last[a:b]


def _read(layer: Layer, run: str, at: np.ndarray, end: int, most: int, done: set | None) -> Iterator[Layer]:
    """Layers of base64 whose characters lie at `at` in the layer; compressed ones, at any byte, if `done` (those read) is given."""
    n = len(run) - (len(run) % 4 == 1)
    if n < LEAST_RUN:
        return
    raw = base64.b64decode(run[:n].translate(STANDARD) + "=" * (-n % 4))
    via, place, covered = f"{layer.via}>base64", 0, []
    while done is not None and (m := MAGIC.search(raw, place)):
        place, used = m.start() + 1, []
        first = int(at[m.start() // 3 * 4])
        if (first, m.start() % 3) not in done and (found := _unpacked(raw[m.start() :], used)):
            done.add((first, m.start() % 3))
            names, source = found
            a, b = layer.span(first, end)
            for piece in _pieces(source, most):  # no places of its own: its secrets lie somewhere in the run
                for text, _, _ in _texts(piece):
                    yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)), via + names)
            if used:
                place = m.start() + used[0]
                covered.append((m.start(), place))
    for text, first, last in _texts(raw):
        if any(a <= first[0] < b for a, b in covered):
            continue
        starts, ends = at[first // 3 * 4], at[np.minimum((last + 2) // 3 * 4, n) - 1]
        yield Layer(text, starts if layer.starts is None else layer.starts[starts], ends + 1 if layer.ends is None else layer.ends[ends], via)


def _base64_layers(layer: Layer, most: int) -> Iterator[Layer]:
    """Every reading of every run: joined over line ends, at four alignments (text before it may be of the same characters), and by parts."""
    done: set[tuple[int, int]] = set()
    for m in chain(WRAPPED_RUN.finditer(layer.text), BASE64_RUN.finditer(layer.text)):
        run, at = m.group().rstrip("="), np.arange(m.start(), m.end())
        if m.re is WRAPPED_RUN:
            own = np.ones(len(run), dtype=bool)
            for gap in NO_BASE64.finditer(run):
                own[gap.start() : gap.end()] = False
            run, at = NO_BASE64.sub("", run), at[: len(run)][own]
        for k in range(4):
            yield from _read(layer, run[k:], at[k:], m.end(), most, done)
        for part in PART.finditer(run):
            if part.end() - part.start() < len(run):
                yield from _read(layer, part.group(), at[part.start() : part.end()], m.end(), most, None)


def _binary_layers(layer: Layer, most: int) -> Iterator[Layer]:
    """What compressed streams that stand as escaped bytes in the text above unpack to.

    URL escapes give bytes, Unicode escapes characters below U+0100 that stand for some; characters in between are bytes too.
    """
    if not NO_TEXT.search(layer.text):
        return
    if layer.via.endswith(">url"):
        runs = [(0, layer.text.encode("utf-8", "surrogateescape"), np.cumsum(_sizes(layer.text)))]
    elif layer.via.endswith(">unicode"):
        runs = [(m.start(), m.group().encode("latin-1"), np.arange(1, m.end() - m.start() + 1)) for m in BYTES.finditer(layer.text)]
    else:
        return
    for offset, raw, ends in runs:
        place = 0
        while m := MAGIC.search(raw, place):
            place, used = m.start() + 1, []
            if found := _unpacked(raw[m.start() :], used):
                for _ in found[1]:  # read through once to learn where the stream ends
                    pass
                stop = m.start() + used[0] if used else len(raw)
                names, source = _unpacked(raw[m.start() :], [])
                first, last = np.searchsorted(ends, [m.start(), stop - 1], side="right")
                a, b = layer.span(offset + int(first), offset + int(last) + 1)
                for piece in _pieces(source, most):
                    for text, _, _ in _texts(piece):
                        yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)), layer.via + names)
                place = max(place, stop) if used else place


def _unwrapped(layer: Layer, most: int) -> Iterator[Layer]:
    yield from _base64_layers(layer, most)
    yield from _binary_layers(layer, most)
    for sign, runs, decode, name in (("%", URL_RUN, _url, "url"), ("\\", UNICODE_RUN, _unicode, "unicode")):
        if sign in layer.text and (new := _substituted(layer, runs, decode, name)) is not None:
            yield new


def scan(text: str, max_layer: int = 64 << 20) -> tuple[list[tuple[str, int, int, str, str]], int]:
    """All findings (kind, start, end, via, secret) by start, kind and end, and the number of layers scanned.

    The worklist starts with the text itself. Each layer is scanned, then unwrapped in every way that applies; new
    layers join the list until none is left. A layer whose text and origin were seen before is a cycle and is dropped.
    Base64 is read at all alignments, in parts and over line ends, so a secret beside other text may be found both on
    its own and with characters of its surroundings. Spans are code points of the original, end exclusive; a finding in
    the clear keeps its span (via is empty). The same secret at the same span counts once, whatever URL and Unicode
    escapes it was seen through, with the shortest via.
    """
    found: dict[tuple[str, int, int, str, str], str] = {}
    work, seen, layers = [iter([Layer(text, None, None, "")])], set(), 0
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if layer.via:
            mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.starts[0]), int(layer.ends[-1])) if layer.text else None
            if mark is None or mark in seen:
                continue
            seen.add(mark)
        layers += 1
        packed = ">".join(x for x in layer.via.split(">") if x not in ("url", "unicode"))
        for kind, a, b in matches(layer.text):
            key = (kind, *layer.span(a, b), layer.text[a:b], packed)
            found[key] = min(found.get(key, layer.via), layer.via, key=lambda via: via.count(">"))
        work.append(_unwrapped(layer, max_layer))
    order = sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2], x[1], x[0][3]))
    return [(kind, a, b, via[1:], secret) for (kind, a, b, secret, _), via in order], layers


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = 64 << 20) -> DataFrame:
    """doc_id, findings and n_layers of every row's whole text; `via` of a finding names the layers it was under.

    A narrow map without any shuffle; memory is a batch of texts and the layers that one layer lies under. A compressed
    layer is scanned whole, `max_layer` bytes at a time; pieces overlap by a quarter of that, which the longest secret or
    run across two pieces may have. A decompression bomb costs the time to read it through. A null or empty text has no findings;
    a null doc_id stays null; repeated rows are scanned each; an empty table gives no rows; other columns are not read.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string()), ("secret", pa.string())]))
        for batch in batches:
            results = [scan(t.as_py() or "", max_layer) for t in batch.column(1)]
            rows = [[dict(zip(("kind", "start", "end", "via", "secret"), f)) for f in r[0]] for r in results]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind), pa.array([r[1] for r in results], pa.int64())], names=["doc_id", "findings", "n_layers"])

    return key_and_text(df, id_col, text_col).mapInArrow(scanned, FINDINGS)
