"""The leaf blocks of an HTML page: runs of text between the bounds of block elements, with the path of tags above each."""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

#: Fixed: elements that bound blocks; all others are part of a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Fixed: elements whose content is no text of the page, up to their end tag.
HIDDEN = frozenset("button canvas datalist head iframe math noembed noframes noscript object script select style svg template textarea title xmp".split())
#: Fixed: elements whose content is not markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Fixed: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dd": {"dt", "dd"}, "dt": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Numbers of path features: tags and words of class, id and role attributes fall to one of so many.
PATHS = 1024
#: Raw tags whose parts a worker keeps.
KEPT_TAGS = 1 << 14

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    """text: white space as single spaces; path: numbers of its ancestors' features; own: the innermost element; linked:
    characters within links; start: where in the page it begins."""

    text: str
    path: frozenset[int]
    own: str
    linked: int
    start: int


def hashed(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


def path_features(tag: str, attributes: str) -> frozenset[int]:
    """The tag, and the words of its class, id and role, each by the words' parts too."""
    found = {hashed(f"<{tag}", PATHS)}
    for groups in _NAMED.findall(attributes):
        found.update(hashed(p.lower(), PATHS) for p in _PART.findall("".join(groups)))
    return frozenset(found)


class _Tags(dict):
    """Raw tags by what they are: (closing, name, path features); a full table starts anew."""

    def __missing__(self, raw: tuple[str, str, str]) -> tuple[bool, str, frozenset[int]]:
        if len(self) >= KEPT_TAGS:
            self.clear()
        name = raw[1].lower()
        self[raw] = found = (bool(raw[0]), name, path_features(name, raw[2]) if name in BLOCKS and not raw[0] else frozenset())
        return found


_tags = _Tags()


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order, in one pass: broken markup is read on, never refused.

    Hidden elements and comments give no text. References are decoded. An element left open ends with its parent, a hidden
    one of markup hides nothing then, one of raw text all that follows; quotes left open end with their tag. Time is linear in the page, as depth and open elements are counted, not searched.
    """
    blocks: list[Block] = []
    # The open block elements with their paths, and how often each name is open.
    stack: list[tuple[str, frozenset[int]]] = [("body", frozenset())]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = begun = 0
    broken, unended = False, set()
    text_at = at = 0
    size = len(page)

    def text(piece: str, where: int) -> None:
        nonlocal linked, begun
        if not parts:
            if piece.isspace():
                return
            begun = where
        if "&" in piece:
            piece = entities.unescape(piece)
        if links:
            linked += len(piece)
        parts.append(piece)

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            words = " ".join("".join(parts).split())
            if words:
                blocks.append(Block(words, stack[-1][1], stack[-1][0], linked, begun))
            parts, linked = [], 0

    def pop() -> None:
        name, _ = stack.pop()
        opened[name] -= 1

    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        if after == "!" or after == "?":
            if at > text_at:
                text(page[text_at:at], text_at)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            text_at = at
            continue
        if not (after.isalpha() or (after == "/" and page[at + 2 : at + 3].isalpha())):
            at += 1  # a lone sign is text
            continue
        match = None if broken else _TAG.match(page, at)
        if match:
            raw, end = match.groups(), match.end()
        else:
            broken, end = True, page.find(">", at) + 1
            if not end:
                end = size
            closing = page.startswith("</", at)
            name, _, rest = page[at + 1 + closing : max(end - 1, at + 1)].replace("/", " ").partition(" ")
            raw = ("/" if closing else "", name or "a", rest)
        if at > text_at:
            text(page[text_at:at], text_at)
        at = text_at = end
        closing, name, features = _tags[raw]
        if name in HIDDEN:
            if closing:
                continue
            end = -1 if name in unended else _hidden_end(page, name, at)
            if end < 0 and name not in RAW:
                unended.add(name)  # left open, it hides nothing: what follows is read
                continue
            at = text_at = size if end < 0 else end
        elif name in BLOCKS:
            flush()
            links = 0
            if closing:
                if opened.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if stack[-1][0] == "p":
                pop()
            ended = ENDS.get(name)
            while ended and stack[-1][0] in ended:
                pop()
            if name not in VOID:
                path = stack[-1][1]
                stack.append((name, path if features <= path else path | features))
                opened[name] = opened.get(name, 0) + 1
        elif name == "br":
            text(" ", text_at)
        elif name == "a":
            links = max(links + (-1 if closing else 1), 0)
    if text_at < size:
        text(page[text_at:], text_at)
    flush()
    return blocks


_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in HIDDEN}


def _hidden_end(page: str, name: str, at: int) -> int:
    """Where the hidden element that is open at `at` ends; -1 if nowhere."""
    if name == "head":
        # Scripts and styles of the head may hold its end tag as text; the body's begin ends a head as well.
        while True:
            found = _HEAD.search(page, at)
            if not found:
                return -1
            inner = (found.group(1) or "").lower()
            if inner not in RAW:
                return found.start() if inner == "body" else found.end()
            end = _END_OF[inner].search(page, found.end())
            if not end:
                return len(page)
            at = end.end()
    found = _END_OF[name].search(page, at)
    return found.end() if found else -1


_HEAD = re.compile(r"</head(?=[\s/>])[^>]*>|<(body|script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>])[^>]*>", re.I)
