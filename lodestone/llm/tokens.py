"""Byte-level BPE ids from a tokenizers JSON file, encoded by the rank engine of tiktoken.

The vocabulary, the merges and the special tokens come from the JSON file alone. The merges are run by tiktoken, which
gives the same ids several times faster than the tokenizers library does; tests hold the two together. Long runs of
white space, on which tiktoken's pattern engine runs out of stack, are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Fixed: the pre-tokenizing pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed: white space as that pattern has it.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of at least this length go to the tokenizers library.
LONG = 4096
LONG_WHITE = re.compile(f"[{WHITE}]{{{LONG},}}")


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in such a vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        order = [ranks[bytes(chars[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model["ignore_merges"] or order != sorted(order):
            raise ValueError(f"{path} isn't a plain byte-level BPE whose ids follow its merges")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and spec["normalizer"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take in what is beside them")
        self.path, self.special = path, set(special)
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._library = None

    def ids(self, text: str) -> np.ndarray:
        """All ids of the text as unsigned 32-bit integers; strings of special tokens inside it become their ids."""
        if len(text) < LONG or not LONG_WHITE.search(text):
            return self.bpe.encode_to_numpy(text, allowed_special=self.special)
        return np.concatenate([np.zeros(0, np.uint32), *self._parts(text)])

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of what lies between long runs of white space, and of each run as the one word that it is.

        Such a word has the whole run before a special token or at the end of the text, else all but its last character,
        which belongs to what follows.
        """
        at = 0
        for m in LONG_WHITE.finditer(text):
            end = m.end() if m.end() == len(text) or any(text.startswith(s, m.end()) for s in self.special) else m.end() - 1
            yield self.bpe.encode_to_numpy(text[at : m.start()], allowed_special=self.special)
            yield self._run(text[m.start() : end])
            at = end
        yield self.bpe.encode_to_numpy(text[at:], allowed_special=self.special)

    def _run(self, white: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(white, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """Loaded once in each Python worker."""
    return ByteBpe(path)
