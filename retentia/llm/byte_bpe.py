"""Byte-level BPE of a tokenizer .json, split into cached chunks.

The pre-tokenizer (the public byte-level pattern) never joins text across a
single space that stands before a non-space character: the space belongs to what
follows. So a text without longer runs around spaces can be cut there, and what
is computed for one chunk can be kept for its next occurrence. Texts with a
space before white space or at the end are split by the pattern itself instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import public_tokenizers
import regex

#: A space whose next character is white space or the end: chunking is not used there.
AWKWARD = re.compile(r" (?:\s|\Z)")
#: Longer chunks are not kept.
LONG = 200
#: Chunks kept by a worker before it starts anew.
CACHE = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by rank, and the special strings, of a byte-level BPE .json."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.ranks = {bytes(alphabet[c] for c in token): rank
                      for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


class ChunkCache(dict):
    """chunk -> value, computed by ``make`` when missing; starts anew when full."""

    def __init__(self, make: Callable[[str], object], prefix: str):
        super().__init__()
        self.make, self.prefix = make, prefix

    def __missing__(self, chunk: str):
        value = self.make(self.prefix + chunk)
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = value
        return value


class Chunked:
    """Values of the chunks of a text, by a function of ordinary text that may be applied chunk by chunk."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make
        self.first, self.inner = ChunkCache(make, ""), ChunkCache(make, " ")

    def __call__(self, text: str) -> list:
        if AWKWARD.search(text):
            return [self.make(text)]
        head, *rest = text.split(" ")
        return [self.first[head], *map(self.inner.__getitem__, rest)]


def split_special(vocabulary: Vocabulary, text: str) -> list[tuple[str, int | None]]:
    """(ordinary text, id of the special string after it or None), as the library's default splits them."""
    if vocabulary.special_split is None or not any(s in text for s in vocabulary.special):
        return [(text, None)]
    out, at = [], 0
    for m in vocabulary.special_split.finditer(text):
        out.append((text[at:m.start()], vocabulary.special[m[0]]))
        at = m.end()
    return [*out, (text[at:], None)]
