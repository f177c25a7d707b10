"""Exact pre-token splitting in front of the tokenizers library.

Both vocabularies here split a text into pre-tokens and run BPE inside each. Texts whose characters all lie
in ``SAFE`` are split here, chunk by chunk between blanks, and each pre-token's ids come from a cache or from
the library's own BPE model. Any other text (other scripts, control characters, special strings) goes to the
library whole, so the result is the library's for every text.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from functools import lru_cache

import regex

# The split patterns and the byte alphabet of the two public vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Characters on which this module and the library agree by construction: ASCII without controls, and Latin
#: letters that are stable under composition and have a one-character lower case.
SAFE = r"\t\n\r\x20-\x7e¡-įı-ɏ"
UNSAFE = regex.compile(rf"[^{SAFE}]")
#: The part of it that has one byte per character, for a quick test.
SAFE_BYTES = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


def unsafe(text: str) -> bool:
    """Whether a text goes to the library whole."""
    if "<|" in text:
        return True
    try:
        return bool(text.encode("latin-1").translate(None, SAFE_BYTES))
    except UnicodeEncodeError:
        return UNSAFE.search(text) is not None


def loose(text: str) -> bool:
    """Blanks in a row, before other white space or at the end: the chunks are then not independent."""
    return "  " in text or " \n" in text or " \t" in text or " \r" in text or text.endswith(" ")


def merging(text: str) -> bool:
    """Tabs, carriage returns, or line ends that may share a pre-token: the lines are then not independent. One line
    end, or two before a letter or mark, are pre-tokens of their own."""
    return "\t" in text or "\r" in text or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n")


def _byte_letters() -> dict[int, str]:
    others = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = _byte_letters()
#: Marks that are a pre-token of their own after a word.
MARKS = frozenset(".,;:!?)")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer of a file, one per worker and single threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Recent(dict):
    """A bounded cache of what ``make`` returns, in two generations: when the young one is full it becomes the
    old one, and what is asked for again moves back, so frequent keys stay."""

    def __init__(self, make: Callable[[str], object], size: int) -> None:
        super().__init__()
        self.make = make
        self.size = size
        self.old: dict[str, object] = {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteLevelIds:
    """Token ids of whole texts for a byte-level vocabulary without normaliser, as little-endian unsigned
    32-bit integers. ``cache_size`` bounds the remembered chunks, chunks at line starts and other pre-tokens each."""

    def __init__(self, path: str, cache_size: int = 300_000) -> None:
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(BYTE_LEVEL)
        self.words = Recent(self._word, cache_size)
        self.chunks = Recent(self._after_blank, cache_size)
        self.starts = Recent(self._at_start, cache_size)
        self.line_end = self._word("\n")

    def _word(self, word: str) -> bytes:
        letters = "Ġ" + word[1:] if word[0] == " " and word[1:].isalpha() and word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after_blank(self, chunk: str) -> bytes:
        """A chunk and the blank before it; a word, or a word and one other mark, needs no pattern."""
        if chunk.isalpha():
            return self._word(" " + chunk)
        word, mark = chunk[:-1], chunk[-1:]
        if mark in MARKS and word.isalpha():
            return self.chunks[word] + self.words[mark]
        return self._split(" " + chunk)

    def _at_start(self, chunk: str) -> bytes:
        """The same without a blank, as at the start of a line."""
        if chunk.isalpha():
            return self._word(chunk)
        word, mark = chunk[:-1], chunk[-1:]
        if mark in MARKS and word.isalpha():
            return self.starts[word] + self.words[mark]
        return self._split(chunk)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.starts[first] + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if unsafe(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if loose(text):
            return self._split(text)
        if merging(text):
            return self._line(text)
        return self.line_end.join(map(self._line, text.split("\n")))


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> ByteLevelIds:
    """One encoder per worker, so that its bounded caches outlive a task."""
    return ByteLevelIds(path)


class FrequentFirst(dict):
    """The frequent tier; what it lacks is asked of the worker's cache."""

    def __init__(self, frequent: dict[str, int], rest: Recent) -> None:
        super().__init__(frequent)
        self.rest = rest

    def __missing__(self, key: str) -> int:
        return self.rest[key]


class WordEndCounts:
    """Token counts of whole texts for a vocabulary with word ends, which lower-cases and drops white space.

    Two tiers: ``frequent`` maps frequent pre-tokens to their lengths and is never evicted; what it lacks is
    encoded once and kept in a bounded worker cache."""

    def __init__(self, path: str, frequent: dict[str, int], cache_size: int = 250_000) -> None:
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(WORD_ENDS)
        self.frequent = FrequentFirst(frequent, Recent(self._miss, cache_size))

    def word(self, word: str) -> int:
        letters = word.encode().decode("latin-1").translate(LETTERS)
        return len(self.model.tokenize(letters))

    def _miss(self, chunk: str) -> int:
        """A chunk between white space that is no frequent pre-token: its pre-tokens one by one."""
        words = self.pattern.findall(chunk)
        return self.word(chunk) if words == [chunk] else sum(map(self.frequent.__getitem__, words))

    def count(self, text: str) -> int:
        if unsafe(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.frequent.__getitem__, text.lower().split()))

    def chunks(self, text: str) -> list[str]:
        """The lower-cased chunks between white space, or none for a text that goes to the library."""
        return [] if unsafe(text) else text.lower().split()
