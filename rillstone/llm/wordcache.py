"""Encoders that remember the ids of words, where a space is a boundary that no token crosses.

A text is cut before each space that follows something else than a space and precedes a visible character. Byte-level BPE
starts a pre-token there, and the pieces of the unigram-like vocabulary hold U+2581 only at their beginning (checked when
it is opened), so what lies between two cuts has ids of its own, whatever is around it.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Words that a worker remembers for one encoder; beyond it the cache starts anew.
WORDS = 300_000
CUT = re.compile(r"(?<=[^ ]) (?=\S)")


class _Irregular(Exception):
    """A part that is empty or begins with white space: the plain split was no split at cuts."""


class Words(dict):
    """word -> what ``make`` gives for a space and the word."""

    def __init__(self, make: Callable[[str], object], most: int = WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if not word or word[0].isspace():
            raise _Irregular
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.make(" " + word)
        return found

    def of(self, text: str) -> tuple[str, list]:
        """The text's first word, and what is known of each later one."""
        parts = text.split(" ")
        try:
            return parts[0], list(map(self.__getitem__, parts[1:]))
        except _Irregular:
            parts = CUT.split(text)
            return parts[0], list(map(self.__getitem__, parts[1:]))


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


@lru_cache(4)
def byte_level(path: str | None = None):
    """A function from a string to its ids in the byte-level vocabulary of a rank file; no string is special to it."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ByteLevel:
    """Byte-level BPE ids of whole texts, as little-endian 32-bit integers; ``special`` strings have ids of their own."""

    def __init__(self, path: str | None = None, special: dict[str, int] | None = None):
        self.encode = byte_level(path)
        self.words = Words(lambda s: packed_ids(self.encode(s)))
        self.special = special or {}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, rest = self.words.of(text)
        return packed_ids(self.encode(first)) + b"".join(rest)

    def __call__(self, text: str) -> bytes:
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(packed_ids([self.special[s]]) if s in self.special else self._plain(s) for s in self.split.split(text))
