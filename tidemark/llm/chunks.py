"""Encoding of texts chunk by chunk, with the ids of chunks in a bounded cache."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, filterfalse

_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: ASCII digits and marks but the apostrophe, which some patterns take with the letters before it.
_MARKS = "!-&(-@\\[-`{-~"
#: Letters before a blank, the end or one of these marks; else all up to a blank; else blanks, up to a space that a word takes.
#: No match of the byte-level tokenizers' pattern crosses such a cut: a match starts with at most one space and has no other
#: blank, or consists of blanks; and letters end a match where a mark follows.
CHUNKS = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^{_BLANK}{_MARKS}])| ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: A chunk that is a single match of the pattern for sure.
LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Chunks kept unless an encoder says otherwise; characters of text that are encoded together.
CACHED, TOGETHER = 400_000, 500_000


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers; ``ids_of`` gives those of chunks that aren't known yet."""

    #: Chunks kept in each of two generations.
    cached = CACHED

    def __init__(self):
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(CHUNKS.findall(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(self.cache) >= self.cached:  # what is asked for again moves back from the old generation
            self.old, self.cache = self.cache, {}
        missing = set(filterfalse(self.cache.__contains__, chain.from_iterable(held)))
        known = {c: ids for c in missing if (ids := self.old.get(c)) is not None}
        new = list(missing.difference(known))
        self.cache.update(known)
        self.cache.update(zip(new, self.ids_of(new)))
        for chunks in held:
            yield b"".join(map(self.cache.__getitem__, chunks))
