"""Splitting texts into the pieces that a byte-level BPE encodes one by one, and a bounded memory of encoded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

#: Fixed value: the public pattern of byte-level BPE vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: The same pieces for texts of ASCII without rare controls and Latin letters only, where the classes are short.
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_OTHER = re.compile(rf"[^\t-\r -~{_LATIN}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists all matches of the pattern in a text."""
    full = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return full
    plain, other = _PLAIN.findall, _OTHER.search
    return lambda text: full(text) if other(text) else plain(text)


class Memory(dict):
    """Encoded pieces by piece, in two generations: when the young one is full it becomes the old one.

    The bound limits memory only: a forgotten piece is encoded again, with the same result.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], bound: int):
        super().__init__()
        self.encode, self.bound, self.old = encode, bound, {}

    def learn(self, pieces: Iterable[str]) -> None:
        """See that every one of the pieces is in the young generation."""
        distinct = set(pieces)
        unseen = [p for p in distinct if p not in self]
        if len(self) + len(unseen) > self.bound:
            self.old = dict(self)
            self.clear()
            unseen = distinct
        old, new = self.old, []
        for p in unseen:
            if p in old:
                self[p] = old[p]
            else:
                new.append(p)
        self.update(zip(new, self.encode(new), strict=True))
