"""Cutting texts into units that a byte-level BPE encodes independently of what stands around them."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space after white space, or white space as a whole text: cutting at every space would not be safe there.
_UNSAFE = re.compile(r"\s ")
#: A place between a visible character and a single space before a visible character.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def units(text: str) -> tuple[str, list[str]]:
    """The first unit, and the others without their leading space.

    The pre-tokenization pattern lets a space start a token but never end or cross one unless white space follows it, so
    each unit (a space and what follows) has the same tokens alone as in the text.
    """
    if not _UNSAFE.search(text):
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _SAFE.split(text)
    return first, [x[1:] for x in rest]


class UnitCache(dict):
    """unit (without its leading space) -> its encoded bytes, for at most ``most`` units.

    ``encode`` encodes many units at once; a unit looked up without ``fill`` is encoded alone.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[unit] = got = self.encode([self.lead + unit])[0]
        return got

    def fill(self, wanted: set[str]) -> None:
        """Encodes all that is missing of ``wanted`` in one call."""
        missing = [x for x in wanted if x not in self]
        if len(self) + len(missing) > self.most:
            self.clear()
            missing = list(wanted)
        for x, got in zip(missing, self.encode([self.lead + x for x in missing])):
            self[x] = got


def encode_each(text: str, first: UnitCache, rest: UnitCache) -> bytes:
    """The encoded bytes of a text, its units looked up one by one."""
    a, b = units(text)
    return first[a] + b"".join(map(rest.__getitem__, b))


def encode_texts(texts: list[str], first: UnitCache, rest: UnitCache, slice_chars: int = 4_000_000) -> list[bytes]:
    """The encoded bytes of each text; units are looked up, after one call that encodes a slice's new units together."""
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        cut, chars = [], 0
        while at < len(texts) and (not cut or chars < slice_chars):
            cut.append(units(texts[at]))
            chars += len(texts[at])
            at += 1
        first.fill({a for a, _ in cut})
        rest.fill({x for _, b in cut for x in b})
        out += [first[a] + b"".join(map(rest.__getitem__, b)) for a, b in cut]
    return out
