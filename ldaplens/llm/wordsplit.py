"""Splitting text the way two public tokenizer files do before their merges.

Texts made only of characters in ``SAFE`` (Latin letters and common punctuation) are split by an
``re`` pattern whose letter, number and space classes are built from the Unicode categories; any
other text goes to the tokenizer's own splitter, so the pieces are the library's for every input.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: Code points of the fast path. No cased letter among them lower-cases by context.
SAFE = [(0x00, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]


def _cls(points) -> str:
    """A character class (without brackets) of sorted code points, as ranges."""
    out, run = [], []
    for p in [*points, -1]:
        if run and p != run[-1] + 1:
            out.append(f"\\U{run[0]:08x}" + (f"-\\U{run[-1]:08x}" if len(run) > 1 else ""))
            run = []
        run.append(p)
    return "".join(out)


@cache
def classes() -> tuple[str, str, str]:
    """Letters, numbers and white space among the safe code points and their lower-case forms."""
    points = [p for a, b in SAFE for p in range(a, b + 1)]
    points = sorted({*points, *(ord(c) for p in points for c in chr(p).lower())})  # some lower-case forms lie outside
    kind = {p: unicodedata.category(chr(p)) for p in points}
    space = [p for p in points if kind[p][0] == "Z" or p in (9, 10, 11, 12, 13, 0x85)]
    return (_cls([p for p in points if kind[p][0] == "L"]), _cls([p for p in points if kind[p][0] == "N"]), _cls(space))


@cache
def unsafe():
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SAFE) + "]").search


@cache
def lower_words():
    """``findall`` for the word vocabulary: contractions, letter runs, single digits, other runs."""
    letter, number, space = classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+").findall


@cache
def byte_pieces():
    """``findall`` for the byte vocabulary's pattern over safe texts."""
    letter, number, space = classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


@cache
def byte_alphabet() -> tuple[str, ...]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable
    Latin-1, else the next code points from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in keep else chr(next(spare)) for b in range(256))


def normal_form(text: str) -> str:
    """NFC and lower case of a safe text."""
    return unicodedata.normalize("NFC", text).lower()


class Bounded(dict):
    """A memo of ``make(key)`` that is emptied when it holds ``limit`` entries; long keys are not kept."""

    def __init__(self, make, limit: int = 500_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
