"""Sets of characters as sorted, disjoint ranges of code points."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

MAX = 0x10FFFF
Set = tuple[tuple[int, int], ...]
EMPTY: Set = ()
ALL: Set = ((0, MAX),)


def norm(ranges) -> Set:
    out: list[list[int]] = []
    for lo, hi in sorted(r for r in ranges if r[0] <= r[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def of(chars: str) -> Set:
    return norm((ord(c), ord(c)) for c in chars)


def span(a: str, b: str) -> Set:
    return norm([(ord(a), ord(b))])


def union(a: Set, b: Set) -> Set:
    return norm((*a, *b))


def complement(a: Set) -> Set:
    out, at = [], 0
    for lo, hi in a:
        out.append((at, lo - 1))
        at = hi + 1
    return norm([*out, (at, MAX)])


def intersection(a: Set, b: Set) -> Set:
    return norm((max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b)


def difference(a: Set, b: Set) -> Set:
    return intersection(a, complement(b))


def symmetric(a: Set, b: Set) -> Set:
    return union(difference(a, b), difference(b, a))


def member(c: str, a: Set) -> bool:
    n = ord(c)
    return any(lo <= n <= hi for lo, hi in a)


@lru_cache(maxsize=None)
def category(name: str) -> Set:
    """Characters of a Unicode category (Lu) or group of them (L)."""
    return norm((k, k) for k in range(MAX + 1) if unicodedata.category(chr(k)).startswith(name))


NAME_START = norm([(58, 58), (65, 90), (95, 95), (97, 122), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF), (0x370, 0x37D), (0x37F, 0x1FFF), (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD), (0x10000, 0xEFFFF)])
NAME_CHAR = union(NAME_START, norm([(45, 46), (48, 57), (0xB7, 0xB7), (0x300, 0x36F), (0x203F, 0x2040)]))
SPACE, DIGIT = of(" \t\n\r"), span("0", "9")
