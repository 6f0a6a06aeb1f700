"""Words of many texts at once: where they stand and their hashes, as arrays."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

# An odd factor, so that it has an inverse among numbers of 64 bits, and two for mixing.
FACTOR, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@cache
def characters(kind: str) -> np.ndarray:
    """For every character whether it is of that kind: `word` (letters and digits), `letter` (those but no decimal digit), `space`."""
    test = {"word": str.isalnum, "letter": lambda c: c.isalnum() and not c.isdecimal(), "space": str.isspace}[kind]
    return np.fromiter((test(chr(i)) for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, begins): the characters of all texts, a line break after each, and where each text begins."""
    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1].astype(np.int64)


def word_bounds(codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of characters of that kind; the last character must be none."""
    inside = characters(kind)[codes]
    turns = np.nonzero(np.diff(np.concatenate([[False], inside])))[0]
    return turns[0::2], turns[1::2]


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each word: its characters as the digits of a number, brought to the word's start and mixed."""
    n = len(codes)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(FACTOR, n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(pow(FACTOR, -1, 1 << 64), n)[starts]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
        return h ^ (h >> np.uint64(31))
