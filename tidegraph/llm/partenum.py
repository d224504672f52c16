"""PartEnum signatures of shingle sets, in NumPy.

Sets are sorted arrays of 64-bit hashes. For a Jaccard similarity of at least
``NUM / DEN`` two sets of sizes a <= b differ in at most
(a + b) * (DEN - NUM) / (DEN + NUM) elements. Sizes are cut into bands in which
the largest size is at most DEN / NUM times the smallest, so a pair lies in one
band or in two neighbouring ones; each set takes part in the instance of its
own band and in that of the next.

An instance for sizes up to r allows k = 2 r (DEN - NUM) / (DEN + NUM)
differences. It has two levels. The hash domain is partitioned into
n1 = (k + 1) / 2 ranges, rounded up: k differences leave at least one of them
with one difference at most. Each range is partitioned again into ``PARTS``
second-level ranges, and all subsets of ``PARTS - 1`` of these are enumerated: one
difference leaves at least one subset untouched. The content of a subset is a
signature, so a similar pair shares one. Subsets without an element say nothing
and have none. Where that could hide a pair (sets of up to ``SMALL`` elements with
an empty subset), the elements that come first in hash order, as many as can
differ plus one, are signatures too: a similar pair shares one of these for
certain. Above ``SMALL`` the chance that all untouched subsets of a pair are empty
is below 1e-15, unless frequent elements were left out of half the set; then the
same elements are signatures there too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tidegraph.llm.common import WordHashes, mix64

NUM, DEN, WORDS, SMALL, PARTS = 3, 4, 5, 256, 3
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run."""
    if not text:
        return np.zeros(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return np.zeros(0, np.uint64)
    h = memo.of(tokens)
    n = min(words, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _ODD
        out += h[i : len(h) - n + 1 + i]
    return np.unique(mix64(out + np.uint64(n)))


@lru_cache(maxsize=1)
def bands() -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band."""
    first, last = [], []
    size = 1
    while size < 1 << 40:
        first.append(size)
        last.append(size * DEN // NUM)
        size = last[-1] + 1
    return np.array(first), np.array(last)


def first_level(band: int) -> int:
    """Ranges of the first level of an instance."""
    k = 2 * int(bands()[1][band]) * (DEN - NUM) // (DEN + NUM)
    return (k + 2) // 2


@lru_cache(maxsize=512)
def ranges(band: int) -> np.ndarray:
    """Starts of the second-level hash ranges of an instance, ``PARTS`` for each of the first level."""
    n = first_level(band) * PARTS
    return np.arange(n, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // n)


def band_of(size: int) -> int:
    return int(np.searchsorted(bands()[0], size, "right")) - 1


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements in as many cells as the set has elements, to the next power of two, 64 at least.

    One differing element flips one parity, so the parities of two sets differ in
    no more cells than the sets in elements: a lower bound, never a guess. A
    sketch is folded to half its width by the exclusive or of its halves.
    """
    width = max(64, 1 << int(len(s) - 1).bit_length()) if len(s) else 64
    cells = np.bincount((mix64(s + _ODD2) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<u8")


def fold(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def signatures(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a non-empty set, and the instance of each: its band, or -1 for elements.

    ``frequent`` (sorted) are elements that very many sets hold. Leaving them out
    of the ranges keeps every bound, because sets cannot differ more without
    them; it only keeps sets apart that share nothing else. Where few other
    elements are left, the elements that come first are signatures as above, the
    frequent ones last in order.
    """
    band = band_of(len(s))
    rare = s
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        known = frequent[at] == s
        if known.any():
            rare = s[~known]
    total = np.zeros(len(rare) + 1, np.uint64)
    np.cumsum(mix64(rare ^ _ODD2), out=total[1:])
    out, instances, empty = [], [], False
    for b in (band, band + 1):
        starts = ranges(b)
        at = np.append(np.searchsorted(rare, starts), len(rare))
        sums, sizes = np.diff(total[at]).reshape(-1, PARTS), np.diff(at).reshape(-1, PARTS)
        # each subset leaves one second-level range out
        content = (sums.sum(axis=1, dtype=np.uint64)[:, None] - sums).ravel()
        full = np.flatnonzero((sizes.sum(axis=1)[:, None] - sizes).ravel())
        empty = empty or len(full) < len(starts)
        salt = np.uint64((b + 1) * int(_ODD2) % (1 << 64))
        out.append(mix64(content[full] + (full.astype(np.uint64) + np.uint64(1)) * _ODD + salt))
        instances.append(np.full(len(full), b, np.int64))
    if empty and (len(s) <= SMALL or len(rare) * 2 < len(s)):
        first = len(s) - -(-len(s) * NUM // DEN) + 1
        order = rare if len(rare) >= first else np.concatenate([rare, s[known]])
        out.append(mix64(order[:first] + _ODD))
        instances.append(np.full(min(first, len(order)), -1, np.int64))
    return np.concatenate(out), np.concatenate(instances)
