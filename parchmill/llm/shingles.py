"""Word shingles of whole texts as hashed sets, and signatures that near-equal sets must share."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers and the finishing steps of a 64-bit mix.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U32 = np.uint64(32)

# Hashes of words are remembered, up to so many.
MEMO_WORDS = 150_000

# A class of set sizes ends at so many times its beginning.
CLASS_RATIO = 1.5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, words: int, memo: WordHashes) -> np.ndarray:
    """The distinct shingles of ``words`` words, hashed and sorted.

    A-Z are lower-cased; words are parted by ASCII white space. A text with
    fewer words is one shingle, one without words has none.
    """
    # Both are what bytes methods do: lower() and split() know ASCII only.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    total = np.full(len(parts) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = mixed(total * _STEP + hashes[i : len(parts) - size + 1 + i])
    return np.unique(total)


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of as many bins as there are tokens, at least: whether it holds an odd number of them.

    Where two sketches differ the sets differ in an element of that bin, so
    there are at least as many such elements as differing bits.
    """
    bins = 64
    while bins < len(tokens):
        bins *= 2
    odd = np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of the same set with half the bins (last axis)."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


class Signatures:
    """Signatures such that two sets whose Jaccard similarity reaches ``percent`` share at least one.

    Sets a <= b with 100 |a & b| >= percent |a | b| differ in at most
    (|a| + |b|) (100 - percent) / (100 + percent) elements. A size class of the
    smaller set has twice as many parts as that; each element falls into one part
    by its hash and can spoil only that part, so all other parts are the same in
    both. A signature is the hash of all elements of one part.

    Parts have an order that depends on what they hold and nothing else. A set
    signs its first ones, one more than may differ: before the first part that
    is the same in both sets, each has only parts that differ, so both sign it.
    First come parts without an element of ``frequent`` (sorted) or with one
    that few sets have (``counts``, as many), of those the ones with the most
    elements that are not frequent; empty parts come last. So sets that share
    only what many sets have, or lack elements in the same part, seldom meet.
    Which elements are frequent decides how many signatures are shared, never
    whether one is.

    A set signs for the class of its size and, as the smaller set may be one
    class below, for that of ``percent`` of its size.
    """

    def __init__(self, percent: int, frequent: np.ndarray | None = None, ratio: float = CLASS_RATIO, counts: np.ndarray | None = None):
        self.percent, self.ratio = percent, ratio
        self.frequent = np.zeros(0, dtype=np.uint64) if frequent is None else frequent
        self.counts = np.ones(len(self.frequent), dtype=np.int64) if counts is None else counts
        self.starts = [1]
        self.parts: list[tuple[int, int]] = []  # of a class: parts, and most that may differ

    def _class_of(self, size: int) -> int:
        while self.starts[-1] <= size:
            start = self.starts[-1]
            end = max(start + 1, int(np.ceil(start * self.ratio)))
            small = end - 1
            differ = (small + small * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
            self.parts.append((2 * differ + 1, differ))
            self.starts.append(end)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def _common(self, tokens: np.ndarray) -> np.ndarray:
        """The count of each token that is frequent, 0 for others."""
        if not len(self.frequent):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, self.counts[at], 0)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if len(tokens) == 0:
            return np.zeros(0, dtype=np.uint64)
        weights, common = mixed(tokens + _STEP), self._common(tokens)
        rare = (common == 0).astype(np.int64)
        smaller = -(-len(tokens) * self.percent // 100)
        out = []
        for size_class in {self._class_of(len(tokens)), self._class_of(smaller)}:
            parts, differ = self.parts[size_class]
            part = ((tokens >> _U32) * np.uint64(parts)) >> _U32  # ascending, as the tokens are
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            salt = np.uint64(size_class << 40)
            signed = mixed(np.add.reduceat(weights, first) ^ mixed(part[first] + salt))
            order = np.lexsort((signed, -np.add.reduceat(rare, first), np.minimum.reduceat(common, first)))
            out.append(signed[order[: differ + 1]])
            if len(signed) <= differ:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                out.append(np.sort(mixed(mixed(empty + salt) + np.uint64(1)))[: differ + 1 - len(signed)])
        return np.concatenate(out)
