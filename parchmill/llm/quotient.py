"""Counting quotient filters over packed pairs of integers, built and merged in sorted order.

A key is a pair (left, right) of unsigned integers of up to 64 bits each. An
invertible permutation scatters keys evenly; the top bits of the permuted left
half name a range and, below them, the quotient. What remains of both halves is
kept in full, so a filter loses nothing: keys come back by inverting.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_HEAD = "<QBBQ"
_BIG = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _scatter(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(salt)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network: each round changes one half by a function of the other."""
    for i, salt in enumerate(_ROUNDS):
        if i % 2 == 0:
            left = left ^ (_scatter(right, salt) & _mask(left_bits))
        else:
            right = right ^ (_scatter(left, salt) & _mask(right_bits))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray]:
    for i, salt in reversed(list(enumerate(_ROUNDS))):
        if i % 2 == 0:
            left = left ^ (_scatter(right, salt) & _mask(left_bits))
        else:
            right = right ^ (_scatter(left, salt) & _mask(right_bits))
    return left, right


def tally(
    left: np.ndarray, right: np.ndarray, counts: np.ndarray, left_bits: int, right_bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if left_bits + right_bits <= 64:
        key = (left << np.uint64(right_bits)) | right if right_bits < 64 else right
        order = np.argsort(key)
    else:
        order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    starts = np.flatnonzero(new)
    return left[starts], right[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _bytes(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` of each value, in whole bytes."""
    return values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, : -(-bits // 8)].tobytes()


def _values(data: bytes, n: int, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    wide = np.zeros((n, 8), np.uint8)
    if width:
        wide[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return wide.view("<u8").reshape(n)


def _slots(rest: np.ndarray, right: np.ndarray, rest_bits: int, right_bits: int) -> list[tuple[np.ndarray, int]]:
    """What remains of both halves: as one number where 64 bits hold it."""
    if rest_bits + right_bits <= 64 and right_bits < 64:
        return [((rest << np.uint64(right_bits)) | right, rest_bits + right_bits)]
    return [(rest, rest_bits), (right, right_bits)]


def build(left: np.ndarray, right: np.ndarray, counts: np.ndarray, left_bits: int, right_bits: int, range_bits: int) -> bytes:
    """A filter of distinct permuted keys in order, all with the same top ``range_bits`` of the left half.

    Slots hold what remains of a key. A bit per quotient says whether it occurs,
    a bit per slot whether it is the last one of its quotient, and another one
    whether the key occurs once. The counts of the others follow, a byte each,
    then those of 255 and more in full.
    """
    n = len(left)
    quotient_bits = min(left_bits - range_bits, max(0, (n - 1).bit_length()))
    rest_bits = left_bits - range_bits - quotient_bits
    quotient = (left >> np.uint64(rest_bits)) & _mask(quotient_bits) if rest_bits < 64 else np.zeros(n, np.uint64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    run_end = np.ones(n, bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    once = counts == 1
    place = int(left[0] >> np.uint64(left_bits - range_bits)) if range_bits and n else 0
    return b"".join([
        struct.pack(_HEAD, n, range_bits, quotient_bits, place),
        np.packbits(occupied).tobytes(),
        np.packbits(run_end).tobytes(),
        np.packbits(once).tobytes(),
        *(_bytes(part, bits) for part, bits in _slots(left & _mask(rest_bits), right, rest_bits, right_bits)),
        np.minimum(counts[~once], _BIG).astype(np.uint8).tobytes(),
        counts[counts >= _BIG].astype("<u8").tobytes(),
    ])


def read(data: bytes, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The permuted keys of a filter in order, and their counts."""
    n, range_bits, quotient_bits, place = struct.unpack_from(_HEAD, data)
    rest_bits = left_bits - range_bits - quotient_bits
    at = struct.calcsize(_HEAD)

    def piece(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    occupied = np.unpackbits(np.frombuffer(piece(-(-(1 << quotient_bits) // 8)), np.uint8), count=1 << quotient_bits)
    run_end = np.unpackbits(np.frombuffer(piece(-(-n // 8)), np.uint8), count=n)
    run = np.cumsum(run_end) - run_end
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    once = np.unpackbits(np.frombuffer(piece(-(-n // 8)), np.uint8), count=n).astype(bool)

    def values(bits: int) -> np.ndarray:
        return _values(piece(n * -(-bits // 8)), n, bits)

    if rest_bits + right_bits <= 64 and right_bits < 64:
        both = values(rest_bits + right_bits)
        left, right = both >> np.uint64(right_bits), both & _mask(right_bits)
    else:
        left, right = values(rest_bits), values(right_bits)
    if quotient_bits:
        left |= quotient << np.uint64(rest_bits)
    if range_bits:
        left |= np.uint64(place) << np.uint64(left_bits - range_bits)
    counts = np.ones(n, np.int64)
    several = np.flatnonzero(~once)
    if len(several):
        counts[several] = np.frombuffer(piece(len(several)), np.uint8)
    big = np.flatnonzero(counts == _BIG)
    if len(big):
        counts[big] = np.frombuffer(data, "<u8", len(big), at).astype(np.int64)
    return left, right, counts


def split(
    left: np.ndarray, right: np.ndarray, counts: np.ndarray, left_bits: int, right_bits: int, range_bits: int
) -> list[tuple[int, bytes]]:
    """Keys in order as one filter per range of their top ``range_bits``."""
    if not len(left):
        return []
    if not range_bits:
        return [(0, build(left, right, counts, left_bits, right_bits, 0))]
    ranges = left >> np.uint64(left_bits - range_bits)
    starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]).tolist()
    parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(left)], strict=True)]
    return [
        (int(ranges[p.start]), build(left[p], right[p], counts[p], left_bits, right_bits, range_bits)) for p in parts
    ]


def merge(filters: Iterable[bytes], left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of several filters in order, their counts added."""
    parts = [read(f, left_bits, right_bits) for f in filters]
    left, right, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    return tally(left, right, counts, left_bits, right_bits)
