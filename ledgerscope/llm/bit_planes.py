"""Hamming neighbours by bit planes.

Fingerprints of a stretch of rows are stored vertically: plane b holds bit b of 64 rows in one word. A query row
is compared with 64 rows at a time: its bit, spread over a word, is exclusive-ored with the plane, and the
differing lanes are added to counters that are themselves bit planes (ones, twos, fours), by carry-save
addition. A lane whose count passes the radius is marked for good; words all of whose lanes are marked are dropped
from the remaining planes.
"""

from __future__ import annotations

import numpy as np

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
CHECK_EVERY = 8


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words): plane b, word w, lane l is bit b of value 64 w + l."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.packbits(bits.reshape(words, 64, BITS), axis=1, bitorder="little")  # words, 8, 64
    return np.ascontiguousarray(lanes.transpose(2, 0, 1)).view("<u8").reshape(BITS, words)


def lane_mask(low: np.ndarray, high: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Lanes of each word whose row numbers lie in [low, high)."""
    a = np.clip(low - word * 64, 0, 64)
    b = np.clip(high - word * 64, 0, 64)
    upto = lambda n: np.where(n == 64, ALL, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    return upto(b) & ~upto(a)


def neighbours(values: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, items: int = 1 << 16):
    """Yields (query rows, found rows): pairs within the radius; query row i is compared with rows low[i]..high[i]-1.

    At most ``items`` (query, word) comparisons are held at once, so memory does not grow with a group.
    """
    if radius > 6:
        raise ValueError("the counters hold up to seven")
    values = values.astype(np.uint64)
    vertical = planes(values)
    asks = np.flatnonzero(high > low)
    first, last = low[asks] // 64, (high[asks] - 1) // 64
    widths = last - first + 1
    ends = np.cumsum(widths)
    at = 0
    total = int(ends[-1]) if len(ends) else 0
    while at < total:
        upto = min(at + items, total)
        number = np.arange(at, upto)
        who = np.searchsorted(ends, number, "right")
        word = first[who] + number - (ends[who] - widths[who])
        row = asks[who]
        yield from _compare(values, vertical, row, word, lane_mask(low[row], high[row], word), radius)
        at = upto


def _compare(values, vertical, row, word, live, radius):
    """One block of (query, word) items: carry-save counting plane by plane, dropping words that are all over."""
    zero = np.zeros(len(row), np.uint64)
    ones, twos, fours, over = zero.copy(), zero.copy(), zero.copy(), ~live
    query = values[row]
    for b in range(BITS):
        spread = np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1))
        carry = vertical[b][word] ^ spread
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        fours, carry = fours ^ carry, fours & carry
        over |= carry
        if b % CHECK_EVERY == CHECK_EVERY - 1:
            over |= beyond(ones, twos, fours, radius)
            keep = np.flatnonzero(over != ALL)
            if len(keep) == 0:
                return
            if len(keep) < 0.8 * len(row):
                row, word, query = row[keep], word[keep], query[keep]
                ones, twos, fours, over = ones[keep], twos[keep], fours[keep], over[keep]
    hits = ~over
    some = np.flatnonzero(hits)
    if len(some):
        lanes = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, lane = np.nonzero(lanes)
        yield row[some[item]], word[some[item]] * 64 + lane


def beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over the radius, by bitwise comparison from the top bit."""
    more, same = np.zeros_like(ones), np.full_like(ones, ALL)
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return more


def spanning(n: int, pairs) -> np.ndarray:
    """Smallest row of each row's connected part, from an iterable of (rows, rows) arrays. Memory follows n and one
    block of pairs."""
    part = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = part[a], part[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = part[part]
                if np.array_equal(up, part):
                    break
                part = up
    return part
