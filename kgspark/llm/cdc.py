"""Content-defined cuts: a rolling hash over a sequence of small integers, computed for all positions at once."""

from __future__ import annotations

import numpy as np

WINDOW = 32


def gear_table(n: int) -> np.ndarray:
    """n fixed pseudo-random 32-bit values (splitmix64 of 0..n-1)."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


def rolling(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each position the sum of table[value j places before] << j over WINDOW places, by doubling the window."""
    h = table[values]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(values: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int, least: int, most: int) -> list[list[int]]:
    """For sequences laid end to end (``ends``: their ends) the chunk ends of each, relative to the sequence's start.

    A cut falls where the top ``bits`` of the rolling hash are 0, ``least`` >= WINDOW items after the last cut, or after
    ``most`` items; so no cut depends on what lies before the sequence, and equal sequences have equal cuts.
    """
    assert least >= WINDOW
    hits = np.flatnonzero(rolling(values, table) >> np.uint32(32 - bits) == 0) + 1 if len(values) >= least else np.empty(0, np.int64)
    found, at, begin = [], 0, 0
    hits = hits.tolist()
    for end in ends.tolist():
        own, last = [], begin
        while at < len(hits) and hits[at] <= begin:
            at += 1
        while at < len(hits) and hits[at] <= end:
            hit = hits[at]
            at += 1
            while hit - last > most:
                last += most
                own.append(last - begin)
            if hit - last >= least:
                last = hit
                own.append(last - begin)
        while end - last > most:
            last += most
            own.append(last - begin)
        if last < end or not own:
            own.append(end - begin)
        found.append(own)
        begin = end
    return found
