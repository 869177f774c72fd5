"""Words of a batch of texts as hashes, and a table from short byte strings to ids: all of a batch at once, without a Python
object for each word."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: The end of a text; no word holds white space. Bytes that are looked at together; the longest word whose bytes are the key.
END = b"\n"
SEGMENT, KEPT = 1 << 20, 32
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NEXT = re.compile(rb"[ \t\n\x0b\x0c\r]")
_ENDED = np.uint64(xxhash.xxh3_64_intdigest(END))


def eights(b: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from it on, as one number."""
    v = b.astype(np.uint64)
    for k in (1, 2, 4):
        v[:-k] |= v[k:] << np.uint64(8 * k)
    return v


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of raw begins, and its hash: of words up to KEPT bytes a mix of these, of others xxh3."""
    b = np.frombuffer(raw + bytes(KEPT + 8), np.uint8)
    edge = np.diff(np.concatenate([[False], ~_SPACE[b[: len(raw)]], [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    v = eights(b)
    h = size.astype(np.uint64) * _FACTORS[3]
    for j, factor in enumerate(_FACTORS):
        h = (h ^ v[np.minimum(begin + 8 * j, len(raw))] & _MASK[np.clip(size - 8 * j, 0, 8)]) * factor
        h ^= h >> np.uint64(31)
    for i in np.flatnonzero(size > KEPT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]])
    return begin, h


def hashed(texts: list[str], ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row (A-Z in lower case), after each text, if ``ended``, that of END; and where each
    text's begin. Bounded memory for long texts."""
    raw = "\n".join(texts).encode().lower()
    begins, hashes, at = [], [], 0
    while at < len(raw):
        m = _NEXT.search(raw, at + SEGMENT) if len(raw) - at > SEGMENT else None
        end = m.start() if m else len(raw)
        if end - at > 8 * SEGMENT:  # a word of megabytes among others
            for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw[at:end]):
                begins.append(np.array([at + m.start()]))
                hashes.append(_hashes(m[0])[1] if len(m[0]) <= KEPT else np.array([xxhash.xxh3_64_intdigest(m[0])], np.uint64))
        else:
            begin, h = _hashes(raw[at:end])
            begins.append(begin + at)
            hashes.append(h)
        at = max(end, at + 1)
    begin, h = (np.concatenate([np.empty(0, t), *x]) for x, t in ((begins, np.int64), (hashes, np.uint64)))
    last = np.cumsum([len(t.encode()) + 1 for t in texts])  # where the next text begins
    ends = np.searchsorted(begin, last)
    if not ended:
        return h, np.concatenate([[0], ends[:-1]])
    out = np.full(len(h) + len(texts), _ENDED, np.uint64)
    out[np.arange(len(h)) + np.searchsorted(last, begin, "right")] = h
    return out, np.concatenate([[0], ends[:-1]]) + np.arange(len(texts))


class Table:
    """From byte strings of KEPT bytes at most, none with a byte 0, to arrays of ids; of bounded size, two places for each."""

    def __init__(self, dtype: np.dtype, slots: int, most: int):
        self.dtype, self.slots, self.most = dtype, slots, most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros((self.slots, KEPT // 8), np.uint64)
        self.first, self.count = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.pool, self.used = np.empty(1 << 18, self.dtype), 0

    def look(self, b: np.ndarray, begin: np.ndarray, size: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each string of b (KEPT + 8 bytes longer than they reach) begin, and how many they are.
        encode(places) gives the ids, as bytes, of those that the table doesn't hold and those that are too long for it, once each
        for equal ones of the former."""
        if self.used > self.most:
            self.forget()
        v = eights(b)
        keys, h = np.empty((len(begin), KEPT // 8), np.uint64), np.zeros(len(begin), np.uint64)
        for j, factor in enumerate(_FACTORS):
            keys[:, j] = v[np.minimum(begin + 8 * j, len(b) - 8)] & _MASK[np.clip(size - 8 * j, 0, 8)]
            h = (h ^ keys[:, j]) * factor
            h ^= h >> np.uint64(31)
        del v
        first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        long = np.flatnonzero(size > KEPT)
        if len(long):
            first[long], count[long] = self._add(encode(long))
        left = np.flatnonzero(size <= KEPT)
        for shift in (0, 40):
            at = (h[left] >> np.uint64(shift) & np.uint64(self.slots - 1)).astype(np.int64)
            held = self.keys[at]
            hit = held[:, 0] == keys[left, 0]
            for j in range(1, keys.shape[1]):
                hit &= held[:, j] == keys[left, j]
            first[left[hit]], count[left[hit]] = self.first[at[hit]], self.count[at[hit]]
            left = left[~hit]
        if len(left):
            _, one, of = np.unique(h[left], return_index=True, return_inverse=True)
            one = left[one]
            if not np.array_equal(keys[one][of], keys[left]):  # two strings of one hash
                one, of = left, np.arange(len(left))
            a, n = self._add(encode(one))
            self._put(keys[one], h[one], a, n)
            first[left], count[left] = a[of], n[of]
        return first, count

    def _add(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        count = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        new = np.frombuffer(b"".join(ids), self.dtype)
        end = self.used + len(new)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(end, self.used) - self.used + len(new), self.dtype)])
        self.pool[self.used : end] = new
        first = self.used + np.cumsum(count) - count
        self.used = end
        return first, count

    def _put(self, keys: np.ndarray, h: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        free = self.keys[at, 0] == 0  # no string begins with a byte 0
        for some, to in ((np.flatnonzero(free), at), (np.flatnonzero(~free), (h >> np.uint64(40) & np.uint64(self.slots - 1)).astype(np.int64))):
            some = some[np.unique(to[some], return_index=True)[1]]  # one to a place
            self.keys[to[some]], self.first[to[some]], self.count[to[some]] = keys[some], first[some], count[some]

    def gathered(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of all strings in a row."""
        total = np.cumsum(count)
        return self.pool[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
