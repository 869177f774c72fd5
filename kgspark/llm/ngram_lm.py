"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted hash arrays that workers map.

Counting: a word is its 64-bit hash, its id the hash's rank among all. Each task reduces its n-grams to sorted rows of ids with
counts, cut by a hash of the context (of the whole bigram at the lowest order) into buckets; a bucket's parts are merged in one
task, which stores the n-grams and the sums of their contexts and hands the number of different words before each shorter n-gram
down to the next order's buckets. Words' own sums are gathered by ranges of ids. So no word or n-gram, however frequent, gathers rows.

Files under the model's path: ``words-B`` (sorted hashes, counts), ``gram-N-B`` (sorted hashes of n-grams, counts), ``back-N-B`` (the
same of contexts, with the sums after them) and ``context-B`` (the sums of a range of ids). Hashes of n-grams are cut: within a
bucket an index by the first bits, some six n-grams to an entry, and 24 bits more of each, so that an n-gram never seen is taken
for a seen one at a rate of 4e-7 at any size. Words keep all 64 bits.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_remainder, mapped_bytes, scratch, shared_dir, slices, write_bytes, written
from .words import END, hashed

MOD, HELD_OUT = 5, 1
#: Words of the longest n-gram. Tokens of a bucket, about; n-grams that a task holds before it writes; files that a worker maps.
ORDER, BUCKET, HELD, MAPPED = 3, 2_000_000, 2_000_000, 20_000
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def tokens(text: str) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case, then END."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of rows of ids."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _FACTORS[0]
        h = (h ^ h >> np.uint64(29)) * _FACTORS[1]
        h ^= h >> np.uint64(32)
    return h


# --- rows of ids with counts, as they go from task to task ---


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Rows in lexicographic order."""
    keys = list(columns)
    if keys[0].itemsize == 4:
        keys = [a.astype(np.uint64) << np.uint64(32) | b for a, b in zip(keys[len(keys) % 2 :: 2], keys[len(keys) % 2 + 1 :: 2])]
        keys = [*columns[: len(columns) % 2], *keys]
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = _order(columns)
    columns, counts = [c[order] for c in columns], counts[order]
    first = _starts(columns)
    return [c[first] for c in columns], np.add.reduceat(counts, first) if len(first) else counts


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted rows, the first column as differences, bytes of one rank side by side, compressed."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    data = b"".join(map(_planes, [first, *columns[1:], counts.astype("<u8")]))
    return struct.pack("<BBI", len(columns), columns[0].itemsize, len(counts)) + zstandard.compress(data, 1)


def _unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, item, m = struct.unpack_from("<BBI", data)
    raw, at, out = np.frombuffer(zstandard.decompress(data[6:]), np.uint8), 0, []
    for k in range(n + 1):
        width = item if k < n else 8
        out.append(np.ascontiguousarray(raw[at : at + width * m].reshape(width, m).T).view(f"<u{width}").ravel())
        at += width * m
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out[:-1], out[-1].astype(np.int64)


def _merged(parts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    rows = [_unpacked(p) for p in parts]
    return _summed([np.concatenate(c) for c in zip(*(c for c, _ in rows))], np.concatenate([n for _, n in rows]))


def _runs(by: np.ndarray):
    """(value, positions in order) of each value of ``by``."""
    order = np.argsort(by, kind="stable")
    first = np.flatnonzero(np.diff(by[order], prepend=np.int64(-9)))
    for a, b in zip(first, np.append(first[1:], len(by))):
        yield int(by[order[a]]), order[a:b]


def _dealt(columns: list[np.ndarray], counts: np.ndarray, by: np.ndarray) -> dict:
    """Rows (bucket, data) of sorted rows, dealt by ``by``."""
    out = {"bucket": [], "data": []}
    for b, at in _runs(by):
        out["bucket"].append(b)
        out["data"].append(_packed([c[at] for c in columns], counts[at]))
    return out


ROWS = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
_ROWS = "bucket long, data binary"


# --- files: arrays one after another, after their sizes ---


def _write(uri: str, arrays: list[np.ndarray]) -> None:
    parts = [np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()]
    for a in arrays:
        parts.append(a.tobytes() + bytes(-a.nbytes % 8))
    write_bytes(uri, b"".join(parts))


def _read(uri: str, kinds: list[str]) -> list[np.ndarray]:
    raw = mapped_bytes(uri)
    sizes = np.frombuffer(raw, "<i8", 1 + len(kinds))[1:].tolist()
    at, out = 8 * (1 + len(kinds)), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size + -size % 8
    return out


def _column(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """values in 4 or 8 bits, and the places and values of those that need more."""
    most = (1 << bits) - 1
    small, odd = np.minimum(values, most).astype("u1"), np.flatnonzero(values >= most)
    if bits == 4:
        small = np.append(small, np.zeros(len(small) % 2, "u1"))
        small = small[::2] | small[1::2] << 4
    return [small, odd.astype("<u4"), values[odd].astype("<i8")]


def _values(column: list[np.ndarray], at: np.ndarray, bits: int) -> np.ndarray:
    small, odd, values = column
    out = ((small[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15 if bits == 4 else small[at]).astype(np.int64)
    more = np.flatnonzero(out == (1 << bits) - 1)
    if len(more):
        out[more] = values[np.searchsorted(odd, at[more])]
    return out


def _keys(keys: np.ndarray, skip: int) -> list[np.ndarray]:
    """Sorted distinct keys, whose first ``skip`` bits are alike: an index by the bits that follow, and the 24 bits after those."""
    q = max(1, (len(keys) // 6).bit_length())
    x = keys << np.uint64(skip)
    first = np.searchsorted(x >> np.uint64(64 - q), np.arange((1 << q) + 1, dtype=np.uint64)).astype("<u4")
    rest = (x << np.uint64(q)) >> np.uint64(40)
    return [first, rest.astype("<u2"), (rest >> np.uint64(16)).astype("u1")]


def _find(index: list[np.ndarray], keys: np.ndarray, skip: int) -> np.ndarray:
    """The place of each key, -1 if it isn't there."""
    first, low, high = index
    q = len(first).bit_length() - 1
    x = keys << np.uint64(skip)
    part, rest = (x >> np.uint64(64 - q)).astype(np.int64), ((x << np.uint64(q)) >> np.uint64(40)).astype(np.uint32)
    at, end, out = first[part].astype(np.int64), first[part + 1].astype(np.int64), np.full(len(keys), -1, np.int64)
    left = np.flatnonzero(at < end)
    while len(left):
        here = at[left]
        hit = low[here] | high[here].astype(np.uint32) << np.uint32(16)
        hit = hit == rest[left]
        out[left[hit]] = here[hit]
        at[left] += 1
        left = left[~hit]
        left = left[at[left] < end[left]]
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each run of values their sum and how many are 1, 2 and more."""
    return [np.add.reduceat(x.astype(np.int64), first) for x in (values, values == 1, values == 2, values >= 3)]


def _coded(sums: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of four sums: a code of the 255 most frequent rows of small ones, and the places and sums of the others."""
    small = np.logical_and.reduce([s < 256 for s in sums])
    key = sum(np.minimum(s, 255) << 8 * k for k, s in enumerate(sums))
    kinds, at, n = np.unique(np.where(small, key, -1), return_inverse=True, return_counts=True)
    n[kinds < 0] = 0
    known = np.argsort(-n, kind="stable")[:255]
    known = known[n[known] > 0]
    code = np.full(len(kinds), 255, "u1")
    code[known] = np.arange(len(known))
    codes = code[at]
    odd = np.flatnonzero(codes == 255)
    return [codes, kinds[known].astype("<i8"), odd.astype("<u4"), np.column_stack([s[odd] for s in sums]).astype("<i8").ravel()]


def _decoded(columns: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    codes, kinds, odd, rows = columns
    own = codes[at]
    key = np.append(kinds, 0)[np.minimum(own, len(kinds))]
    out = np.column_stack([key >> 8 * k & 255 for k in range(4)])
    more = np.flatnonzero(own == 255)
    if len(more):
        out[more] = rows.reshape(-1, 4)[np.searchsorted(odd, at[more])]
    return out


class Model:
    """Where a model is and its few numbers; opens its files in the worker that uses it."""

    def __init__(self, path: str, bits: int, order: int):
        self.path, self.bits, self.order, self.open = path, bits, order, {}
        self.bases = np.zeros((1 << bits) + 1, np.int64)
        self.held = {n: np.zeros(1 << bits, bool) for n in range(2, order + 1)}  # buckets that have n-grams
        self.n_tokens, self.discounts, self.kinds, self.rest = 0, {n: [0.0] * 4 for n in range(1, order + 1)}, 0, 1.0

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    @property
    def n_words(self) -> int:
        """Also the id of the start of a text."""
        return int(self.bases[-1])

    def file(self, name: str, kinds: list[str]) -> list[np.ndarray]:
        if name not in self.open:
            if len(self.open) >= MAPPED:
                self.open.clear()
            self.open[name] = _read(f"{self.path}/{name}", kinds)
        return self.open[name]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id (-1: unknown) and the count of each word, given by hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for b, at in _runs((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.bases[b + 1] > self.bases[b]:
                own, *column = self.file(f"words-{b}", ["<u8", "u1", "<u4", "<i8"])
                i = np.minimum(np.searchsorted(own, hashes[at]), len(own) - 1)
                hit = own[i] == hashes[at]
                ids[at[hit]] = i[hit] + self.bases[b]
                counts[at[hit]] = _values(column, i[hit], 8)
        return ids, counts

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Of each id the sums of what follows it (values, how many of 1, 2, more) and the kinds of words before it; of unknown ids 0."""
        out = np.zeros((len(ids), 5), np.int64)
        part = np.where(ids < 0, -1, np.searchsorted(self.bases, ids, "right") - 1)
        for p, at in _runs(part):
            if p >= 0 and self.n_tokens:
                columns = self.file(f"context-{p}", ["u1", "<u4", "<i8"] * 5)
                for k in range(5):
                    out[at, k] = _values(columns[3 * k : 3 * k + 3], ids[at] - self.bases[p], 8)
        return out

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        """The bucket of n-grams: by their contexts, of bigrams by themselves."""
        return (gram_key(columns[:-1] if len(columns) > 2 else columns) >> np.uint64(64 - self.bits)).astype(np.int64)

    def values(self, columns: list[np.ndarray]) -> np.ndarray:
        """The count of each n-gram, or, of shorter ones than the longest, the number of different words before it."""
        n, out, keys = len(columns), np.zeros(len(columns[0]), np.int64), gram_key(columns)
        for b, at in _runs(self.bucket(columns)):
            if not self.held[n][b]:
                continue
            *index, small, odd, more = self.file(f"gram-{n}-{b}", ["<u4", "<u2", "u1", "u1", "<u4", "<i8"])
            i = _find(index, keys[at], self.bits if n == 2 else 0)
            out[at[i >= 0]] = _values([small, odd, more], i[i >= 0], 4)
        return out

    def sums(self, columns: list[np.ndarray]) -> np.ndarray:
        """The sums after each context of two words or more."""
        n, keys = len(columns) + 1, gram_key(columns)
        out = np.zeros((len(keys), 4), np.int64)
        for b, at in _runs((keys >> np.uint64(64 - self.bits)).astype(np.int64)):
            if not self.held[n][b]:
                continue
            *index, codes, kinds, odd, rows = self.file(f"back-{n}-{b}", ["<u4", "<u2", "u1", "u1", "<i8", "<u4", "<i8"])
            i = _find(index, keys[at], self.bits)
            out[at[i >= 0]] = _decoded([codes, kinds, odd, rows], i[i >= 0])
        return out


def _columns(ids: np.ndarray, place: np.ndarray, n: int, start: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The tokens with n - 1 ids before them, the text's start counted, and the n-grams that end in them."""
    at = np.flatnonzero(place >= n - 2)
    columns = [np.where(place[at] >= k, ids[at - np.minimum(k, place[at])], start) for k in range(n - 1, 0, -1)]
    return at, [*columns, ids[at]]


def _places(firsts: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))


def discounts(n: list[int]) -> list[float]:
    """The modified discounts of counts 0, 1, 2 and 3 or more from the numbers of items seen once to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def _of_counts(values: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(values == k) for k in (1, 2, 3, 4)] + [np.count_nonzero(values >= 3), len(values)], "<i8")


def train(texts: DataFrame, path: str, order: int = ORDER) -> Model:
    """Counts the model on texts (doc_id, text; no nulls) and stores it at path, in the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(5, math.ceil(math.log2(size / 6 / BUCKET + 1)))
    model = Model(path, bits, order)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flushed():
            columns, counts = _summed([np.concatenate([k for k, _ in held])], np.concatenate([c for _, c in held]))
            return pa.RecordBatch.from_pydict(_dealt(columns, counts, (columns[0] >> np.uint64(64 - bits)).astype(np.int64)), ROWS)

        for batch in slices(batches):
            held.append(np.unique(hashed(batch.column(1).to_pylist())[0], return_counts=True))
            n += len(held[-1][0])
            if n > 2 * HELD:
                yield flushed()
                held, n = [], 0
        if held:
            yield flushed()

    def store_words(key: tuple, table: pa.Table) -> pa.Table:
        (keys,), counts = _merged(table["data"].to_pylist())
        b = key[0].as_py()
        _write(f"{path}/words-{b}", [keys, *_column(counts, 8)])
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [int(counts.sum())]})

    rows = texts.mapInArrow(words, _ROWS).groupBy("bucket").applyInArrow(store_words, "bucket long, n long, total long").collect()  # a row for each bucket
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["n"]
    model.bases = np.concatenate([[0], np.cumsum(sizes)])
    model.n_tokens = sum(r["total"] for r in rows)
    if not rows:
        return model
    item = np.dtype("<u4" if model.n_words < (1 << 32) - 1 else "<u8")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0

        def flushed():
            for parts in held.values():
                columns = [np.concatenate(c) for c in zip(*parts)]
                columns, counts = _summed(columns, np.ones(len(columns[0]), np.int64))
                yield pa.RecordBatch.from_pydict(_dealt(columns, counts, model.bucket(columns)), ROWS)

        for batch in slices(batches):
            h, firsts = hashed(batch.column(1).to_pylist())
            kinds, at = np.unique(h, return_inverse=True)
            ids, place = model.word_ids(kinds)[0][at], _places(firsts, len(h))
            for k in range(2, order + 1):  # shorter ones at a text's start only
                ends, columns = _columns(ids, place, k, model.n_words)
                some = slice(None) if k == order else place[ends] == k - 2
                held.setdefault(k, []).append([c[some].astype(item) for c in columns])
            n += len(h)
            if n > HELD:
                yield from flushed()
                held, n = {}, 0
        yield from flushed()

    def store_grams(k: int):
        def store(key: tuple, table: pa.Table) -> pa.Table:
            b, parts = key[0].as_py(), table["data"].to_pylist()
            if b < 0:  # numbers of an order done
                return table
            mine = [p for p in parts if p[0] == k]
            out = {"bucket": [b] * (len(parts) - len(mine)), "data": [p for p in parts if p[0] != k]}
            if not mine:
                return pa.table(out, schema=ROWS)
            columns, values = _merged(mine)
            del mine, parts
            keys = gram_key(columns)
            by = np.argsort(keys)
            _write(f"{path}/gram-{k}-{b}", [*_keys(keys[by], bits if k == 2 else 0), *_column(values[by], 4)])
            out["bucket"].append(-k)
            out["data"].append(np.append(_of_counts(values), b).tobytes())
            if k > 2:
                first = _starts(columns[:-1])
                keys = gram_key([c[first] for c in columns[:-1]])
                by = np.argsort(keys)
                _write(f"{path}/back-{k}-{b}", [*_keys(keys[by], bits), *_coded([s[by] for s in _sums(values, first)])])
                columns, counts = _summed(columns[1:], np.ones(len(values), np.int64))
                told = _dealt(columns, counts, model.bucket(columns))
            else:  # sums of words: after them, and kinds before them
                first = _starts(columns[:1])
                after, befores = columns[0][first].astype(np.int64), np.unique(columns[1], return_counts=True)
                ids = np.union1d(after, befores[0].astype(np.int64))
                sums = np.zeros((5, len(ids)), np.int64)
                sums[:4, np.searchsorted(ids, after)] = _sums(values, first)
                sums[4, np.searchsorted(ids, befores[0])] = befores[1]
                told = {"bucket": [], "data": []}
                for part, at in _runs(np.searchsorted(model.bases, ids, "right") - 1):
                    told["bucket"].append(part)
                    told["data"].append(zstandard.compress(b"".join(_planes(np.ascontiguousarray(x[at]).astype("<i8")) for x in (ids, *sums)), 1))
            return pa.table({c: out[c] + told[c] for c in out}, schema=ROWS)

        return store

    rows = texts.mapInArrow(grams, _ROWS)
    for k in range(order, 1, -1):
        rows = rows.groupBy("bucket").applyInArrow(store_grams(k), _ROWS)
    sums = written(rows, "sums")

    def store_contexts(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        base = int(model.bases[p])
        out = np.zeros((5, int(model.bases[p + 1]) - base if p < 1 << bits else 1), np.int64)
        for data in table["data"].to_pylist():
            raw = np.frombuffer(zstandard.decompress(data), np.uint8)
            ids, *own = (np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel() for x in raw.reshape(6, -1))
            out[:, ids - base] += own
        _write(f"{path}/context-{p}", [x for row in out for x in _column(row, 8)])
        return pa.table({"n": [_of_counts(out[4]).tolist()]})

    told: dict[int, np.ndarray] = {}
    for r in sums.where("bucket < 0").collect():  # a row for each bucket and order
        *n, b = np.frombuffer(r["data"], "<i8")
        told[-r["bucket"]] = told.get(-r["bucket"], 0) + np.array(n)
        model.held[-r["bucket"]][b] = True
    for k, n in told.items():
        model.discounts[k] = discounts(n[:4].tolist())
    model.kinds = int(told[2][5])
    kinds = sums.where("bucket >= 0").groupBy("bucket").applyInArrow(store_contexts, "n array<long>").collect()  # a row for each range
    n = np.sum([r["n"] for r in kinds], axis=0).tolist()
    d = model.discounts[1] = discounts(n[:4])
    model.rest = (d[1] * n[0] + d[2] * n[1] + d[3] * n[4]) / model.kinds
    return model


def probabilities(model: Model, ids: np.ndarray, firsts: np.ndarray, kinds: np.ndarray, of: np.ndarray) -> np.ndarray:
    """P(token | tokens before it in its text) of each token; kinds: the distinct ids (the start of a text the last), of: each
    token's place among them."""
    after = model.contexts(kinds)
    d = np.array(model.discounts[1])
    before = after[of, 4]
    p = np.maximum(before - d[np.minimum(before, 3)], 0) / max(1, model.kinds) + model.rest / (model.n_words + 1)
    place = _places(firsts, len(ids))
    for n in range(2, model.order + 1):
        at, columns = _columns(ids, place, n, model.n_words)
        if n == 2:
            sums = after[np.where(place > 0, of[np.maximum(np.arange(len(of)) - 1, 0)], len(kinds) - 1)][:, :4]
        else:
            known = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in columns[:-1]]))
            sums = np.zeros((len(at), 4), np.int64)
            sums[known] = model.sums([c[known] for c in columns[:-1]])
        some = np.flatnonzero(sums[:, 0] > 0)
        at, sums, columns = at[some], sums[some], [c[some] for c in columns]
        values, d = np.zeros(len(at), np.int64), np.array(model.discounts[n])
        known = np.flatnonzero(columns[-1] >= 0)
        values[known] = model.values([c[known] for c in columns])
        p[at] = (np.maximum(values - d[np.minimum(values, 3)], 0) + sums[:, 1:] @ d[1:] * p[at]) / sums[:, 0]
    return p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text; no null texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, firsts = hashed(batch.column(1).to_pylist())
            kinds, of = np.unique(h, return_inverse=True)
            ids, counts = model.word_ids(kinds)
            counts = counts[of]
            base = np.log10((counts + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
            own = np.log10(probabilities(model, ids[of], firsts, np.append(ids, model.n_words), of))
            n = np.diff(np.append(firsts, len(h)))
            cols = [pa.array(n, pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), firsts)), pa.array(np.full(len(n), model.n_tokens, np.int64)), pa.array(np.add.reduceat(base, firsts)), pa.array(np.add.reduceat(own, firsts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each whole text of docs.

    The model learns from the rows whose crc32(doc_id as text) mod MOD is not HELD_OUT. A null or empty text is the end alone; a
    null doc_id counts as the empty text for crc32 and stays null; rows that repeat a doc_id all count. Without rows to learn
    from every word is unknown. An empty table gives an empty result; other columns of docs are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts = id_and_text(docs)
    held = id_remainder(F.col("doc_id"), MOD) == HELD_OUT
    model = train(texts.where(~held), scratch(spark, "lm"), order)
    scored = score(texts, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
