"""Byte-level BPE as a lazily determinised finite-state transducer, and its inverse.

A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent pair of tokens is the encoding of the pair's own
bytes. So the merges define a nondeterministic transducer: a state is the last token written and a node of the trie of tokens'
bytes; at the end of a token t it may write t and return to the root if the pair (last token, t) holds. The subset
construction with delayed output makes it deterministic: a state is the set of readings still possible with the tokens each
has yet to write, and a step writes the tokens that all readings share. Readings are no longer than the longest token, so
output comes after a bounded lookahead. States and steps are made when first needed and kept up to a bound.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .words import KEPT, SEGMENT, Table

#: Bounds of what a worker keeps: steps of the transducer, words with their ids. When full they start anew.
STEPS, WORDS = 700_000, 100_000
#: Words and ids in the worker's table.
SLOTS, IDS = 1 << 20, 4 << 20
#: Characters of the longest word or piece that is kept; longer ones, without end perhaps, would fill the memory.
LONGEST = 64
_WORKERS: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int], none: int = 1 << 60) -> list[int]:
    """The encoding by definition: merge the adjacent pair of least rank (under ``none``), the first of equals, until none can be."""
    parts = [data[i : i + 1] for i in range(len(data))]
    of = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while of and (least := min(of)) < none:
        i = of.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del of[i]
        if i < len(of):
            of[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            of[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Byte strings to token ids."""

    def __init__(self, ranks: dict[bytes, int], steps: int = STEPS):
        self.ranks, self.most = ranks, steps
        self.bytes_of = {i: b for b, i in ranks.items()}
        # The trie: (node, byte) -> node; the token that ends at a node. A whole piece that is a token is that token.
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for data, token in ranks.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = token
        # The two tokens that a token is merged from, -1: it is a byte. If each is of a higher rank than its parts, ranks tell the time.
        self.parts = [(-1, -1)] * (max(ranks.values()) + 1)
        for data, token in ranks.items():
            if len(data) > 1:
                two = merge(data, ranks, token)
                self.parts[token] = tuple(two) if len(two) == 2 else (-2, -2)
        single = {t for d, t in ranks.items() if len(d) == 1}
        self.timely = all(p == (-1, -1) or p[0] >= 0 and all(x in single or x < t for x in p) for t, p in enumerate(self.parts))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((-1, 0, ()),)
        self.number, self.states, self.ends, self.step = {start: 0}, [start], [()], {}

    def _holds(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: the start)."""
        if a < 0:
            if b not in self.alone:
                self.alone[b] = merge(self.bytes_of[b], self.ranks) == [b]
            return self.alone[b]
        if (a, b) not in self.pairs:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            self.pairs[a, b] = self._apart(a, b) if self.timely else merge(self.bytes_of[a] + self.bytes_of[b], self.ranks) == [a, b]
        return self.pairs[a, b]

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before those that make a and b. Backwards in time the last part of a
        and the first of b get shorter; two that could merge while both were there would have done so, of merges of one rank the
        left one first."""
        until_a = until_b = 1 << 60
        parts, bytes_of, ranks = self.parts, self.bytes_of, self.ranks
        while True:
            made_a, made_b = (a if parts[a][0] >= 0 else -1), (b if parts[b][0] >= 0 else -1)
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None:
                when = max(across, made_a, made_b)
                if when < until_a and when <= until_b:
                    return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_a, a = made_a, parts[a][1]
            else:
                until_b, b = made_b, parts[b][0]

    def _new_step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        readings, whole = [], None  # in the order in which their last tokens began
        for last, node, waiting in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            readings.append((last, to, waiting))
            token = self.token[to]
            if token >= 0 and self._holds(last, token):
                whole = (token, 0, (*waiting, token))  # one at most: an encoding is unique
        if whole:
            readings.append(whole)
        shared = readings[0][2]
        n = len(shared)
        for _, _, waits in readings[1:]:  # what all readings have yet to write
            k, most = 0, min(n, len(waits))
            while k < most and waits[k] == shared[k]:
                k += 1
            n = k
            if not n:
                break
        shared = shared[:n]
        new = tuple([(last, node, w[n:]) for last, node, w in readings]) if n else tuple(readings)
        return self._state(new), shared

    def _state(self, new: tuple) -> int:
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.ends.append(next((w for _, node, w in new if not node), None))
        return self.number[new]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.step) > self.most:
            self._forget()
        state, out, known = 0, [], self.step
        for byte in piece:
            step = known.get(state << 8 | byte)
            if step is None:
                if len(known) > 2 * self.most:  # a piece without end; what is still to read is all in the state
                    now = self.states[state]
                    self._forget()
                    known = self.step
                    state = self._state(now)
                step = known[state << 8 | byte] = self._new_step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return [*out, *self.ends[state]]


class Encoder:
    """Texts to ids: a text is split at single spaces into words, whose ids don't depend on their neighbours; a word that isn't in
    the table is split by the pattern and each match goes through the transducer. A text in which white space meets white space is split by the
    pattern as a whole."""

    def __init__(self, path: str, pattern: str, words: int = WORDS, slots: int = SLOTS):
        self.ranks = read_ranks(path)
        self.machine, self.pattern, self.words = Transducer(self.ranks), regex.compile(pattern), words
        self.known: dict[bytes, bytes] = {}
        self.table = Table(np.dtype("<u4"), slots, IDS)
        self.pieces: dict[str, bytes] = {}
        self.bytes = [self.machine.bytes_of.get(i, b"") for i in range(max(self.ranks.values()) + 1)]
        self.numerals = [str(i) for i in range(len(self.bytes))]

    def _ids(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        pieces, out = self.pieces, []
        for p in found:
            ids = pieces.get(p)
            if ids is None:
                if len(pieces) > self.words:
                    pieces.clear()
                ids = array("I", self.machine.encode(p.encode())).tobytes()
                if len(p) <= LONGEST:
                    pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; all words of a batch are looked up at once."""
        out: list = [None] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if not text or "\0" in text or len(text) > 8 * SEGMENT or _MEET.search(text):
                out[i] = np.frombuffer(self._ids(text), "<u4")
                continue
            if group and size + len(text) > SEGMENT:
                self._segment(texts, group, out)
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            self._segment(texts, group, out)
        return out

    def _segment(self, texts: list[str], group: list[int], out: list) -> None:
        raw = b"\xff".join([texts[i].encode() for i in group])  # a byte of no text
        b = np.frombuffer(raw + b"\xff" + bytes(KEPT + 8), np.uint8)
        gap = np.flatnonzero((b[: len(raw) + 1] == 32) | (b[: len(raw) + 1] == 255))
        begin = np.concatenate([[0], gap[:-1] + (b[gap[:-1]] == 255)])  # a word has the space before it

        def encode(at: np.ndarray) -> list[bytes]:
            found, known = [], self.known
            if len(known) > self.words:
                known.clear()
            for word in (raw[i:j] for i, j in zip(begin[at].tolist(), gap[at].tolist())):
                if word[:1] == b" " and word[1:].isalpha():  # of ASCII letters: one match of the pattern
                    found.append(array("I", self.machine.encode(word)).tobytes())
                    continue
                ids = known.get(word)
                if ids is None:
                    ids = self._ids(word.decode())
                    if len(word) <= LONGEST:
                        known[word] = ids
                found.append(ids)
            return found

        first, count = self.table.look(b, begin, gap - begin, encode)
        ids = self.table.gathered(first, count)
        ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, gap[b[gap] == 255])]
        for i, own in zip(group, np.split(ids, ends[:-1])):
            out[i] = own

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as it becomes certain: bytes of a character that isn't whole yet wait in the UTF-8 state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.bytes[i]):
                yield text
        if text := machine.decode(b"", final=True):
            yield text


# White space before or after white space, or at either end: there a word's pieces can depend on its neighbour.
_MEET = re.compile(r"\s\s|^\s|\s$")


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's own, kept from task to task."""
    if (path, pattern) not in _WORKERS:
        _WORKERS[path, pattern] = Encoder(path, pattern)
    return _WORKERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text of docs; a null or empty text has no ids. A null doc_id stays null, rows
    that repeat a doc_id stay, an empty table gives an empty result; other columns of docs are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, pattern)
        for batch in slices(batches):
            ids = [x.astype(np.int32) for x in machine.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of the rows of encode_texts(), through the streaming decoder; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, pattern)
        for batch in batches:
            texts = ["".join(machine.stream(ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text: encode, then decode again, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, pattern)
        numeral = machine.numerals.__getitem__
        for batch in slices(batches):
            rows = []
            for ids in machine.encode_all(batch.column(1).to_pylist()):
                ids = ids.tolist()
                utf8, back = codecs.getincrementaldecoder("utf-8")("strict"), hashlib.sha256()
                for k in range(0, len(ids), 4096):
                    # an id stream that isn't UTF-8 is an error
                    back.update(utf8.decode(machine.decode(ids[k : k + 4096])).encode())
                utf8.decode(b"", final=True)
                rows.append((len(ids), hashlib.sha256(" ".join(map(numeral, ids)).encode()).hexdigest(), back.hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ORACLE: dict[str, str] = {}
