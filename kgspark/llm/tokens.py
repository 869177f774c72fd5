"""Whole texts to token ids with the tokenizers library, each distinct word once per worker.

The vocabulary used drops white space and never merges across it, so a text's ids are those of its words in order. A word of
Latin letters with ASCII punctuation after them is two units, any other word is one; units are found and looked up for a
whole batch at once, in a table of bounded size that holds their bytes and ids. The library encodes units that aren't in it.
"""

from __future__ import annotations

import re

import numpy as np

from .words import KEPT, Table

#: Units and ids that a worker keeps.
SLOTS, IDS = 1 << 20, 4 << 20
#: Characters that are looked up at once.
SEGMENT = 1 << 20
_WORKERS: dict[str, "WordTokenizer"] = {}

#: Classes of bytes of a text in lower case: ASCII white space; letters (a-z, bytes of U+00C0 to U+027F); ASCII marks, which are one
#: piece of the library's split where they stand together, and none of them with letters before; all others.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
#: Bytes of U+00D7 and U+00F7, which are no letters, and of U+0130, which has two characters in lower case.
_SIGNS = re.compile(rb"\xc3[\x97\xb7]|\xc4\xb0")
_NEXT = re.compile(r"[ \t\n\x0b\x0c\r]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
    return t


def parts_of(text: str, size: int = SEGMENT) -> list[str]:
    """text cut at white space into parts of about ``size`` characters."""
    at, parts = 0, []
    while len(text) - at > size and (m := _NEXT.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


class WordTokenizer:
    """Encodes batches of texts to uint16 or uint32 arrays."""

    def __init__(self, path: str, slots: int = SLOTS):
        from tokenizers import normalizers, pre_tokenizers

        self.tokenizer = tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain = tokenizer(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.last, self.table = last, Table(self.dtype, slots, IDS)

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.dtype).tobytes() for w in words]

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words that are one piece each, many to a call: only a piece's last token ends a word."""
        n, out = self.dtype.itemsize, []
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * n).tolist()
            assert len(ends) == len(part)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _units(self, units: list[bytes], letters: np.ndarray) -> list[bytes]:
        words = [u.decode() for u in units]
        ids: list = [None] * len(words)
        plain, odd = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        for some, found in ((plain, self._letters([words[i].lower() for i in plain])), (odd, self._whole([words[i] for i in odd]))):
            for i, x in zip(some, found):
                ids[i] = x
        return ids

    def _segment(self, texts: list[str]) -> list[np.ndarray]:
        raw = "\n".join(texts).encode().lower()
        if b"\0" in raw:
            return [np.frombuffer(x, self.dtype) for x in self._whole(texts)]
        b = np.frombuffer(raw + bytes(KEPT + 8), np.uint8)
        kind = _CLASS[b[: len(raw)]]
        kind[[m.start() for m in _SIGNS.finditer(raw)]] = _OTHER
        edge = np.diff(np.concatenate([[False], kind != _SPACE, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return [np.empty(0, self.dtype)] * len(texts)
        bad = kind == _OTHER
        bad[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
        bad = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        odd = (bad[ends] != bad[starts]) | (kind[starts] != _LETTER)
        cut = np.flatnonzero((kind[1:] == _MARK) & (kind[:-1] == _LETTER)) + 1
        cut = cut[~odd[np.searchsorted(starts, cut, "right") - 1]]
        begin, end = (np.sort(np.concatenate([x, cut]), kind="stable") for x in (starts, ends))

        def encode(at: np.ndarray) -> list[bytes]:
            letters = ~odd[np.searchsorted(starts, begin[at], "right") - 1] & (kind[begin[at]] == _LETTER)
            return self._units([raw[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist())], letters)

        first, count = self.table.look(b, begin, end - begin, encode)
        ids = self.table.gathered(first, count)
        bounds = np.cumsum([len(t.encode()) + 1 for t in texts[:-1]]) if len(texts) > 1 else []
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, bounds)]
        return np.split(ids, upto)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > SEGMENT:
                out += self._segment(group)
                group, size = [], 0
            if len(text) > 2 * SEGMENT:
                out.append(np.concatenate([self._segment([p])[0] for p in parts_of(text)]))
            else:
                group.append(text)
                size += len(text)
        return out + (self._segment(group) if group else [])


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's own, kept from task to task."""
    if path not in _WORKERS:
        _WORKERS[path] = WordTokenizer(path)
    return _WORKERS[path]
