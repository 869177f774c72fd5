"""Licence scans: fuzzy search of short notices.

A text is reduced to its words, one space between them. By the pigeonhole principle a notice found with at most k edits holds
one of its k + 1 parts unchanged; one Aho-Corasick pass finds these parts, and the regex library's bounded-error matching
checks the windows around them and gives spans and edits. A match is of whole words, and the short words that tell notices apart
(names, terms, numbers) stand in it unedited; where notices of different labels overlap, the one with more edits goes. The base
phrases are notices with k = 0, whose one part is the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

# Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices in common use, as words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
    "proprietary and confidential": "proprietary",
    "all rights reserved": "reserved",
}

# Short words that don't tell notices apart; other words of under LEAST characters do.
COMMON = {"a", "all", "and", "any", "copy", "free", "in", "into", "is", "of", "or", "the", "this", "to", "use"}
LEAST = 5

MATCH = pa.struct([("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_MATCH = "struct<label: string, notice: string, base: boolean, first_word: long, last_word: long, start: long, end: long, edits: int>"
_TO_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def edits_allowed(notice: str) -> int:
    """One edit for each ten characters, three at most."""
    return min(3, len(notice) // 10)


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """notice cut into k + 1 parts of nearly equal length, each with its offset."""
    at = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


def telling(notice: str) -> list[str]:
    """The words of a notice that no edit may touch."""
    return [w for w in notice.split() if len(w) < LEAST and w not in COMMON]


def matches(pattern: regex.Pattern, told: list[str], least: int, line: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the best match in line from a to b, widened to whole words, and of those in what is left beside it."""
    left = [(a, b)]
    while left:
        a, b = left.pop()
        if b - a >= least and (m := pattern.search(line, a, b)):
            start, end = m.span()
            while line[start] == " ":
                start += 1
            while line[end - 1] == " ":
                end -= 1
            start, end = line.rindex(" ", 0, start + 1) + 1, line.index(" ", end)
            words = iter(line[start:end].split())
            if all(w in words for w in told) and (whole := pattern.fullmatch(line, start, end)):
                yield start, end, sum(whole.fuzzy_counts)
                left += [(a, m.start()), (m.end(), b)]
            else:
                left += [(a, m.start()), (m.start() + 1, b)]


def beaten(spans: list[tuple[int, int, int, str]]) -> set[int]:
    """Which of the spans (start, end, edits, label) overlap one of another label with fewer edits."""
    out, order = set(), sorted(range(len(spans)), key=lambda i: spans[i][:2])
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if spans[j][0] >= spans[i][1]:
                break
            if spans[i][3] != spans[j][3] and spans[i][2] != spans[j][2]:
                out.add(i if spans[i][2] > spans[j][2] else j)
    return out


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        parts: dict[str, list] = {}
        self.base, self.notices, self.patterns = base, notices, {}
        for phrase in base:
            parts.setdefault(f" {phrase} ", []).append((phrase, 0, True))
        for notice in notices:
            k = edits_allowed(notice)
            self.patterns[notice] = k, telling(notice), regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")
            for offset, part in seeds(notice, k):
                parts.setdefault(part, []).append((notice, offset, False))
        self.magic = ahocorasick.Automaton()
        for part, uses in parts.items():
            self.magic.add_word(part, (len(part), uses))
        self.magic.make_automaton()

    def __call__(self, text: str) -> tuple[int, list[dict]]:
        """The number of words, and a dict for each match by start: MATCH's fields; start and end in code points of text."""
        words = text.encode().translate(_TO_WORDS).split()
        line = f" {b' '.join(words).decode()} "
        spans, windows = [], {}
        for last, (n, uses) in self.magic.iter(line):
            at = last - n + 1
            for notice, offset, base in uses:
                if base:
                    spans.append((at + 1, last, notice, True, 0))
                else:
                    k = self.patterns[notice][0]
                    a, b = max(0, at - offset - k), min(len(line), at - offset + len(notice) + k)
                    own = windows.setdefault(notice, [])
                    if own and a <= own[-1][1]:
                        own[-1] = min(a, own[-1][0]), max(b, own[-1][1])
                    else:
                        own.append((a, b))
        fuzzy = set()
        for notice, own in windows.items():
            k, told, pattern = self.patterns[notice]
            for a, b in own:
                fuzzy.update((start, end, notice, False, edits) for start, end, edits in matches(pattern, told, len(notice) - k, line, a, b))
        fuzzy = sorted(fuzzy)
        gone = beaten([(start, end, edits, self.notices[notice]) for start, end, notice, _, edits in fuzzy])
        spans += [x for i, x in enumerate(fuzzy) if i not in gone]
        if not spans:
            return len(words), []
        return len(words), self._rows(text, line, sorted(set(spans)))

    def _rows(self, text: str, line: str, spans: list) -> list[dict]:
        at = n = 0
        rows, places = [], [(m.start(), m.end()) for m in _WORD.finditer(text)]
        for a, b, notice, base, edits in spans:
            n += line.count(" ", at, a)
            at = a
            first = n - 1
            last = first + line.count(" ", a, b)
            label = (self.base if base else self.notices)[notice]
            rows.append(dict(zip((f.name for f in MATCH), (label, notice, base, first, last, places[first][0], places[last][1], edits))))
        return rows


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, matches (array of label, notice, base, first_word, last_word, start, end, edits) of each row of docs.

    Whole texts are read; a null or empty text has no words and no matches. A null doc_id stays null, rows that repeat a
    doc_id stay, an empty table gives an empty result and other columns of docs are not read. Where matches of a notice
    overlap, or of notices with different labels, the one with the fewest edits is given; base phrases are given at each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            found = [scanner(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], pa.list_(MATCH))], names=["doc_id", "n_words", "matches"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_words long, matches array<{_MATCH}>")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")
    closeness = F.transform("matches", lambda m: 1 - m["edits"] / F.length(m["notice"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"),
    )


ORACLE: dict[str, str] = {}
