"""Best-two-fit packing of documents' token ids into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, shared_dir, slices, written
from .tokens import vocabulary, word_tokenizer

CAPACITY, END = 2048, 0
#: Pieces that are packed together on average. Each group leaves at most about one sequence part empty, of some 1,000.
GROUP = 3000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length (1 to capacity).

    A bin is filled greedily with the longest that fits, again and again. If a gap is left, its smallest item is put back
    for two unpacked items whose sum fits the gap thus expanded more tightly, if there are such two. Items of equal length
    go in order of their position; no random choice is made.
    """
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("lengths must be 1 to the capacity")
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stock[lengths[i]].append(i)
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)

    def longest() -> np.ndarray:
        """For each size the longest length in stock up to it, else 0."""
        return np.maximum.accumulate(np.where(count > 0, sizes, 0))

    fits, left, number = longest(), len(lengths), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    while left:
        own, gap = [], capacity
        while x := int(fits[gap]):
            own.append(stock[x].pop())
            count[x] -= 1
            gap -= x
            if not count[x]:
                fits = longest()
        left -= len(own)
        if gap and left > 1:
            last = int(lengths[own[-1]])
            room = gap + last
            a = np.flatnonzero(count[: room + 1])
            b = fits[room - a]
            b = np.where((b == a) & (count[a] < 2), fits[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total[k := int(total.argmax())] > last:
                x = own.pop()
                for y in (int(a[k]), int(b[k])):
                    own.append(stock[y].pop())
                    count[y] -= 1
                stock[last].append(x)
                count[last] += 1
                left -= 1
                fits = longest()
        bins[own] = number
        offsets[own] = np.cumsum([0, *lengths[own[:-1]]])
        number += 1
    return bins, offsets


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(path)
        for batch in slices(batches):
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, own in zip(ids, words.encode(batch.column(1).to_pylist())):
                own = np.append(own.astype("<u4"), np.uint32(end))
                for k in range(0, len(own), capacity):
                    part = own[k : k + capacity]
                    rows.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's ids and the end id, cut only where longer than the capacity."""
    return id_and_text(docs).mapInArrow(_pieces(path, capacity, end), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (any columns, among them length of 1 to capacity) with sequence_id and offset: gapless from 0 in each sequence.

    Pieces are dealt by a hash of all their columns and their place in ``pieces``, which should be a written table (so a task
    that runs again deals alike, and rows that repeat go to many groups), into groups of about ``group``; a group is packed whole
    in one task, whose size so doesn't grow with the input.
    """
    n = pieces.count()
    groups = max(1, -(-n // group))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in names if c != "length"], kind="stable", na_position="first").reset_index(drop=True)
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins + (int(key[0]) << 32)
        pdf["offset"] = offsets
        return pdf[[*names, "sequence_id", "offset"]]

    dealt = pieces.select(*names, F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)).alias("__group"))
    return dealt.groupBy("__group").applyInPandas(lambda key, pdf: run(key, pdf[names]), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Packs the texts of docs (doc_id, text) into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id alone; a null doc_id stays null; rows that repeat a doc_id are packed each.
    A text longer than the capacity is cut into pieces of the capacity, the last may be shorter. An empty table gives an
    empty result; other columns of docs are not read.
    """
    shared_dir(docs.sparkSession)
    return pack(written(token_pieces(docs, path, capacity, end), "pieces"), capacity)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs packed into sequences, see pack_documents()."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


ORACLE: dict[str, str] = {}
