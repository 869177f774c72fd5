"""Token ids as a content-addressed store.

A rolling hash cuts each document's ids into chunks; a chunk's address is the SHA-256 of its ids. Each unique chunk is stored
once; a document is a recipe, the addresses in order. The Merkle root over a recipe's addresses stands with it, and a
manifest holds the root over each file's documents. Reading back recomputes addresses and roots from the stored ids.

Layout under the store's path: ``chunks`` (address, ids: zstandard of little-endian ids), ``recipes`` (part, doc_id, start,
n_tokens, addresses, root; ascending doc_id over the parts) and ``manifest`` (part, n_docs, n_tokens, root).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cdc import cuts, gear_table
from .common import id_and_text, join_unique, may_match, scratch, shared_dir, slices, written
from .tokens import tokenizer, vocabulary, word_tokenizer

END = 1
BITS, LEAST, MOST = 9, 128, 8192
STAGED = "doc_id long, n_tokens long, addresses array<binary>, address binary, ids binary"


def merkle(leaves: list[bytes]) -> bytes:
    """The Merkle root: leaves and inner nodes are hashed with different prefixes; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


# --- crc32 of a whole from those of its parts, in arithmetic over GF(2) on arrays ---

# Fixed value: the reflected polynomial of crc32.
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = np.zeros_like(b)
    for bit in range(31, -1, -1):
        p ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return p


def _powers() -> list[np.uint32]:
    x = [np.array([1 << 30], np.uint32)]  # the polynomial x
    for _ in range(66):
        x.append(_times(x[-1], x[-1]))
    return x


_SQUARES = _powers()


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each crc as if followed by n_bytes more, to be xored with theirs."""
    crc, n, k = crc.astype(np.uint32), n_bytes.astype(np.uint64), 3
    while n.any():
        odd = np.flatnonzero(n & np.uint64(1))
        if len(odd):
            crc[odd] = _times(np.broadcast_to(_SQUARES[k], len(odd)), crc[odd])
        n >>= np.uint64(1)
        k += 1
    return crc


def crcs_of_parts(crcs: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The crc of each whole; its parts lie in a row, the first of each at ``firsts`` (each whole has a part)."""
    ends = np.cumsum(sizes)
    last = np.append(firsts[1:], len(sizes)) - 1
    after = np.repeat(ends[last], np.diff(np.append(firsts, len(sizes)))) - ends
    return np.bitwise_xor.reduceat(crc_shift(crcs, after), firsts)


# --- writing ---


def _staged(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, press, seen = word_tokenizer(path), zstandard.ZstdCompressor(level=1), set()
        table, dtype = gear_table(1 << 16 if words.dtype.itemsize == 2 else max(1 << 16, words.tokenizer.get_vocab_size())), words.dtype
        for batch in slices(batches):
            docs = [np.append(x, dtype.type(end)) for x in words.encode(batch.column(1).to_pylist())]
            raw, lists, new = [d.tobytes() for d in docs], [], {}
            for own, data in zip(cuts(np.concatenate(docs), np.cumsum([len(d) for d in docs]), table, BITS, LEAST, MOST), raw):
                parts = [data[a * dtype.itemsize : b * dtype.itemsize] for a, b in zip([0, *own], own)]
                lists.append([hashlib.sha256(p).digest() for p in parts])
                new.update(zip(lists[-1], parts))
            new = {a: p for a, p in new.items() if a not in seen}
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(new)
            n, m = len(docs), len(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*batch.column(0).to_pylist(), *[None] * m], pa.int64()),
                    pa.array([*map(len, docs), *[None] * m], pa.int64()),
                    pa.array([*lists, *[None] * m], pa.list_(pa.binary())),
                    pa.array([*[None] * n, *new], pa.binary()),
                    pa.array([*[None] * n, *map(press.compress, new.values())], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "addresses", "address", "ids"],
            )

    return run


def _in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_tokens, addresses) in range partitions by ascending doc_id, with part, the ids before each in its part, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column(1).to_pylist()
            start = np.cumsum([before, *n])
            before = int(start[-1])
            root = [merkle(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start[:-1], pa.int64()), pa.array(root, pa.binary())], names=["doc_id", "n_tokens", "addresses", "part", "before", "root"])

    # ranges of a second key too, so that rows without doc_id, or with the same, aren't one task's
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("addresses")).sortWithinPartitions("doc_id", F.xxhash64("addresses"))
    return ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, "doc_id long, n_tokens long, addresses array<binary>, part int, before long, root binary")


def write_store(docs: DataFrame, path: str, vocabulary_path: str, end: int = END) -> None:
    """Encodes every whole text of docs (doc_id, text; null: empty), appends the id ``end`` and writes the store at path."""
    spark = docs.sparkSession
    staged = written(id_and_text(docs).mapInArrow(_staged(vocabulary_path, end), STAGED), "staged")
    chunks = staged.where("address is not null").select("address", "ids")
    often = written(chunks.groupBy("address").agg(F.count("*").alias("n")).where("n > 1").select("address"), "often")
    chunks = may_match(chunks, often, ["address"])  # chunks that came once are stored where they are
    once = chunks.where(~F.col("__may")).select("address", "ids")
    once.unionByName(chunks.where("__may").groupBy("address").agg(F.first("ids").alias("ids"))).write.option("compression", "none").parquet(f"{path}/chunks")
    recipes = written(_in_order(staged.where("address is null").select("doc_id", "n_tokens", "addresses")), "recipes")
    sizes = {r["part"]: r["n"] for r in recipes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each file
    starts = np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()
    offsets = spark.createDataFrame(list(zip(sorted(sizes), starts)), "part int, at long")
    whole = recipes.join(F.broadcast(offsets), "part").select("part", "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "addresses", "root")
    whole.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _per_part(spark, path).write.parquet(f"{path}/manifest")


_RECIPES = "part int, doc_id long, start long, n_tokens long, addresses array<binary>, root binary"


def _per_part(spark: SparkSession, path: str) -> DataFrame:
    """part, n_docs, n_tokens, root over the documents of each part, from the stored recipes."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [[r["root"] for r in rows] for rows in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([merkle(x) for x in leaves], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    per_part = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "root"))).alias("rows"))
    return per_part.mapInArrow(roots, "part int, n_docs long, n_tokens long, root binary")


# --- reading ---


def read_chunks(spark: SparkSession, path: str, item: int) -> DataFrame:
    """address, n (ids), crc (of the ids as little-endian unsigned 32-bit integers) of each stored chunk; a chunk whose ids
    don't give its address is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            n, crc = [], []
            for address, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = unpress.decompress(data)
                if hashlib.sha256(data).digest() != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                ids = np.frombuffer(data, f"<u{item}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

    return spark.read.schema("address binary, ids binary").parquet(f"{path}/chunks").mapInArrow(run, "address binary, n long, crc long")


def check_manifest(spark: SparkSession, path: str) -> None:
    """An error if the recipes aren't those of the manifest: counts and roots of each part."""
    held, told = _per_part(spark, path), spark.read.schema("part int, n_docs long, n_tokens long, root binary").parquet(f"{path}/manifest")
    odd = held.exceptAll(told).select("part").union(told.exceptAll(held).select("part")).distinct().limit(10).collect()
    if odd:
        raise ValueError(f"recipes of parts {sorted(r['part'] for r in odd)} are damaged or lost")


def read_store(spark: SparkSession, path: str, item: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified (the recipe's root and length are those of its stored chunks) of each
    document, from the store's files; ``item``: bytes of a stored id. Recipes that differ from the manifest are an error, and so
    is a document whose chunks are lost or not its own."""
    check_manifest(spark, path)
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    uses = recipes.select("start", F.posexplode("addresses").alias("pos", "address"))
    found = join_unique(uses, written(read_chunks(spark, path, item), "read"), "address")
    lists = found.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc", "address"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(4)
            if column.null_count:
                raise ValueError(f"all chunks of {column.null_count} documents are lost")
            parts = column.flatten()
            firsts = np.asarray(column.offsets)[:-1] - column.offsets[0].as_py()
            n, crc = (np.asarray(parts.field(k), np.int64) for k in (1, 2))
            crcs = crcs_of_parts(crc, 4 * n, firsts).astype(np.int64)
            addresses = parts.field(3).to_pylist()
            last = np.append(firsts[1:], len(n))
            good = [root == merkle(addresses[a:b]) for root, a, b in zip(batch.column(3).to_pylist(), firsts, last)]
            good = np.array(good) & (np.add.reduceat(n, firsts) == np.asarray(batch.column(2)))
            if not good.all():
                raise ValueError(f"chunks of {np.count_nonzero(~good)} documents are lost or not their own")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return recipes.join(lists, "start", "left").select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, and ids (binary: little-endian ids as stored) of each document, joined together from the chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("doc_id", "start", F.posexplode("addresses").alias("pos", "address"))
    parts = uses.join(spark.read.parquet(f"{path}/chunks"), "address").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [b"".join(unpress.decompress(p["ids"]) for p in own) for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return parts.mapInArrow(run, "doc_id long, start long, ids binary")


def store_and_read(docs: DataFrame, vocabulary_path: str, end: int = END) -> DataFrame:
    """Writes the store for docs in the shared folder and reads it back, see read_store().

    A null or empty text is the end id alone; rows with a null doc_id come first; rows that repeat a doc_id are stored each,
    in a repeatable order; an empty table gives an empty result; other columns of docs are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    path = scratch(spark, "store")
    write_store(docs, path, vocabulary_path, end)
    return read_store(spark, path, 2 if tokenizer(vocabulary_path).get_vocab_size() <= 1 << 16 else 4)


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


ORACLE: dict[str, str] = {}
