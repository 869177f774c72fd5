"""Shared helpers: the shared work folder, tables written there, and Arrow batch plumbing."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (tests) a local one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"  # one machine only, as in tests
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that this session's operators wrote into the shared folder, in order.
_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written_so_far() -> int:
    return len(_WRITTEN)


def remove_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what operators wrote since then but for the last ``keep`` paths, once the result made of it is stored: an operator's
    result is lazy, so it can't do so itself."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_WRITTEN) - keep
    for uri in _WRITTEN[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(conf).delete(path, True)
    del _WRITTEN[since:end]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text, null as empty; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def id_remainder_of(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the column's bytes stay near ``limit`` (one row at least): bounded memory in Python."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write_bytes(uri: str, data) -> None:
    """Writes a file of the shared folder whole: a temporary name first, then a rename, so that a lost task leaves no torn file."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(temp, "wb") as out:
            out.write(data)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, path)


def mapped_bytes(uri: str):
    """A memory map of a file of the shared folder; from a store that can't be mapped the bytes are read."""
    path = local_path(uri)
    if path is not None:
        return memoryview(b"") if not os.path.getsize(path) else memoryview(pa.memory_map(path).read_buffer())
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return memoryview(store.open_input_file(path).readall())


import pyarrow.compute  # noqa: E402  pa.compute is used in slices()


#: Keys that hold over 1/HOT of all rows; there can be no more than HOT of them.
HOT = 10_000


def join_unique(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with ``table``, whose key is unique, whatever share of rows one key holds.

    The rows of hot keys, under HOT keys by their definition, meet a broadcast copy of the table's few rows for them; all
    others are dealt by key. ``rows`` is read three times, so it should come from a written table.
    """
    counts = rows.groupBy(key).count()
    n = rows.count()
    hot = written(counts.where(F.col("count") > max(1, n // HOT)).select(key).join(table, key), "hot")
    near = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    far = near.where("__hot is null").select(*rows.columns).join(table, key)
    return near.where("__hot").drop("__hot").unionByName(far)


#: Bits of a filter for each of its keys, and most bits in all (32 MB), however many keys there are; a full filter passes more.
FILTER_BITS, FILTER_MOST = 16, 1 << 28


def may_match(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """rows with __may: false only where no row of ``keys`` has the same values of ``by`` (same types in both).

    A Bloom filter of one hash, broadcast as bitmaps, so that rows which can't join never enter a shuffle; it is made anew from
    ``keys``, which should be a written table.
    """
    bits = min(FILTER_MOST, max(1 << 15, 1 << (FILTER_BITS * keys.count()).bit_length()))
    slot = F.xxhash64(*by).bitwiseAND(F.lit(bits - 1))
    at = F.col("__slot").bitwiseAND(F.lit((1 << 15) - 1))
    filled = keys.select(slot.alias("__slot")).groupBy(F.shiftright("__slot", 15).alias("__part")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("__slot", slot).withColumn("__part", F.shiftright("__slot", 15)).join(F.broadcast(filled), "__part", "left")
    may = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], may.alias("__may"))


def rows_that_stay(docs: DataFrame, told: DataFrame) -> DataFrame:
    """docs without the rows that go. ``told`` (id long, said long: the hash of the row's text, stay boolean) names the (doc_id,
    text) of which all rows go, or, where stay is true, all but one; rows it doesn't name all stay.

    Only rows that may be named are shuffled. A null doc_id counts as a key of its own; a null text as empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = may_match(rows.select("__row", key.alias("__id"), F.xxhash64("__text").alias("said")), told.select(key.alias("__id"), "said"), ["__id", "said"])
    near = rows.where("__may").drop("__may").join(told.select(key.alias("__id"), "said", "stay"), ["__id", "said"], "left")
    one = near.where("stay").groupBy("__id", "said").agg(F.max_by("__row", F.xxhash64("__row")).alias("__row"))
    return rows.where(~F.col("__may")).select("__row.*").unionByName(near.where("stay is null").select("__row.*")).unionByName(one.select("__row.*"))
