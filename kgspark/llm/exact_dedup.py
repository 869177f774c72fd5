"""Exact dedup by content-defined chunk recipes.

Each text is normalised and cut by content into chunks. Chunks are deduplicated to identifiers: 64-bit hashes, verified by
a 256-bit digest; where chunks of one hash differ, each gets an identifier of its own. Documents are then compared by their
ordered identifier lists alone: no text leaves the task that read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cdc import cuts, gear_table
from .common import SPACES, id_and_text, rows_that_stay, shared_dir, slices, written

BITS, LEAST, MOST = 11, 512, 16384
#: Groups with over 1/HOT of all rows, so fewer than HOT of them, are joined by broadcast.
HOT = 10_000
RECIPE = "doc_id long, said long, n_code_points long, text_sha256 string, ids array<long>, digests array<binary>"
_DROP = bytes(SPACES, "ascii")


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = gear_table(256)
    for batch in slices(batches, limit=2 << 20):
        texts = batch.column(1).to_pylist()
        raw = [t.encode("utf-8", "surrogatepass").translate(None, _DROP) for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        ids, digests = [], []
        for own, text in zip(cuts(buffer, ends, table, BITS, LEAST, MOST), raw):
            parts = [text[a:b] for a, b in zip([0, *own], own)]
            ids.append([xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts])
            digests.append([hashlib.sha256(p).digest() for p in parts])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array(ids, pa.list_(pa.int64())),
                pa.array(digests, pa.list_(pa.binary())),
            ],
            names=["doc_id", "said", "n_code_points", "text_sha256", "ids", "digests"],
        )


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, said (a hash of the original text), n_code_points (of it), text_sha256, ids and digests
    of its chunks in order."""
    return id_and_text(docs).withColumn("said", F.xxhash64("text")).mapInArrow(_recipes, RECIPE)


def chunk_identifiers(recipes: DataFrame) -> DataFrame:
    """The chunk store's index: id, digest, variant (0, 1, ... within the chunks of one 64-bit id), uses."""
    chunks = recipes.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.digests").alias("digest"))
    held = chunks.groupBy("id", "digest").agg(F.count("*").alias("uses"))
    per_id = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("digest", "uses"))).alias("all"))
    return per_id.select("id", F.posexplode("all").alias("variant", "v")).select("id", F.col("v.digest").alias("digest"), "variant", F.col("v.uses").alias("uses"))


def verified_lists(recipes: DataFrame) -> DataFrame:
    """recipes with ``ids`` verified: equal lists now mean equal chunks. Where one 64-bit id stands for chunks with different
    digests, the ids of the second and later are replaced by longer ones (variant in the second half of the list)."""
    chunks = recipes.select(F.explode(F.arrays_zip("ids", "digests")).alias("c"))
    clashes = written(chunks.groupBy(F.col("c.ids").alias("id")).agg(F.min("c.digests").alias("lo"), F.max("c.digests").alias("hi")).where("lo <> hi").select("id"), "clashes")
    if clashes.isEmpty():
        return recipes.drop("digests")
    variants = chunk_identifiers(recipes).join(clashes, "id", "left_semi").where("variant > 0")
    by = ["doc_id", "said", "n_code_points", "text_sha256"]
    equal = recipes.groupBy(*by, "ids", "digests").agg(F.count("*").alias("rows"))  # rows that repeat are listed once and repeated below
    rows = equal.select(*by, "ids", "rows", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c"))
    rows = rows.join(variants, (F.col("c.ids") == variants["id"]) & (F.col("c.digests") == variants["digest"]), "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("variant", F.lit(0)).cast("long").alias("v")))), lambda x: x["v"])
    lists = rows.groupBy(*by, rows["ids"], "rows").agg(listed.alias("extra"))
    return lists.select(*by, F.concat("ids", "extra").alias("ids"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("__nth")).drop("__nth")


def _deduped(docs: DataFrame) -> DataFrame:
    """What exact_dedup() gives, with said and n_code_points of each row."""
    shared_dir(docs.sparkSession)
    lists = verified_lists(written(chunk_recipes(docs), "recipes"))
    order = F.struct("n_code_points", (-F.col("doc_id")).alias("back"))
    groups = written(
        lists.groupBy("ids").agg(F.max(order).alias("best"), F.count("*").alias("group_size"), F.min("text_sha256").alias("text_sha256"))
        .select("text_sha256", (-F.col("best.back")).alias("keep_id"), "group_size"),
        "groups",
    )
    rows = lists.select("doc_id", "text_sha256", F.size("ids").alias("n_chunks"), "said", "n_code_points")
    n = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = groups.where(F.col("group_size") > max(1, n // HOT))  # fewer than HOT rows of some 100 bytes
    cold = groups.where(F.col("group_size") <= max(1, n // HOT))
    near = rows.join(F.broadcast(hot), "text_sha256", "left")
    far = near.where("group_size is null").drop("keep_id", "group_size").join(cold, "text_sha256")
    both = near.where("group_size is not null").unionByName(far)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks", "said", "n_code_points")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Which rows of ``docs`` (doc_id, text) are copies: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Of equal texts the row with the most
    code points in the original text stays, then the smallest doc_id. A null text counts as empty; empty texts are equal to
    each other. A null doc_id comes after all others; rows that repeat a doc_id with an equal text are one document and
    counted each in group_size. An empty table gives an empty result; other columns of docs are not read.
    """
    return _deduped(docs).drop("said", "n_code_points")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that stay, with the columns of docs; of rows with the same doc_id and equal text one, the longest."""
    rows = written(_deduped(docs).select(F.col("doc_id").alias("id"), "said", "text_sha256", "kept", "n_code_points"), "deduped")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    best = rows.where("kept").groupBy(key.alias("key"), "text_sha256").agg(F.max_by("said", F.struct("n_code_points", "said")).alias("said")).select("key", "said", F.lit(True).alias("stay"))
    each = rows.groupBy(key.alias("key"), "id", "said").agg(F.count("*").alias("rows")).join(best, ["key", "said"], "left")
    return rows_that_stay(docs, written(each.where("stay is null or rows > 1").select("id", "said", F.coalesce("stay", F.lit(False)).alias("stay")), "told"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")


ORACLE = {
    "op2_exact_dedup": r"""
with n as (select doc_id, length(coalesce(text, '')) as cp, translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') as t from documents),
g as (select *, first_value(doc_id) over (partition by t order by cp desc, doc_id) as keep_id, count(*) over (partition by t) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g
""",
}
