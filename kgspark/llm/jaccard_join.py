"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word 5-grams; equal sets are one class. Its number is its smallest doc_id or, where another class with that
doc_id has it already, one that is no doc_id. MinHash values in bands make candidates: in each band that classes share they
compare their values step by step, and a pair is dropped when the posterior probability that its similarity reaches the
threshold falls below a tolerance. What is kept joins classes to small components; only their texts are read again, and only
within a component, in blocks where it is large, shingle sets are compared. Blocks return counts of links and a spanning
forest, never pairs. So classes that share a band by chance never bring their texts together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, id_and_text, join_unique, may_match, rows_that_stay, shared_dir, slices, written
from .components import components
from .words import hashed

NGRAM, SIMILARITY = 5, 0.8
#: MinHash values: BANDS of ROWS each. A pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 32 < 3.1e-6.
BANDS, ROWS = 32, 5
#: Values compared in a step, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Of each MinHash value 8 bits are kept: two differing ones agree with this probability.
CHANCE = 1 / 256
#: Classes of a block; memory of a task is that of two blocks. Classes of a band (a signature each) that are compared in one task.
BLOCK, MEMBERS = 400, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def shingles_of(h: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-grams of words given by hash."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out + np.uint64(n)))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The shingles of each text; words are runs without ASCII white space, A-Z in lower case. A text of fewer words is one
    shingle, a text without words none."""
    h, firsts = hashed(texts, ended=False)
    return [shingles_of(x) for x in np.split(h, firsts[1:])]


def signature(own: np.ndarray) -> np.ndarray:
    """The MinHash values (their low 8 bits) of a set of shingles."""
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(own), 1024):  # bounded memory for long texts
        part = ((own[None, i : i + 1024] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, part.min(axis=1), out=least)
    return least.astype(np.uint8)


def bands_of(values: np.ndarray) -> np.ndarray:
    """A number for each band of each signature: the band's number and its values side by side."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.int64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.int64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = h << 8 | parts[:, :, k]
    return h


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared the fewest equal ones with which a pair stays: with a uniform prior the posterior of
    the share of equal values is Beta(m + 1, n - m + 1), and P(at least t) is the probability of at most m successes in n + 1
    trials of t, the share at the threshold."""
    found, t = {}, similarity + (1 - similarity) * CHANCE
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        chance = [math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 2)]
        found[n] = next(m for m in range(n + 1) if math.fsum(chance[: m + 1]) >= tolerance)
    return found


def kept_by_values(values: np.ndarray, x: np.ndarray, y: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which of the pairs (x, y) stay when their values are compared step by step."""
    at, m = np.arange(max(len(x), len(y))), np.zeros(max(len(x), len(y)), np.int32)
    x, y = np.broadcast_to(x, len(at)), np.broadcast_to(y, len(at))
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        m += (values[x[at], n - STEP : n] == values[y[at], n - STEP : n]).sum(axis=1)
        stay = m >= need[n]
        at, m = at[stay], m[stay]
    return at


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        own = shingle_sets(batch.column(1).to_pylist())
        cols = [batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array([signature(s).tobytes() for s in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "said", "key", "n_shingles", "values"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            bands = bands_of(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), BANDS)), pa.array(bands.ravel())], names=["node", "band"])


def forest(values: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """For each signature the first of those it is joined with, directly or through others, by pairs that pruning keeps. Each is
    compared with those not reached yet, so a group of alike ones costs little more than one pass."""
    top, left = np.arange(len(values)), np.arange(len(values))
    while len(left):
        first, left = left[0], left[1:]
        reached = [first]
        while reached and len(left):
            at = kept_by_values(values, np.array([reached.pop()]), left, need)
            top[left[at]] = first
            reached += left[at].tolist()
            left = np.delete(left, at)
    return top


def _kin(key: tuple, table: pa.Table) -> pa.Table:
    """Joins of a task's bands (node, values, band): u and v, in trees."""
    node, band = np.asarray(table["node"]), np.asarray(table["band"])
    values = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint8).reshape(len(node), -1)
    order = np.lexsort((node, band))
    node, values = node[order], values[order]
    first = np.flatnonzero(np.diff(band[order], prepend=-1))
    sizes, need = np.diff(np.append(first, len(node))), least_matches()
    pairs = first[sizes == 2]  # most bands
    pairs = pairs[kept_by_values(values, pairs, pairs + 1, need)] if len(pairs) else pairs
    us, vs = [node[pairs]], [node[pairs + 1]]
    for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        top = forest(values[a : a + n], need)
        some = np.flatnonzero(top != np.arange(n))
        us.append(node[a + top[some]])
        vs.append(node[a + some])
    return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        own = shingle_sets(batch.column(1).to_pylist())
        same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(own, batch.column(5).to_pylist())], pa.bool_())
        cols = [*(batch.column(i) for i in (0, 2, 3, 4, 6)), pa.array([s.tobytes() for s in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["node", "size", "component", "blocks", "values", "shingles"]).filter(same)


def links_within(shingle_sets: list[np.ndarray], values: np.ndarray, block: np.ndarray, crossed: bool, similarity: float = SIMILARITY):
    """Yields (i, js): linked pairs. ``crossed``: only pairs from different blocks are wanted."""
    bands, need = bands_of(values), least_matches(similarity)
    firsts, seconds = [], []
    for k in range(BANDS):
        order = np.argsort(bands[:, k], kind="stable")
        same = bands[order, k]
        edges = np.flatnonzero(np.diff(same, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(same))):
            if b - a < 2:
                continue
            run = np.sort(order[a:b])
            i, j = np.triu_indices(len(run), 1)
            i, j = run[i], run[j]
            if crossed:
                keep = block[i] != block[j]
                i, j = i[keep], j[keep]
            for s in range(0, len(i), 1 << 16):  # pairs that met in an earlier band are left out; bounded memory
                x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                new = ~(bands[x, :k] == bands[y, :k]).any(axis=1) if k else np.ones(len(x), bool)
                x, y = x[new], y[new]
                stay = kept_by_values(values, x, y, need)
                firsts.append(x[stay])
                seconds.append(y[stay])
    if not firsts or not sum(map(len, firsts)):
        return
    first, second = np.concatenate(firsts), np.concatenate(seconds)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    sizes = np.array([len(s) for s in shingle_sets])
    used = np.unique(np.concatenate([first, second]))
    local = dict(zip(used.tolist(), np.split(np.unique(np.concatenate([shingle_sets[u] for u in used]), return_inverse=True)[1], np.cumsum(sizes[used])[:-1])))
    mark = np.zeros(max(int(x.max()) for x in local.values()) + 1, np.int32)
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(first))):
        i, js = int(first[a]), second[a:b]
        mark[local[i]] = 1
        for s in range(0, len(js), 256):
            part = js[s : s + 256]
            lists = [local[j] for j in part.tolist()]
            common = np.add.reduceat(mark[np.concatenate(lists)], np.cumsum([0, *map(len, lists[:-1])]))
            linked = part[common >= similarity * (sizes[i] + sizes[part] - common) - 1e-9]
            if len(linked):
                yield i, linked
        mark[local[i]] = 0


def _block(key: tuple, table: pa.Table) -> pa.Table:
    nodes, at = np.unique(np.asarray(table["node"]), return_index=True)
    table = table.take(pa.array(at))
    sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
    values = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint8).reshape(len(nodes), -1)
    size, block = np.asarray(table["size"]), np.asarray(table["block"])
    count, parent = np.zeros(len(nodes), np.int64), list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, js in links_within(sets, values, block, key[1].as_py() != key[2].as_py()):
        count[i] += size[js].sum()
        count[js] += size[i]
        for j in js.tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    top = np.array([root(x) for x in range(len(nodes))])
    some = np.flatnonzero(count)
    return pa.table({"node": nodes[some], "links": count[some], "top": nodes[top[some]]})


def numbered(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """classes (key, rep, ...) with node, their number; and key, rep and node of those whose node isn't their rep (None: there
    are none), because another class has the same rep."""
    shared = written(classes.groupBy("rep").agg(F.min("key").alias("owner"), F.count("*").alias("held")).where("held > 1").select("rep", "owner"), "shared")
    if shared.isEmpty():
        return classes.withColumn("node", F.col("rep")), None
    low, high = classes.agg(F.min("rep"), F.max("rep")).first()
    free = 1 << 56  # more than the numbers given below
    if high + free < 1 << 63:
        node = F.lit(high + 1) + F.monotonically_increasing_id()
    elif low - free >= -(1 << 63):
        node = F.lit(low - 1) - F.monotonically_increasing_id()
    else:
        raise ValueError("doc_ids that repeat with different texts reach both ends of the range of 64 bits")
    others = written(join_unique(classes.select("key", "rep"), shared, "rep").where("key <> owner").select("key", "rep", node.alias("node")), "others")
    return written(classes.join(others.select("key", "node"), "key", "left").withColumn("node", F.coalesce("node", "rep")), "classes"), others


def _joined(docs: DataFrame) -> DataFrame:
    """What jaccard_join() gives, with said (hash of the text) and chosen (the row is of the class that stands for its class_id,
    and has its doc_id; null if it has no words or doc_id)."""
    shared_dir(docs.sparkSession)
    texts = id_and_text(docs).withColumn("said", F.xxhash64("text"))
    every = written(texts.mapInArrow(_features, "doc_id long, said long, key binary, n_shingles long, values binary"), "features")
    rows = every.where("doc_id is not null and n_shingles > 0")
    classes = written(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.min_by("said", F.struct("doc_id", "said")).alias("rep_said"), F.first("values").alias("values")), "classes")
    classes, others = numbered(classes)
    n = rows.count()

    bands = written(classes.select("node", "values").mapInArrow(_band_rows, "node long, band long"), "bands")
    met = written(bands.groupBy("band").agg(F.count("*").alias("held")).where("held > 1"), "met")
    most = max(1, n * BANDS // HOT)  # so that fewer than HOT bands are hot
    tied = may_match(bands, met, ["band"]).where("__may").select("node", "band")
    tied = tied.join(F.broadcast(met.where(F.col("held") > most)), "band").unionByName(tied.join(met.where(F.col("held") <= most), "band"))
    parts = F.ceil(F.col("held") / MEMBERS).cast("long")
    members = tied.join(classes.select("node", "values"), "node").withColumn("parts", parts)
    members = members.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "band"), "parts")).otherwise(F.lit(0).cast("long")))
    # a band of several parts goes to a task for each two of them
    rest = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("part"))).otherwise(F.array(F.lit(0).cast("long")))
    members = members.withColumn("other", F.explode(rest))
    dealt = F.lit(max(1, met.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0] // (2 * BLOCK)))
    task = F.when(F.col("parts") > 1, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), dealt) - dealt)
    members = members.groupBy(task.alias("task"), F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    together = components(members.applyInArrow(_kin, "u long, v long"))

    blocks = together.groupBy("component").agg(F.count("*").alias("members"))
    blocks = blocks.select("component", F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"))
    wanted = together.join(blocks, "component").join(classes, "node").select("node", F.col("rep").alias("doc_id"), F.col("rep_said").alias("said"), "size", "component", "blocks", "key", "values")
    wanted = written(wanted, "wanted")
    dealt = max(1, -(-wanted.where("blocks = 1").count() // BLOCK))
    payload = may_match(texts, wanted, ["doc_id", "said"]).where("__may").join(wanted, ["doc_id", "said"])
    payload = payload.select("node", "text", "size", "component", "blocks", "key", "values").mapInArrow(_payload, "node long, size long, component long, blocks long, values binary, shingles binary")
    payload = payload.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.lit(0).cast("long")))
    payload = payload.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(dealt)) - dealt)
    groups = payload.groupBy(task.alias("task"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    found = written(groups.applyInArrow(_block, "node long, links long, top long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tops = components(found.where("node <> top").select(F.col("node").alias("u"), F.col("top").alias("v")))
    if others is None:
        tops = tops.select("node", F.col("component").alias("class_id"), (F.col("node") == F.col("component")).alias("chosen"))
    else:  # the least node isn't always that with the least doc_id
        tops = written(tops.join(others.select("node", "rep"), "node", "left").withColumn("rep", F.coalesce("rep", "node")), "tops")
        least = tops.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
        tops = join_unique(tops, written(least, "least"), "component").select("node", F.col("least.rep").alias("class_id"), (F.col("node") == F.col("least.node")).alias("chosen"))
    known = classes.select("key", "rep", "node", "size").join(links, "node", "left").join(tops, "node", "left")
    known = written(known.select("key", F.col("rep").alias("copy_id"), "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("chosen", F.lit(True)).alias("chosen")), "known")
    most = max(1, n // HOT)
    own = rows.select("doc_id", "said", "key", "n_shingles")
    result = own.join(F.broadcast(known.where(F.col("size") > most)), "key").unionByName(own.join(known.where(F.col("size") <= most), "key"))
    result = result.select("doc_id", "class_id", "n_links", "copy_id", "n_shingles", "key", "said", (F.col("chosen") & (F.col("doc_id") == F.col("copy_id"))).alias("chosen"))
    alone = every.where("doc_id is null or n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), "n_shingles", "key", "said", F.lit(None).cast("boolean").alias("chosen"))
    return result.unionByName(alone)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, copy_id, n_shingles of each row of docs (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of word 5-grams is SIMILARITY or more; n_links is the number of
    other rows a row is linked with, copies among them; class_id is the smallest doc_id that links lead to, copy_id the smallest
    with an equal set. A text without words (null, empty) has no shingles, is linked with nothing and is its own class and copy.
    Rows with a null doc_id get null ids and no links and give none. Rows that repeat a doc_id are rows of their own; where they
    differ in text, links and class_id are found for each. An empty table gives an empty result; other columns of docs are not read.
    """
    return _joined(docs).select("doc_id", "class_id", "n_links", "copy_id", "n_shingles")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that stay, with the columns of docs: of each group of linked rows one with the smallest doc_id (of rows that
    repeat it with equal sets one), and all rows without words or doc_id."""
    rows = written(_joined(docs).where("chosen is not null").select(F.col("doc_id").alias("id"), "said", "key", "chosen"), "joined")
    kept = rows.where("chosen").groupBy("id", "key").agg(F.min("said").alias("said")).select("id", "said", F.lit(True).alias("stay"))
    each = rows.groupBy("id", "said").agg(F.count("*").alias("rows")).join(kept, ["id", "said"], "left")
    return rows_that_stay(docs, written(each.where("stay is null or rows > 1").select("id", "said", F.coalesce("stay", F.lit(False)).alias("stay")), "told"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
