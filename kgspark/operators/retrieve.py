"""Entity linking, rank fusion and the hybrid route, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_label, tokens
from ..session import cut, written
from ..vocab import STOPWORDS
from . import graph, lexical

RRF_K = 60
LEXICAL_DEPTH = 10
#: A token of more labels than this, and of more than its square in pairs of label and query, is common.
COMMON = 1000


def link_entities(queries: DataFrame, nodes: DataFrame, limit: int = 8, stopwords: list[str] = STOPWORDS, common: int = COMMON) -> DataFrame:
    """query_id, id, overlap: the nodes whose labels share most distinct tokens with a query (query_id, text); ties by id, descending.

    Tokens of more than ``common`` labels that many queries ask for never meet label by label: see _common_links().
    """
    asked = cut(queries.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit("")), stopwords))).alias("token")).distinct())
    labels = nodes.select("id", F.explode(F.array_distinct(tokens(clean_label(F.col("name"), F.col("id")), stopwords))).alias("token"))
    labels = cut(labels.join(asked.select("token").distinct(), "token", "left_semi").select("id", "token").distinct())
    often = asked.groupBy("token").agg(F.count("*").alias("a")).join(labels.groupBy("token").agg(F.count("*").alias("p")), "token")
    often = cut(often.where((F.col("p") > common) & (F.col("a") * F.col("p") > common * common)).select("token"))
    if often.isEmpty():
        shared = asked.join(labels, "token").groupBy("query_id", "id").agg(F.count("*").alias("overlap"))
    else:
        shared = _common_links(asked, labels, F.broadcast(often), limit)
    best = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("id"))
    return shared.withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit).drop("n")


def _common_links(asked: DataFrame, labels: DataFrame, often: DataFrame, limit: int) -> DataFrame:
    """query_id, id, overlap of asked (query_id, token) and labels (id, token): all pairs that share a token not in ``often``, and of
    the others those that can be among the first ``limit`` of a query.

    Labels with the same common tokens overlap alike in them, so that only the ``limit`` last ids of each such set can be needed
    unless a rarer token is shared too; queries with the same common tokens have the same answer.
    """
    sets = lambda df, key, name: df.join(often, "token", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("token")).alias(name))
    said, held = cut(sets(asked, "query_id", "said")), cut(sets(labels, "id", "held"))
    last = held.withColumn("n", F.row_number().over(Window.partitionBy("held").orderBy(F.desc("id")))).where(F.col("n") <= limit).select("held", "id")
    ours, theirs = (df.select(c).distinct().select(c, F.explode(c).alias("token")) for df, c in ((said, "said"), (held, "held")))
    alike = ours.join(theirs, "token").groupBy("said", "held").agg(F.count("*").alias("overlap")).join(last, "held").select("said", "id", "overlap")
    best = Window.partitionBy("said").orderBy(F.desc("overlap"), F.desc("id"))
    alike = alike.withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit).drop("n")
    rare = asked.join(often, "token", "left_anti").join(labels.join(often, "token", "left_anti"), "token").groupBy("query_id", "id").agg(F.count("*").alias("few"))
    both = rare.join(said, "query_id", "left").join(held, "id", "left")
    both = both.select("query_id", "id", (F.col("few") + F.size(F.coalesce(F.array_intersect("said", "held"), F.array().cast("array<string>")))).alias("overlap"))
    return both.unionByName(said.join(alike, "said").select("query_id", "id", "overlap")).groupBy("query_id", "id").agg(F.max("overlap").alias("overlap"))


def reciprocal(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """ranked (query_id, id, rank from 1) with rrf = 1 / (k + rank - 1)."""
    return ranked.withColumn("rrf", 1 / (F.lit(k) + F.col("rank") - 1))


def fuse(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k best by the sum of both lists' reciprocal ranks (query_id, id, rank); ties by id."""
    one, two = (reciprocal(x).groupBy("query_id", "id").agg(F.sum("rrf").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = one.join(two, ["query_id", "id"], "full_outer").select("query_id", "id", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc("id"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def multi_list_rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, rank, id, score of any number of lists (query_id, list, pos from 0, id): an id that a list holds more than once adds up
    each time; ties by first appearance."""
    total = lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("pos"))).alias("score"), F.min(F.struct("list", "pos")).alias("first"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc("first"))
    return total.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "id", "score")


def ordered_distinct(ranked: DataFrame, k: int) -> DataFrame:
    """The first k distinct ids of each list (query_id, pos, id), by first occurrence."""
    first = ranked.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("rank") <= k)


def graph_ranking(queries_seeds: DataFrame, adj: DataFrame, nodes: DataFrame, k: int = LEXICAL_DEPTH, wanted: DataFrame | None = None, both: bool = False, others: DataFrame | None = None) -> DataFrame:
    """query_id, id, rank, score: the k best notes by personalised PageRank and specificity; ties by the order of writes; scores
    that differ by about 1e-12 of themselves or less are ties, since sums in another order differ by more than nothing.

    wanted (query_id, id; a few of each query): those have their rank among all notes too, by counting the better ones, so that no
    task sorts all notes of a query; they are few enough to be sent to all tasks. both, others: see graph.note_ranks().
    """
    scores = graph.note_ranks(adj, queries_seeds, nodes, both=both, others=others)
    scores = scores.withColumn("level", F.floor(F.log("score") * F.lit(1e12) + 0.5))
    scores = scores if wanted is None else written(scores)
    best = Window.partitionBy("query_id").orderBy(F.desc("level"), F.asc("seq"))
    top = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")
    if wanted is None:
        return top
    some = scores.join(F.broadcast(wanted.select("query_id", "id")), ["query_id", "id"], "left_semi")
    some = cut(some.select("query_id", "id", F.col("score").alias("own"), F.col("level").alias("own_level"), F.col("seq").alias("at")))
    better = (F.col("level") > F.col("own_level")) | (F.col("level") == F.col("own_level")) & (F.col("seq") < F.col("at"))
    asked = scores.select("query_id", "level", "seq").join(F.broadcast(some), "query_id").groupBy("query_id", "id", F.col("own").alias("score"))
    asked = asked.agg((F.count_if(better) + 1).cast("int").alias("rank")).select("query_id", "id", "rank", "score")
    return top.unionByName(asked.join(top, ["query_id", "id"], "left_anti"))


def retrieve(queries: DataFrame, docs: DataFrame, nodes: DataFrame, adj: DataFrame, k: int = 5, depth: int = LEXICAL_DEPTH, linked: DataFrame | None = None, kept: tuple | None = None, both: bool = False, others: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, text, score: graph and lexical rankings fused; a query that links to no node has the lexical one alone.

    docs: id, text, ord; both rankings go ``depth`` deep whatever k is, the graph one over all notes. kept: docs' index, if there is one.
    both, others: see graph.note_ranks().
    """
    words = cut(lexical.top_k(docs, queries, depth, kept=kept))
    linked = cut(link_entities(queries, nodes)) if linked is None else linked
    seeded = linked.select("query_id").distinct()
    # beside the lexical ids only the k best of the others can be among the fused
    ranks = graph_ranking(linked.select("query_id", "id"), adj, nodes, k + depth, words, both, others)
    fused = fuse(ranks.select("query_id", "id", "rank"), words.join(seeded, "query_id", "left_semi").select("query_id", "id", "rank"), k)
    alone = words.join(seeded, "query_id", "left_anti").where(F.col("rank") <= k)
    every = fused.unionByName(alone.select("query_id", "rank", "id", "score"))
    return every.join(docs.select("id", "text"), "id", "left").select("query_id", "rank", "id", F.coalesce("text", F.lit("")).alias("text"), F.round("score", 6).alias("score"))
