"""Evaluation: probes, ranks, hit@k, MRR, recall, lift, the sign test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_label, tokens

CUTOFFS = [1, 5, 10]
FAMILIES = ["multi_hop", "simple_lookup"]
#: Pairs up to which the sign test adds whole numbers up; their digits grow with the pairs, and so do the terms.
EXACT = 1000


def multi_hop_probes(nodes: DataFrame, edges: DataFrame, max_overlap: int = 1) -> tuple[DataFrame, DataFrame]:
    """(probes: family, query, gold_id, seq; one row with discarded). A probe is an edge other than ``mentions`` between two notes
    whose labels share max_overlap tokens at most; of equal (query, gold) the first stays. An edge whose labels share more is
    discarded each time it occurs."""
    notes = nodes.where("note_path is not null").select("id", clean_label(F.col("name"), F.col("id")).alias("label"))
    pairs = edges.where("predicate <> 'mentions' and src <> dst").select("src", "dst", "seq")
    pairs = pairs.join(notes.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(notes.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    shared = F.size(F.array_intersect(tokens(F.col("a")), tokens(F.col("b"))))
    pairs = pairs.withColumn("far", shared <= max_overlap)
    probes = pairs.where("far").groupBy(F.col("a").alias("query"), F.col("dst").alias("gold_id")).agg(F.min("seq").alias("seq"))
    return probes.select(F.lit("multi_hop").alias("family"), "query", "gold_id", "seq"), pairs.where("not far").agg(F.count("*").alias("discarded"))


def simple_probes(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """family, query, gold_id: each note by its label, by id; the first n."""
    notes = nodes.where("note_path is not null").select(F.lit("simple_lookup").alias("family"), clean_label(F.col("name"), F.col("id")).alias("query"), F.col("id").alias("gold_id"))
    return notes.orderBy("gold_id").limit(n) if n is not None else notes


def gold_ranks(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """probes (query_id, family, gold_id) with rank: the first place of the gold id among the hits (query_id, id, rank), or null."""
    first = hits.groupBy("query_id", F.col("id").alias("gold_id")).agg(F.min("rank").alias("rank"))
    return probes.join(first, ["query_id", "gold_id"], "left").select("query_id", "family", "gold_id", "rank")


def evaluate(ranks: DataFrame, k: int = 10) -> DataFrame:
    """group, n, hit_1, hit_5, hit_10, mrr of all probes and of each fixed family. A cutoff beyond k is null, but 0 where there are no
    probes; values have four places."""
    cols = [F.count("*").alias("n"), *[F.round(F.avg(F.when(F.col("rank") <= c, 1.0).otherwise(0.0)), 4).alias(f"hit_{c}") for c in CUTOFFS], F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr")]
    found = ranks.groupingSets([[F.col("family")], []], F.col("family")).agg(F.grouping("family").alias("all"), *cols)
    found = found.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("family")).alias("group"), "n", *[f"hit_{c}" for c in CUTOFFS], "mrr")
    groups = ranks.sparkSession.createDataFrame([(g,) for g in ("overall", *FAMILIES)], "group string")
    out = groups.join(found, "group", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for c in CUTOFFS:
        own = F.coalesce(f"hit_{c}", F.lit(0.0))
        out = out.withColumn(f"hit_{c}", own if c <= k else F.when(F.col("n") == 0, F.lit(0.0)))
    return out.withColumn("mrr", F.coalesce("mrr", F.lit(0.0)))


def lift(arm: DataFrame, base: DataFrame) -> DataFrame:
    """group and, for each metric, arm minus base to four places; null where either is."""
    names = [*[f"hit_{c}" for c in CUTOFFS], "mrr"]
    both = arm.alias("a").join(base.alias("b"), "group")
    return both.select("group", *[F.round(F.col(f"a.{m}") - F.col(f"b.{m}"), 4).alias(m) for m in names])


def recall_at(got: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of gold ids (query_id, id) among the first k got (query_id, id, rank)."""
    hits = got.where(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return gold.select("query_id", "id").distinct().join(hits, ["query_id", "id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def _log_factorial_rest(n: int) -> float:
    """ln(n!) less Stirling's (n + 1/2) ln(n) - n + ln(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + math.log(2 * math.pi) / 2)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _half_split(k: int, n: int) -> float:
    """C(n, k) / 2**n by Loader's saddle point, to nearly all digits whatever n; k from 1 to n - 1."""
    e = (n - 2 * k) / n  # how uneven; k is n/2 (1 - e), and the rest n/2 (1 + e)
    if abs(e) < 0.1:
        far, power, i = 0.0, e * e, 1
        while power > far * 1e-18:  # (1 - e) ln(1 - e) + (1 + e) ln(1 + e) = sum of e**2i / (i (2i - 1))
            far, power, i = far + power / (i * (2 * i - 1)), power * e * e, i + 1
    else:
        far = (1 - e) * math.log1p(-e) + (1 + e) * math.log1p(e)
    rest = _log_factorial_rest(n) - _log_factorial_rest(k) - _log_factorial_rest(n - k)
    return math.exp(rest - n / 2 * far) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def binomial_tail(wins: int, losses: int) -> float:
    """The exact two-sided probability of such a split or a more uneven one under even chances; 1 without data. Beyond EXACT pairs
    the terms come from the greatest, each from the one before, until they change nothing: some root of n of them."""
    n, k = wins + losses, min(wins, losses)
    if n <= EXACT:
        return min(1.0, 2 * math.fsum(math.comb(n, i) / 2**n for i in range(k + 1))) if n else 1.0
    term = _half_split(k, n) if k else 0.5**n if n < 1075 else 0.0
    total = 0.0
    while term > total * 1e-18:
        total, term, k = total + term, term * k / (n - k + 1), k - 1
    return min(1.0, 2 * total)


def sign_test(base: DataFrame, arm: DataFrame) -> tuple[int, int, float]:
    """(better, worse, p) of paired values (query_id, recall); ties are left out."""
    both = base.alias("a").join(arm.alias("b"), "query_id")
    won = both.agg(F.count_if(F.col("b.recall") > F.col("a.recall")).alias("w"), F.count_if(F.col("b.recall") < F.col("a.recall")).alias("l")).first()
    return won["w"], won["l"], binomial_tail(won["w"], won["l"])


def controls(real: float, positive: float, shuffled: float) -> list[str]:
    """What speaks against a run: the positive control under 0.8, or the shuffled one over half the real value."""
    return [s for s, bad in (("positive control under 0.8", positive < 0.8), ("shuffled labels score over half the real ones", real <= 0 or shuffled / real > 0.5)) if bad]
