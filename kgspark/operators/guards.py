"""Guards of an answer: groundedness, refusal, contradiction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import FUNCTIONAL
from .retrieve import link_entities


def groundedness(answers: DataFrame, retrieved: DataFrame, nodes: DataFrame, threshold: float = 0.5, limit: int = 50) -> DataFrame:
    """query_id, grounded, support of each answer (query_id, text): the share of its linked nodes among the ids retrieved (query_id,
    id); without linked nodes it isn't grounded. The share is compared as it is and told to four places."""
    linked = link_entities(answers, nodes, limit)
    had = retrieved.select("query_id", "id").distinct().withColumn("had", F.lit(1))
    share = linked.join(had, ["query_id", "id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("had", F.lit(0))) / F.count("*")).alias("share"))
    out = answers.select("query_id").join(share, "query_id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    known = out.join(share.select("query_id", F.lit(True).alias("linked")), "query_id", "left")
    return known.select("query_id", (F.coalesce("linked", F.lit(False)) & (F.col("share") >= threshold)).alias("grounded"), F.round("share", 4).alias("support"))


def should_refuse(queries: DataFrame, linked: DataFrame) -> DataFrame:
    """The queries that link to no node."""
    return queries.join(linked.select("query_id").distinct(), "query_id", "left_anti")


def contradictions(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims (src, predicate, dst) under a functional predicate whose subject has another object already."""
    other = edges.where(F.col("predicate").isin(FUNCTIONAL)).select("src", "predicate", F.col("dst").alias("held"))
    return claims.join(other, ["src", "predicate"]).where("held <> dst").select("src", "predicate", "dst", "held").distinct()
