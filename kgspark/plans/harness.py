"""Comparisons of retrieval arms: three arms over probes from the graph, and four over labelled sessions with controls.

All probes of an arm are one DataFrame and run together. Results hold numbers alone: no id, path or text leaves a harness.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evalkit, graph, lexical, reason, retrieve, store
from ..session import cut
from ..sources.markdown import read_sessions
from ..sources.sinks import write_results
from .service import Service

#: Sessions whose gold is quoted in the positive control; characters quoted; fewest words of a quotation.
QUOTED, QUOTE, WORDS = 25, 400, 8


def _metrics(df: DataFrame) -> dict:
    return {r["group"]: {c: r[c] for c in df.columns if c != "group"} for r in df.collect()}  # three rows


def three_arms(service: Service, k: int = 10, max_multihop: int | None = None, max_simple: int | None = None, path: str | None = None) -> dict:
    """Probes of a service's graph over its lexical arm, its graph arm and the graph arm on the entailed adjacency; the same snapshot
    and probes for each. Caps are told by ``capped``; with a path the result is written there too."""
    nodes, edges = service.nodes, service.edges
    multi, discarded = evalkit.multi_hop_probes(nodes, edges)
    multi, simple = cut(multi), cut(evalkit.simple_probes(nodes))
    sizes = {"multi_hop": multi.count(), "simple_lookup": simple.count()}
    some = []
    for df, order, most, name in ((multi, ["seq"], max_multihop, "multi_hop"), (simple, ["gold_id"], max_simple, "simple_lookup")):
        some.append((df.orderBy(*order).limit(most) if most is not None else df).select("family", "query", "gold_id"))
    capped = any(m is not None and sizes[n] > m for n, m in (("multi_hop", max_multihop), ("simple_lookup", max_simple)))
    probes = cut(some[0].unionByName(some[1]))
    probes = cut(probes.withColumn("query_id", F.monotonically_increasing_id()))
    asked = probes.select("query_id", F.col("query").alias("text"))
    reasoned = cut(reason.reasoned_adjacency(nodes, edges, service.adj))
    hits = {
        "flat": lexical.top_k(service.docs, asked, k, kept=service.kept),
        "graph": retrieve.retrieve(asked, service.docs, nodes, service.adj, k, kept=service.kept),
        "reasoned": retrieve.retrieve(asked, service.docs, nodes, reasoned, k, kept=service.kept),
    }
    arms = {name: cut(evalkit.evaluate(evalkit.gold_ranks(probes.select("query_id", "family", "gold_id"), got), k)) for name, got in hits.items()}
    kept = probes.groupBy("family").count().collect()
    result = {
        "vault": store.counts(nodes, edges).select("nodes", "edges").first().asDict() | {"notes": nodes.where("note_path is not null").count()},
        "probes": {"multi_hop": 0, "simple_lookup": 0} | {r["family"]: r["count"] for r in kept} | {"discarded": discarded.first()["discarded"], "capped": capped},
        "k": k,
        "arms": {name: _metrics(df) for name, df in arms.items()},
        "lift": {f"{a}_vs_{b}": _metrics(evalkit.lift(arms[a], arms[b])) for a, b in (("graph", "flat"), ("reasoned", "flat"), ("reasoned", "graph"))},
    }
    if path:
        write_results(result, path)
    return result


def _ranked(df: DataFrame, depth: int) -> DataFrame:
    return df.where(F.col("rank") <= depth).select("query_id", "id", "rank")


def session_arms(service: Service, asked: DataFrame, depth: int = 20) -> dict[str, DataFrame]:
    """query_id, id, rank to ``depth`` of each arm for the queries (query_id, text): flat (notes by their pieces), note (whole
    notes), ensemble (both fused), ensemble+ppr (and the graph's ranking)."""
    pieces = cut(lexical.chunks(service._notes))
    by_piece = lexical.top_k(pieces, asked, 4 * depth)
    flat = retrieve.ordered_distinct(by_piece.select("query_id", F.col("rank").alias("pos"), F.regexp_replace("id", "#[0-9]+$", "").alias("id")), depth)
    flat = cut(flat.select("query_id", "id", "rank"))
    note = cut(_ranked(lexical.top_k(service.docs, asked, depth, kept=service.kept), depth))
    seeds = retrieve.link_entities(asked, service.nodes).select("query_id", "id")
    # beyond a few times the depth a rank adds less than any rank within it: those can't be among the first
    scores = graph.note_scores(graph.personalized_pagerank(service.adj, seeds), service.adj, service.nodes)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seq"))
    ppr = cut(scores.withColumn("rank", F.row_number().over(best)).select("query_id", "id", "rank"))
    lists = [df.select("query_id", F.lit(n).alias("list"), (F.col("rank") - 1).cast("long").alias("pos"), "id") for n, df in enumerate((note, flat, ppr))]
    both = retrieve.multi_list_rrf(lists[0].unionByName(lists[1]))
    three = retrieve.multi_list_rrf(lists[0].unionByName(lists[1]).unionByName(lists[2]))
    return {"flat": flat, "note": note, "ensemble": cut(_ranked(both, depth)), "ensemble+ppr": cut(_ranked(three, depth))}


def _mean(df: DataFrame) -> float:
    return df.agg(F.coalesce(F.avg("recall"), F.lit(0.0))).first()[0]


def run_controls(service: Service, flat: DataFrame, gold: DataFrame, depth: int, seed: int = 0) -> tuple[dict, list[str]]:
    """(figures, what speaks against the run): the lexical arm with gold (query_id, id) dealt to other queries, and with notes
    asked for by their own words."""
    n = gold.select("query_id").distinct()
    order = Window.orderBy("at")
    real = _mean(evalkit.recall_at(flat, gold, depth))
    # a permutation of the queries, each by its place in two orders; one small row a session
    one = n.withColumn("at", F.col("query_id")).withColumn("place", F.row_number().over(order)).select("query_id", "place")
    two = n.withColumn("at", F.xxhash64("query_id", F.lit(seed))).withColumn("place", F.row_number().over(order)).select(F.col("query_id").alias("other"), "place")
    dealt = one.join(two, "place").join(gold.withColumnRenamed("query_id", "other"), "other").select("query_id", "id")
    shuffled = _mean(evalkit.recall_at(flat, dealt, depth))
    quoted = gold.groupBy("query_id").agg(F.min("id").alias("id")).orderBy("query_id").limit(QUOTED)
    quoted = quoted.join(service.docs.select("id", F.substring("text", 1, QUOTE).alias("text")), "id").where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= WORDS)
    quoted = cut(quoted)
    found = retrieve.ordered_distinct(lexical.top_k(cut(lexical.chunks(service._notes)), quoted, 4 * depth).select("query_id", F.col("rank").alias("pos"), F.regexp_replace("id", "#[0-9]+$", "").alias("id")), depth)
    probes = quoted.count()
    positive = _mean(evalkit.recall_at(found.select("query_id", "id", "rank"), quoted.select("query_id", "id"), depth)) if probes else 1.0
    return {"real": real, "shuffled": shuffled, "positive": positive, "probes": probes}, evalkit.controls(real, positive, shuffled) if real else []


def sessions_ab(service: Service, transcripts: str, depth: int = 20, max_sessions: int | None = None, seed: int = 0, controls: bool = True) -> tuple[int, dict]:
    """(exit code, figures) of the four arms over the sessions of a folder: 1 without labelled sessions, 2 on an empty graph (each
    graph arm would be the lexical one), 3 where a control speaks against the run; then the arms' figures are left out."""
    if service.health()["empty"]:
        return 2, {"error": "the graph is empty"}
    sessions = read_sessions(service.spark, transcripts, service.docs.select(F.col("id").alias("path")), max_sessions)
    sessions = cut(cut(sessions).withColumn("query_id", F.monotonically_increasing_id()))
    n = sessions.count()
    if not n:
        return 1, {"error": "no labelled sessions"}
    asked = sessions.select("query_id", F.col("query").alias("text"))
    gold = cut(sessions.select("query_id", F.explode("gold").alias("id")))
    arms = session_arms(service, asked, depth)
    figures = {"sessions": n, "depth": depth, "anchored": retrieve.link_entities(asked, service.nodes).select("query_id").distinct().count()}
    if controls:
        figures["controls"], against = run_controls(service, arms["flat"], gold, depth, seed)
        if against:
            return 3, figures | {"error": "; ".join(against)}
    recalls = {name: cut(evalkit.recall_at(df, gold, depth)) for name, df in arms.items()}
    figures["arms"] = {}
    for name, df in recalls.items():
        figures["arms"][name] = {"recall": _mean(df)}
        if name != "ensemble":
            better, worse, p = evalkit.sign_test(recalls["ensemble"], df)
            figures["arms"][name] |= {"better": better, "worse": worse, "p": p}
    return 0, figures


def main(argv: list[str] | None = None) -> int:
    """python -m kgspark.plans.harness --roots A:B [--transcripts FOLDER]: the four arms over sessions, or else the three over probes."""
    args = argparse.ArgumentParser()
    args.add_argument("--roots", required=True)
    args.add_argument("--transcripts")
    args.add_argument("--path")
    args.add_argument("--depth", type=int, default=20)
    args.add_argument("--max-sessions", type=int)
    args.add_argument("--seed", type=int, default=0)
    args.add_argument("--skip-controls", action="store_true")
    told = args.parse_args(argv)
    service = Service(SparkSession.builder.appName("kgspark").getOrCreate(), told.roots.split(":"), told.path)
    if told.transcripts:
        code, figures = sessions_ab(service, told.transcripts, told.depth, told.max_sessions, told.seed, not told.skip_controls)
    else:
        code, figures = 0, three_arms(service)
    print(json.dumps(figures, indent=2))
    if "error" in figures:
        print(f"ABORT: {figures['error']}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
