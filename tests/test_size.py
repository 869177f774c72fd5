"""What large tables need: common words in entity linking, ranks by blocks, and the sign test of many pairs."""

import time
from fractions import Fraction
from math import comb

import pytest

from kgspark.operators import evalkit, graph, guards, retrieve, store


def labelled(spark, n):
    words = ["red", "blue", "green", "supplier"]
    rows = [(f"n{k:03}", f"{words[k % 3]} {'supplier ' if k % 2 else ''}{k % 40} {words[k % 4]}") for k in range(n)]
    return spark.createDataFrame(rows, "id string, name string")


@pytest.mark.parametrize("limit", [1, 3, 8, 50])
def test_common_words_give_the_same_links(spark, limit):
    own = labelled(spark, 150)
    asked = spark.createDataFrame([(k, f"{'red' if k % 2 else 'blue green'} {'supplier' if k % 3 else ''} {k % 40}") for k in range(30)] + [(30, "nothing"), (31, None)], "query_id long, text string")
    held = {r["id"]: set(r["name"].split()) for r in own.collect()}
    want = set()
    for r in asked.collect():
        found = [(len(held[i] & set((r["text"] or "").split())), i) for i in held]
        want |= {(r["query_id"], i, n) for n, i in sorted((x for x in found if x[0]), reverse=True)[:limit]}
    for common in (1, 30, 10**6):
        got = [tuple(r) for r in retrieve.link_entities(asked, own, limit, common=common).select("query_id", "id", "overlap").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_common_words_never_meet_label_by_label(spark):
    """Each of 4,000 answers shares its word with 4,000 labels: 16 million pairs before, of which 50 an answer are needed."""
    own = spark.range(4000).selectExpr("concat('s', id) as id", "concat('supplier ', id) as name")
    asked = spark.range(4000).selectExpr("id as query_id", "concat('Supplier ', id) as text")
    links = retrieve.link_entities(asked, own, 50)
    joins = links._jdf.queryExecution().optimizedPlan().toString()
    assert "held" in joins and links.count() == 4000 * 50
    told = guards.groundedness(asked, spark.range(4000).selectExpr("id as query_id", "concat('s', id) as id"), own)
    assert {(r["grounded"], r["support"]) for r in told.collect()} == {(False, 0.02)}


def test_sign_test_of_many_pairs():
    for wins, losses in ((500, 501), (0, 1001), (40, 1200), (1400, 1500), (0, 1070), (2, 1500), (900, 1300), (1500, 1500)):
        n = wins + losses
        want = min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)), 2**n))
        assert evalkit.binomial_tail(wins, losses) == pytest.approx(float(want), rel=1e-12)
    began = time.time()
    assert evalkit.binomial_tail(450_000, 450_000) == 1.0 and evalkit.binomial_tail(10**9, 10**9 + 100_000) == pytest.approx(0.02534, rel=2e-3)
    assert evalkit.binomial_tail(100_000, 800_000) == 0.0 and time.time() - began < 5


def test_ranks_by_blocks_equal_ranks_in_a_task(spark, monkeypatch):
    """Parallel and weightless edges, stuck nodes, a query without seeds, more blocks than cores."""
    monkeypatch.setattr(graph, "BLOCK_VERTICES", 20)
    adj = [(f"n{k * k % 90}", f"n{k % 97}", 0.25 + k % 3) for k in range(400)] + [("n1", "sink", 2.0), ("n2", "idle", 0.0), ("n1", "sink", 1.0), ("idle", "n3", 0.0)]
    rows = spark.createDataFrame(adj, "src string, dst string, w double")
    seeds = spark.createDataFrame([(k % 10, f"n{k}") for k in range(30)] + [(10, "nowhere"), (3, "n3"), (4, "nowhere")], "query_id int, id string")
    one, two = ({(r["query_id"], r["id"]): r["r"] for r in graph.personalized_pagerank(rows, seeds, rounds=6, small=small, together=6).collect()} for small in (10**6, 0))
    assert len(two) == 11 * len({x for e in adj for x in e[:2]}) and one.keys() == two.keys()
    assert max(abs(one[k] - two[k]) for k in one) < 1e-12


def test_ranks_by_blocks_make_no_row_of_an_edge(spark, monkeypatch, tmp_path):
    """The rounds before kept checkpoints and shuffles of all edges and of ranks by rows; now the two last rounds' arrays stay."""
    rows = spark.range(5000).selectExpr("concat('a', id % 500) as src", "concat('b', id % 499) as dst", "1.0D as w")
    monkeypatch.setattr(graph, "shared", lambda spark: f"file://{tmp_path}")
    ranks = graph.personalized_pagerank(rows, spark.createDataFrame([(1, "a1")], "query_id int, id string"), rounds=3, small=0)
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("ranks-*/r*") if not p.name.endswith(".crc")}
    assert left == {"r0-3"} and ranks.count() == 999


@pytest.mark.parametrize("lost", [0, 40])
def test_ranks_by_blocks_compute_edges_once(spark, monkeypatch, lost):
    """The sum over all ends as text computed all edges once more than the blocks did, and shuffled them; with names (of which some have
    no edge) each edge is computed once, in one direction. Ends that are missing among the names are found all the same."""
    monkeypatch.setattr(graph, "BLOCK_VERTICES", 20)
    adj = [(f"n{k * k % 90}", f"n{k % 97}", 0.25 + k % 3) for k in range(400)] + [("n1", "sink", 2.0), ("idle", "n2", 0.0), ("n1", "n1", 1.0), ("n3", "n4", None)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(adj, "src string, dst string, w double")
    names = spark.createDataFrame([(f"n{k}",) for k in range(97 - lost)] + [("alone",)] + [("sink",), ("idle",)] * (not lost), "id string")
    seeds = spark.createDataFrame([(1, "n5"), (1, "n8"), (1, "n5"), (2, "alone"), (3, "sink")], "query_id int, id string")
    counted = rows.mapInArrow(count, rows.schema)
    one = {(r["query_id"], r["id"]): r["r"] for r in graph.personalized_pagerank(store.both_ways(rows), seeds, rounds=7).collect()}
    two = graph.personalized_pagerank(counted, seeds, rounds=7, small=0, names=names, both=True).collect()
    assert len(one) == len(two) == 3 * len({x for e in adj for x in e[:2]}) and max(abs(one[r["query_id"], r["id"]] - r["r"]) for r in two) < 1e-12
    assert lost or seen.value == len(adj)


def test_notes_of_a_large_graph_compute_edges_once(spark, monkeypatch):
    """Ranks and the count of neighbours computed all edges three times and shuffled their ends as text; the blocks know both now."""
    adj = [(f"n{k * k % 90}", f"n{k % 97}", 0.25 + k % 3) for k in range(400)] + [("n1", "status", 2.0), ("n2", "status", 1.0), ("n1", "n1", 1.0), ("n3", "n4", 0.0)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(adj, "src string, dst string, w double")
    nodes = spark.createDataFrame([(f"n{k}", f"note {k}" if k % 3 else None, k) for k in range(98)], "id string, note_path string, seq long")
    seeds = spark.createDataFrame([(1, "n5"), (1, "n8"), (2, "n7"), (3, "nowhere")], "query_id int, id string")
    want = {(r["query_id"], r["id"], r["seq"]): r["score"] for r in graph.note_scores(graph.personalized_pagerank(store.both_ways(rows), seeds), store.both_ways(rows), nodes).collect()}
    got = graph.note_ranks(rows.mapInArrow(count, rows.schema), seeds, nodes, small=0, both=True, others=spark.createDataFrame([("status",)], "id string")).collect()
    assert len(got) == len(want) > 150 and max(abs(want[r["query_id"], r["id"], r["seq"]] - r["score"]) for r in got) < 1e-12
    assert seen.value == len(adj)
    monkeypatch.setattr(graph, "CHUNK", 7)
    again = graph.note_ranks(rows, seeds, nodes, small=0, both=True).collect()
    assert {(r["query_id"], r["id"], r["seq"]): round(r["score"], 12) for r in again} == {k: round(v, 12) for k, v in want.items()}
