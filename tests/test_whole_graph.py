"""The queries on all nodes and edges: PageRank against dense matrices, the others against their SQL, at the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from kgspark.sources import star
from kgspark.vocab import NAMESPACE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ["rdf_triples", "turtle_lines", "bgp_join", "ask_entailed", "subclass_entail", "sparql_filter"])
def test_whole_graph_matches_sql(spark, con, name):
    rows, held = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert sorted(rows.columns) == sorted(held.columns)
    assert Counter(map(tuple, rows.select(*held.columns).collect())) == Counter(held.fetchall())


def test_export_holds_all_families_of_edges(spark, con):
    held = dict(con.sql(f"select predicate, count(*) from ({star.EDGES}) x group by predicate").fetchall())
    got = {r["p"]: r["count"] for r in entry.queries()["rdf_triples"](spark, SF).groupBy("p").count().collect()}
    assert len(held) == 7 and {p: got[NAMESPACE + p] for p in held} == held and got[NAMESPACE + "confidence"] == sum(held.values())


@pytest.mark.parametrize("name", ["ppr_50", "ppr_no_seed_uniform"])
def test_whole_graph_ranks(spark, con, name):
    edges = con.sql(f"select src, dst, confidence from ({star.EDGES}) x").fetchall()
    ids = sorted({x for e in edges for x in e[:2]})
    at, n = {x: i for i, x in enumerate(ids)}, len(ids)
    w = np.zeros((n, n))
    for a, b, c in edges:
        w[at[a], at[b]] += c
        w[at[b], at[a]] += c
    w /= w.sum(axis=1, keepdims=True)
    if name == "ppr_50":
        queries = {f"q{k}": np.eye(n)[at[f"nation/{k}"]] for k in range(25)}
    else:
        queries = {"q": np.full(n, 1 / n)}
    start = np.array(list(queries.values()))
    rank = np.full(start.shape, 1 / n)
    for _ in range(50):
        rank = 0.85 * rank @ w + 0.15 * start
    want = {(q, x): rank[k, i] for k, q in enumerate(queries) for x, i in at.items()}
    got = {(r["query_id"], r["id"]): r["r"] for r in entry.queries()[name](spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-9 and any(x.startswith("order/") for _, x in got)
