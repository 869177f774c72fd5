"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHEAP = ["corpus_fingerprint", "inline_cue_edges", "note_chunks", "gold_ranks", "upsert_nodes_lww", "upsert_edges_null_key", "frontmatter_fields", "wikilink_edges", "broader_rollup", "entity_link", "rrf_fusion", "multi_list_rrf", "contradictions", "node_iri", "shacl_functional", "bgp_join", "hit_mrr", "lift", "recall_at_k"]


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float | Decimal):
        return round(float(x), 9)
    return int(x) if hasattr(x, "item") and float(x).is_integer() else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    rows = entry.queries()[name](spark, SF)
    held = con.sql(entry.oracle_sql()[name])
    assert sorted(rows.columns) == sorted(held.columns)
    at = [held.columns.index(c) for c in rows.columns]
    want = sorted([[plain(r[i]) for i in at] for r in held.fetchall()], key=str)
    assert sorted([[plain(x) for x in r] for r in rows.collect()], key=str) == want


def test_queries_without_sql_are_known():
    engine = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}
    assert engine - set(entry.oracle_sql()) == set()
