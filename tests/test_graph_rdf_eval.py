import math

import pytest

from kgspark.operators import evalkit, graph, guards, rdf, reason, retrieve, sparql, store
from kgspark.sources import sinks
from kgspark.vocab import NAMESPACE

EDGE = "src string, predicate string, dst string, note_path string, span string, confidence double, extractor string, seq long"


def edges(spark, *rows):
    return spark.createDataFrame([(s, p, o, None, None, 1.0, "t", i) for i, (s, p, o) in enumerate(rows)], EDGE)


def nodes(spark, *rows):
    return spark.createDataFrame([(i, t, i, i, n) for n, (i, t) in enumerate(rows)], "id string, type string, name string, note_path string, seq long")


def ranks(adj, spark, *seeds):
    asked = spark.createDataFrame([(1, s) for s in seeds], "query_id long, id string")
    return {r["id"]: r["r"] for r in graph.personalized_pagerank(adj, asked).collect()}


def test_pagerank(spark):
    adj = store.adjacency(edges(spark, ("a", "p", "b"), ("b", "p", "c"), ("d", "p", "e")))
    r = ranks(adj, spark, "a")
    assert r["b"] > r["d"] and abs(sum(r.values()) - 1) < 1e-9 and r["d"] > 0
    assert len(set(round(x, 12) for x in ranks(store.adjacency(edges(spark, ("a", "p", "b"))), spark, "none").values())) == 1
    assert ranks(store.adjacency(edges(spark)), spark, "a") == {}


def test_dangling_mass_goes_to_the_seeds(spark):
    zero = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("x", "y", 0.0), ("y", "x", 0.0)], "src string, dst string, w double")
    r = ranks(zero, spark, "a")
    assert abs(sum(r.values()) - 1) < 1e-9 and r["x"] < 1e-3


def test_vertices_are_the_ends_of_all_edges(spark):
    r = ranks(spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, w double"), spark, "a")
    assert abs(r["a"] - 1 / 1.85) < 1e-3 and abs(r["b"] - 0.85 / 1.85) < 1e-3


def test_queries_go_together_alike(spark):
    adj = store.adjacency(edges(spark, *[(f"n{i}", "p", f"n{i * 7 % 23}") for i in range(1, 23)]))
    asked = spark.createDataFrame([(q, f"n{q + j}") for q in range(19) for j in (0, 0, 3)] + [(99, "none")], "query_id long, id string")
    one, two = ({(r["query_id"], r["id"]): r["r"] for r in graph.personalized_pagerank(adj, asked, rounds=12, small=n).collect()} for n in (graph.SMALL, 0))
    assert one.keys() == two.keys() and len({q for q, _ in one}) == 20 and all(abs(one[k] - two[k]) < 1e-8 for k in one)
    loose = adj.unionByName(spark.createDataFrame([("n1", "x", 1.0), ("x", "y", 0.0)], "src string, dst string, w double"))
    one, two = ({r["id"]: r["r"] for r in graph.personalized_pagerank(loose, asked.where("query_id = 1"), rounds=4, small=n).collect()} for n in (graph.SMALL, 0))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-8 for k in one) and abs(sum(one.values()) - 1) < 1e-9


def test_specificity(spark):
    s = {r["id"]: r["specificity"] for r in graph.node_specificity(store.adjacency(edges(spark, ("a", "p", "b"), ("b", "p", "c")))).collect()}
    assert abs(s["b"] - 1 / (1 + math.log(3))) < 1e-12 and s["a"] > s["b"]


def test_closure_with_cycle(spark):
    chain = edges(spark, ("a", "supersedes", "b"), ("b", "supersedes", "c"), ("x", "supersedes", "y"), ("y", "supersedes", "x"))
    starts = spark.createDataFrame([("a",), ("c",), ("x",)], "start string")
    assert {tuple(r) for r in graph.reachable(chain, starts).collect()} == {("a", "b"), ("a", "c"), ("x", "y"), ("x", "x")}


def test_link_and_guards(spark):
    own = nodes(spark, ("bow", "Note"), ("project_leo-cap.md", "Project"))
    asked = spark.createDataFrame([(1, "the leo and bow"), (2, "nothing here")], "query_id long, text string")
    linked = retrieve.link_entities(asked, own)
    assert {(r["query_id"], r["id"]) for r in linked.collect()} == {(1, "bow"), (1, "project_leo-cap.md")}
    assert [r["query_id"] for r in guards.should_refuse(asked, linked).collect()] == [2]
    had = spark.createDataFrame([(1, "bow")], "query_id long, id string")
    assert {(r["query_id"], r["grounded"], r["support"]) for r in guards.groundedness(asked, had, own).collect()} == {(1, True, 0.5), (2, False, 0.0)}
    claims = spark.createDataFrame([("a", "has_status", "FROZEN"), ("a", "has_status", "LIVE"), ("a", "mentions", "q")], "src string, predicate string, dst string")
    held = edges(spark, ("a", "has_status", "LIVE"), ("a", "mentions", "z"))
    assert [r["dst"] for r in guards.contradictions(claims, held).collect()] == ["FROZEN"]


def test_rdf_and_shapes(spark):
    own = nodes(spark, ("a b/é*~.", "Note"), ("b", "Tool"))
    graph_ = rdf.export(own, edges(spark, ("a b/é*~.", "supersedes", "b"), ("a b/é*~.", "supersedes", "b")))
    assert rdf.validate(graph_)[0] and graph_.where("p like '%confidence'").count() == 2 and graph_.where(f"p = '{NAMESPACE}supersedes'").count() == 1
    assert sinks.turtle_text(graph_).count(" .\n") == graph_.count()
    bad = rdf.export(own, edges(spark, ("b", "has_status", "x"), ("b", "has_status", "y")))
    assert [(r["path"], r["kind"]) for r in rdf.violations(bad).collect()] == [(NAMESPACE + "has_status", "maxCount")]
    assert rdf.export(own.where("false"), edges(spark)).count() == 0


def test_sparql(spark):
    t = spark.createDataFrame([(NAMESPACE + s, NAMESPACE + "p", NAMESPACE + o) for s, o in (("a", "b"), ("b", "c"))], "s string, p string, o string")
    rows = sparql.run(t, sparql.parse("SELECT ?x ?z WHERE { ?x kl:p ?y . ?y kl:p ?z }")).collect()
    assert [tuple(r) for r in rows] == [(NAMESPACE + "a", NAMESPACE + "c")]
    assert sparql.run(t, sparql.parse("ASK { kl:a kl:p+ kl:c }")).first()["answer"]
    assert not sparql.run(t, sparql.parse("ASK { kl:c kl:p+ kl:a }")).first()["answer"]
    rows = sparql.run(t, sparql.parse("SELECT ?x ?z WHERE { ?x kl:p ?y OPTIONAL { ?y kl:p ?z } }")).collect()
    assert {(r["x"][-1], r["z"] and r["z"][-1]) for r in rows} == {("a", "c"), ("b", None)}


def test_sparql_filter_and_products(spark):
    t = spark.createDataFrame([(NAMESPACE + s, NAMESPACE + "p", o) for s, o in (("a", "1"), ("b", "12"), ("c", "Zed"))], "s string, p string, o string")
    said = lambda q: {r["x"][-1] for r in sparql.run(t, sparql.parse(f"SELECT ?x WHERE {{ ?x kl:p ?v {q} }}")).collect()}
    assert said("FILTER (?v > 3)") == {"b"} and said("FILTER (?v != 12 || ?v = \"Zed\")") == {"a", "c"}
    assert said("FILTER regex(?v, \"^z\", \"i\")") == {"c"} and said("FILTER (!contains(?v, \"1\") && bound(?x))") == {"c"}
    assert said("FILTER (?x = kl:a)") == {"a"} and sparql.run(t, sparql.parse("SELECT ?y WHERE { kl:nowhere kl:p* ?y }")).count() == 1
    assert sparql.run(t, sparql.parse("SELECT * WHERE { ?x kl:p ?v . ?y kl:p ?w . ?x kl:p ?w }")).count() == 3
    with pytest.raises(ValueError):
        sparql.PRODUCT, old = 5, sparql.PRODUCT
        try:
            sparql.run(t, sparql.parse("SELECT * WHERE { ?x kl:p ?v . ?y kl:p ?w }"))
        finally:
            sparql.PRODUCT = old


def test_cohort_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(reason, "COHORT", 2)
    own, held = nodes(spark, ("a", "Tool"), ("b", "Tool"), ("c", "Tool")), edges(spark, ("a", "mentions", "b"))
    with pytest.raises(ValueError):
        reason.reasoned_adjacency(own, held, store.adjacency(held), type_cohort=True)


def test_entailment(spark):
    own = nodes(spark, ("a", "Note"), ("b", "Note"), ("c", "Note"), ("p", "Note"))
    held = edges(spark, ("a", "supersedes", "b"), ("b", "supersedes", "c"), ("a", "authored_by", "p"), ("a", "authored_by", "ghost"))
    types, relations = reason.entail(own, held)
    assert ("a", "supersedesTransitively", "c") in {tuple(r) for r in relations.collect()}
    assert {("p", "Person"), ("ghost", "Person")} <= {tuple(r) for r in types.collect()}
    adj = {(r["src"], r["dst"]): r["w"] for r in reason.reasoned_adjacency(own, held, store.adjacency(held)).collect()}
    assert adj["a", "c"] == adj["c", "a"] == adj["a", "b"] == 1.0


def test_functional_objects_merge(spark):
    held = edges(spark, ("a", "supersedes", "b"), ("a", "supersedes", "c"), ("b", "mentions", "x"))
    _, relations = reason.entail(nodes(spark, ("a", "Note")), held)
    assert ("c", "mentions", "x") in {tuple(r) for r in relations.collect()}


def test_cycle_gives_a_loop_of_two(spark):
    held = edges(spark, ("a", "supersedes", "b"), ("b", "supersedes", "a"))
    adj = {(r["src"], r["dst"]): r["w"] for r in reason.reasoned_adjacency(nodes(spark, ("a", "Note"), ("b", "Note")), held, store.adjacency(held)).collect()}
    assert adj["a", "a"] == 2.0 and adj["a", "b"] == 2.0


def test_metrics(spark):
    rows = spark.createDataFrame([("multi_hop", 3), ("multi_hop", 1), ("simple_lookup", None)], "family string, rank int")
    got = {r["group"]: tuple(r)[1:] for r in evalkit.evaluate(rows, 5).collect()}
    assert got["multi_hop"] == (2, 0.5, 1.0, None, 0.6667) and got["simple_lookup"] == (1, 0.0, 0.0, None, 0.0) and got["overall"][0] == 3
    empty = {r["group"]: tuple(r)[1:] for r in evalkit.evaluate(rows.where("false"), 3).collect()}
    assert empty["overall"] == (0, 0.0, 0.0, 0.0, 0.0)
    assert evalkit.binomial_tail(11, 10) == 1.0 and round(evalkit.binomial_tail(3, 10), 3) == 0.092 and evalkit.binomial_tail(0, 0) == 1.0
    assert evalkit.controls(0.6731, 1.0, 0.2499) == [] and len(evalkit.controls(0.1, 0.5, 0.2)) == 2


def test_probes(spark):
    own = nodes(spark, ("apollo", "Note"), ("zenith", "Note"), ("big red", "Note"), ("big red x", "Note"))
    held = edges(spark, ("apollo", "supersedes", "zenith"), ("apollo", "depends_on", "zenith"), ("apollo", "mentions", "big red"), ("big red", "blocks", "big red x"))
    probes, gone = evalkit.multi_hop_probes(own, held)
    assert [(r["query"], r["gold_id"]) for r in probes.collect()] == [("apollo", "zenith")] and gone.first()["discarded"] == 1
    assert evalkit.simple_probes(own, 2).count() == 2


def test_multi_list(spark):
    lists = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "a"), (1, 1, 0, "b")], "query_id long, list int, pos long, id string")
    got = [(r["id"], round(r["score"], 6)) for r in retrieve.multi_list_rrf(lists).orderBy("rank").collect()]
    assert got == [("b", round(1 / 61 + 1 / 60, 6)), ("a", round(1 / 60 + 1 / 62, 6))]
