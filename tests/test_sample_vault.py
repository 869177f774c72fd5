"""The golden walk-through: seven notes, their graph, the graph scores and the lexical score."""

import json

import pytest

from kgspark.operators import lexical
from kgspark.plans import harness
from kgspark.plans.service import EchoProvider, Service, query, reset, shared
from kgspark.vocab import REFUSAL

#: Seven notes; names, fields and links are those of the walk-through, whose graph scores depend on them alone.
NOTES = {
    "cache-eviction": ('project: "[[search-revamp]]"\ntags: [performance]', "# Eviction in the cache\n\nWhen load stays high the cache throws entries out too early, and p99 latency jumps.\nPart of [[search-revamp]].\n"),
    "incident-runbook": ("tags: [ops]", "# If something breaks\n\nWake whoever is on duty, say so in the channel, stop the damage, then look for the cause.\n"),
    "maya-chen": ("tags: [person]", "# Maya Chen\n\nLooks after everything between the index and the answer; been here five years.\n"),
    "onboarding": ("tags: [ops]", "# The first week\n\nGet a laptop, get your accounts, read the three documents at the top of the wiki.\n"),
    "search-revamp": ('author: "[[maya-chen]]"\ntags: [project]', "# A better search\n\nThis quarter's work on what people find. In the hands of [[maya-chen]].\nDepends on [[vector-index]].\n"),
    "travel-policy": ("tags: [ops]", "# Going places\n\nBook early; a per diem covers food; hand in receipts for reimbursement within a month.\n"),
    "vector-index": ('project: "[[search-revamp]]"\ntags: [performance]', "# Vectors\n\nA graph index over embeddings that proposes candidates.\n"),
}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("vault")
    for name, (fields, body) in NOTES.items():
        (folder / f"{name}.md").write_text(f"---\n{fields}\n---\n{body}")
    return Service(spark, [str(folder)], str(tmp_path_factory.mktemp("store") / "kg"))


def test_graph_and_scores(service):
    assert service.health() == {"nodes": 11, "edges": 12, "empty": False}
    seeds = service.seeds("p99 cache eviction latency owner")
    assert [s.rsplit("/", 1)[-1] for s in seeds] == ["cache-eviction.md"]
    scores = {r["id"].rsplit("/", 1)[-1][:-3]: round(r["score"], 6) for r in service.graph_scores(seeds).collect()}
    assert sorted(scores.values(), reverse=True) == [0.120435, 0.107982, 0.067981, 0.050109, 0.000016, 0.000016, 0.000016]
    assert scores["search-revamp"] in (0.120435, 0.107982) and scores["travel-policy"] == 0.000016


def test_query_fuses_and_falls_back(service):
    hits = service.query("p99 cache eviction latency owner", 5).collect()
    assert hits[0]["id"].endswith("cache-eviction.md") and "p99" in hits[0]["text"]
    assert any(h["id"].endswith("maya-chen.md") for h in hits)  # shares no word with the question
    lexical_only = service.query("reimbursement per diem receipts", 3).collect()
    assert lexical_only[0]["id"].endswith("travel-policy.md") and [h["rank"] for h in lexical_only] == [1, 2, 3]
    assert lexical_only[1]["score"] == 0.0


def test_answer_guards(service):
    refused = service.answer("zzz qqq", EchoProvider("x"))
    assert refused["answer"] == REFUSAL and refused["refused"] and refused["grounded"] is None
    good = service.answer("cache eviction", EchoProvider("Cache eviction belongs to search revamp."))
    assert good["grounded"] and not good["refused"] and good["support"] > 0.5
    assert not service.answer("cache eviction", EchoProvider("nothing known"))["grounded"]


def test_reuse_and_rebuild(spark, service, tmp_path):
    again = Service(spark, service.roots, service.store.path)
    assert again.store.get_meta("fingerprint") == service.store.get_meta("fingerprint")
    assert again.store._pointer("nodes") == service.store._pointer("nodes")  # nothing was written
    again.store.clear()
    assert Service(spark, service.roots, service.store.path).health()["empty"]  # as cached
    assert Service(spark, service.roots, service.store.path, rebuild=True).health()["edges"] == 12


def test_zero_scores_in_document_order(spark):
    docs = spark.createDataFrame([("a", "alpha beta", 0), ("b", "gamma", 1), ("c", None, 2)], "id string, text string, ord long")
    asked = spark.createDataFrame([(1, "gamma delta"), (2, "nothing")], "query_id long, text string")
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in lexical.top_k(docs, asked, 3).collect())
    assert got == [(1, 1, "b", 1.0), (1, 2, "a", 0.0), (1, 3, "c", 0.0), (2, 1, "a", 0.0), (2, 2, "b", 0.0), (2, 3, "c", 0.0)]


def test_shared_service(spark, service, tmp_path):
    reset()
    first = shared(spark, service.roots, service.store.path)
    assert shared(spark, ["/no such root"]) is first and query(spark, "cache eviction", 1).first()["id"].endswith("cache-eviction.md")
    reset()
    with pytest.raises(ValueError):
        shared(spark)


def test_three_arms(service, tmp_path):
    got = harness.three_arms(service, 5, path=str(tmp_path / "results.json"))
    assert got["vault"] == {"nodes": 11, "edges": 12, "notes": 7} and not got["probes"]["capped"] and got["probes"]["simple_lookup"] == 7
    assert got["arms"].keys() == {"flat", "graph", "reasoned"} and got["lift"].keys() == {"graph_vs_flat", "reasoned_vs_flat", "reasoned_vs_graph"}
    assert got["arms"]["graph"]["overall"]["n"] == got["probes"]["multi_hop"] + 7 and 0 < got["arms"]["graph"]["multi_hop"]["mrr"] <= 1
    text = (tmp_path / "results.json").read_text()
    assert json.loads(text) == got
    assert not any(x in text.lower() for x in ("/", ".md", "maya", "chen", "cache", "search-revamp", "vector", "latency"))  # no id, path or text
    capped = harness.three_arms(service, 5, max_multihop=1, max_simple=2)
    assert capped["probes"]["capped"] and capped["probes"]["simple_lookup"] == 2 and capped["probes"]["multi_hop"] == 1
    assert not harness.three_arms(service, 5, max_multihop=100, max_simple=7)["probes"]["capped"]


def test_sessions_ab(spark, service, tmp_path):
    root = service.roots[0]
    asked = {"cache-eviction": "why does p99 latency jump when the cache is full?", "travel-policy": "how does reimbursement work, are receipts needed?", "onboarding": "what should a laptop and accounts look like in the first week?"}
    assert harness.sessions_ab(service, str(tmp_path))[0] == 1
    for n, (name, text) in enumerate(asked.items()):
        lines = [{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": text}}, {"type": "assistant", "timestamp": "2026-01-01T00:00:01Z", "message": {"content": [{"type": "tool_use", "input": {"file": f"{root}/{name}.md"}}]}}]
        (tmp_path / f"s{n}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    code, got = harness.sessions_ab(service, str(tmp_path), depth=1, controls=False)
    assert code == 0 and got["sessions"] == 3 and got["arms"].keys() == {"flat", "note", "ensemble", "ensemble+ppr"}
    assert got["arms"]["flat"]["recall"] == got["arms"]["note"]["recall"] == got["arms"]["ensemble"]["recall"] == 1.0 and got["arms"]["note"]["p"] == 1.0
    figures, against = harness.run_controls(service, *(lambda a, g: (a["flat"], g))(*arms_and_gold(spark, service, asked)), depth=7)
    assert figures["real"] == figures["shuffled"] == figures["positive"] == 1.0 and len(against) == 1  # all notes: labels don't matter
    assert harness.sessions_ab(service, str(tmp_path), depth=7)[0] == 3


def arms_and_gold(spark, service, asked):
    rows = spark.createDataFrame([(n, t, f"{service.roots[0]}/{k}.md") for n, (k, t) in enumerate(asked.items())], "query_id long, text string, id string")
    return harness.session_arms(service, rows.select("query_id", "text"), 7), rows.select("query_id", "id")


def test_an_empty_graph_stops_the_comparison(spark, tmp_path):
    (tmp_path / "a.md").write_text("no links")
    assert harness.sessions_ab(Service(spark, [str(tmp_path)], str(tmp_path / "kg")), str(tmp_path))[0] == 2
