from kgspark.operators import extract, store
from kgspark.sources import markdown

EDGE = "src string, predicate string, dst string, note_path string, span string, confidence double, extractor string, seq long"


def notes(spark, *texts):
    return spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(texts)], "path string, walk_ord long, text string")


def edges_of(spark, text, **how):
    return {(r["predicate"], r["dst"]) for r in extract.extract(notes(spark, ("n.md", text)), **how)[1].collect()}


def test_frontmatter(spark):
    rows = extract.frontmatter_fields(notes(spark, ("a", "---\ntype: Project\ntags: [ai, 'ml', ]\n# x: y\nnocolon\nempty:\ntype: \"Tool\"\n---\nbody"), ("b", " ---\na: b\n---\n"), ("c", "---\na: b\n---"))).collect()
    assert {(r["path"], r["key"], r["text"], tuple(r["items"] or ())) for r in rows} == {("a", "type", "Tool", ()), ("a", "tags", None, ("ai", "ml")), ("a", "empty", None, ())}


def test_cues_and_headings(spark):
    text = "# Superseded things\nsee [[a]]\nThis was superseded by [[b]] and [[c|x]]\nblocked on [[d#part]]\n## Decisions\n[[e]]\n# [[lost]]\n[[f]]\n"
    assert edges_of(spark, text) == {("supersedes", "a"), ("supersedes", "b"), ("supersedes", "c"), ("blocks", "d"), ("decides", "e"), ("mentions", "f")}


def test_quoted_and_bare_links(spark):
    assert edges_of(spark, "---\nproject: [[x]]\n---\n") == {("is_part_of", "[x]")}
    assert edges_of(spark, '---\nproject: "[[x]]"\n---\n') == {("is_part_of", "x")}


def test_status_is_a_scalar_only(spark):
    assert edges_of(spark, "---\nstatus: [a, b]\n---\n") == set()
    assert edges_of(spark, "---\nstatus: LIVE\n---\n") == {("has_status", "LIVE")}


def test_resolution_and_types(spark):
    all_notes = notes(spark, ("v/project_bow.md", "---\ntags: [leo]\n---\n[[LEO]] [[ghost]]"), ("v/leo.md", "x"), ("w/leo.md", "y"))
    nodes, edges = extract.extract(all_notes)
    assert {(r["src"], r["predicate"], r["dst"]) for r in edges.collect()} == {("v/project_bow.md", "about", "v/leo.md"), ("v/project_bow.md", "mentions", "v/leo.md"), ("v/project_bow.md", "mentions", "ghost")}
    assert {(r["id"], r["type"]) for r in store.upsert_nodes(nodes).collect()} == {("v/project_bow.md", "Project"), ("v/leo.md", "Note"), ("w/leo.md", "Note"), ("ghost", "Note")}
    assert "leo" in {r["dst"] for r in extract.extract(all_notes, resolve_links=False)[1].collect()}


def test_llm_hook(spark):
    told = lambda path, text: [(path, "supports", "z"), (path, "no such predicate", "y")]
    nodes, edges = extract.extract(notes(spark, ("a.md", "")), llm=told)
    assert [(r["dst"], r["extractor"]) for r in edges.collect()] == [("z", "llm")]
    assert [r["id"] for r in nodes.collect()] == ["a.md"]


def edges(spark, *rows):
    return spark.createDataFrame([(s, p, o, n, None, c, "t", i) for i, (s, p, o, n, c) in enumerate(rows)], EDGE)


def test_null_provenance_never_collides(spark):
    kept = store.upsert_edges(edges(spark, ("a", "p", "b", None, 1.0), ("a", "p", "b", None, 1.0), ("a", "q", "b", "n", 1.0), ("a", "q", "b", "n", 0.5)))
    assert kept.count() == 3
    adj = {(r["src"], r["dst"]): r["w"] for r in store.adjacency(kept).collect()}
    assert adj == {("a", "b"): 2.5, ("b", "a"): 2.5}


def test_loops(spark):
    loop = edges(spark, ("a", "p", "a", None, 1.5))
    assert [r["w"] for r in store.adjacency(loop).collect()] == [3.0]
    assert store.neighbors(loop, spark.createDataFrame([("a",)], "id string")).count() == 2


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "kg"))
    node = lambda *rows: spark.createDataFrame([(*r, {}, i) for i, r in enumerate(rows)], store.NODES)
    s.write(node(("a", None, None, None)), edges(spark))
    s.write(node(("a", "Tool", "A", None), ("b", "Note", "b", "b")), edges(spark))
    again = store.Store(spark, str(tmp_path / "kg"))
    assert {(r["id"], r["type"], r["name"]) for r in again.nodes.collect()} == {("a", "Tool", "A"), ("b", "Note", "b")}
    assert again.node("none").count() == 0
    again.set_meta("k", "v")
    again.clear()
    assert again.nodes.count() == 0 and again.get_meta("k") == "v"


def test_walk(spark, tmp_path):
    for name in ("b.md", "a/z.md", ".git/no.md", "a/y.txt", "c.MD"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xff\xef\xbf\xbd\r\ny\xe2\x82" if name == "b.md" else b"t")
    rows = markdown.read_notes(spark, [str(tmp_path)]).orderBy("walk_ord").collect()
    assert [r["path"].removeprefix(str(tmp_path)) for r in rows] == ["/b.md", "/a/z.md"] and rows[0]["text"] == "x\ufffd\ny"


def test_sparql_json(spark):
    body = '{"head": {"vars": ["a", "b"]}, "results": {"bindings": [{"a": {"type": "uri", "value": "x"}}]}}'
    assert markdown.parse_sparql_json(spark.createDataFrame([(body,)], "body string")).first()["row"] == {"a": "x", "b": None}


def test_sessions(spark, tmp_path):
    lines = [
        '{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "too short"}}',
        '{"type": "user", "timestamp": "2026-01-01T00:00:01Z", "message": {"content": "where is the eviction policy described?"}}',
        "not json",
        '{"type": "assistant", "timestamp": "2026-01-01T00:00:02Z", "message": {"content": [{"type": "tool_use", "input": {"p": {"q": "open /v/a.md and /v/x.md.md now"}}}]}}',
        '{"type": "assistant", "timestamp": "2025-01-01T00:00:02Z", "message": {"content": [{"type": "tool_use", "input": {"p": "/v/b.md"}}]}}',
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(lines))
    corpus = spark.createDataFrame([("/v/a.md",), ("/v/b.md",), ("/v/x.md",)], "path string")
    rows = markdown.read_sessions(spark, str(tmp_path), corpus).collect()
    assert [(r["session_id"], r["query"], r["gold"]) for r in rows] == [("s1", "where is the eviction policy described?", ["/v/a.md", "/v/x.md"])]


def test_lines_and_items_without_bounds(spark):
    text = "---\ntags: [" + ", ".join(f"t{i}" for i in range(3000)) + "]\n---\n" + "\n" * 100 + "[[t2999]]"
    nodes, edges = extract.extract(notes(spark, ("n.md", text)))
    rows = edges.orderBy("seq").collect()
    assert [r["dst"] for r in rows] == [*(f"t{i}" for i in range(3000)), "t2999"] and [r["seq"] for r in rows] == list(range(3001))
