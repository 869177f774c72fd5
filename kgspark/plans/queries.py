"""Queries of the engine's operators over the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evalkit, extract, graph, guards, lexical, rdf, reason, retrieve, sparql, store
from ..sources import markdown, sinks, star
from ..vocab import NAMESPACE, RDF, SCHEMA, SUPERCLASS, XSD

N, E, C, M = star.NODES, star.EDGES, star.CORE, star.NOTES
WITH = f"with nodes as ({N}), edges as ({E})"
ADJ = "adj as (select src, dst, sum(w) as w from (select src, dst, confidence as w from edges union all select dst, src, confidence from edges) x group by src, dst)"
CLEAN = "translate(regexp_replace(regexp_replace(lower({0}), '\\.[^.]*$', ''), '^(project_|reference_|feedback_|user_)', ''), '_-', '  ')"
STOP = "('" + "','".join(tx.STOPWORDS) + "')"
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: t not in " + STOP + ")"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- store ---


@query(f"{WITH}, {ADJ} select src, dst, round(w, 6) as w from adj")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return store.adjacency(star.edges(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"{WITH} select c.id, e.src, e.predicate, e.dst from (select 'customer/' || c_custkey as id from customer) c join edges e on e.src = c.id union all select c.id, e.src, e.predicate, e.dst from (select 'customer/' || c_custkey as id from customer) c join edges e on e.dst = c.id")
def neighbors(spark, d):
    ids = star.nodes(spark, d).where("type = 'Person'").select("id")
    return store.neighbors(star.edges(spark, d), ids).select("id", "src", "predicate", "dst")


@query("select 'user/' || user_id as id, arg_max(event_type, event_id) as type, 'user/' || user_id as name, max(event_id) as seq from events group by user_id")
def upsert_nodes_lww(spark, d):
    star.views(spark, d)
    writes = spark.sql("select 'user/' || user_id as id, event_type as type, cast(null as string) as name, event_id as seq from events")
    return store.upsert_nodes(writes).select("id", "type", "name", "seq")


_EDGE_WRITES = "select 'user/' || user_id as src, event_type as predicate, 'hour/' || event_id % 24 as dst, case when event_id % 3 > 0 then 'note/' || event_id % 5 end as note_path, value as confidence, event_id as seq from events"


@query(f"with w as ({_EDGE_WRITES}), r as (select *, row_number() over (partition by src, predicate, dst, coalesce(note_path, 'null' || seq) order by seq desc) as n from w) select src, predicate, dst, note_path, confidence, seq, 'unknown' as extractor from r where n = 1")
def upsert_edges_null_key(spark, d):
    star.views(spark, d)
    writes = spark.sql(_EDGE_WRITES).withColumn("extractor", F.lit(None).cast("string"))
    return store.upsert_edges(writes).select("src", "predicate", "dst", "note_path", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "seq", "extractor")


@query(f"{WITH} select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from edges) = 0 as empty")
def graph_health(spark, d):
    return store.counts(star.nodes(spark, d), star.edges(spark, d))


# --- notes ---


@query(f"""with n as ({M}), d as (select doc_id, lang, source, path from documents join n on walk_ord = doc_id)
select path, 'tags' as key, cast(null as varchar) as text, lang || '|' || source as items from d
union all select path, 'status', 's' || doc_id % 5, null from d union all select path, 'type', 'decision', null from d where doc_id % 3 = 0""")
def frontmatter_fields(spark, d):
    return extract.frontmatter_fields(star.notes(spark, d)).select("path", "key", "text", F.array_join("items", "|").alias("items"))


@query(f"with n as ({M}) select path, case when walk_ord % 3 = 0 then 'Decision' when walk_ord % 4 = 0 then 'Project' when walk_ord % 4 = 1 then 'Person' else 'Note' end as type from n")
def node_typing(spark, d):
    notes = star.notes(spark, d)
    return extract.typed_notes(notes, extract.frontmatter_fields(notes))


@query(f"""with n as ({M}) select path, 'doc_' || walk_ord % 7 as target, 'depends_on' as predicate from n union all select path, 'user_' || walk_ord % 11, 'depends_on' from n
union all select path, 'nowhere ' || walk_ord % 3, 'decides' from n""")
def wikilink_edges(spark, d):
    return extract.body_links(star.notes(spark, d)).select("path", "target", "predicate")


_CUES = "select '/n/' || o_orderkey || '.md' as path, cast(o_orderkey as bigint) as walk_ord, case o_orderkey % 6 when 0 then 'Superseded by' when 1 then 'blocked on' when 2 then 'depends upon' when 3 then 'a part of' when 4 then 'decided in' else 'see' end || ' [[c' || o_custkey || '#x|y]]' as text from orders"


@query("select '/n/' || o_orderkey || '.md' as path, 'c' || o_custkey as target, case o_orderkey % 6 when 0 then 'supersedes' when 1 then 'blocks' when 2 then 'depends_on' when 3 then 'is_part_of' when 4 then 'decides' else 'mentions' end as predicate from orders")
def inline_cue_edges(spark, d):
    star.views(spark, d)
    return extract.body_links(spark.sql(_CUES)).select("path", "target", "predicate")


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents),
c as (select doc_id, w, unnest(range(0, greatest(cast(ceil(len(w) / 120) as bigint), 1))) as n from w) select 'd' || doc_id || '#' || n as id, coalesce(array_to_string(w[n * 120 + 1 : n * 120 + 120], ' '), '') as text from c""")
def note_chunks(spark, d):
    star.views(spark, d)
    return lexical.chunks(spark.sql("select 'd' || doc_id as path, doc_id as walk_ord, text from documents")).select("id", "text")


@query(f"with n as ({M}) select path, 'Doc ' || walk_ord as heading, 1 as linked from n union all select path, 'Decisions', 1 from n")
def heading_context(spark, d):
    rows = extract.body_lines(star.notes(spark, d)).where(F.size(tx.wikilinks(F.col("line"))) > 0)
    return rows.select("path", "heading", F.lit(1).alias("linked"))


_BARE = "with n as ({0}), k as (select regexp_replace(replace(path, '/notes/', ''), '\\.md$', '') as key, path from n), raw as (select path as src, 'about' as predicate, lang as dst from n join documents on doc_id = walk_ord union all select path, 'about', source from n join documents on doc_id = walk_ord union all select path, 'has_status', 's' || walk_ord % 5 from n union all select path, 'depends_on', 'doc_' || walk_ord % 7 from n union all select path, 'depends_on', 'user_' || walk_ord % 11 from n union all select path, 'decides', 'nowhere ' || walk_ord % 3 from n)".format(M)


@query(f"{_BARE} select src, predicate, coalesce(k.path, dst) as dst from raw left join k on k.key = raw.dst")
def link_resolution(spark, d):
    _, edges = extract.extract(star.notes(spark, d))
    return edges.select("src", "predicate", "dst")


@query(f"{_BARE}, t as (select path as id, case when walk_ord % 3 = 0 then 'Decision' when walk_ord % 4 = 0 then 'Project' when walk_ord % 4 = 1 then 'Person' else 'Note' end as type from n) select id, type from t union all select distinct dst, case when predicate in ('about', 'has_status') then 'Concept' else 'Note' end from raw left join k on k.key = raw.dst where k.path is null")
def extracted_nodes(spark, d):
    nodes, _ = extract.extract(star.notes(spark, d))
    return store.upsert_nodes(nodes).select("id", "type")


@query(f"with n as ({M}) select sha256(string_agg(path || ':' || mtime || ':' || size || ';', '' order by path)) as fingerprint from n")
def corpus_fingerprint(spark, d):
    return markdown.corpus_fingerprint(star.notes(spark, d))


# --- graph analytics ---


@query(f"{WITH}, {ADJ} select src as id, round(1 / (1 + ln(1 + count(distinct dst))), 9) as specificity from adj group by src")
def node_specificity(spark, d):
    return graph.node_specificity(store.adjacency(star.edges(spark, d))).select("id", F.round("specificity", 9).alias("specificity"))


def _ppr(tele: str, r: str = "round(r, 9)") -> str:
    return f"""with recursive edges as ({E}), {ADJ}, o as (select src, sum(w) as t from adj group by src),
e as (select adj.src, dst, w / t as share from adj join o on o.src = adj.src), v as (select src as id, count(*) over () as n from o),
tele as ({tele}), r as (
  select q.query_id, v.id, 0 as it, 1.0::double / n as r from (select distinct query_id from tele) q, v
  union all
  select r.query_id, e.dst, it + 1, sum(0.85::double * r.r * e.share) + 0.15::double * coalesce(max(tele.t), 0) from r join e on e.src = r.id
  left join tele on tele.query_id = r.query_id and tele.id = e.dst where it < 50 group by r.query_id, e.dst, it)
select query_id, id, {r} as r from r where it = 50"""


def _statuses(spark: SparkSession) -> DataFrame:
    """The ends of edges that are no nodes."""
    return spark.sql("select distinct 'status/' || o_orderstatus as id from orders")


_NATIONS = "select 'q' || n_nationkey as query_id, 'nation/' || n_nationkey as id, 1.0::double as t from nation"
_UNIFORM = "select 'q' as query_id, id, 1.0::double / n as t from v"


def _ppr_nations(spark, d):
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    seeds = spark.sql("select 'q' || n_nationkey as query_id, 'nation/' || n_nationkey as id from nation")
    return graph.personalized_pagerank(store.weighted(edges), seeds, names=nodes.select("id").unionByName(_statuses(spark)), both=True).select("query_id", "id", F.round("r", 9).alias("r"))


def _ppr_no_seed(spark, d):
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    seeds = spark.createDataFrame([("q", "no such node")], "query_id string, id string")
    return graph.personalized_pagerank(store.weighted(edges), seeds, names=nodes.select("id").unionByName(_statuses(spark)), both=True).select("query_id", "id", F.round("r", 9).alias("r"))


@query(_ppr(_NATIONS))
def ppr_50(spark, d):
    return _ppr_nations(spark, d)


@query(_ppr(_UNIFORM))
def ppr_no_seed_uniform(spark, d):
    return _ppr_no_seed(spark, d)


@query("with o as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, o_custkey as c from orders) select 'order/' || a.o_orderkey as src, 'order/' || b.o_orderkey as dst from o a join o b on a.c = b.c and a.n > b.n")
def supersedes_closure(spark, d):
    return graph.transitive_closure(star.edges(spark, d).where("predicate = 'supersedes'"))


_BROADER = f"select src, dst from ({C}) x where predicate = 'broader' union all select 'region/' || r_regionkey, 'world' from region"


@query(f"with b as ({_BROADER}) select a.src as start, a.dst as id from b a union select a.src, b.dst from b a join b on b.src = a.dst")
def broader_rollup(spark, d):
    star.views(spark, d)
    edges = spark.sql(_BROADER)
    return graph.reachable(edges, edges.select(F.col("src").alias("start")))


# --- retrieval ---

_ASKED = "select 'q' || n_nationkey as query_id, n_name || ' and ' || r_name as text from nation join region on r_regionkey = n_regionkey"


@query(f"""{WITH}, q as ({_ASKED}), l as (select distinct id, unnest({TOKENS.format(CLEAN.format("name"))}) as t from nodes), a as (select distinct query_id, unnest({TOKENS.format("text")}) as t from q),
s as (select query_id, id, count(*) as overlap from a join l using (t) group by query_id, id), r as (select *, row_number() over (partition by query_id order by overlap desc, id desc) as n from s)
select query_id, id, overlap from r where n <= 8""")
def entity_link(spark, d):
    nodes = star.nodes(spark, d)
    return retrieve.link_entities(spark.sql(_ASKED), nodes)


_TFIDF = f"""c as (select id, t, count(*) as tf from (select id, unnest({TOKENS.format("text")}) as t from docs) x group by id, t),
f as (select t, ln((1 + (select count(*) from docs)) / (1 + count(*))) + 1 as idf from c group by t), v as (select id, t, tf * idf as w from c join f using (t)), n as (select id, sqrt(sum(w * w)) as norm from v group by id),
a as (select query_id, t, count(*) * any_value(idf) as q from (select query_id, unnest({TOKENS.format("text")}) as t from asked) x join f using (t) group by query_id, t), m as (select query_id, sqrt(sum(q * q)) as len from a group by query_id),
s as (select query_id, id, sum(q * w) / any_value(norm * len) as score from a join v using (t) join n using (id) join m using (query_id) group by query_id, id),
every as (select query_id, docs.id, docs.ord, coalesce(score, 0) as score from asked cross join docs left join s using (query_id, id)),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, ord) as rank from every)"""


@query(f"with docs as (select doc_id as id, doc_id as ord, coalesce(text, '') as text from documents), asked as (select item_id as query_id, text from benchmark), {_TFIDF} select query_id, rank::int as rank, id, round(score, 6) as score from ranked where rank <= 5")
def tfidf_topk(spark, d):
    star.views(spark, d)
    docs = spark.sql("select doc_id as id, doc_id as ord, coalesce(text, '') as text from documents")
    asked = spark.sql("select item_id as query_id, text from benchmark")
    return lexical.top_k(docs, asked, 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


_BY_PRICE = "select o_custkey as query_id, 'order/' || o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders where o_orderstatus <> 'P'"
_BY_DATE = "select o_custkey as query_id, 'order/' || o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank from orders"


@query(f"""with a as ({_BY_PRICE}), b as ({_BY_DATE}), f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.id, b.id) as id, coalesce(1.0::double / (59 + a.rank), 0) + coalesce(1.0::double / (59 + b.rank), 0) as score from a full join b on a.query_id = b.query_id and a.id = b.id),
r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from f) select query_id, rank::int as rank, id, round(score, 9) as score from r where rank <= 5""")
def rrf_fusion(spark, d):
    star.views(spark, d)
    return retrieve.fuse(spark.sql(_BY_PRICE), spark.sql(_BY_DATE), 5).select("query_id", "rank", "id", F.round("score", 9).alias("score"))


_LISTS = f"select query_id, 0 as list, cast(rank - 1 as bigint) as pos, id from ({_BY_PRICE}) x union all select query_id, 1, cast(rank - 1 as bigint), id from ({_BY_DATE}) y union all select o_custkey, 2, cast(0 as bigint), 'order/' || max(o_orderkey) from orders group by o_custkey"


@query(f"with l as ({_LISTS}), s as (select query_id, id, sum(1.0::double / (60 + pos)) as score, min(list * 1000000 + pos) as first from l group by query_id, id) select query_id, row_number() over (partition by query_id order by round(score, 12) desc, first)::int as rank, id, round(score, 9) as score from s")
def multi_list_rrf(spark, d):
    star.views(spark, d)
    return retrieve.multi_list_rrf(spark.sql(_LISTS)).select("query_id", "rank", "id", F.round("score", 9).alias("score"))


_PARTS = "select l_suppkey as query_id, cast(l_orderkey as bigint) * 100 + l_linenumber as pos, l_partkey as id from lineitem"


@query(f"with f as (select query_id, id, min(pos) as pos from ({_PARTS}) x group by query_id, id), r as (select *, row_number() over (partition by query_id order by pos, id) as rank from f) select query_id, pos, rank::int as rank from r where rank <= 3")
def ordered_distinct(spark, d):
    star.views(spark, d)
    return retrieve.ordered_distinct(spark.sql(_PARTS), 3).select("query_id", "pos", "rank")


_LINKED = f"""select query_id, id, 1.0::double / count(*) over (partition by query_id) as t from (
select * from (select query_id, id, row_number() over (partition by query_id order by count(*) desc, id desc) as n from (select distinct query_id, unnest({TOKENS.format("text")}) as t from ({{0}}) q) a
join (select distinct id, unnest({TOKENS.format(CLEAN.format("name"))}) as t from ({N}) nn) l using (t) group by query_id, id) x where n <= 8) y"""
_QUESTIONS = "select * from (values ('q1', 'FRANCE and EUROPE'), ('q2', 'polished brass part'), ('q3', 'zzzz qqqq')) v(query_id, text)"


@query(f"""with ranks as ({_ppr(_LINKED.format(_QUESTIONS), "r")}), nodes as ({N}), edges as ({E}), {ADJ}, sp as (select src as id, 1 / (1 + ln(1 + count(distinct dst))) as sp from adj group by src),
gs as (select query_id, id, r * coalesce(sp, 1) as score, seq from ranks join nodes using (id) left join sp using (id) where note_path is not null),
g as (select query_id, id, row_number() over (partition by query_id order by score desc, seq) as gr from gs where score > 0),
docs as (select 'part/' || p_partkey as id, p_name || ' ' || p_brand || ' ' || p_type as text, p_partkey as ord from part), asked as ({_QUESTIONS}), {_TFIDF},
x as (select query_id, id, rank as lr, score from ranked where rank <= 10), seeded as (select distinct query_id from ranks),
fused as (select coalesce(g.query_id, x.query_id) as query_id, coalesce(g.id, x.id) as id, coalesce(1.0::double / (59 + gr), 0) + coalesce(1.0::double / (59 + lr), 0) as score from g full join (select * from x where query_id in (select query_id from seeded)) x on g.query_id = x.query_id and g.id = x.id),
best as (select query_id, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank, id, score from fused)
select query_id, rank::int as rank, id, round(score, 6) as score from best where rank <= 10 union all select query_id, lr::int, id, round(score, 6) from x where query_id not in (select query_id from seeded)""")
def hybrid_retrieve(spark, d):
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    docs = spark.sql("select 'part/' || p_partkey as id, p_name || ' ' || p_brand || ' ' || p_type as text, p_partkey as ord from part")
    asked = spark.sql(_QUESTIONS.replace("v(", "as v("))
    return retrieve.retrieve(asked, docs, nodes, store.weighted(edges), 10, both=True, others=_statuses(spark)).select("query_id", "rank", "id", "score")


# --- guards ---

_SAID = "select 'a' || s_suppkey as query_id, s_name || ' ' || n_name as text from supplier join nation on n_nationkey = s_nationkey"


@query(f"""{WITH}, q as ({_SAID}), l as (select distinct id, unnest({TOKENS.format(CLEAN.format("name"))}) as t from nodes), a as (select distinct query_id, unnest({TOKENS.format("text")}) as t from q),
s as (select query_id, id, count(*) as overlap from a join l using (t) group by query_id, id), r as (select *, row_number() over (partition by query_id order by overlap desc, id desc) as n from s),
g as (select 'a' || s_suppkey as query_id, 'supplier/' || s_suppkey as id from supplier union select 'a' || s_suppkey, 'nation/' || s_nationkey from supplier),
p as (select query_id, avg(case when g.id is null then 0.0 else 1.0 end) as share from r left join g using (query_id, id) where n <= 50 group by query_id)
select q.query_id, coalesce(share >= 0.5, false) as grounded, round(coalesce(share, 0)::double, 4) as support from q left join p using (query_id)""")
def groundedness(spark, d):
    nodes = star.nodes(spark, d)
    had = spark.sql("select 'a' || s_suppkey as query_id, 'supplier/' || s_suppkey as id from supplier union select 'a' || s_suppkey, 'nation/' || s_nationkey from supplier")
    return guards.groundedness(spark.sql(_SAID), had, nodes)


_TURNS = "select conv_id as query_id, text from conversations where role = 'user' and turn = 0"


@query(f"""{WITH}, q as ({_TURNS}), l as (select distinct unnest({TOKENS.format(CLEAN.format("name"))}) as t from nodes), a as (select distinct query_id, unnest({TOKENS.format("coalesce(text, '')")}) as t from q)
select query_id from q where query_id not in (select query_id from a join l using (t))""")
def structural_refuse(spark, d):
    nodes = star.nodes(spark, d)
    asked = spark.sql(_TURNS)
    return guards.should_refuse(asked, retrieve.link_entities(asked, nodes)).select("query_id")


@query("select distinct 'order/' || o_orderkey as src, 'has_status' as predicate, 'status/F' as dst, 'status/' || o_orderstatus as held from orders where o_orderstatus <> 'F'")
def contradictions(spark, d):
    claims = star.nodes(spark, d).where("type = 'Event'").select(F.col("id").alias("src"), F.lit("has_status").alias("predicate"), F.lit("status/F").alias("dst"))
    return guards.contradictions(claims, star.edges(spark, d))


# --- RDF, shapes, paths ---


def _iri(x: str) -> str:
    return f"'{NAMESPACE}n/' || url_encode({x})"


@query(f"{WITH} select id, {_iri('id')} as iri, id as back from nodes")
def node_iri(spark, d):
    nodes = star.nodes(spark, d).select("id", tx.node_iri(F.col("id")).alias("iri"))
    return nodes.select("id", "iri", tx.iri_to_id(F.col("iri")).alias("back"))


_S = f"'{NAMESPACE}stmt/' || n"


def _triples(nodes: str, edges: str, more: str = "") -> str:
    return f"""nodes as ({nodes}), edges as ({edges}), e as (select *, row_number() over (order by seq) - 1 as n, {_iri("src")} as s, '{NAMESPACE}' || predicate as p, {_iri("dst")} as o from edges),
triples as (select {_iri("id")} as s, '{RDF}type' as p, '{NAMESPACE}' || type as o, 'iri' as o_kind, cast(null as varchar) as o_datatype from nodes
union select {_iri("id")}, '{SCHEMA}name', name, 'literal', null from nodes union select s, p, o, 'iri', null from e union select {_S}, '{RDF}type', '{RDF}Statement', 'iri', null from e
union select {_S}, '{RDF}subject', s, 'iri', null from e union select {_S}, '{RDF}predicate', p, 'iri', null from e union select {_S}, '{RDF}object', o, 'iri', null from e
union select {_S}, '{NAMESPACE}confidence', confidence::varchar, 'literal', '{XSD}decimal' from e{more})"""


_TRIPLES = _triples(N, E, f" union select {_S}, '{NAMESPACE}provenance', note_path, 'literal', null from e where note_path <> ''")


def _exported(spark, d):
    return rdf.export(star.nodes(spark, d), star.edges(spark, d))


@query(f"with {_TRIPLES} select * from triples")
def rdf_triples(spark, d):
    return _exported(spark, d)


_LINES = "select '<' || s || '> <' || p || '> ' || case when o_kind = 'iri' then '<' || o || '>' else '\"' || replace(o, '\"', '\\\"') || '\"' || coalesce('^^<' || o_datatype || '>', '') end || ' .' as line from triples"


@query(f"with {_TRIPLES} {_LINES}")
def turtle_lines(spark, d):
    return sinks.turtle_lines(_exported(spark, d))


def _faulty(spark, d):
    """Triples of orders with a status from each of their lines; every tenth without a type, every seventh without a name."""
    star.views(spark, d)
    iri = tx.node_iri(F.concat(F.lit("order/"), F.col("k").cast("string")))
    orders = spark.sql("select o_orderkey as k from orders")
    status = spark.sql("select distinct l_orderkey as k, l_linestatus as v from lineitem")
    null = F.lit(None).cast("string")
    row = lambda df, p, o, kind: df.select(iri.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), null.alias("o_datatype"))
    return row(orders.where("k % 10 > 0"), RDF + "type", F.lit(NAMESPACE + "Event"), "iri").unionByName(row(orders.where("k % 7 > 0"), SCHEMA + "name", F.concat(F.lit("order "), F.col("k").cast("string")), "literal")).unionByName(row(status, NAMESPACE + "has_status", tx.node_iri(F.concat(F.lit("status/"), "v")), "iri"))


_ORDER = _iri("'order/' || k")


def _violations(spark, d, path, kind):
    return rdf.violations(_faulty(spark, d)).where((F.col("path") == path) & (F.col("kind") == kind))


@query(f"select {_ORDER} as focus, '{RDF}type' as path, 'minCount' as kind from (select distinct o_orderkey as k from orders) x where k % 10 = 0 and k % 7 > 0")
def shacl_missing_type(spark, d):
    return _violations(spark, d, RDF + "type", "minCount")


@query(f"select {_ORDER} as focus, '{SCHEMA}name' as path, 'minCount' as kind from (select distinct o_orderkey as k from orders) x where k % 10 > 0 and k % 7 = 0")
def shacl_missing_name(spark, d):
    return _violations(spark, d, SCHEMA + "name", "minCount")


@query(f"select {_ORDER} as focus, '{NAMESPACE}has_status' as path, 'maxCount' as kind from (select l_orderkey as k from lineitem where l_orderkey in (select o_orderkey from orders) group by l_orderkey having count(distinct l_linestatus) > 1) x where k % 7 > 0")
def shacl_functional(spark, d):
    return _violations(spark, d, NAMESPACE + "has_status", "maxCount")


@query(f"{WITH} select name from nodes where type = 'Concept'")
def nodes_of_type(spark, d):
    return sparql.nodes_of_type(star.nodes(spark, d), "Concept")


_BGP = f"select c.s as c, n.s as n, l.o as name from triples c join triples n on c.o = n.s join triples l on l.s = n.s where c.p = '{NAMESPACE}is_part_of' and n.p = '{NAMESPACE}broader' and n.o = '{NAMESPACE}n/region%2F1' and l.p = '{SCHEMA}name'"


@query(f"with {_TRIPLES} {_BGP}")
def bgp_join(spark, d):
    q = sparql.parse(f"SELECT ?c ?n ?name WHERE {{ ?c kl:is_part_of ?n . ?n kl:broader <{NAMESPACE}n/region%2F1> ; schema:name ?name }}")
    return sparql.run(_exported(spark, d), q)


@query(f"with {_TRIPLES} {_BGP} and (l.o > 'B' and c.s like '%customer%')")
def sparql_filter(spark, d):
    q = sparql.parse(f"SELECT ?c ?n ?name WHERE {{ ?c kl:is_part_of ?n . ?n kl:broader <{NAMESPACE}n/region%2F1> ; schema:name ?name FILTER (?name > \"B\" && contains(str(?c), \"customer\")) }}")
    return sparql.run(_exported(spark, d), q)


@query("select count(*) > 0 as answer from nation where n_nationkey = 3 and n_regionkey = 1")
def ask_entailed(spark, d):
    q = sparql.parse(f"ASK {{ <{NAMESPACE}n/nation%2F3> kl:broader+ <{NAMESPACE}n/region%2F1> }}")
    return sparql.run(_exported(spark, d), q)


# --- reasoning ---

_OVER = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in SUPERCLASS.items()) + " end"


@query(f"{WITH} select id, type from nodes union select id, {_OVER} from nodes")
def subclass_entail(spark, d):
    types, _ = reason.entail(star.nodes(spark, d), star.edges(spark, d))
    return types


@query(f"select distinct 'order/' || o_custkey as id, unnest(['Person', '{SUPERCLASS['Person']}']) as type from orders")
def range_entail(spark, d):
    star.views(spark, d)
    edges = spark.sql("select 'x' as src, 'authored_by' as predicate, 'order/' || o_custkey as dst from orders")
    types, _ = reason.entail(star.nodes(spark, d).select("id", "type").where("false"), edges)
    return types


@query("select 'order/' || o_orderkey as id, min('order/' || o_orderkey) over (partition by o_custkey) as component from orders qualify count(*) over (partition by o_custkey) > 1")
def same_as_components(spark, d):
    star.views(spark, d)
    return reason.same_as(spark.sql("select 'customer/' || o_custkey as src, 'supersedes' as predicate, 'order/' || o_orderkey as dst from orders"))


_CHAIN = "select 'order/' || o_orderkey as src, 'supersedes' as predicate, 'order/' || back as dst, cast(0.5 as double) as confidence from (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as back from orders) x where back is not null"


@query(f"""with edges as ({_CHAIN}), {ADJ}, o as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, o_custkey as c from orders),
p as (select 'order/' || a.o_orderkey as src, 'order/' || b.o_orderkey as dst from o a join o b on a.c = b.c and a.n <> b.n) select src, dst, coalesce(w, 1.0) as w from p left join adj using (src, dst)""")
def reasoned_adjacency(spark, d):
    nodes = star.nodes(spark, d)
    edges = spark.sql(_CHAIN)
    return reason.reasoned_adjacency(nodes.select("id", "type"), edges, store.adjacency(edges))


@query(f"with n as (select * from ({N}) x where type = 'Concept'), e as (select * from ({C}) x where predicate = 'broader') select a.id as src, b.id as dst, 1.0 + case when exists (select 1 from e where (e.src = a.id and e.dst = b.id) or (e.src = b.id and e.dst = a.id)) then 1.0 else 0.0 end as w from n a join n b on a.id <> b.id")
def type_cohort(spark, d):
    nodes = star.nodes(spark, d).where("type = 'Concept'").select("id", "type")
    edges = star.core_edges(spark, d).where("predicate = 'broader'")
    return reason.reasoned_adjacency(nodes, edges, store.adjacency(edges), type_cohort=True)


# --- evaluation ---


@query("with o as (select o_orderkey as k, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as back from orders) select 'multi_hop' as family, 'order ' || k as query, 'order/' || back as gold_id from o where back is not null")
def multi_hop_probes(spark, d):
    edges = star.edges(spark, d).where("predicate = 'supersedes'")
    return evalkit.multi_hop_probes(star.nodes(spark, d), edges)[0].drop("seq")


@query(f"{WITH} select 'simple_lookup' as family, {CLEAN.format('name')} as query, id as gold_id from nodes where note_path is not null")
def simple_probes(spark, d):
    return evalkit.simple_probes(star.nodes(spark, d))


_PROBED = "select o_orderkey as query_id, case when o_orderkey % 2 = 0 then 'multi_hop' else 'simple_lookup' end as family, o_orderkey % 200 as gold_id from orders"
_HITS = "select l_orderkey as query_id, l_partkey as id, l_linenumber as rank from lineitem"


@query(f"with p as ({_PROBED}), h as (select query_id, id, min(rank) as rank from ({_HITS}) x group by query_id, id) select p.query_id, family, gold_id, rank from p left join h on h.query_id = p.query_id and h.id = gold_id")
def gold_ranks(spark, d):
    star.views(spark, d)
    return evalkit.gold_ranks(spark.sql(_PROBED), spark.sql(_HITS))


_RANKS = "select o_orderkey as query_id, case when o_orderkey % 2 = 0 then 'multi_hop' else 'simple_lookup' end as family, case when o_orderkey % 13 {0} 0 then o_orderkey % {1} + 1 end as rank from orders"


def _scores(ranks: str) -> str:
    one = lambda g, w: f"select '{g}' as \"group\", count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 4) as hit_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 4) as hit_5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 4) as hit_10, round(avg(coalesce(1.0 / rank, 0.0)), 4) as mrr from r {w}"
    return f"with r as ({ranks}) " + " union all ".join([one("overall", ""), one("multi_hop", "where family = 'multi_hop'"), one("simple_lookup", "where family = 'simple_lookup'")])


@query(_scores(_RANKS.format(">", 12)))
def hit_mrr(spark, d):
    star.views(spark, d)
    return evalkit.evaluate(spark.sql(_RANKS.format(">", 12)))


@query(f"select a.\"group\", round(a.hit_1 - b.hit_1, 4) as hit_1, round(a.hit_5 - b.hit_5, 4) as hit_5, round(a.hit_10 - b.hit_10, 4) as hit_10, round(a.mrr - b.mrr, 4) as mrr from ({_scores(_RANKS.format('>', 7))}) a join ({_scores(_RANKS.format('>', 12))}) b on a.\"group\" = b.\"group\"")
def lift(spark, d):
    star.views(spark, d)
    return evalkit.lift(evalkit.evaluate(spark.sql(_RANKS.format(">", 7))), evalkit.evaluate(spark.sql(_RANKS.format(">", 12))))


_GOLD = "select distinct l_orderkey as query_id, l_partkey as id from lineitem"
_GOT = "select l_orderkey as query_id, l_partkey as id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as rank from lineitem"


@query(f"with g as ({_GOLD}), h as (select distinct query_id, id from ({_GOT}) x where rank <= 3) select query_id, round(avg(case when h.id is null then 0.0 else 1.0 end), 6) as recall from g left join h using (query_id, id) group by query_id")
def recall_at_k(spark, d):
    star.views(spark, d)
    return evalkit.recall_at(spark.sql(_GOT), spark.sql(_GOLD), 3).select("query_id", F.round("recall", 6).alias("recall"))


@query("select count(*) filter (c_acctbal > 0) as better, count(*) filter (c_acctbal < 0) as worse from customer")
def sign_test(spark, d):
    star.views(spark, d)
    base = spark.sql("select c_custkey as query_id, 0.0 as recall from customer")
    arm = spark.sql("select c_custkey as query_id, c_acctbal as recall from customer")
    better, worse, _ = evalkit.sign_test(base, arm)
    return spark.createDataFrame([(better, worse)], "better long, worse long")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_retrieve(spark, d)
