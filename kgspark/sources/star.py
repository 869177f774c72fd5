"""A knowledge graph and notes made from the star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STEP = 100_000_000_000_000_000

NODES = f"""
select 'region/' || r_regionkey as id, 'Concept' as type, r_name as name, cast(null as varchar(99)) as note_path, {_STEP} * 0 + r_regionkey as seq from region
union all select 'nation/' || n_nationkey, 'Concept', n_name, cast(null as varchar(99)), {_STEP} * 1 + n_nationkey from nation
union all select 'customer/' || c_custkey, 'Person', c_name, cast(null as varchar(99)), {_STEP} * 2 + c_custkey from customer
union all select 'supplier/' || s_suppkey, 'Source', s_name, cast(null as varchar(99)), {_STEP} * 3 + s_suppkey from supplier
union all select 'part/' || p_partkey, 'Tool', p_name, 'part/' || p_partkey, {_STEP} * 4 + p_partkey from part
union all select 'order/' || o_orderkey, 'Event', 'order ' || o_orderkey, 'order/' || o_orderkey, {_STEP} * 5 + o_orderkey from orders
"""

CORE = f"""
select 'nation/' || n_nationkey as src, 'broader' as predicate, 'region/' || n_regionkey as dst, cast(null as varchar(99)) as note_path, cast(1.0 as double) as confidence, {_STEP} * 1 + n_nationkey as seq from nation
union all select 'customer/' || c_custkey, 'is_part_of', 'nation/' || c_nationkey, cast(null as varchar(99)), cast(1.0 as double), {_STEP} * 2 + c_custkey from customer
union all select 'supplier/' || s_suppkey, 'is_part_of', 'nation/' || s_nationkey, cast(null as varchar(99)), cast(1.0 as double), {_STEP} * 3 + s_suppkey from supplier
"""

EDGES = f"""{CORE}
union all select 'order/' || o_orderkey, 'authored_by', 'customer/' || o_custkey, 'order/' || o_orderkey, cast(1.0 as double), {_STEP} * 4 + o_orderkey from orders
union all select 'order/' || o_orderkey, 'has_status', 'status/' || o_orderstatus, 'order/' || o_orderkey, cast(1.0 as double), {_STEP} * 5 + o_orderkey from orders
union all select 'order/' || o_orderkey, 'supersedes', 'order/' || back, 'order/' || o_orderkey, cast(1.0 as double), {_STEP} * 6 + o_orderkey
  from (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as back from orders) x where back is not null
union all select 'order/' || l_orderkey, 'mentions', 'part/' || l_partkey, 'order/' || l_orderkey, max(1 - l_discount), {_STEP} * 7 + l_orderkey * 10000000 + l_partkey from lineitem group by l_orderkey, l_partkey
union all select 'part/' || l_partkey, 'derived_from', 'supplier/' || min(l_suppkey), 'part/' || l_partkey, cast(1.0 as double), {_STEP} * 8 + l_partkey from lineitem group by l_partkey
"""

NOTES = """
select '/notes/' || case doc_id % 4 when 0 then 'project_' when 1 then 'user_' else 'doc_' end || doc_id || '.md' as path, cast(doc_id as bigint) as walk_ord, cast(doc_id as bigint) as mtime, cast(n_chars as bigint) as size,
  '---' || chr(10) || case when doc_id % 3 = 0 then 'type: decision' || chr(10) else '' end || 'tags: [' || lang || ', ' || source || ']' || chr(10)
  || 'status: "s' || doc_id % 5 || '"' || chr(10) || '# not: a field' || chr(10) || '---' || chr(10) || '# Doc ' || doc_id || chr(10)
  || 'This depends on [[doc_' || doc_id % 7 || ']] and [[user_' || doc_id % 11 || '#part|that]].' || chr(10) || '## Decisions' || chr(10) || 'See [[nowhere ' || doc_id % 3 || ']].' || chr(10) || coalesce(text, '') as text
from documents
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(EDGES).selectExpr("*", "cast(null as string) as span", "'table' as extractor")


def core_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(CORE).selectExpr("*", "cast(null as string) as span", "'table' as extractor")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(NOTES)
