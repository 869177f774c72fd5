"""Markdown notes, session transcripts and SPARQL result documents as DataFrames."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, decode
from ..session import numbered
from ..vocab import SKIPPED_FOLDERS

#: The end of a note's file name, as a pattern.
NOTE = r"\.md"


def read_notes(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, walk_ord, mtime, size, text of the ``.md`` files under the roots, or of a root that is a file.

    Roots go in the order given, in a folder its files first and then its folders, both by name; skipped folders count only
    below a root. Text is UTF-8 without what isn't valid.
    """
    parts = []
    for n, root in enumerate(roots):
        at = root.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(at)
        path = F.regexp_replace("path", "^file:/+", "/")
        inside = F.substring(path, F.length(F.lit(at)) + 2, F.lit(1 << 30))
        skipped = F.exists(F.slice(F.split(inside, "/"), F.lit(1), F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0))), lambda p: p.isin(SKIPPED_FOLDERS))
        # in a folder files come before folders: folder names get a later first character
        order = F.regexp_replace(F.concat(F.lit("\x01"), F.regexp_replace(inside, "/", "/\x01")), "\x01([^/]*/)", "\x02$1")
        parts.append(files.where(~skipped).select(path.alias("path"), F.lit(n).alias("root"), order.alias("order"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), decode(F.col("content")).alias("text")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # only paths are ordered; texts aren't moved for it
    order = numbered(every.select("root", "order", "path"), ["root", "order"], "walk_ord").drop("order")
    return every.join(order, ["root", "path"]).select("path", "walk_ord", "mtime", "size", "text")


def corpus_fingerprint(notes: DataFrame) -> DataFrame:
    """One row: the SHA-256 over ``path:mtime:size;`` of all notes in the order of their paths, as ``fingerprint``.

    The lines are sorted by Spark and run through the hash one partition after another, so the driver holds one partition's lines;
    a hash of a sequence can't be made in parts. Texts are not read.
    """
    line = F.concat_ws(":", "path", F.col("mtime").cast("long").cast("string"), F.col("size").cast("string"))
    whole = hashlib.sha256()
    for row in notes.select("path", line.alias("line")).orderBy("path").select("line").toLocalIterator():
        whole.update(f"{row['line']};".encode())
    return notes.sparkSession.createDataFrame([(whole.hexdigest(),)], "fingerprint string")


def all_strings(x: Column) -> Column:
    """All string values in a JSON text, however deep, as an array; keys are left out."""
    bare = F.regexp_replace(x, r'"(?:[^"\\]|\\.)*"\s*:', "")
    quoted = F.regexp_extract_all(bare, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.transform(quoted, lambda s: F.get_json_object(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "$.v"))


def epoch(x: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time, null if it isn't one."""
    return F.unix_micros(F.try_to_timestamp(x)).cast("double") / 1e6


def read_sessions(spark: SparkSession, folder: str, corpus: DataFrame, most: int | None = None, least: int = 25, longest: int = 600) -> DataFrame:
    """session_id, query, gold of the ``*.jsonl`` transcripts in a folder, by file name; lines that aren't JSON are left out.

    The query is the first user text of ``least`` characters or more that neither begins with ``<`` nor holds a tool result, cut
    to ``longest``; gold are the corpus paths (column path, each ending in .md) that stand in tool inputs at or after it. Sessions without gold are
    left out.
    """
    shape = "type string, timestamp string, message struct<content: string>"
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(folder, wholetext=False)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", shape).alias("j"), "value").where("j is not null")
    at = raw.select("file", "value", F.col("j.type").alias("type"), epoch(F.col("j.timestamp")).alias("at"), F.get_json_object("value", "$.message.content").alias("content"))
    blocks = F.from_json("content", "array<struct<type: string, text: string, input: string>>")
    at = at.withColumn("blocks", F.when(F.ltrim("content").startswith("["), blocks))
    said = F.when(F.col("blocks").isNotNull(), F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), " ")).otherwise(F.col("content"))
    tool = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    asked = at.withColumn("said", F.trim(said)).where((F.col("type") == "user") & ~tool & (F.length("said") >= least) & ~F.col("said").startswith("<") & F.col("at").isNotNull())
    asked = asked.groupBy("file").agg(F.min(F.struct("at", F.col("said"))).alias("q")).select("file", F.col("q.at").alias("query_at"), F.substring(F.col("q.said"), 1, longest).alias("query"))
    inputs = at.select("file", "at", F.explode(F.filter("blocks", lambda b: b["input"].isNotNull())).alias("b")).select("file", "at", F.explode(all_strings(F.concat(F.lit("["), F.col("b.input"), F.lit("]")))).alias("s"))
    later = inputs.join(asked, "file").where(F.col("at") >= F.col("query_at"))
    # a path that stands in a string does so up to its end; what lies between the last slash and that end is its file name
    heads = lambda part: F.transform(F.slice(F.split(part, NOTE, -1), F.lit(1), F.size(F.split(part, NOTE, -1)) - 1), lambda x, i: F.concat(F.array_join(F.slice(F.split(part, NOTE, -1), F.lit(1), i + 1), ".md"), F.lit(".md")))
    later = later.select("file", "s", F.explode(F.array_distinct(F.flatten(F.transform(F.split("s", "/"), heads)))).alias("name"))
    paths = corpus.select(F.col("path").alias("p"), basename(F.col("path")).alias("name"))
    gold = later.join(paths, "name").where(F.col("s").contains(F.col("p"))).groupBy("file").agg(F.sort_array(F.collect_set("p")).alias("gold"))
    out = asked.join(gold, "file").select(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "").alias("session_id"), "query", "gold").orderBy("session_id")
    return out.limit(most) if most else out


def parse_sparql_json(df: DataFrame, column: str = "body") -> DataFrame:
    """A map of variable to value (null: not bound) for each binding of SPARQL result documents, as ``row``."""
    shape = "struct<head: struct<vars: array<string>>, results: struct<bindings: array<map<string, struct<type: string, value: string>>>>>"
    each = df.select(F.from_json(column, shape).alias("j")).select(F.col("j.head.vars").alias("vars"), F.explode("j.results.bindings").alias("b"))
    return each.select(F.map_from_arrays("vars", F.transform("vars", lambda v: F.try_element_at("b", v)["value"])).alias("row"))
