"""Notes to a typed graph, as column expressions over lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename_key, delink, first_cue, lines, node_type, strip, wikilinks
from ..session import numbered
from ..vocab import HEADING_CUES, LINE_CUES, PREDICATES

# Fixed value: the pattern of the fences of frontmatter.
FENCE = r"(?s)^---\n(.*?)\n---\n"
#: Where links of the frontmatter go: key, predicate, type of a target that isn't a note, and whether its link is taken off.
FIELDS = [("tags", "about", "Concept", False), ("project", "is_part_of", "Project", True), ("people", "mentions", "Person", True), ("author", "authored_by", "Person", True), ("authors", "authored_by", "Person", True)]


def split_frontmatter(notes: DataFrame) -> DataFrame:
    """notes with fm (the text between fences at the very start, null if there is none) and body."""
    block = F.regexp_substr("text", F.lit(FENCE))
    return notes.withColumn("fm", F.when(block.isNotNull(), F.regexp_extract("text", FENCE, 1))).withColumn("body", F.when(block.isNull(), F.col("text")).otherwise(F.substring(F.col("text"), F.length(block) + 1, F.length("text"))))


def frontmatter_fields(notes: DataFrame) -> DataFrame:
    """path, key, text (of a scalar), items (of a list) of each key in a note's frontmatter; both are null where it is empty.

    Lines without a colon or that begin with # are left out, the last of equal keys counts, ``[a, b]`` is a list.
    """
    each = split_frontmatter(notes).select("path", F.posexplode(lines(F.coalesce("fm", F.lit("")))).alias("pos", "line"))
    each = each.where(F.col("line").contains(":") & ~strip(F.col("line")).startswith("#"))
    each = each.select("path", "pos", strip(F.regexp_extract("line", r"(?s)^([^:]*):(.*)$", 1)).alias("key"), strip(F.regexp_extract("line", r"(?s)^([^:]*):(.*)$", 2)).alias("value")).where("key <> ''")
    last = each.groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))
    is_list = F.col("value").startswith("[") & F.col("value").endswith("]")
    bare = lambda x: F.regexp_replace(x, r"""^["']+|["']+$""", "")
    inner = F.substring(F.col("value"), F.lit(2), F.length("value") - 2)
    items = F.filter(F.transform(F.split(inner, ","), lambda x: bare(strip(x))), lambda x: x != "")
    return last.select("path", "key", F.when(~is_list & (F.col("value") != ""), bare(F.col("value"))).alias("text"), F.when(is_list, items).alias("items"))


def typed_notes(notes: DataFrame, fields: DataFrame) -> DataFrame:
    """path, type of each note: the declared one, else by the file name."""
    declared = fields.where("key = 'type'").select("path", F.col("text").alias("declared"))
    return notes.join(declared, "path", "left").select("path", node_type(F.col("path"), F.col("declared")).alias("type"))


def body_lines(notes: DataFrame) -> DataFrame:
    """path, pos, line, heading of each line of a note's body that is no heading; heading: the last one before it."""
    each = split_frontmatter(notes).select("path", F.posexplode(lines(F.col("body"))).alias("pos", "line"))
    title = F.when(F.col("line").rlike(r"^#{1,6}\s+"), strip(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    each = each.withColumn("title", title)
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("heading", F.last("title", ignorenulls=True).over(upto)).where("title is null").drop("title")


def body_links(notes: DataFrame) -> DataFrame:
    """path, pos, n, target, predicate of each link in a body; the line's cue tells the predicate, else the heading's."""
    by_heading = first_cue(F.coalesce("heading", F.lit("")), HEADING_CUES, F.lit("mentions"))
    each = body_lines(notes).where(F.col("line").contains("[["))
    return each.select("path", "pos", first_cue(F.col("line"), LINE_CUES, by_heading).alias("predicate"), F.posexplode(wikilinks(F.col("line"))).alias("n", "target"))


def _emitted(notes: DataFrame) -> DataFrame:
    """path, k, pos, n, predicate, target, type: what a note emits, in the order (k, pos, n)."""
    fields = frontmatter_fields(notes)
    values = fields.select("path", "key", F.coalesce("items", F.when(F.col("text").isNotNull(), F.array("text")), F.array().cast("array<string>")).alias("v"), F.col("items").isNotNull().alias("listed"))
    each = values.select("path", "key", "listed", F.posexplode("v").alias("n", "target"))
    zero = F.lit(0).alias("pos")
    parts = []
    for k, (key, predicate, kind, linked) in enumerate(FIELDS):
        target = delink(F.col("target")) if linked else strip(F.col("target"))
        parts.append(each.where(F.col("key") == key).select("path", F.lit(k).alias("k"), zero, "n", F.lit(predicate).alias("predicate"), target.alias("target"), F.lit(kind).alias("type")))
    status = each.where("key = 'status' and not listed")
    parts.append(status.select("path", F.lit(len(FIELDS)).alias("k"), zero, "n", F.lit("has_status").alias("predicate"), strip(F.col("target")).alias("target"), F.lit("Concept").alias("type")))
    parts.append(body_links(notes).select("path", F.lit(len(FIELDS) + 1).alias("k"), "pos", "n", "predicate", "target", F.lit("Note").alias("type")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("target <> ''")


def extract(notes: DataFrame, resolve_links: bool = True, llm: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(node writes, edge writes) of all notes (path, walk_ord, text), in write order by seq, for the store's upserts.

    A target whose name is that of a note's file (without folder and extension, in any case) becomes that note, the first in walk
    order of equals. Within a note a node's first type counts. ``llm``: (path, text) to (subject, predicate, object) rows, run
    in Python on the executors; edges with a predicate outside the vocabulary are left out, and they make no nodes.
    """
    order = notes.select("path", "walk_ord")
    each = _emitted(notes).join(order, "path")
    place = F.struct(F.col("walk_ord"), F.col("k"), F.col("pos"), F.col("n"))
    own = notes.join(typed_notes(notes, frontmatter_fields(notes)), "path")
    own = own.select(F.col("path").alias("id"), "type", F.col("path").alias("name"), F.col("path").alias("note_path"), F.struct("walk_ord", F.lit(-1).alias("k"), F.lit(0).alias("pos"), F.lit(0).alias("n")).alias("place"))
    found = each.where("target <> path").groupBy("path", F.col("target").alias("id")).agg(F.min_by("type", place).alias("type"), F.min(place).alias("place"))
    found = found.select("id", "type", F.col("id").alias("name"), F.lit(None).cast("string").alias("note_path"), "place")
    edges = each.select(F.col("path").alias("src"), "predicate", F.col("target").alias("dst"), F.col("path").alias("note_path"), place.alias("place"), F.lit("wikilink").alias("extractor"))
    if llm is not None:
        edges = edges.unionByName(_llm_edges(notes, llm))
    if resolve_links:
        keys = notes.groupBy(basename_key(F.col("path")).alias("key")).agg(F.min_by("path", "walk_ord").alias("to"))
        real = notes.select(F.col("path").alias("real"))

        def resolved(df: DataFrame, column: str) -> DataFrame:
            at = df.withColumn("key", basename_key(F.col(column))).join(keys, "key", "left").join(real, F.col(column) == F.col("real"), "left")
            return at.withColumn(column, F.coalesce("real", "to", column)).drop("key", "to", "real")

        bare = found.withColumn("key", basename_key(F.col("id"))).join(keys, "key", "left_anti").drop("key")
        found, edges = bare, resolved(resolved(edges, "src"), "dst")
    nodes = own.unionByName(found)
    return _numbered(nodes.withColumn("attrs", F.create_map().cast("map<string,string>")), "id"), _numbered(edges.withColumn("span", F.lit(None).cast("string")).withColumn("confidence", F.lit(1.0)), "dst")


def _numbered(df: DataFrame, tie: str) -> DataFrame:
    """place (note, kind of field, line, item) as one number that keeps its order."""
    return numbered(df, ["place", tie], "seq").drop("place")


def _llm_edges(notes: DataFrame, llm: Callable) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(path, at, n, *t) for path, at, text in pdf.itertuples(index=False) for n, t in enumerate(llm(path, text))]
            yield pd.DataFrame(rows, columns=["path", "walk_ord", "n", "src", "predicate", "dst"])

    told = notes.select("path", "walk_ord", "text").mapInPandas(run, "path string, walk_ord long, n int, src string, predicate string, dst string")
    place = F.struct("walk_ord", F.lit(len(FIELDS) + 2).alias("k"), F.lit(0).alias("pos"), "n")
    return told.where(F.col("predicate").isin(PREDICATES)).select("src", "predicate", "dst", F.col("path").alias("note_path"), place.alias("place"), F.lit("llm").alias("extractor"))
