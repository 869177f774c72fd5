"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

A window starts at each line of a text and reaches over WINDOW lines, or as many as hold LONG words if these are fewer. The least
line hash of a window, the last of equals, is its fingerprint; a position that neighbouring windows select is one fingerprint.
Any run of WINDOW lines or LONG words that occurs twice holds the same window, so the same fingerprint, at both places. So only
around fingerprints that occur twice matches are extended: the windows over them, and those that end at each line, are compared
by all their lines (128 bits of hash), and the lines of each that stands at an earlier place, in (doc_id, line) order, are deleted.
Their union is all of each run of WINDOW lines or LONG words that came before, to both its ends, whichever lines happen to be
fingerprints. Lines are compared
without spaces, tabs and carriage returns at their ends; blank lines don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, id_and_text, may_match, shared_dir, written

WINDOW, LONG = 3, 50
_ENDS = " \t\r"


def _trimmed(x: Column) -> Column:
    return F.trim(x, F.lit(_ENDS))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: _trimmed(x) != "")


def _reach(i: Column, step: int, window: int, long: int) -> Column:
    """The number of lines of the window that starts (step 1) or ends (-1) at line i."""
    total, out = F.lit(0), None
    for k in range(1, window):
        total = total + F.get("words", i + step * (k - 1))
        out = F.when(total >= long, k) if out is None else out.when(total >= long, k)
    return F.lit(window) if out is None else out.otherwise(window)


def windows(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """A row for each window: doc_id, version (a hash of the text), start and lines (of the window), fingerprint (of the window
    that starts there), fresh (it starts there and the one before doesn't select the same position), key (two hashes of all its
    lines)."""
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("version"), F.transform(_lines(F.col("text")), _trimmed).alias("line"))
    rows = rows.select(
        "doc_id",
        "version",
        F.transform("line", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("line", lambda x: F.xxhash64(F.lit(1), x)).alias("g"),
        F.transform("line", lambda x: F.size(F.split(x, r"[ \t\r]+"))).alias("words"),
    )
    n = F.size("h")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    there = F.transform(at, lambda i: F.struct(i.alias("start"), _reach(i, 1, window, long).alias("lines")))
    back = F.transform(F.transform(at, lambda i: F.struct(i.alias("end"), _reach(i, -1, window, long).alias("lines"))), lambda x: F.struct((x["end"] - x["lines"] + 1).alias("start"), x["lines"].alias("lines")))
    rows = rows.withColumn("w", F.filter(there, lambda x: x["start"] + x["lines"] <= n))  # the window at line k is the k-th
    rows = rows.withColumn("back", F.filter(F.when(n > 0, back).otherwise(F.array()), lambda x: (x["start"] >= 0) & (F.get("w", x["start"])["lines"] != x["lines"])))
    own = lambda x: F.slice("h", x["start"] + 1, x["lines"])
    last = lambda x: x["start"] + x["lines"] - F.array_position(F.reverse(own(x)), F.array_min(own(x))).cast("int")
    rows = rows.withColumn("at", F.transform("w", last))
    with_print = lambda x, fresh: F.struct(x["start"].alias("start"), x["lines"].alias("lines"), fresh.alias("fresh"), F.get("h", F.get("at", x["start"])).alias("fingerprint"))
    every = F.concat(F.transform("w", lambda x, k: with_print(x, (k == 0) | (F.get("at", k) != F.get("at", k - 1)))), F.transform("back", lambda x: with_print(x, F.lit(False))))
    rows = rows.select("doc_id", "version", "h", "g", F.explode(every).alias("w"))
    key = [F.xxhash64(F.slice(a, F.col("w.start") + 1, F.col("w.lines"))) for a in ("h", "g")]
    return rows.select("doc_id", "version", "w.start", "w.lines", "w.fingerprint", "w.fresh", F.struct(key[0].alias("a"), key[1].alias("b"), "w.lines").alias("key"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """doc_id, version, start, lines of each window whose lines stand at an earlier place too."""
    every = written(windows(docs, window, long), "windows")
    shared = written(every.where("fresh").groupBy("fingerprint").agg(F.count("*").alias("held")).where("held > 1").select("fingerprint"), "shared")
    near = may_match(every, shared, ["fingerprint"]).where("__may").drop("__may")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "start")
    met = written(near.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("held")).where("held > 1"), "met")
    most = max(1, every.count() // HOT)  # fewer than HOT groups hold more: these are broadcast
    both = [near.join(F.broadcast(met.where(F.col("held") > most)), "key"), near.join(met.where(F.col("held") <= most), "key")]
    return both[0].unionByName(both[1]).where(place != F.col("first")).select("doc_id", "version", "start", "lines")


def line_dedup(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_text of each row of docs (doc_id, text).

    A text of which no line is removed stays as it is; of others the lines that stay are joined by line feeds, without blank
    lines. A null text counts as empty. Texts go by ascending doc_id, null last; rows that repeat a doc_id and a text are one
    text, so none of them is a later repeat of another. An empty table gives an empty result; other columns of docs are not read.
    """
    shared_dir(docs.sparkSession)
    gone = repeated_runs(docs, window, long).groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "lines")).alias("runs"))
    gone = written(gone.select("doc_id", "version", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1)))).alias("gone")), "gone")
    rows = may_match(id_and_text(docs).withColumn("version", F.xxhash64("text")), gone, ["doc_id", "version"])
    told = gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "gone")
    near = rows.where("__may").join(told, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version")), "left")
    line = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(line, i)), "\n"))
    n = F.size(line).cast("long").alias("n_lines")
    near = near.select("doc_id", n, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))
    return near.unionByName(rows.where(~F.col("__may")).select("doc_id", n, F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text")))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op8_line_dedup": r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') as line
  from documents),
t as (select doc_id, list_transform(line, lambda x: trim(x, ' ' || chr(9) || chr(13))) as line from d),
c as (select doc_id, line, list_transform(line, lambda x: len(regexp_extract_all(x, '[^ \t\r]+'))) as words from t),
e as (select doc_id, line, words, unnest(range(0, len(line))) as i from c),
r as (
  select doc_id, line, i, case when words[i + 1] >= 50 then 1 when words[i + 1] + words[i + 2] >= 50 then 2 else 3 end as n from e
  union
  select doc_id, line, i - n + 1, n from (
    select doc_id, line, i, case when words[i + 1] >= 50 then 1 when i > 0 and words[i] + words[i + 1] >= 50 then 2 else 3 end as n from e)),
w as (select doc_id, i, n, line[i + 1 : i + n] as own from r where i >= 0 and i + n <= len(line)),
f as (select doc_id, i, n, row_number() over (partition by own order by doc_id, i) as r from w),
g as (select distinct doc_id, unnest(range(i, i + n)) as p from f where r > 1),
x as (select doc_id, count(*) as n_removed, list(p) as gone from g group by doc_id)
select d.doc_id, len(line)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       case when gone is null then text
            else coalesce(array_to_string(list_transform(list_filter(range(0, len(line)), lambda p: not list_contains(gone, p)), lambda p: line[p + 1]), chr(10)), '') end as kept_text
from d left join x using (doc_id)
"""
}
