"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kgspark.llm import exact_dedup, jaccard_join, packing, toxicity
from kgspark.llm.common import remove_written, written, written_so_far

#: (name, function); each function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [("toxicity", toxicity.stage), ("exact_dedup", exact_dedup.stage), ("ngram_jaccard_join", jaccard_join.stage), ("best_fit_packing", packing.stage)]

#: Stages use a fitted classifier and a tokenizer, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written_so_far()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_written(spark, before, keep=1)  # what the stage needed, now that its rows are stored
    return STAGES[-1][1](spark, docs, sf_dir)


def run_query(spark, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
