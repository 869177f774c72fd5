"""Builds the graph of the notes under some folders: python -m kgspark.plans.build_cli PATH ROOT..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .service import Service


def main(argv: list[str] | None = None) -> int:
    path, *roots = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("kgspark").getOrCreate()
    print(Service(spark, roots, path, rebuild=True).health())
    return 0


if __name__ == "__main__":
    sys.exit(main())
