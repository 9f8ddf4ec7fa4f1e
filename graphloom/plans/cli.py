"""python -m graphloom.plans.cli STREETS OUT [--levels N] [--approximate]: streets is a Parquet table or an edge file."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators.betweenness import sample_sources
from graphloom.plans.hierarchy import build_hierarchy
from graphloom.sources.edge_files import read_edges, write_results
from graphloom.sources.tables import replace


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("streets")
    parser.add_argument("out")
    parser.add_argument("--levels", type=int, default=10)
    parser.add_argument("--delimiter", default=",")
    parser.add_argument("--approximate", action="store_true", help="betweenness from a square root of all vertices")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = spark or SparkSession.builder.appName("hierarchy").getOrCreate()
    if given.streets.endswith((".csv", ".txt")):
        ways = read_edges(spark, given.streets, given.delimiter).withColumnRenamed("id", "gid")
    else:
        ways = spark.read.parquet(given.streets)
    sources = None
    if given.approximate:
        sources = sample_sources(ways.select(F.explode(F.array("source", "target")).alias("id")).distinct())
    built = build_hierarchy(ways, given.levels, sources=sources)
    replace(built.edges, f"{given.out}/edges")
    replace(built.vertices, f"{given.out}/vertices")
    write_results(built.edges, f"{given.out}/results_csv", given.levels)


if __name__ == "__main__":
    main()
