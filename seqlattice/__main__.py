"""python -m seqlattice MODE: aligns, counts, makes pair libraries and searches, over files that Spark can read."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqlattice.functions.alphabet import GENETIC_CODES
from seqlattice.operators.scoring import AlignConfig
from seqlattice.plans import jobs
from seqlattice.sources import fasta


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqlattice", description=__doc__)
    modes = parser.add_subparsers(dest="job", required=True)
    for name in ("align", "count", "library", "search"):
        mode = modes.add_parser(name)
        mode.add_argument("--input", nargs="*", default=[], help="FASTA files or patterns")
        mode.add_argument("--file-list", help="a file with one input a line, up to the first blank line")
        mode.add_argument("--output", required=True)
        mode.add_argument("--format", default="fasta", choices=sorted(fasta.FORMS))
        if name == "count":
            mode.add_argument("--modes", default="01")
            mode.add_argument("--frequency", help="CSV of name, count")
            continue
        mode.add_argument("--matrix", default="CID", help="matrix file, or CID")
        mode.add_argument("--transitions", help="transition table")
        mode.add_argument("--average-ambiguous", action="store_true", help="score B, Z and X as means of what they stand for")
        for field in dataclasses.fields(AlignConfig):
            if field.type in ("float", "int"):
                mode.add_argument(f"--{field.name.replace('_', '-')}", type=float if field.type == "float" else int, default=field.default)
        if name == "align":
            mode.add_argument("--coding", type=int, nargs="+", choices=range(len(GENETIC_CODES)), help="the input is coding DNA, by one genetic code, or by one for each sequence")
            mode.add_argument("--keep-order", action="store_true")
        if name == "library":
            mode.add_argument("--distance", default="gid", choices=["gid", "lid", "pdist", "eer", "eer2", "ecd", "ecdr"])
            mode.add_argument("--limit", type=int)
        if name == "search":
            mode.add_argument("--database", nargs="+", required=True)
            mode.add_argument("--limit", type=int, help="so many of the nearest hits of each query")
            mode.add_argument("--every", action="store_true", help="compare all queries with all records, not those with common seeds alone")
    o = parser.parse_args(args)
    logging.basicConfig(format="%(message)s")
    logging.getLogger("seqlattice").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("seqlattice").getOrCreate()
    paths = o.input or ([r.in_path for r in fasta.file_list(spark, o.file_list).collect()] if o.file_list else [])
    if o.job == "count":
        frequency = None
        if o.frequency:
            frequency = spark.read.csv(o.frequency, schema="a_name string, f double").groupBy("a_name").agg(F.max("f").alias("f"))
        jobs.count_files(spark, paths, o.output, frequency, o.modes, o.format)
        return
    options = {f.name: getattr(o, f.name) for f in dataclasses.fields(AlignConfig) if hasattr(o, f.name)}
    scoring = jobs.scoring_of(spark, o.matrix, o.transitions, AlignConfig(**options), o.average_ambiguous)
    if o.job == "align":
        jobs.align_files(spark, paths, o.output, scoring, tuple(o.coding) if o.coding else None, o.format)
    elif o.job == "library":
        jobs.library_files(spark, paths, o.output, scoring, o.distance, o.limit, o.format)
    else:
        jobs.search_files(spark, paths, o.database, o.output, scoring, o.every, o.limit)


if __name__ == "__main__":
    main()
