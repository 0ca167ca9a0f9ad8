"""The jobs of the command line: files in, files out, any number of alignments as one Spark job."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.functions import residues as R
from seqlattice.operators import align, distance, estimate, msa
from seqlattice.operators.pairs import all_pairs
from seqlattice.operators.scoring import AlignConfig, Scoring, collected
from seqlattice.sources import fasta, matrix
from seqlattice.workspace import stored


_log = logging.getLogger("seqlattice")


@contextmanager
def _phase(name: str) -> Iterator[None]:
    """Tells, in the log, how many seconds a phase of a job took."""
    began = time.monotonic()
    yield
    _log.info("%s: %.1f s", name, time.monotonic() - began)


def sequences_of(spark: SparkSession, paths: list[str], form: str = "fasta") -> DataFrame:
    """(aln_id, seq_idx, name, raw, row, seq) of sequence files; the file is the alignment, seq_idx counts from 0.

    Sequences with a sign that the alphabet lacks are an error, which names the first of them.
    """
    rows = fasta.read(spark, *paths, form=form)
    if form == "colon":  # numbered by lines
        rows = rows.withColumn("record_no", F.row_number().over(Window.partitionBy("path").orderBy("record_no")))
    rows = rows.select(F.col("path").alias("aln_id"), (F.col("record_no") - 1).alias("seq_idx"), "name", F.col("seq").alias("raw"))
    wrong = rows.withColumn("symbols", R.illegal_symbols(F.col("raw"))).filter("symbols <> ''").orderBy("aln_id", "seq_idx").first()
    if wrong:
        raise ValueError(f"{wrong.aln_id}: sequence {wrong.seq_idx + 1} has the symbol {wrong.symbols[0]!r}")
    return rows.select("*", R.aligned(F.col("raw")).alias("row"), R.residues(F.col("raw")).alias("seq"))


def scoring_of(spark: SparkSession, scores: str, transitions: str | None, config: AlignConfig, average: bool = False) -> Scoring:
    """Scores of a matrix file (``CID`` is the built-in identity) and transition quantities of a table file, if one is named.

    With ``average``, B, Z and X score as the means of what they stand for.
    """
    table = matrix.identity(spark) if scores == "CID" else matrix.read_matrix(spark, scores)
    table = matrix.average_ambiguous(table) if average else table
    return collected(table, matrix.parse_transitions(matrix.lines_of(spark, transitions)) if transitions else None, config)


def align_files(spark: SparkSession, paths: list[str], out: str, scoring: Scoring, coding: tuple[int, ...] | None = None, form: str = "fasta") -> None:
    """Aligns the sequences of every file; with ``coding`` they are DNA that is aligned as protein.

    ``coding`` is one genetic code for all sequences, or one for each sequence of a file, by its place.
    """
    with _phase("sequences"):
        rows = stored(sequences_of(spark, paths, form), "sequences")
        if coding is not None:
            if len(coding) > 1:
                wrong = rows.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != len(coding)).orderBy("aln_id").first()
                if wrong:
                    raise ValueError(f"{wrong.aln_id} has {wrong.n} sequences for {len(coding)} genetic codes")
            number = F.get(F.array(*map(F.lit, coding)), F.col("seq_idx") if len(coding) > 1 else F.lit(0))
            rows = stored(rows.withColumn("dna", F.col("seq")).withColumn("seq", R.translated(F.col("dna"), number)), "coding")
    with _phase("profiles, trees and merging"):
        done = stored(msa.multiple_alignment(rows, all_pairs(rows, "seq"), scoring, spread=False), "aligned")
    joined = done.join(rows.drop("row", "seq"), ["aln_id", "seq_idx"])
    seq = F.col("row") if coding is None else R.back_mapped(F.col("row"), F.col("dna"))
    place = F.col("place") if scoring.config.keep_order else F.col("seq_idx")
    with _phase("writing"):
        fasta.write(joined.select("aln_id", place.alias("seq_idx"), "name", seq.alias("seq")), out)


def count_files(spark: SparkSession, paths: list[str], out: str, frequency: DataFrame | None = None, modes: str = "01", form: str = "fasta") -> None:
    """Matrix and transition table of reference alignments, written as ``out``/matrix and ``out``/transitions.

    modes: 1 skips columns of two gaps, 2 drops transitions with a gap, 3 takes q = 1 - p over the largest p of a start, 5
    scales q by the largest of all, 4 leaves out lower case, f keeps both directions of a transition apart, n takes all
    pairs, with or without an equal residue.
    """
    rows = sequences_of(spark, paths, form)
    if "4" in modes:
        rows = rows.withColumn("row", R.aligned(R.without_lower_case(F.col("raw"))))
    pairs = all_pairs(rows.withColumnRenamed("name", "a_name"), "row", "a_name")
    weighted = estimate.pair_weights(pairs, frequency)
    only_similar, skip = "n" not in modes, "1" in modes
    odds = stored(estimate.log_odds(estimate.pair_counts(weighted, skip, only_similar)), "odds")
    scale = estimate.relative_entropy_scale(odds).first()["scale"]
    scores = estimate.with_ambiguous(odds, estimate.residue_shares(rows)).withColumn("score", F.col("score") * scale)
    matrix.square_text(scores).orderBy("no").coalesce(1).select(F.col("line").alias("value")).write.mode("overwrite").text(f"{out}/matrix")
    counts = stored(estimate.transition_counts(weighted, skip, only_similar), "transitions")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if "2" in modes:
        counts = estimate.without_gaps(counts)
    sym = counts.select("a1", "b1", "a2", "b2", "w") if "f" in modes else estimate.symmetric_transitions(counts)
    quantity = estimate.transition_quantity(estimate.transition_probabilities(sym), "direct" if "3" in modes else "global" if "5" in modes else "local")
    codes = ("a1", "b1", "a2", "b2")
    grid = spark.range(24**4).select(*(F.expr(f"cast(id div {24 ** (3 - k)} % 24 as int)").alias(c) for k, c in enumerate(codes)))
    full = grid.join(quantity, list(codes), "left").select(*codes, F.coalesce("q", F.lit(1.0)).alias("q"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("w", F.lit(0.0)).alias("n"))
    matrix.transitions_text(full, total).sort("no").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{out}/transitions")


def library_files(spark: SparkSession, paths: list[str], out: str, scoring: Scoring, measure: str = "gid", limit: int | None = None, form: str = "fasta") -> None:
    """A pair library for each file, weighted by one of the distances of aligned pairs."""
    rows = sequences_of(spark, paths, form)
    rows = rows if limit is None else rows.filter(F.col("seq_idx") < limit)
    pairs = all_pairs(rows, "seq")
    found = stored(align.path_alignments(pairs, scoring), "paths")
    aligned = align.gapped_rows(found.join(pairs, ["aln_id", "i", "j"]))
    weights = distance.pair_statistics(aligned).select("aln_id", "i", "j", F.col(measure).alias("distance"))
    align.write_library(align.library_lines(rows.select("aln_id", "seq_idx", "name", "seq"), found, weights), out)


def search_files(spark: SparkSession, queries: list[str], database: list[str], out: str, scoring: Scoring, every: bool = False, limit: int | None = None) -> None:
    """Hits of query sequences in database sequences as CSV: names, distance, aligned rows.

    With ``every``, all queries are compared with all records, else those with seeds in common, which misses many related ones.
    Without ``queries``, all records of the database are compared with all, each with itself too. ``limit`` keeps so many of the
    nearest hits of each query.
    """

    def kept(hits: DataFrame, query: str, subject: str) -> DataFrame:
        if limit is None:
            return hits
        near = Window.partitionBy(query).orderBy("eer2", subject)
        return hits.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= limit).drop("_n")

    def keyed(paths: list[str]) -> DataFrame:
        rows = sequences_of(spark, paths).filter("seq <> ''")
        return stored(rows.select(F.xxhash64("aln_id", "seq_idx").alias("id"), "name", "seq"), "records")

    two = keyed(database)
    one = keyed(queries) if queries else two
    if every or not queries:
        hits = kept(align.compared(align.every_pair(one, two, not queries), scoring), "query", "subject")
        hits.select(F.col("name_q").alias("query_name"), F.col("name_s").alias("subject_name"), "eer2", "row_i", "row_j").write.mode("overwrite").csv(out, header=True)
        return
    found = align.seeded_pairs(one, two)
    pairs = found.join(one.select(F.col("id").alias("query"), F.col("name").alias("query_name"), F.col("seq").alias("seq_i")), "query")
    pairs = pairs.join(two.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"), F.col("seq").alias("seq_j")), "subject")
    pairs = stored(pairs.withColumns({"aln_id": F.concat_ws(" ", "query", "subject"), "i": F.lit(0), "j": F.lit(1)}), "candidates")
    rows = stored(align.gapped_rows(align.path_alignments(pairs, scoring).join(pairs, ["aln_id", "i", "j"])), "aligned")
    scored = kept(rows.join(distance.pair_statistics(rows).select("aln_id", "eer2"), "aln_id"), "query", "subject")
    scored.select("query_name", "subject_name", "eer2", "row_i", "row_j").write.mode("overwrite").csv(out, header=True)
