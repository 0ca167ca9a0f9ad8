"""Records of alignments and pairs of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions.residues import aligned
from seqlattice.sources.tables import table


def alignment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(seq_id, aln_id, seq_idx, a_name, raw, row): one row per record; raw as delivered, row in one spelling.

    A record that was delivered twice counts once. Rows that are null or empty are left out.
    """
    rows = table(spark, folder, "sequences").filter("seq_id is not null")
    once = rows.groupBy("seq_id").agg(F.max(F.struct("loaded_at", "aln_id", "seq_idx", "a_name", F.col("a_seq").alias("raw"))).alias("_last"))
    return once.select("seq_id", "_last.aln_id", "_last.seq_idx", "_last.a_name", "_last.raw", aligned(F.col("_last.raw")).alias("row")).filter("row <> ''")


#: Members of an alignment up to which its pairs are one key of the join.
_BLOCK = 256


def all_pairs(rows: DataFrame, *columns: str, limit: int | None = None, spread: bool = False) -> DataFrame:
    """(aln_id, i, j, and columns with _i and _j): all pairs i < j of an alignment, by an equi-join.

    The join is on aln_id and a block of each side, so that the pairs of a large alignment are spread over many tasks, with no
    more than about ``_BLOCK`` squared at one key; a row goes to as many keys as its alignment has blocks, which is one
    for most. ``limit`` keeps only sequences with a place below it. Rows without aln_id pair with none. With ``spread`` the
    pairs come in many partitions, for what takes long for each of them; the rows are spread, not the pairs.
    """
    if limit is not None:
        rows = rows.filter(F.col("seq_idx") < limit)
    blocks = rows.filter("aln_id is not null").groupBy("aln_id").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("_n"))
    rows = rows.join(blocks, "aln_id").withColumn("_own", F.pmod(F.xxhash64("seq_idx"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    one = rows.select("aln_id", F.col("_own").alias("_i"), every.alias("_j"), F.col("seq_idx").alias("i"), *(F.col(c).alias(f"{c}_i") for c in columns))
    two = rows.select("aln_id", every.alias("_i"), F.col("_own").alias("_j"), F.col("seq_idx").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    if spread:
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * rows.sparkSession.sparkContext.defaultParallelism)
        one, two = (x.repartition(n, "aln_id", "_i", "_j") for x in (one, two))
    return one.join(two, ["aln_id", "_i", "_j"]).filter("i < j").drop("_i", "_j")


def by_alignment(rows: DataFrame, order: list[str], of: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """What ``of`` makes of the rows of each alignment, which come to it in ``order``; many alignments are the work of one task.

    ``rows`` start with aln_id. For alignments of a bounded size only: one alignment lies in memory.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = batch.column(0)
            if not len(batch):
                continue
            new = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1
            if held and held[-1].column(0)[len(held[-1]) - 1] != names[0]:
                yield from done(held)
                held = []
            edges = [0, *new.tolist(), len(batch)]
            for k, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if k:
                    yield from done(held)
                    held = []
                held.append(batch.slice(start, end - start))
        yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = of(pa.Table.from_batches(held).combine_chunks()) if held else None
        if out is not None:
            yield from out.to_batches()

    return rows.filter("aln_id is not null").repartition(n, "aln_id").sortWithinPartitions("aln_id", *order).mapInArrow(stream, schema)
