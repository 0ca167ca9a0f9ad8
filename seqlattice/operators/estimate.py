"""Substitution scores and transition quantities, estimated from reference alignments by counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.functions.alphabet import ALPHABET, GAP, PURE, code, encoded

_CELLS = 25**4


def _columns(i: list[bytes], j: list[bytes], weights: np.ndarray, skip_gap_pairs: bool, only_similar: bool) -> tuple[np.ndarray, ...]:
    a, b = [encoded(x) for x in i], [encoded(x) for x in j]
    n = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    flat_a = np.concatenate([x[:k] for x, k in zip(a, n, strict=True)]).astype(np.int64)
    flat_b = np.concatenate([y[:k] for y, k in zip(b, n, strict=True)]).astype(np.int64)
    pair = np.repeat(np.arange(len(n)), n)
    kept = np.ones(len(pair), bool)
    if only_similar:
        equal = np.bincount(pair, (flat_a == flat_b) & (flat_a < GAP), minlength=len(n))
        kept &= (equal > 0)[pair]
    if skip_gap_pairs:
        kept &= (flat_a != GAP) | (flat_b != GAP)
    return flat_a[kept], flat_b[kept], pair[kept], weights[pair[kept]]


def pair_weights(pairs: DataFrame, frequency: DataFrame | None) -> DataFrame:
    """``pairs`` with w: 1/sqrt(f f') where ``frequency`` (a_name, f) knows both names, else 1."""
    if frequency is None:
        return pairs.withColumn("w", F.lit(1.0))
    known = frequency.filter("a_name is not null")
    one = known.select(F.col("a_name").alias("a_name_i"), F.col("f").alias("f_i"))
    two = known.select(F.col("a_name").alias("a_name_j"), F.col("f").alias("f_j"))
    joined = pairs.join(one, "a_name_i", "left").join(two, "a_name_j", "left")
    return joined.withColumn("w", F.coalesce(1 / F.sqrt(F.col("f_i") * F.col("f_j")), F.lit(1.0)))


def counted(pairs: DataFrame, skip_gap_pairs: bool = True, only_similar: bool = True, residues: bool = True, transitions: bool = True) -> DataFrame:
    """(cell, n, w): counts and weights, by one pass over aligned pairs (row_i, row_j, w), added up batch by batch before they are shuffled.

    Cells below 25^4 are of transitions, from there on of residue pairs; ``pair_counts_of`` and ``transition_counts_of`` take them apart.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _CELLS + 625 if transitions else 625
        n, w = np.zeros(size, np.int64), np.zeros(size)
        first = size - 625
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.slice(k, 2000)
                i, j = (part.column(c).cast(pa.binary()).to_pylist() for c in (0, 1))
                a, b, pair, weight = _columns(i, j, part.column(2).to_numpy(), skip_gap_pairs, only_similar)
                cell = a * 25 + b
                if residues:
                    n[first:] += np.bincount(cell, minlength=625)
                    w[first:] += np.bincount(cell, weight, minlength=625)
                if transitions:
                    follows = pair[1:] == pair[:-1]
                    cell, weight = (cell[:-1] * 625 + cell[1:])[follows], weight[1:][follows]
                    if len(cell) > _CELLS // 16:
                        n[:_CELLS] += np.bincount(cell, minlength=_CELLS)
                        w[:_CELLS] += np.bincount(cell, weight, minlength=_CELLS)
                    else:
                        cells, place = np.unique(cell, return_inverse=True)
                        n[cells] += np.bincount(place, minlength=len(cells))
                        w[cells] += np.bincount(place, weight, minlength=len(cells))
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells + _CELLS - first), pa.array(n[cells]), pa.array(w[cells])], names=["cell", "n", "w"])

    counts = pairs.filter("row_i is not null and row_j is not null").select("row_i", "row_j", "w").mapInArrow(of, "cell bigint, n bigint, w double")
    return counts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def pair_counts_of(counts: DataFrame) -> DataFrame:
    """``pair_counts`` from what ``counted`` gives."""
    cell = f"(cell - {_CELLS})"
    codes = [F.expr(f"cast({cell} div 25 as int)").alias("a"), F.expr(f"cast({cell} % 25 as int)").alias("b")]
    return counts.filter(F.col("cell") >= _CELLS).select(*codes, "n", "w")


def transition_counts_of(counts: DataFrame) -> DataFrame:
    """``transition_counts`` from what ``counted`` gives."""
    codes = [F.expr(f"cast(cell div {25 ** (3 - k)} % 25 as int)").alias(c) for k, c in enumerate(("a1", "b1", "a2", "b2"))]
    return counts.filter(F.col("cell") < _CELLS).select(*codes, "n", "w")


def pair_counts(pairs: DataFrame, skip_gap_pairs: bool = True, only_similar: bool = True) -> DataFrame:
    """(a, b, n, w): residue pairs in the columns of aligned pairs (row_i, row_j, w), by code.

    ``only_similar`` leaves out pairs of rows without an equal residue.
    """
    return pair_counts_of(counted(pairs, skip_gap_pairs, only_similar, transitions=False))


def transition_counts(pairs: DataFrame, skip_gap_pairs: bool = True, only_similar: bool = True) -> DataFrame:
    """(a1, b1, a2, b2, n, w): pairs of one column followed by pairs of the next, columns with two gaps being skipped."""
    return transition_counts_of(counted(pairs, skip_gap_pairs, only_similar, residues=False))


def without_gaps(transitions: DataFrame) -> DataFrame:
    """Transitions with a gap count nothing."""
    return transitions.filter(F.greatest("a1", "b1", "a2", "b2") != GAP)


def symmetric_pairs(pairs: DataFrame, value: str = "w") -> DataFrame:
    """The mean of each cell and its mirror image; a cell that is missing is 0."""
    mirror = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value)
    return pairs.select("a", "b", value).unionByName(mirror).groupBy("a", "b").agg((F.sum(value) / 2).alias(value))


def symmetric_transitions(transitions: DataFrame, value: str = "w") -> DataFrame:
    """The mean of each transition and its counterpart, in which first and second row change places.

    AB to CD has the counterpart BA to DC; AA to BC and AB to CC have AA to CB and BA to CC, which is the same rule.
    """
    mirror = transitions.select(F.col("b1").alias("a1"), F.col("a1").alias("b1"), F.col("b2").alias("a2"), F.col("a2").alias("b2"), value)
    both = transitions.select("a1", "b1", "a2", "b2", value).unionByName(mirror)
    return both.groupBy("a1", "b1", "a2", "b2").agg((F.sum(value) / 2).alias(value))


def transition_probabilities(transitions: DataFrame, value: str = "w") -> DataFrame:
    """Adds p: the share of a transition among all that start at the same pair."""
    start = Window.partitionBy("a1", "b1")
    return transitions.withColumn("p", F.col(value) / F.sum(value).over(start))


def transition_quantity(transitions: DataFrame, mode: str = "local") -> DataFrame:
    """Adds q in [0, 1], 1 for transitions that were not seen.

    local: -ln p over the largest of the same start; global: over the largest of all; direct: 1 - p over the largest p of
    the same start. A start with one certain transition has q = 0.
    """
    p = F.col("p")
    seen = p > 1e-15
    if mode == "direct":
        top = F.max("p").over(Window.partitionBy("a1", "b1"))
        return transitions.withColumn("q", F.when(seen, 1 - p / top).otherwise(1.0))
    cost = F.when(seen, -F.log(p))
    if mode == "local":
        top = F.max(cost).over(Window.partitionBy("a1", "b1"))
        return transitions.withColumn("q", F.when(~seen, 1.0).when(top > 0, cost / top).otherwise(0.0))
    largest = transitions.agg(F.max(cost)).first()[0] or 0.0
    return transitions.withColumn("q", F.when(~seen, 1.0).otherwise(cost / largest) if largest > 0 else F.when(~seen, 1.0).otherwise(0.0))


def log_odds(pairs: DataFrame) -> DataFrame:
    """(a, b, p, odds, score): for pure residues, log2 of P(ab) over P(a) P(b), from symmetric weights; -20 where odds are 0.

    P(ab) are shares of all weights, P(a) their margins. All 400 cells are given; without any pair all are -20.
    """
    pure = symmetric_pairs(pairs.filter((F.col("a") < PURE) & (F.col("b") < PURE)))
    grid = pairs.sparkSession.range(PURE * PURE).select(F.expr(f"cast(id div {PURE} as int)").alias("a"), F.expr(f"cast(id % {PURE} as int)").alias("b"))
    pure = grid.join(pure, ["a", "b"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = pure.groupBy(F.lit(0).alias("_k")).agg(F.sum("w").alias("_all"))
    p = pure.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").withColumn("p", F.coalesce(F.try_divide("w", "_all"), F.lit(0.0)))  # one row is broadcast
    p = p.withColumn("p_a", F.sum("p").over(Window.partitionBy("a"))).withColumn("p_b", F.sum("p").over(Window.partitionBy("b")))
    odds = F.coalesce(F.try_divide("p", F.col("p_a") * F.col("p_b")), F.lit(0.0))
    return p.withColumn("odds", odds).withColumn("score", F.when(odds < 1e-9, -20.0).otherwise(F.log2(odds))).select("a", "b", "p", "odds", "score")


def relative_entropy_scale(odds: DataFrame) -> DataFrame:
    """(relative_entropy, scale): sum of p times score, and max(2, round(2 / sqrt of it)); unseen pairs add nothing."""
    h = odds.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("score")).otherwise(0.0)).alias("relative_entropy"))
    return h.withColumn("scale", F.greatest(F.lit(2.0), F.coalesce(F.round(F.try_divide(F.lit(2.0), F.sqrt("relative_entropy"))), F.lit(2.0))))


def _stands() -> list[tuple[int, int]]:
    """Which pure residues each of the 23 stands for: B for D and N, Z for E and Q, X for all, any other for itself."""
    at = ALPHABET.index
    return [(at("B"), at(c)) for c in "ND"] + [(at("Z"), at(c)) for c in "QE"] + [(at("X"), k) for k in range(PURE)] + [(k, k) for k in range(PURE)]


def ambiguous_transitions(quantities: DataFrame) -> DataFrame:
    """(a1, b1, a2, b2, q) for all 23 residues: means over what B, Z and X stand for; transitions without a row have q = 1."""
    spark = quantities.sparkSession
    codes = ("a1", "b1", "a2", "b2")
    grid = spark.range(PURE**4).select(*(F.expr(f"cast(id div {PURE ** (3 - k)} % {PURE} as int)").alias(c) for k, c in enumerate(codes)))
    rows = grid.join(quantities.select(*codes, "q"), list(codes), "left").withColumn("q", F.coalesce("q", F.lit(1.0)))
    for c in codes:  # mean by mean, as each is over one code
        stands = F.broadcast(spark.createDataFrame(_stands(), f"_to int, {c} int"))  # 44 rows
        rest = [x for x in codes if x != c]
        rows = rows.join(stands, c).groupBy(*rest, F.col("_to").alias(c)).agg(F.avg("q").alias("q"))
    return rows.select(*codes, "q")


def with_ambiguous(odds: DataFrame, residue_share: DataFrame) -> DataFrame:
    """(a, b, score) of the pure residues with B, Z and X: means weighted by the shares of what they stand for.

    ``residue_share`` has (a, f). B stands for N and D, Z for Q and E, X for all.
    """
    spark = odds.sparkSession
    stands = F.broadcast(spark.createDataFrame(_stands(), "to int, a int")).join(residue_share, "a").withColumnRenamed("f", "g")
    left = stands.select(F.col("to").alias("x"), "a", "g")
    right = stands.select(F.col("to").alias("y"), F.col("a").alias("b"), F.col("g").alias("h"))
    rows = odds.select("a", "b", "score").join(left, "a").join(right, "b")
    weight = F.col("g") * F.col("h")
    return rows.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("score"))


def residue_shares(rows: DataFrame) -> DataFrame:
    """(a, n, f): how often each pure residue occurs in ``rows`` (row), and its share."""
    letters = rows.select(F.explode(F.split("row", "")).alias("letter"))
    counts = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    coded = counts.select(code(F.col("letter")).alias("a"), "n").filter(F.col("a") < PURE)
    total = coded.groupBy(F.lit(0).alias("_k")).agg(F.sum("n").alias("_all"))
    return coded.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").select("a", "n", (F.col("n") / F.col("_all")).alias("f"))  # one row is broadcast
