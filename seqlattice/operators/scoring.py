"""Configuration, normalised metrics and step costs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.functions.alphabet import GAP, PRE, RANK


@dataclass(frozen=True)
class AlignConfig:
    """Options of an alignment run.

    gap_open, gap_extend: path gap scores; part_open, part_extend: those of the partition function. epsilon: share of the
    transition quantity in a step; gamma: share of a second metric in the first. posterior: share of the posterior in
    profiles. beta, beta_tq: Boltzmann weights of scores and transition quantities. refinements, consistency: repeats.
    mode: how scores become distances, 0 by range to [0, 1], 1 by slope only, 2 by sign only. keep_order: rows in the order
    of merging.
    """

    gap_open: float = -11.0
    gap_extend: float = -0.3
    part_open: float = -22.0
    part_extend: float = -1.0
    epsilon: float = 0.775
    gamma: float = 0.0
    posterior: float = 0.7
    beta: float = 0.2
    beta_tq: float = 1.5
    refinements: int = 10
    consistency: int = 2
    mode: int = 0
    keep_order: bool = False
    scale: int = 1000


def _slope(low: float, high: float, mode: int) -> tuple[float, float]:
    if mode == 0:
        a = -1 / (high - low)
        return a, -a * high
    return (-1 / (high - low), 0.0) if mode == 1 else (-1.0, 0.0)


def normalised(scores: DataFrame, config: AlignConfig, second: DataFrame | None = None) -> DataFrame:
    """(a, b, d): scores as distances, by the range over all cells, mixed with ``second`` (a, b, d) by gamma."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    a, b = _slope(low, high, config.mode)
    d = scores.select("a", "b", (F.col("score") * a + b).alias("d"))
    if second is None or config.gamma == 0:
        return d
    mixed = d.join(second.withColumnRenamed("d", "_d"), ["a", "b"], "left")
    return mixed.select("a", "b", ((1 - config.gamma) * F.col("d") + config.gamma * F.coalesce("_d", F.lit(0.0))).alias("d"))


def step_costs(scores: DataFrame, quantities: DataFrame | None, config: AlignConfig) -> DataFrame:
    """(a1, b1, a2, b2, cost, boltzmann): every step from a pair (24 being the start) to a pair, gaps being code 23.

    cost = (1 - epsilon) times the difference + epsilon times the transition quantity; a gap opens unless the other row had
    one just before; boltzmann = exp(beta score) exp(-beta_tq quantity). ``quantities`` (a1, b1, a2, b2, q) holds 1 where it
    has no row; without it, and from the start, the quantity is 0.
    """
    spark = scores.sparkSession
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    a, b = _slope(low, high, config.mode)
    cells = spark.range(25 * 25 * 24 * 24).select(
        F.expr("cast(id div 14400 as int)").alias("a1"), F.expr("cast(id div 576 % 25 as int)").alias("b1"), F.expr("cast(id div 24 % 24 as int)").alias("a2"), F.expr("cast(id % 24 as int)").alias("b2")
    )
    table = scores.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "score", (F.col("score") * a + b).alias("d"))
    rows = cells.join(F.broadcast(table), ["a2", "b2"], "left")  # 23 by 23 rows
    if quantities is None:
        q = F.lit(0.0)
    else:
        rows = rows.join(quantities.select("a1", "b1", "a2", "b2", "q"), ["a1", "b1", "a2", "b2"], "left")
        q = F.when((F.col("a1") == PRE) | (F.col("b1") == PRE), 0.0).otherwise(F.coalesce("q", F.lit(1.0)))
    both, none = (F.col("a2") < GAP) & (F.col("b2") < GAP), (F.col("a2") == GAP) & (F.col("b2") == GAP)
    extends = ((F.col("a2") < GAP) & (F.col("b1") == GAP)) | ((F.col("b2") < GAP) & (F.col("a1") == GAP))
    pick = lambda match, opened, longer: F.when(both, match).when(none, 0.0).when(extends, longer).otherwise(opened)
    difference = pick(F.col("d"), config.gap_open * a + b, config.gap_extend * a + b)
    score = pick(F.col("score"), config.part_open, config.part_extend)
    cost = (1 - config.epsilon) * difference + config.epsilon * q
    return rows.select("a1", "b1", "a2", "b2", cost.alias("cost"), (F.exp(config.beta * score) * F.exp(-config.beta_tq * q)).alias("boltzmann"))


@dataclass(frozen=True)
class Scoring:
    """What the kernels need, as arrays of fixed size: scores 23 by 23, and transition quantities 24^4 or None."""

    scores: np.ndarray
    quantities: np.ndarray | None
    config: AlignConfig

    def _slope(self) -> tuple[float, float]:
        return _slope(float(self.scores.min()), float(self.scores.max()), self.config.mode)

    def path(self) -> tuple[np.ndarray, int, int, np.ndarray | None]:
        """Costs before they are cut to whole numbers: pairs 25 by 25, opening, extending, and the quantities' part 24^4 or None."""
        a, b = self._slope()
        c = self.config
        pair = np.zeros((25, 25))
        pair[:RANK, :RANK] = (1 - c.epsilon) * (self.scores * a + b)
        opened, longer = ((1 - c.epsilon) * (g * a + b) for g in (c.gap_open, c.gap_extend))
        return pair, opened, longer, None if self.quantities is None else c.epsilon * self.quantities

    def partition(self) -> tuple[np.ndarray, float, float, np.ndarray | None]:
        """Boltzmann weights: pairs 25 by 25, opening, extending, and factors of quantities 24^4 or None."""
        c = self.config
        pair = np.ones((25, 25))
        pair[:RANK, :RANK] = np.exp(c.beta * self.scores)
        return pair, float(np.exp(c.beta * c.part_open)), float(np.exp(c.beta * c.part_extend)), None if self.quantities is None else np.exp(-c.beta_tq * self.quantities)


    @cached_property
    def path_table(self) -> np.ndarray:
        """Whole-number costs of all steps, 25 by 25 by 24 by 24."""
        pair, opened, longer, extra = self.path()
        return (_table(pair, opened, longer, extra, np.add, 0.0) * self.config.scale).astype(np.int64)

    @cached_property
    def partition_table(self) -> np.ndarray:
        """Boltzmann weights of all steps, 25 by 25 by 24 by 24."""
        return _table(*self.partition(), np.multiply, 1.0)


def _table(pair: np.ndarray, opened: float, longer: float, extra: np.ndarray, join: np.ufunc, none: float) -> np.ndarray:
    """What every step from a pair to a pair costs or weighs; after the start mark the quantity has no part."""
    base = np.broadcast_to(pair[:24, :24], (25, 25, 24, 24)).copy()
    base[:, :, :GAP, GAP] = np.where(np.arange(25) == GAP, longer, opened)[None, :, None]
    base[:, :, GAP, :GAP] = np.where(np.arange(25) == GAP, longer, opened)[:, None, None]
    more = np.full((25, 25, 24, 24), none)
    if extra is not None:
        more[:24, :24] = extra
    return join(base, more)


def collected(scores: DataFrame, quantities: DataFrame | None, config: AlignConfig) -> Scoring:
    """The relations (a, b, score) and (a1, b1, a2, b2, q) as arrays; both have a bounded number of cells."""
    square = np.zeros((RANK, RANK))
    for a, b, score in scores.select("a", "b", "score").collect():  # at most 23 by 23
        square[a, b] = score
    table = None
    if quantities is not None:
        table = np.ones((24, 24, 24, 24))
        got = quantities.filter(F.greatest("a1", "b1", "a2", "b2") <= GAP).select("a1", "b1", "a2", "b2", "q").toPandas()  # at most 24^4
        table[got["a1"], got["b1"], got["a2"], got["b2"]] = got["q"]
    return Scoring(square, table, config)
