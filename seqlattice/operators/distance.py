"""Distances of aligned pairs: shares of equal columns, and entropies of the letters of the two rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqlattice.functions.alphabet import GAP, encoded

STATISTICS = ("gid", "lid", "pdist", "h1", "h2", "mutual", "eer", "eer2", "ecd", "ecdr")


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits, over the last axis; empty rows have none."""
    p = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def _statistics(rows_i: list[bytes], rows_j: list[bytes], sentinel: bool) -> dict[str, np.ndarray]:
    a = [encoded(x) for x in rows_i]
    b = [encoded(x) for x in rows_j]
    n = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    flat_a = np.concatenate([x[:k] for x, k in zip(a, n, strict=True)]).astype(np.int64)
    flat_b = np.concatenate([y[:k] for y, k in zip(b, n, strict=True)]).astype(np.int64)
    pair = np.repeat(np.arange(len(n)), n)
    joint = np.bincount(pair * 625 + flat_a * 25 + flat_b, minlength=len(n) * 625).reshape(-1, 25, 25).astype(np.float64)
    if sentinel:
        joint[:, 24, 24] += 1
    both = joint[:, :GAP, :GAP].sum(axis=(1, 2)) + joint[:, 24, 24]
    equal = np.trace(joint, axis1=1, axis2=2)
    equal_both = equal - joint[:, GAP, GAP]
    total = joint.sum(axis=(1, 2))
    h1, h2, h12 = _entropy(joint.sum(axis=2)), _entropy(joint.sum(axis=1)), _entropy(joint.reshape(len(n), 625))
    mutual = np.maximum(h1 + h2 - h12, 0)
    share = lambda x, y: np.divide(x, y, out=np.zeros(len(n)), where=y > 1e-12)
    lid = share(equal_both, both)
    none = (h1 < 1e-12) & (h2 < 1e-12)
    return {
        "gid": share(equal, total), "lid": lid, "pdist": 1 - lid, "h1": h1, "h2": h2, "mutual": mutual,
        "eer": np.where(none, 0, 1 - (share(mutual, h1) + share(mutual, h2)) / 2), "eer2": np.where(none, 0, 1 - share(mutual, h1 + h2 - mutual)),
        "ecd": h1 - mutual, "ecdr": (h1 + h2 - 2 * mutual) / np.log2(21) / 2,
    }


def pair_statistics(pairs: DataFrame, sentinel: bool = False) -> DataFrame:
    """``pairs`` (aln_id, i, j, row_i, row_j) as (aln_id, i, j, and every distance).

    gid: equal columns, two gaps included, of all; lid: equal ones of those without a gap (0 of none); pdist = 1 - lid; h1, h2
    and mutual: entropies and mutual information of the columns in bits, the gap being a letter; eer, eer2, ecd and ecdr
    from these, 0 where both entropies are 0. Rows of different lengths are compared as far as both go. ``sentinel``
    counts one more column with a mark of its own in both rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                i, j = (part.column(c).cast(pa.binary()).to_pylist() for c in (3, 4))
                got = _statistics(i, j, sentinel)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(got[c]) for c in STATISTICS)], names=["aln_id", "i", "j", *STATISTICS])

    schema = "aln_id string, i int, j int, " + ", ".join(f"{c} double" for c in STATISTICS)
    return pairs.filter("row_i is not null and row_j is not null").select("aln_id", "i", "j", "row_i", "row_j").mapInArrow(of, schema)
