"""The kernels as column functions, for use in SELECT lists and, once registered, in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from seqlattice.functions.alphabet import encoded
from seqlattice.operators.kernels import blocks, path
from seqlattice.operators.scoring import Scoring

_ALIGNED = StructType([StructField("distance", DoubleType()), StructField("script", StringType())])


def path_udf(scoring: Scoring) -> Callable:
    """A function of two residue columns with (distance, script) of their path; null if either is null."""

    def of(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"distance": np.full(len(first), np.nan), "script": None}, dtype=object)
        at = np.flatnonzero((first.notna() & second.notna()).to_numpy())
        a, b = ([encoded(x.encode()) for x in s.iloc[at]] for s in (first, second))
        for part in blocks(np.array([len(x) for x in a], int), np.array([len(x) for x in b], int), 24 << 20):
            cost, scripts = path([a[k] for k in part], [b[k] for k in part], scoring)
            out.iloc[at[part], 0] = cost
            out.iloc[at[part], 1] = scripts
        return out.astype({"distance": float})

    return F.pandas_udf(of, _ALIGNED)
