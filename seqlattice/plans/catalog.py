"""The registered queries of the core, each over its whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlattice.plans import alignment, relational
from seqlattice.streaming import compact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": compact.p3_found,
    "p3_compacted": compact.p3_compacted,
    **relational.QUERIES,
    **alignment.QUERIES,
}

SQL: dict[str, str] = {**compact.SQL, **relational.SQL, **alignment.SQL}
