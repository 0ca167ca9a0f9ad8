"""Frequency of every distinct term of a text column, with marks for terms too rare or too common."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: What a term is made of, after NFKC and lower-casing; full stops at its ends go.
RUN = "[a-z0-9.]+"
#: Texts of up to so many signs, all of them ASCII, are counted inside the JVM.
_SHORT = 2000
_COUNTS = ArrayType(StructType([StructField("term", StringType()), StructField("n", LongType())]))


@F.pandas_udf(_COUNTS)
def _counted(texts: pd.Series) -> pd.Series:
    def of(text: str) -> list[tuple[str, int]]:
        runs = (x.strip(".") for x in re.findall(RUN, unicodedata.normalize("NFKC", text).lower()))
        return list(Counter(x for x in runs if x).items())

    return texts.map(of)


def _terms(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0)), lambda x: F.btrim(x, F.lit(".")))
    return F.filter(runs, lambda x: x != "")


def term_counts(records: DataFrame, text: str) -> DataFrame:
    """(term, n): of each record each term with its number; null and empty texts have none.

    Long texts and those with a sign beyond ASCII go through Python, as the JVM functions have no NFKC.
    """
    known = records.select(F.col(text).alias("_text")).filter("_text <> ''")
    short = F.col("_text").rlike(r"^\p{ASCII}*$") & (F.length("_text") <= _SHORT)
    counts = F.expr("transform(array_distinct(_terms), t -> struct(t AS term, cast(size(filter(_terms, x -> x = t)) AS bigint) AS n))")
    plain = known.filter(short).select(_terms(F.col("_text")).alias("_terms")).select(F.explode(counts).alias("_t"))
    other = known.filter(~short).select(F.explode(_counted("_text")).alias("_t"))
    return plain.unionByName(other).select("_t.term", "_t.n")


def term_frequencies(records: DataFrame, text: str, n_records: int, min_records: int = 3, max_share: float = 0.02) -> DataFrame:
    """(term, occurrences, n_records, mark) of ``records``, which has one row per record.

    Each record gives its own term counts; these are summed by hash within a partition before they are shuffled, so a
    term that a third of all records hold costs one row per partition. mark is 'rare' below ``min_records`` records,
    'common' above ``max_share`` of ``n_records``, else null; in collections so small that both hold, 'rare'.
    Null and empty texts count as records without terms; an empty table gives an empty result.
    """
    total = term_counts(records, text).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_records"))
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > F.lit(max_share) * F.lit(n_records), "common")
    return total.withColumn("mark", mark)
