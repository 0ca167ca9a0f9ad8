"""The registered queries over the whole tables of the smallest size."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from seqlattice.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["group_no", "root_group_no"], "p2_found": ["term", "mark"], "p4_found": ["seq_id", "span_start", "span_end"], "p5_found": ["seq_id_a", "seq_id_b"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "pii_kind", "pii_text"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).cache()
    assert rows.count() > 0
    if name in COLUMNS:
        assert rows.columns == COLUMNS[name]
        assert rows.count() == rows.distinct().count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted((tuple(None if pd.isna(x) else round(x, 9) if isinstance(x, float) else x for x in r) for r in df[columns].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_splits_of_the_query_keep_components_together(spark):
    rows = queries.p1_splits(spark, FOLDER).toPandas()
    assert rows.seq_id.is_unique and (rows.groupby("component").split.nunique() == 1).all() and set(rows.split) <= {"train", "valid", "test"}
    records = spark.read.parquet(f"{FOLDER}/sequences.parquet").select("seq_id", "group_no").distinct().toPandas().dropna()
    root = {r.group_no: r.root_group_no for r in queries.p1_found(spark, FOLDER).collect()}
    of = dict(zip(rows.seq_id, rows.split, strict=True))
    seen: dict = {}
    for seq_id, group in records.itertuples(index=False):
        assert seen.setdefault(root.get(group, group), of[seq_id]) == of[seq_id]
    shares = rows.split.value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.1  # a tenth of the rows is one Group
