"""Searches of every query in all records."""

import glob

from pyspark.sql import functions as F

from seqlattice.__main__ import main
from seqlattice.operators import align
from seqlattice.operators.distance import pair_statistics
from seqlattice.plans import alignment

FOLDER = "/root/testdata/sf0.001"


def test_every_query_meets_all_records(spark):
    records = alignment._sequences(spark, FOLDER).filter("seq <> ''").select("seq_id", "seq").toPandas()
    want = {(q, s) for q in records.seq_id if q % 20 == 0 for s in records.seq_id if q != s}
    hits = alignment.search_hits(spark, FOLDER).toPandas()
    assert len(hits) == len(want) and set(zip(hits["query"], hits["subject"], strict=True)) == want
    best = hits.sort_values(["query", "eer2", "subject"]).groupby("query").first()
    near = {r.query: (r.subject, r.eer2) for r in alignment.nearest_subject(spark, FOLDER).collect()}
    assert near == {q: (r.subject, r.eer2) for q, r in best.iterrows()}
    some = hits.sort_values(["query", "subject"]).iloc[::97]
    seq = dict(zip(records.seq_id, records.seq, strict=True))
    pairs = spark.createDataFrame([(str(k), 0, 1, seq[r.query], seq[r.subject]) for k, r in enumerate(some.itertuples())], "aln_id string, i int, j int, seq_i string, seq_j string")
    rows = align.gapped_rows(align.path_alignments(pairs, alignment.estimated_scoring(spark, FOLDER)).join(pairs, ["aln_id", "i", "j"])).cache()
    told = {r.aln_id: r.eer2 for r in pair_statistics(rows).select("aln_id", F.round("eer2", 6).alias("eer2")).collect()}
    assert {r.aln_id: (r.row_i, r.row_j, told[r.aln_id]) for r in rows.collect()} == {str(k): (r.row_i, r.row_j, r.eer2) for k, r in enumerate(some.itertuples())}


def test_search_command_compares_all_if_told(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">q\nARNDCARNEARNDDNRA\n>far\nDDDDDDDD\n")
    (tmp_path / "db.fa").write_text(">s\nNDCARNEARNDDNRAA\n>t\nEEEEEEEEEEE\n")
    main(["search", "--input", f"{tmp_path}/q.fa", "--database", f"{tmp_path}/db.fa", "--output", str(tmp_path / "hits"), "--every"])
    assert glob.glob(f"{tmp_path}/hits/*.csv")
    assert {(r.query_name, r.subject_name) for r in spark.read.csv(str(tmp_path / "hits"), header=True).collect()} == {(q, s) for q in ("q", "far") for s in ("s", "t")}


def test_every_member_without_a_group_votes_by_its_nearest(spark):
    rows = alignment.alignment_rows(spark, FOLDER).select("seq_id", "aln_id", alignment.R.sccs(F.col("a_name")).alias("sccs"))
    groups = alignment.relational.family_vote(spark, FOLDER).select("sccs", "group_no")
    members = rows.join(groups, "sccs", "left").toPandas()
    assert members.group_no.isna().any() and members.group_no.notna().any()
    got = alignment.family_estimate(spark, FOLDER).toPandas()
    assert alignment.relational.family_blacklist(spark, FOLDER).isEmpty()
    assert set(got.aln_id) == set(members.aln_id)
    assert got.n.sum() >= len(members) / 2
