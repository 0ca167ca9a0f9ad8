import glob

import pytest

from seqlattice.__main__ import main
from seqlattice.plans import jobs
from seqlattice.sources import fasta, matrix


def _text(folder):
    return "\n".join(open(p).read() for p in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)))


def test_align_and_library(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nMKVLAAGI\n>y\nMKVAAGI\n>z\nMKVLAGI\n")
    (tmp_path / "b.fa").write_text(">one\nACDE\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa\n\nnothing\n")
    main(["align", "--file-list", str(tmp_path / "list"), "--output", str(tmp_path / "out"), "--refinements", "2"])
    got = {}
    for path in glob.glob(f"{tmp_path}/out/aln_id=*"):
        got |= {r.name: r.seq for r in fasta.read(spark, path).collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {"x": "MKVLAAGI", "y": "MKVAAGI", "z": "MKVLAGI", "one": "ACDE"}
    assert len({len(got[k]) for k in "xyz"}) == 1
    main(["library", "--input", f"{tmp_path}/a.fa", "--output", str(tmp_path / "lib"), "--distance", "lid"])
    assert "! TC_LIB_FORMAT_01\n3\nx 8 MKVLAAGI" in _text(tmp_path / "lib")


def test_coding(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nATGAAAGTT\n>y\nATGGTT\n")
    main(["align", "--input", f"{tmp_path}/a.fa", "--output", str(tmp_path / "out"), "--coding", "0", "--posterior", "0"])
    got = [r.seq for r in fasta.read(spark, *glob.glob(f"{tmp_path}/out/aln_id=*")).orderBy("record_no").collect()]
    assert [x.replace("-", "") for x in got] == ["ATGAAAGTT", "ATGGTT"] and len(got[0]) == len(got[1]) == 9


def test_count_and_use(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nARND-ARND\n>y\nARNDCARNE\n>z\nARN--ARND\n")
    main(["count", "--input", f"{tmp_path}/a.fa", "--output", str(tmp_path / "out"), "--modes", "012"])
    scores = {(r.a, r.b): r.score for r in matrix.read_matrix(spark, glob.glob(f"{tmp_path}/out/matrix/part-*")[0]).collect()}
    assert scores[0, 0] > 0 > scores[0, 1]
    table = matrix.parse_transitions(spark.read.text(f"{tmp_path}/out/transitions").selectExpr("0 AS no", "value AS line"))
    assert table.count() == 24**4 and table.filter("q < 1").count() > 0
    (tmp_path / "q.fa").write_text(">q\nARNDCARNEARNDDNRA\n>far\nDDDDDDDD\n")
    (tmp_path / "db.fa").write_text(">s\nNDCARNEARNDDNRAA\n>t\nEEEEEEEEEEE\n")
    main(["search", "--input", f"{tmp_path}/q.fa", "--database", f"{tmp_path}/db.fa", "--output", str(tmp_path / "hits"), "--matrix", glob.glob(f"{tmp_path}/out/matrix/part-*")[0]])
    assert [(r.query_name, r.subject_name) for r in spark.read.csv(str(tmp_path / "hits"), header=True).collect()] == [("q", "s")]


def test_illegal_symbols_are_named(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC\n>y\nAJ\n")
    with pytest.raises(ValueError, match="sequence 2 has the symbol 'J'"):
        jobs.sequences_of(spark, [f"{tmp_path}/a.fa"])


def test_one_genetic_code_a_sequence(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nATGAGAGTT\n>y\nATGTGAGTT\n")
    main(["align", "--input", f"{tmp_path}/a.fa", "--output", str(tmp_path / "out"), "--coding", "0", "1", "--posterior", "0"])
    got = [r.seq for r in fasta.read(spark, *glob.glob(f"{tmp_path}/out/aln_id=*")).orderBy("record_no").collect()]
    assert got == ["ATGAGAGTT", "ATGTGAGTT"]
    with pytest.raises(ValueError, match="2 sequences for 3 genetic codes"):
        main(["align", "--input", f"{tmp_path}/a.fa", "--output", str(tmp_path / "no"), "--coding", "0", "1", "1"])


def test_other_forms_and_timings(spark, tmp_path, caplog):
    (tmp_path / "a.ali").write_text("C; comment\n>P1;one\nstructureX:1abc\nAC/DE*\n>P1;two\nACDE*\n")
    (tmp_path / "a.txt").write_text("one: ACDE\ntwo: ACE\n\none: FG\ntwo: FG\n")
    (tmp_path / "a.xml").write_text("<a><sequence seq-type='p'><seq-name>one</seq-name><seq-data>ACDE</seq-data></sequence><sequence><seq-name>two</seq-name><seq-data>ACE</seq-data></sequence><colsco-data>1 1 0 1</colsco-data></a>")
    for form, name in (("homstrad", "a.ali"), ("colon", "a.txt"), ("balibase", "a.xml")):
        rows = jobs.sequences_of(spark, [f"{tmp_path}/{name}"], form).orderBy("seq_idx").collect()
        assert [(r.seq_idx, r.name) for r in rows] == [(0, "one"), (1, "two")]
    with caplog.at_level("INFO", "seqlattice"):
        main(["align", "--input", f"{tmp_path}/a.txt", "--format", "colon", "--output", str(tmp_path / "out"), "--average-ambiguous", "--refinements", "1"])
    assert "profiles, trees and merging" in caplog.text
    assert {r.seq.replace("-", "") for r in fasta.read(spark, *glob.glob(f"{tmp_path}/out/aln_id=*")).collect()} == {"ACDEFG", "ACEFG"}


def test_search_of_all_with_all_and_the_nearest_alone(spark, tmp_path):
    (tmp_path / "db.fa").write_text(">s\nNDCARNEARNDDNRAA\n>t\nEEEEEEEEEEE\n>u\nNDCARNEARNDDNRA\n")
    main(["search", "--database", f"{tmp_path}/db.fa", "--output", str(tmp_path / "all")])
    rows = spark.read.csv(str(tmp_path / "all"), header=True).collect()
    assert {(r.query_name, r.subject_name) for r in rows} == {(x, y) for x in "stu" for y in "stu"}
    main(["search", "--database", f"{tmp_path}/db.fa", "--output", str(tmp_path / "near"), "--limit", "1"])
    assert {(r.query_name, r.subject_name) for r in spark.read.csv(str(tmp_path / "near"), header=True).collect()} == {("s", "s"), ("t", "t"), ("u", "u")}
