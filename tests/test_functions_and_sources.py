import pytest
from pyspark.sql import functions as F

from seqlattice.functions import residues as R
from seqlattice.operators import curate, family
from seqlattice.operators.pairs import all_pairs
from seqlattice.sources import fasta, matrix
from seqlattice.workspace import lookup_hot, shared_dir


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_gapped(spark):
    assert _one(spark, R.gapped(F.col("s"), F.col("e"), "X"), s="MKLWVE", e="BXYYXBYBXY") == "MK--LW-VE-"
    assert _one(spark, R.gapped(F.col("s"), F.col("e"), "Y"), s="PQRSTAC", e="BXYYXBYBXY") == "P-QR-STA-C"


def test_position_map(spark):
    assert _one(spark, R.position_map(F.col("s")), s="-K-LW--V") == [2, 4, 5, 8]
    assert _one(spark, R.position_map(F.col("s")), s="----") == []


def test_translation(spark):
    assert _one(spark, R.translated(F.col("s")), s="ATGtaaNNNGG-TTUGC") == "MXXXFX"
    assert _one(spark, R.translated(F.col("s")), s="") == ""
    assert _one(spark, R.translated(F.col("s")), s=None) is None
    assert _one(spark, R.translated(F.col("s"), 1), s="ATAAGA") == "MX"
    assert _one(spark, R.back_mapped(F.col("r"), F.col("s")), r="M--XF", s="ATGTAATT") == "ATG------TAATT"


def test_coding_sequence_is_translated_back(spark):
    protein = "ARNDCQEGHILKMFPSTWYV"
    assert _one(spark, R.translated(curate.coding_sequence(F.col("s"))), s=protein) == protein
    assert _one(spark, curate.coding_sequence(F.col("s")), s="BX") == "NNNNNN"


def test_headers(spark):
    assert _one(spark, R.sccs(F.col("s")), s="d1abca_ a.1.2.3 (A:) thing") == "a.1.2.3"
    assert _one(spark, R.sccs(F.col("s")), s="d1abca_ a.1.2.34") is None
    assert _one(spark, R.illegal_symbols(F.col("s")), s="AC-@u*x J") == "u*J"
    assert _one(spark, R.aligned(F.col("s")), s="aC.~-J**") == "AC---X"


def test_fasta(spark, tmp_path):
    text = "; no\n>one two \r\nAC\r\nDE \r\n>\n>three\rGH>I\r"
    files = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ACD")], "file_id bigint, content string")
    got = [tuple(r) for r in fasta.parse(files, "file_id").orderBy("record_no").collect()]
    assert got == [(1, 1, "one two", "ACDE"), (1, 2, "", ""), (1, 3, "three", "GH>I")]
    rows = spark.createDataFrame([("a", 1, "n1", "C" * 61), ("a", 0, None, "D")], "aln_id string, seq_idx int, name string, seq string")
    fasta.write(rows, str(tmp_path / "out"))
    back = fasta.read(spark, str(tmp_path / "out" / "aln_id=a")).orderBy("record_no").collect()
    assert [(r.name, r.seq) for r in back] == [("", "D"), ("n1", "C" * 61)]


def test_file_list(spark, tmp_path):
    (tmp_path / "list").write_text("a, b\nc\n\nd, e\n")
    assert [tuple(r) for r in fasta.file_list(spark, str(tmp_path / "list")).collect()] == [("a", "b"), ("c", None)]


def test_other_formats(spark):
    ali = spark.createDataFrame([("C; x\n>P1;1abc\nstructureX:1abc\nAC/D*\n>P1;2abc\nstructure\nACED*\n",)], "content string")
    assert [(r.name, r.seq) for r in fasta.parse_homstrad(ali).collect()] == [("1abc", "AC-D"), ("2abc", "ACED")]
    xml = spark.createDataFrame([("<a><sequence seq-type='P'><seq-name>s1</seq-name><seq-data>\nAc-D\n</seq-data></sequence><colsco-data>1 0 0 1</colsco-data></a>",)], "content string")
    assert [(r.name, r.seq) for r in fasta.parse_balibase(xml).collect()] == [("s1", "Ac-D")]
    rows = spark.createDataFrame([(1, "q: AC\ns: A-\nq: D\ns: E\n")], "file_id int, content string")
    assert sorted((r.name, r.seq) for r in fasta.parse_colon_rows(rows, "file_id").collect()) == [("q", "ACD"), ("s", "A-E")]


def test_find_file(tmp_path):
    (tmp_path / "m").write_text("")
    assert matrix.find_file("m", ["/nowhere", str(tmp_path)]) == str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        matrix.find_file("other", [str(tmp_path)])


def test_pairs(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 5, "z"), ("b", 0, "w"), (None, 0, "v"), (None, 1, "u")], "aln_id string, seq_idx int, row string")
    assert sorted((r.aln_id, r.i, r.j, r.row_i + r.row_j) for r in all_pairs(rows, "row").collect()) == [("a", 0, 1, "xy"), ("a", 0, 5, "xz"), ("a", 1, 5, "yz")]
    assert all_pairs(rows, limit=5).count() == 1


def test_empty_columns(spark):
    rows = spark.createDataFrame([(1, "a", "A--C"), (2, "a", "-D--"), (3, "b", "--")], "seq_id bigint, aln_id string, row string")
    assert sorted((r.seq_id, r.row) for r in curate.without_empty_columns(rows).collect()) == [(1, "A-C"), (2, "-D-")]


def test_alternated(spark):
    rows = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "k int").repartition(7)
    got = {r.k: r.part for r in curate.alternated(rows, "k").collect()}
    assert all(got[k] == ("train", "test")[k % 2] for k in range(101))


def test_family(spark):
    rows = spark.createDataFrame([("f", 2), ("f", 1), ("g", 3), ("g", 3), ("g", 1), (None, 1), ("h", None)], "key string, value int")
    assert {(r.key, r.value, r.n) for r in family.most_frequent(rows, "key", "value").collect()} == {("f", 1, 1), ("g", 3, 2)}
    listed = spark.createDataFrame([(1, "GROUP_12", "#5; 7.0", "m", 1, 2), (2, " 3 ", "n/a", None, None, None), (3, None, "0", None, None, None)], "row_no int, group_label string, scop_sunid string, matrix_file string, gap_init int, gap_ext int")
    assert [(r.group_no, r.sunids) for r in family.group_map(listed).orderBy("row_no").collect()] == [(12, "5,7"), (3, None), (None, None)]


def test_estimated_family(spark):
    members = spark.createDataFrame([(1, "a", "x", "f"), (2, "a", "y", None), (3, "a", "bad", "g"), (4, "b", None, "g"), (5, "c", "z", None)], "seq_id bigint, aln_id string, a_name string, sccs string")
    groups = spark.createDataFrame([("f", 7), ("g", 3)], "sccs string, group_no bigint")
    hits = spark.createDataFrame([(2, 1), (5, 2)], "query bigint, subject bigint")
    black = spark.createDataFrame([("bad",)], "a_name string")
    assert {tuple(r) for r in family.estimated(members, groups, hits, black).collect()} == {("a", 7, 2), ("b", 3, 1)}


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 1, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("k"), "id")
    keyed = spark.range(0, 400_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = rows.join(keyed, "k", how).agg(F.count("*"), F.sum("v"), F.sum("id")).first()
        assert lookup_hot(rows, keyed, "k", how, hot_share=100).agg(F.count("*"), F.sum("v"), F.sum("id")).first() == want


def test_shared_folder(spark):
    assert shared_dir(spark) != shared_dir(spark)


def test_one_genetic_code_a_sequence(spark):
    rows = spark.createDataFrame([(0, "AGATGAATA"), (1, "AGATGAATA"), (2, "AGATGAATA"), (3, "AGATGAATA"), (4, "AGA")], "k int, s string")
    assert {r.k: r.p for r in rows.select("k", R.translated(F.col("s"), F.col("k")).alias("p")).collect()} == {0: "RXI", 1: "XWM", 2: "SWM", 3: "RXI", 4: None}


def test_group_files(spark, tmp_path):
    from seqlattice.operators import family

    (tmp_path / "sccs").write_text("10, a.1.1.1, d1, 7\n11,a.1.1.2,d2,-\n12, b.1.1.1, d3\n13, a.1.1.1, d4, 8\n")
    assert {tuple(r) for r in family.read_family_groups(spark, str(tmp_path / "sccs")).collect()} == {("a.1.1.1", 8), ("a.1.1.2", None)}
    (tmp_path / "seqs").write_text("Sequence,Group,SCOP sunid\nd1abca_, 3, 55\nd2xyz__,4,56\nshort,1\nd1abca_,5,57\n")
    assert {tuple(r) for r in family.read_sequence_groups(spark, str(tmp_path / "seqs")).collect()} == {("d1abca_", 5), ("d2xyz__", 4)}
