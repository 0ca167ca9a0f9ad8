import datetime

from pyspark.sql import functions as F

from seqlattice.streaming.compact import canonical_path, compact, has_record, land

SCHEMA = "file_id bigint, out_ref_fasta string, out_in_fasta string, content string, n_bytes bigint, written_at timestamp_ntz"


def _day(n):
    return datetime.datetime(2020, 1, n)


def _write(spark, rows, path, mode="overwrite"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def test_paths(spark):
    cases = {" in/../ref\\a.fa ": "ref/a.fa", "./in//sup/./a": "in/sup/a", "a/..": "", "../a": "../a", "/../a": "/a", "In/a": "In/a", "a/../../b": "../b", "\tin/a ": "in/a", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", canonical_path(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in rows} == cases


def test_records(spark):
    rows = spark.createDataFrame([(None,), ("",), ("; x\n",), ("x>y",), (">a",), ("\r\n>a",), ("x\r>a",)], "c string")
    assert [r.h for r in rows.select(has_record(F.col("c")).alias("h")).collect()] == [False, False, False, False, True, True, True]


def test_compaction(spark, tmp_path):
    source, work = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    rows = [
        (1, "ref/a.fa", None, ">x\nAC\n", 6, _day(1)), (2, None, "./ref//a.fa", ">x\nACD\n>y\nE", 9, _day(2)), (3, "ref/A.fa", None, ">z\nG", 4, _day(1)), (4, "b", None, "", 0, _day(1)),
        (5, "c", None, ">old\nA", 5, _day(3)), (6, "c", None, ">new\nA", 5, _day(3)), (7, "d", None, ">gone\nA", 5, _day(1)), (8, "d", None, None, None, _day(9)), (9, None, None, ">lone\nA", 5, None), (10, "e", None, ">first\nA", 5, None), (11, "e", None, ">second\nA", 5, _day(1)),
    ]
    _write(spark, rows, source)
    got = {r.file_id: r.carried for r in compact(spark, source, work).collect()}
    assert {k for k, v in got.items() if not v} == {1, 4, 5, 7, 8, 10}
    held = spark.read.parquet(f"{work}/compacted")
    assert sorted((r.name, r.record_no, r.seq) for r in held.collect()) == [("lone", 1, "A"), ("new", 1, "A"), ("second", 1, "A"), ("x", 1, "ACD"), ("y", 2, "E"), ("z", 1, "G")]
    # a later run takes up only the file that came since
    _write(spark, [(12, "ref/A.fa", None, ">zz\nGG", 4, _day(5))], source, "append")
    assert land(spark, source, work).count() == 12
    again = {r.file_id: r.carried for r in compact(spark, source, work).collect()}
    assert again[12] and not again[3] and len(again) == 12
    # with everything there, nothing is landed twice
    assert land(spark, source, work).count() == 12


def test_one_file_as_source_and_an_empty_table(spark, tmp_path):
    source = tmp_path / "t.parquet"
    _write(spark, [], str(tmp_path / "dir"))
    next((tmp_path / "dir").glob("part-*.parquet")).rename(source)
    assert compact(spark, str(source), str(tmp_path / "work")).count() == 0


def test_number_of_output_files(spark, tmp_path):
    source = str(tmp_path / "t.parquet")
    _write(spark, [(k, f"f{k}", None, ">a\n" + "A" * 100, 103, _day(1)) for k in range(200)], source)
    compact(spark, source, str(tmp_path / "work"), target_bytes=8000)
    files = list((tmp_path / "work" / "compacted").glob("part-*.parquet"))
    assert 1 <= len(files) <= 3
    assert spark.read.parquet(str(tmp_path / "work" / "compacted")).count() == 200


def test_output_files_are_of_like_size_and_as_many_as_wanted(spark, tmp_path):
    source, work = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    rows = [(k, f"f{k}", None, "".join(f">a{j}\n{'A' * 60}\n" for j in range(1 + k % 5)), None, _day(1)) for k in range(600)]
    rows.append((600, "large", None, "".join(f">b{j}\n{'C' * 60}\n" for j in range(900)), None, _day(1)))  # a third of all
    _write(spark, rows, source)
    total = sum(len(r[3]) for r in rows)
    target = total // 33 + 1
    compact(spark, source, work, target_bytes=target)
    held = spark.read.parquet(f"{work}/compacted").groupBy(F.input_file_name().alias("f")).agg(F.sum(F.length("seq") + F.length("name") + 3).alias("n"), F.count(F.lit(1)).alias("records")).collect()
    assert 20 <= len(held) <= 50 and max(r.n for r in held) < 2 * target
    assert sum(r.records for r in held) == 1800 + 900 and sum(r.n for r in held) == total


def test_intermediates_can_be_cleared(spark):
    from pathlib import Path

    from seqlattice import workspace

    df = workspace.stored(spark.range(3))
    path = Path(workspace._made[-1].removeprefix("file:"))
    assert df.count() == 3 and path.exists()
    workspace.clear(spark)
    assert not path.exists() and not workspace._made
