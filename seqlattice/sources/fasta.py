"""FASTA text as relations, and back; other formats of reference alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.streaming.compact import sequences_of


def parse(files: DataFrame, *keep: str) -> DataFrame:
    """(keep, record_no, name, seq) of FASTA texts in ``content``; see ``sequences_of``. Null and empty texts have no record."""
    return sequences_of(files, *keep)


def read(spark: SparkSession, *paths: str, form: str = "fasta") -> DataFrame:
    """(path, record_no, name, seq) of files of one of ``FORMS``, each read whole by one task."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return FORMS[form](files, "path")


def entry(name: Column, seq: Column, width: int = 60) -> Column:
    """One record as text: ``>name``, then the sequence in lines of ``width``; a null name is empty."""
    return F.concat(F.lit(">"), F.coalesce(name, F.lit("")), F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))


def entries(rows: DataFrame, width: int = 60) -> DataFrame:
    """(aln_id, seq_idx, entry) of rows (aln_id, seq_idx, name, seq)."""
    return rows.select("aln_id", "seq_idx", entry(F.col("name"), F.col("seq"), width).alias("entry"))


def write(rows: DataFrame, path: str, width: int = 60) -> None:
    """One folder of FASTA text per alignment; the records of an alignment are in order and in one file."""
    text = entries(rows, width).repartition("aln_id").sortWithinPartitions("aln_id", "seq_idx")
    text.select("aln_id", F.col("entry").alias("value")).write.mode("overwrite").partitionBy("aln_id").text(path)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(in_path, out_path) of a batch list with one pair a line, up to the first blank line; one path a line is allowed."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    lines = lines.select(F.explode(F.split(F.split("t", r"\n\s*\n", 2)[0], "\n")).alias("line")).filter("trim(line) <> ''")
    parts = F.filter(F.split("line", "[, ]+"), lambda x: x != "")
    return lines.select(F.try_element_at(parts, F.lit(1)).alias("in_path"), F.try_element_at(parts, F.lit(2)).alias("out_path"))


def parse_homstrad(files: DataFrame, *keep: str) -> DataFrame:
    """Records of ``.ali`` texts in ``content``: lines of structure and comments go, ``/`` is a gap, ``*`` ends a record."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^(?:structure[^\n]*|C;[^\n]*)\n?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^>P1;", ">"), "[*]", "")
    return sequences_of(files.withColumn("content", text), *keep).withColumn("seq", F.translate("seq", "/", "-"))


def parse_balibase(files: DataFrame, *keep: str) -> DataFrame:
    """Records of alignment XML in ``content``: residues in core columns upper case, all others lower case."""
    inside = lambda tag, text: F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    flags = F.split(F.trim(F.regexp_replace(inside("colsco-data", F.col("content")), r"\s+", " ")), " ")
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<sequence[ >].*?</sequence>"), F.lit(0))
    rows = files.select(*keep, flags.alias("_flags"), F.posexplode(blocks).alias("_no", "_block"))
    seq = F.split(F.regexp_replace(inside("seq-data", F.col("_block")), r"\s", ""), "")
    cased = F.array_join(F.zip_with(seq, F.slice("_flags", F.lit(1), F.size(seq)), lambda x, f: F.when(f == "1", F.upper(x)).otherwise(F.lower(x))), "")
    return rows.select(*keep, (F.col("_no") + 1).alias("record_no"), F.trim(inside("seq-name", F.col("_block"))).alias("name"), cased.alias("seq"))


def parse_colon_rows(files: DataFrame, *keep: str) -> DataFrame:
    """Records of ``name: residues`` rows in ``content``, rows of a name being joined in order."""
    lines = files.select(*keep, F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n")).alias("_k", "_line"))
    rows = lines.filter(F.instr("_line", ":") > 0).select(*keep, "_k", F.trim(F.substring_index("_line", ":", 1)).alias("name"), F.regexp_replace(F.substring_index("_line", ":", -1), r"\s", "").alias("_s"))
    joined = rows.groupBy(*keep, "name").agg(F.min("_k").alias("record_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]), "").alias("seq"))
    return joined.select(*keep, "record_no", "name", "seq")


#: The forms of sequence files, by name.
FORMS = {"fasta": parse, "homstrad": parse_homstrad, "balibase": parse_balibase, "colon": parse_colon_rows}
