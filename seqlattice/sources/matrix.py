"""Reading and writing substitution matrices and transition tables as relations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.functions.alphabet import ALPHABET, GAP, code

_GAPS = "[-*~]"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(no, line) of one small text file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("no", "line"))


def parse_square(lines: DataFrame) -> DataFrame:
    """(a, b, score) of matrix text given as (no, line): comments begin with ``#``, a header of letters, a row per letter.

    A cell stands for its mirror image too, and later lines win; gap rows and columns are skipped, missing cells are 0,
    and a value beyond the header is left out. An empty text gives an empty relation.
    """
    kept = lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != "")).withColumn("w", F.split(F.trim("line"), r"\s+"))
    first = kept.agg(F.min(F.struct("no", "w")).alias("head"))
    cells = kept.join(F.broadcast(first), F.col("no") > F.col("head.no"))  # one row
    cells = cells.select("no", F.col("w")[0].alias("x"), F.posexplode(F.slice("w", 2, 100)).alias("k", "v"), F.col("head.w").alias("header"))
    cells = cells.select("no", "k", code(F.col("x")).alias("a"), code(F.try_element_at("header", F.col("k") + 1)).alias("b"), F.col("v").cast("double").alias("score"))
    cells = cells.filter((F.col("a") < GAP) & (F.col("b") < GAP))
    both = cells.unionByName(cells.select("no", "k", F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return both.groupBy("a", "b").agg(F.max_by("score", F.struct("no", "k")).alias("score"))


def parse_triangle(lines: DataFrame) -> DataFrame:
    """(a, b, score) of a lower-triangle distance text as (no, line): a banner, then a letter and its cells up to itself.

    The columns are in the order of the rows; the result holds both halves.
    """
    kept = lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != "")).withColumn("w", F.split(F.trim("line"), r"\s+"))
    ordered = kept.withColumn("r", F.row_number().over(Window.orderBy("no")) - 1)  # a row per letter
    names = ordered.select(F.col("r").alias("k"), code(F.col("w")[0]).alias("b"))
    cells = ordered.select("r", code(F.col("w")[0]).alias("a"), F.posexplode(F.slice("w", 2, 100)).alias("k", "v")).filter("k <= r").join(names, "k")
    half = cells.select("a", "b", F.col("v").cast("double").alias("score"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).distinct()


def square_text(scores: DataFrame, decimals: int = 3) -> DataFrame:
    """(no, line): the matrix as text, with a gap row and column of zeros; missing cells are 0."""
    letters = ALPHABET[:GAP]
    spark = scores.sparkSession
    pattern = f"%.{decimals}f" if decimals else "%d"
    value = F.format_string(pattern, F.round("score", decimals) if decimals else F.round("score").cast("int"))
    zero = f"{0:.{decimals}f}" if decimals else "0"
    cells = scores.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", value))).alias("row"))  # 23 cells at most
    rows = spark.range(GAP).select(F.col("id").cast("int").alias("a")).join(cells, "a", "left")
    texts = [F.coalesce(F.try_element_at("row", F.lit(b)), F.lit(zero)) for b in range(GAP)]
    letter = F.substring(F.lit(letters), F.col("a") + 1, F.lit(1))
    body = rows.select((F.col("a") + 2).alias("no"), F.concat_ws(" ", letter, *texts, F.lit(zero)).alias("line"))
    fixed = spark.createDataFrame([(0, "# substitution matrix"), (1, " ".join([*letters, "*"])), (GAP + 2, " ".join(["*"] + [zero] * (GAP + 1)))], "no int, line string")
    return body.unionByName(fixed)


def read_matrix(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """(a, b, score) of a matrix file of any of three kinds, told by its first line.

    ``#WEIGHTED MATRIX#`` heads lines ``weight, file``, whose weighted mean is taken (with ``last_wins`` the last file alone);
    a first line that begins with ``#This`` or ``# This`` heads a triangle; anything else is a square.
    """
    lines = lines_of(spark, path)
    first = (lines.filter("no = 0").first() or [0, ""])[1]
    if first.startswith("#WEIGHTED MATRIX#"):
        listed = [r["line"].split(",") for r in lines.filter("no > 0 and trim(line) <> ''").orderBy("no").collect()]  # a list of files
        parts = [(float(w), read_matrix(spark, find_file(name.strip(), [os.path.dirname(path)]), last_wins)) for w, name in listed]
        return parts[-1][1] if last_wins else weighted_mean(parts)
    if first.replace("# ", "#").startswith("#This"):
        return parse_triangle(lines)
    return parse_square(lines)


def weighted_mean(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """The mean of matrices (weight, relation), by weight; a cell that one lacks is 0 in it."""
    total = sum(w for w, _ in parts)
    every = None
    for w, scores in parts:
        scaled = scores.select("a", "b", (F.col("score") * (w / total)).alias("score"))
        every = scaled if every is None else every.unionByName(scaled)
    return every.groupBy("a", "b").agg(F.sum("score").alias("score"))


def identity(spark: SparkSession) -> DataFrame:
    """The built-in matrix with 1 for equal residues and 0 else."""
    return spark.range(GAP * GAP).select(F.expr(f"cast(id div {GAP} as int)").alias("a"), F.expr(f"cast(id % {GAP} as int)").alias("b")).withColumn("score", (F.col("a") == F.col("b")).cast("double"))


def find_file(name: str, folders: list[str]) -> str:
    """The path of a file in any file system that the session reads: as it is, else in the first of ``folders`` that has it."""
    spark = SparkSession.builder.getOrCreate()
    for path in (name, *(os.path.join(f, name) for f in folders)):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return path
    raise FileNotFoundError(name)


def average_ambiguous(scores: DataFrame) -> DataFrame:
    """``scores`` with B as the mean of D and N, Z of E and Q, then X of all other 22, each row before the next.

    Rows and columns are filled alike. Missing cells count as 0.
    """
    grid = scores.sparkSession.range(GAP * GAP).select(F.expr(f"cast(id div {GAP} as int)").alias("a"), F.expr(f"cast(id % {GAP} as int)").alias("b"))
    cells = grid.join(scores.select("a", "b", "score"), ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))  # 23 by 23
    at = ALPHABET.index
    for x, members in ((at("B"), [at("D"), at("N")]), (at("Z"), [at("E"), at("Q")]), (at("X"), [k for k in range(GAP) if k != at("X")])):
        row = cells.filter(F.col("a").isin(members) & (F.col("b") != x)).groupBy("b").agg((F.sum("score") / len(members)).alias("score"))
        corner = row.filter(F.col("b").isin(members)).agg((F.sum("score") / len(members)).alias("score")).select(F.lit(x).alias("b"), "score")
        whole = row.unionByName(corner)
        column = row.select(F.col("b").alias("a"), F.lit(x).alias("b"), "score")
        cells = cells.filter((F.col("a") != x) & (F.col("b") != x)).unionByName(whole.select(F.lit(x).alias("a"), "b", "score")).unionByName(column)
    return cells


def transitions_text(transitions: DataFrame, total: int) -> DataFrame:
    """(no, line) of a transition table (a1, b1, a2, b2, q, p, n): a format line with the number of transitions, then one each."""
    letter = lambda c: F.substring(F.lit(ALPHABET), F.col(c) + 1, F.lit(1))
    no = ((F.col("a1") * 24 + F.col("b1")) * 24 + F.col("a2")) * 24 + F.col("b2") + 1
    line = F.concat_ws(",", F.concat(*(letter(c) for c in ("a1", "b1", "a2", "b2"))), *(F.col(c).cast("string") for c in ("q", "p", "n")))
    head = transitions.sparkSession.createDataFrame([(0, f"format_ITO={total}")], "no int, line string")
    return transitions.select(no.cast("int").alias("no"), line.alias("line")).unionByName(head)


def parse_transitions(lines: DataFrame) -> DataFrame:
    """(a1, b1, a2, b2, q, p, n) of ``transitions_text``, or of the older ``ab cd q`` lines, p and n being null there."""
    kept = lines.filter("trim(line) <> '' and not startswith(line, 'format_')").select(F.trim("line").alias("line"))
    w = kept.select(F.split("line", ",").alias("w")).filter(F.size("w") == 4).select(F.col("w")[0].alias("k"), *(F.col("w")[i].cast("double").alias(c) for i, c in ((1, "q"), (2, "p"), (3, "n"))))
    older = kept.select(F.split("line", r"\s+").alias("w")).filter(F.size("w") == 3)
    older = older.select(F.concat(F.col("w")[0], F.col("w")[1]).alias("k"), F.col("w")[2].cast("double").alias("q"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("n"))
    return w.unionByName(older).select(*(code(F.substring("k", i + 1, 1)).alias(c) for i, c in enumerate(("a1", "b1", "a2", "b2"))), "q", "p", "n")
