"""Far too many small files: a checkpointed streaming compactor.

Deliveries of tiny FASTA files are discovered once each by a file stream whose checkpoint lies in the shared folder. Every
available batch is written under its batch number, and a batch that is tried again replaces what it wrote. From the landed
batches the last version of each file is settled, and its sequences are written to few files of a wanted size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.workspace import lookup_hot, shared_dir, stored

LANDED = "file_id bigint, written_at timestamp_ntz, content string, file_key string, has_record boolean"


def canonical_path(path: Column) -> Column:
    """The place a path leads to: blanks around it void, ``\\`` as ``/``, ``.`` and ``..`` as steps, repeated ``/`` once.

    A ``..`` above the start stays in a relative path and is void in an absolute one. Null stays null.
    """
    clean = F.regexp_replace(F.translate(path, "\\", "/"), r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    steps = F.filter(F.split(clean, "/"), lambda x: (x != "") & (x != "."))
    absolute = clean.startswith("/")

    def step(done: Column, x: Column) -> Column:
        climb = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        stay = F.when(absolute, done).otherwise(F.concat(done, F.array(x)))
        return F.when(x != "..", F.concat(done, F.array(x))).when(climb, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(stay)

    joined = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(joined)


def has_record(content: Column) -> Column:
    """Whether some line starts with ``>``; lines end with LF, CR or both. Null and empty contents have none."""
    return F.coalesce(content.rlike(r"(^|[\r\n])>"), F.lit(False))


def sequences_of(files: DataFrame, *keep: str) -> DataFrame:
    """One row per record of ``content``: ``keep``, record_no from 1, name, seq.

    A record starts at a line that starts with ``>``; what stands before the first one is dropped, a cut-off last line
    is kept. Line ends of all kinds and blanks at the ends of lines go from the residues.
    """
    lines = F.regexp_replace(F.coalesce("content", F.lit("")), r"\r\n?", "\n")
    parts = F.slice(F.split(F.concat(F.lit("\n"), lines), "\n>"), 2, 2**31 - 1)
    rows = files.select(*keep, F.posexplode(parts).alias("_no", "_part"))
    name = F.regexp_replace(F.substring_index("_part", "\n", 1), r"\s+$", "")
    body = F.when(F.instr("_part", "\n") > 0, F.expr("substring(_part, instr(_part, '\\n') + 1)")).otherwise(F.lit(""))
    return rows.select(*keep, (F.col("_no") + 1).alias("record_no"), name.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def land(spark: SparkSession, source: str, work: str, bytes_per_batch: int = 32 << 30) -> DataFrame:
    """All deliveries of the table at ``source``, landed under ``work`` batch by batch, with file_key and has_record.

    Calling it again with the same ``work`` takes up only files that came since.
    """
    schema = spark.read.parquet(source).schema
    # a file stream takes a path for a folder unless it is a pattern; this one matches just the source, file or folder
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source + "{}")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(
            "file_id", "written_at", "content",
            canonical_path(F.coalesce("out_ref_fasta", "out_in_fasta")).alias("file_key"), has_record(F.col("content")).alias("has_record"),
        )
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{work}/landed/batch={number}")

    spark.createDataFrame([], LANDED).write.mode("overwrite").parquet(f"{work}/landed/batch=-1")  # so that there is one
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(LANDED).parquet(f"{work}/landed")


def settle(landed: DataFrame) -> DataFrame:
    """``landed`` with is_last: whether the delivery is the last version of its file.

    Later is the larger written_at (null is the earliest), if equal the larger file_id; a row that was landed twice
    counts once. A delivery without a path is a file of its own.
    """
    key = F.coalesce("file_key", F.concat(F.lit("\0"), F.col("file_id").cast("string")))
    rows = landed.withColumn("_key", key)
    age = F.coalesce(F.col("written_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    last = rows.groupBy("_key").agg(F.max(F.struct(age.alias("at"), F.col("file_id").alias("id"))).alias("_last"))
    return lookup_hot(rows, last, "_key").withColumn("is_last", F.col("file_id") == F.col("_last.id")).drop("_key", "_last")


def compact(spark: SparkSession, source: str, work: str, target_bytes: int = 128 << 20) -> DataFrame:
    """(file_id, file_key, carried) for every delivery; the sequences of the carried ones lie in ``work``/compacted.

    Carried are last versions with at least one record. They come out as (bytes of their contents / ``target_bytes``) files of
    like size: records are spread over that many tasks just before they are written, so that a large file of many records
    is divided too, while the join and the parser run in as many tasks as their own shuffle has, and in no fewer than there
    will be files where these are more. The output is written as a whole under one name, so a repeated run replaces it.
    """
    landed = land(spark, source, work)
    settled = settle(landed.select("file_id", "written_at", "file_key", "has_record", F.octet_length("content").cast("bigint").alias("size")))
    carry = F.col("is_last") & F.col("has_record")
    rows = stored(settled.select("file_id", "file_key", "size", carry.alias("carried")).dropDuplicates(["file_id"]), "settled")
    carried = rows.filter("carried")
    n = max(1, math.ceil((carried.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    contents = landed.filter("has_record").select("file_id", "content")
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):  # so that what one task joins and parses doesn't grow with the whole
        contents = contents.repartition(n, "file_id")
    files = contents.join(carried.select("file_id", "file_key"), "file_id").dropDuplicates(["file_id"])
    sequences_of(files, "file_key").repartition(n, "file_key", "record_no").write.mode("overwrite").option("compression", "zstd").parquet(f"{work}/compacted")
    return rows.select("file_id", "file_key", "carried")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return compact(spark, f"{folder}/fasta_files.parquet", shared_dir(spark, "compact")).filter("not carried").select("file_id")


def p3_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences that the compactor wrote: (file_key, record_no, name, seq)."""
    work = shared_dir(spark, "compact")
    compact(spark, f"{folder}/fasta_files.parquet", work)
    return spark.read.schema("file_key string, record_no int, name string, seq string").parquet(f"{work}/compacted")


_KEY = """regexp_replace(list_reduce(list_prepend('', list_filter(string_split(replace(regexp_replace(coalesce(out_ref_fasta, out_in_fasta), '^\\s+|\\s+$', '', 'g'), chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.')),
  lambda acc, x: CASE WHEN x <> '..' THEN acc || '/' || x WHEN acc = '' OR regexp_matches(acc, '/[.][.]$') THEN acc || '/..' ELSE regexp_replace(acc, '/[^/]+$', '') END), '^/', '')"""
SQL = {
    "p3_found": f"""WITH f AS (SELECT file_id, content, written_at, {_KEY} AS k FROM fasta_files), v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY written_at DESC, file_id DESC) AS n FROM f)
SELECT file_id FROM v WHERE n > 1 OR NOT coalesce(regexp_matches(content, '(^|[\\r\\n])>'), false)""",
    "p3_compacted": f"""WITH f AS (SELECT file_id, content, written_at, {_KEY} AS file_key FROM fasta_files), v AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY written_at DESC, file_id DESC) AS n FROM f),
p AS (SELECT file_key, string_split(chr(10) || regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10) || '>') AS parts FROM v WHERE n = 1 AND regexp_matches(content, '(^|[\\r\\n])>')),
q AS (SELECT file_key, k, parts[k + 1] AS part FROM (SELECT file_key, parts, unnest(range(1, len(parts))) AS k FROM p))
SELECT file_key, CAST(k AS INTEGER) AS record_no, regexp_replace(string_split(part, chr(10))[1], '\\s+$', '') AS name,
  CASE WHEN instr(part, chr(10)) > 0 THEN regexp_replace(substr(part, instr(part, chr(10)) + 1), '\\s', '', 'g') ELSE '' END AS seq FROM q""",
}
