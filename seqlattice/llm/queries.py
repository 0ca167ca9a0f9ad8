"""The registered queries of this subpackage, each over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions.residues import residues
from seqlattice.llm import containers, leakage, overlap, pii, spans, splits, terms
from seqlattice.llm.pii_table import labelled_table
from seqlattice.sources.tables import latest_records, table
from seqlattice.workspace import base_dir, lookup_hot


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    records = latest_records(spark, folder, "a_name")
    n = table(spark, folder, "sequences").agg(F.countDistinct("seq_id")).first()[0]
    return terms.term_frequencies(records, "a_name", n)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_terms(spark, folder).filter("mark is not null").select("term", "mark")


def _group_listings(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "summary_group").select(
        F.try_element_at(splits.numbers(F.col("group_label")), F.lit(1)).alias("group_no"), splits.numbers(F.col("scop_sunid")).alias("sunids")
    )
    return groups.filter("group_no is not null").select("group_no", F.explode("sunids").alias("sunid"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied(_group_listings(spark, folder), "group_no", "sunid").withColumnRenamed("root", "root_group_no")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(seq_id, component, split): tied Groups as one component; without a Group, an alignment is one."""
    records = latest_records(spark, folder, "group_no", "aln_id")
    component = F.coalesce(F.concat(F.lit("group "), F.coalesce("root_group_no", "group_no")), F.concat(F.lit("alignment "), F.col("aln_id")))
    tied = lookup_hot(records, p1_found(spark, folder), "group_no", "left").select("seq_id", component.alias("component"))
    return splits.assign(tied, "component", {"train": 0.8, "valid": 0.1, "test": 0.1})


def _sequence_spans(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "sequences").select(F.col("seq_id").alias("id"), F.col("a_seq").alias("seq"), "loaded_at")
    return spans.verified(spans.paths(records))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = spans.merged(_sequence_spans(spark, folder))
    return runs.select(F.col("id").alias("seq_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with how much of it is shared elsewhere."""
    shared = p4_found(spark, folder).groupBy("seq_id").agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    sizes = latest_records(spark, folder, "a_seq").select("seq_id", F.coalesce(F.length(residues(F.col("a_seq"))), F.lit(0)).alias("n_residues"))
    rows = sizes.join(shared, "seq_id", "left").fillna(0, ["n_shared", "n_spans"])
    return rows.withColumn("share", F.when(F.col("n_residues") > 0, F.col("n_shared") / F.col("n_residues")).otherwise(0.0))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every compacted path: its residues, in how many records and places it lies."""
    return _sequence_spans(spark, folder).groupBy("text").agg(F.length("text").alias("n_residues"), F.countDistinct("id").alias("n_records"), F.count(F.lit(1)).alias("n_places"))


def _split_records(spark: SparkSession, folder: str) -> DataFrame:
    trains = F.when(F.col("split_name").isin("train", "valid", "test"), F.col("split_name") == "train")
    records = table(spark, folder, "sequences")
    return records.select(F.col("seq_id").alias("id"), residues(F.col("a_seq")).alias("seq"), trains.alias("trains"), "loaded_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.overlaps(_split_records(spark, folder))
    return pairs.select(F.least("train_id", "eval_id").alias("seq_id_a"), F.greatest("train_id", "eval_id").alias("seq_id_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source of the evaluation records: how many recur in training, exactly and in all."""
    hit = overlap.overlapping(_split_records(spark, folder)).withColumnRenamed("eval_id", "seq_id")
    records = latest_records(spark, folder, "split_name", "source_db").filter("split_name in ('valid', 'test')")
    return records.join(hit, "seq_id", "left").groupBy("split_name", "source_db").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("n_train").alias("n_overlapping"),
        F.count_if(F.col("exact")).alias("n_exact"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_pairs"),
    )


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of evaluation items, also near ones; which items, and how much of them."""
    items = table(spark, folder, "eval_items")
    return leakage.leaks(_documents(spark, folder), items.select(F.col("item_id").alias("id"), "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).filter(F.col("run") >= leakage.Search().min_run).select("doc_id", "item_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text").filter("id is not null")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container and how full that is."""
    return containers.pack(_documents(spark, folder)).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = pii.find(_documents(spark, folder), pii.stored(labelled_table(spark), base_dir(spark)))
    return spans.select(F.col("id").alias("doc_id"), F.col("kind").alias("pii_kind"), F.col("text").alias("pii_text")).distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders in place of personal information."""
    return pii.redact(_documents(spark, folder), pii.stored(labelled_table(spark), base_dir(spark))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_splits": p1_splits,
    "p1_found": p1_found,
    "p2_terms": p2_terms,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p4_paths": p4_paths,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_containers": p6_containers,
    "p7_leaks": p7_leaks,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

_RESIDUES = """r AS (SELECT seq_id, max(split_name) AS split_name, max(source_db) AS source_db, upper(regexp_replace(max(a_seq), '[^A-Za-z]', '', 'g')) AS s FROM sequences WHERE seq_id IS NOT NULL GROUP BY seq_id)"""
_WORDS = "regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), '[a-z0-9]+')"
#: Full-width signs are all that NFKC changes into parts of terms in these tables; SQL has no NFKC.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_TERMS = f"""rec AS (SELECT seq_id, max(a_name) AS a_name FROM sequences WHERE seq_id IS NOT NULL GROUP BY seq_id),
runs AS (SELECT seq_id, unnest(regexp_extract_all(lower(translate(coalesce(a_name, ''), '{_WIDE[0]}', '{_WIDE[1]}')), '[a-z0-9.]+')) AS r FROM rec),
terms AS (SELECT seq_id, trim(r, '.') AS term FROM runs WHERE trim(r, '.') <> ''),
total AS (SELECT term, count(*) AS occurrences, count(DISTINCT seq_id) AS n_records FROM terms GROUP BY term),
marked AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.02 * (SELECT count(*) FROM rec) THEN 'common' END AS mark FROM total)"""
_SPANS = f"""{_RESIDUES}, w AS (SELECT seq_id, k, substr(s, k, 40) AS x FROM (SELECT seq_id, s, unnest(range(1, length(s) - 38)) AS k FROM r)),
shared AS (SELECT x FROM w GROUP BY x HAVING min(seq_id) < max(seq_id)),
o AS (SELECT seq_id, k, k + 39 AS e FROM w JOIN shared ON w.x = shared.x),
n AS (SELECT *, CASE WHEN k > max(e) OVER (PARTITION BY seq_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS opened FROM o),
g AS (SELECT *, sum(opened) OVER (PARTITION BY seq_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM n),
spans AS (SELECT seq_id, CAST(min(k) AS INTEGER) AS span_start, CAST(max(e) AS INTEGER) AS span_end FROM g GROUP BY seq_id, run)"""
_NEAR = f"""{_RESIDUES}, c AS (SELECT s, length(s) AS n, min(seq_id) AS t, bool_or(split_name = 'train') AS trains, bool_or(split_name IN ('valid', 'test')) AS evals FROM r WHERE s <> '' GROUP BY s),
near AS (SELECT a.s AS sa, b.s AS sb FROM c a JOIN c b ON b.n BETWEEN a.n - a.n // 9 AND a.n + a.n // 9 WHERE a.trains AND b.evals
  AND CASE WHEN abs(a.n - b.n) * 10 <= greatest(a.n, b.n) THEN levenshtein(a.s, b.s) * 10 <= greatest(a.n, b.n) ELSE false END),
pairs AS (SELECT x.seq_id AS train_id, y.seq_id AS eval_id, sa = sb AS exact FROM near JOIN r x ON x.s = sa AND x.split_name = 'train' JOIN r y ON y.s = sb AND y.split_name IN ('valid', 'test'))"""

SQL: dict[str, str] = {
    "p1_found": """WITH RECURSIVE listed AS (SELECT CAST(nullif(regexp_extract(group_label, '[0-9]+'), '') AS BIGINT) AS g,
  unnest(regexp_extract_all(coalesce(scop_sunid, ''), '([0-9]+)(\\.[0-9]+)?', 1)) AS s FROM summary_group),
e AS (SELECT DISTINCT g, CAST(s AS BIGINT) AS s FROM listed WHERE g > 0 AND CAST(s AS BIGINT) > 0),
near AS (SELECT DISTINCT a.g AS g, b.g AS h FROM e a JOIN e b ON a.s = b.s),
reach(g, h) AS (SELECT g, h FROM near UNION SELECT reach.g, near.h FROM reach JOIN near ON reach.h = near.g)
SELECT g AS group_no, min(h) AS root_group_no FROM reach GROUP BY g HAVING count(DISTINCT h) > 1""",
    "p2_terms": f"WITH {_TERMS} SELECT term, occurrences, n_records, mark FROM marked",
    "p2_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_found": f"WITH {_SPANS} SELECT seq_id, span_start, span_end FROM spans",
    "p4_records": f"""WITH {_SPANS}, t AS (SELECT seq_id, CAST(sum(span_end - span_start + 1) AS BIGINT) AS n_shared, count(*) AS n_spans FROM spans GROUP BY seq_id)
SELECT r.seq_id, CAST(coalesce(length(s), 0) AS INTEGER) AS n_residues, coalesce(n_shared, 0) AS n_shared, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN length(s) > 0 THEN coalesce(n_shared, 0) / length(s) ELSE 0.0 END AS share FROM r LEFT JOIN t ON r.seq_id = t.seq_id""",
    "p5_found": f"WITH {_NEAR} SELECT least(train_id, eval_id) AS seq_id_a, greatest(train_id, eval_id) AS seq_id_b FROM pairs",
    "p5_report": f"""WITH {_NEAR}, h AS (SELECT eval_id, bool_or(exact) AS exact, count(*) AS n FROM pairs GROUP BY eval_id)
SELECT split_name, source_db, count(*) AS n_records, count(n) AS n_overlapping, count(*) FILTER (WHERE exact) AS n_exact, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM r LEFT JOIN h ON r.seq_id = h.eval_id WHERE split_name IN ('valid', 'test') GROUP BY split_name, source_db""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 19), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g""",
}
